"""Streaming queries: run over what is there now and return the result (STR1-3)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.plans import queries as core
from tessera.plans.queries import usage
from tessera.session import ready, shared_folder
from tessera.streaming import events as st


def _folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


def stream_daily(spark: SparkSession, d: str) -> DataFrame:
    """STR1, STR2: the event log as a stream, counted per local day."""
    ready(spark)
    folder = _folder(spark)
    usage(spark, d).write.parquet(f"{folder}/in")
    source = st.timed(st.read(spark, f"{folder}/in", spark.read.parquet(f"{folder}/in").schema))
    days = st.collected(st.daily(source, exact=True), f"days_{uuid.uuid4().hex[:8]}", f"{folder}/state")
    return days.select(F.col("day").cast("string").alias("day"), "visits", "searches", "chats", "visitors")


def stream_limit(spark: SparkSession, d: str) -> DataFrame:
    """STR3: at most three accepted events per user in twelve hours, with state."""
    ready(spark)
    folder = _folder(spark)
    spark.read.parquet(f"{d}/events.parquet").select("user_id", F.col("ts").cast("timestamp").alias("ts")).write.parquet(f"{folder}/in")
    source = st.read(spark, f"{folder}/in", spark.read.parquet(f"{folder}/in").schema)
    st.run_to_end(st.limited(source, "user_id", "ts", 3, 43_200, "60 days"), f"{folder}/out", f"{folder}/state")
    return spark.read.parquet(f"{folder}/out").select("user_id", F.col("ts").cast("string").alias("ts"), "accepted")


QUERIES = {"stream_daily": stream_daily, "stream_limit": stream_limit}
ORACLE_SQL = {
    "stream_limit": core.ORACLE_SQL["rate_limit"].replace("select event_id, user_id, accepted from r", "select r.user_id, e.ts::varchar as ts, accepted from r join events e using (event_id)"),
    "stream_daily": """select (ts + interval 3 hour)::date::varchar as day, count(*) filter (event_type = 'view') as visits, count(*) filter (event_type = 'click') as searches, count(*) filter (event_type = 'purchase') as chats, count(distinct user_id) as visitors from events group by 1""",
}
