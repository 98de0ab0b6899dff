"""Sinks: events, records, tables, text, and reports as files (SNK9-14, SNK16, SNK22, STR1)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.scalars import guarded, visitor_hash

TYPES = ("visit", "search", "chat")


def prepared_events(raw: DataFrame, salt: str) -> DataFrame:
    """SNK9/FLT15: events as they are stored: salted visitor, empty strings as null; `ok` is false for what the store refuses."""
    none = lambda c: F.nullif(F.col(c), F.lit(""))
    ok = F.col("type").isin(*TYPES) & (F.length(F.coalesce("visitor_id", F.lit(""))) <= 200) & (F.length(F.coalesce("result", F.lit(""))) <= 50)
    ok = ok & F.coalesce(F.col("latency_ms").between(0, 600_000), F.lit(True))
    return raw.select("type", F.when(F.coalesce("visitor_id", F.lit("")) != "", visitor_hash(salt, "visitor_id")).alias("visitor_hash"), none("query").alias("query"), none("result").alias("result"), "latency_ms", "created_at", F.coalesce(ok, F.lit(False)).alias("ok"))


def append_events(events: DataFrame, path: str) -> None:
    """SNK9: accepted events by day; refused ones beside them."""
    ok = events.filter("ok").drop("ok").withColumn("day", F.to_date("created_at"))
    ok.write.mode("append").partitionBy("day").parquet(path)
    events.filter("not ok").drop("ok").write.mode("append").parquet(f"{path.rstrip('/')}_refused")


def records_json(records: DataFrame, path: str) -> None:
    """SNK10: one JSON object per line, letters as they are."""
    records.write.mode("overwrite").json(path)


def text_lines(texts: DataFrame, path: str, text: str = "text") -> None:
    """SNK13."""
    texts.select(F.col(text).alias("value")).write.mode("overwrite").text(path)


def sheets(tables: dict[str, DataFrame], path: str) -> None:
    """SNK11: one CSV folder per sheet; cells that would be formulas are quoted."""
    for name, df in tables.items():
        safe = df.select(*[(guarded(f.name) if f.dataType.typeName() == "string" else F.col(f.name)).alias(f.name) for f in df.schema])
        safe.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{path.rstrip('/')}/{name}")


def emptied(df: DataFrame) -> DataFrame:
    """SNK16: the same columns, no rows."""
    return df.limit(0)


def removed(spark: SparkSession, folder: str, pattern: str) -> int:
    """SNK22: deletes matching files of a folder; bytes freed."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/{pattern}")
    fs, freed = path.getFileSystem(spark._jsc.hadoopConfiguration()), 0
    for s in fs.globStatus(path) or []:
        freed += fs.getContentSummary(s.getPath()).getLength()
        fs.delete(s.getPath(), True)
    return freed
