"""Usage reports over an event log (AGG1-5, AGG13, JN5, FLT3, PRJ3, PRJ8, SCL1-3).

A range of local days becomes a half-open range of UTC times, so the filter reaches the Parquet scan and its statistics; the day itself is
only computed for rows that pass. Times are UTC: zone-free timestamps, or instants in a session whose time zone is UTC.
"""

from __future__ import annotations

import time
from concurrent.futures import ThreadPoolExecutor
from datetime import date, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.scalars import RESULT_LABELS, labelled, local_day

MAX_DAYS, TOP = 366, 10


def default_range(today: date) -> tuple[date, date]:
    """SCL2: the last thirty days."""
    return today - timedelta(days=29), today


def in_range(events: DataFrame, first: date, last: date, hours: int = 3, ts: str = "created_at") -> DataFrame:
    """FLT3/OPT1/SCL3."""
    if first > last:
        raise ValueError("the range begins after its end")
    if (last - first).days >= MAX_DAYS:
        raise ValueError(f"a report covers at most {MAX_DAYS} days")
    kind = events.schema[ts].dataType.typeName()
    at = lambda d: F.lit(f"{d} 00:00:00").cast(kind) - F.make_interval(hours=F.lit(hours))
    return events.filter((F.col(ts) >= at(first)) & (F.col(ts) < at(last + timedelta(days=1))))


def _counts() -> list:
    return [F.count_if(F.col("type") == k).alias(n) for k, n in (("visit", "visits"), ("search", "searches"), ("chat", "chats"))] + [F.count_distinct("visitor_hash").alias("visitors")]


def totals(events: DataFrame) -> DataFrame:
    """AGG1: one row; the average is rounded half to even, and null when there is none or it is 0."""
    mean = F.avg(F.when(F.col("type") == "search", F.col("latency_ms")))
    return events.agg(*_counts(), F.bround(F.nullif(mean, F.lit(0.0)), 0).cast("long").alias("avg_latency"))


def daily(events: DataFrame, hours: int = 3, ts: str = "created_at") -> DataFrame:
    """AGG2."""
    return events.groupBy(local_day(ts, hours).alias("day")).agg(*_counts())


def calendar(days: DataFrame, first: date, last: date) -> DataFrame:
    """JN5: every day of the range, zeros where nothing happened."""
    spine = days.sparkSession.range(1).select(F.explode(F.sequence(F.lit(first), F.lit(last))).alias("day"))
    return spine.join(days, "day", "left").na.fill(0)


def top_queries(events: DataFrame, kind: str, n: int = TOP) -> DataFrame:
    """AGG3."""
    rows = events.filter((F.col("type") == kind) & F.col("query").isNotNull())
    return rows.groupBy("query").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "query").limit(n)


def outcomes(events: DataFrame) -> DataFrame:
    """AGG4/PRJ3: result, n and label; ties by result."""
    rows = events.filter((F.col("type") == "search") & F.col("result").isNotNull())
    return rows.groupBy("result").agg(F.count(F.lit(1)).alias("n")).withColumn("label", labelled("result", RESULT_LABELS)).orderBy(F.desc("n"), "result")


def source_totals(sources: DataFrame) -> DataFrame:
    """AGG5/AGG14: ready sources and their passages."""
    return sources.filter("status = 'ready'").agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("chunks"), F.lit(0)).cast("long").alias("chunks"))


def uploads(sources: DataFrame, first: date, last: date, hours: int = 3) -> DataFrame:
    """AGG5: ready sources uploaded in the range."""
    return in_range(sources.filter("status = 'ready'"), first, last, hours, "uploaded_at").agg(F.count(F.lit(1)).alias("uploads"))


def summary_rows(total: DataFrame, first: date, last: date) -> DataFrame:
    """PRJ8: the totals as (label, value) rows; a missing average is a dash."""
    value = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("—"))
    rows = [("الفترة", F.lit(f"من {first} إلى {last}")), ("عدد الزيارات", value("visits")), ("عدد الزوار (فريد)", value("visitors")), ("عمليات البحث", value("searches")), ("أسئلة الحوار", value("chats")), ("متوسط زمن البحث (ms)", value("avg_latency"))]
    rows += [(label, value(c)) for label, c in (("الملفات في قاعدة البيانات", "files"), ("المقاطع المفهرسة", "chunks"), ("ملفات رُفعت خلال الفترة", "uploads")) if c in total.columns]
    return total.select(F.posexplode(F.array(*[F.struct(F.lit(k).alias("label"), v.alias("value")) for k, v in rows])).alias("pos", "r")).select("pos", "r.label", "r.value")


def activity(days: DataFrame) -> DataFrame:
    """AGG13/SNK12: peak and total of the days that saw anything."""
    busy = F.col("visits") + F.col("searches") + F.col("chats")
    return days.filter(busy > 0).agg(F.max("visits").alias("peak"), F.coalesce(F.sum("visits"), F.lit(0)).cast("long").alias("total"), F.count(F.lit(1)).alias("days"))


def checks(probes: dict[str, object], remote: dict[str, object] | None = None) -> list[tuple[str, bool | None, str, float]]:
    """AGG16: name, outcome, detail and seconds of each probe, in the given order; a probe that raises is a row, not an error. Those of `remote`, which wait
    for other services, run side by side."""

    def run(probe) -> tuple[bool | None, str, float]:
        start = time.perf_counter()
        try:
            ok, detail = probe()
        except Exception as e:  # noqa: BLE001  that is the row
            ok, detail = False, f"{type(e).__name__}: {e}"
        return ok, detail, time.perf_counter() - start

    near = [(name, *run(probe)) for name, probe in probes.items()]
    far = remote or {}
    with ThreadPoolExecutor(max(1, len(far))) as pool:
        return near + [(name, *found) for name, found in zip(far, pool.map(run, far.values()))]
