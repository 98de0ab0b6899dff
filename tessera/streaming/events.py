"""Events as streams: the log, daily counts, a limiter with state, progress (STR1-3, STR6).

Event times are UTC; a day begins `hours` before UTC midnight. Streams read the same Parquet folders as the batch reports.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def read(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int | None = None) -> DataFrame:
    """STR1: a growing folder as a stream."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).parquet(path)


def timed(events: DataFrame, ts: str = "created_at") -> DataFrame:
    """A zone-free time as an instant, which watermarks need."""
    return events.withColumn(ts, F.col(ts).cast("timestamp"))


def daily(events: DataFrame, ts: str = "created_at", hours: int = 3, late: str = "1 day", exact: bool = False) -> DataFrame:
    """STR2: counts per local day. Visitors are approximate, unless `exact`, which keeps the hashes of a day's visitors as state; the batch report
    counts them exactly without."""
    start = f"{(24 - hours) % 24} hours"
    counts = [F.count_if(F.col("type") == k).alias(n) for k, n in (("visit", "visits"), ("search", "searches"), ("chat", "chats"))]
    visitors = F.size(F.collect_set("visitor_hash")) if exact else F.approx_count_distinct("visitor_hash")
    w = F.window(ts, "1 day", startTime=start)
    out = events.withWatermark(ts, late).groupBy(w).agg(*counts, visitors.cast("long").alias("visitors"))
    return out.select(F.to_date(F.col("window.start") + F.make_interval(hours=F.lit(hours))).alias("day"), "visits", "searches", "chats", "visitors")


def limited(events: DataFrame, key: str, ts: str, limit: int, seconds: int, late: str | None = None) -> DataFrame:
    """STR3: key, time, accepted. State per key: the times of its accepted events within the window, dropped once the window has passed. Events that come
    later than `late` (the window itself, unless given) after newer ones are dropped, as Spark's watermark has it; those before are counted."""
    key_type = events.schema[key].dataType
    out = T.StructType([T.StructField(key, key_type), T.StructField(ts, T.TimestampType()), T.StructField("accepted", T.BooleanType())])

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        taken = list(state.get[0]) if state.exists else []
        times = pd.concat([b[ts] for b in batches]).sort_values()
        rows = []
        for t in times:
            now = t.timestamp()
            taken = [x for x in taken if x > now - seconds]
            ok = len(taken) < limit
            if ok:
                taken.append(now)
            rows.append((k[0], t, ok))
        state.update((taken,))
        newest = int(max([times.iloc[-1].timestamp(), *taken]) * 1000) + seconds * 1000
        state.setTimeoutTimestamp(max(newest, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(rows, columns=[key, ts, "accepted"])

    marked = events.withWatermark(ts, late or f"{seconds} seconds")
    return marked.groupBy(key).applyInPandasWithState(step, out, "taken array<double>", "append", GroupStateTimeout.EventTimeTimeout)


def run_to_end(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Processes what is there and stops; a second call goes on from the checkpoint."""
    q = stream.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def collected(stream: DataFrame, name: str, checkpoint: str, mode: str = "complete") -> DataFrame:
    """What is there now as a table in memory (for small results such as daily counts)."""
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)


class Progress(StreamingQueryListener):
    """STR6: calls back with the rows done so far, at most once in `every` seconds."""

    def __init__(self, tell, every: float = 1.0):
        import time

        self.tell, self.every, self.clock, self.last, self.rows, self.ended = tell, every, time.monotonic, -1e9, 0, False

    def onQueryStarted(self, event) -> None: ...

    def onQueryProgress(self, event) -> None:
        self.rows += event.progress.numInputRows
        if self.clock() - self.last >= self.every:
            self.last = self.clock()
            self.tell(self.rows)

    def onQueryIdle(self, event) -> None: ...

    def onQueryTerminated(self, event) -> None:
        self.tell(self.rows)
        self.ended = True
