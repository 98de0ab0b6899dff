"""Order-dependent operators as windows (WIN1-10, JN4, JN10, AGG10, SRC20). Every window is partitioned; none spans a whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.session import col


def keep_first(df: DataFrame, key: list[str], order: list[Column | str]) -> DataFrame:
    """WIN1/SNK6: the first row of each key."""
    return df.withColumn("_n", F.row_number().over(W.partitionBy(*key).orderBy(*order))).filter("_n = 1").drop("_n")


def suffixed(df: DataFrame, id: str, order: list[Column | str], out: str = "unique_id") -> DataFrame:
    """WIN2: repeats of an id get -b, -c and so on."""
    n = F.row_number().over(W.partitionBy(id).orderBy(*order))
    return df.withColumn(out, F.when(n == 1, F.col(id).cast("string")).otherwise(F.concat(F.col(id).cast("string"), F.lit("-"), F.char(F.lit(96) + n))))


def filled(df: DataFrame, part: list[str], order: list[Column | str], reset: Column, value: Column | str, out: str) -> DataFrame:
    """WIN3: the last value so far, forgotten where `reset` holds."""
    w = W.partitionBy(*part).orderBy(*order)
    group = df.withColumn("_g", F.sum(reset.cast("int")).over(w))
    return group.withColumn(out, F.last(col(value), ignorenulls=True).over(W.partitionBy(*part, "_g").orderBy(*order))).drop("_g")


def ends(df: DataFrame, part: list[str], start: str, end: Column, out: str = "end") -> DataFrame:
    """WIN4: an item ends where the next begins."""
    return df.withColumn(out, F.coalesce(F.lead(start).over(W.partitionBy(*part).orderBy(start)), end))


def changes(df: DataFrame, part: list[str], order: list[Column | str], value: str, out: str = "changed") -> DataFrame:
    """WIN5: whether the value differs from the row before; false on the first."""
    return df.withColumn(out, F.coalesce(F.lag(value).over(W.partitionBy(*part).orderBy(*order)) != F.col(value), F.lit(False)))


def offsets(df: DataFrame, part: list[str], order: list[Column | str], length: Column | str, out: str = "offset") -> DataFrame:
    """WIN6: where each piece starts when pieces are joined by one character."""
    w = W.partitionBy(*part).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return df.withColumn(out, F.coalesce(F.sum(col(length) + 1).over(w), F.lit(0)).cast("long"))


def runs(df: DataFrame, part: list[str], order: list[Column | str], value: str, out: str = "run", strict: bool = False) -> DataFrame:
    """WIN7: number of the run of non-decreasing values a row is in, with its length and the row's place in it."""
    w = W.partitionBy(*part).orderBy(*order)
    before = F.lag(value).over(w)
    broken = F.coalesce((F.col(value) <= before) if strict else (F.col(value) < before), F.lit(False))
    found = df.withColumn(out, F.sum(broken.cast("int")).over(w))
    own = W.partitionBy(*part, out)
    return found.withColumn(f"{out}_place", F.row_number().over(own.orderBy(*order))).withColumn(f"{out}_length", F.count(F.lit(1)).over(own))


def front_matter(df: DataFrame, part: list[str], order: list[Column | str], number: str, narration: str, least: int = 50) -> DataFrame:
    """WIN7: rows from the first narration numbered 1 after which numbers rise for `least` rows; all rows where there is none.

    A row begins such a run when at least `least` rows of its own run of rising numbers are left, itself included."""
    found = runs(df, part, order, number)
    start = (F.col(number) == 1) & F.col(narration) & (F.col("run_length") - F.col("run_place") + 1 >= least)
    w = W.partitionBy(*part)
    place = found.withColumn("_p", F.row_number().over(w.orderBy(*order)))
    first = place.withColumn("_s", F.min(F.when(start, F.col("_p"))).over(w))
    return first.filter(F.col("_s").isNull() | (F.col("_p") >= F.col("_s"))).drop("_p", "_s", "run", "run_place", "run_length")


def blocks(df: DataFrame, part: list[str], order: list[Column | str], size: int, out: str = "block") -> DataFrame:
    """WIN8/WIN10: consecutive blocks of `size` rows, and each row's ordinal."""
    n = F.row_number().over(W.partitionBy(*part).orderBy(*order))
    return df.withColumn("ordinal", n).withColumn(out, F.floor((n - 1) / size).cast("long"))


def limited(events: DataFrame, key: str, ts: str, limit: int, seconds: int, out: str = "accepted") -> DataFrame:
    """WIN9: a sliding-window limiter: an event is refused when `limit` accepted ones lie within the window; refused ones do not count.

    A fold over each key's sorted times, in batches of a key's rows, holding the last `limit` accepted times only."""
    from collections import deque
    from collections.abc import Iterator

    import pyarrow as pa
    from pyspark.sql import types as T

    schema = T.StructType([*events.schema.fields, T.StructField(out, T.BooleanType())])
    names = events.columns

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now_key, taken = object(), deque()
        for b in batches:
            flags = []
            for k, t in zip(b.column(names.index(key)).to_pylist(), b.column(names.index(ts)).cast(pa.timestamp("us")).cast(pa.int64()).to_pylist()):
                if k != now_key:
                    now_key, taken = k, deque()
                while taken and taken[0] <= t - seconds * 1_000_000:
                    taken.popleft()
                flags.append(len(taken) < limit)
                if flags[-1]:
                    taken.append(t)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(flags)], schema.names)

    order = [c for c in names if c not in (key, ts)]
    return events.repartition(key).sortWithinPartitions(key, ts, *order).mapInArrow(fold, schema)


def as_of(left: DataFrame, right: DataFrame, part: list[str], at: str, start: str, values: list[str]) -> DataFrame:
    """JN10: for each left row, the values of the last right row that starts at or before it, per part; one union, one sort.

    left: part columns and at; right: part columns, start and values."""
    keys = [F.col(c) for c in part]
    rest = [c for c in left.columns if c not in part]
    a = left.select(*keys, F.col(at).alias("_at"), F.lit(1).alias("_side"), F.struct(*rest).alias("_row"), F.lit(None).cast(right.select(F.struct(*values)).schema[0].dataType).alias("_value"))
    b = right.select(*keys, F.col(start).alias("_at"), F.lit(0).alias("_side"), F.lit(None).cast(left.select(F.struct(*rest)).schema[0].dataType).alias("_row"), F.struct(*values).alias("_value"))
    w = W.partitionBy(*part).orderBy("_at", "_side").rowsBetween(W.unboundedPreceding, 0)
    found = a.unionByName(b).withColumn("_value", F.last("_value", ignorenulls=True).over(w)).filter("_side = 1")
    return found.select(*part, "_row.*", "_value.*")


def ordered_lookup(ids: DataFrame, table: DataFrame, key: str = "id") -> DataFrame:
    """JN4/SRC18: rows of the table in the order asked for; unknown ids are dropped. ids: pos, key."""
    return ids.join(table, key).orderBy("pos")


def repeated(df: DataFrame, id: str, order: str, shown: int = 10) -> DataFrame:
    """AGG10: ids that occur again, in the order of their second occurrence."""
    n = F.row_number().over(W.partitionBy(id).orderBy(order))
    return df.withColumn("_n", n).filter("_n = 2").select(id, order).orderBy(order).limit(shown)


def sampled(df: DataFrame, id: str, n: int = 200, seed: int = 7) -> DataFrame:
    """SRC20: n rows in an order that depends on id and seed only."""
    return df.orderBy(F.md5(F.concat_ws(":", F.col(id).cast("string"), F.lit(str(seed)))), id).limit(n)
