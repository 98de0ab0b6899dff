"""Exact dedup by a tree-merge of sorted digest runs, in DataFrame operations only.

Every input partition is a run: its rows' digests, sorted, one entry per digest with the smallest identifier and a count. In each round
a block of `fan_in` runs merges into one (a binomial round generalised to several partners), keeping the smallest identifier and adding
the counts; after log(runs) rounds a single logical run, itself spread over partitions by digest, holds every group. The answers go
down the same tree. An exchange therefore never holds more than `fan_in` entries of one digest per run, whatever share of the table
one text has: a group of copies is collapsed inside its own partition first, and the answer for it fans out level by level.

Defined results. Null text: equal to empty text. Empty table: no rows. Repeated rows: rows with equal doc_id and equal text are copies
of each other, exactly one of them stays (the first by position). Null doc_id: such a row stays only if all its copies have none.
Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import SPACE_CLASS, Scratch, load, sieve, sifted

FAN_IN = 8


def normalised(text):
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE_CLASS, " ")


def assign(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", fan_in: int = FAN_IN, row: str | None = None) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256, text_bytes (of the normalised text) and row (the column of
    that name, or a number given here).

    Groups are equal SHA-256 digests with equal byte lengths; min over (has doc_id, doc_id, position) verifies the smallest identifier
    at every level."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "exact")
    n_text = normalised(docs[text])
    runs = docs.select(
        docs[doc_id].cast("long").alias("doc_id"),
        F.unhex(F.sha2(n_text, 256)).alias("digest"),
        F.octet_length(n_text).cast("long").alias("size"),
        F.spark_partition_id().cast("long").alias("run"),
        (docs[row] if row else F.monotonically_increasing_id()).alias("row"),
    ).sortWithinPartitions("digest", "doc_id")
    runs = scratch.keep(runs)
    best = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("row"))
    level = runs.groupBy("run", "digest", "size").agg(F.min(best).alias("best"), F.count(F.lit(1)).alias("n"))
    level = scratch.keep(level.select(F.col("run"), "digest", "size", "best", "n"))
    last = level.agg(F.max("run")).first()[0] or 0
    levels = [level]
    for _ in range(math.ceil(math.log(last + 1, fan_in) - 1e-9) if last else 0):
        up = F.expr(f"run div {fan_in}")
        merged = levels[-1].groupBy(up.alias("run"), "digest", "size").agg(F.min("best").alias("best"), F.sum("n").alias("n"))
        levels.append(scratch.keep(merged))
    answer = levels[-1]
    for below in levels[-2::-1]:
        entry = below.select(F.col("run").alias("own"), F.expr(f"run div {fan_in}").alias("run"), "digest", "size")
        answer = entry.join(answer, ["run", "digest", "size"]).select(F.col("own").alias("run"), "digest", "size", "best", "n")
    answer = answer.select("run", "digest", "size", F.col("best.doc_id").alias("keep_id"), F.col("best.row").alias("keep_row"), "n")
    return runs.join(answer, ["run", "digest", "size"]).select(
        "doc_id", "keep_id", F.col("n").alias("group_size"), (F.col("row") == F.col("keep_row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"), F.col("size").alias("text_bytes"), "row",
    )


def keep_first(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of docs that stay, all columns. Rows are numbered and written once, since doc_id need not tell them apart. Only rows that a sieve of the numbers that
    go does not let through at once are shuffled."""
    row, flag = (f"{x}_{uuid.uuid4().hex}" for x in ("row", "maybe"))
    scratch = Scratch(docs.sparkSession, "exact-rows")
    rows = scratch.keep(docs.withColumn(row, F.monotonically_increasing_id()))
    gone = scratch.keep(assign(rows, text, doc_id, row=row).filter("not kept").select(F.col("row").alias(row)))
    marked = sifted(rows, F.col(row), sieve(gone, row), flag)
    stay = marked.filter(~F.col(flag)).select(*docs.columns)
    return stay.unionByName(marked.filter(flag).join(gone, row, "left_anti").select(*docs.columns))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign(load(spark, sf_dir)).drop("text_bytes", "row")


ORACLE_SQL = r"""
with t as (select doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) as text_sha256 from documents)
select doc_id, min(doc_id) over w as keep_id, count(*) over w as group_size, doc_id = min(doc_id) over w as kept, text_sha256
from t window w as (partition by text_sha256)
"""
