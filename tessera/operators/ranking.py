"""Hybrid ranking of literal and semantic hits (RNK1-6, WIN1, SET1, JN3, JN6, ORD2, ORD3, ORD8).

A batch of queries is one plan: every window is partitioned by query_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.session import col

# Weights of a shared word and of a close chapter, and how many candidates are taken before ranking.
SUBJECT_WEIGHT, TITLE_WEIGHT, CHAPTER_WEIGHT = 0.15, 1.0, 0.8
OVERFETCH, SUBJECT_POOL, TITLE_POOL = 3, 60, 100


def pool(top_k: int, subject: bool, by_title: bool = False) -> int:
    """OPT7: number of nearest vectors fetched."""
    return max(top_k * OVERFETCH, (TITLE_POOL if by_title else SUBJECT_POOL) if subject or by_title else 0)


def text_key(kind: Column | str = "type", source: Column | str = "source", record: Column | str = "record_id", item: Column | str = "id") -> Column:
    """RNK6: what two vectors of one text share."""
    return F.when(col(kind) == "structured_hadith", F.concat_ws("#", col(source), col(record))).otherwise(col(item))


def owner(item: Column | str = "id") -> Column:
    """JN3: the item whose text is shown."""
    return F.regexp_replace(col(item), "~matn$", "")


def hydrated(hits: DataFrame, texts: DataFrame) -> DataFrame:
    """JN3: hits with the stored text of their owner; a hit's own text where none is stored."""
    stored = texts.select(F.col("item_id").alias("_owner"), F.col("text").alias("_stored"))
    own = F.col("text") if "text" in hits.columns else F.lit(None).cast("string")
    return hits.withColumn("_owner", owner("id")).join(stored, "_owner", "left").withColumn("text", F.coalesce(F.nullif("_stored", F.lit("")), own)).drop("_owner", "_stored")


def score(similarity: Column | str, share: Column | str, chapter: Column | str | None = None, by_title: bool = False) -> Column:
    """RNK2/RNK5: similarity, shared words, closeness of the chapter (only in a search by title; 0 where unknown)."""
    out = col(similarity) + F.lit(TITLE_WEIGHT if by_title else SUBJECT_WEIGHT) * col(share)
    return out + CHAPTER_WEIGHT * F.coalesce(col(chapter), F.lit(0.0)) if by_title and chapter is not None else out


def shown(similarity: Column | str) -> Column:
    """RNK4."""
    return F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), col(similarity))), 4)


def nulls_last(*cols: Column | str) -> Column:
    """A place that orders by these columns, rows without a value last, as SQL's ORDER BY has them; a plain struct puts them first."""
    return F.struct(*[c for i, x in enumerate(map(col, cols)) for c in (x.isNull().alias(f"no{i}"), x.alias(f"v{i}"))])


def merged(exact: DataFrame, close: DataFrame, top_k: int, blank: bool = False) -> DataFrame:
    """SET1/WIN1/ORD8: exact hits, then close ones; each text once, at its first place; at most top_k per query.

    exact and close: query_id, key, text, similarity, place (order within its branch), and any columns both have. blank: blank texts are hits too,
    and no text is needed."""
    both = exact.withColumn("branch", F.lit(0)).unionByName(close.withColumn("branch", F.lit(1)))
    if not blank:
        both = both.filter(~tx.blank("text"))
    first = F.row_number().over(W.partitionBy("query_id", "key").orderBy("branch", "place"))
    once = both.withColumn("_n", first).filter("_n = 1").drop("_n")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("branch", "place", "key"))
    return once.withColumn("rank", rank).filter(F.col("rank") <= top_k).drop("branch", "place")


def projected(hits: DataFrame) -> DataFrame:
    """PRJ2: the fields of a result; empty ones are null."""
    gone = lambda c: F.nullif(F.col(c), F.lit(""))
    return hits.select("query_id", "rank", "id", "text", shown("similarity").alias("similarity"), "word_overlap", F.coalesce("type", F.lit("document")).alias("kind"), gone("hukm").alias("hukm"), gone("mohaddith").alias("mohaddith"), gone("topic").alias("topic"), F.coalesce(gone("reference"), gone("source")).alias("source"))
