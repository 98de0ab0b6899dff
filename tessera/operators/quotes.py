"""Literal quotes: which passages hold a phrase word for word (TXT6, JN1, ORD5).

A phrase is found by its first three words: every passage's runs of three words are looked up among the phrases' first three, and a
hit is verified on the whole phrase. Up to SMALL phrases of SMALL_BYTES are broadcast, and a passage's text then stays beside its runs in the same
stage; more phrases are joined by hash, runs alone are shuffled, and texts follow for the hits. Nothing is compared pair by pair.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import text as tx

# Bounds of the rule that tells a quote from a formula, and the words of transmission in index form.
MIN_WORDS, LONG_WORDS, MANY, MOST = 3, 8, 20, 60
#: Phrases that are broadcast at most, and their bytes (both measured first).
SMALL, SMALL_BYTES = 100_000, 32 << 20
TRANSMISSION = ("قال", "قالت", "قالا", "قالوا", "عن", "حدثنا", "حدثني", "حدثه", "اخبرنا", "اخبرني", "انبانا", "سمعت", "سمع", "يقول", "رضي")


def with_body(passages: DataFrame, text: str = "text", unicode: bool = True) -> DataFrame:
    """SNK2/STR8: passages with the derived column that phrases are looked up in."""
    return passages.withColumn("body", F.array_join(tx.phrase_words(text, unicode), " "))


def matches(phrases: DataFrame, passages: DataFrame, unicode: bool = True) -> DataFrame:
    """query_id, rowid of every passage that holds the phrase. phrases: query_id, query. passages: rowid, body (see with_body)."""
    asked = phrases.select("query_id", tx.phrase_words("query", unicode).alias("w")).filter(F.size("w") >= MIN_WORDS)
    asked = asked.select("query_id", F.array_join("w", " ").alias("phrase"), F.xxhash64(F.slice("w", 1, 3)).alias("head"))
    w = F.split("body", " ")
    runs = F.explode(F.arrays_zip(w.alias("a"), F.slice(w, 2, 1 << 30).alias("b"), F.slice(w, 3, 1 << 30).alias("c"))).alias("r")
    head = F.xxhash64("r.a", "r.b", "r.c").alias("head")
    held = F.instr(F.concat(F.lit(" "), F.col("body"), F.lit(" ")), F.concat(F.lit(" "), F.col("phrase"), F.lit(" "))) > 0
    size = asked.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("phrase") + 32), F.lit(0)).alias("bytes")).first()
    if size["n"] <= SMALL and size["bytes"] <= SMALL_BYTES:
        hits = passages.select("rowid", "body", runs).select("rowid", "body", head).join(F.broadcast(asked), "head")
    else:
        near = passages.select("rowid", runs).select("rowid", head).join(asked, "head").select("query_id", "rowid", "phrase").distinct()
        hits = near.join(passages.select("rowid", "body"), "rowid")
    return hits.filter(held).select("query_id", "rowid").distinct()


def quotes(phrases: DataFrame, passages: DataFrame, unicode: bool = True) -> DataFrame:
    """query_id, rowid, pos: the first sixty passages by rowid, for phrases that are not too common to name a text."""
    words = tx.index_words("query", unicode)
    rule = phrases.select("query_id", F.size(words).alias("n_words"), F.arrays_overlap(words, F.array(*map(F.lit, TRANSMISSION))).alias("told"))
    found = matches(phrases, passages, unicode)
    counts = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    common = (F.col("n_words") < LONG_WORDS) & (F.col("n") > MANY) & ((F.col("n") > MOST) | F.col("told"))
    kept = counts.join(rule, "query_id").filter(~common).select("query_id")
    ranked = found.join(kept, "query_id", "left_semi").withColumn("pos", F.row_number().over(W.partitionBy("query_id").orderBy("rowid")))
    return ranked.filter(F.col("pos") <= MOST)
