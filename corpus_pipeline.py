"""Corpus pipeline over `documents`: quality classifier, exact dedup, near-dedup, personal data, packing.

Each stage is written as Parquet and read again as the next one's input. All stages but the last return the columns of `documents`; the
last returns one row per packed piece.

Defined results. Rows without doc_id pass all stages; near-dedup links them with nothing. Null and empty texts: the classifier scores them like any
other, exact dedup keeps the first, packing gives the end token alone. Empty tables: no rows. Ties and repeated rows: the row with the smallest
doc_id stays, of rows of equal doc_id the first as numbered. Extra columns, whatever their names, stay up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import exact_dedup, near_dedup, packing, pii, quality
from tessera.llm.common import Scratch, load


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier (fitted on the labels of the documents at hand) does not reject."""
    return quality.keep_good(docs, load(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the smallest doc_id."""
    return exact_dedup.keep_first(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity of 0.8 or more), the row with the smallest doc_id."""
    return near_dedup.keep_one(docs, percent=80)


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with surrogates (under a public key, for synthetic data; give your own for anything else); n_chars follows the text."""
    out = pii.replace(docs, pii.TEST_KEY)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    return packing.sequences(docs).select(*packing.PIECES.names)


STAGES = [("quality", keep_good), ("exact dedup", drop_copies), ("near dedup", drop_near_copies), ("personal data", hide_personal_data), ("packing", pack)]
#: The classifier, near-dedup, surrogates and packing have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the last stage: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset. Only the stages' results stay in the shared folder."""
    docs, scratch = load(spark, sf_dir), Scratch(spark, "pipeline")
    for _, stage in STAGES[:-1]:
        opened = len(Scratch.opened)
        docs = scratch.keep(stage(spark, docs, sf_dir))
        Scratch.sweep(opened)  # the tables of the stage's operators; its result is written
    return STAGES[-1][1](spark, docs, sf_dir)
