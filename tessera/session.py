"""Small things every module needs: loading tables, and letting Python workers import this package."""

from __future__ import annotations

import tempfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = str(Path(__file__).resolve().parents[1])


#: Bytes of a batch that goes to or from a Python worker, and Spark's own default, which alone is replaced.
BATCH_BYTES, DEFAULT_BATCH_BYTES = 8 << 20, 64 << 20


def ready(spark: SparkSession) -> SparkSession:
    """Python workers find this package whatever folder the driver was started in, and get batches of bounded bytes, however long texts are."""
    batch = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(batch) in (f"{DEFAULT_BATCH_BYTES}b", str(DEFAULT_BATCH_BYTES), "64MB", "64m"):
        spark.conf.set(batch, str(BATCH_BYTES))
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = f"{ROOT}:{env['PYTHONPATH']}" if env.get("PYTHONPATH") else ROOT
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset, in a local session only, a temporary one, kept for the session."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="tessera-")
        spark.sparkContext.setCheckpointDir(found)
    return found


#: Tables of texts, whose rows take long to process.
HEAVY = ("documents", "pages")


def spread(df: DataFrame) -> DataFrame:
    """A table that was written as fewer row groups than there are cores is dealt out; a larger one is left as it is read."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = ready(spark).read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name in HEAVY else df


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c
