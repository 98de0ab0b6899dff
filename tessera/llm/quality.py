"""Quality classifier: regularised quadratic discriminant on transformed document statistics.

Each document becomes a vector of logarithms of simple statistics (length, word length, shares of character classes, repetition). Per
class: mean and covariance, shrunk towards the pooled covariance (the more, the fewer rows the class has) and towards a scaled identity. The model
keeps the inverses of the Cholesky factors, made once, so a batch of documents costs one product per class, and a score is the logistic of the difference of log densities (with class priors). The fit uses moments added up over all labelled
training rows; no sample is drawn, and only sums of fixed size (classes x dimensions squared) reach the driver.

Defined results. Null or empty text: the statistics of an empty text, scored like any other. Empty documents: no rows. No training label
at all: every score is 0.5; labels of one class only: every score is that class; one row of a class is enough to tell it apart. Repeated rows are scored each; a label row that occurs
n times weighs n times. Null labels are not used. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import Scratch, column, load, mix, owner, raw, remainder, slices, windows, word_hashes, words

#: Shares of the pooled covariance and of the scaled identity in a class covariance.
POOLED, RIDGE = 0.1, 0.02
THRESHOLD = 0.3
#: A log-density difference beyond this counts as this.
LARGEST = 30.0
DIMENSIONS = 12
_CLASS = np.zeros(256, np.int64)
for _k, _chars in enumerate(("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", ".,;:'\"-()?", "#$%&*@~^_=+<>\\/{}[]`", "!", "|", "\n\r\x0b\x0c", " \t"), 1):
    _CLASS[np.frombuffer(_chars.encode(), np.uint8)] = _k
_CLASS[0x80:0xC0] = 10  # inside a character of several bytes
_CLASS[0xC0:] = 2  # begins one: counts as a letter


def statistics(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """One row of DIMENSIONS numbers per text."""
    n = len(off) - 1
    count = np.bincount(owner(off) * 11 + _CLASS[data], minlength=11 * n).reshape(n, 11).astype(float)
    chars = np.maximum(1, np.diff(off) - count[:, 10])
    start, end, bounds = words(data, off)
    of, length = owner(bounds), (end - start).astype(float)
    n_words = np.diff(bounds).astype(float)
    some = np.maximum(1, n_words)
    mean = np.bincount(of, length, n) / some
    spread = np.sqrt(np.maximum(0, np.bincount(of, length**2, n) / some - mean**2))
    last = _CLASS[data[end - 1]]
    marked = np.bincount(of, (last == 5) | (last == 6), n) / some
    h = word_hashes(data, start, end)

    def distinct(x: np.ndarray, text: np.ndarray) -> np.ndarray:
        _, first = np.unique(x ^ mix(text.astype(np.uint64) + np.uint64(1)), return_index=True)
        return np.bincount(text[first], minlength=n) / np.maximum(1, np.bincount(text, minlength=n))

    three = windows(h, 3)
    inside = of[: len(three)] == of[2:] if len(three) else np.empty(0, bool)
    letters = np.maximum(1, count[:, 1] + count[:, 2])
    log = lambda x, least: np.log(x + least)
    return np.column_stack([
        log(n_words, 1), log(mean, 0.5), log(spread, 0.5), log(count[:, 1] / letters, 0.01), log(count[:, 3] / chars, 0.01),
        log(count[:, 5] / chars, 0.005), log(count[:, 6] / chars, 0.005), log(count[:, 7] / chars, 0.005), log(count[:, 8] / some, 0.02),
        log(marked, 0.02), log(distinct(h, of), 0.05), log(1 - distinct(three[inside], of[: len(three)][inside]), 0.02),
    ])


@dataclass
class Model:
    prior: tuple[float, float]
    means: list[np.ndarray]
    inverses: list[np.ndarray]  # of the lower Cholesky factors

    def scores(self, x: np.ndarray) -> np.ndarray:
        if not self.means:
            return np.full(len(x), self.prior[1])
        logs = []
        for p, m, inverse in zip(self.prior, self.means, self.inverses):
            z = (x - m) @ inverse.T
            logs.append(np.log(p) + np.log(np.diag(inverse)).sum() - 0.5 * (z**2).sum(1))
        return 1 / (1 + np.exp(-np.clip(logs[1] - logs[0], -LARGEST, LARGEST)))


def discriminant(moments: dict[int, np.ndarray], d: int = DIMENSIONS, pooled: float = POOLED, ridge: float = RIDGE) -> Model:
    """moments: by class, the count, the sums and the sums of products, in one vector."""
    n = [float(moments[c][0]) if c in moments else 0.0 for c in (0, 1)]
    if min(n) < 1:
        return Model((0, 0.5 if not sum(n) else float(n[1] > n[0])), [], [])
    means = [moments[c][1 : d + 1] / n[c] for c in (0, 1)]
    own = [moments[c][d + 1 :].reshape(d, d) / n[c] - np.outer(means[c], means[c]) for c in (0, 1)]
    both = (n[0] * own[0] + n[1] * own[1]) / sum(n)
    inverses = []
    for s, rows in zip(own, n):
        share = max(pooled, (d + 1) / (rows + d + 1))
        s = (1 - share) * s + share * both
        s = (1 - ridge) * s + ridge * np.diag(np.maximum(np.diag(both), 1e-6)) + 1e-9 * np.eye(d)
        inverses.append(np.linalg.inv(np.linalg.cholesky(s)))
    return Model((n[0] / sum(n), n[1] / sum(n)), means, inverses)


def features(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """keep columns and x, the statistics as array<double>."""
    schema = T.StructType([docs.schema[k] for k in keep] + [T.StructField("x", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, text):
                x = statistics(*raw(column(b, text)))
                lists = pa.ListArray.from_arrays(np.arange(0, x.size + 1, DIMENSIONS, dtype=np.int32), x.ravel())
                yield pa.RecordBatch.from_arrays([*(column(b, k) for k in keep), lists], [*keep, "x"])

    return docs.select(*keep, text).mapInArrow(run, schema)


def fit(table: DataFrame, labels: DataFrame, label: str = "quality") -> Model:
    """table: doc_id and x. Uses the labelled rows whose crc32(doc_id as text) mod 5 is not 0."""
    d = DIMENSIONS
    seen = labels.select(labels["doc_id"].alias("doc_id"), labels[label].cast("int").alias("y")).filter("y in (0, 1)")
    rows = table.select("doc_id", "x").join(seen.filter(remainder(F.col("doc_id"), 5) != 0), "doc_id").select("y", "x")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {0: np.zeros(1 + d + d * d), 1: np.zeros(1 + d + d * d)}
        for b in batches:
            x, y = np.array(column(b, "x").flatten()).reshape(-1, d), np.array(column(b, "y"))
            for c in total:
                own = x[y == c]
                total[c] += np.concatenate([[len(own)], own.sum(0), (own.T @ own).ravel()])
        yield pa.RecordBatch.from_pydict({"y": pa.array([0, 1], pa.int32()), "m": pa.array([total[0], total[1]], pa.list_(pa.float64()))})

    sums = rows.mapInArrow(run, "y int, m array<double>").select("y", F.posexplode("m").alias("i", "v")).groupBy("y", "i").agg(F.sum("v").alias("v"))
    found: dict[int, np.ndarray] = {}
    for r in sums.collect():  # 2 * (1 + d + d * d) rows, whatever the input
        found.setdefault(r.y, np.zeros(1 + d + d * d))[r.i] = r.v
    return discriminant({c: m for c, m in found.items() if m[0] > 0})


def score(table: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    schema = T.StructType([table.schema[k] for k in keep] + [T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array(column(b, "x").flatten()).reshape(-1, DIMENSIONS)
            yield pa.RecordBatch.from_arrays([*(column(b, k) for k in keep), pa.array(model.scores(x))], [*keep, "score"])

    return table.select(*keep, "x").mapInArrow(run, schema)


def keep_good(docs: DataFrame, labels: DataFrame, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, all columns, whose score reaches the threshold. Two scans of docs and no shuffle of texts."""
    model = fit(features(docs, text=text), labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, text):
                yield b.filter(pa.array(model.scores(statistics(*raw(column(b, text)))) >= threshold))

    return docs.mapInArrow(run, docs.schema)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = Scratch(spark, "quality").keep(features(load(spark, sf_dir)))
    scored = score(table, fit(table, load(spark, sf_dir, "labels")))
    return scored.select("doc_id", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
