"""Document fingerprints by randomised edit embedding.

A text is read by a walk shared by all texts: at step j on a character of class c the walk stays or moves on, by a random bit that
depends on j and c only. Texts at a small edit distance come into step again after each edit, so the characters seen at equal steps
agree at most steps: edit distance becomes Hamming distance. The fingerprint keeps four bits for the character seen at a sampled step and the
one after it (which makes chance agreement rarer); steps are sampled by nested levels, and a text's level follows its length, so a fingerprint has 128 to 256 samples (fewer for short texts)
and fingerprints of different levels compare on the steps of the coarser one. Likeness is the share of compared samples that agree.

Near documents are found by bit-sampled banding and verification. Band b of a fingerprint takes the BAND samples whose hashes with b are the
smallest of all its samples, so two fingerprints of nearly as many samples mostly take the same ones. A fingerprint has BANDS bands at its own
level and BANDS at the next coarser one, where it meets texts of up to twice its length. Distinct fingerprints that share a band are compared
by likeness, all of them: a band of more than CROWD is dealt to blocks of which each two meet, and what is connected already is skipped.
Components of pairs of likeness LEAST or more are the classes. A pair of likeness p shares no band with probability (1 - p ** BAND) ** BANDS:
5 % at 0.8, below 1 % at 0.83.

The successor of a document (the next in descending doc_id) comes from range buckets: bounds are those of a range partitioning of the ids
alone, and the first document of each bucket also goes to the bucket before it. Texts travel compressed. A bucket is a task of its own, sorted by
Spark and read as a stream, so its size is no matter for memory; one number per bucket, MOST_BUCKETS at most, reaches the driver.

Defined results. Null text: as empty. Empty text: fingerprint of no samples, likeness 1 to another empty one and 0 to any other. Empty
table: no rows. One document: it is its own successor. Repeated rows: one row each; equal doc_ids are in an order that their texts fix. Null
doc_id: after all others; its class_id is that of its class, null if no other document is in it. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import U64, Scratch, attached, column, load, mix, release, sieve, sifted, slices, strings
from tessera.llm.components import Forest, components

PERIOD, CLASSES, LONGEST = 1 << 16, 64, 8
SAMPLES = 128
#: Text bytes in a bucket, and characters embedded at a time.
BUCKET_BYTES, CHUNK_CHARS = 8 << 20, 4 << 20
MOST_BUCKETS = 20_000
#: With fewer texts than this at work, a plain loop is quicker than array steps.
FEW = 24
BANDS, BAND, LEAST = 16, 8, 0.8
#: Entries of a block of a band, and of a band that is compared pair by pair in plain Python.
CROWD, PLAIN = 512, 12


@lru_cache(1)
def stays() -> tuple[np.ndarray, list[bytes]]:
    """Steps spent on a character of class c that is reached at step j (1 to LONGEST), as a table and as bytes per class."""
    zero = ~np.random.default_rng(40961).integers(0, 2, (PERIOD, CLASSES)).astype(bool)
    out, run = np.ones((PERIOD, CLASSES), np.uint8), np.ones((PERIOD, CLASSES), bool)
    for k in range(LONGEST - 1):
        run &= np.roll(zero, -k, 0)
        out += run
    return out, [out[:, c].tobytes() for c in range(CLASSES)]


@lru_cache(64)
def steps(level: int, size: int) -> np.ndarray:
    """Sampled steps below `size` at a level: those whose hash has at least `level` trailing zeros."""
    j = np.arange(size, dtype=U64)
    return np.flatnonzero(mix(j + U64(0x51ED2701)) & U64((1 << level) - 1) == 0)


def sampled(level: int, end: int) -> np.ndarray:
    found = steps(level, 1 << max(12, int(end).bit_length()))
    return found[: np.searchsorted(found, end)]


def level_of(chars: int) -> int:
    return max(0, (2 * chars // SAMPLES).bit_length() - 1)


def embed(texts: list[str]) -> list[tuple[int, np.ndarray]]:
    """(level, samples of four bits) of each text."""
    out: list[tuple[int, np.ndarray]] = [(0, np.empty(0, np.uint8))] * len(texts)
    order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
    at = 0
    while at < len(order):
        chars, to = 0, at
        while to < len(order) and (to == at or chars + len(texts[order[to]]) <= CHUNK_CHARS):
            chars += len(texts[order[to]])
            to += 1
        _embed([texts[i] for i in order[at:to]], order[at:to], out)
        at = to
    return out


def _embed(texts: list[str], names: list[int], out: list[tuple[int, np.ndarray]]) -> None:
    """texts: longest first."""
    table, rows = stays()
    flat = table.ravel()
    size = np.array([len(x) for x in texts])
    base = np.concatenate([[0], np.cumsum(size)])
    code = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
    kind = np.where(code < 128, code & 63, (code ^ (code >> 6)) & 63).astype(np.uint8)
    reach = np.zeros(base[-1] + 1, np.int32)  # the step at which each character is reached
    common = int(size[FEW]) if len(size) > FEW else 0  # array steps as long as more than FEW texts go on
    ends = np.zeros(len(texts), np.int64)
    j = np.zeros(len(texts), np.int64)
    alive = len(texts)
    for i in range(common):
        while size[alive - 1] <= i:
            alive -= 1
        p = base[:alive] + i
        now = j[:alive]
        reach[p] = now
        now += flat[((now & (PERIOD - 1)) << 6) | kind[p]]
    ends[:] = j
    for d in np.flatnonzero(size > common).tolist():
        step, a, b = int(j[d]), int(base[d]), int(base[d + 1])
        own, mask = [], PERIOD - 1
        for c in kind[a + common : b].tobytes():
            own.append(step)
            step += rows[c][step & mask]
        reach[a + common : b] = own
        ends[d] = step
    following = np.zeros_like(code)
    following[:-1] = code[1:]
    following[base[1:][size > 0] - 1] = 0
    nibble = (mix(code.astype(U64) << U64(21) | following) & U64(15)).astype(np.uint8)
    for d, name in enumerate(names):
        n = int(size[d])
        if n:
            level = level_of(n)
            at = np.searchsorted(reach[base[d] : base[d + 1]], sampled(level, int(ends[d])), side="right") - 1
            out[name] = level, nibble[base[d] + at]


def written(level: int, samples: np.ndarray) -> str:
    """Two hexadecimal digits of level, then a digit per sample."""
    return f"{level:02x}" + (samples + np.where(samples > 9, 87, 48)).astype(np.uint8).tobytes().decode()


def parsed(fingerprint: str) -> tuple[int, np.ndarray]:
    x = np.frombuffer(fingerprint[2:].encode(), np.uint8)
    return int(fingerprint[:2], 16), x - np.where(x > 96, 87, 48).astype(np.uint8)


@lru_cache(256)
def _subset(level: int, coarse: int, n: int) -> np.ndarray:
    """Which of the first n samples of a level are samples of a coarser one."""
    size = 1 << max(12, (n << level).bit_length() + 2)
    found = steps(level, size)[:n]
    return np.flatnonzero(np.isin(found, steps(coarse, size)))


def likeness(a: tuple[int, np.ndarray], b: tuple[int, np.ndarray]) -> float:
    level = max(a[0], b[0])
    x, y = (s if own == level else s[_clip(_subset(own, level, 1 << max(6, len(s).bit_length())), len(s))] for own, s in (a, b))
    most = max(len(x), len(y))
    n = min(len(x), len(y))
    return float((x[:n] == y[:n]).sum() / most) if most else float(len(a[1]) == len(b[1]))


def _clip(places: np.ndarray, n: int) -> np.ndarray:
    return places[: np.searchsorted(places, n)]


def edited(text: str, successor: str) -> str:
    """The last third (rounded down) replaced by as many first characters of the successor."""
    k = len(text) // 3
    return text[: len(text) - k] + successor[:k]


def marked(docs: DataFrame) -> DataFrame:
    """doc_id (the least number for null), mark (the fingerprint) and z, the text compressed."""
    low = F.lit(-(1 << 63)).cast("long")
    rows = docs.select(F.coalesce(docs["doc_id"].cast("long"), low).alias("doc_id"), docs["text"].alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3)
        for whole in batches:
            for b in slices(whole, "text", CHUNK_CHARS):
                texts = strings(column(b, "text"))
                z = [pack.compress(x.encode("utf-8", "surrogatepass")) for x in texts]
                yield pa.RecordBatch.from_arrays([column(b, "doc_id"), pa.array([written(*m) for m in embed(texts)], pa.string()), pa.array(z, pa.binary())], ["doc_id", "mark", "z"])

    return rows.mapInArrow(run, "doc_id long, mark string, z binary")


def with_successor(docs: DataFrame, fn, schema: T.StructType, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """fn(ids, texts, successors, marks, marks of successors) -> columns by name, called on runs of documents in descending doc_id; marks are fingerprints."""
    low = -(1 << 63)
    ids = docs.select(F.coalesce(docs["doc_id"].cast("long"), F.lit(low)).alias("doc_id"), F.octet_length(docs["text"]).cast("long").alias("size"))
    total, = ids.agg(F.sum("size")).first()
    n = min(MOST_BUCKETS, max(1, -(-(total or 0) // bucket_bytes)))
    ranged = ids.select("doc_id").repartitionByRange(n, "doc_id").groupBy(F.spark_partition_id().alias("part")).agg(F.max("doc_id").alias("head"))
    heads = sorted(r["head"] for r in ranged.collect())
    bounds = np.array(heads[:-1], np.int64)  # the greatest id of each bucket but the last
    above = {head: (k + 1) % len(heads) for k, head in enumerate(heads)}  # the bucket that precedes, going down; round at the end

    @F.pandas_udf("array<int>")
    def places(own_ids):
        import pandas as pd

        own = np.searchsorted(bounds, own_ids.to_numpy(), side="left").tolist()
        return pd.Series([[b, above[i]] if i in above else [b] for b, i in zip(own, own_ids.tolist())])

    dealt = marked(docs).select("doc_id", "mark", "z", F.posexplode(places("doc_id")).alias("guest", "bucket"))

    def rows_out(run: list[tuple]) -> pa.RecordBatch:
        cols = fn([None if x[0] == low else x[0] for x in run], *([x[k] for x in run] for k in range(1, 5)))
        return pa.RecordBatch.from_arrays([pa.array(cols[f.name], _ARROW[f.dataType.typeName()]) for f in schema.fields], schema.names)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: tuple | None = None  # (bucket, id, text, mark) that has no successor yet
        unpack = zstandard.ZstdDecompressor()
        held, chars = [], 0
        for b in batches:
            for bucket, guest, i, mark, z in zip(*(column(b, k).to_pylist() for k in ("bucket", "guest", "doc_id", "mark", "z"))):
                text = unpack.decompress(z).decode("utf-8", "surrogatepass")
                if open_ and open_[0] == bucket:
                    held.append((open_[1], open_[2], text, open_[3], mark))
                    chars += len(open_[2])
                    if chars > CHUNK_CHARS:
                        yield rows_out(held)
                        held, chars = [], 0
                        release()
                open_ = None if guest else (bucket, i, text, mark)  # guests come last; the first closes the bucket
        if held:
            yield rows_out(held)

    parts = dealt.select("bucket", "guest", "doc_id", "mark", "z").repartitionById(max(1, len(heads)), F.col("bucket"))
    return parts.sortWithinPartitions("bucket", "guest", F.desc("doc_id"), F.xxhash64("z"), "z").mapInArrow(stream, schema)


_ARROW = {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}
_RESULT = T.StructType([T.StructField(k, t) for k, t in (("doc_id", T.LongType()), ("n_chars", T.LongType()), ("edited_sha256", T.StringType()), ("fingerprint", T.StringType()), ("edited_fingerprint", T.StringType()), ("near_edited", T.DoubleType()), ("near_next", T.DoubleType()))])


def compare_to_edits(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""

    def fn(ids, texts, after, marks, marks_after):
        changed = [edited(x, y) for x, y in zip(texts, after)]
        own, other, following = [parsed(x) for x in marks], embed(changed), [parsed(x) for x in marks_after]
        return {
            "doc_id": ids, "n_chars": [len(x) for x in texts], "edited_sha256": [hashlib.sha256(x.encode("utf-8", "replace")).hexdigest() for x in changed],
            "fingerprint": marks, "edited_fingerprint": [written(*m) for m in other],
            "near_edited": [likeness(a, b) for a, b in zip(own, other)], "near_next": [likeness(a, b) for a, b in zip(own, following)],
        }

    return with_successor(docs, fn, _RESULT)


def fingerprints(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """keep columns and fingerprint string."""
    schema = T.StructType([docs.schema[k] for k in keep] + [T.StructField("fingerprint", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, text, CHUNK_CHARS):
                marks = [written(*m) for m in embed(strings(column(b, text)))]
                yield pa.RecordBatch.from_arrays([*(column(b, k) for k in keep), pa.array(marks, pa.string())], [*keep, "fingerprint"])

    return docs.select(*keep, text).mapInArrow(run, schema)


# --- banding and verification -----------------------------------------------------------------------------------------


def coarser(mark: tuple[int, np.ndarray]) -> np.ndarray:
    """The samples of a fingerprint at the next coarser level."""
    return mark[1][_clip(_subset(mark[0], mark[0] + 1, 1 << max(6, len(mark[1]).bit_length())), len(mark[1]))]


@lru_cache(2048)
def picks(n: int) -> np.ndarray:
    """[band, BAND]: the samples that each band takes of n."""
    h = mix(np.arange(n, dtype=U64)[None, :] * U64(0x9E3779B97F4A7C15) + (np.arange(BANDS, dtype=U64)[:, None] + U64(1)) * U64(0xD1B54A32D192ED03))
    return np.sort(np.argsort(h, 1, kind="stable")[:, : min(BAND, n)], 1)


def bands(level: int, samples: np.ndarray) -> np.ndarray:
    """A 64-bit key per band: of the level, the band, and the places and values of its samples. samples: [fingerprint, sample]."""
    at = picks(samples.shape[1])
    h = mix(((at[None].astype(U64) << U64(4)) | samples[:, at].astype(U64)) * U64(0xA24BAED4963EE407) + U64(1)).sum(2, dtype=U64)
    return mix(h + mix(np.arange(BANDS, dtype=U64) + U64(level << 16) + U64(99))[None, :])


def banded(marks: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of the fingerprint, key, whether at its own level) of all bands. Fingerprints of no samples have none."""
    groups: dict[tuple, list] = {}
    for i, x in enumerate(marks):
        m = parsed(x)
        for own, level, s in ((True, m[0], m[1]), (False, m[0] + 1, coarser(m))):
            if len(s):
                groups.setdefault((own, level, len(s)), []).append((i, s))
    which, key, flag = [np.empty(0, np.int64)], [np.empty(0, U64)], [np.empty(0, bool)]
    for (own, level, _), found in groups.items():
        k = bands(level, np.stack([s for _, s in found]))
        which.append(np.repeat([i for i, _ in found], BANDS)), key.append(k.ravel()), flag.append(np.full(k.size, own))
    return np.concatenate(which), np.concatenate(key), np.concatenate(flag)


def compared(rows: list[tuple], forest: Forest, least: float, across: bool) -> None:
    """rows: node, own, block, fingerprint, of one band (or two blocks of it: then only pairs between the two). Joins those of likeness `least` or more; of
    pairs both of which are at the finer level, their own bands take care."""
    first = min(x[2] for x in rows)
    if len(rows) <= PLAIN:
        parts = [parsed(x[3]) for x in rows]
        for i, x in enumerate(rows):
            for j, y in enumerate(rows[:i]):
                if (x[1] or y[1]) and (not across or x[2] != y[2]) and forest.root(x[0]) != forest.root(y[0]) and likeness(parts[i], parts[j]) >= least:
                    forest.join(x[0], y[0])
        return
    samples = [m[1] if own else coarser(m) for own, m in ((x[1], parsed(x[3])) for x in rows)]
    size = np.array([len(x) for x in samples])
    width = int(size.max())
    table = np.full((len(rows), width), 16, np.uint8)
    for i, x in enumerate(samples):
        table[i, : len(x)] = x
    node, own, side = np.array([x[0] for x in rows]), np.array([x[1] for x in rows]), np.array([x[2] for x in rows]) != first
    one = np.flatnonzero(own)
    step = max(1, (1 << 22) // (len(rows) * width))
    for at in range(0, len(one), step):
        i = one[at : at + step]
        longer = np.maximum(size[i][:, None], size[None, :])
        same = (table[i][:, None, :] == table[None, :, :]).sum(2, dtype=np.int32) - (width - longer)
        near = (same >= least * longer) & (node[i][:, None] != node[None, :])
        near &= side[i][:, None] != side[None, :] if across else ~own[None, :] | (np.arange(len(rows))[None, :] > i[:, None])
        for x, y in zip(*(v.tolist() for v in np.nonzero(near))):
            forest.join(int(node[i[x]]), int(node[y]))


def links(nodes: DataFrame, scratch: Scratch, least: float = LEAST, crowd: int = CROWD) -> DataFrame:
    """nodes: node, fingerprint (distinct). a, b: components of the verified pairs, as (node, smallest node)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            which, key, own = banded(column(b, "fingerprint").to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(column(b, "node").to_numpy()[which]), pa.array(own)], ["band", "node", "own"])

    rows = nodes.select("node", "fingerprint").mapInArrow(run, "band long, node long, own boolean")
    band = W.partitionBy("band")
    live = rows.withColumns({"n": F.count(F.lit(1)).over(band), "some": F.max("own").over(band)}).filter("n > 1 and some")
    live = scratch.keep(live.select("band", "node", "own", F.ceil(F.col("n") / crowd).alias("blocks"))).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    live = live.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    live = live.select("band", F.least("block", "other").alias("left"), F.greatest("block", "other").alias("right"), "block", "node", "own")
    live = live.join(nodes.select("node", "fingerprint"), "node")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, now, held = Forest(), None, []
        for b in batches:
            for band, left, right, *row in zip(*(column(b, k).to_pylist() for k in ("band", "left", "right", "node", "own", "block", "fingerprint"))):
                if (band, left, right) != now:
                    if len(held) > 1:
                        compared(held, forest, least, now[1] != now[2])
                    now, held = (band, left, right), []
                held.append(tuple(row))
        if len(held) > 1:
            compared(held, forest, least, now[1] != now[2])
        yield forest.stars()

    met = live.repartition("band", "left", "right").sortWithinPartitions("band", "left", "right", "node").mapInArrow(meet, "a long, b long")
    return components(scratch.keep(met), scratch)


def classed(rows: DataFrame, scratch: Scratch, least: float = LEAST, crowd: int = CROWD) -> DataFrame:
    """rows (a written table: doc_id, fingerprint and more) with class_id: the smallest doc_id that verified pairs and equal fingerprints reach."""
    nodes = rows.groupBy("fingerprint").agg(F.min("doc_id").alias("id"), F.count(F.lit(1)).alias("n"))
    nodes = scratch.keep(nodes.withColumn("node", F.monotonically_increasing_id()))
    root = links(nodes, scratch, least, crowd)
    root = root.select(F.col("a").alias("node"), F.col("b").alias("root")).union(root.select("b", "b").distinct())
    of = nodes.join(root, "node", "left").filter("root is not null or n > 1")
    ids = of.filter("root is not null").groupBy("root").agg(F.min("id").alias("least"))
    of = scratch.keep(of.join(ids, "root", "left").select("fingerprint", F.coalesce("least", "id").alias("class_id"), "n"))
    # a fingerprint that no other document has and no link touches is its own class; only the others are looked up
    sifted_rows = sifted(rows, F.col("fingerprint"), sieve(of, "fingerprint"), "some")
    found = attached(sifted_rows.filter("some").drop("some"), of, "fingerprint", "class_id")
    alone = sifted_rows.filter("not some").drop("some").withColumn("class_id", F.lit(None).cast("long"))
    return found.unionByName(alone).withColumn("class_id", F.coalesce("class_id", "doc_id"))


def near_classes(docs: DataFrame, least: float = LEAST, crowd: int = CROWD) -> DataFrame:
    """One row per row of docs: those of compare_to_edits, and class_id."""
    scratch = Scratch(docs.sparkSession, "fingerprint")
    rows = scratch.keep(compare_to_edits(docs))
    return classed(rows, scratch, least, crowd).select(*_RESULT.names, "class_id")


def op9_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(load(spark, sf_dir))
