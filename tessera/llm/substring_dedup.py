"""Substring dedup: fixed-block anchors, probed by every rolling window, extended to maximal exact repeats.

A window is WINDOW consecutive words of one document. A word goes if a window that covers it also starts in a document with a smaller
doc_id. Every window wholly holds an aligned block of BLOCK words of its document (2 * BLOCK <= WINDOW), so:

1. Index and probe. Of every document the aligned blocks are reference blocks, and every rolling window of BLOCK words is a probe. Probes
   are dealt to buckets by hash; a value that is a reference block somewhere and occurs in several documents is a hit.
2. Extend. Around every hit, all windows that contain it are looked up among the windows around all other hits, for the smallest doc_id
   that has the same words. Windows that occur in a smaller document, merged, are the maximal repeats.

Documents travel in slices of about SLICE_BYTES, written once, compressed. A slice sends each distinct value once to its bucket, with two flags
or the smallest doc_id, and gets back one bit per value, so no pair of documents is ever formed. A task remembers (up to KNOWN values) what it
has sent: a passage that its slices share is sent by the first of them, and the others know the answer, so a passage that a third of all
documents share costs a bucket an entry or two per task.

Exactness. In step 1 values are 64-bit hashes (32 bits within a bucket), which only add windows to step 2 by chance collisions. In step 2 a
window is 128 bits: two hashes of its words, each from the words' bytes on with a seed of its own. The seeds are drawn at random for each run
and never leave it, so no text can be built to collide, and among 10^13 windows the chance of any collision is below 10^-12.

Defined results. Null or empty text: no words. Fewer than WINDOW words: nothing goes. Empty table: no rows. A repeat inside one document, or
between rows of equal doc_id, does not count. Null doc_id: larger than all others. Extra columns are ignored. Bytes are compared as they are.
"""

from __future__ import annotations

import secrets
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import U64, Scratch, column, load, owner, raw, release, rolling, slices, word_hashes, words

WINDOW, BLOCK = 50, 25
#: Bytes of text per slice; and per bucket on average, in small tables and in large ones (of more than FEW_BUCKETS buckets).
SLICE_BYTES, BUCKET_BYTES, LARGE_BUCKET_BYTES, FEW_BUCKETS = 2 << 20, 4 << 20, 32 << 20, 4096
#: Values that a task remembers; further ones are sent again.
KNOWN = 1 << 18
_NONE = np.iinfo(np.int64).max


def sliced(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SLICE_BYTES) -> DataFrame:
    """slice long, n_bytes long, ids, off (both packed 64-bit integers) and data binary (compressed): about `size` bytes of text per row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, pack = TaskContext.get().partitionId() << 32, zstandard.ZstdCompressor(level=3)
        for whole in batches:
            for b in slices(whole, "text", size):
                data, off = raw(column(b, "text"))
                ids = column(b, "doc_id").fill_null(_NONE).to_numpy(zero_copy_only=False).astype("<i8")
                values = [[n], [len(data)], [ids.tobytes()], [off.astype("<i8").tobytes()], [pack.compress(data.tobytes())]]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, (pa.int64(), pa.int64(), *[pa.binary()] * 3))], ["slice", "n_bytes", "ids", "off", "data"])
                n += 1

    rows = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("text"))
    return rows.mapInArrow(run, "slice long, n_bytes long, ids binary, off binary, data binary")


def _bucket(values: np.ndarray, n: int) -> np.ndarray:
    """Buckets of 64-bit values, in order of value."""
    high = values["high"] if values.dtype == _WINDOW else values
    return ((high >> U64(32)) * U64(n)) >> U64(32)


def unpacked(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


_WINDOW = np.dtype([("high", "<u8"), ("low", "<u8")])


def _within(values: np.ndarray, n: int) -> np.ndarray:
    """The 32 bits of each value that follow those which choose its bucket, so they ascend in a bucket."""
    return ((values * U64(n)) >> U64(32)).astype("<u4")


class Slice:
    """The words of a slice and the distinct rolling windows of its documents of at least WINDOW words."""

    def __init__(self, ids: bytes, off: bytes, data: bytes, window: int, block: int, seeds: tuple[int, int]):
        self.window, self.block, self.seeds = window, block, seeds
        self.ids, self.off, self.data = np.frombuffer(ids, "<i8"), np.frombuffer(off, "<i8"), np.frombuffer(unpacked(data), np.uint8)
        self.start, self.end, self.bounds = words(self.data, self.off)
        self.h, self.of = word_hashes(self.data, self.start, self.end, seed=seeds[0]), owner(self.bounds)
        size = np.diff(self.bounds)
        r = rolling(self.h, block)
        doc = self.of[: len(r)]
        inside = (doc == self.of[block - 1 :][: len(r)]) & (size[doc] >= window) if len(r) else np.empty(0, bool)
        self.places = np.flatnonzero(inside)
        self.values, self.first, self.back = np.unique(r[inside], return_index=True, return_inverse=True)

    def flags(self) -> np.ndarray:
        """Per distinct value: 1 if it is an aligned block here, 2 if it occurs in two documents here."""
        doc = self.of[self.places]
        out = np.zeros(len(self.values), np.uint8)
        out[self.back[(self.places - self.bounds[doc]) % self.block == 0]] = 1
        who = self.ids[doc]
        other = np.zeros(len(self.values), bool)
        other[self.back[who != who[self.first][self.back]]] = True
        return out | (other.astype(np.uint8) << 1)

    def around(self, hit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """hit: one flag per distinct value. (first words of the windows that hold a hit, their distinct 128-bit hashes, index of each
        window's hash, smallest doc_id of each hash here)."""
        n = len(self.h) - self.window + 1
        if n <= 0 or not hit.any():
            return (np.empty(0, np.int64), np.empty(0, _WINDOW), np.empty(0, np.int64), np.empty(0, np.int64))
        seen = np.zeros(len(self.h) + 1, np.int64)
        seen[self.places[hit[self.back]] + 1] = 1
        np.cumsum(seen, out=seen)
        at = np.arange(n)
        at = at[(self.of[:n] == self.of[self.window - 1 :]) & (seen[np.minimum(at + self.window - self.block + 1, len(self.h))] > seen[:n])]
        found = np.empty(len(at), _WINDOW)
        found["high"] = rolling(self.h, self.window)[at]
        found["low"] = rolling(word_hashes(self.data, self.start, self.end, seed=self.seeds[1]), self.window)[at]
        values, back = _distinct(found)
        least = np.full(len(values), _NONE)
        np.minimum.at(least, back, self.ids[self.of[at]])
        return at, values, back, least

    def bits(self, values: np.ndarray, n: int, found: list | None) -> np.ndarray:
        """Flags per value (in order) from the entries that came back: bucket, mask, and which of the slice's values of that bucket the mask is about."""
        out = np.zeros(len(values), bool)
        if found:
            b = _bucket(values, n)
            for x in found:
                i, j = np.searchsorted(b, [x["bucket"], x["bucket"] + 1])
                place = np.arange(i, j) if x["sent"] is None else i + np.flatnonzero(np.unpackbits(np.frombuffer(x["sent"], np.uint8), count=j - i))
                out[place] |= np.unpackbits(np.frombuffer(x["mask"], np.uint8), count=len(place)).view(bool)
        return out


def _distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 128-bit hashes in order, and the index of each entry's."""
    order = np.argsort(x["high"], kind="stable")
    high, low = x["high"][order], x["low"][order]
    tied = high[1:] == high[:-1]
    if (tied & (low[1:] != low[:-1])).any():
        order = np.lexsort((x["low"], x["high"]))
        high, low = x["high"][order], x["low"][order]
    new = np.concatenate([[True], (high[1:] != high[:-1]) | (low[1:] != low[:-1])])[: len(x)]
    back = np.empty(len(x), np.int64)
    back[order] = np.cumsum(new) - 1
    return x[order[new]], back


class Known:
    """What a task has sent: items by sorted 64-bit keys, at most KNOWN of them."""

    def __init__(self, kind: np.dtype):
        self.key, self.item = np.empty(0, U64), np.empty(0, kind)

    def of(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which keys are known, their items)."""
        if not len(self.key):
            return np.zeros(len(keys), bool), np.zeros(len(keys), self.item.dtype)
        at = np.minimum(np.searchsorted(self.key, keys), len(self.key) - 1)
        return self.key[at] == keys, self.item[at]

    def add(self, keys: np.ndarray, items: np.ndarray) -> None:
        """Items of known keys are replaced."""
        if len(self.key) + len(keys) > KNOWN:
            self.key, self.item = self.key[:0], self.item[:0]
        self.key, at = np.unique(np.concatenate([keys, self.key]), return_index=True)
        self.item = np.concatenate([items, self.item])[at]


def _dealt(slice_: int, values: np.ndarray, n: int, content: list[np.ndarray], own: np.ndarray, answer: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows of a slice: its bucket, the content of the values to send (packed, up to three arrays of one entry per value, the first ascending), and a bit for each of the
    slice's values of that bucket that says which they are (null: all). own: flags of the values to send; answer: flags of values whose answer is
    known already, which go back as masks, dealt by slice."""
    b = _bucket(values, n).astype(np.int64)
    rows: list[tuple] = []
    for flags, sending in ((own, True), (answer, False)):
        at = np.flatnonzero(flags)
        if not len(at):
            continue
        found, first = np.unique(b[at], return_index=True)
        begin, end = np.searchsorted(b, found), np.searchsorted(b, found, side="right")
        cuts = [*first.tolist(), len(at)]
        for x, i, j, lo, hi in zip(found.tolist(), cuts, cuts[1:], begin.tolist(), end.tolist()):
            sent = None if j - i == hi - lo else np.packbits(flags[lo:hi]).tobytes()
            parts = [(_planes if k else _steps)(c[at[i:j]]) for k, c in enumerate(content)] if sending else []
            rows.append((x if sending else -1 - (slice_ % n), x, slice_, *parts, *[None] * (3 - len(parts)), sent, None if sending else np.packbits(np.ones(j - i, bool)).tobytes()))
    kinds = (pa.int32(), pa.int32(), pa.int64(), *[pa.binary()] * 5)
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["deal", "bucket", "slice", "c0", "c1", "c2", "sent", "mask"])


def _planes(x: np.ndarray) -> bytes:
    """Numbers as their first bytes, their second bytes and so on, since bytes that hardly vary compress well."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes()


def _unplaned(x: bytes, kind: np.dtype) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(x, np.uint8).reshape(kind.itemsize, -1).T).view(kind).ravel()


def _steps(x: np.ndarray) -> bytes:
    """Ascending numbers, as planes of the steps between them."""
    return _planes(np.diff(x, prepend=x.dtype.type(0)))


def _unstepped(x: bytes, kind: np.dtype) -> np.ndarray:
    return np.cumsum(_unplaned(x, kind), dtype=kind)


_DEALT = "deal int, bucket int, slice long, c0 binary, c1 binary, c2 binary, sent binary, mask binary"
_MASKS = "slice long, bucket int, sent binary, mask binary"
_PROBE, _SMALLEST = np.dtype([("value", "<u4"), ("flag", "u1")]), np.dtype([("high", "<u8"), ("low", "<u8"), ("least", "<i8")])


def _answer(got: pa.Table, kind: np.dtype, judge) -> pa.Table:
    """judge(all entries) -> a flag per entry; back come masks of the slices that have one. Known answers pass."""
    if got["deal"][0].as_py() < 0:
        return got.select(["slice", "bucket", "sent", "mask"])
    columns = [[(_unplaned if i else _unstepped)(x, kind[k]) for x in got[f"c{i}"].to_pylist()] for i, k in enumerate(kind.names)]
    every = np.empty(sum(map(len, columns[0])), kind)
    for k, c in zip(kind.names, columns):
        every[k] = np.concatenate(c)
    flags = judge(every)
    bucket, out, at = got["bucket"][0].as_py(), [], 0
    for name, sent, x in zip(got["slice"].to_pylist(), got["sent"].to_pylist(), columns[0]):
        own = flags[at : at + len(x)]
        at += len(x)
        if own.any():
            out.append((name, bucket, sent, np.packbits(own).tobytes()))
    kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary())
    return pa.Table.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate(kinds)], ["slice", "bucket", "sent", "mask"])


def _hits(x: np.ndarray) -> np.ndarray:
    """Which probes are a reference block somewhere and occur in several documents."""
    order = np.argsort(x["value"], kind="stable")
    value, flag = x["value"][order], x["flag"][order]
    new = np.concatenate([[True], value[1:] != value[:-1]])
    starts, group = np.flatnonzero(new), np.cumsum(new) - 1
    flag[np.diff(starts, append=len(flag))[group] > 1] |= 2  # sent by several slices
    out = np.empty(len(x), bool)
    out[order] = (np.bitwise_or.reduceat(flag, starts) == 3)[group]
    return out


def _smaller(x: np.ndarray) -> np.ndarray:
    """Which windows occur in a document with a smaller doc_id than the one that came with them."""
    values, group = _distinct(np.rec.fromarrays([x["high"], x["low"]], dtype=_WINDOW))
    least = np.full(len(values), _NONE)
    np.minimum.at(least, group, x["least"])
    return least[group] < x["least"]


def repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, block: int = BLOCK, size: int = SLICE_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_removed, spans (word ranges that go, as array of start and end), kept (the other words,
    joined by one space; binary, UTF-8 as given)."""
    if 2 * block > window + 1:
        raise ValueError("a window must hold an aligned block wherever it starts")
    spark = docs.sparkSession
    scratch, seeds = Scratch(spark, "substring"), (secrets.randbits(64), secrets.randbits(64))
    table = scratch.keep(sliced(docs, doc_id, text, size))
    total = table.agg(F.sum("n_bytes")).first()[0] or 0
    few = min(-(-total // bucket_bytes), FEW_BUCKETS)
    n = max(few, -(-total // LARGE_BUCKET_BYTES), int(spark.conf.get("spark.sql.shuffle.partitions")), 1)

    def probes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hits = Known(np.dtype("u1"))  # values that the flags of one slice have shown to be hits
        for b in batches:
            for r in b.to_pylist():
                s = Slice(r["ids"], r["off"], r["data"], window, block, seeds)
                if len(s.values):
                    flag = s.flags()
                    known, _ = hits.of(s.values)
                    yield from _dealt(r["slice"], s.values, n, [_within(s.values, n), flag], ~known, known)
                    fresh = (flag == 3) & ~known
                    hits.add(s.values[fresh], flag[fresh])
                release()

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent = Known(_SMALLEST)
        for b in batches:
            for r in b.to_pylist():
                s = Slice(r["ids"], r["off"], r["data"], window, block, seeds)
                _, values, _, least = s.around(s.bits(s.values, n, r["hits"]))
                if len(values):
                    content = np.empty(len(values), _SMALLEST)
                    content["high"], content["low"], content["least"] = values["high"], values["low"], least
                    found, before = sent.of(values["high"])
                    known = found & (before["low"] == values["low"]) & (before["least"] < least)
                    yield from _dealt(r["slice"], values, n, [values["high"], values["low"], least], ~known, known)
                    sent.add(values["high"][~known], content[~known])
                release()

    def gathered(dealt: DataFrame, kind: np.dtype, judge, name: str) -> DataFrame:
        # as many entries as a slice has buckets with a flag: bounded by the slice
        masks = dealt.groupBy("deal").applyInArrow(lambda got: _answer(got, kind, judge), _MASKS)
        return scratch.keep(masks.groupBy("slice").agg(F.collect_list(F.struct("bucket", "sent", "mask")).alias(name)))

    first = gathered(table.select("slice", "ids", "off", "data").mapInArrow(probes, _DEALT), _PROBE, _hits, "hits")
    second = table.join(first, "slice").select("slice", "ids", "off", "data", "hits").mapInArrow(candidates, _DEALT)
    second = gathered(second, _SMALLEST, _smaller, "smaller")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                if r["hits"] is None:
                    yield _cut(r, None, np.empty(0, np.int64), window)
                    continue
                s = Slice(r["ids"], r["off"], r["data"], window, block, seeds)
                at, values, back, least = s.around(s.bits(s.values, n, r["hits"]))
                gone = s.bits(values, n, r["smaller"])[back] | (least[back] < s.ids[s.of[at]])
                yield _cut(r, s, at[gone], window)

    marks = first.join(second, "slice", "left")
    return table.join(marks, "slice", "left").select("slice", "ids", "off", "data", "hits", "smaller").mapInArrow(cut, "doc_id long, n_words long, n_removed long, spans array<struct<start:int,end:int>>, kept binary")


def _cut(r: dict, s: Slice | None, gone: np.ndarray, window: int) -> pa.RecordBatch:
    """The documents of a slice without the words of the windows that begin at the words `gone`."""
    ids, off, data = np.frombuffer(r["ids"], "<i8"), np.frombuffer(r["off"], "<i8").tolist(), unpacked(r["data"])
    edge = np.zeros((len(s.h) if s else 0) + 1, np.int64)
    np.add.at(edge, gone, 1)
    np.add.at(edge, gone + window, -1)
    covered = np.cumsum(edge)[:-1] > 0
    out: list[list] = [[], [], [], []]
    for d in range(len(ids)):
        own = data[off[d] : off[d + 1]].split()
        mask = covered[s.bounds[d] : s.bounds[d + 1]] if s else covered
        spans: list[dict] = []
        lost = int(mask.sum())
        if lost:
            turn = np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]]))).tolist()
            spans = [{"start": a, "end": b} for a, b in zip(turn[::2], turn[1::2])]
        out[0].append(len(own))
        out[1].append(lost)
        out[2].append(spans)
        out[3].append(b" ".join(compress(own, (~mask).tolist()) if lost else own))
    kinds = (pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])), pa.binary())
    names = pa.array(np.where(ids == _NONE, 0, ids), mask=ids == _NONE)
    return pa.RecordBatch.from_arrays([names, *(pa.array(x, t) for x, t in zip(out, kinds))], ["doc_id", "n_words", "n_removed", "spans", "kept"])


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats(load(spark, sf_dir)).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
