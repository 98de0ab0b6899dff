"""What the operators of this folder share: tables, scratch storage, Arrow text access and byte-level word kernels.

All text kernels work on the UTF-8 bytes of an Arrow column. A null text counts as empty. Word separators are the six ASCII bytes
0x20 and 0x09-0x0D, which never occur inside a multi-byte UTF-8 character, so words can be found without decoding.
"""

from __future__ import annotations

import atexit
import ctypes
import gc
import hashlib
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import ready, shared_folder, spread

pa.set_cpu_count(1)  # a task has one core; further threads of Arrow's would each keep memory of their own

#: Separator class of the word contracts.
SPACE_CLASS = r"[\x20\x09-\x0D]+"
#: Text bytes that a Python worker holds in numpy form at a time; a longer single text is one slice.
SLICE_BYTES = 2 << 20


def load(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    df = ready(spark).read.parquet(f"{sf_dir}/{table}.parquet")
    return spread(df) if table == "documents" else df


# --- scratch storage -------------------------------------------------------------------------------------------------


#: Spark's setting that removes a query's shuffle files when the query is done.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch:
    """Tables in the shared folder that cut lineage and outlive a lost executor. A table can be dropped as soon as the next one is
    written, and all of those that operators opened as soon as their result is; what is left goes when the session ends."""

    opened: list[Scratch] = []

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.base, self.n = ready(spark), f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}", 0
        atexit.register(self._clear, self.base)
        Scratch.opened.append(self)

    @staticmethod
    def sweep(since: int) -> None:
        """Drops all tables of those opened after the first `since`, whose results have been written."""
        for x in Scratch.opened[since:]:
            x._clear(x.base)
        del Scratch.opened[since:]

    def keep(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path, conf = f"{self.base}/{self.n}", self.spark.conf
        was = conf.get(CLEANUP, None)
        conf.set(CLEANUP, "true")  # once the table is written, nobody needs the shuffle files behind it
        try:
            df.write.option("compression", "zstd").parquet(path)
        finally:
            conf.unset(CLEANUP) if was is None else conf.set(CLEANUP, was)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch = path
        return out

    def rest(self) -> None:
        """Lets the driver give back the memory of plans that are done."""
        gc.collect()
        self.spark._jvm.System.gc()

    def drop(self, *tables: DataFrame) -> None:
        for x in tables:
            self._clear(x._scratch)

    def _clear(self, path: str) -> None:
        try:
            jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(conf).delete(p, True)
        except Exception:  # noqa: BLE001  the session may be gone at exit; the folder is temporary
            pass


# --- joins that spare the large side ----------------------------------------------------------------------------------

#: Bits of a sieve: 8 MB, whatever goes into it.
SIEVE_BITS = 26


def _place(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(1 << SIEVE_BITS))


def sieve(keys: DataFrame, key: str) -> DataFrame:
    """A hashed bitmap of a column, as at most 2^(SIEVE_BITS - 15) rows of 4 KB."""
    place = _place(F.col(key))
    rows = keys.filter(F.col(key).isNotNull()).select(F.bitmap_bucket_number(place).alias("_bucket"), F.bitmap_bit_position(place).alias("_bit"))
    return rows.groupBy("_bucket").agg(F.bitmap_construct_agg("_bit").alias("_bits"))


def sifted(rows: DataFrame, key: Column, found: DataFrame, flag: str) -> DataFrame:
    """rows with a boolean column `flag`: false only where the key is not in the sieve. Broadcasts the sieve, so rows stay where they are."""
    bucket, at, bits = (f"_{k}_{uuid.uuid4().hex}" for k in ("bucket", "at", "bits"))
    rows = rows.withColumn(bucket, F.bitmap_bucket_number(_place(key))).withColumn(at, F.bitmap_bit_position(_place(key)))
    rows = rows.join(F.broadcast(found.select(F.col("_bucket").alias(bucket), F.col("_bits").alias(bits))), bucket, "left")
    byte = F.conv(F.hex(F.expr(f"substring({bits}, cast({at} div 8 as int) + 1, 1)")), 16, 10).cast("int")
    hit = byte.bitwiseAND(F.expr(f"shiftleft(1, cast({at} % 8 as int))")) != 0
    return rows.withColumn(flag, F.coalesce(hit, F.lit(False))).drop(bucket, at, bits)


#: A key that more than one in HOT rows bears is hot; there are fewer than HOT of those.
HOT = 10_000


def attached(rows: DataFrame, of: DataFrame, key: str, value: str, total: int | None = None) -> DataFrame:
    """rows with `value` from `of`, null where there is none. of: key, value and n, the number of rows that bear the key; one row per key.
    Hot keys, fewer than HOT, are broadcast and so never gather in one task; the rest meets by hash. total: of the numbers n."""
    total = rows.count() if total is None else total
    hot = F.broadcast(of.filter(F.col("n") * HOT > total).select(key, value))
    first = rows.join(hot, key, "left")
    rest = first.filter(F.col(value).isNull()).drop(value).join(of.filter(F.col("n") * HOT <= total).select(key, value), key, "left")
    return first.filter(F.col(value).isNotNull()).unionByName(rest)


# --- Arrow text access ------------------------------------------------------------------------------------------------


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


@lru_cache(1)
def _trim():
    try:
        return ctypes.CDLL("libc.so.6").malloc_trim
    except (OSError, AttributeError):
        return lambda _: 0


def release(rows: int | None = None) -> None:
    """Gives free memory of this Python worker back to the system, for the executor's other users; after small groups (of fewer than 64 rows) not."""
    if rows is not None and rows < 64:
        return
    pa.default_memory_pool().release_unused()
    _trim()(0)


def slices(batch: pa.RecordBatch, text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Zero-copy slices of about `limit` text bytes; a text longer than that is a slice of its own."""
    n = batch.num_rows
    if not n:
        return
    size = pc.fill_null(pc.binary_length(column(batch, text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    total, at = np.concatenate([[0], np.cumsum(size)]), 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(total, total[at] + limit, side="right")) - 1)
        yield batch.slice(at, to - at)
        at = to
    release()


def strings(col: pa.Array) -> list[str]:
    """Texts as Python strings; null is empty; bytes that are no UTF-8 become U+FFFD."""
    try:
        return [x or "" for x in col.to_pylist()]
    except UnicodeDecodeError:
        return [(x or b"").decode("utf-8", "replace") for x in col.cast(pa.large_binary()).to_pylist()]


def raw(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a text or binary column, null as empty."""
    col = col.cast(pa.large_binary())
    if col.null_count:
        col = pc.fill_null(col, b"")
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] is not None else np.empty(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def packed(parts: np.ndarray, bounds: np.ndarray, dtype: str) -> pa.Array:
    """A binary column whose row i holds parts[bounds[i]:bounds[i + 1]] as little-endian `dtype`."""
    data = np.ascontiguousarray(parts.astype(dtype, copy=False))
    off = (bounds * data.itemsize).astype(np.int64)
    big = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(off) - 1, [None, pa.py_buffer(off), pa.py_buffer(data)])
    return big.cast(pa.binary())


# --- byte kernels -----------------------------------------------------------------------------------------------------

U64 = np.uint64
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MASK = np.array([(1 << 8 * i) - 1 for i in range(9)], U64)
#: Words of more bytes than this are hashed one by one.
LONG_WORD = 256


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; modifies and returns x."""
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first byte, byte after, bounds): the words of all texts in order; text i has words bounds[i]:bounds[i + 1]."""
    n = len(data)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(off), np.int64)
    solid = ~IS_SPACE[data]
    begins, ends = solid.copy(), solid.copy()
    begins[1:] &= ~solid[:-1]
    ends[:-1] &= ~solid[1:]
    edge = off[(off > 0) & (off < n)]
    begins[edge], ends[edge - 1] = solid[edge], solid[edge - 1]
    start = np.flatnonzero(begins)
    return start, np.flatnonzero(ends) + 1, np.searchsorted(start, off)


def lanes(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on (zeros after the end) as little-endian numbers; a view that overlaps itself."""
    padded = np.zeros(len(data) + 16, np.uint8)
    padded[: len(data)] = data
    return np.ndarray((len(data) + 9,), "<u8", padded, strides=(1,))


def lowered_bytes(data: np.ndarray) -> np.ndarray:
    """A-Z as a-z, all else as it is."""
    return _LOWER[data]


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool = False, seed: int = 0) -> np.ndarray:
    """64-bit hashes of byte ranges, eight bytes at a time, each step a bijection of the state; with `lower`, A-Z count as a-z. Ranges of one
    length up to eight bytes never collide; longer ones by chance only. Where that is not enough, callers compare words, or take two secret seeds."""
    if not len(start):
        return np.empty(0, U64)
    if lower:
        data = lowered_bytes(data)
    view, size = lanes(data), end - start
    h = mix((size.astype(U64) + U64(1)) * U64(0x9E3779B97F4A7C15) + U64(seed))
    todo, at, left = np.arange(len(size)), start, size
    for k in range(0, LONG_WORD, 8):
        x = mix((h[todo] if k else h) ^ (view[at] & _MASK[np.minimum(left, 8)]))
        h[todo] = x
        more = left > 8
        if not more.any():
            return h
        todo, at, left = todo[more], at[more] + 8, left[more] - 8
    for i in np.flatnonzero(size > LONG_WORD).tolist():
        h[i] = int.from_bytes(hashlib.blake2b(data[start[i] : end[i]], digest_size=8, key=seed.to_bytes(8, "little")).digest(), "little")
    return h


def windows(h: np.ndarray, k: int, seed: int = 1) -> np.ndarray:
    """Hashes of all runs of k consecutive entries of h (as if h were one text)."""
    if len(h) < k:
        return np.empty(0, U64)
    c = np.random.default_rng(seed).integers(1, 2**63, k, dtype=np.uint64) * U64(2) + U64(1)
    n = len(h) - k + 1
    out = h[:n] * c[0]
    for j in range(1, k):
        out += h[j : j + n] * c[j]
    return mix(out)


def rolling(h: np.ndarray, k: int) -> np.ndarray:
    """As windows, for long runs: runs of 1, 2, 4, ... entries are put together, so cost grows with the logarithm of k."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, U64)

    def both(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        x = a * U64(0x9E3779B97F4A7C15)
        x ^= x >> U64(29)
        x += b
        x *= U64(0xC2B2AE3D27D4EB4F)
        x ^= x >> U64(32)
        return x

    runs, size, at, out = h, 1, 0, None
    while size <= k:
        if k & size:
            part = runs[at : at + n]
            out, at = part if out is None else both(out, part), at + size
        if 2 * size <= k:
            runs = both(runs[:-size], runs[size:])
        size *= 2
    return mix(out.copy())


def owner(bounds: np.ndarray) -> np.ndarray:
    """For each item, the index of the text it belongs to."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


def remainder(doc_id, m: int):
    """crc32 of doc_id as text, modulo m; a null doc_id counts as 'null'."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("null"))) % m
