"""Vectors: normalisation, similarity, exact nearest neighbours for one or many queries, closeness of titles (VEC*, EMB*)."""

from __future__ import annotations

import hashlib
import threading
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tessera.session import col

Embedder = Callable[[list[str]], np.ndarray]
# Text put before a query for models that take an instruction.
QUERY_INSTRUCTION = "Instruct: ابحث عن الحديث النبوي الذي يطابق هذا النص\nQuery: "
TITLE_INSTRUCTION = "Instruct: ابحث عن عنوان الباب الذي يتناول هذا الموضوع\nQuery: "


def dot(a: Column | str, b: Column | str) -> Column:
    """Inner product, added up in double precision."""
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column | str) -> Column:
    """VEC1: length one; a zero vector stays."""
    norm = F.sqrt(dot(v, v))
    return F.transform(col(v), lambda x: (x / F.when(norm == 0, F.lit(1.0)).otherwise(norm)).cast("float"))


def similarity(a: Column | str, b: Column | str) -> Column:
    """VEC2: cosine of unit vectors, not below 0."""
    return F.greatest(F.lit(0.0), dot(a, b))


def checked(vectors: DataFrame, dim: int, vec: str = "vec") -> DataFrame:
    """VEC4: fails on a vector of another dimension."""
    return vectors.withColumn(vec, F.when(F.size(vec) == dim, F.col(vec)).otherwise(F.raise_error(F.lit(f"a vector does not have {dim} dimensions"))))


def with_model(vectors: DataFrame, model: str, dim: int, vec: str = "vec") -> DataFrame:
    """VEC4: the model and dimension travel in the column's metadata."""
    return vectors.withColumn(vec, F.col(vec).alias(vec, metadata={"embedding_model": model, "embedding_dimensions": dim}))


def same_model(vectors: DataFrame, model: str, dim: int, vec: str = "vec") -> None:
    """VEC4: raises where stored vectors come from another model. A table without a note, or an empty one, accepts any."""
    meta = vectors.schema[vec].metadata
    if meta and (meta.get("embedding_model"), meta.get("embedding_dimensions")) != (model, dim) and vectors.limit(1).count():
        raise ValueError(f"the collection holds vectors of {meta.get('embedding_model')}")


def nearest(queries: DataFrame, vectors: DataFrame, k: int, key: str = "id", vec: str = "vec", block: int = 8192, slots: int = 64, parts: int | None = None) -> DataFrame:
    """VEC3/JN16/ORD4: query_id, key, similarity, pos: the k most similar vectors of each query, ties by key; exact.

    A blocked join on the cluster: queries (query_id, vec) are dealt by hash to groups of about `block`, at most `slots` of them at a time in a pass over the vectors;
    vectors to `parts` (the session's shuffle partitions unless given). A task holds one group of queries, reads its part of the vectors as a
    stream, and hands on the k best of each query once, so a query sends k rows per part to the last step, and nothing comes to the driver."""
    spark = vectors.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    total = queries.count()
    groups = max(1, -(-total // block))
    asked = queries.select(F.pmod(F.xxhash64("query_id"), F.lit(groups)).cast("int").alias("group"), "query_id", F.col(vec).alias("vec"))
    held = vectors.select(F.pmod(F.xxhash64(F.col(key)), F.lit(parts)).cast("int").alias("part"), F.col(key).alias("id"), F.col(vec).alias("vec"))
    schema = T.StructType([queries.schema["query_id"], T.StructField("id", vectors.schema[key].dataType), T.StructField("similarity", T.DoubleType())])
    id_type, query_type = held.schema["id"].dataType, queries.schema["query_id"].dataType
    none = lambda kind: F.lit(None).cast(kind)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, names, q, best = None, [], [], None
        for b in batches:
            cells, ids, query_ids, flat = b.column(0).to_pylist(), b.column(2), b.column(1), b.column(3)
            edges = [0, *(i for i in range(1, len(cells)) if cells[i] != cells[i - 1]), len(cells)]
            for lo, hi in zip(edges, edges[1:]):
                if lo == hi:
                    continue
                if cells[lo] != now:
                    if best is not None:
                        yield _best(best, names, k, schema)
                    now, names, q, best = cells[lo], [], [], None
                x = np.array(flat.slice(lo, hi - lo).flatten(), np.float64).reshape(hi - lo, -1)
                is_query = np.array(query_ids.slice(lo, hi - lo).is_valid())
                if is_query.any():  # a cell's queries come first
                    names += query_ids.slice(lo, hi - lo).filter(pa.array(is_query)).to_pylist()
                    q.append(x[is_query])
                if not is_query.all() and names:
                    own = np.concatenate(q)
                    q = [own]
                    best = _merged(best, own, x[~is_query], ids.slice(lo, hi - lo).filter(pa.array(~is_query)).to_pylist(), k)
        if best is not None:
            yield _best(best, names, k, schema)

    found = None
    for first in range(0, groups, slots):
        last = min(groups, first + slots)
        some = asked.filter(F.col("group").between(first, last - 1)).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        cell = lambda: F.col("group") * parts + F.col("part")
        left = some.select(cell().alias("cell"), F.col("query_id"), none(id_type).alias("id"), "vec")
        right = held.withColumn("group", F.explode(F.sequence(F.lit(first), F.lit(last - 1)))).select(cell().alias("cell"), none(query_type).alias("query_id"), "id", "vec")
        cells = left.unionByName(right).repartition(parts, "cell").sortWithinPartitions("cell", F.col("query_id").isNull(), "id").mapInArrow(local, schema)
        found = cells if found is None else found.unionByName(cells)
    w = W.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
    return found.withColumn("pos", F.row_number().over(w)).filter(F.col("pos") <= k)


def _merged(best: tuple | None, q: np.ndarray, x: np.ndarray, ids: list, k: int) -> tuple:
    """The k largest similarities of each query so far, and their ids; those of the same similarity as the k-th stay too, so ties are broken at the end."""
    s = np.maximum(0.0, q @ x.T)
    names = np.array(ids, object)
    out_s, out_i = [], []
    for row, line in enumerate(s):
        if len(line) > k:
            line_at = np.flatnonzero(line >= np.partition(line, len(line) - k)[len(line) - k])
        else:
            line_at = np.arange(len(line))
        at = line_at[np.argsort(-line[line_at], kind="stable")][:k]  # ids ascend, so the first of equals are the smallest
        values, own = line[at], names[at]
        if best is not None:
            values, own = np.concatenate([best[0][row], values]), np.concatenate([best[1][row], own])
            keep = np.argsort(-values, kind="stable")[:k]  # the earlier ones have smaller ids
            values, own = values[keep], own[keep]
        out_s.append(values)
        out_i.append(own)
    return out_s, out_i


def _best(best: tuple, names: list, k: int, schema: T.StructType) -> pa.RecordBatch:
    count = [len(x) for x in best[0]]
    cols = [[n for n, c in zip(names, count) for _ in range(c)], [i for x in best[1] for i in x], np.concatenate(best[0]) if names else []]
    return pa.RecordBatch.from_arrays([pa.array(c, to_arrow_type(f.dataType)) for c, f in zip(cols, schema.fields)], schema.names)


def nearest_to(vectors: DataFrame, query: list[float], k: int, key: str = "id", vec: str = "vec") -> DataFrame:
    """VEC3 for one query: a projection and a bounded sort, all in the JVM."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return vectors.select(F.col(key), similarity(vec, q).alias("similarity")).orderBy(F.desc("similarity"), F.col(key)).limit(k)


def bag_of_characters(dim: int = 64) -> Embedder:
    """EMB6: a deterministic embedder without a model: characters counted in hashed places, length one."""
    place: dict[str, int] = {}

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim))
        for row, t in zip(out, texts):
            for ch in t:
                if ch not in place:
                    place[ch] = int(hashlib.md5(ch.encode("utf-8", "surrogatepass"), usedforsecurity=False).hexdigest(), 16) % dim
                row[place[ch]] += 1
        norm = np.sqrt((out**2).sum(1, keepdims=True))
        return (out / np.where(norm == 0, 1, norm)).astype(np.float32)

    return embed


def embed(table: DataFrame, text: str = "text", vec: str = "vec", make: Callable[[], Embedder] = bag_of_characters, batch: int = 512, instruction: str = "", most_chars: int = 6000) -> DataFrame:
    """EMB1/EMB4/EMB7/SRC16: table with a vector column. make() builds the embedder once per task; texts go in batches, order kept; at most
    most_chars characters of a text are embedded (TXT30)."""
    schema = T.StructType([*table.schema.fields, T.StructField(vec, T.ArrayType(T.FloatType()))])
    at = table.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for b in batches:
            texts = [instruction + (x or "")[:most_chars] for x in b.column(at).to_pylist()]
            got = [np.asarray(fn(texts[i : i + batch]), np.float32) for i in range(0, len(texts), batch)]
            rows = pa.array([v.tolist() for part in got for v in part], pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([*b.columns, rows], schema.names)

    return table.mapInArrow(run, schema)


def parsed_reply(reply: dict, expected: int, dim: int) -> np.ndarray:
    """EMB5: vectors of a provider's reply in the order of their index; lists or base64 float32; count and dimension are checked; length one."""
    import base64

    items = sorted(reply["data"], key=lambda x: x["index"])
    vectors = [np.frombuffer(base64.b64decode(x["embedding"], validate=True), "<f4") if isinstance(x["embedding"], str) else np.asarray(x["embedding"], np.float32) for x in items]
    if len(vectors) != expected or any(len(v) != dim for v in vectors):
        raise ValueError("the reply does not have one vector of the right dimension per text")
    x = np.stack(vectors) if vectors else np.zeros((0, dim), np.float32)
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return (x / np.where(norm == 0, 1, norm)).astype(np.float32)


class Throttle:
    """EMB3: how many requests may run at once: halved on refusal, with a pause for all, one more after twice as many successes as are allowed."""

    def __init__(self, limit: int, clock: Callable[[], float] = time.monotonic):
        self.limit = self.allowed = max(1, limit)
        self.good = self.running = 0
        self.clock, self.resume = clock, 0.0
        self.change = threading.Condition()

    def refused(self, pause: float = 0.0) -> None:
        with self.change:
            self.allowed, self.good = max(1, self.allowed // 2), 0
            self.resume = max(self.resume, self.clock() + pause)

    def succeeded(self) -> None:
        with self.change:
            self.good += 1
            if self.good >= 2 * self.allowed and self.allowed < self.limit:
                self.allowed, self.good = self.allowed + 1, 0
                self.change.notify_all()

    def __enter__(self) -> Throttle:
        with self.change:
            while self.running >= self.allowed or self.clock() < self.resume:
                self.change.wait(max(0.01, min(1.0, self.resume - self.clock())))
            self.running += 1
        return self

    def __exit__(self, *_: object) -> None:
        with self.change:
            self.running -= 1
            self.change.notify_all()


class Refused(OSError):
    """A provider's answer that it is asked too often; it may say when to come again."""

    def __init__(self, retry_after: float | None = None):
        super().__init__("too many requests")
        self.retry_after = retry_after


def provider(send: Callable[[list[str]], dict], dim: int, batch: int = 64, at_once: int = 8, attempts: int = 5, sleep: Callable[[float], None] | None = None) -> Callable[[], Embedder]:
    """EMB1-3, EMB5, SRC16: makes an embedder of a service: send(texts) -> reply (see parsed_reply). Batches go side by side within a throttle, each is
    repeated with doubling waits, and replies are checked and put in order. `send` raises Refused where it is asked too often."""

    def make() -> Embedder:
        throttle = Throttle(at_once)

        def one(texts: list[str]) -> np.ndarray:
            def request() -> np.ndarray:
                with throttle:
                    try:
                        got = parsed_reply(send(texts), len(texts), dim)
                    except Refused as e:
                        throttle.refused(e.retry_after or 0.0)
                        raise
                    throttle.succeeded()
                    return got

            return with_retries(request, attempts, sleep=sleep)

        def embedder(texts: list[str]) -> np.ndarray:
            parts = [texts[i : i + batch] for i in range(0, len(texts), batch)]
            with ThreadPoolExecutor(at_once) as pool:
                return np.concatenate([np.zeros((0, dim), np.float32), *pool.map(one, parts)])

        return embedder

    return make


def with_retries(fn: Callable[[], np.ndarray], attempts: int = 5, first_wait: float = 1.0, most_wait: float = 60.0, sleep: Callable[[float], None] | None = None, retry: tuple[type[BaseException], ...] = (OSError, TimeoutError)) -> np.ndarray:
    """EMB2: repeats a request with doubling waits; the last error is raised."""
    wait = first_wait
    for turn in range(attempts):
        try:
            return fn()
        except retry as e:
            if turn + 1 == attempts:
                raise
            (sleep or time.sleep)(min(most_wait, getattr(e, "retry_after", None) or wait))
            wait *= 2
    raise AssertionError("unreachable")


def title_closeness(titles: DataFrame, query: list[float], title: str = "topic", vec: str = "vec") -> DataFrame:
    """VEC5/VEC6/SET2: title, closeness (-1 to 1): each distinct title that names a subject once."""
    from tessera.functions.text import blank, names_a_subject

    q = F.array(*[F.lit(float(x)) for x in query])
    rows = titles.filter(~blank(title) & names_a_subject(title)).dropDuplicates([title])
    return rows.select(F.col(title).alias("topic"), dot(vec, q).alias("closeness"))
