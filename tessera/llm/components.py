"""Connected components of an edge table by alternating stars, for graphs of any size.

Each round is two aggregations and a join on node ids; no neighbour list is ever collected. Rounds grow with the logarithm of the size of
a component. Every round is written to the shared folder, and the one before is dropped. What belongs to
a hub (a node with more than a ten-thousandth of the edges) is broadcast, so its edges stay where they are and are not held by anyone.

Defined results. Edges that are null at an end, or lead from a node to itself, count for nothing. Repeated edges count once. Empty table: no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, attached, column


class Forest:
    """Union-find over 64-bit ids; the root of a tree is its smallest id."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        r = x
        while (p := up.get(r, r)) != r:
            r = p
        while (p := up.get(x, x)) != r:
            up[x], x = r, p
        return r

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        if b < a:
            a, b = b, a
        self.up[b] = a
        self.up.setdefault(a, a)
        return True

    def stars(self, kinds: tuple[str, str] = ("a", "b")) -> pa.RecordBatch:
        """(id, root) of every id that is not its own root."""
        found = [(x, r) for x in self.up if (r := self.root(x)) != x]
        cols = np.array(found, np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(cols[:, 0]), pa.array(cols[:, 1])], list(kinds))


def contracted(edges: DataFrame) -> DataFrame:
    """The edges of each partition as stars: as many as ids at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest()
        for b in batches:
            for x, y in zip(column(b, "a").to_pylist(), column(b, "b").to_pylist()):
                forest.join(x, y)
        yield forest.stars()

    return edges.select("a", "b").mapInArrow(run, "a long, b long")


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b") % (1 << 40))).first())


def components(edges: DataFrame, scratch: Scratch, rounds: int = 200) -> DataFrame:
    """a long, b long: every id that is not the smallest of its component, and the smallest. `rounds` is a guard against a fault, far above the
    few dozen (about twice the logarithm of the largest component) that any table needs; beyond it this raises, and gives no partial result."""
    now = scratch.keep(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    mark = _mark(now)
    for _ in range(rounds):
        if not mark[0]:
            return now
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"), F.count(F.lit(1)).alias("n"))
        large = attached(both.filter("b > a"), least, "a", "m", 2 * mark[0]).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
        small = attached(large, least, "a", "m", mark[0]).select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()
        after = scratch.keep(small)
        seen = _mark(after)
        scratch.drop(now)
        now = after
        if seen == mark:
            scratch.rest()
            return now
        mark = seen
    raise RuntimeError(f"components did not settle in {rounds} rounds")
