"""MinHash near-dedup with an LSH forest.

1. Each text becomes the set of its distinct word shingles and a signature of HASHES minima. Equal sets are one node from here on.
2. Forest: TREES sorted orders. In each, nodes are range-partitioned and sorted by a prefix of depth() minima and then by four bits of all
   other minima in an order of the tree's own, so neighbours are those with the longest common prefix. Up to REACH neighbours on either
   side that share the prefix are compared by all their four-bit minima: in a sparse region that is the whole region. Pairs that look at
   least loose() alike join; a task keeps a spanning forest, so it hands on at most as many edges as it has nodes. A group that shares a prefix
   and has more than REACH + 1 rows, or touches an edge of its partition, is open: its rows meet again, all pairs of different families
   (components of the edges so far), in blocks of about CROWD rows of which each two meet. So every two nodes that share a prefix and look
   alike are in one family, however dense the region, and whatever the number of partitions.
3. Components of these edges are families. A family's texts meet in tasks of at most about BLOCK_TEXTS texts and FAMILY shingles. There,
   pairs that look at least loose() alike and are not yet connected are confirmed on their full sets, most alike first. Of families of
   several blocks, one text of each group found so far meets the others in the same way, again and again, which joins a large family of near
   copies at a cost in proportion to its texts. Only where groups of one family are still apart after that, their texts are compared by sketch, and
   those with a partner that looks alike in another group meet in blocks of at most CROWD texts and FAMILY shingles, each two blocks once. No pair leaves a task
   but the edges of the forest of confirmed links.
4. Components of confirmed links are the groups.

Exactness. Copies are one node by a 128-bit BLAKE2b digest of their lower-cased words; links are confirmed on sets of the words themselves
(numbered within a task, no hashes). Hashes only choose candidates, and count a text's own distinct shingles (64 bits).

A pair at the threshold shares a prefix in no tree with probability (1 - (percent / 100) ** depth) ** 20 < 1e-5, and looks less than loose()
alike with about the same; nothing else is missed, in dense regions too. The price is a comparison of sketches, in each tree, of all pairs of an open
group that are not in one family, and of all pairs of a family's groups that no confirmed links connect: squares of the numbers of those.

Defined results. Null or empty text, or no words: an empty set, linked with nothing, kept. Fewer words than WORDS: the whole sequence is the one
shingle. Empty table: no rows. Repeated rows and rows of equal doc_id are one row each, and all rows that carry the smallest doc_id of a
group are kept. Null doc_id: linked with nothing, kept, component_id null. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, GroupedData, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import U64, Scratch, attached, column, load, lowered_bytes, mix, owner, packed, raw, release, sieve, sifted, slices, windows, word_hashes, words
from tessera.llm.components import Forest, components

WORDS = 5
#: Links: 100 * intersection >= PERCENT * union, unless a caller gives another percentage.
PERCENT = 80
TREES, HASHES = 20, 128
REACH = 32
#: Rows of a block of an open group, and of a block of a family whose groups are compared by sketch.
CROWD, APART = 600, 140


def depth(percent: int) -> int:
    """Minima in a prefix: as many as leave a pair at the threshold without a common prefix with probability below 1e-5."""
    return max(d for d in range(1, HASHES // TREES + 1) if d == 1 or (1 - (percent / 100) ** d) ** TREES < 1e-5)


def loose(percent: int) -> int:
    """Four-bit minima that must agree for a closer look: an estimated similarity 4.5 standard errors below the threshold, in whole percent."""
    p = percent / 100
    low = max(0, int(100 * (p - 4.5 * (p * (1 - p) / HASHES) ** 0.5))) / 100
    return int(np.ceil(HASHES * (low + (1 - low) / 16)))


#: Texts and shingles of a block of a family.
BLOCK_TEXTS, FAMILY = 120, 500_000
_A = np.random.default_rng(31337).integers(1, 2**63, HASHES, dtype=np.uint64) * U64(2) + U64(1)


def shingles(data: np.ndarray, off: np.ndarray, k: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds): text i has the distinct shingles hashes[bounds[i]:bounds[i + 1]], ascending."""
    start, end, bounds = words(data, off)
    h, size = word_hashes(data, start, end, lower=True), np.diff(bounds)
    of = owner(bounds)
    s = windows(h, k)
    inside = np.flatnonzero(of[: len(s)] == of[k - 1 :][: len(s)])
    values, text = s[inside], of[inside]
    for n in range(1, k):
        short = np.flatnonzero(size == n)
        if len(short):
            values, text = np.concatenate([values, windows(h, n, seed=100 + n)[bounds[short]]]), np.concatenate([text, short])
    if len(text) > len(inside):
        order = np.argsort(text, kind="stable")
        values, text = values[order], text[order]
    at = np.searchsorted(text, np.arange(len(off)))
    for i, j in zip(at[:-1].tolist(), at[1:].tolist()):
        if j - i > 1:
            values[i:j].sort()
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (text[1:] != text[:-1])
    return values[new], np.concatenate([[0], np.cumsum(new)])[at]


def digests(data: np.ndarray, off: np.ndarray) -> list[bytes | None]:
    """BLAKE2b of the lower-cased words of each text, one space between two; None for a text without words."""
    whole = lowered_bytes(data).tobytes()
    parts = (b" ".join(whole[i:j].split()) for i, j in zip(off[:-1].tolist(), off[1:].tolist()))
    return [hashlib.blake2b(x, digest_size=16).digest() if x else None for x in parts]


def signatures(s: np.ndarray, bounds: np.ndarray, deep: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(prefixes [text, tree], sketch [text, HASHES / 2 bytes]) of the non-empty sets, and which texts those are."""
    some = np.flatnonzero(np.diff(bounds))
    first = bounds[some]
    minima = np.empty((HASHES, len(some)), np.uint32)
    for i in range(HASHES if len(some) else 0):
        minima[i] = np.minimum.reduceat(((s * _A[i]) >> U64(32)).astype(np.uint32), first)
    prefix = np.empty((len(some), TREES), U64)
    for t in range(TREES):
        x = np.zeros(len(some), U64)
        for m in minima[t * deep : (t + 1) * deep]:
            x = mix((x ^ m) * U64(0x9E3779B97F4A7C15) + U64(1))
        prefix[:, t] = x
    low = (minima & 15).astype(np.uint8)
    return prefix, np.ascontiguousarray((low[0::2] << 4 | low[1::2]).T), some


def sketched(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, digest (of the words; null without), prefixes and sketch (binary)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text"):
                data, off = raw(column(b, "text"))
                s, bounds = shingles(data, off)
                prefix, sketch, some = signatures(s, bounds, depth(percent))
                none = np.ones(b.num_rows, bool)
                none[some] = False
                edge = np.concatenate([[0], np.cumsum(~none)])
                yield pa.RecordBatch.from_arrays(
                    [column(b, "doc_id"), pa.array(np.diff(bounds)), pa.array(digests(data, off), pa.binary()), packed(prefix.ravel(), edge * TREES, "<u8"), packed(sketch.ravel(), edge * sketch.shape[1], "u1")],
                    ["doc_id", "n_shingles", "digest", "prefixes", "sketch"],
                )

    rows = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_shingles long, digest binary, prefixes binary, sketch binary")


#: Equal four-bit halves of a byte, by the exclusive or of two bytes.
_AGREE = np.array([(x & 15 == 0) + (x >> 4 == 0) for x in range(256)], np.uint8)


def alike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Number of equal four-bit minima, row by row."""
    return _AGREE[a ^ b].sum(1, dtype=np.int64)


_FOUND = "a long, b long, tree int, prefix long, turned binary"


def neighbours(sorted_rows: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Edges a, b of a spanning forest, per partition, of the pairs within REACH that share tree and prefix and look alike. Also, with the
    node as a and a null b, the rows of open groups: those of more than REACH + 1 rows, and those at an edge of the partition, which may go on in
    another one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, held, tail, last, going = Forest(), None, None, None, True  # going: the last group is open, its rows are handed on
        for b in batches:
            if not b.num_rows:
                continue
            key = np.column_stack([column(b, "tree").to_numpy().astype(np.int64), column(b, "prefix").to_numpy()])
            node = column(b, "node").to_numpy()
            sketch = raw(column(b, "turned"))[0].reshape(len(node), -1)
            k, n, t = (np.concatenate(x) for x in zip(tail, (key, node, sketch))) if tail else (key, node, sketch)
            start = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]).any(1)]))
            size = np.diff(np.append(start, len(n)))
            wide = size > REACH + 1
            wide[0] |= going and (last is None or bool((last == k[0]).all()))
            yield _opened(*(x[np.repeat(wide, size)] for x in (k, n, t)))
            last, going = key[-1].copy(), bool(wide[-1])
            tail = None if going else tuple(x[start[-1] :].copy() for x in (k, n, t))
            fresh = 0
            if held:
                fresh = len(held[1])
                key, node, sketch = (np.concatenate(x) for x in zip(held, (key, node, sketch)))
            for lag in range(1, min(REACH, len(node) - 1) + 1):
                at = np.flatnonzero((key[lag:] == key[:-lag]).all(1))
                at = at[at + lag >= fresh]
                if not len(at):
                    break
                at = at[alike(sketch[at], sketch[at + lag]) >= loose(percent)]
                for x, y in zip(node[at].tolist(), node[at + lag].tolist()):
                    forest.join(x, y)
            held = key[-REACH:].copy(), node[-REACH:].copy(), sketch[-REACH:].copy()
        if tail:
            yield _opened(*tail)
        stars = forest.stars()
        none = [pa.nulls(stars.num_rows, x) for x in (pa.int32(), pa.int64(), pa.binary())]
        yield pa.RecordBatch.from_arrays([*stars.columns, *none], ["a", "b", "tree", "prefix", "turned"])

    return sorted_rows.select("tree", "prefix", "turned", "node").mapInArrow(run, _FOUND)


def _opened(key: np.ndarray, node: np.ndarray, sketch: np.ndarray) -> pa.RecordBatch:
    turned = packed(sketch.ravel(), np.arange(len(node) + 1) * sketch.shape[1], "u1")
    cols = [pa.array(node), pa.nulls(len(node), pa.int64()), pa.array(key[:, 0].astype(np.int32)), pa.array(key[:, 1]), turned]
    return pa.RecordBatch.from_arrays(cols, ["a", "b", "tree", "prefix", "turned"])


def meet(family: np.ndarray, sketch: np.ndarray, node: np.ndarray, side: np.ndarray, forest: Forest, least: int) -> None:
    """Joins all pairs of different families that look alike; with two blocks at hand (side 0 and 1), those between the blocks."""
    across = bool(side.any())
    order = np.argsort(family, kind="stable")
    family, node, side = family[order], node[order], side[order]
    lanes = np.ascontiguousarray(np.ascontiguousarray(sketch[order]).view(U64).T)
    ones = U64(0x1111111111111111)
    own = np.flatnonzero(side == 0)
    other = np.flatnonzero(side == 1) if across else own
    for f in np.unique(family[own]).tolist():
        left = own[family[own] == f]
        right = other[family[other] != f] if across else other[family[other] > f]
        if not len(right):
            continue
        step = max(1, (1 << 17) // len(right))
        for at in range(0, len(left), step):
            i = left[at : at + step]
            apart = np.zeros((len(i), len(right)), np.uint8)
            for lane in lanes:
                x = lane[i][:, None] ^ lane[right][None, :]
                x |= x >> U64(1)
                x |= x >> U64(2)
                apart += np.bitwise_count(x & ones)
            u, v = np.nonzero(apart <= HASHES - least)
            for x, y in zip(node[i[u]].tolist(), node[right[v]].tolist()):
                forest.join(x, y)


def _apart(rows: DataFrame, *keys: str) -> GroupedData:
    """rows grouped by keys, left and right, each group dealt on its own: a table that lies by `keys` already would keep all blocks of a key in one task."""
    return rows.repartition(*keys, "left", "right").groupBy(*keys, "left", "right")


def candidates(order: DataFrame, scratch: Scratch, crowd: int = CROWD, percent: int = PERCENT) -> DataFrame:
    """a long, b long: every node that is not the smallest of its family, and the smallest. order: tree, prefix, turned, node. Every two nodes
    that share a prefix and look alike are in one family: what neighbours cannot settle meets in blocks of about `crowd` rows."""
    parts = max(1, int(order.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    found = scratch.keep(neighbours(order.repartitionByRange(parts, "tree", "prefix", "turned").sortWithinPartitions("tree", "prefix", "turned"), percent))
    stars = components(found.filter("b is not null").select("a", "b"), scratch)
    rows = found.filter("b is null").select("tree", "prefix", "turned", F.col("a").alias("node"))
    rows = rows.join(stars.select(F.col("a").alias("node"), F.col("b").alias("root")), "node", "left").withColumn("family", F.coalesce("root", "node"))
    rows = scratch.keep(rows.withColumn("group", F.struct("tree", "prefix")))
    groups = rows.groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.min("family").alias("low"), F.max("family").alias("high"))
    groups = groups.filter("low < high").select("group", F.ceil(F.col("n") / crowd).alias("blocks"), "n")
    dealt = attached(rows, groups, "group", "blocks").filter("blocks is not null").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = dealt.select("tree", "prefix", F.least("block", "other").alias("left"), F.greatest("block", "other").alias("right"), "block", "family", "node", "turned")

    def group(got: pa.Table) -> pa.Table:
        got = got.combine_chunks()
        node, family, left = got["node"].to_numpy(), got["family"].to_numpy(), got["left"].to_numpy()
        sketch = raw(got["turned"].combine_chunks() if isinstance(got["turned"], pa.ChunkedArray) else got["turned"])[0].reshape(len(node), -1)
        forest = Forest()
        meet(family, sketch, node, (got["block"].to_numpy() != left).astype(np.int8), forest, loose(percent))
        release(len(node))
        return pa.Table.from_batches([forest.stars()])

    more = scratch.keep(_apart(dealt, "tree", "prefix").applyInArrow(group, "a long, b long"))
    return components(stars.union(more), scratch) if more.limit(1).count() else stars


def exact_sets(texts: list[bytes], k: int = WORDS) -> list[set]:
    """The set of each (lower-cased) text, as numbers that are equal for equal shingles only. Words are numbered as they come, then runs of
    2, 3, ... words by the number of the run before and that of the next word."""
    names: dict[bytes, int] = {}
    short: dict[tuple, int] = {}
    ids, off = [], [0]
    for t in texts:
        ids += [names.setdefault(w, len(names)) for w in t.split()]
        off.append(len(ids))
    word = np.array(ids, U64)
    run = word
    for j in range(1, k):
        if j > 1:
            run = np.unique(run, return_inverse=True)[1].astype(U64)
        run = run[: max(0, len(word) - j)] << U64(32) | word[j:]
    out = []
    for i, j in zip(off, off[1:]):
        out.append(set(run[i : j - k + 1].tolist()) if j - i >= k else {-1 - short.setdefault(tuple(ids[i:j]), len(short))} if j > i else set())
    return out


def linked(a: set, b: set, percent: int = PERCENT) -> bool:
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(a & b)
    return 100 * both >= percent * (len(a) + len(b) - both)


def confirm(label: np.ndarray, sketch: np.ndarray, sets: list[set], side: np.ndarray, forest: Forest, percent: int = PERCENT) -> None:
    """Joins the labels of the texts that confirmed links connect. side: with two blocks at hand, only pairs between them are looked at (0 and 1);
    with one, all (0)."""
    across, least = bool(side.any()), loose(percent)
    size = np.array([len(x) for x in sets])
    rows = np.flatnonzero(side == 0)
    other = np.flatnonzero(side == 1) if across else np.arange(len(label))
    step = max(1, (1 << 22) // max(1, len(other) * sketch.shape[1]))
    for at in range(0, len(rows), step):
        i = rows[at : at + step]
        agree = _AGREE[sketch[i][:, None, :] ^ sketch[other][None, :, :]].sum(2, dtype=np.int16)
        x, y = np.nonzero((agree >= least) & (label[i][:, None] != label[other][None, :]))
        if not across:
            x, y = x[i[x] < other[y]], y[i[x] < other[y]]
        big, small = np.maximum(size[i[x]], size[other[y]]), np.minimum(size[i[x]], size[other[y]])
        fits = 100 * small >= percent * big
        # the pairs of a step are judged at once, most alike first, so memory does not grow with the pairs of a family
        _judge(i[x][fits], other[y][fits], agree[x, y][fits], label, sets, forest, percent)


def _judge(a: np.ndarray, b: np.ndarray, n: np.ndarray, label: np.ndarray, sets: list[set], forest: Forest, percent: int) -> None:
    order = np.argsort(-n, kind="stable")
    for at in range(0, len(order), 2048):
        some = order[at : at + 2048]
        for i, j, x, y in zip(a[some].tolist(), b[some].tolist(), label[a[some]].tolist(), label[b[some]].tolist()):
            if forest.root(x) != forest.root(y) and linked(sets[i], sets[j], percent):
                forest.join(x, y)


def confirmed(dealt: DataFrame, percent: int = PERCENT) -> DataFrame:
    """dealt: family, left and right (block numbers), block, label, digest, sketch, text. a, b: forests of the labels that confirmed links connect."""

    def group(got: pa.Table) -> pa.Table:
        got = got.combine_chunks().sort_by("label")
        label, left, parts, sets = got["label"].to_numpy(), got["left"].to_numpy(), [], []
        for b in got.select(["text"]).to_batches():
            data, off = raw(column(b, "text"))
            sets += digests(data, off)
            data = lowered_bytes(data)
            parts += [data[i:j].tobytes() for i, j in zip(off[:-1].tolist(), off[1:].tolist())]
        # rows of equal doc_id may bring another text: only the node's own counts
        ok = np.array([i for i, (x, y) in enumerate(zip(sets, got["digest"].to_pylist())) if x == y], np.int64)
        sketch = raw(got["sketch"].combine_chunks() if isinstance(got["sketch"], pa.ChunkedArray) else got["sketch"])[0].reshape(len(label), -1)
        forest = Forest()
        confirm(label[ok], sketch[ok], exact_sets([parts[i] for i in ok]), (got["block"].to_numpy() != left).astype(np.int8)[ok], forest, percent)
        del parts, sets, sketch
        release(len(label))
        return pa.Table.from_batches([forest.stars()])

    return _apart(dealt, "family").applyInArrow(group, "a long, b long")


def _paired(rows: DataFrame, blocks: DataFrame, of: str) -> DataFrame:
    """rows dealt to the blocks of their family (by a hash of `of`), and copied to each pair of blocks: left, right, block."""
    out = attached(rows, blocks, "family", "blocks").filter("blocks is not null").withColumn("block", F.pmod(F.xxhash64(of), F.col("blocks")))
    out = out.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    return out.withColumn("left", F.least("block", "other")).withColumn("right", F.greatest("block", "other")).drop("other", "blocks")


def _blocks(rows: DataFrame, texts: int, family: int) -> DataFrame:
    return rows.groupBy("family").agg(F.greatest(F.ceil(F.count(F.lit(1)) / texts), F.ceil(F.sum("n") / family)).alias("blocks"), F.count(F.lit(1)).alias("n"))


def partners(rows: DataFrame, percent: int = PERCENT) -> DataFrame:
    """rows: family, left, right, block, label, node, sketch. node: those that look like one of another label."""

    def group(got: pa.Table) -> pa.Table:
        got = got.combine_chunks()
        node = got["node"].to_numpy()
        sketch = raw(got["sketch"].combine_chunks() if isinstance(got["sketch"], pa.ChunkedArray) else got["sketch"])[0].reshape(len(node), -1)
        seen = Forest()
        meet(got["label"].to_numpy(), sketch, node, (got["block"].to_numpy() != got["left"].to_numpy()).astype(np.int8), seen, loose(percent))
        release(len(node))
        return pa.table({"node": pa.array(list(seen.up), pa.int64())})

    return _apart(rows, "family").applyInArrow(group, "node long").distinct()


def settled(held: DataFrame, links: DataFrame, scratch: Scratch, texts: int, family: int, crowd: int, percent: int) -> DataFrame:
    """All links (as stars) of the families of several blocks, whose texts have met in their own blocks only. held: family, node, n, digest, sketch, text."""
    nodes = scratch.keep(held.select("family", "node", "n", "sketch"))
    before = None
    while True:
        tops = scratch.keep(nodes.join(links.select(F.col("a").alias("node")), "node", "left_anti").select("family", "node", "n"))
        blocks = scratch.keep(_blocks(tops, texts, family).filter("n > 1"))
        most, = blocks.agg(F.max("blocks")).first()
        left = tops.count()
        if not most or (before is not None and left > 0.8 * before):
            break
        dealt = attached(tops.select("family", "node"), blocks, "family", "blocks", left).filter("blocks is not null")
        met = held.join(dealt.withColumn("block", F.pmod(F.xxhash64("node", F.lit(left)), F.col("blocks"))).select("node", "block"), "node")
        more = confirmed(met.select("family", F.col("block").alias("left"), F.col("block").alias("right"), "block", F.col("node").alias("label"), "digest", "sketch", "text"), percent)
        links, before = components(links.union(scratch.keep(more)), scratch), left
        if most == 1:
            break
    label = nodes.join(links.select(F.col("a").alias("node"), F.col("b").alias("root")), "node", "left").withColumn("label", F.coalesce("root", "node"))
    apart = label.groupBy("family").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count(F.lit(1)).alias("nodes")).filter("low < high")
    label = scratch.keep(label)
    apart = apart.select("family", F.ceil(F.col("nodes") / min(crowd, APART)).alias("blocks"), F.col("nodes").alias("n"))
    met = partners(_paired(label.select("family", "node", "label", "sketch"), apart, "node"), percent)
    met = scratch.keep(label.join(met, "node").select("family", "node", "label", "n"))
    if not met.limit(1).count():
        return links
    dealt = held.join(_paired(met.drop("n"), _blocks(met, crowd, family), "node").drop("family"), "node")
    more = scratch.keep(confirmed(dealt.select("family", "left", "right", "block", "label", "digest", "sketch", "text"), percent))
    return components(links.union(more), scratch)


def groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT, texts: int = BLOCK_TEXTS, family: int = FAMILY, crowd: int = CROWD) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "near")
    rows = sketched(docs, doc_id, text, percent)
    rows = scratch.keep(rows.withColumn("digest", F.when(F.col("doc_id").isNotNull(), F.col("digest"))))
    nodes = rows.filter("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("id"), F.count(F.lit(1)).alias("copies"), F.max("n_shingles").alias("n"), F.max("prefixes").alias("prefixes"), F.max("sketch").alias("sketch"))
    nodes = scratch.keep(nodes.withColumn("node", F.monotonically_increasing_id()))
    half = HASHES // 2
    order = (
        nodes.select("node", "prefixes", "sketch", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree"))
        .select("tree", F.conv(F.hex(F.expr("substring(prefixes, tree * 8 + 1, 8)")), 16, -10).cast("long").alias("prefix"), F.concat(F.expr(f"substring(sketch, (tree * 3) % {half} + 1)"), F.expr(f"substring(sketch, 1, (tree * 3) % {half})")).alias("turned"), "node")
    )
    stars = candidates(order, scratch, crowd, percent)
    scratch.rest()
    member = stars.select(F.col("a").alias("node"), F.col("b").alias("family")).union(stars.select(F.col("b").alias("node"), F.col("b").alias("family")).distinct())
    member = scratch.keep(member.join(nodes, "node").select("family", "node", "id", "digest", "n", "sketch"))
    blocks = scratch.keep(_blocks(member, texts, family))
    dealt = attached(member, blocks, "family", "blocks").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    own = docs.select(docs[doc_id].cast("long").alias("id"), docs[text].alias("text"))
    own = sifted(own, F.col("id"), sieve(member, "id"), "some").filter("some").drop("some")
    wide = blocks.filter("blocks > 1").limit(1).count() > 0
    held = own.join(dealt, "id").drop("id")
    held = scratch.keep(held) if wide else held
    links = held.select("family", F.col("block").alias("left"), F.col("block").alias("right"), "block", F.col("node").alias("label"), "digest", "sketch", "text")
    links = scratch.keep(confirmed(links, percent))
    scratch.rest()
    if wide:
        links = settled(held.filter("blocks > 1").drop("blocks", "block"), links, scratch, texts, family, crowd, percent)
    root = links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    root = root.union(links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
    of = nodes.select("node", "digest", "id", "copies").join(root, "node", "left")
    least = of.filter("root is not null").groupBy("root").agg(F.min("id").alias("least"))
    # a text without copies and links is its own component; all others are looked up by their digests
    of = scratch.keep(of.filter("root is not null or copies > 1").join(least, "root", "left").select("digest", F.coalesce("least", "id").alias("component_id"), F.col("copies").alias("n")))
    out = attached(rows.filter("digest is not null").select("doc_id", "n_shingles", "digest"), of, "digest", "component_id").drop("digest")
    out = out.unionByName(rows.filter("digest is null").select("doc_id", "n_shingles", F.lit(None).cast("long").alias("component_id")))
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """The rows of docs, all columns, without those of a group whose doc_id is not its smallest. Rows of equal doc_id go or stay together. Only rows that a
    sieve of the doc_ids that go does not let through at once are shuffled."""
    name, flag = (f"{x}_{uuid.uuid4().hex}" for x in ("gone", "maybe"))
    found = groups(docs, doc_id, text, percent).filter("not kept").select(F.col("doc_id").alias(name)).distinct()
    gone = Scratch(docs.sparkSession, "near-gone").keep(found)
    rows = sifted(docs, F.col(doc_id).cast("long"), sieve(gone, name), flag)
    stay = rows.filter(~F.col(flag)).select(*docs.columns)
    return stay.unionByName(rows.filter(flag).join(gone, rows[doc_id].cast("long") == F.col(name), "left_anti").select(*docs.columns))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(load(spark, sf_dir), percent=85)
