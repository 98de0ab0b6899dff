"""op3, op4, op6 against brute force."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from compare import difference
from llm_data import prose
from pyspark.sql import functions as F

from tessera.llm import components, exact_dedup, near_dedup, queries, substring_dedup
from tessera.llm.common import Scratch, attached, rolling, sieve, sifted, word_hashes

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_groups(texts: dict, percent: int = 80) -> dict:
    sets = {}
    for i, t in texts.items():
        w = WORD.findall((t or "").translate(LOWER))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    held = defaultdict(list)
    for i in sorted(sets):
        common = defaultdict(int)
        for s in sets[i]:
            for j in held[s]:
                common[j] += 1
            held[s].append(i)
        for j, n in common.items():
            if 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), root(i), root(i) == i) for i in sets}


def brute_cut(texts: dict, window: int = 50) -> dict:
    words, least = {i: WORD.findall(t or "") for i, t in texts.items()}, {}
    for i in sorted(words):
        for k in range(len(words[i]) - window + 1):
            least.setdefault(tuple(words[i][k : k + window]), i)
    out = {}
    for i, w in words.items():
        gone = set()
        for k in range(len(w) - window + 1):
            if least[tuple(w[k : k + window])] < i:
                gone |= set(range(k, k + window))
        out[i] = (len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))
    return out


def family(seed: int, n: int, size: int, changes: int) -> dict:
    """Near copies of one text, each with some words changed: many pairs lie about the threshold."""
    r = random.Random(seed)
    base = [f"w{r.randrange(5000)}" for _ in range(size)]
    out = {}
    for i in range(n):
        w = list(base)
        for _ in range(r.randint(0, changes)):
            w[r.randrange(size)] = f"v{r.randrange(10**6)}"
        out[i] = " ".join(w)
    return out


def as_frame(spark, texts: dict):
    return spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)


def test_near_query_equals_brute_force(spark, sf, small):
    want = brute_groups({r.doc_id: r.text for r in small.collect()}, 85)
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in queries.QUERIES["op3_near_dedup"](spark, sf).collect()} == want


@pytest.mark.parametrize(("seed", "n", "size", "changes"), [(1, 120, 200, 12), (2, 150, 60, 3), (3, 60, 12, 1)])
def test_near_on_borderline_families(spark, seed, n, size, changes):
    texts = family(seed, n, size, changes) | {1000 + k: v for k, v in family(seed + 10, 20, size, changes).items()}
    want = brute_groups(texts)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.groups(as_frame(spark, texts)).collect()}
    assert got == want


def test_near_in_blocks_equals_one_task(spark):
    texts = family(5, 80, 120, 9)
    want = brute_groups(texts)
    for how in ({"family": 2000}, {"texts": 7, "crowd": 9}):
        got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.groups(as_frame(spark, texts), **how).collect()}
        assert got == want


def test_near_family_of_several_groups(spark):
    """One family (alike enough for the sketches) of groups that no link connects, and links between blocks only."""
    r = random.Random(9)
    base, texts = [f"w{k}" for k in range(400)], {}
    for g in range(4):
        own = [f"g{g}x{k}" if k % 60 == 0 else w for k, w in enumerate(base)]
        for i in range(15):
            w = list(own)
            w[r.randrange(400)] = f"v{r.randrange(10**6)}"
            texts[100 * g + i] = " ".join(w)
    want = brute_groups(texts, 90)
    assert len({x[1] for x in want.values()}) == 4
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.groups(as_frame(spark, texts), percent=90, texts=4, crowd=10).collect()}
    assert got == want


def doubling(n: int) -> tuple[str, str]:
    """A sequence of two letters that doubles by its complement, and the complement: they collide under every sum of powers modulo 2^64."""
    x = "a"
    while len(x) < n:
        x += x.translate(str.maketrans("ab", "ba"))
    return x, x.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("n", [8, 64, 1024, 4096])
def test_words_that_collide_under_polynomials(spark, n):
    a, b = doubling(n)
    texts = {1: a, 2: b} | {10 + k: " ".join([w, *["same"] * 49]) for k, w in enumerate((a, b))}
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.groups(as_frame(spark, texts)).collect()} == brute_groups(texts)
    got = {x.doc_id: (x.n_words, x.n_removed, bytes(x.kept).decode()) for x in substring_dedup.repeats(as_frame(spark, texts)).collect()}
    assert got == brute_cut(texts)


def test_word_hashes_differ():
    r = random.Random(3)
    found = {bytes(r.choice(b"ab") for _ in range(r.choice((1, 7, 8, 9, 16, 17, 255, 256, 257, 300)))) for _ in range(3000)}
    found |= {b"a" * n for n in range(1, 600)} | {x.encode() for n in (256, 1024) for x in doubling(n)}
    data, off = b"".join(found), np.concatenate([[0], np.cumsum([len(x) for x in found])])
    data = np.frombuffer(data, np.uint8)
    assert len(set(word_hashes(data, off[:-1], off[1:]).tolist())) == len(found)
    again = word_hashes(data[3:], off[:-1][off[:-1] >= 3] - 3, off[1:][off[:-1] >= 3] - 3)
    assert again.tolist() == word_hashes(data, off[:-1], off[1:])[off[:-1] >= 3].tolist()
    h = word_hashes(data, off[:-1], off[1:])
    for k in (1, 2, 25, 50):
        x = rolling(np.concatenate([h, h]), k)
        assert (x[: len(h) - k] == x[len(h) : len(h) + len(h) - k]).all() and len(set(x[: len(h)].tolist())) == len(h)


def test_a_sieve_lets_all_its_keys_through(spark):
    keys = spark.range(0, 3000, 3).withColumnRenamed("id", "k")
    rows = spark.range(-500, 6000).selectExpr("if(id < 0, null, id) as x", "id as _bucket")
    got = sifted(rows, F.col("x"), sieve(keys, "k"), "hit")
    assert got.columns == ["x", "_bucket", "hit"]
    hit = [r.x for r in got.filter("hit").collect()]
    assert set(range(0, 3000, 3)) <= set(hit) and len(hit) < 1010 and None not in hit and got.count() == 6500


def test_attached_with_hot_keys(spark):
    rows = spark.range(30_000).selectExpr("if(id % 3 = 0, 7, if(id % 100 = 1, null, id)) as k", "id")
    of = spark.createDataFrame([(7, 70, 10_000), (8, 80, 1), (40_000, 1, 1)], "k long, v long, n long")
    got = [(r.k, r.v) for r in attached(rows, of, "k", "v").collect()]
    assert len(got) == 30_000 and got.count((7, 70)) == sum(1 for i in range(30_000) if i % 3 == 0 or i == 7) and got.count((8, 80)) == 1
    assert sum(v is not None for _, v in got) == got.count((7, 70)) + 1


def test_near_on_edge_rows(edge, empty):
    rows = near_dedup.groups(edge).collect()
    assert len(rows) == edge.count() and near_dedup.groups(empty).count() == 0
    by = defaultdict(set)
    for r in rows:
        by[r.doc_id].add((r.component_id, r.kept))
    assert by[None] == {(None, True)}
    assert by[3] == {(3, True)} and by[7] == by[11] == {(3, False)}
    assert by[20] == {(20, True)} and by[21] == {(20, False)}
    assert by[30] == {(30, True)} and by[31] == {(31, True)} and by[32] == {(32, True)}
    assert by[40] == {(40, True)} and by[41] == {(40, False)}
    kept = near_dedup.keep_one(edge)
    assert kept.columns == edge.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in rows if r.kept)


def test_near_at_another_threshold(spark):
    """A pair of similarity 0.818: linked at 80 percent (as unless told), not at 85."""
    base = [f"w{i}" for i in range(204)]
    other = [f"v{i}" if i in (50, 90, 130, 170) else w for i, w in enumerate(base)]
    docs = as_frame(spark, {1: " ".join(base), 2: " ".join(other)} | {k: " ".join(f"t{k}x{i}" for i in range(50)) for k in range(3, 9)})
    assert sorted(r.doc_id for r in near_dedup.keep_one(docs).collect()) == [1, 3, 4, 5, 6, 7, 8]
    assert near_dedup.keep_one(docs, percent=85).count() == 8
    assert [near_dedup.depth(x) for x in (80, 85)] == [3, 5] and near_dedup.loose(85) == 92


@pytest.mark.parametrize("crowd", [2048, 100])
def test_near_in_a_crowded_prefix(spark, crowd):
    """Nodes 0 and 1 look alike but sort to the two ends of 400 unlike nodes of their prefix; another prefix lies on either side."""
    sketch = np.random.default_rng(8).integers(17, 238, (400, 64)).astype(np.uint8)
    sketch[1] = sketch[0]
    sketch[0, :2], sketch[1, :2] = 0, 255
    rows = [(0, 5, bytearray(x.tobytes()), i) for i, x in enumerate(sketch)] + [(0, p, bytearray(sketch[9].tobytes()), 1000 + p) for p in range(10) if p != 5]
    order = spark.createDataFrame(rows, "tree int, prefix long, turned binary, node long")
    in_order = order.repartitionByRange(1, "tree").sortWithinPartitions("tree", "prefix", "turned")
    assert near_dedup.neighbours(in_order).filter("b is not null").count() == 0
    was = spark.conf.get("spark.sql.shuffle.partitions")
    for parts in (1, 4):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        try:
            got = near_dedup.candidates(order, Scratch(spark, "t"), crowd).collect()
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", was)
        assert [(r.a, r.b) for r in got] == [(1, 0)]


@pytest.mark.parametrize("parts", [3, 200])
def test_near_does_not_depend_on_partitions(spark, parts):
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        texts = {i: " ".join(f"new{i}" if i % 2 and k in (50, 150, 250) else w for k, w in enumerate(prose(40 + i // 2, 300).split())) for i in range(6)}
        want = brute_groups(texts)
        assert [want[i][1] for i in range(6)] == [0, 0, 2, 2, 4, 4]
        assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.groups(as_frame(spark, texts)).collect()} == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)


def test_components(spark, tmp_path):
    r = random.Random(4)
    edges = [(r.randrange(400), r.randrange(400)) for _ in range(330)] + [(k, k + 1) for k in range(1000, 1060)] + [(2000, k) for k in range(2001, 2300)] + [(5, 5)]
    up = {}

    def root(x):
        while up.get(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    want = {x: root(x) for e in edges for x in e if root(x) != x}
    df = spark.createDataFrame(edges, "a long, b long").repartition(4)
    for e in (df, components.contracted(df)):
        assert {x.a: x.b for x in components.components(e, Scratch(spark, "t")).collect()} == want
    assert components.components(df.limit(0), Scratch(spark, "t")).count() == 0


def test_exact_query_equals_sql(spark, sf):
    assert difference(queries.QUERIES["op4_exact_dedup"](spark, sf), sf, queries.ORACLE_SQL["op4_exact_dedup"]) is None


@pytest.mark.parametrize("fan_in", [2, 8])
def test_exact_over_many_runs(spark, fan_in):
    r = random.Random(6)
    texts = {i: "hot  text" if i % 3 == 0 else f"t{r.randrange(40)}\n" for i in range(300)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(11)
    groups = defaultdict(list)
    for i, t in texts.items():
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t)].append(i)
    want = {i: (min(g), len(g), i == min(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for i in g}
    assert {x.doc_id: (x.keep_id, x.group_size, x.kept, x.text_sha256) for x in exact_dedup.assign(df, fan_in=fan_in).collect()} == want


def test_exact_on_edge_rows(edge, empty):
    rows = exact_dedup.assign(edge).collect()
    assert len(rows) == edge.count() and exact_dedup.assign(empty).count() == 0
    assert sum(r.kept for r in rows) == len({r.text_sha256 for r in rows})
    by = {r.doc_id: r for r in rows}
    assert (by[11].keep_id, by[7].keep_id, by[3].kept, by[3].group_size) == (3, 3, True, 3)
    assert by[31].keep_id == 30 and by[31].group_size == 3  # null texts are empty ones
    forty = [r for r in rows if r.doc_id == 40]
    assert sorted(r.kept for r in forty) == [False, True] and {r.group_size for r in forty} == {2}
    kept = exact_dedup.keep_first(edge)
    assert kept.columns == edge.columns and kept.count() == sum(r.kept for r in rows)


def test_exact_is_native(edge):
    plan = exact_dedup.assign(edge)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_substring_query_equals_brute_force(spark, sf, small):
    want = {i: (n, k, hashlib.sha256(t.encode()).hexdigest()) for i, (n, k, t) in brute_cut({r.doc_id: r.text for r in small.collect()}).items()}
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in queries.QUERIES["op6_substring_dedup"](spark, sf).collect()} == want


@pytest.mark.parametrize(("seed", "size"), [(1, 400), (2, 1 << 20), (3, 60)])
def test_substring_over_slices(spark, seed, size):
    """A tiny vocabulary, short windows and slices of few documents: repeats everywhere, and across slices and buckets."""
    r = random.Random(seed)
    phrase = [f"p{k}" for k in range(15)]
    texts = {}
    for i in range(120):
        w = [r.choice("abc") for _ in range(r.randrange(40))]
        if i % 3 == 0:
            at = r.randrange(len(w) + 1)
            w[at:at] = phrase[r.randrange(4) : 15 - r.randrange(4)]
        texts[i] = r.choice([" ", "\n"]).join(w)
    want = brute_cut(texts, 8)
    got = {x.doc_id: (x.n_words, x.n_removed, bytes(x.kept).decode()) for x in substring_dedup.repeats(as_frame(spark, texts), window=8, block=4, size=size).collect()}
    assert got == want


def test_substring_on_edge_rows(edge, empty):
    rows = substring_dedup.repeats(edge).collect()
    assert len(rows) == edge.count() and substring_dedup.repeats(empty).count() == 0
    by = {r.doc_id: r for r in rows}
    assert by[3].n_removed == 0 and by[11].n_removed == by[11].n_words == 180 and by[7].n_removed == 180
    assert by[20].n_removed == 0 and by[21].n_removed == by[21].n_words - 1 and len(by[21].spans) == 2
    assert by[30].n_words == by[31].n_words == by[32].n_words == 0 and by[None].n_removed == 0 and by[50].n_words == 1
    with pytest.raises(ValueError):
        substring_dedup.repeats(edge, window=10, block=8)


def test_shingles_and_hashes_are_exact():
    texts = ["a b c d e f", "A b c d e", "a b", "", "a b c d e a b c d e"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    off = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    s, b = near_dedup.shingles(data, off)
    sets = [set(s[i:j].tolist()) for i, j in zip(b[:-1], b[1:])]
    assert [len(x) for x in sets] == [2, 1, 1, 0, 5] and len(sets[0] & sets[1]) == 1 and sets[1] < sets[4]
