"""Language identification by segmentation-marginalised unigrams.

A fixed public vocabulary of byte pieces is shared by all languages. Per language, each piece has a probability; a word's probability
is the sum over all its segmentations into pieces of the products of their probabilities, found by a forward pass over all pieces of the
vocabulary and the whole word, however long. A text's log probability is the sum over its words. Piece probabilities come from
expectation-maximisation with forward-backward passes over word counts. Words are lower-cased and carry a leading space. (Pieces with a
space inside cannot occur in a word.) Forward values are rescaled every BLOCK bytes, per word and language, so nothing underflows.

The fit reads a bounded sample: of each language about `per_lang` training documents and SAMPLE_BYTES over all languages (a hash of doc_id
below a rate), whole texts, of at most `most_bytes` each where the language has such; the shortest text of each language is always in it, so
every language is learned. A model holds 0.4 MB a language. Scoring reads every whole text. Words are scored once per batch of texts.

Defined results. Null text or no letter: `und`, score 0. Empty table: no rows. Nothing to learn from: `und`, score 0, for all. Ties between
languages: the first in alphabetical order. Repeated rows are scored each. Extra columns are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import U64, column, lanes, load, mix, owner, raw, remainder, slices, word_hashes, words

RANKS = "byte_bpe_multi_50k.tiktoken"
#: Scale per byte, and bytes after which values are scaled anew.
SCALE, BLOCK = 16.0, 16
#: Numbers of the forward table that are held at a time, and bytes of words at least.
CELLS, LEAST = 1 << 20, 256
ROUNDS = 3
PER_LANG, DOC_BYTES, SAMPLE_BYTES = 400, 1 << 16, 64 << 20
#: Weight of the mean of all languages in a piece's probability.
SMOOTH = 0.02
_STEM = 8


class Table:
    """An open hash table from 64-bit keys to their numbers."""

    def __init__(self, keys: np.ndarray):
        self.n, self.bits, self.probes = len(keys), max(10, (4 * len(keys)).bit_length()), 1
        self.key, self.id = np.zeros(1 << self.bits, U64), np.full(1 << self.bits, len(keys), np.int32)
        keys = keys | U64(1)
        for i, (k, s) in enumerate(zip(keys.tolist(), (keys >> U64(64 - self.bits)).tolist())):
            step = 1
            while self.key[s]:
                s, step = (s + 1) % len(self.key), step + 1
            self.key[s], self.id[s], self.probes = k, i, max(self.probes, step)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Number of each key; n where there is none."""
        keys = keys | U64(1)
        slot = (keys >> U64(64 - self.bits)).astype(np.int64)
        there = self.key[slot]
        out = np.where(there == keys, self.id[slot], np.int32(self.n))
        open_ = np.flatnonzero((there != keys) & (there != 0))
        for _ in range(self.probes - 1):
            if not len(open_):
                break
            slot[open_] = (slot[open_] + 1) % len(self.key)
            there = self.key[slot[open_]]
            hit = there == keys[open_]
            out[open_[hit]] = self.id[slot[open_[hit]]]
            open_ = open_[~hit & (there != 0)]
        return out


class Pieces:
    """The vocabulary: which piece, if any, lies where."""

    def __init__(self, ranks: str | None = None):
        import public_tokenizers as public

        with open(ranks or public.path(RANKS), "rb") as f:
            found = sorted({base64.b64decode(x.split()[0]) for x in f} | {bytes([i]) for i in range(256)})
        found = [x for x in found if x and b" " not in x[1:]]
        self.n, self.longest = len(found), max(map(len, found))
        self.length = np.array([len(x) for x in found] + [0], float)
        self.table = Table(self.keys(found))
        self.stems = Table(np.unique(self.keys([x[:_STEM] for x in found if len(x) > _STEM])))

    @staticmethod
    def keys(found: list[bytes]) -> np.ndarray:
        off = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int64)
        return word_hashes(np.frombuffer(b"".join(found), np.uint8), off[:-1], off[1:])

    def occurrences(self, data: np.ndarray, room: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(k, places, pieces) of the pieces of k bytes that begin at places with at least k bytes of room."""
        view, stems = lanes(data), None
        for k in range(1, self.longest + 1):
            at = np.flatnonzero(room >= k) if k <= _STEM else stems[room[stems] >= k]
            if not len(at):
                return
            h = np.full(len(at), mix(np.array([k + 1], U64) * U64(0x9E3779B97F4A7C15))[0])
            for j in range(0, k, 8):
                h = mix(h ^ (view[at + j] & U64((1 << 8 * min(8, k - j)) - 1)))
            ids = self.table.find(h)
            if k == _STEM:
                stems = at[self.stems.find(h) < self.stems.n]
            some = ids < self.n
            yield k, at[some], ids[some]


@lru_cache(2)
def pieces(ranks: str | None = None) -> Pieces:
    return Pieces(ranks)


class Lattice:
    """All pieces in all words. Word w covers size[w] bytes of data from base[w] on; words follow one another. Places 0 to size[w] of word w are
    numbered on from base[w] + w; an edge leads over one piece from a place to a later one. Edges are in order of the place in the word that
    they lead to. `skip`: no edges lead to the first places up to that one, whose values the caller gives."""

    def __init__(self, data: np.ndarray, base: np.ndarray, size: np.ndarray, vocabulary: Pieces, skip: int = 0):
        self.base, self.size, self.skip = base, size, skip
        word = np.repeat(np.arange(len(size)), size)
        room = (base + size)[word] - np.arange(len(data))
        src, dst, ids = [], [], []
        for k, at, found in vocabulary.occurrences(data, room):
            src.append(at + word[at])
            dst.append(at + word[at] + k)
            ids.append(found)
        self.src, self.dst, self.ids = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (src, dst, ids))
        self.first = base + np.arange(len(size))
        self.n = len(data) + len(size)
        of = np.repeat(np.arange(len(size)), size + 1)
        step = (np.arange(self.n) - self.first[of])[self.dst]
        order = np.argsort(step * self.n + self.dst, kind="stable")
        order = order[step[order] > skip]
        self.src, self.dst, self.ids, step = self.src[order], self.dst[order], self.ids[order], step[order]
        self.word = of[self.dst]
        self.steps = np.searchsorted(step, np.arange(skip, int(size.max() if len(size) else 0) + 1), side="right")
        self.heads = np.flatnonzero(np.concatenate([[True], self.dst[1:] != self.dst[:-1]])) if len(self.dst) else np.empty(0, np.int64)
        self.head_steps = np.searchsorted(self.heads, self.steps)
        far = self.src - self.first[self.word]
        self.from_block, self.to_block = np.maximum(far - 1, 0) // BLOCK, (step - 1) // BLOCK
        self.cross = self.from_block != self.to_block

    def forward(self, p: np.ndarray, given: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(values of the places, log scale [block, word] of the values in it, factor of each edge that crosses blocks), all by language; a place's
        true value is the sum over the segmentations before it. p: pieces (and a last row of zeros) by languages, scaled."""
        langs, blocks = p.shape[1], int(self.size.max() - 1) // BLOCK + 1 if len(self.size) else 1
        a = np.zeros((self.n, langs))
        a[self.first] = 1.0
        if given is not None:
            a[: len(given)] = given
        scale = np.zeros((blocks, len(self.size), langs))
        factor = np.ones((int(self.cross.sum()), langs))
        nth = np.cumsum(self.cross) - self.cross
        for j in range(self.skip + 1, self.skip + len(self.steps)):
            lo, hi = self.steps[j - 1 - self.skip], self.steps[j - self.skip]
            b = (j - 1) // BLOCK
            if j > self.skip + 1 and (j - 1) % BLOCK == 0:
                on = np.flatnonzero(self.size >= j)
                scale[b] = scale[b - 1]
                scale[b, on] += np.log(np.maximum(a[self.first[on] + j - 1], 1e-290))
            got = a[self.src[lo:hi]] * p[self.ids[lo:hi]]
            over = np.flatnonzero(self.cross[lo:hi])
            if len(over):
                e = lo + over
                factor[nth[e]] = np.exp(np.clip(scale[self.from_block[e], self.word[e]] - scale[b, self.word[e]], -600, 600))
                got[over] *= factor[nth[e]]
            h0, h1 = self.head_steps[j - 1 - self.skip], self.head_steps[j - self.skip]
            heads = self.heads[h0:h1]
            a[self.dst[heads]] = np.add.reduceat(got, heads - lo) if len(heads) else 0
        return a, scale, factor

    def logs(self, p: np.ndarray) -> np.ndarray:
        """Log probability of each word by language."""
        if not len(self.size):
            return np.zeros((0, p.shape[1]))
        a, scale, _ = self.forward(p)
        end = scale[(self.size - 1) // BLOCK, np.arange(len(self.size))]
        return np.log(np.maximum(a[self.first + self.size], 1e-290)) + end - self.size[:, None] * np.log(SCALE)

    def expected(self, p: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Expected piece counts by language. weight: words by languages."""
        a, _, factor = self.forward(p)
        last = self.first + self.size
        back = np.zeros_like(a)
        back[last] = weight / np.maximum(a[last], 1e-290)
        got = np.zeros((len(self.src), p.shape[1]))
        nth = np.cumsum(self.cross) - self.cross
        for lo, hi in zip(self.steps[-2::-1], self.steps[:0:-1]):
            through = back[self.dst[lo:hi]] * p[self.ids[lo:hi]]
            over = np.flatnonzero(self.cross[lo:hi])
            through[over] *= factor[nth[lo + over]]
            src = self.src[lo:hi]
            back[src] += through  # places before are all different
            got[lo:hi] = through * a[src]
        return np.stack([np.bincount(self.ids, got[:, c], p.shape[0]) for c in range(p.shape[1])], 1)


def spaced(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, start, size): each word with a leading space, in a buffer of its own, in the given order."""
    size = end - start + 1
    base = np.concatenate([[0], np.cumsum(size)])
    out = np.full(base[-1], 32, np.uint8)
    inside = np.ones(base[-1], bool)
    inside[base[:-1]] = False
    of = owner(base)
    at = np.arange(base[-1]) - base[of] - 1 + start[of]
    out[inside] = data[at[inside]]
    return out, base[:-1], size


def runs(size: np.ndarray, limit: int) -> Iterator[slice]:
    """Runs of words of at most `limit` bytes together; a longer word is a run of its own."""
    total, at = np.concatenate([[0], np.cumsum(size)]), 0
    while at < len(size):
        to = max(at + 1, int(np.searchsorted(total, total[at] + limit, side="right")) - 1)
        yield slice(at, to)
        at = to


def long_word(data: np.ndarray, p: np.ndarray, v: Pieces, limit: int) -> np.ndarray:
    """Log probability of one word by language, stretch by stretch: a stretch takes up the values of the places before it, so no segmentation is lost."""
    done, given, logs = 0, None, np.zeros(p.shape[1])
    while done < len(data):
        back = min(done, v.longest)
        part = data[done - back : done + limit]
        lattice = Lattice(part, np.zeros(1, np.int64), np.array([len(part)]), v, back)
        a, scale, _ = lattice.forward(p, given)
        done = done - back + len(part)
        b = (len(part) - 1) // BLOCK
        tail = np.arange(max(0, len(part) - v.longest), len(part) + 1)
        given = a[tail] * np.exp(np.clip(scale[np.maximum(tail - 1, 0) // BLOCK, 0] - scale[b, 0], -600, 600))
        top = np.maximum(given[-1], 1e-290)
        given, logs = given / top, logs + scale[b, 0] + np.log(top)
    return logs - len(data) * np.log(SCALE)


@dataclass
class Model:
    langs: list[str]
    p: np.ndarray  # pieces + 1 by languages, scaled; last row zeros
    ranks: str | None

    def word_logs(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Log probability of each word by language. Words are taken in order of length, so few steps serve many."""
        v, limit = pieces(self.ranks), max(LEAST, CELLS // len(self.langs))
        order = np.argsort(end - start, kind="stable")
        buffer, at, size = spaced(data, start[order], end[order])
        out = np.zeros((len(start), len(self.langs)))
        for some in runs(size, limit):
            lo, hi = at[some][0], at[some][-1] + size[some][-1]
            if hi - lo > limit:
                out[order[some]] = long_word(buffer[lo:hi], self.p, v, limit)
            else:
                out[order[some]] = Lattice(buffer[lo:hi], at[some] - lo, size[some], v).logs(self.p)
        return out

    def text_logs(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Log probability of each text by language; every distinct word of the batch is scored once."""
        start, end, bounds = words(data, off)
        _, first, back = np.unique(word_hashes(data, start, end), return_index=True, return_inverse=True)
        logs, of = self.word_logs(data, start[first], end[first]) if len(start) else np.zeros((0, len(self.langs))), owner(bounds)
        return np.stack([np.bincount(of, logs[back, c], len(off) - 1) for c in range(len(self.langs))], 1)


def lowered(col: pa.Array) -> pa.Array:
    try:
        return pc.utf8_lower(col)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError):
        return pa.array([None if x is None else x.decode("utf-8", "replace").lower() for x in col.cast(pa.large_binary()).to_pylist()], pa.large_string())


def word_counts(docs: DataFrame) -> DataFrame:
    """lang, word binary, n: summed over all rows of docs (lang, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text"):
                data, off = raw(lowered(column(b, "text")))
                start, end, bounds = words(data, off)
                if not len(start):
                    continue
                names, code = np.unique(np.array(column(b, "lang").to_pylist()), return_inverse=True)
                key = word_hashes(data, start, end) ^ mix(code[owner(bounds)].astype(U64) + U64(1))
                _, first, n = np.unique(key, return_index=True, return_counts=True)
                lang = names[code[owner(bounds)[first]]]
                found = [data[s:e].tobytes() for s, e in zip(start[first], end[first])]
                yield pa.RecordBatch.from_arrays([pa.array(lang.tolist(), pa.string()), pa.array(found, pa.binary()), pa.array(n)], ["lang", "word", "n"])

    return docs.mapInArrow(run, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def estimate(langs: list[str], lang: np.ndarray, found: list[bytes], n: np.ndarray, ranks: str | None = None, rounds: int = ROUNDS) -> Model:
    """Piece probabilities from rows (lang index, word, count)."""
    v = pieces(ranks)
    types, of = np.unique(np.array(found, object), return_inverse=True)
    length = np.array([len(x) for x in types])
    order = np.argsort(length, kind="stable")
    types, of = types[order], np.argsort(order)[of]
    off = np.concatenate([[0], np.cumsum(length[order])]).astype(np.int64)
    buffer, at, size = spaced(np.frombuffer(b"".join(types), np.uint8), off[:-1], off[1:])
    weight = np.zeros((len(types), len(langs)))
    np.add.at(weight, (of, lang), n)
    # a piece of k bytes begins with weight SCALE^-k: longer pieces are rarer, in the same measure for all languages
    p = np.repeat((SCALE ** (1 - v.length))[:, None] / v.n, len(langs), 1)
    p[-1] = 0
    grow = (SCALE**v.length)[:, None]
    lattices = []
    for some in runs(size, max(LEAST, CELLS // len(langs))):
        lo, hi = at[some][0], at[some][-1] + size[some][-1]
        lattices.append((Lattice(buffer[lo:hi], at[some] - lo, size[some], v), weight[some]))
    for _ in range(rounds):
        count = sum(x.expected(p * grow, w) for x, w in lattices)
        count[-1] = 0
        own = (count + 1e-3) / (count + 1e-3)[:-1].sum(0)
        p = (1 - SMOOTH) * own + SMOOTH * own.mean(1, keepdims=True)
        p[-1] = 0
    return Model(langs, p * grow, ranks)


def fit(docs: DataFrame, per_lang: int = PER_LANG, most_bytes: int = DOC_BYTES, sample_bytes: int = SAMPLE_BYTES, ranks: str | None = None) -> Model | None:
    """docs: doc_id, text, lang; learns from rows whose crc32(doc_id as text) mod 4 is not 2 and that have text and lang."""
    rows = docs.select("doc_id", "text", "lang").filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (remainder(F.col("doc_id"), 4) != 2))
    size = F.octet_length("text").cast("long")
    rank = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text")), F.lit(11)), F.lit(1 << 30))
    short = size <= most_bytes
    seen = rows.groupBy("lang").agg(F.count_if(short).alias("rows"), F.sum(F.when(short, size)).alias("bytes"), F.min(F.struct(size.alias("size"), rank.alias("rank"))).alias("least")).orderBy("lang").collect()
    if not seen:
        return None
    # an entry per language; as literals, so texts are filtered where they are read
    each = sample_bytes / len(seen)
    rate = {r.lang: int((1 << 30) * min(1.0, per_lang / r.rows, each / max(1, r.bytes))) if r.rows else 0 for r in seen}
    of = lambda values: F.try_element_at(F.create_map(*[F.lit(x) for k, v in values.items() for x in (k, v)]), F.col("lang"))
    shortest = (size == of({r.lang: r.least["size"] for r in seen})) & (rank == of({r.lang: r.least["rank"] for r in seen}))
    got = word_counts(rows.filter((short & (rank < of(rate))) | shortest).select("lang", "text")).toArrow()
    if not got.num_rows:
        return None
    langs, code = np.unique(np.array(got["lang"].to_pylist()), return_inverse=True)
    return estimate(langs.tolist(), code, got["word"].to_pylist(), got["n"].to_numpy(), ranks)


def predict(docs: DataFrame, model: Model | None, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """keep columns, lang_pred string, score double: the posterior of the predicted language under equal priors."""
    schema = T.StructType([docs.schema[k] for k in keep] + [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, text, 4 << 20):
                low = lowered(column(b, text))
                letters = np.array(pc.fill_null(pc.match_substring_regex(low, r"\p{L}"), False))
                if model is None:
                    pred, score = ["und"] * b.num_rows, np.zeros(b.num_rows)
                else:
                    logs = model.text_logs(*raw(low))
                    best = logs.argmax(1)
                    score = np.where(letters, 1 / np.exp(logs - logs.max(1, keepdims=True)).sum(1), 0.0)
                    pred = [model.langs[k] if ok else "und" for k, ok in zip(best, letters)]
                yield pa.RecordBatch.from_arrays([*(column(b, k) for k in keep), pa.array(pred, pa.string()), pa.array(score)], [*keep, "lang_pred", "score"])

    return docs.select(*keep, text).mapInArrow(run, schema)


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir)
    return predict(docs, fit(docs)).select("doc_id", (remainder(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")
