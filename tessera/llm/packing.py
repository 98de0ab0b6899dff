"""Packing: first-fit decreasing with a tournament tree of bin capacities, in randomised groups of documents.

Documents are dealt to groups by a hash; the number of groups follows the bytes of text, so a group is a bounded load for one task. In a
group, full-length pieces are sequences of their own; what is left of each document goes, longest first, into the first open sequence
with room, found by descending a tree that holds the largest free capacity under each node. Then the least filled sequences are cut
up to fill the gaps of the others, and the last one is cut into powers of two, so no sequence of a group needs padding.

Tokens come from a per-process table of words: the tokenizer drops white space and never merges across it, so a text's ids are its
words' ids, concatenated. Words are split at ASCII blanks and line ends only. A word of plain letters (no character from U+0130 on, for which
normal forms and lower case are simple) is split by the tokenizer's own pattern, and the library's merge model gives each part's ids; any
other word, and one that may hold a special token, goes through the whole tokenizer. A tokenizer file of another make (its normal form, split or
model are compared with those that all this is true of) encodes whole texts, without tables.

Defined results. Null or empty text: one piece, the end id alone. Empty table: no rows. Rows with the same doc_id are packed each, and
their pieces carry the same doc_id. Null doc_id is packed too. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import column, load, ready, slices, strings

VOCABULARY = "word_bpe_49k.json"
END_ID = 1
LENGTH = 2048
#: Bytes of text in a group, on average.
GROUP_BYTES = 16 << 20
SEED = 7
#: Words kept per process, and the longest word that is kept; bytes of text for which other words are kept.
TABLE_WORDS, TABLE_CHARS, BATCH_BYTES = 200_000, 48, 1 << 20


#: What tables of words are right for: normal form, split and model of the tokenizer.
_MADE = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
    "post_processor": None,
}
#: The tokenizer's split pattern, and the words whose normal form is their lower case.
_SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
_PLAIN = regex.compile(r"[!-~\xa1-\u012f]+")


def _byte_letters() -> dict[int, str]:
    """The characters that stand for bytes in byte-level vocabularies: printable ones for themselves, the others from U+0100 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return {b: chr(b if b in own else next(rest)) for b in range(256)}


class Words(dict):
    """Ids of words, as bytes. Holds a bounded number; words beyond it are kept for one batch only."""

    def __init__(self, path: str | None):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers as public
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path or public.path(VOCABULARY))
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model, spec = self.tokenizer.model, json.loads(self.tokenizer.to_str())
        added = [x["content"] for x in spec["added_tokens"]]
        self.by_words = all(spec.get(k) == v for k, v in _MADE.items()) and spec["model"]["type"] == "BPE" and all(x.startswith("<|") for x in added)
        self.dtype = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        self.kind = "H" if self.dtype == "<u2" else "I"
        self.letters = _byte_letters()
        self.parts: dict[str, bytes] = {}
        self.rest: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        found = self.rest.get(word)
        if found is None:
            found = self.word(word)
            (self if len(self) < TABLE_WORDS and len(word) <= TABLE_CHARS else self.rest)[word] = found
        return found

    def part(self, text: str) -> bytes:
        found = self.parts.get(text)
        if found is None:
            ids = [x.id for x in self.model.tokenize(text if text.isascii() else text.encode().decode("latin-1").translate(self.letters))]
            found = struct.pack(f"<{len(ids)}{self.kind}", *ids)
            if len(self.parts) < TABLE_WORDS and len(text) <= TABLE_CHARS:
                self.parts[text] = found
        return found

    def word(self, word: str) -> bytes:
        low = word.lower()
        found = self.parts.get(low)
        if found is not None:  # a part is never split, and only plain words have parts
            return found
        if low[-1:] in (".", ",") and low[-2:-1].isalpha() and (found := self.parts.get(low[:-1])) is not None:
            return found + self.part(low[-1])
        if _PLAIN.fullmatch(word) and "<|" not in word:
            return b"".join([self.part(x) for x in _SPLIT.findall(low)])
        ids = self.tokenizer.encode(word, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}{self.kind}", *ids)


@lru_cache(2)
def table(path: str | None) -> Words:
    return Words(path)


def encode_texts(texts: list[str], path: str | None = None) -> list[bytes]:
    """Ids of each text with the end id, packed in the table's dtype."""
    t = table(path)
    t.rest.clear()
    end = np.array([END_ID], t.dtype).tobytes()
    if not t.by_words:
        return [np.array(t.tokenizer.encode(x, add_special_tokens=False).ids, t.dtype).tobytes() + end for x in texts]
    return [b"".join(map(t.__getitem__, x.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" "))) + end for x in texts]


class Tournament:
    """Bins in order of opening; finds the first with a given room in O(log bins)."""

    def __init__(self, most: int):
        self.size = 1 << max(0, most - 1).bit_length()
        self.tree = [0] * (2 * self.size)

    def set(self, i: int, room: int) -> None:
        tree, i = self.tree, i + self.size
        tree[i] = room
        while i > 1:
            i >>= 1
            a, b = tree[2 * i], tree[2 * i + 1]
            now = a if a > b else b
            if tree[i] == now:
                return
            tree[i] = now

    def first(self, room: int) -> int:
        tree, i = self.tree, 1
        if tree[1] < room:
            return -1
        while i < self.size:
            i *= 2
            if tree[i] < room:
                i += 1
        return i - self.size


def pack(sizes: list[int], length: int = LENGTH) -> list[list[tuple[int, int, int]]]:
    """Sequences of (document, start, length) that hold every document's tokens once and need no padding: each is full or a power of two."""
    out = [[(d, at, length)] for d, n in enumerate(sizes) for at in range(0, n - n % length, length)]
    left = sorted(((n % length, -d) for d, n in enumerate(sizes) if n % length), reverse=True)
    bins: list[list[tuple[int, int, int]]] = []
    tree, room = Tournament(max(1, len(left))), []
    for n, d in left:
        i = tree.first(n)
        if i < 0:
            i = len(bins)
            bins.append([])
            room.append(length)
        bins[i].append((-d, sizes[-d] - n, n))
        room[i] -= n
        tree.set(i, room[i])
    order = sorted(range(len(bins)), key=lambda i: (room[i], i))  # fullest first
    give = len(order) - 1
    for at, i in enumerate(order):
        while at < give and room[i]:
            d, start, n = bins[order[give]].pop()
            take = min(n, room[i])
            bins[i].append((d, start + n - take, take))
            room[i] -= take
            room[order[give]] += take
            if take < n:
                bins[order[give]].append((d, start, n - take))
            if not bins[order[give]]:
                give -= 1
        if at >= give:
            break
    for i in order[: give + 1]:
        if not room[i]:
            out.append(bins[i])
            continue
        used = length - room[i]
        rest = bins[i][::-1]
        for bit in range(used.bit_length() - 1, -1, -1):
            want, seq = used & 1 << bit, []
            while want:
                d, start, n = rest.pop()
                take = min(n, want)
                seq.append((d, start, take))
                want -= take
                if take < n:
                    rest.append((d, start + take, n - take))
            if seq:
                out.append(seq)
    return out


PIECES = T.StructType([T.StructField(k, T.LongType()) for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])


def sequences(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, group_bytes: int = GROUP_BYTES, path: str | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and ids binary (as the tokenizer's table packs
    them, little-endian)."""
    ready(docs.sparkSession)
    total = docs.agg(F.sum(F.octet_length(text).cast("long"))).first()[0] or 0
    groups = max(1, -(-total // group_bytes))
    rows = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("text"), F.pmod(F.xxhash64(docs[doc_id], docs[text], F.lit(SEED)), F.lit(groups)).alias("part"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text", BATCH_BYTES):
                ids = pa.array(encode_texts(strings(column(b, "text")), path), pa.binary())
                yield pa.RecordBatch.from_arrays([column(b, "part"), column(b, "doc_id"), ids], ["part", "doc_id", "ids"])

    def group(got: pa.Table) -> pa.Table:
        kind = np.dtype(table(path).dtype)
        got = got.sort_by([("doc_id", "ascending"), ("ids", "ascending")])
        part, names, ids = got["part"][0].as_py(), got["doc_id"].to_pylist(), [np.frombuffer(x, kind) for x in got["ids"].to_pylist()]
        rows = []
        for s, seq in enumerate(pack([len(x) for x in ids], length)):
            at = 0
            for d, start, n in seq:
                piece = ids[d][start : start + n]
                rows.append((names[d], start, n, zlib.crc32(piece.astype("<u4").tobytes()), len(ids[d]), (part << 32) + s, at, piece.tobytes()))
                at += n
        kinds = [pa.int64()] * 7 + [pa.binary()]
        return pa.Table.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], names=[*PIECES.names, "ids"])

    coded = rows.mapInArrow(encode, "part long, doc_id long, ids binary")
    return coded.groupBy("part").applyInArrow(group, T.StructType([*PIECES.fields, T.StructField("ids", T.BinaryType())]))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences(load(spark, sf_dir)).select(*PIECES.names)
