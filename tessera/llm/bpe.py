"""Byte-level BPE encoding and decoding with tiktoken and a local rank file.

Long texts are cut where the split pattern cannot match across: right before an ASCII space or line feed that follows a character
which is no white space. No alternative of the pattern holds a space after a non-space, and the look-ahead of the white-space
alternative only concerns white space, so the parts' ids, concatenated, are the text's ids. A stretch without such a place is one part.

Defined results. Null and empty text: no ids. Empty table: no rows. Rows with equal ids or texts are encoded each. Bytes that are no
UTF-8 count as U+FFFD. Columns other than `keep` and `text` are not read.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import column, load, packed, raw, slices, strings

RANKS = "byte_bpe_multi_50k.tiktoken"
#: Characters from which on a text is cut at safe places.
PART_CHARS = 1 << 16
_SAFE = re.compile(r"(?<=\S)(?=[ \n])")


@lru_cache(4)
def encoding(ranks: str | None = None):
    import public_tokenizers as public
    import tiktoken

    with open(ranks or public.path(RANKS), "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("local", pat_str=public.PATTERN, mergeable_ranks=table, special_tokens={})


def parts(text: str, size: int = PART_CHARS) -> Iterator[str]:
    at = 0
    while len(text) - at > size:
        cut = _SAFE.search(text, at + size)
        if not cut:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:] if at else text


def encode_text(text: str, enc, size: int = PART_CHARS) -> np.ndarray:
    found = [enc.encode_to_numpy(x, disallowed_special=()) for x in parts(text, size)]
    return found[0] if len(found) == 1 else np.concatenate(found)


def encode(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text", ranks: str | None = None) -> DataFrame:
    """keep columns, n_tokens long, ids binary (little-endian unsigned 32-bit integers)."""
    schema = T.StructType([docs.schema[k] for k in keep] + [T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(ranks)
        for whole in batches:
            for b in slices(whole, text):
                ids = [encode_text(x, enc) for x in strings(column(b, text))]
                n = np.array([len(x) for x in ids], np.int64)
                blob = packed(np.concatenate(ids) if ids else np.empty(0), np.concatenate([[0], np.cumsum(n)]), "<u4")
                yield pa.RecordBatch.from_arrays([*(column(b, k) for k in keep), pa.array(n), blob], [*keep, "n_tokens", "ids"])

    return docs.select(*keep, text).mapInArrow(run, schema)


def decode(tokens: DataFrame, keep: tuple[str, ...] = ("doc_id",), ids: str = "ids", ranks: str | None = None) -> DataFrame:
    """keep columns, decoded binary: the raw bytes of the ids, which need not be UTF-8 on their own. Null ids: no bytes."""
    schema = T.StructType([tokens.schema[k] for k in keep] + [T.StructField("decoded", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(ranks)
        for whole in batches:
            for b in slices(whole, ids, 8 << 20):
                data, off = raw(column(b, ids))
                values, off = np.frombuffer(data.tobytes(), "<u4"), off // 4
                out = [enc.decode_bytes(values[i:j].tolist()) for i, j in zip(off[:-1], off[1:])]
                yield pa.RecordBatch.from_arrays([*(column(b, k) for k in keep), pa.array(out, pa.binary())], [*keep, "decoded"])

    return tokens.select(*keep, ids).mapInArrow(run, schema)


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = encode(load(spark, sf_dir)).withColumn("ids_sha256", F.sha2("ids", 256))
    done = decode(ids, keep=("doc_id", "n_tokens", "ids_sha256"))
    return done.select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))
