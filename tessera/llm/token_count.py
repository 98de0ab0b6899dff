"""Token counts: batch encoding in an Arrow function that returns lengths only.

Batches hold about the same number of bytes. Long texts are cut before a single space between two characters that are neither spaces nor
line breaks; the part after it loses that space, since the model puts its own word mark before every text. No piece of the model
holds a word mark after another character, so no merge can cross such a place (checked once per process; a model with such pieces is
encoded without cuts).

Defined results. Null and empty text: 0 tokens, 0 bytes. Empty table: no rows. Repeated rows count each. Columns other than `keep` and
`text` are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tessera.llm.common import column, load, raw, slices, strings

MODEL = "piece_bpe_32k.model"
LIMIT = 4096
PART_CHARS = 1 << 14
BATCH_BYTES = 1 << 20
_SAFE = re.compile(r"(?<=[^\s▁])(?= [^\s▁])")


@lru_cache(4)
def model(path: str | None = None):
    """The processor, and whether texts may be cut."""
    import public_tokenizers as public
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path or public.path(MODEL))
    mark = "▁"
    safe = not any(mark in sp.id_to_piece(i).lstrip(mark) for i in range(sp.get_piece_size())) and sp.encode("a b") == sp.encode("a") + sp.encode("b")
    return sp, safe


def parts(text: str, size: int = PART_CHARS) -> list[str]:
    out, at = [], 0
    while len(text) - at > size:
        cut = _SAFE.search(text, at + size)
        if not cut:
            break
        out.append(text[at : cut.start()])
        at = cut.start() + 1
    out.append(text[at:])
    return out


def count_texts(texts: list[str], path: str | None = None, size: int = PART_CHARS) -> np.ndarray:
    sp, safe = model(path)
    pieces, of = [], []
    for i, x in enumerate(texts):
        found = parts(x, size) if safe else [x]
        pieces += found
        of += [i] * len(found)
    lengths = [len(x) for x in sp.encode(pieces, num_threads=1)] if pieces else []
    return np.bincount(np.array(of, np.int64), weights=lengths, minlength=len(texts)).astype(np.int64)


def count(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text", path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """keep columns, n_bytes long, n_tokens long, over_limit boolean."""
    schema = T.StructType([docs.schema[k] for k in keep] + [T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, text, BATCH_BYTES):
                n = count_texts(strings(column(b, text)), path)
                size = np.diff(raw(column(b, text))[1])
                yield pa.RecordBatch.from_arrays([*(column(b, k) for k in keep), pa.array(size), pa.array(n), pa.array(n > limit)], [*keep, "n_bytes", "n_tokens", "over_limit"])

    return docs.select(*keep, text).mapInArrow(run, schema)


def op10_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count(load(spark, sf_dir))
