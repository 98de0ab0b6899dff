import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

from llm_data import prose  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, ids string, node string, row string, n_tokens long, bucket int, gone long, digest string, _bucket int"


def edge_rows() -> list[tuple]:
    """Nulls, empty and very long texts, ties, repeated rows, copies, and columns whose names clash with those of the operators."""
    base, long = prose(1, 180), prose(2, 400)
    words = long.split(" ")
    words[200] = "changed"
    texts = [
        (11, base), (3, base), (7, base.replace(" ", "  ")), (20, long), (21, " ".join(words)), (30, None), (31, ""), (32, " \n\t "), (40, "one two three"), (41, "ONE  two three"),
        (40, "one two three"), (None, "a row without an identifier"), (None, None), (50, "x" * 150_000), (51, prose(3, 9000)), (60, "naïve café ΑΣ ﷺ \U0001f600 <|endoftext|> <s> ▁▁ don't 12345 é"), (61, "١٢٣ كتاب 你好世界 !!!"), (70, prose(4, 3)),
    ]
    return [(i, t, "en" if k % 3 else None, "src0", len(t or ""), 0.5, "x", "y", "z", 9, 1, 3, "d", 2) for k, (i, t) in enumerate(texts)]


@pytest.fixture(scope="session")
def edge(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def small(spark, sf):
    from tessera.llm.common import load

    return load(spark, sf)
