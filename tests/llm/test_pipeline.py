"""The pipeline against a plain version of each stage, stage by stage on the same input."""

import re

import corpus_pipeline
from llm_data import prose
from test_dedup import brute_groups
from test_tokens import check_pieces

import __spark_entry__ as entry
from tessera.llm import pii, quality
from tessera.llm.common import load


def test_stages_equal_plain_versions(spark, sf, tmp_path):
    docs, stages = load(spark, sf), dict(corpus_pipeline.STAGES)
    columns, labels = docs.columns, load(spark, sf, "labels")
    rows, done = docs.collect(), {}
    for k, (name, fn) in enumerate(corpus_pipeline.STAGES):
        out = fn(spark, docs, sf)
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        done[name] = docs.collect()
        assert name == "packing" or docs.columns == columns
    table = quality.features(load(spark, sf))
    scores = {r.doc_id: r.score for r in quality.score(table, quality.fit(table, labels)).collect()}
    good = [r for r in rows if scores[r.doc_id] >= 0.3]
    assert sorted(done["quality"]) == sorted(good) and len(stages) == 5
    seen, first = {}, []
    for r in sorted(good, key=lambda r: r.doc_id):
        if seen.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r.text or ""), r.doc_id) == r.doc_id:
            first.append(r)
    assert sorted(done["exact dedup"]) == sorted(first)
    kept = brute_groups({r.doc_id: r.text for r in first})
    near = [r for r in first if kept[r.doc_id][2]]
    assert sorted(done["near dedup"]) == sorted(near)
    assert sorted((r.doc_id, r.text, r.n_chars) for r in done["personal data"]) == sorted((r.doc_id, x := pii.replace_text(r.text, pii.TEST_KEY)[0], len(x)) for r in near)
    check_pieces(done["personal data"], done["packing"])
    whole = entry.queries()["pipeline"](spark, sf).collect()
    assert sorted(whole) == sorted(done["packing"])


def test_stages_take_edge_rows_and_empty_tables(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, prose(1, 50), "en", "a", 1), (1, prose(1, 50), "en", "a", 1), (2, None, None, None, None), (None, "x", "en", "a", 1), (3, "", "en", "a", 0), (None, None, None, None, None)]
    spark.createDataFrame([(1, 1, 0), (2, None, None)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for name, some in (("a", rows), ("b", [])):
        docs = spark.createDataFrame(some, schema)
        for _, fn in corpus_pipeline.STAGES:
            out = fn(spark, docs, str(tmp_path))
            docs = spark.createDataFrame(out.collect(), out.schema)
        assert (docs.count() > 0) == bool(some)


def test_stages_keep_extra_columns_and_long_texts(spark, edge, tmp_path):
    """The rows of the edge fixture (nulls, copies, a text of 150,000 characters, columns with clashing names) through all stages."""
    spark.createDataFrame([(11, 1), (3, 1), (20, 1), (40, 0)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = edge
    for k, (_, fn) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = fn(spark, docs, str(tmp_path))
        assert out.columns == edge.columns
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
    kept = docs.collect()
    assert len({r.doc_id for r in kept}) <= len(kept) <= edge.count() and any(len(r.text or "") == 150_000 for r in kept)
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
    assert pieces.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
