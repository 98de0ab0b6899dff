"""Every query against its SQL on the smallest tables; those without SQL must give the same rows twice."""

import os

import duckdb
import pytest
from compare import difference, spark_rows

import __spark_entry__ as entry
from tessera.plans import arabic, files, lifecycle, queries, streams

CORE = {**queries.QUERIES, **arabic.QUERIES, **files.QUERIES, **lifecycle.QUERIES, **streams.QUERIES}


@pytest.mark.parametrize("name", sorted(set(CORE) & set(entry.oracle_sql())))
def test_query_equals_sql(spark, sf, name):
    assert difference(CORE[name](spark, sf), sf, entry.oracle_sql()[name]) is None


@pytest.mark.parametrize("name", sorted(set(CORE) - set(entry.oracle_sql())))
def test_query_without_sql_is_stable(spark, sf, name):
    a, b = (spark_rows(CORE[name](spark, sf)) for _ in range(2))
    assert a == b and a[1]


def test_entry_has_rows_and_every_sql_has_a_query(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_fixed_rows_tell_each_rule(spark):
    """The Arabic rows are of both kinds under every test, and each step of a text rule changes some of them."""
    flags = arabic.arabic_quality(spark, "").collect()
    assert all({r[k] for r in flags} == {True, False} for k in ("meaningful", "garbled", "broken", "usable", "arabic"))
    assert {r.kept for r in arabic.arabic_titles(spark, "").collect()} == {True, False}
    layers = arabic.arabic_layers(spark, "").collect()
    assert any(r.chosen != r.seen for r in layers)
    words, cleaned = arabic.arabic_words(spark, "").collect(), arabic.arabic_clean(spark, "").collect()
    assert any(r.normal != r.indexed for r in words) and any(r.indexed != r.body for r in words) and any(r.cleaned != r.tidied for r in cleaned) and {r.blank for r in cleaned} == {True, False}
    assert {r.query_id for r in arabic.arabic_quotes(spark, "").select("query_id").distinct().collect()} == {1, 4, 6, 8, 10}
    shares = arabic.arabic_subjects(spark, "").collect()
    assert {r.subject for r in shares} == {True, False} and any(r.with_title > r.share for r in shares) and {0.0, 0.5, 1.0} <= {r.share for r in shares}


@pytest.mark.parametrize("name", ["branches_merged", "hybrid_rank"])
def test_ranking_keeps_blank_texts_as_sql_does(spark, sf, tmp_path, name):
    """Documents with blank, empty or no text, without a source, a language, a length or an id."""
    for t in os.listdir(sf):
        if t != "documents.parquet":
            (tmp_path / t).symlink_to(f"{sf}/{t}")
    odd = """case when doc_id % 7 = 1 then null when doc_id % 7 = 2 then '' when doc_id % 7 = 3 then E' \\n\\t' else text end as text"""
    few = """case when doc_id % 11 = 1 then null else lang end as lang, case when doc_id % 5 = 1 then null else source end as source,
        case when doc_id % 7 = 1 and doc_id % 2 = 1 then null when doc_id % 7 = 1 then 0 else length(text) end as n_chars"""
    duckdb.sql(f"copy (select case when doc_id = 150 then null else doc_id end as doc_id, text, lang, source, n_chars from (select doc_id, {odd}, {few} from '{sf}/documents.parquet')) to '{tmp_path}/documents.parquet' (format parquet)")
    assert difference(CORE[name](spark, str(tmp_path)), str(tmp_path), entry.oracle_sql()[name]) is None
