"""A library from upload to search and report."""

import json
from datetime import date, datetime

import pytest

from tessera.service import Library
from tessera.sources import collections as coll

LONG = "حدثنا زيد بن خالد، عن نافع، عن ابن عمر، قال سمعت رسول الله صلى الله عليه وسلم يقول من حفظ لسانه سلم قلبه وطاب يومه كله واستراح"


@pytest.fixture(scope="module")
def library(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("files")
    records = [
        {"id": "1", "text": LONG, "topic": "باب حفظ اللسان", "hukm": "صحيح"},
        {"id": "2", "text": "نص قصير عن الرفق بالناس كلهم", "topic": "باب الرفق", "sanad": [{"name": "النبي ﷺ"}, {"name": "أنس", "grade": "صحابي"}]},
    ]
    (folder / "sahih-bukhari.json").write_text(json.dumps(records), "utf-8")
    (folder / "notes.txt").write_text("A first passage about rivers and stones.\n\nA second passage about quiet houses and birds.", "utf-8")
    (folder / "empty.txt").write_text(" \n", "utf-8")
    (folder / "odd.bin").write_bytes(b"x")
    lib = Library(spark, str(tmp_path_factory.mktemp("library")))
    lib.result = {r.filename: (r.ok, r.chunks, r.error) for r in lib.add(coll.files(spark, str(folder))).collect()}
    lib.folder = folder
    return lib


def test_upload(library):
    assert library.result == {"sahih-bukhari.json": (True, 2, None), "notes.txt": (True, 2, None), "empty.txt": (False, 0, "nothing to index"), "odd.bin": (False, 0, "unsupported file")}
    assert library.read("items").count() == 5 and library.read("passages").count() == 4  # the long record has a vector of its matn too
    assert sorted(r.rowid for r in library.read("passages").collect()) == [0, 1, 2, 3]
    assert {r.filename: r.status for r in library.read("sources").collect()} == {"sahih-bukhari.json": "ready", "notes.txt": "ready", "empty.txt": "failed", "odd.bin": "failed"}
    assert {r.topic: r.n for r in library.topics().collect()} == {"باب حفظ اللسان": 2, "باب الرفق": 1}


def test_search(spark, library):
    q = spark.createDataFrame([("quote", "من حفظ لسانه سلم قلبه"), ("subject", "الرفق"), ("blank", " "), ("english", "quiet houses and birds")], "query_id string, query string")
    hits = library.search(q, 3).orderBy("query_id", "rank").collect()
    by = {}
    for h in hits:
        by.setdefault(h.query_id, []).append(h)
    assert set(by) == {"quote", "subject", "english"} and all([h.rank for h in x] == list(range(1, len(x) + 1)) for x in by.values())
    first = by["quote"][0]
    assert (first.text, first.similarity, first.word_overlap, first.source, first.hukm) == (LONG, 1.0, 1.0, "صحيح البخاري", "صحيح") and "البخاري" in first.compiler
    assert len({h.text for h in by["quote"]}) == len(by["quote"])
    assert by["subject"][0].topic == "باب الرفق" and by["english"][0].similarity == 1.0 and by["english"][0].kind == "document"
    titles = library.search(q.filter("query_id = 'subject'"), 2, by_title=True).orderBy("rank").collect()
    assert titles[0].topic == "باب الرفق"
    trees = {}
    for e in library.trees(library.search(q.filter("query_id = 'subject'"), 3)).orderBy("id", "node_id").collect():
        trees.setdefault((e.id, e.extracted), []).append(e.name)
    assert ["النبي ﷺ", "أنس", "البخاري"] in trees.values()
    with pytest.raises(ValueError):
        library.search(q, 21)


def test_second_upload_replaces_and_delete_removes(spark, library, tmp_path):
    (tmp_path / "notes.txt").write_text("Only one passage about rivers now.", "utf-8")
    library.add(coll.files(spark, str(tmp_path)))
    assert library.read("passages").filter("source = 'notes.txt'").count() == 1 and library.read("passages").count() == 3
    (tmp_path / "notes.txt").write_text(" \n", "utf-8")
    library.add(coll.files(spark, str(tmp_path)))
    assert library.read("passages").filter("source = 'notes.txt'").count() == 1  # a failed upload keeps the previous one
    assert {r.status for r in library.read("sources").filter("filename = 'notes.txt'").collect()} == {"ready"}
    library.recover()
    library.compact()
    library.delete("notes.txt")
    assert library.read("items").filter("source = 'notes.txt'").count() == 0 and library.read("sources").filter("filename = 'notes.txt'").count() == 0


def test_another_model_and_too_little_room_are_refused(spark, library, tmp_path, monkeypatch):
    (tmp_path / "more.txt").write_text("A passage about something else entirely.", "utf-8")
    files, before = coll.files(spark, str(tmp_path)), library.catalog.current()
    for other in (Library(spark, library.path, model="other"), Library(spark, library.path, dim=32)):
        with pytest.raises(ValueError):
            other.add(files)
        with pytest.raises(ValueError):
            other.search(spark.createDataFrame([("a", "rivers and stones")], "query_id string, query string"), 2)
    monkeypatch.setattr(library.catalog, "free_bytes", lambda: 100)
    with pytest.raises(ValueError, match="free"):
        library.add(files)
    assert library.catalog.current() == before


def test_events_and_report(spark, library):
    rows = [("visit", "v", None, None, None, datetime(2024, 1, 1, 22)), ("search", "v", "q", "found", 120, datetime(2024, 1, 2, 1)), ("bad", "v", None, None, None, datetime(2024, 1, 2))]
    library.record(spark.createDataFrame(rows, "type string, visitor_id string, query string, result string, latency_ms int, created_at timestamp"))
    r = library.report(date(2024, 1, 2), date(2024, 1, 3))
    assert tuple(r["totals"].first()) == (1, 1, 0, 1, 120) and r["daily"].count() == 2 and r["searches"].first().query == "q" and r["outcomes"].first().label == "موجود بلا حكم"
    assert r["sources"].first().files >= 1
