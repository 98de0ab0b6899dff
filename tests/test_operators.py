"""Chains, collections, editions, registry, sequences, vectors, images, documents, writers and streams on small cases."""

import io
import zipfile
from datetime import date, datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import passwords
from tessera.operators import chains, images, ranking, registry, reports, sequence, vectors
from tessera.sources import collections as coll
from tessera.sources import documents, editions, writers
from tessera.streaming import events as st

# Our own chains, in the forms that narrations have.
CASES = [
    ("حدثنا زيد بن خالد، قال حدثنا عمرو، عن نافع، عن ابن عمر، قال سمعت رسول الله صلى الله عليه وسلم يقول كلام", [["زيد بن خالد", "عمرو", "نافع", "ابن عمر"]], True),
    ("حدثنا هناد، حدثنا وكيع، عن سماك، ح وحدثنا مسدد، حدثنا أبو عوانة، عن سماك بن حرب، عن أنس، عن النبي صلى الله عليه وسلم قال", [["هناد", "وكيع", "سماك"], ["مسدد", "أبو عوانة", "سماك بن حرب", "أنس"]], True),
    ("حدثنا صالح، حدثنا عبد العزيز، - يعني ابن محمد - عن هشام، عن أبيه، عن عائشة، أن النبي صلى الله عليه وسلم قال", [["صالح", "عبد العزيز (ابن محمد)", "هشام", "والد هشام", "عائشة"]], True),
    ("حدثنا صالح، عن عمر بن حفص، وهو يخطب الناس فقال سمعت رسول الله صلى الله عليه وسلم", [["صالح", "عمر بن حفص"]], True),
    ("حدثنا عمرو الناقد، وحسن الحلواني، عن كريب مولى ابن عباس، عن وكيع، أن رسول الله صلى الله عليه وسلم", [["عمرو الناقد وحسن الحلواني", "كريب مولى ابن عباس", "وكيع"]], True),
    ("نص بلا سند", [["نص"]], False),  # one name is no chain: see test_trees
    ("", [], False),
]


@pytest.mark.parametrize(("text", "want", "reaches"), CASES)
def test_chains(text, want, reaches):
    assert chains.chains_of(text) == (want, reaches)


def test_trees():
    paths = lambda t, a="": chains.tree_of_text(t, a).paths()
    assert paths(CASES[0][0], "البخاري") == ["النبي ﷺ > ابن عمر > نافع > عمرو > زيد بن خالد > البخاري"]
    assert sorted(paths(CASES[1][0], "الترمذي")) == ["النبي ﷺ > أنس > سماك بن حرب > أبو عوانة > مسدد > الترمذي", "النبي ﷺ > أنس > سماك بن حرب > وكيع > هناد > الترمذي"]
    assert paths("حدثني يحيى، عن مالك، عن نافع، أن عبد الله بن عمر كان يقول", "مالك") == ["عبد الله بن عمر > نافع > مالك > يحيى"]
    assert all(chains.tree_of_text(t) is None for t in ("", "حدثنا مسدد", "كلام", "نص بلا سند"))
    assert chains.tree_of_list([("عمر", None), ("الإمام البخاري", "x")], "البخاري").paths() == ["عمر > الإمام البخاري"]
    key = chains.key_of
    assert key("الليث") == key("ليث") and key("سماك") != key("سماك بن حرب") and chains.alike("سماك", "سماك بن حرب") and not chains.alike("محمد", "محمد بن علي") and not chains.alike("سما", "سماك")


def test_given_chain_wins_over_wording(spark):
    rows = spark.createDataFrame([(1, CASES[0][0], [("النبي ﷺ", "المصدر"), ("أبو هريرة", "صحابي")], "صحيح مسلم"), (2, CASES[0][0], [], ""), (3, "كلام", None, "")], "id int, text string, sanad array<struct<name:string,grade:string>>, source string")
    got = {}
    for r in chains.trees(rows).orderBy("id", "node_id").collect():
        got.setdefault((r.id, r.extracted), []).append(r.name)
    assert got[1, False] == ["النبي ﷺ", "أبو هريرة", "مسلم"] and got[2, True][0] == "النبي ﷺ" and all(k[0] != 3 for k in got)


def test_collections_decode_and_roles(spark, tmp_path):
    assert coll.decode_document("نص".encode("utf-8-sig")) == "نص" == coll.decode_document("نص".encode("utf-16")) == coll.decode_document("نص".encode("cp1256"))
    assert coll.decode_collection("نص".encode("cp1256")) == "نص"
    (tmp_path / "a.txt").write_bytes("نص".encode("cp1256"))
    (tmp_path / "b.bin").write_bytes(b"x")
    f = coll.files(spark, str(tmp_path)).withColumn("kind", coll.kind("path"))
    assert sorted((r.kind or "") for r in f.collect()) == ["", "text"]
    assert [r.text for r in documents.blocks(coll.files(spark, str(tmp_path), "*.txt")).collect()] == ["نص"]
    rows = coll.csv_records(spark.createDataFrame([("a.csv", "1,نص طويل بما يكفي هنا\n2,نص آخر طويل بما يكفي"), ("b.csv", "عنوان\nنص طويل بما يكفي ليكون حديثا كاملا\nنص ثان طويل بما يكفي ليكون كاملا"), ("c.csv", "")], "file string, text string"))
    assert sorted((r.file, r.id, r.title) for r in rows.collect()) == [("a.csv", "1", ""), ("a.csv", "2", ""), ("b.csv", "1", "عنوان"), ("b.csv", "2", "عنوان")]


def test_docx(spark, tmp_path):
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    p = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    xml = f'<w:document xmlns:w="{w}"><w:body>{p("first")}{p(" ")}<w:tbl><w:tr><w:tc>{p("a")}</w:tc><w:tc>{p("b")}</w:tc></w:tr></w:tbl>{p("last")}</w:body></w:document>'
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("word/document.xml", xml)
    assert documents.docx_blocks(buffer.getvalue()) == ["first", "last", "a | b"]
    (tmp_path / "bad.docx").write_bytes(b"no zip")
    assert documents.blocks(coll.files(spark, str(tmp_path))).first().error.startswith("BadZipFile")


def test_edition_pieces(spark):
    row = lambda **kw: spark.createDataFrame([tuple(kw.values())], list(kw))
    assert row(t="<b>نص</b> (١) ⦗٣⦘ آخر ﵀").select(editions.plain("t")).first()[0] == "نص آخر رحمه الله"
    assert row(t="قَالَ ____ تم الكتاب").select(editions.without_colophon("t")).first()[0] == "قَالَ "
    assert row(t="نص ____ قَالَ").select(editions.without_colophon("t")).first()[0] == "نص ____ قَالَ"
    assert row(f="(١) أول (٢) ثان (١) أخير").select(editions.footnotes("f")).first()[0] == {"٢": "ثان", "١": "أخير"}
    assert tuple(row(b="نص (١).\n\n(١) حاشية", f=" ").select(editions.notes_apart("b", "f").alias("x")).first().x) == ("نص (١).", "(١) حاشية")
    assert row(m='{"shorts": {"s0": "حكم"}}').select(editions.shorts("m")).first()[0] == {"s0": "حكم"}
    assert row(m="bad").select(editions.shorts("m")).first()[0] == {}
    link = lambda n: f'<a href="inr://man-1">{n}</a>'
    text = f"{link('قتيبة')}، و{link('زيد')} عن {link('هشام')} عن {link('أبيه')} <hadeeth-1>نص"
    assert row(t=text).select(editions.linked_chain("t")).first()[0] == ["قتيبة وزيد", "هشام", "والد هشام"]
    assert row(t=f"{link('زيد')} ح {link('عمرو')}").select(editions.linked_chain("t")).first()[0] == []


BOOK = [
    (1, "1", "<span data-type='title'>كتاب العلم</span>\n١ - حدثنا زيد عن عمرو (١)", "(١) إسناده صحيح"),
    (2, "1", "تتمة النص (١).\nباب الرفق\n٢ - حدثني خالد (٢)", "(١) حاشية الصفحة الثانية (٢) ضعيف\n<s0> صحيح"),
    (5, "2", "مقدمة المجلد\n<span data-type='title'>كتاب الصوم</span>\n٣ - ٤ - (٥) عن أنس ____ تم الكتاب", "<s0> حسن :\n<s1> غيره"),
]


def test_segments_over_pages(spark):
    """Narrations that go on over pages, topics, volumes, and notes from the page of their mark."""
    pages = spark.createDataFrame([(7, *x) for x in BOOK], "book_id long, page long, part string, body string, foot string")
    cut = editions.segments(pages)
    got = [(r.pos, r.numbers, " ".join(r.raw.split()), r.topic, r.first_page, r.last_page, r.notes) for r in cut.orderBy("pos").collect()]
    assert got == [
        (0, [1], "حدثنا زيد عن عمرو (١) تتمة النص (١).", "كتاب العلم", 0, 1, ["إسناده صحيح", "حاشية الصفحة الثانية"]),
        (1, [2], "حدثني خالد (٢)", "باب الرفق", 1, 1, ["ضعيف\n<s0> صحيح"]),
        (2, [3, 4, 5], "عن أنس", "كتاب الصوم", 2, 2, []),
    ]
    codes = spark.createDataFrame([(7, {"0": "[حكم الألباني] :", "1": "غيره"})], "book_id long, shorts map<string,string>")
    rules = editions.noted_rulings(pages, codes)
    assert sorted((r.page, r.hukm, r.mohaddith) for r in rules.collect()) == [(1, "صحيح", "الألباني"), (2, "حسن", "الألباني")]
    assert sorted((r.pos, r.hukm) for r in editions.coded_rulings(cut, rules).collect()) == [(0, "صحيح"), (2, "حسن")]  # the narration before takes it first: its pages hold it too
    assert editions.segments(pages.limit(0)).count() == 0


def test_front_matter_and_numbers(spark):
    line = lambda i, t: f"{str(i).translate(str.maketrans('0123456789', '٠١٢٣٤٥٦٧٨٩'))} - {t}"
    page = "\n".join([line(1, "نقطة"), line(2, "نقطة"), *(line(i, "حدثنا زيد عن عمرو") for i in range(1, 60))])
    got = editions.segments(spark.createDataFrame([(1, 1, "1", page, "")], "book_id long, page long, part string, body string, foot string")).orderBy("pos").collect()
    assert [g.numbers for g in got] == [[i] for i in range(1, 60)] and got[0].raw.strip() == "حدثنا زيد عن عمرو" and got[0].pos == 0


def test_coded_rulings(spark):
    n = spark.createDataFrame([(1, 0, 0, 0), (1, 1, 1, 2), (1, 2, 2, 3)], "book_id long, pos int, first_page int, last_page int")
    rules = lambda *rows: spark.createDataFrame([(1, p, k, h, "x") for p, k, h in rows], "book_id long, page int, n int, hukm string, mohaddith string")
    got = lambda r: sorted((x.pos, x.hukm) for x in editions.coded_rulings(n, r).collect())
    assert got(rules((0, 0, "صحيح"), (2, 0, "حسن"), (3, 0, "ضعيف"))) == [(0, "صحيح"), (1, "حسن"), (2, "ضعيف")]
    assert got(rules((0, 0, "أ"), (0, 1, "ب"), (1, 0, "ج"))) == [(0, "أ"), (1, "ج")]
    assert got(rules((3, 0, "أ"), (3, 1, "ب"))) == [(2, "أ")] and got(rules((9, 0, "أ"))) == []


def test_versions_survive_a_failed_write(spark, tmp_path):
    v = registry.Versions(spark, str(tmp_path / "t"))
    assert v.read() is None and v.compact() is None
    v.publish(spark.range(3))
    with pytest.raises(Exception):
        v.publish(spark.range(1).select(F.raise_error(F.lit("no")).alias("id")))
    assert v.read().count() == 3
    v.publish(spark.range(5))
    assert v.read().count() == 5 and v.compact() and v.read().count() == 5
    (tmp_path / "x.tmp").write_text("x")
    assert writers.removed(spark, str(tmp_path), "x*") == 1


def test_tables_are_published_at_once(spark, tmp_path):
    """Readers during and after a publish, a failure between tables, an old version read afterwards, and two at the same time."""
    c = registry.Catalog(spark, str(tmp_path / "c"))
    c.publish({"a": spark.range(1), "b": spark.range(10)})
    old = c.read("a"), c.read("b")
    seen = []

    class Watching(registry.Catalog):
        def _commit(self, number, manifest):
            seen.append((c.read("a").count(), c.read("b").count()))  # both tables are written, neither is current
            super()._commit(number, manifest)
            seen.append((c.read("a").count(), c.read("b").count()))

    Watching(spark, c.path).publish({"a": spark.range(2), "b": spark.range(20)})
    assert seen == [(1, 10), (2, 20)] and (old[0].count(), old[1].count()) == (1, 10)
    before = c.current()
    with pytest.raises(Exception):
        c.publish({"a": spark.range(3), "b": spark.range(1).select(F.raise_error(F.lit("no")).alias("id"))})
    assert c.current() == before and len(list((tmp_path / "c" / "a").iterdir())) == 2 and len(list((tmp_path / "c" / "b").iterdir())) == 2

    class Late(registry.Catalog):
        def _commit(self, number, manifest):
            c.publish({"a": spark.range(4)})
            super()._commit(number, manifest)

    with pytest.raises(registry.Conflict):
        Late(spark, c.path).publish({"a": spark.range(5)})
    assert c.read("a").count() == 4 and c.read("b").count() == 20
    assert c.vacuum(0) == 3 and old[1].schema == c.read("b").schema and c.read("b").count() == 20 and len(list((tmp_path / "c" / "a").iterdir())) == 1
    assert c.free_bytes() > 0


def test_accounts_and_passwords(spark):
    none = spark.createDataFrame([], "id long, username string, must_change_password boolean")
    first = registry.bootstrapped(none, spark.createDataFrame([(1, "a")], "id long, username string"))
    assert [tuple(r) for r in first.collect()] == [(1, "a", True)]
    assert registry.bootstrapped(first, spark.createDataFrame([(2, "b")], "id long, username string")).count() == 1
    h = passwords.hashed("secret words")
    assert passwords.matches("secret words", h) and not passwords.matches("other", h) and not passwords.matches(None, h) and not passwords.matches("x", "md5$1") and h != passwords.hashed("secret words")
    assert len({passwords.new_token() for _ in range(9)}) == 9


def test_provider(spark):
    """Refusals, a short reply, order over batches, and a bound on what runs at once."""
    import threading
    import time as clock

    running, most, calls, lock = [0], [0], [], threading.Lock()

    def send(texts):
        with lock:
            running[0] += 1
            most[0] = max(most[0], running[0])
            calls.append(texts)
            turn = len(calls)
        clock.sleep(0.01)
        with lock:
            running[0] -= 1
        if turn in (2, 5):
            raise vectors.Refused(0.01)
        return {"data": [{"index": i, "embedding": [float(t), 1.0]} for i, t in reversed(list(enumerate(texts)))]}

    embedder = vectors.provider(send, 2, batch=3, at_once=4, sleep=lambda _: None)()
    got = embedder([str(i) for i in range(20)])
    want = np.array([[i, 1.0] for i in range(20)])
    assert np.allclose(got, want / np.linalg.norm(want, axis=1, keepdims=True)) and most[0] <= 4 and len(calls) == 9
    assert embedder([]).shape == (0, 2)
    with pytest.raises(vectors.Refused):
        vectors.provider(lambda t: (_ for _ in ()).throw(vectors.Refused()), 2, attempts=2, sleep=lambda _: None)()(["x"])
    with pytest.raises(ValueError):
        vectors.provider(lambda t: {"data": []}, 2)()(["x"])


def test_nearest_over_cells(spark):
    r = np.random.default_rng(3)
    x = r.normal(size=(300, 8)).round(1)
    x[200:] = x[:100]  # ties
    v = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "id long, vec array<float>").repartition(5)
    q = v.filter("id % 7 = 0").select(F.col("id").alias("query_id"), "vec")
    x = x.astype(np.float32).astype(float)
    for block, slots, parts in ((1024, 64, 3), (5, 4, 2)):
        got = {}
        for row in vectors.nearest(q, v, 6, block=block, slots=slots, parts=parts).orderBy("query_id", "pos").collect():
            got.setdefault(row.query_id, []).append(row.id)
        for i in range(0, 300, 7):
            s = np.maximum(0, x @ x[i])
            assert got[i] == np.lexsort((np.arange(300), -s))[:6].tolist()
    plan = vectors.nearest(q, v, 6)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastNestedLoop" not in plan and "Cartesian" not in plan


def test_accounts(spark):
    admins = spark.createDataFrame([(1, "a"), (2, "b")], "id long, username string")
    sessions = spark.createDataFrame([("x", 1), ("y", 1), ("z", 2)], "token_hash string, admin_id long")
    a, s = registry.delete_account(admins, sessions, 1)
    assert a.count() == 1 and s.count() == 1
    assert sorted(r[0] for r in registry.end_sessions(sessions, 1, keep="y").collect()) == ["y", "z"] and registry.end_sessions(sessions, 1).count() == 1
    with pytest.raises(ValueError):
        registry.insert_unique(admins, spark.createDataFrame([(3, "A")], "id long, username string"), F.lower("username"), "the name")
    assert registry.with_missing_columns(admins, {"status": F.lit("ready"), "id": F.lit(0)}).columns == ["id", "username", "status"]
    src = spark.createDataFrame([("f", "processing")], "filename string, status string")
    with pytest.raises(ValueError):
        registry.delete_source({}, src, "f")


def test_limiter_refusals_do_not_count(spark):
    t = [datetime(2024, 1, 1, 0, 0, s) for s in (0, 1, 2, 3, 11, 12)]
    df = spark.createDataFrame([("k", x) for x in t] + [("n", t[0])], "k string, ts timestamp_ntz")
    got = [r.accepted for r in sequence.limited(df, "k", "ts", 2, 10).filter("k = 'k'").orderBy("ts").collect()]
    assert got == [True, True, False, False, True, True]


def test_stream_equals_fold(spark, tmp_path):
    t = [datetime(2024, 1, 1, 0, 0, s) for s in (0, 1, 2, 3, 11, 12)]
    df = spark.createDataFrame([("k", x) for x in t], "k string, ts timestamp")
    df.write.parquet(str(tmp_path / "in"))
    s = st.limited(st.read(spark, str(tmp_path / "in"), df.schema), "k", "ts", 2, 10, "1 hour")
    st.run_to_end(s, str(tmp_path / "out"), str(tmp_path / "state"))
    assert [r.accepted for r in spark.read.parquet(str(tmp_path / "out")).orderBy("ts").collect()] == [True, True, False, False, True, True]
    st.run_to_end(st.limited(st.read(spark, str(tmp_path / "in"), df.schema), "k", "ts", 2, 10, "1 hour"), str(tmp_path / "out"), str(tmp_path / "state"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 6


def test_reports_bounds(spark):
    assert reports.default_range(date(2024, 3, 1)) == (date(2024, 2, 1), date(2024, 3, 1))
    rows = [("visit", "v", None, None, None, datetime(2024, 1, 1, 22, 30)), ("search", "v", "q", "found", 100, datetime(2024, 1, 2, 10)), ("visit", "w", None, None, None, datetime(2024, 1, 4))]
    df = spark.createDataFrame(rows, "type string, visitor_hash string, query string, result string, latency_ms int, created_at timestamp_ntz")
    two = reports.in_range(df, date(2024, 1, 2), date(2024, 1, 3))
    assert tuple(reports.totals(two).first()) == (1, 1, 0, 1, 100)
    days = reports.calendar(reports.daily(two), date(2024, 1, 2), date(2024, 1, 3)).orderBy("day").collect()
    assert [(r.visits, r.searches) for r in days] == [(1, 1), (0, 0)]
    assert tuple(reports.totals(two.limit(0)).first()) == (0, 0, 0, 0, None)
    for a, b in ((date(2024, 2, 1), date(2024, 1, 1)), (date(2023, 1, 1), date(2024, 1, 2))):
        with pytest.raises(ValueError):
            reports.in_range(df, a, b)


def test_report_filter_reaches_the_scan(spark, sf):
    from tessera.plans.queries import _ranged

    plan = _ranged(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts" in plan and "LessThan(ts" in plan


def test_vectors(spark):
    v = spark.createDataFrame([(i, np.eye(4)[i % 4].tolist()) for i in range(8)], "id long, vec array<float>")
    q = v.filter("id = 1").select(F.col("id").alias("query_id"), "vec")
    assert [(r.id, r.similarity) for r in vectors.nearest(q, v, 3).orderBy("pos").collect()] == [(1, 1.0), (5, 1.0), (0, 0.0)]
    assert vectors.nearest(q.limit(0), v, 3).count() == 0
    with pytest.raises(Exception):
        vectors.checked(v, 5).collect()
    with pytest.raises(ValueError):
        vectors.same_model(vectors.with_model(v, "a", 4), "b", 4)
    vectors.same_model(vectors.with_model(v.limit(0), "a", 4), "b", 4)
    e = vectors.bag_of_characters()(["abc", "abc", ""])
    assert np.allclose(e[0] @ e[1], 1) and not e[2].any()
    import base64

    reply = {"data": [{"index": 1, "embedding": [0.0, 2.0]}, {"index": 0, "embedding": base64.b64encode(np.array([3, 0], "<f4").tobytes()).decode()}]}
    assert vectors.parsed_reply(reply, 2, 2).tolist() == [[1, 0], [0, 1]]
    with pytest.raises(ValueError):
        vectors.parsed_reply(reply, 3, 2)
    t = vectors.Throttle(8)
    t.refused()
    assert t.allowed == 4
    for _ in range(8):
        t.succeeded()
    assert t.allowed == 5
    waits, calls = [], []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise OSError
        return 1

    assert vectors.with_retries(flaky, sleep=waits.append) == 1 and waits == [1.0, 2.0]
    assert ranking.pool(5, True) == 60 and ranking.pool(50, False) == 150 and ranking.pool(5, True, True) == 100


def test_images():
    page = np.full((400, 300), 255, np.uint8)
    for y in range(60, 380, 8):
        page[y : y + 3, 20:135] = 0
        page[y : y + 3, 165:280] = 0
    page[30:32, 10:290] = 0
    right, left = images.regions(page)
    assert right.shape[1] + left.shape[1] == 300 and images.ink_share(right) > 0.1
    assert abs(images.skew(images.rotated(page, 2.0)) + 2.0) <= 0.5
    assert images.read_page(np.full((50, 50), 255, np.uint8), []).text == ""
    read = images.read_page(page, [lambda r: ("نص واحد", 0.1), lambda r: ("نص واحد", 0.1)])
    assert read.text == "نص واحد\n\nنص واحد" and not read.disputed
    assert images.prepared(page).max() == 255


def test_writers(spark, tmp_path):
    raw = spark.createDataFrame([("visit", "v", "", None, 5, datetime(2024, 1, 1)), ("other", "v", "q", None, 5, datetime(2024, 1, 1)), ("chat", "x" * 201, "q", None, 5, datetime(2024, 1, 1)), ("search", None, "q", "r", -1, datetime(2024, 1, 1))], "type string, visitor_id string, query string, result string, latency_ms int, created_at timestamp")
    e = writers.prepared_events(raw, "s")
    assert [r.ok for r in e.collect()] == [True, False, False, False] and e.first().query is None and len(e.first().visitor_hash) == 32
    writers.append_events(e, str(tmp_path / "ev"))
    assert spark.read.parquet(str(tmp_path / "ev")).count() == 1 and spark.read.parquet(str(tmp_path / "ev_refused")).count() == 3
    writers.sheets({"a": spark.createDataFrame([("=1", 2)], "x string, y int")}, str(tmp_path / "s"))
    assert spark.read.option("header", True).csv(str(tmp_path / "s/a")).first().x == "'=1"
    writers.text_lines(spark.createDataFrame([("نص",)], "text string"), str(tmp_path / "t"))
    writers.records_json(spark.createDataFrame([("نص",)], "text string"), str(tmp_path / "j"))
    assert spark.read.text(str(tmp_path / "t")).first()[0] == "نص" and spark.read.json(str(tmp_path / "j")).first().text == "نص"
    assert writers.emptied(raw).count() == 0


def test_ordered_operators_on_empty_and_null(spark):
    empty = spark.createDataFrame([], "id string, n int")
    assert sequence.keep_first(empty, ["id"], ["n"]).count() == 0 and sequence.runs(empty, ["id"], ["n"], "n").count() == 0
    some = spark.createDataFrame([(None, 1), (None, 2), ("a", 1)], "id string, n int")
    assert sorted(str(r.unique_id) for r in sequence.suffixed(some, "id", ["n"]).collect()) == ["None", "None", "a"]
