"""Text rules on small cases: cleaning, folding, quality, passages, subjects, readings."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.functions import scalars as sc
from tessera.functions import text as tx
from tessera.operators import passages, quotes, readings, subjects


def one(spark, expr, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(expr.alias("x")).first().x


@pytest.mark.parametrize(("raw", "want"), [
    ("قَالَ   رسولُ\tالله", "قال رسول الله"), ("كتـــاب", "كتاب"), ("a\r\nb\rc", "a\nb\nc"), ("a\n\n\n\nb", "a\n\nb"), ("‏نص‎ ", "نص"),
    ("  x  \n  y  z ", "x\ny z"), ("ﷺ", "صلى الله عليه وسلم"), ("", ""),
])
def test_clean(spark, raw, want):
    assert one(spark, tx.clean("t"), t=raw) == want


def test_clean_keeps_null_and_diacritics_on_request(spark):
    df = spark.createDataFrame([(None,), ("قَالَ",)], "t string")
    assert [r[0] for r in df.select(tx.clean("t", strip_diacritics=False)).collect()] == [None, "قَالَ"]


def test_normalize_and_index_form(spark):
    assert one(spark, tx.normalize("t"), t="إنّما الأعمالُ، بالنيّة!") == "انما الاعمال بالنيه"
    assert one(spark, tx.index_form("t"), t="ومن غشنا فليس منا") == "من غشنا ليس منا"
    assert one(spark, tx.index_form("t"), t="وو فا") == "وو فا"


@pytest.mark.parametrize(("q", "t", "want"), [("الصلاة والصوم", "الصلاة والصوم خير", 1.0), ("كتاب قلم دار", "قلم في دار", 0.6667), ("من في عن", "من", 0.0), ("", "x", 0.0), ("aa aa bb", "aa", 0.6667)])
def test_word_overlap(spark, q, t, want):
    assert one(spark, tx.word_overlap("q", "t"), q=q, t=t) == want


def test_quality(spark):
    good = "هذا نص عربي سليم فيه كلمات كافية للفهم"
    mixed = "هذا BE نص gall عربي INKS فيه abc كلمات xyz كثيرة"
    split = " ".join("ا ل ح د ي ث ن ب و ي ش ر ي ف م ن ك ت ب س ن ن".split())
    assert one(spark, tx.meaningful("t"), t=good) and not one(spark, tx.meaningful("t"), t="كلمة")
    assert one(spark, tx.looks_garbled("t"), t=mixed) and not one(spark, tx.looks_garbled("t"), t="plain english text only here")
    assert one(spark, tx.looks_broken("t"), t=split) and not one(spark, tx.looks_broken("t"), t=good)
    assert not one(spark, tx.usable_layer("t"), t="قصير")
    assert one(spark, tx.choose_layer("o", "l"), o=" ", l="layer") == "layer"


def test_passages_are_bounded_overlap_and_lose_no_word():
    text = " ".join(f"Sentence number {i} ends here." for i in range(60))
    got = passages.cut(text, 200, 40)
    assert len(got) > 5 and all(len(x) <= 200 for x in got)
    assert all(w in " ".join(got) for w in text.split())
    assert any(set(a.split()[-3:]) & set(b.split()[:6]) for a, b in zip(got, got[1:]))
    words = [f"w{i}" for i in range(200)]
    assert " ".join(passages.cut(" ".join(words), 100, 0)).split() == words
    assert passages.cut("x" * 950, 400, 0) == ["x" * 400, "x" * 400, "x" * 150]
    assert passages.cut("a b\nc\n\n  \n\nd e", 400) == ["a b c", "d e"] and passages.cut("") == []


def test_passages_column_drops_junk_and_takes_null(spark):
    df = spark.createDataFrame([(1, "x\n\nA useful passage with letters."), (2, None), (3, "")], "id int, text string")
    assert [tuple(r) for r in passages.chunked(df, "id").collect()] == [(1, 0, "A useful passage with letters.")]


@pytest.mark.parametrize(("word", "form"), [("وأمك", "ام"), ("الامهات", "ام"), ("والديه", "والد"), ("صلاتك", "صلاة"), ("الصلوات", "صلاة")])
def test_forms(word, form):
    assert form in subjects.forms(word.translate(str.maketrans("أإآ", "ااا")))


def test_subject_overlap(spark):
    assert one(spark, subjects.overlap("q", "t"), q="فضل الأم", t="عن عائشة أم المؤمنين قالت صلى الله عليه وسلم أمك ثم أمك") == 1.0
    assert one(spark, subjects.overlap("q", "t"), q="فضل الأم", t="عن أم سلمة قالت صلى الله عليه وسلم كلام آخر") == 0.0
    assert one(spark, subjects.overlap("q", "t"), q="فضل", t="فضل") == 0.0
    assert one(spark, subjects.overlap("q", "t", whole=True), q="الصوم", t="كتاب الصوم") == 1.0


def test_best_subjects_by_task_and_by_join(spark):
    """The best texts found in each task are those of all shares; no pairs are joined, grouped or shuffled."""
    words = ["فضل", "الصلوات", "وأمك", "صلاتك", "الأم", "الصوم", "كتاب", "abc", "of", "the", "x", "w" * 100, "والديه"]
    rows = [(i, " ".join(words[(i * k) % len(words)] for k in range(1, 1 + i % 6))) for i in range(300)] + [(300, None), (301, ""), (302, "ab" * 5000), (None, "the of")]
    texts = spark.createDataFrame(rows, "rowid long, text string").repartition(5)
    q = spark.createDataFrame([("a", "فضل الأم"), ("b", "الصلاة والصوم"), ("c", "the of"), ("d", "the the abc " + "w" * 100), ("e", ""), ("f", "فضل"), ("g", "nowhere"), ("h", "x")], "query_id string, query string")
    rows_of = lambda df: sorted(map(tuple, df.select("query_id", "rowid", "share", "pos").collect()), key=repr)
    for n in (1, 7, 1000):
        df = subjects.best(q, texts, n)
        assert rows_of(df) == rows_of(subjects.best_subjects(subjects.overlaps(q, texts), n)) == rows_of(subjects.best(q, texts, n, most=3))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan and plan.count("Exchange hashpartitioning") == 1
    assert rows_of(subjects.best(q.limit(0), texts, 3)) == rows_of(subjects.best(q, texts.limit(0), 3)) == []


def test_a_task_hands_on_the_best_texts_only():
    """However many texts and batches, n rows of each query; small tables of texts and words give the same."""
    batch = lambda lo: pa.RecordBatch.from_arrays([pa.array(range(lo + 100, lo, -1)), pa.array([["one", "two"][: 1 + i % 2] if i % 9 else None for i in range(100)])], names=["rowid", "words"])
    for cells in (1, 7, 1 << 20):
        out = list(subjects._best_of(["p", "q"], [["one", "two", "two"], ["two"]], 4, pa.string(), cells)(batch(lo) for lo in range(0, 1000, 100)))
        assert sorted(map(tuple, map(dict.values, pa.Table.from_batches(out).to_pylist()))) == [("p", i, 3, 3) for i in (3, 5, 7, 9)] + [("q", i, 1, 1) for i in (3, 5, 7, 9)]


def test_quote_rules(spark):
    formula, plain = "حدثنا فلان عن النبي", "كلمات عادية متتالية"
    rows = [(i, f"{formula} نص {i}") for i in range(30)] + [(100 + i, f"بداية {plain} نهاية {i}") for i in range(30)] + [(200 + i, f"عبارة شائعة جدا هنا {i}") for i in range(70)]
    p = quotes.with_body(spark.createDataFrame(rows, "rowid long, text string"))
    q = spark.createDataFrame([("formula", formula), ("plain", plain), ("common", "عبارة شائعة جدا هنا"), ("short", "كلمات عادية"), ("joined", "وكلمات عادية متتالية"), ("none", "")], "query_id string, query string")
    n = {r.query_id: r.n for r in quotes.quotes(q, p).groupBy("query_id").agg(F.count("*").alias("n")).collect()}
    assert n == {"plain": 30, "joined": 30}


def test_readings(spark):
    a = "قال رسول الله صلى الله عليه وسلم إنما الأعمال بالنيات وإنما لكل امرئ ما نوى"
    other, alike, gap = a.replace("الأعمال", "الاعمال"), a.replace("نوى", "نوي"), a.replace("رسول الله صلى الله عليه", "")
    rows = [(a, other), (a, alike), (a, gap), ("", None), ("١٢ x_y", "x y"), (a, a.replace("بالنيات", "بالنية"))]
    df = spark.createDataFrame(rows, "a string, b string").select(readings.compare("a", "b").alias("m")).select("m.*")
    got = [tuple(r) for r in df.collect()]
    assert [r[3] for r in got] == [True, True, False, True, True, True] and got[3] == (1.0, 0, 0, True) and got[2][1:3] == (5, 5) and got[5][1:3] == (1, 1)
    for (x, y), m in zip(rows, got):
        assert readings.measured(readings.words_of(x), readings.words_of(y or "")) == m
    three = [["x", a, a], ["x"], ["one two three four", "five six seven eight", "nine ten eleven twelve"], [a, gap, other], [gap, "نص بعيد جدا عن غيره", a]]
    votes = spark.createDataFrame([(k, i, t) for k, texts in enumerate(three) for i, t in enumerate(texts)], "k int, model int, text string")
    found = {r.k: (r.text, r.disputed) for r in readings.voted(votes, ["k"]).collect()}
    assert found == {0: (a, False), 1: ("x", True), 2: ("one two three four", True), 3: (a, False), 4: (gap, True)}
    assert {k: readings.settled(t) for k, t in enumerate(three)} == found
    read = spark.createDataFrame([(i, 0.5, i % 2 == 0, False) for i in range(100)], "page int, cost double, disputed boolean, fallback boolean")
    t = readings.totals(read, most=3).first()
    assert (t.pages, t.cost, t.disputed_pages, t.fallback_pages) == (100, 50.0, "0، 2، 4 و47 غيرها", "")
    assert tuple(readings.totals(read.limit(0)).first()) == (0, 0.0, "", "")


def test_codec_and_scalars(spark):
    df = spark.createDataFrame([([("النبي ﷺ", "المصدر"), ("زيد (أبو بكر)", None)],)], "c array<struct<name:string,grade:string>>")
    s = df.select(sc.chain_string("c").alias("s"))
    assert s.first().s == "النبي ﷺ (المصدر) > زيد (أبو بكر)"
    assert [tuple(x) for x in s.select(sc.chain_array("s").alias("a")).first().a] == [("النبي ﷺ", "المصدر"), ("زيد", "أبو بكر")]
    assert one(spark, sc.chain_array("s"), s="") == []
    assert one(spark, sc.human_size("n"), n=10) == "1 KB" and one(spark, sc.human_size("n"), n=3 << 20) == "3.0 MB"
    assert one(spark, sc.guarded("t"), t="=HYPERLINK()") == "'=HYPERLINK()"
    assert one(spark, sc.labelled("t", sc.KIND_LABELS), t="other") == "other"
    assert one(spark, tx.matn_of("t"), t="عن زيد قال رسول الله صلى الله عليه وسلم قال كلمات الحديث هنا ثمانية على الأقل كما ترى الآن") .startswith("كلمات الحديث")
    assert one(spark, tx.matn_of("t"), t="بلا ذكر") == ""
    assert one(spark, tx.names_a_subject("t"), t="باب بر الوالدين") and not one(spark, tx.names_a_subject("t"), t="حديث أم سلمة")


def test_both_tests_of_a_passage_agree(spark):
    some = ["a b", "letters enough here", "هذا نص عربي سليم فيه كلمات", "هذا BE نص gall عربي INKS فيه abc كلمات xyz كثيرة", "12345678 90", "x" * 30, "", " ", "éàü ñoç ßéé"]
    df = spark.createDataFrame([(t,) for t in some], "t string")
    assert [r[0] for r in df.select(tx.meaningful("t")).collect()] == [passages.meaningful(t) for t in some]
