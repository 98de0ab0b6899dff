"""Queries over a fixed table of Arabic texts, with each rule written out in SQL: the driver's tables hold no Arabic letter, so their rows cannot
show marks, letter variants, conjunctions, stems, mixed scripts or honorifics.

The texts are made by a rule from a few words of our own; the same rows go to Spark and, as VALUES, to SQL. The SQL holds compatibility
forms as plain replacements, which is all that the rows need of the normal form.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.operators import quotes, ranking, readings, subjects
from tessera.plans.queries import Query
from tessera.session import ready
from tessera.sources import editions

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE_SQL[fn.__name__] = sql
        return fn

    return add


# --- rows -----------------------------------------------------------------------------------------------------------------

_WORDS = (
    "العِلمُ", "كتــاب", "والصلاة", "فقال", "نُورٌ", "الأمة", "إلى", "موسى", "حدثنا", "أخبرنا", "قلم", "الرِفق", "من", "في", "abc", "Word", "ﻻ", "ﷺ", "①", "آدم", "وفاء", "فم", "ٱلليل", "سنة", "٢٣",
    "‏يمين", "ﬁn", "شــىء", "له،", "«قول»", "x_y", "بحر.", "يوم:", "1", "طويلة",
)
_GAPS = (" ", " ", " ", "  ", "\t", "\n", "\r\n", "\n \n\n\n", " ", " \n")


def _texts() -> list[tuple[int, str]]:
    rows = []
    for i in range(240):
        n, step, words = i % 23, 1 + i % 7, []
        for k in range(n):
            words += [_WORDS[(i * 5 + k * step) % len(_WORDS)], _GAPS[(i + k * k) % len(_GAPS)]]
        rows.append((i, "".join(words)))
    apart, back = "ا ل ع ل م ن و ر ي ه د ي ب ه م ن ي ش ا ء ا", "ملعلا رونلا ةنسلا " * 3 + " ".join(["ملعلا", "بابلا", "ملقلا", "ليللا", "رحبلا", "مويلا", "بتكلا"] * 3)
    back += " " + " ".join(w + "لا" for w in ("ملع", "رون", "باب", "ملق", "ليل", "رحب", "موي"))
    mixed = "هذا نص LATIN عربي TEXT سليم WORDS فيه كلمات MIXED كثيرة"
    return [*rows, (240, apart), (241, back), (242, mixed), (243, ""), (244, " \n\t "), (245, "النور " * 25), (246, "plain words in Latin letters only, long enough"), (247, "كلام عربي طويل بما يكفي ليكون نصا سليما"), (248, "كلام عربي ab"), (249, "ab")]


def _values(rows: list[tuple]) -> str:
    cell = lambda x: "null" if x is None else str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"
    return ", ".join(f"({', '.join(map(cell, r))})" for r in rows)


TEXTS = _texts()
_T = f"t as (select * from (values {_values(TEXTS)}) t(id, text))"


def _frame(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return ready(spark).createDataFrame(rows, schema)


_MARKED = r"\x{0610}-\x{061a}\x{064b}-\x{065f}\x{0670}\x{06d6}-\x{06dc}\x{06df}-\x{06e8}\x{06ea}-\x{06ed}"
_HIDDEN = r"[\x{200b}-\x{200f}\x{202a}-\x{202e}\x{2066}-\x{2069}\x{feff}]"


def _kc(c: str) -> str:
    """The compatibility forms of the rows."""
    for a, b in (("ﻻ", "لا"), ("ﷺ", "صلى الله عليه وسلم"), ("①", "1"), ("ﬁ", "fi"), (" ", " ")):
        c = f"replace({c}, '{a}', '{b}')"
    return c


def _cleaned(marks: bool) -> str:
    x = rf"regexp_replace(regexp_replace({_kc('text')}, '\r\n?', chr(10), 'g'), '{_HIDDEN}', '', 'g')"
    x = x if marks else f"regexp_replace({x}, '[{_MARKED}]', '', 'g')"
    x = rf"regexp_replace(replace({x}, 'ـ', ''), '[ \t]+', ' ', 'g')"
    x = rf"regexp_replace({x}, '(?m)^ +| +$', '', 'g')"
    return rf"regexp_replace(regexp_replace({x}, '\n{{3,}}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')"


def _words(c: str, frm: str = "أإآٱىة", to: str = "اااايه") -> str:
    x = rf"translate(regexp_replace({_kc(c)}, '[{_MARKED}ـ]', '', 'g'), '{frm}', '{to}')"
    return rf"list_filter(string_split(regexp_replace({x}, '[^\p{{L}}\p{{N}}_]+', ' ', 'g'), ' '), lambda x: x <> '')"


def _unjoined(words: str) -> str:
    return f"list_transform({words}, lambda w: case when length(w) >= 3 and left(w, 1) in ('و', 'ف') then substr(w, 2) else w end)"


def _body(c: str) -> str:
    return f"array_to_string(list_filter(string_split(lower(replace(array_to_string({_unjoined(_words(c))}, ' '), '_', ' ')), ' '), lambda x: x <> ''), ' ')"


# --- text -----------------------------------------------------------------------------------------------------------------


@query(rf"with {_T} select id, {_cleaned(False)} as cleaned, trim(regexp_replace({_cleaned(True)}, '\s+', ' ', 'g')) as tidied, not regexp_matches(text, '[^\s\x{{00a0}}]') as blank from t")
def arabic_clean(spark, d):
    """TXT1, TXT2, TXT12, FLT14."""
    return _frame(spark, TEXTS, "id int, text string").select("id", tx.clean("text").alias("cleaned"), tx.tidy("text").alias("tidied"), tx.blank("text").alias("blank"))


_BARE = r"trim(translate(regexp_replace(text, '[\x{0610}-\x{061a}\x{064b}-\x{065f}\x{0670}\x{0640}]', '', 'g'), 'أإآ', 'ااا'), ' ،,.:؛')"


@query(f"with {_T} select id, array_to_string({_words('text')}, ' ') as normal, array_to_string({_unjoined(_words('text'))}, ' ') as indexed, {_body('text')} as body, {_BARE} as bare from t")
def arabic_words(spark, d):
    """TXT2, TXT4, TXT5, TXT32, SNK2, STR8: folded words, the index form, the stored body, the key of a heading."""
    rows = quotes.with_body(_frame(spark, TEXTS, "id int, text string"))
    return rows.select("id", tx.normalize("text").alias("normal"), tx.index_form("text").alias("indexed"), "body", tx.bare("text").alias("bare"))


_COUNTS = r"""c as (select *, length(text) - length(regexp_replace(text, '\p{L}', '', 'g')) as letters, length(text) - length(regexp_replace(text, '[A-Za-z]', '', 'g')) as latin,
length(text) - length(regexp_replace(text, '[\x{0600}-\x{06ff}\x{0750}-\x{077f}\x{08a0}-\x{08ff}]', '', 'g')) as arab, regexp_extract_all(text, '[ء-ي]+') as w from t),
k as (select *, arab + latin >= 20 and latin / (arab + latin) > 0.08 and latin / (arab + latin) < 0.9 as garbled, case when arab + latin > 0 then latin / (arab + latin) else 0 end as share,
len(w) >= 20 and (len(list_filter(w, lambda x: length(x) = 1)) / greatest(len(w), 1) > 0.35 or (len(list_filter(w, lambda x: suffix(x, 'لا') and length(x) > 3)) >= 5 and len(list_filter(w, lambda x: suffix(x, 'لا') and length(x) > 3)) > 2 * len(list_filter(w, lambda x: prefix(x, 'ال') and length(x) > 3)))) as broken,
length(regexp_replace(text, '^[\s\x{00a0}]+|[\s\x{00a0}]+$', '', 'g')) as stripped from c)"""


@query(rf"""with {_T}, {_COUNTS} select id, letters::bigint as letters, letters >= 8 and len(list_filter(regexp_split_to_array(text, '[\s\x{{00a0}}]+'), lambda x: x <> '')) >= 2 and not garbled as meaningful, garbled, broken,
stripped >= 20 and not garbled and not broken as usable, regexp_matches(text, '[\x{{0600}}-\x{{06ff}}]') as arabic from k""")
def arabic_quality(spark, d):
    """FLT5-9, SCL10."""
    t = _frame(spark, TEXTS, "id int, text string")
    return t.select("id", tx.letters("text").cast("long").alias("letters"), tx.meaningful("text").alias("meaningful"), tx.looks_garbled("text").alias("garbled"), tx.looks_broken("text").alias("broken"), tx.usable_layer("text").alias("usable"), tx.has_arabic("text").alias("arabic"))


@query(f"""with {_T}, {_COUNTS} select a.id, case when a.stripped = 0 or (b.stripped > 0 and a.share > b.share) then b.text else a.text end as chosen, case when a.stripped = 0 then b.text else a.text end as seen from k a join k b on b.id = 249 - a.id""")
def arabic_layers(spark, d):
    """TXT28: each text as the reading of another one's layer, without and with a vision model."""
    t = _frame(spark, TEXTS, "id int, text string")
    pairs = t.join(t.select((249 - F.col("id")).alias("id"), F.col("text").alias("layer")), "id")
    return pairs.select("id", tx.choose_layer("text", "layer").alias("chosen"), tx.choose_layer("text", "layer", vision=True).alias("seen"))


TITLES = [(i, t) for i, t in enumerate(("باب بر الوالدين", "حديث أم سلمة", "من حديث أنس", "وَمِن حَديث زيد", "مُسند عمر", "أخبار مكة", "بقيّة الكلام", "تتمة: الباب", "ذكر الاختلاف على نافع", "ذكر الله", "حديثه في السفر", "", "زيادةُ بيان", "باب حديث جابر", "الأحاديث", "احاديث الرفق"))]
_KEY = r"trim(regexp_replace(translate(regexp_replace(title, '[\x{064b}-\x{065f}\x{0670}]', '', 'g'), 'أإآةـ', 'اااه'), '\s+', ' ', 'g'))"


@query(rf"select id, {_KEY} <> '' and not regexp_matches({_KEY}, '^(و?من )?(حديث|احاديث|مسند|اخبار|بقيه|تتمه|زياده|ذكر الاختلاف|ذكر اختلاف)(\s|:|$)') as kept from (values {_values(TITLES)}) t(id, title)")
def arabic_titles(spark, d):
    """FLT10, VEC6: titles of chapters about a subject."""
    return _frame(spark, TITLES, "id int, title string").select("id", tx.names_a_subject("title").alias("kept"))


# --- quotes -----------------------------------------------------------------------------------------------------------------

#: Passages: a formula of transmission in 30, a plain phrase in 30, a phrase in 70, a long one in 70, and the texts.
PASSAGES = (
    [(i, f"حدثنا فلان عن النبيّ نص {i}") for i in range(30)] + [(100 + i, f"بداية، وكلمات عاديةٌ متتالية نهاية {i}") for i in range(30)] + [(200 + i, f"عبارة شائعة جدا هنا {i}") for i in range(70)]
    + [(300 + i, f"{i} هذه عبارة طويلة من ثماني كلمات لا غير والسلام") for i in range(70)] + [(1000 + i, t) for i, t in TEXTS]
)
PHRASES = [(0, "حدثنا فلان عن النبي"), (1, "كلمات عادية متتالية"), (2, "عبارة شائعة جدا هنا"), (3, "كلمات عادية"), (4, "فكلمات عَادِية متتالية"), (5, ""), (6, "هذه عبارة طويلة من ثماني كلمات لا غير"), (7, "شائعة جدا"), (8, "بداية كلمات عادية"), (9, "قلم x_y ABC"), (10, "النبي نص 7"), (11, "سمعت نص غائب")]
_SAID = ", ".join(f"'{w}'" for w in quotes.TRANSMISSION)


@query(f"""with p as (select rowid, {_body('text')} as body from (values {_values(PASSAGES)}) p(rowid, text)),
q as (select query_id, {_body('query')} as phrase, {_unjoined(_words('query'))} as w from (values {_values(PHRASES)}) q(query_id, query)),
h as (select query_id, rowid, phrase, w from q join p on len(string_split(phrase, ' ')) >= 3 and contains(' ' || body || ' ', ' ' || phrase || ' ')),
n as (select *, count(*) over (partition by query_id) as n from h)
select query_id, rowid, (row_number() over (partition by query_id order by rowid))::int as pos from n where not (len(w) < 8 and n > 20 and (n > 60 or list_has_any(w, [{_SAID}]))) qualify pos <= 60""")
def arabic_quotes(spark, d):
    """TXT5, TXT6, JN1, ORD5, SNK2: formulas of transmission and common phrases name no text; sixty passages at most."""
    return quotes.quotes(_frame(spark, PHRASES, "query_id int, query string"), quotes.with_body(_frame(spark, PASSAGES, "rowid int, text string"))).select("query_id", "rowid", "pos")


# --- subjects ---------------------------------------------------------------------------------------------------------------

SUBJECTS = [(0, "فضل الصدقات"), (1, "الصلاة"), (2, "بر الوالدين"), (3, "أم سلمة"), (4, "هل من"), (5, "صبرهم وكتابهما"), (6, "الرفق بالحيوان في السفر"), (7, "كلمات كثيرة لا تعد موضوعا من ستة كلمات أو أقل"), (8, "المؤمنون"), (9, "زكاة"), (10, "ليل ونهار")]
STORIES = [
    (0, "عن صدقة قال صلى الله عليه وسلم الصدقة تطفئ الخطيئة", "باب الزكاة"), (1, "صلاتهم وصلواتكم ثم ليل", "كتاب الصلوات"), (2, "أم سلمة أم المؤمنين قالت", ""), (3, "والداه وبرّهما", "بر الوالد"), (4, "الصابرون على صبر", "الصبر"), (5, "كتب الكتابات والكتاب", None), (6, "رفيق الحيوانات مسافر", "الرفق"),
    (7, "سمع زكاة ﷺ نهار بعد ليل", "الزكوات"), (8, "قال المؤمن للمؤمنين إنه ابن زكاة", "أم المؤمنين"), (9, "", "ليل"), (10, "وبالليالي فالنهار", "صوم"), (11, "بنت ليل", "بنت الليل"),
]
_F = ("أإآٱى", "ااااي")
_ENDINGS = _values([(e, least, i) for i, (e, least) in enumerate(subjects.ENDINGS)])
_ARTICLE = " ".join(f"when prefix(f, '{a}') and length(f) - {len(a)} >= 2 then substr(f, {len(a) + 1})" for a in subjects.ARTICLES)
_LIST = lambda xs: ", ".join(f"'{x}'" for x in xs)


def _stripped(frm: str) -> str:
    """Stems under the longest ending that leaves enough, and the feminine forms they may stand for."""
    cut = f"select w, f, left(f, length(f) - length(e)) as s, e from {frm} join (values {_ENDINGS}) n(e, least, ord) on suffix(f, e) and length(f) - length(e) >= least qualify row_number() over (partition by w, f order by ord) = 1"
    return f"select w, f from {frm} union select w, unnest(list_filter([s, case when suffix(s, 'ت') then left(s, length(s) - 1) || 'ة' end, case when e = 'ات' and suffix(s, 'و') then left(s, length(s) - 1) || 'اة' end], lambda x: x is not null)) from ({cut})"


def _told(c: str, whole: bool) -> str:
    """The words of a text that can name a subject."""
    x = f"array_to_string({_words(c, *_F)}, ' ')"
    x = x if whole else f"case when contains({x}, '{subjects.PROPHET}') then substr({x}, position('{subjects.PROPHET}' in {x}) + {len(subjects.PROPHET)}) else {x} end"
    return f"list_filter(string_split(replace({x}, '{subjects.MOTHER}', ' '), ' '), lambda w: w <> '' and not list_contains([{_LIST(subjects.NAME_WORDS)}], case when length(w) >= 3 and left(w, 1) in ('و', 'ف') then substr(w, 2) else w end))"


_SUBJECTS = f"""with q as (select query_id, list_filter({_words('query', *_F)}, lambda w: not list_contains([{_LIST(subjects.FRAMING)}], w) and not list_contains([{_LIST(tx.STOPWORDS)}], translate(w, 'أإآٱىة', 'اااايه')) and length(w) > 1) as w, len({_words('query', *_F)}) between 1 and 6 as subject from (values {_values(SUBJECTS)}) q(query_id, query)),
s as (select rowid, {_told('text', False)} as a, {_told("coalesce(topic, '')", True)} as b from (values {_values(STORIES)}) s(rowid, text, topic)),
every as (select unnest(w) as w from q union select unnest(a) from s union select unnest(b) from s),
f0 as (select w, w as f from every union select w, substr(w, 2) from every where length(w) >= 4 and left(w, 1) in ('و', 'ف')),
f1 as (select w, f from f0 union select w, case {_ARTICLE} end from f0 where case {_ARTICLE} end is not null),
f2 as ({_stripped('f1')}), f3 as ({_stripped('f2')}), forms as (select w, list(distinct f) as forms from f3 group by w),
asked as (select query_id, subject, i, forms from (select query_id, subject, unnest(w) as w, generate_subscripts(w, 1) as i from q) join forms using (w)),
have as (select rowid, which, list(distinct f) as h from (select rowid, 'a' as which, unnest(a) as w from s union all select rowid, 'b', unnest(b) from s) join f3 using (w) group by all),
n as (select q.query_id, s.rowid, k.which, len(q.w) as n, count(*) filter (list_has_any(asked.forms, h)) as hit from q, s, (values ('a'), ('b')) k(which) left join have on have.rowid = s.rowid and have.which = k.which left join asked on asked.query_id = q.query_id group by all),
r as (select query_id, rowid, which, case when n = 0 then 0.0 else round(hit / n, 4) end as share from n)"""


@query(_SUBJECTS + " select r.query_id, rowid, subject, max(share) filter (which = 'a')::double as share, max(share)::double as with_title from r join q using (query_id) group by all")
def arabic_subjects(spark, d):
    """TXT8, TXT9, TXT10, RNK3, SET3, SET4, JN15: every subject against every story and its chapter's title."""
    q, s = _frame(spark, SUBJECTS, "query_id int, query string"), _frame(spark, STORIES, "rowid int, text string, topic string")
    pairs = q.join(F.broadcast(s), how="cross")  # two fixed tables of a dozen rows
    return pairs.select("query_id", "rowid", tx.is_subject("query").alias("subject"), subjects.overlap("query", "text").alias("share"), subjects.title_share("query", "text", "topic").alias("with_title"))


@query(_SUBJECTS + " select query_id, rowid, share::double as share, (row_number() over (partition by query_id order by share desc, rowid))::int as pos from r where which = 'a' and share > 0 qualify pos <= 3")
def arabic_best_subjects(spark, d):
    """TXT9, TXT10, SET3, SET4, JN15: the same by a table of forms in each task, the best three."""
    q, s = _frame(spark, SUBJECTS, "query_id int, query string"), _frame(spark, STORIES, "rowid int, text string, topic string")
    return subjects.best(q, s.select("rowid", "text"), 3).select("query_id", "rowid", "share", "pos")


# --- results ----------------------------------------------------------------------------------------------------------------

ITEMS = [(f"i{k}{'~matn' if k % 3 == 1 else ''}", "structured_hadith" if k % 4 else "document", f"s{k % 2}", str(k // 3), None if k % 5 == 0 else f"own {k}") for k in range(40)]
STORED = [(f"i{k}", "" if k % 7 == 0 else f"stored {k}") for k in range(0, 40, 2)]


@query(f"""with i as (select * from (values {_values(ITEMS)}) i(id, type, source, record_id, text)), s as (select * from (values {_values(STORED)}) s(item_id, text)),
h as (select i.id, case when type = 'structured_hadith' then source || '#' || record_id else i.id end as key, coalesce(nullif(s.text, ''), i.text) as text from i left join s on s.item_id = regexp_replace(i.id, '~matn$', ''))
select id, key, text from h where text is not null qualify row_number() over (partition by key order by id) = 1""")
def arabic_items(spark, d):
    """RNK6, JN3, WIN1: the vectors of one text share a key; the owner's stored text is shown, else the item's own; each text once."""
    items, stored = _frame(spark, ITEMS, "id string, type string, source string, record_id string, text string"), _frame(spark, STORED, "item_id string, text string")
    rows = ranking.hydrated(items.withColumn("key", ranking.text_key()), stored)
    rows = rows.select(F.lit(1).alias("query_id"), "id", "key", "text", F.lit(1.0).alias("similarity"), F.col("id").alias("place"))
    return ranking.merged(rows.limit(0), rows, 100).select("id", "key", "text")


# --- narrations, markup, readings ---------------------------------------------------------------------------------------------

MATNS = [(i, t) for i, t in enumerate((
    "عن زيد قال رسول الله صلى الله عليه وسلم: قال «كلمات الحديث هنا ثمانية على الأقل كما ترى الآن»", "بلا ذكر أحد", "عن النبيّ ﷺ قال من صلّى في يومه وليلته كان له أجر عند ربه", "قال صلى الله عليه وسلم كلام قصير", "ﷺ يقول الرفق خير كله فارفقوا بأنفسكم وأهليكم ما استطعتم إلى ذلك",
    "حدثنا عمرو عن أنس أن النبي صلى الله عليه وسلم قال صلى الله عليه وسلم مرتين في نص واحد طويل بما يكفي", "قال صلى الله عليه وسلم فقال أنه قالوا: وقال لا يقولن أحدكم كذا وكذا أبدا في يوم",
))]
_PLAIN = rf"regexp_replace({_kc('text')}, '[\x{{0610}}-\x{{061a}}\x{{064b}}-\x{{065f}}\x{{0670}}\x{{06d6}}-\x{{06ed}}ـ]', '', 'g')"
_LEAD = r"^([\s:،,.«»\x{22}()]|\x{27}|(قالت|قالا|قالوا|فقالت|فقالوا|وقالت|قال|فقال|وقال|يقول|أنه|انه)($|[^ء-ي]))+"


@query(rf"""with m as (select * from (values {_values(MATNS)}) m(id, text)), p as (select id, {_PLAIN} as x from m), f as (select *, position('صلى الله عليه وسلم' in x) as place from p),
r as (select *, trim(regexp_replace(' ' || substr(x, place + 18), '{_LEAD}', ''), ' «»".' || chr(39)) as rest from f)
select id, case when place = 0 or len(list_filter(string_split(rest, ' '), lambda w: w <> '')) < 8 or length(rest) > 0.85 * length(x) then '' else rest end as matn from r""")
def arabic_matns(spark, d):
    """TXT11: what follows the first mention that ends the chain, if it stands on its own."""
    return _frame(spark, MATNS, "id int, text string").select("id", tx.matn_of("text").alias("matn"))


MARKUP = [(i, t) for i, t in enumerate((
    "<b>نص</b> (١) ⦗٣⦘ آخر ﵀", "قال ٣٠٠ - وكان الأمر", "[الأحزاب: ٢٨ - ٢٩] آية", "• ١١٠٢٠/ قال عبد الله", "قبل ____ بعد", "ربط¬ بين (¬٢) و(¬*) كلمتين [", "﵇ ﵅ ﷿", "﵏﵆ باق", "<span data-type='title'>باب\r\n جديد</span>  (12) نص", "بلا شيء",
))]


def _readable(c: str) -> str:
    x = rf"regexp_replace(regexp_replace(regexp_replace({c}, '<[^>]+>', '', 'g'), '⦗[٠-٩0-9]+⦘', '', 'g'), '\s*\(¬?([٠-٩0-9]{{1,3}}|\*)\)', '', 'g')"
    for glyph, words in editions.HONORIFICS.items():
        x = f"replace({x}, '{glyph}', ' {words} ')"
    x = rf"regexp_replace({x}, '[\x{{fd40}}-\x{{fd4f}}]', '', 'g')"
    # a range of verses keeps its numbers: its dash is set aside while numbers inside a narration go
    x = rf"regexp_replace({x}, '([٠-٩]+[ \t]*)-([ \t]+[٠-٩]+\])', '\1' || chr(1) || '\2', 'g')"
    x = rf"replace(regexp_replace(regexp_replace({x}, '(\s)[٠-٩]+[ \t]*-[ \t]+', '\1', 'g'), '•[ \t]*[٠-٩]+[ \t]*/', '•', 'g'), chr(1), '-')"
    return rf"regexp_replace(trim(regexp_replace(replace(regexp_replace({x}, '_{{3,}}', ' ', 'g'), '¬', ''), '\s+', ' ', 'g')), ' \[$', '')"


@query(f"select id, {_readable('text')} as plain from (values {_values(MARKUP)}) m(id, text)")
def arabic_markup(spark, d):
    """TXT22: honorifics spelled out; tags, page marks, pointers to notes, numbers inside a narration, rules and joining marks gone."""
    return _frame(spark, MARKUP, "id int, text string").select("id", editions.plain("text").alias("plain"))


@query(rf"""with {_T}, r as (select id, regexp_replace('```text' || chr(10) || translate({_kc('text')}, '٢٣', '۲۳') || chr(10) || '```', '^```[a-zA-Z]*\s*|\s*```$', '', 'g') as x from t),
y as (select id, translate(x, '۰۱۲۳۴۵۶۷۸۹یک', '٠١٢٣٤٥٦٧٨٩يك') as x from r),
w as (select id, list_filter(regexp_split_to_array(regexp_replace(translate(regexp_replace(x, '[\x{{0610}}-\x{{061a}}\x{{064b}}-\x{{065f}}\x{{0670}}\x{{06d6}}-\x{{06ed}}ـ]', '', 'g'), 'أإآٱىة', 'اااايه'), '[^\p{{L}}\p{{M}}\p{{N}}\s]|_', ' ', 'g'), '\s+'), lambda v: v <> '') as w, x from y)
select id, md5(regexp_replace(x, '^\s+|\s+$', '', 'g')) as tidy_md5, array_to_string(list_filter(list_transform(w, lambda v: left(v, 1) || replace(substr(v, 2), 'ا', '')), lambda v: not regexp_full_match(v, '\p{{Nd}}+')), ' ') as compared from w""")
def arabic_readings(spark, d):
    """TXT16, TXT17: a model's reading without its fences, and the words by which readings are compared."""
    raw = F.concat(F.lit("```text\n"), F.translate(tx.nfkc("text"), "٢٣", "۲۳"), F.lit("\n```"))
    rows = _frame(spark, TEXTS, "id int, text string").withColumn("x", tx.reading_tidy(raw))
    return rows.select("id", F.md5("x").alias("tidy_md5"), F.array_join(readings.comparable("x"), " ").alias("compared"))
