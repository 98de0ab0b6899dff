"""Collections of records: JSON arrays, JSON books, CSV files of unknown dialect (SRC1-4, SRC8-15, SRC19-21, TXT13, JN8, AGG9).

Files come as (path, content): Spark's binaryFile reader reads any store, decoding is an Arrow function, and parsing is from_json, Variant paths
and native expressions wherever the layout is known.
"""

from __future__ import annotations

import csv
import io

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.operators import books
from tessera.session import col, ready

# File kinds; grades and graders as collections write them, in order of preference.
STRUCTURED, TEXTS, IMAGES = (".json", ".csv"), (".txt", ".md"), (".png", ".jpg", ".jpeg", ".tif", ".tiff", ".bmp", ".webp")
GRADES = (
    ("hasan sahih", "حسن صحيح"), ("sahih", "صحيح"), ("hasan", "حسن"), ("da'if jiddan", "ضعيف جدًا"), ("da'if", "ضعيف"), ("daif", "ضعيف"), ("da`if", "ضعيف"),
    ("weak", "ضعيف"), ("mawdu", "موضوع"), ("maudu", "موضوع"), ("fabricated", "موضوع"), ("munkar", "منكر"), ("shadh", "شاذ"),
)
GRADERS = (
    ("al-albani", "الألباني"), ("shuaib al arnaut", "شعيب الأرناؤوط"), ("zubair ali zai", "زبير علي زئي"), ("darussalam", "دار السلام"),
    ("ahmad muhammad shakir", "أحمد محمد شاكر"),
)
RECORD = "struct<id:string,text:string,hukm:string,mohaddith:string,sanad:array<struct<name:string,grade:string>>,topic:string,source:string,matn:string>"


def files(spark: SparkSession, path: str, glob: str = "*", most_bytes: int | None = None) -> DataFrame:
    """SRC15/SRC19: path, length, content of files below a folder, in order of path; larger ones are left out, and files without a byte are not listed."""
    found = ready(spark).read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    return found.filter(F.col("length") <= most_bytes) if most_bytes else found


def extension(path: Column | str) -> Column:
    return F.lower(F.regexp_extract(col(path), r"(\.[^./]*)$", 1))


def kind(path: Column | str) -> Column:
    """SRC1/SRC2: how a file is read; null for an unsupported one."""
    ext = extension(path)
    return F.when(ext.isin(*STRUCTURED), "structured").when(ext == ".pdf", "pdf").when(ext == ".docx", "docx").when(ext.isin(*TEXTS), "text").when(ext.isin(*IMAGES), "image")


def decode_document(data: bytes) -> str:
    """SRC3: UTF-8 with or without a mark, UTF-16 with one, the Windows Arabic page, else UTF-8 with replacements."""
    tries = ["utf-8-sig", *(["utf-16"] if data[:2] in (b"\xff\xfe", b"\xfe\xff") else []), "cp1256"]
    for encoding in tries:
        try:
            return data.decode(encoding)
        except UnicodeDecodeError:
            pass
    return data.decode("utf-8", "replace")


def decode_collection(data: bytes) -> str | None:
    """SRC4: null where neither encoding fits."""
    for encoding in ("utf-8-sig", "cp1256"):
        try:
            return data.decode(encoding)
        except UnicodeDecodeError:
            pass
    return None


def decoded(content: Column | str, collection: bool = False) -> Column:
    """SRC3/SRC4 as a column."""
    fn = decode_collection if collection else decode_document

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda b: fn(bytes(b)), na_action="ignore")

    return run(col(content))


def either(value: Column, inner: str) -> Column:
    """SRC21: a JSON field that is a string, or an object that holds it."""
    is_object = F.ltrim(value).startswith("{")
    return F.coalesce(F.when(is_object, F.get_json_object(value, f"$.{inner}")).otherwise(value), F.lit(""))


def grade(grades: Column) -> Column:
    """TXT13/ORD6: struct(hukm, mohaddith) from an array of (name, grade): the preferred grader's, in the known term."""
    known = F.create_map(*[F.lit(x) for i, (n, _) in enumerate(GRADERS) for x in (n, i)])
    labels = F.create_map(*[F.lit(x) for pair in GRADERS for x in pair])
    rank = lambda g: F.coalesce(F.try_element_at(known, F.lower(F.trim(F.coalesce(g["name"], F.lit(""))))), F.lit(len(GRADERS)))
    given = F.filter(F.coalesce(grades, F.array()), lambda g: F.coalesce(g["grade"], F.lit("")) != "")
    ranked = F.array_sort(F.transform(given, lambda g, i: F.struct(rank(g).alias("r"), i.alias("i"), g["name"].alias("name"), g["grade"].alias("grade"))))
    best = F.try_element_at(ranked, F.lit(1))
    said, name = F.trim(best["grade"]), F.trim(F.coalesce(best["name"], F.lit("")))
    term = said
    for english, arabic in reversed(GRADES):
        term = F.when(F.lower(said).startswith(english), F.lit(arabic)).otherwise(term)
    return F.struct(F.coalesce(term, F.lit("")).alias("hukm"), F.when(best.isNull(), F.lit("")).otherwise(F.coalesce(F.try_element_at(labels, F.lower(name)), name)).alias("mohaddith"))


def json_records(texts: DataFrame, text: str = "text") -> DataFrame:
    """SRC8: records of JSON arrays; missing fields are empty. texts: file and text."""
    rows = texts.select("file", F.posexplode(F.from_json(text, f"array<{RECORD}>")).alias("pos", "r"))
    blank = lambda c: F.coalesce(F.col(f"r.{c}"), F.lit("")).alias(c)
    return rows.select("file", "pos", *(blank(c) for c in ("id", "text", "hukm", "mohaddith", "topic", "source", "matn")), F.coalesce("r.sanad", F.array().cast("array<struct<name:string,grade:string>>")).alias("sanad"))


_BOOK = "struct<metadata:struct<arabic:string>,chapters:array<struct<id:long,arabic:string>>,chapter:struct<id:long,arabic:string>,hadiths:array<struct<id:long,idInBook:long,chapterId:long,arabic:string,english:struct<grades:array<struct<name:string,grade:string>>>,grades:array<struct<name:string,grade:string>>>>>"


def json_books(texts: DataFrame, text: str = "text", unicode: bool = True) -> DataFrame:
    """SRC9/JN8: records of JSON books: chapters give topics, grades give rulings; bodies without Arabic letters have kept = false.

    Fields that are a string in one file and an object in another are read as JSON text and opened by `either`."""
    b = texts.select("file", F.from_json(text, _BOOK).alias("b"))
    title = tx.tidy(F.coalesce(F.get_json_object("b.metadata.arabic", "$.title"), F.lit("")), unicode)
    chapters = F.concat(F.coalesce("b.chapters", F.array().cast("array<struct<id:long,arabic:string>>")), F.when(F.col("b.chapter").isNotNull(), F.array("b.chapter")).otherwise(F.array().cast("array<struct<id:long,arabic:string>>")))
    topics = b.select("file", F.posexplode(chapters).alias("n", "c")).groupBy("file", F.col("c.id").alias("chapterId")).agg(F.max_by(either(F.col("c.arabic"), "title"), "n").alias("topic"))
    rows = b.select("file", title.alias("title"), F.posexplode("b.hadiths").alias("pos", "h"))
    body = tx.tidy(either(F.col("h.arabic"), "text"), unicode)
    grades = F.when(F.size(F.coalesce("h.english.grades", F.array())) > 0, F.col("h.english.grades")).otherwise(F.col("h.grades"))
    rows = rows.select("file", "title", "pos", F.col("h.chapterId").alias("chapterId"), F.coalesce(F.nullif("h.idInBook", F.lit(0)), F.nullif("h.id", F.lit(0)), (F.col("pos") + 1).cast("long")).cast("string").alias("id"), body.alias("text"), grade(grades).alias("g"))
    out = rows.join(topics, ["file", "chapterId"], "left")
    return out.select("file", "title", "pos", "id", "text", "g.hukm", "g.mohaddith", tx.tidy(F.coalesce("topic", F.lit("")), unicode).alias("topic"), tx.has_arabic("text").alias("kept"))


def _table(text: str) -> list[list[str]]:
    """SRC10: rows of a CSV text under the dialect its first 20,000 characters show; blank rows dropped, short rows filled up."""
    csv.field_size_limit(10_000_000)
    try:
        dialect: object = csv.Sniffer().sniff(text[:20_000], delimiters=",;\t")
    except csv.Error:
        dialect = csv.excel
    rows = [r for row in csv.reader(io.StringIO(text), dialect) if any(r := [c.strip() for c in row])]
    width = max(map(len, rows), default=0)
    return [r + [""] * (width - len(r)) for r in rows]


def csv_records(texts: DataFrame, text: str = "text", unicode: bool = True) -> DataFrame:
    """SRC10-12/WIN8: records of CSV files: the text column is the longest, the number column the first other one that holds digits only,
    and a first row that is no record is the title. A file is parsed in one task, as its dialect needs all of it; roles and headers are
    native."""

    @F.pandas_udf("array<array<string>>")
    def parse(s: pd.Series) -> pd.Series:
        return s.map(lambda x: _table(x) if x else [])

    t = texts.select("file", parse(text).alias("rows"))
    width = F.size(F.coalesce(F.try_element_at("rows", F.lit(1)), F.array()))
    columns = F.when(width > 0, F.sequence(F.lit(0), width - 1)).otherwise(F.array().cast("array<int>"))
    total = lambda c: F.aggregate(F.transform("rows", lambda r: F.length(r[c])), F.lit(0), lambda a, x: a + x)
    t = t.withColumn("tc", F.array_max(F.transform(columns, lambda c: F.struct(total(c).alias("n"), (-c).alias("c"))))["c"] * -1)
    later = F.slice("rows", 2, 1 << 30)
    cells = lambda c: F.filter(F.transform(later, lambda r: r[c]), lambda x: x != "")
    numbers = F.filter(columns, lambda c: (c != F.col("tc")) & (F.size(cells(c)) > 0) & F.forall(cells(c), lambda x: x.rlike(r"^\p{Nd}+$")))
    t = t.withColumn("nc", F.try_element_at(numbers, F.lit(1)))
    first = F.try_element_at("rows", F.lit(1))
    head = first[F.col("tc")]
    others = F.transform(later, lambda r: F.length(r[F.col("tc")]))
    mean = F.aggregate(others, F.lit(0), lambda a, x: a + x) / F.greatest(F.size(others), F.lit(1))
    header = F.when(~tx.has_arabic(head), F.lit(True)).when(F.col("nc").isNotNull(), ~first[F.col("nc")].rlike(r"^\p{Nd}+$")).otherwise((F.size(others) > 0) & (F.length(head) < 20) & (mean > 20))
    t = t.withColumn("header", F.coalesce(header, F.lit(False)))
    body = F.when(F.col("header"), later).otherwise(F.col("rows"))
    rows = t.select("file", "tc", "nc", F.when(F.col("header"), head).otherwise(F.lit("")).alias("title"), F.posexplode(body).alias("pos", "r"))
    number = F.when(F.col("nc").isNotNull(), F.nullif(F.col("r")[F.col("nc")], F.lit("")))
    return rows.select("file", "title", "pos", F.coalesce(number, (F.col("pos") + 1).cast("string")).alias("id"), tx.tidy(F.col("r")[F.col("tc")], unicode).alias("text")).withColumn("kept", tx.has_arabic("text"))


def with_defaults(records: DataFrame, source: str = "", hukm: str = "", mohaddith: str = "") -> DataFrame:
    """A record's book (its own, the one given, the file's title, or the file's name) under its published title; a ruling for those without."""
    stem = F.regexp_replace(F.regexp_extract("file", r"([^/]*)$", 1), r"\.[^.]*$", "")
    own = F.nullif("source", F.lit("")) if "source" in records.columns else F.lit(None).cast("string")
    named = F.nullif("title", F.lit("")) if "title" in records.columns else F.lit(None).cast("string")
    out = records.withColumn("source", books.title(F.coalesce(own, F.nullif(F.lit(source), F.lit("")), named, stem)))
    if hukm:
        none = F.coalesce("hukm", F.lit("")) == ""
        out = out.withColumn("mohaddith", F.when(none, F.coalesce(F.nullif("mohaddith", F.lit("")), F.lit(mohaddith))).otherwise(F.col("mohaddith"))).withColumn("hukm", F.when(none, F.lit(hukm)).otherwise(F.col("hukm")))
    return out


def summary(records: DataFrame) -> DataFrame:
    """AGG9: kept, skipped, graded per file."""
    graded = F.count_if(F.col("kept") & (F.col("hukm") != "")) if "hukm" in records.columns else F.lit(0)
    return records.groupBy("file").agg(F.count_if("kept").alias("kept"), F.count_if(~F.col("kept")).alias("skipped"), graded.alias("graded"))


def embedded_texts(records: DataFrame) -> DataFrame:
    """SET5: whole texts, then the matns that stand on their own."""
    whole = records.select(F.lit(0).alias("part"), "id", tx.clean("text").alias("text"))
    return whole.unionByName(records.select(F.lit(1).alias("part"), "id", tx.clean(tx.record_matn("matn", "text")).alias("text")).filter("text <> ''"))


def token_estimate(texts: DataFrame, sampled_chars: int, sampled_tokens: int, price_per_million: float, text: str = "text") -> DataFrame:
    """AGG11: tokens and cost of all texts from a sample's ratio."""
    chars = F.sum(F.length(text))
    tokens = F.bround(chars * (sampled_tokens / max(1, sampled_chars)), 0).cast("long")
    return texts.agg(F.count(F.lit(1)).alias("texts"), chars.alias("chars"), tokens.alias("tokens"), (tokens * price_per_million / 1e6).alias("cost"))

