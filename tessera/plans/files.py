"""Queries of files and services: encodings, Word files, page images, exported editions, uploads, embedding services, progress.

Inputs that the driver's tables do not have are made here from them, or are a few files of our own; the SQL states what must come out.
"""

from __future__ import annotations

import base64
import io
import sqlite3
import struct
import time
import uuid
import zipfile
from contextlib import closing

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import images, vectors
from tessera.plans.queries import Query
from tessera.service import Library
from tessera.session import ready, shared_folder, table
from tessera.sources import collections as coll
from tessera.sources import documents, editions, writers
from tessera.streaming import events as st

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE_SQL[fn.__name__] = sql
        return fn

    return add


def _folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"


def _files(spark: SparkSession, found: dict[str, bytes]) -> DataFrame:
    return ready(spark).createDataFrame([(f"/in/{k}", len(v), bytearray(v)) for k, v in found.items()], "path string, length long, content binary")


# --- texts and Word files --------------------------------------------------------------------------------------------------

_TEXT = "نص عربي، كلام: 12"
_ENCODED = {
    "plain.txt": _TEXT.encode(), "mark.txt": _TEXT.encode("utf-8-sig"), "wide.txt": _TEXT.encode("utf-16"), "wide_be.txt": b"\xfe\xff" + _TEXT.encode("utf-16-be"), "page.txt": _TEXT.encode("cp1256"), "empty.md": b"",
    "latin.txt": b"plain ascii",
}


@query(f"""select path, text, case when path not like 'wide%' then text end as collection from (values ('plain.txt', '{_TEXT}'), ('mark.txt', '{_TEXT}'), ('wide.txt', '{_TEXT}'), ('wide_be.txt', '{_TEXT}'), ('page.txt', '{_TEXT}'), ('empty.md', ''), ('latin.txt', 'plain ascii')) t(path, text)""")
def decoded_files(spark, d):
    """SRC3, SRC4: UTF-8 with and without a mark, UTF-16 with one, the Windows Arabic page. As a collection, UTF-16 is not looked for."""
    f = _files(spark, _ENCODED).withColumn("path", F.regexp_extract("path", r"([^/]*)$", 1))
    wide = F.col("path").startswith("wide")
    return f.select("path", coll.decoded("content").alias("text"), F.when(~wide, coll.decoded("content", collection=True)).alias("collection"))


@query("select replace(replace(text, chr(10), ' '), chr(13), ' ') as line, count(*) as n from conversations group by 1")
def listed_files(spark, d):
    """SRC15, SRC19, SNK13: texts written as files, found below their folder by name, with a cap on size, and read as lines."""
    folder = _folder(spark)
    writers.text_lines(table(spark, d, "conversations").select(F.translate("text", "\n\r", "  ").alias("text")), f"{folder}/a/b")
    writers.text_lines(spark.range(1).select(F.repeat(F.lit("x"), (1 << 25) + 1).alias("text")), f"{folder}/large")  # over the cap
    found = coll.files(spark, folder, "part-*", 1 << 25)
    return found.select(F.explode(F.split(F.regexp_replace(coll.decoded("content"), "\n$", ""), "\n")).alias("line")).groupBy("line").agg(F.count(F.lit(1)).alias("n"))


def _docx(*parts: str) -> bytes:
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body>{"".join(parts)}</w:body></w:document>')
    return buffer.getvalue()


def _p(text: str) -> str:
    return f"<w:p><w:r><w:t>{text}</w:t></w:r></w:p>"


_CELLS = f"<w:tbl><w:tr><w:tc>{_p('a')}</w:tc><w:tc>{_p('b')}{_p('c')}</w:tc></w:tr><w:tr><w:tc>{_p('د')}</w:tc></w:tr></w:tbl>"


@query("""select * from (values ('one.docx', 0, 'أول', null), ('one.docx', 1, 'last', null), ('one.docx', 2, 'a | b' || chr(10) || 'c', null), ('one.docx', 3, 'د', null), ('two.docx', 0, 'x' || chr(9) || 'y', null), ('bad.docx', 0, null, 'BadZipFile'), ('t.txt', 0, 'نص', null)) t(path, ix, text, error)""")
def word_blocks(spark, d):
    """SRC1, SRC2, SRC6: paragraphs in order, then tables by row; a file that cannot be read is a row, one of another kind is none."""
    f = _files(spark, {"one.docx": _docx(_p("أول"), _p(" "), _CELLS, _p("last")), "two.docx": _docx("<w:p><w:r><w:t>x</w:t><w:tab/><w:t>y</w:t></w:r></w:p>"), "bad.docx": b"no zip", "t.txt": "نص".encode(), "x.exe": b"MZ"})
    return documents.blocks(f).select(F.regexp_extract("path", r"([^/]*)$", 1).alias("path"), "ix", "text", F.split("error", ":")[0].alias("error"))


@query("select 3 as gone, true as freed, 2 as kept")
def files_removed(spark, d):
    """SNK22: files that match a pattern go; their bytes are told."""
    folder = _folder(spark)
    for name in ("index-1", "index-2", "index-3", "original-1", "other"):
        writers.text_lines(spark.range(5).select(F.col("id").cast("string").alias("text")), f"{folder}/{name}")
    before = coll.files(spark, folder, "part-*").select(F.element_at(F.split("path", "/"), -2).alias("n"), "length")
    size = before.filter("n like 'index%'").agg(F.sum("length")).first()[0]
    freed = writers.removed(spark, folder, "index-*")
    kept = coll.files(spark, folder, "part-*").select(F.element_at(F.split("path", "/"), -2).alias("n")).distinct().count()
    return spark.createDataFrame([(5 - kept, freed >= size > 0, kept)], "gone int, freed boolean, kept int")


# --- page images ---------------------------------------------------------------------------------------------------------------


def _greymap(*pages: np.ndarray) -> bytes:
    return b"".join(b"P5\n# page\n%d %d\n255\n" % (p.shape[1], p.shape[0]) + p.astype(np.uint8).tobytes() for p in pages)


def _page(columns: list[tuple[int, int]], rule: bool = True) -> np.ndarray:
    page = np.full((400, 300), 255, np.uint8)
    for y in range(60, 380, 8):
        for a, b in columns:
            page[y : y + 3, a:b] = 0
    if rule:
        page[30:32, 10:290] = 0
    return page


def _scans(spark: SparkSession) -> DataFrame:
    two, one, blank = _page([(20, 135), (165, 280)]), _page([(20, 280)], rule=False), np.full((50, 60), 255, np.uint8)
    return _files(spark, {"two.pgm": _greymap(two, one), "blank.pgm": _greymap(blank), "tilted.pgm": _greymap(images.rotated(one, 2.0))})


@query("""select * from (values ('two.pgm', 0, 0, 151, true, false, 0), ('two.pgm', 0, 1, 149, true, false, 0), ('two.pgm', 1, 0, 300, true, false, 0), ('blank.pgm', 0, 0, 60, false, true, 0), ('tilted.pgm', 0, 0, 300, true, false, -2)) t(path, frame, region, width, inked, whole, tilt)""")
def page_regions(spark, d):
    """IMG1, IMG2, IMG3, SRC7: ink, tilt, and columns from the right without the running header, of every frame."""
    r = images.page_regions(_scans(spark))
    return r.select(F.regexp_extract("path", r"([^/]*)$", 1).alias("path"), "frame", "region", "width", F.col("ink").between(0.2, 0.5).alias("inked"), (F.col("height") == 50).alias("whole"), F.round("skew").cast("int").alias("tilt"))


def _read(change: int):
    """A reader that tells a region's width, and from regions of 300 on disagrees with the others."""

    def read(region: np.ndarray) -> tuple[str, float]:
        if change == 1 and images.skew(region) == 0 and region.shape[1] == 300:
            return "four other words here", 0.5
        return f"region of width {region.shape[1]}", 0.5

    return read


def _silent(region: np.ndarray) -> tuple[str, float]:
    raise OSError("no answer")


@query("""select path, frame, text, cost::double as cost, false as fallback, disputed, plain, plain_cost::double as plain_cost, path = 'blank.pgm' as readable from (values ('two.pgm', 0, 'region of width 151' || chr(10) || chr(10) || 'region of width 149', 2.0, false, 'prepared 0-255' || chr(10) || chr(10) || 'prepared 0-255', 0),
('two.pgm', 1, 'region of width 300', 1.5, false, 'prepared 0-255', 0), ('blank.pgm', 0, '', 0.0, false, '', 0), ('tilted.pgm', 0, 'region of width 300', 1.5, false, 'prepared 0-255', 0)) t(path, frame, text, cost, disputed, plain, plain_cost)""")
def pages_read(spark, d):
    """IMG4, IMG5, AGG15, TXT20: two readers, a third where they disagree, a plain one on prepared regions where none answers; blank pages have no text."""
    scans = _scans(spark)
    read = images.read_pages(scans, [_read(0), _read(1), _read(2)]).drop("error")
    plain = images.read_pages(scans, [_silent], lambda g: f"prepared {g.min()}-{g.max()}").select("path", "frame", F.col("text").alias("plain"), F.col("cost").alias("plain_cost"))
    unread = images.read_pages(scans, [_silent]).select("path", "frame", F.col("error").isNull().alias("readable"))
    out = read.join(plain, ["path", "frame"]).join(unread, ["path", "frame"])
    return out.withColumn("path", F.regexp_extract("path", r"([^/]*)$", 1))


# --- exported editions ----------------------------------------------------------------------------------------------------------


@query("select doc_id % 3 as book_id, doc_id as page, text as body, coalesce(lang, '') as foot from documents")
def edition_pages(spark, d):
    """SRC13: pages as JSON lines, a file per book; documents as pages."""
    folder = _folder(spark)
    docs = table(spark, d, "documents").select((F.col("doc_id") % 3).alias("book"), F.col("doc_id").alias("page"), F.col("text").alias("body"), F.col("lang").alias("foot"))
    for b in range(3):
        docs.filter(F.col("book") == b).drop("book").write.json(f"{folder}/{b}.jsonl")
    return editions.read_pages(spark, f"{folder}/*.jsonl")


def _database(statements: list[str]) -> bytes:
    with closing(sqlite3.connect(":memory:")) as db:
        for x in statements:
            db.execute(x)
        db.commit()
        return db.serialize()


@query("""select * from (values (7, 'جامع الترمذي', '7.db', 's0', 'حكم', 1, '1'), (7, 'جامع الترمذي', '7.db', 's0', 'حكم', 2, '2')) t(book_id, book_name, path, code, label, page, part)""".replace("(7,", "(7::bigint,").replace(", 1, '1')", ", 1::bigint, '1')").replace(", 2, '2')", ", 2::bigint, '2')"))
def edition_catalogue(spark, d):
    """SRC14, JN13, TXT33: a catalogue attached read-only: books of a category that are on disk, their codes and pages."""
    master = _database([
        "create table category (category_id int, category_name text)", "insert into category values (1, 'كتب السنة'), (2, 'اللغة')", "create table book (book_id int, book_name text, book_category int, meta_data text)",
        """insert into book values (7, 'جامع الترمذي', 1, '{"shorts": {"s0": "حكم"}}'), (8, 'غائب', 1, null), (9, 'كتاب نحو', 2, null)""",
    ])
    pages = _database(["create table page (id int, part text)", "insert into page values (2, '2'), (1, '1')"])
    found = _files(spark, {"master.db": master, "7.db": pages, "9.db": pages})
    t = editions.catalogue(found)
    disk = found.select(F.expr("try_cast(regexp_extract(path, '([0-9]+)[.]db$', 1) as long)").alias("book_id"), F.regexp_extract("path", r"([^/]*)$", 1).alias("path")).filter("book_id is not null")
    have = editions.installed(t["books"].drop("path"), t["categories"].drop("path"), disk, "كتب السنة")
    parts = t["parts"].withColumn("path", F.regexp_extract("path", r"([^/]*)$", 1))
    return have.select("book_id", "book_name", "path", F.explode("shorts").alias("code", "label")).join(parts, "path").select("book_id", "book_name", "path", "code", "label", "page", "part")


# --- uploads, services, progress ---------------------------------------------------------------------------------------------------


@query("""select * from (values ('a.json', 'ready', 2::bigint, null, 3::bigint, 2::bigint), ('b.txt', 'ready', 2, null, 2, 2), ('c.txt', 'failed', 0, 'nothing to index', 0, 0), ('d.bin', 'failed', 0, 'unsupported file', 0, 0)) t(filename, status, chunks, error, vectors, texts)""")
def library_uploaded(spark, d):
    """SNK1, SNK3, SNK17, SNK20, SNK21, PRJ5-7, EMB1, VEC4, STR5: files uploaded, one of them again with new content, another one deleted."""
    library = Library(spark, _folder(spark))
    long = "حدثنا زيد بن خالد، عن نافع، عن ابن عمر، قال سمعت رسول الله صلى الله عليه وسلم يقول من حفظ لسانه سلم قلبه وطاب يومه كله واستراح"
    records = f'[{{"id": "1", "text": "{long}", "topic": "باب"}}, {{"id": "2", "text": "نص قصير عن الرفق بالناس"}}]'
    library.add(_files(spark, {"a.json": records.encode(), "b.txt": b"An older passage that goes away.", "e.txt": b"A passage of a source that is deleted."}))
    library.add(_files(spark, {"b.txt": b"A first passage about rivers.\n\nA second one about houses.", "c.txt": b" \n", "d.bin": b"x"}))
    library.delete("e.txt")
    count = lambda name, out: library.read(name).groupBy(F.col("source").alias("filename")).agg(F.count(F.lit(1)).alias(out))
    rows = library.read("sources").join(count("items", "vectors"), "filename", "left").join(count("passages", "texts"), "filename", "left")
    return rows.select("filename", "status", "chunks", "error", F.coalesce("vectors", F.lit(0)).alias("vectors"), F.coalesce("texts", F.lit(0)).alias("texts")).withColumns({k: F.col(k).cast("long") for k in ("vectors", "texts")})


def _service():
    """Replies like a service: out of order, as base64 or lists, and refuses every fourth request."""
    made, calls = vectors.bag_of_characters(), [0]

    def send(texts: list[str]) -> dict:
        calls[0] += 1
        if calls[0] % 4 == 2:
            raise vectors.Refused(0.001)
        data = [{"index": i, "embedding": base64.b64encode(struct.pack(f"<{len(v)}f", *v)).decode() if calls[0] % 2 else [2 * float(x) for x in v]} for i, v in enumerate(made(texts))]
        return {"data": data[::-1]}

    return vectors.provider(send, 64, batch=5, at_once=3, sleep=lambda s: time.sleep(0.001))()


@query("select item_id, true as same from benchmark")
def service_texts(spark, d):
    """SRC16, EMB1, EMB2, EMB3, EMB5: vectors of a service that refuses, answers out of order and in two forms, are those of the embedder behind it."""
    b = table(spark, d, "benchmark").select("item_id", "text")
    both = vectors.embed(vectors.embed(b, vec="v", make=_service), vec="w")
    return both.select("item_id", (F.aggregate(F.zip_with("v", "w", lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, x: s + x) < 1e-4).alias("same"))


@query("select count(*)::bigint as rows, true as told from events")
def stream_progress(spark, d):
    """STR6: the rows of a stream as its progress tells them, seldom in between and always at the end."""
    folder, told = _folder(spark), []
    table(spark, d, "events").select("event_id").repartition(4).write.parquet(f"{folder}/in")
    progress = st.Progress(told.append, every=3600.0)
    spark.streams.addListener(progress)
    try:
        st.run_to_end(st.read(spark, f"{folder}/in", spark.read.parquet(f"{folder}/in").schema, files_per_trigger=1), f"{folder}/out", f"{folder}/state")
        for _ in range(300):  # listeners are told a moment later
            if len(told) >= 2 and told[-1] == progress.rows and progress.ended:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(progress)
    return spark.createDataFrame([(progress.rows, len(told) == 2)], "rows long, told boolean")
