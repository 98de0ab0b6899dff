"""A library of sources: upload, search, topics, events, reports, lifecycle, over versioned tables in one folder.

The tables are `items` (one row per vector: id, source, type, part, metadata, vector), `passages` (one row per stored text, with the body that
phrases are looked up in), `sources` and `events`. An upload writes texts before vectors, and a source's previous generation goes only when the new
one is complete; readers keep to published versions. Everything is a DataFrame: a batch of searches is one plan.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.functions.scalars import source_digest
from tessera.operators import books, chains, passages, quotes, ranking, registry, reports, subjects, vectors
from tessera.session import ready
from tessera.sources import collections as coll
from tessera.sources import documents, writers

META = "struct<type:string,source:string,reference:string,record_id:string,hukm:string,mohaddith:string,sanad:string,topic:string,chunk_index:int>"
ITEMS = f"id string, source string, type string, part string, owner string, metadata {META}, vec array<float>"
PASSAGES = "rowid long, item_id string, source string, text string, body string"
SOURCES = "filename string, kind string, status string, chunks long, characters long, error string, uploaded_at timestamp"
EVENTS = "type string, visitor_hash string, query string, result string, latency_ms int, created_at timestamp"


class Library:
    """make: builds an embedder per task (EMB1); dim: its dimension; salt: of visitors' hashes; instructions: put before queries and before
    titles searched for, for models that take them (EMB4; see operators.vectors). model: its name, kept with the vectors; a library refuses
    vectors of another model or dimension (VEC4)."""

    def __init__(self, spark: SparkSession, path: str, make: Callable[[], vectors.Embedder] = vectors.bag_of_characters, dim: int = 64, salt: str = "salt", query_instruction: str = "", title_instruction: str = "", model: str = "bag of characters"):
        self.spark, self.path, self.make, self.dim, self.salt = ready(spark), path.rstrip("/"), make, dim, salt
        self.query_instruction, self.title_instruction, self.model = query_instruction, title_instruction, model
        self.catalog = registry.Catalog(spark, self.path)

    def read(self, name: str) -> DataFrame:
        schema = {"items": ITEMS, "passages": PASSAGES, "sources": SOURCES}[name]
        found = self.catalog.read(name)
        return found if found is not None else self.spark.createDataFrame([], schema)

    # --- uploads (SRC1, PRJ5-7, SNK1-3, SNK20-21, STR5, STR7) ---

    def add(self, files: DataFrame) -> DataFrame:
        """SNK21: files (path, length, content) become the next generation of their sources; (filename, ok, chunks, error) per file.

        A file that cannot be read, or holds nothing to index, fails on its own: its previous generation stays. Texts, vectors and sources are published
        at once (SNK3), after the library has made sure that its vectors are of this model (SNK1, VEC4) and that there is room for them (SNK17)."""
        vectors.same_model(self.read("items"), self.model, self.dim)
        named = files.select(F.regexp_extract("path", r"([^/]*)$", 1).alias("file"), "path", "length", "content").withColumn("how", coll.kind("path"))
        items = self._record_items(named).unionByName(self._document_items(named))
        vectors_ = vectors.checked(vectors.embed(items, "embed", "vec", self.make), self.dim).drop("embed")
        made = registry.Versions(self.spark, f"{self.path}/_upload", grace=3600)
        made.publish(vectors_)  # computed once; an error here leaves every published table as it was
        new = made.read()
        needed, free = passages.size_estimate(new, self.dim).first()["bytes"] or 0, self.catalog.free_bytes()
        if needed > free:
            raise ValueError(f"the upload needs about {needed / 2**20:.0f} MB, and {free / 2**20:.0f} MB are free")
        done = new.groupBy("source").agg(F.count_if(F.col("part") != "matn").alias("chunks"), F.sum(F.length("text")).alias("characters"))
        result = named.select(F.col("file").alias("filename"), "how").join(done, F.col("filename") == done["source"], "left")
        result = result.select("filename", F.when(F.col("how") == "structured", "structured_hadith").otherwise("document").alias("kind"), F.col("chunks").isNotNull().alias("ok"), F.coalesce("chunks", F.lit(0)).cast("long").alias("chunks"), F.coalesce("characters", F.lit(0)).cast("long").alias("characters"), F.when(F.col("how").isNull(), "unsupported file").when(F.col("chunks").isNull(), "nothing to index").alias("error"))
        last = self.read("passages").agg(F.coalesce(F.max("rowid"), F.lit(-1))).first()[0]
        place = F.row_number().over(W.partitionBy("source").orderBy("pos"))  # numbers within a source; sources follow each other
        texts = new.filter("part <> 'matn'").withColumn("n", place)
        counts, firsts = done.select("source", "chunks").orderBy("source").collect(), []  # one row per uploaded file
        for r in counts:
            firsts.append((r.source, last))
            last += r.chunks
        before = self.spark.createDataFrame(firsts, "source string, first long")
        texts = texts.join(before, "source").select((F.col("n") + F.col("first")).cast("long").alias("rowid"), F.col("id").alias("item_id"), "source", "text")
        next_items = registry.replace_generation(self.read("items"), new.drop("text", "pos"))
        rows = result.select("filename", "kind", F.when(F.col("ok"), registry.READY).otherwise(registry.FAILED).alias("status"), "chunks", "characters", "error", F.current_timestamp().alias("uploaded_at"))
        old = self.read("sources")
        kept = old.join(result.filter("not ok").select("filename"), "filename", "left_semi").filter(F.col("status") == registry.READY)  # a failure keeps the previous version
        new_rows = rows.join(kept.select("filename"), "filename", "left_anti")
        next_sources = old.join(new_rows.select("filename"), "filename", "left_anti").unionByName(new_rows.select(*old.columns))
        next_passages = registry.replace_generation(self.read("passages"), quotes.with_body(texts))
        self.catalog.publish({"passages": next_passages, "items": vectors.with_model(next_items, self.model, self.dim), "sources": next_sources})
        return result

    def _keyed(self, rows: DataFrame, prefix: str) -> DataFrame:
        gen = F.substring(F.sha2(F.concat("source", F.current_timestamp().cast("string")), 256), 1, 8)
        return rows.withColumn("id", F.concat_ws("-", F.lit(prefix), source_digest("source"), gen, "key")).withColumn("owner", ranking.owner("id"))

    def _record_items(self, named: DataFrame) -> DataFrame:
        texts = named.filter("how = 'structured'").select("file", F.col("path"), coll.decoded("content", collection=True).alias("text")).filter("text is not null")
        is_book = F.ltrim("text").startswith("{")
        ext = coll.extension("path")
        arrays = coll.json_records(texts.filter((ext == ".json") & ~is_book))
        none = F.array().cast("array<struct<name:string,grade:string>>")
        books_ = coll.json_books(texts.filter((ext == ".json") & is_book)).filter("kept").withColumns({"source": F.col("title"), "matn": F.lit(""), "sanad": none})
        sheets = coll.csv_records(texts.filter(ext == ".csv")).filter("kept").withColumns({k: F.lit("") for k in ("hukm", "mohaddith", "topic", "matn")} | {"source": F.col("title"), "sanad": none})
        cols = ["file", "pos", "id", "text", "hukm", "mohaddith", "sanad", "topic", "source", "matn"]
        records = coll.with_defaults(arrays.select(*cols).unionByName(books_.select(*cols)).unionByName(sheets.select(*cols)))
        places = records.select("file", F.col("id").alias("record"), "pos")
        made = passages.record_items(records).withColumn("source", F.col("metadata.source")).withColumn("record", F.col("metadata.record_id"))
        made = made.join(places.withColumnRenamed("file", "source"), ["source", "record"]).drop("record")
        return self._shape(self._keyed(made, "hadith"))

    def _document_items(self, named: DataFrame) -> DataFrame:
        whole = documents_text(named)
        chunks = passages.chunked(whole, "file")
        made = chunks.withColumns({"key": F.concat(F.lit("doc"), F.col("chunk_index")), "part": F.lit("full"), "embed": F.col("text"), "pos": F.col("chunk_index"), "metadata": F.struct(F.lit("document").alias("type"), "source", "chunk_index")})
        return self._shape(self._keyed(made, "doc"))

    @staticmethod
    def _shape(rows: DataFrame) -> DataFrame:
        names = [f.split(":")[0] for f in META[7:-1].split(",")]
        kinds = dict(f.split(":") for f in META[7:-1].split(","))
        have = {f.name for f in rows.schema["metadata"].dataType.fields}
        meta = F.struct(*[(F.col(f"metadata.{n}") if n in have else F.lit(None)).cast(kinds[n]).alias(n) for n in names])
        return rows.select("id", "source", F.col("metadata.type").alias("type"), "part", "owner", meta.alias("metadata"), "text", F.col("pos").cast("int").alias("pos"), "embed")

    def delete(self, filename: str) -> None:
        """SNK20."""
        done = registry.delete_source({"items": self.read("items"), "passages": self.read("passages")}, self.read("sources"), filename)
        done["items"] = vectors.with_model(done["items"], self.model, self.dim)
        self.catalog.publish(done)

    def recover(self) -> None:
        """STR7."""
        self.catalog.publish({"sources": registry.recovered(self.read("sources"))})

    def compact(self) -> None:
        """SNK15."""
        self.catalog.compact()

    # --- search (RNK1-6) ---

    def search(self, queries: DataFrame, top_k: int = 5, by_title: bool = False) -> DataFrame:
        """queries: query_id, query. Exact quotes first, in the order of books; then the closest vectors, reordered by shared words for a
        subject, and by the closeness of chapters in a search by title. Each text once."""
        if not 1 <= top_k <= 20:
            raise ValueError("top_k is 1 to 20")
        queries = queries.select("query_id", "query").filter(~tx.blank(tx.clean("query")) & (F.length("query") <= 2000))
        items, texts = self.read("items"), self.read("passages")
        vectors.same_model(items, self.model, self.dim)
        exact = quotes.quotes(queries, texts).join(texts.select("rowid", F.col("item_id").alias("id")), "rowid").select("query_id", "rowid", "id", F.lit(1.0).alias("similarity"))
        q = vectors.embed(queries.select("query_id", tx.clean("query").alias("query")), "query", "vec", self.make, instruction=self.query_instruction).select("query_id", "vec")
        k = ranking.pool(top_k, subject=True, by_title=by_title)
        close = vectors.nearest(q, items, k).select("query_id", "id", "similarity", "pos")
        plain = ranking.pool(top_k, subject=False)
        close = close.join(queries.select("query_id", "query", tx.is_subject("query").alias("subject")), "query_id").filter(F.col("subject") | F.lit(by_title) | (F.col("pos") <= plain))
        meta = items.select("id", "owner", "source", "type", "metadata")
        stored = texts.select(F.col("item_id").alias("owner"), "text")
        close = close.join(meta, "id").join(stored, "owner", "left")
        exact = exact.join(meta, "id").join(stored, "owner", "left")
        share = subjects.title_share("query", "text", "metadata.topic") if by_title else subjects.overlap("query", "text")
        close = close.withColumn("share", share)
        if by_title:
            close = close.withColumn("topic", F.col("metadata.topic")).join(self._chapters(queries, close), ["query_id", "topic"], "left")
            close = close.withColumn("score", ranking.score("similarity", "share", "closeness", by_title=True))
        else:
            close = close.withColumn("score", F.when(F.col("subject"), ranking.score("similarity", "share")).otherwise(F.col("similarity")))
        key = ranking.text_key("type", "source", "metadata.record_id", "id")
        name = F.coalesce(F.nullif(F.col("metadata.reference"), F.lit("")), F.col("source"))
        pick = lambda df, place: df.select("query_id", key.alias("key"), "id", "text", "similarity", "metadata", "type", place.alias("place"))
        hits = ranking.merged(pick(exact, F.struct(books.rank(name).cast("double").alias("a"), F.col("rowid").alias("b"))), pick(close, F.struct((-F.col("score")).alias("a"), F.col("pos").cast("long").alias("b"))), top_k)
        hits = hits.join(queries, "query_id").withColumn("word_overlap", tx.word_overlap("query", "text"))
        flat = hits.select("query_id", "rank", "id", "text", "similarity", "word_overlap", "type", "metadata.hukm", "metadata.mohaddith", "metadata.topic", books.title("metadata.reference").alias("reference"), "metadata.source", "metadata.sanad")
        return ranking.projected(flat).join(flat.select("query_id", "rank", "sanad", books.credit("reference").alias("compiler")), ["query_id", "rank"])

    def _chapters(self, queries: DataFrame, close: DataFrame) -> DataFrame:
        """VEC5: query_id, topic, closeness, for the topics of the candidates."""
        topics = close.select(F.col("metadata.topic").alias("topic")).distinct().filter(~tx.blank("topic") & tx.names_a_subject("topic"))
        titles = vectors.embed(topics.withColumn("clean", tx.clean("topic")), "clean", "vec", self.make)
        q = vectors.embed(queries.select("query_id", tx.clean("query").alias("query")), "query", "qvec", self.make, instruction=self.title_instruction).select("query_id", "qvec")
        pairs = close.select("query_id", F.col("metadata.topic").alias("topic")).distinct().join(titles, "topic").join(q, "query_id")
        return pairs.select("query_id", "topic", vectors.dot("vec", "qvec").alias("closeness"))

    def trees(self, hits: DataFrame) -> DataFrame:
        """GRF7: edges of the trees of hits that are records: query_id#rank as id."""
        from tessera.functions.scalars import chain_array

        rows = hits.filter("kind = 'structured_hadith'").select(F.concat_ws("#", "query_id", "rank").alias("id"), "text", chain_array("sanad").alias("sanad"), "source")
        return chains.trees(rows)

    def topics(self) -> DataFrame:
        """AGG7."""
        rows = self.read("items").select("type", F.col("metadata.topic").alias("topic"), F.col("id").alias("ord"))
        return registry.topics(rows).select("topic", "n")

    # --- events and reports (SNK9, AGG1-5) ---

    def record(self, raw: DataFrame) -> None:
        """SNK9, STR1."""
        writers.append_events(writers.prepared_events(raw, self.salt), f"{self.path}/events")

    def events(self) -> DataFrame:
        return self.spark.read.schema(EVENTS).parquet(f"{self.path}/events")

    def report(self, first: date, last: date, hours: int = 3) -> dict[str, DataFrame]:
        """The parts of a report; each is a small table."""
        rows = reports.in_range(self.events(), first, last, hours)
        return {
            "totals": reports.totals(rows), "daily": reports.calendar(reports.daily(rows, hours), first, last), "searches": reports.top_queries(rows, "search"),
            "questions": reports.top_queries(rows, "chat"), "outcomes": reports.outcomes(rows), "sources": reports.source_totals(self.read("sources")), "uploads": reports.uploads(self.read("sources"), first, last, hours),
        }


def documents_text(named: DataFrame) -> DataFrame:
    """file, text of the documents that hold text, blocks joined in order (TXT21)."""
    from tessera.operators.readings import joined

    blocks = documents.blocks(named.select("path", "content")).filter("text is not null")
    return joined(blocks, "path").select(F.regexp_extract("path", r"([^/]*)$", 1).alias("file"), "text")
