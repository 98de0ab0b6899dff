"""Queries of sources, accounts, files and results: what the other plans do not show (see queries.py for the mappings)."""

from __future__ import annotations

import time
import uuid
from datetime import date

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tessera.functions import passwords
from tessera.functions import text as tx
from tessera.functions.scalars import valid_password, valid_username
from tessera.operators import quotes, ranking, registry, reports, sequence, vectors
from tessera.plans.queries import _DOT, _NORM_WORDS, _SOURCES, Query, _sources, _vectors
from tessera.session import shared_folder, table
from tessera.sources import collections as coll
from tessera.sources import editions, writers

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
    return f"{shared_folder(spark)}/plan-{uuid.uuid4().hex}"


# --- results ---------------------------------------------------------------------------------------------------------------


@query("""select 1 as query_id, doc_id::int as rank, doc_id::varchar as id, text, round(least(1, greatest(0, n_chars / 1000 - 1)), 4) as similarity, 0.5::double as word_overlap, 'document' as kind, nullif(case when doc_id % 2 = 0 then lang else '' end, '') as hukm, null::varchar as mohaddith, lang as topic, case when doc_id % 3 = 0 then 'ref' else source end as source from documents""")
def result_fields(spark, d):
    """PRJ1, PRJ2, RNK4: the fields of a result, empty ones null."""
    docs = table(spark, d, "documents")
    hits = docs.select(F.lit(1).alias("query_id"), F.col("doc_id").cast("int").alias("rank"), F.col("doc_id").cast("string").alias("id"), "text", (F.col("n_chars") / 1000 - 1).alias("similarity"), F.lit(0.5).alias("word_overlap"), F.lit(None).cast("string").alias("type"), F.when(F.col("doc_id") % 2 == 0, F.col("lang")).otherwise("").alias("hukm"), F.lit("").alias("mohaddith"), F.col("lang").alias("topic"), F.when(F.col("doc_id") % 3 == 0, "ref").otherwise("").alias("reference"), "source")
    return ranking.projected(hits)


@query(f"""with t as (select label, min_by(embedding, vec_id) as e from embeddings group by label), q as (select embedding as e from embeddings where vec_id = 7),
c as (select 'label ' || label as topic, {_DOT.format(a='t.e', b='q.e')} as closeness from t, q),
s as (select v.vec_id as id, 'label ' || v.label as topic, greatest(0, {_DOT.format(a='v.embedding', b='q.e')}) as similarity from embeddings v, q order by similarity desc, id limit 100)
select id, s.topic, round(similarity + (id % 7) / 10 + 0.8 * coalesce(closeness, 0), 6) as score from s left join c on c.topic = s.topic and c.topic <> 'label 3'""")
def chapter_rank(spark, d):
    """JN6, RNK2, RNK3, RNK5: candidates with the closeness of their chapters; 0 where a chapter is not known."""
    v = _vectors(spark, d)
    q = v.filter("id = 7").select("vec").first()[0]
    titles = v.groupBy("label").agg(F.min_by("vec", "id").alias("vec")).select(F.concat(F.lit("label "), "label").alias("topic"), "vec").filter("topic <> 'label 3'")
    close = vectors.nearest_to(v, q, ranking.pool(5, True, True)).join(v.select("id", F.concat(F.lit("label "), "label").alias("topic")), "id")
    ranked = close.join(vectors.title_closeness(titles, q), "topic", "left").withColumn("share", F.col("id") % 7 / 10)
    return ranked.select("id", "topic", F.round(ranking.score("similarity", "share", "closeness", by_title=True), 6).alias("score"))


@query("select p_partkey, p_name from part where contains(lower(p_name), 'ring')")
def name_filter(spark, d):
    """FLT11: a part of a name, without letter case."""
    return table(spark, d, "part").filter(F.contains(F.lower("p_name"), F.lower(F.lit("RING")))).select("p_partkey", "p_name")


@query(rf"""with b as (select doc_id as rowid, array_to_string(list_transform({_NORM_WORDS.format(c="lower(replace(text, chr(95), chr(32)))")}, lambda w: w), ' ') as body from documents) select rowid, md5(body) as body_md5 from b""")
def index_rebuilt(spark, d):
    """STR8, OPT17: the derived column of stored texts, made anew."""
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("rowid"), "text")
    return quotes.with_body(rows).select("rowid", F.md5("body").alias("body_md5"))


# --- text keys ---------------------------------------------------------------------------------------------------------------


@query("select l_orderkey, l_linenumber, l_partkey, l_quantity::int as n from lineitem")
def digits_read(spark, d):
    """TXT27: Arabic digits as numbers."""
    arabic = F.translate(F.col("l_quantity").cast("int").cast("string"), "0123456789", "٠١٢٣٤٥٦٧٨٩")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", tx.digits_to_ascii(arabic).cast("int").alias("n"))


@query(r"select doc_id, case when trim(text) = '' then 'layer' when length(regexp_replace(text, '[^A-Za-z]', '', 'g')) > 0 then 'layer' else text end as chosen, trim(regexp_extract(text, '^[^ ]*'), ' ،,.:؛') as key from documents")
def layers_chosen(spark, d):
    """TXT28, TXT32: a reading with more Latin letters than its layer is not taken."""
    docs = table(spark, d, "documents")
    layer = F.lit("طبقة")
    chosen = F.when(tx.choose_layer("text", layer) == layer, "layer").otherwise(F.col("text"))
    return docs.select("doc_id", chosen.alias("chosen"), tx.bare(F.regexp_extract("text", "^[^ ]*", 0)).alias("key"))


@query("select p_partkey as id, 's' || (p_partkey % 10) as code, p_name as label from part where p_partkey % 5 = 0 union all select p_partkey, 'x', p_brand from part where p_partkey % 5 = 0")
def edition_codes(spark, d):
    """TXT33: codes in an edition's metadata; none where it is malformed, missing, empty or of another shape. Parts as editions."""
    k = F.col("p_partkey") % 5
    codes = F.to_json(F.struct(F.create_map(F.concat(F.lit("s"), (F.col("p_partkey") % 10).cast("string")), F.col("p_name"), F.lit("x"), F.col("p_brand")).alias("shorts"), F.lit(1).alias("other")))
    meta = F.when(k == 0, codes).when(k == 1, F.concat(F.lit("{"), "p_name")).when(k == 2, F.lit("{}")).when(k == 3, F.lit('{"shorts": 5}'))
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.explode(editions.shorts(meta)).alias("code", "label"))


@query("select page_id, case when ext in ('.json', '.csv') then 'structured' when ext = '.pdf' then 'pdf' when ext = '.docx' then 'docx' when ext in ('.txt', '.md') then 'text' when ext in ('.png', '.jpg') then 'image' end as kind from (select page_id, lower(regexp_extract(name, '(\\.[^./]*)$', 1)) as ext from (select page_id, 'dir.x/' || page_id || ['.JSON', '.csv', '.pdf', '.Txt', '.md', '.exe', '.tar.docx', '', '.', '.PNG', '.jpg', '.csv.bak'][(page_id % 12 + 1)::int] as name from pages))")
def file_kinds(spark, d):
    """SRC1, SRC2, SET6: how a file is read, by its name."""
    forms = (".JSON", ".csv", ".pdf", ".Txt", ".md", ".exe", ".tar.docx", "", ".", ".PNG", ".jpg", ".csv.bak")
    name = F.concat(F.lit("dir.x/"), F.col("page_id").cast("string"), F.element_at(F.array(*map(F.lit, forms)), (F.col("page_id") % 12 + 1).cast("int")))
    return table(spark, d, "pages").select("page_id", coll.kind(name).alias("kind"))


@query(r"select c_custkey, regexp_full_match(n, '[A-Za-z0-9_.-]{3,32}') as name_ok, length(n) >= 8 as password_ok from (select c_custkey, case c_custkey % 4 when 0 then c_name when 1 then replace(c_name, '#', '_') when 2 then 'ab' else 'user.' || c_custkey end as n from customer)")
def account_rules(spark, d):
    """FLT12."""
    m = F.col("c_custkey") % 4
    n = F.when(m == 0, F.col("c_name")).when(m == 1, F.replace("c_name", F.lit("#"), F.lit("_"))).when(m == 2, "ab").otherwise(F.concat(F.lit("user."), F.col("c_custkey").cast("string")))
    return table(spark, d, "customer").select("c_custkey", valid_username(n).alias("name_ok"), valid_password(n).alias("password_ok"))


# --- accounts and sessions -----------------------------------------------------------------------------------------------------


def _accounts(spark, d):
    admins = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("username"))
    sessions = table(spark, d, "events").filter("event_type = 'signup'").select(F.concat(F.lit("t"), "event_id").alias("token_hash"), F.col("user_id").alias("admin_id"), F.col("ts").alias("expires_at"))
    return admins, sessions


@query("select 't' || event_id as token_hash, user_id as admin_id, c_name as username from events join customer on c_custkey = user_id where event_type = 'signup' and user_id <> 7")
def account_deleted(spark, d):
    """SNK5: an account and its sessions go."""
    admins, sessions = registry.delete_account(*_accounts(spark, d), 7)
    return sessions.join(admins, F.col("admin_id") == F.col("id")).select("token_hash", "admin_id", "username")


@query("select 't' || event_id as token_hash from events where event_type = 'signup' and (user_id <> 7 or event_id = (select min(event_id) from events where event_type = 'signup' and user_id = 7))")
def sessions_ended(spark, d):
    """SNK19: an account's other sessions end."""
    _, sessions = _accounts(spark, d)
    keep = sessions.filter("admin_id = 7").agg(F.min_by("token_hash", F.substring("token_hash", 2, 20).cast("long"))).first()[0]
    return registry.end_sessions(sessions, 7, keep=keep or "none").select("token_hash")


@query("select c_custkey as id, c_name as username, true as active, 3 as visits from customer union all select 999999999, 'new user', true, 3")
def account_added(spark, d):
    """SNK18, SNK23: a new account under a free name; a column added with its default."""
    admins, _ = _accounts(spark, d)
    new = spark.createDataFrame([(999_999_999, "new user")], "id long, username string")
    return registry.with_missing_columns(registry.insert_unique(admins, new, F.lower("username"), "the name"), {"active": F.lit(True), "username": F.lit("kept as it is"), "visits": F.lit(3)})


@query("select min(c_custkey) as id, min_by(c_name, c_custkey) as username from customer")
def account_oldest(spark, d):
    """ORD7, FLT16."""
    admins, _ = _accounts(spark, d)
    return registry.one(admins, F.col("id") == registry.oldest(admins).first()[0])


@query("select event_id, floor(epoch(ts + interval 12 hour))::bigint as expires from events where event_type = 'signup'")
def session_expiry(spark, d):
    """SCL4."""
    e = table(spark, d, "events").filter("event_type = 'signup'")
    return e.select("event_id", F.unix_seconds((F.col("ts") + F.make_interval(hours=F.lit(12))).cast("timestamp")).alias("expires"))


@query("select '2024-01-01' as first, '2024-01-30' as last, count(*) as n from events where ts >= timestamp '2023-12-31 21:00:00' and ts < timestamp '2024-01-30 21:00:00'")
def default_range(spark, d):
    """SCL2, SCL3, OPT1: the thirty local days that end on a day."""
    a, b = reports.default_range(date(2024, 1, 30))
    return reports.in_range(table(spark, d, "events"), a, b, ts="ts").agg(F.lit(str(a)).alias("first"), F.lit(str(b)).alias("last"), F.count(F.lit(1)).alias("n"))


# --- sources and files ---------------------------------------------------------------------------------------------------------


@query("select count(*) as uploads from orders where o_orderstatus = 'F' and o_orderdate >= timestamp '1997-01-31 21:00:00' and o_orderdate < timestamp '1997-06-30 21:00:00'")
def uploads_in_period(spark, d):
    """AGG5, FLT3: orders as uploads."""
    rows = table(spark, d, "orders").select(F.when(F.col("o_orderstatus") == "F", "ready").otherwise("failed").alias("status"), F.col("o_orderdate").alias("uploaded_at"))
    return reports.uploads(rows, date(1997, 2, 1), date(1997, 6, 30))


@query("select c_name as filename, c_custkey as id from customer where c_custkey % 3 = 0 order by c_custkey % 10 desc, c_custkey limit 25")
def sources_listed(spark, d):
    """ORD1: ready sources, the newest first; customers as sources, the first twenty-five."""
    rows = table(spark, d, "customer").select(F.col("c_name").alias("filename"), F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 3 == 0, "ready").otherwise("failed").alias("status"), (F.col("c_custkey") % 10).alias("uploaded_at"))
    return registry.listed(rows, ready_only=True).limit(25).select("filename", "id")


@query("select doc_id, source from documents where source <> 'src2'")
def source_deleted(spark, d):
    """SNK4, SNK20: a source goes from every table."""
    rows = table(spark, d, "documents").select("doc_id", "source")
    sources = _sources(spark, d).withColumn("status", F.lit("ready"))
    return registry.delete_source({"items": rows}, sources, "src2")["items"]


@query("select conv_id, turn, (row_number() over (partition by conv_id order by turn // 2, role <> 'assistant', turn))::int as place from conversations")
def marks_ordered(spark, d):
    """ORD10: marks in order of place, ends first."""
    c = table(spark, d, "conversations")
    return sequence.blocks(c, ["conv_id"], [F.floor(F.col("turn") / 2), F.col("role") != "assistant", "turn"], 10).select("conv_id", "turn", F.col("ordinal").alias("place"))


@query("select n_nationkey, n_name from nation")
def version_compacted(spark, d):
    """SNK3, SNK15, OPT16: a table published twice, compacted and read."""
    v = registry.Versions(spark, _folder(spark))
    n = table(spark, d, "nation").select("n_nationkey", "n_name")
    v.publish(n.limit(3))
    v.publish(n.repartition(4))
    v.compact()
    return v.read()


@query("select n_nationkey, n_name from nation where n_nationkey >= 20")
def table_emptied(spark, d):
    """SNK16: a table is emptied, and takes new rows in its old columns."""
    n = table(spark, d, "nation").select("n_nationkey", "n_name")
    return writers.emptied(n).unionByName(n.filter("n_nationkey >= 20"))


@query("select conv_id || '/' || turn as conv_id, replace(replace(text, chr(10), ' '), chr(13), ' ') as text from conversations")
def files_round_trip(spark, d):
    """SNK10, SNK11, SNK13: rows written as JSON, sheets and text, and read again."""
    folder = _folder(spark)
    rows = table(spark, d, "conversations").select(F.concat_ws("/", "conv_id", "turn").alias("conv_id"), F.translate("text", "\n\r", "  ").alias("text"))
    writers.records_json(rows, f"{folder}/json")
    writers.sheets({"sheet": spark.read.schema(rows.schema).json(f"{folder}/json").select("conv_id")}, folder)
    writers.text_lines(rows, f"{folder}/text")
    same = spark.read.text(f"{folder}/text").select(F.col("value").alias("text")).distinct()
    ids = spark.read.option("header", True).schema("conv_id string").csv(f"{folder}/sheet")
    return spark.read.schema(rows.schema).json(f"{folder}/json").join(same, "text").join(ids, "conv_id").select("conv_id", "text")


@query("select * from (values (0, 'tables', 'true', 'found', true), (1, 'key', 'unknown', 'not set', true), (2, 'short key', 'false', 'too short', true), (3, 'site', 'false', 'OSError: no route', true), (4, 'slow', 'true', 'answered', true)) t(place, name, ok, detail, timed)")
def health_checks(spark, d):
    """AGG16, FLT12: probes in a fixed order, those of other services side by side; a failure is a row; each is timed."""

    def site():
        raise OSError("no route")

    def slow():
        time.sleep(0.05)
        return True, "answered"

    n = table(spark, d, "nation")
    keys = n.select(passwords.site_key_ok(F.lit("")).alias("unset"), passwords.site_key_ok(F.lit("short")).alias("short")).first()
    found = reports.checks({"tables": lambda: (n.count() > 0, "found"), "key": lambda: (keys.unset, "not set"), "short key": lambda: (keys.short, "too short")}, {"site": site, "slow": slow})
    rows = [(i, name, "unknown" if ok is None else str(ok).lower(), detail, seconds >= (0.05 if name == "slow" else 0)) for i, (name, ok, detail, seconds) in enumerate(found)]
    return spark.createDataFrame(rows, "place int, name string, ok string, detail string, timed boolean")


@query("select n_nationkey, true as own, false as other, false as broken, sha256(n_name) as token, length(n_name) >= 10 as site_key from nation")
def passwords_checked(spark, d):
    """SCL6, FLT12: a hash accepts its own password only; tokens are stored as digests."""
    n = table(spark, d, "nation").select("n_nationkey", "n_name", passwords.password_hash("n_name").alias("h"))
    return n.select("n_nationkey", passwords.password_matches("n_name", "h").alias("own"), passwords.password_matches(F.concat("n_name", F.lit("x")), "h").alias("other"), passwords.password_matches("n_name", F.lit("scrypt$1$2")).alias("broken"), passwords.token_hash("n_name").alias("token"), passwords.site_key_ok("n_name", 10).alias("site_key"))


@query("select c_custkey as id, case when c_custkey = 7 then 'new' else 'old' end as password_hash, c_custkey <> 7 and c_custkey % 2 = 0 as must_change_password, count(event_id) as sessions from customer left join (select event_id, user_id from events where event_type = 'signup' and (user_id <> 7 or event_id = (select min(event_id) from events where event_type = 'signup' and user_id = 7))) e on e.user_id = c_custkey group by all")
def password_changed(spark, d):
    """SNK19: an account's new password, and its other sessions ended."""
    admins, sessions = _accounts(spark, d)
    keep = sessions.filter("admin_id = 7").agg(F.min_by("token_hash", F.substring("token_hash", 2, 20).cast("long"))).first()[0]
    admins = admins.select("id", F.lit("old").alias("password_hash"), (F.col("id") % 2 == 0).alias("must_change_password"))
    admins, sessions = registry.with_password(admins, sessions, 7, "new", keep or "none")
    counts = sessions.groupBy(F.col("admin_id").alias("id")).agg(F.count(F.lit(1)).alias("sessions"))
    return admins.join(counts, "id", "left").withColumn("sessions", F.coalesce("sessions", F.lit(0)).cast("long"))


@query("select c_custkey as id, c_name as username, false as must_change_password from customer union all select -2, 'second', true")
def account_bootstrapped(spark, d):
    """SNK18: the first account is made only where there is none: the full table stays as it is, the empty one gets it."""
    admins = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("username"), F.lit(False).alias("must_change_password"))
    new = lambda i, name: spark.createDataFrame([(i, name)], "id long, username string")
    return registry.bootstrapped(admins, new(-1, "first")).unionByName(registry.bootstrapped(admins.limit(0), new(-2, "second")))
