"""Sources and their lifecycle as tables: generations, upserts, guarded updates, deletes, accounts (SNK1-9, SNK15-23, SRC17-18, JN2, JN14, FLT1,
FLT4, FLT16, ORD1, ORD7, AGG6-8, SCL4, SCL8, STR5, STR7).

Tables are immutable DataFrames; an operation returns the next version. Versions are published by writing them and then one small manifest of a
new number, so readers see whole versions of all tables only.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.scalars import source_digest

READY, BUSY, FAILED = "ready", "processing", "failed"


# --- versions on disk --------------------------------------------------------------------------------------------------


class Conflict(RuntimeError):
    """Someone else published in between."""


class Catalog:
    """SNK3/SNK15/SNK16/STR8: tables as folders of their versions, and numbered manifests that name the current version of every table at once.

    A manifest is written beside its place and renamed to the next number, which is not there yet; nothing is ever replaced, so a reader finds the
    highest number and with it a whole, consistent set of tables, before, during and after a publish. Tables are written first: where one fails,
    those of the same publish are removed and no manifest is written. Versions stay for `grace` seconds after they are out of date, so plans that
    read them can end."""

    def __init__(self, spark: SparkSession, path: str, grace: float = 86_400):
        self.spark, self.path, self.grace = spark, path.rstrip("/"), grace

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{path}")
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _numbers(self) -> list[int]:
        fs, p = self._fs("_manifests")
        return sorted(int(x.getPath().getName()) for x in fs.listStatus(p) if x.getPath().getName().isdigit()) if fs.exists(p) else []

    def _manifest(self, number: int) -> dict[str, str]:
        fs, p = self._fs(f"_manifests/{number:012d}")
        stream = fs.open(p)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def current(self) -> dict[str, str]:
        """Version by table; empty where nothing was published."""
        numbers = self._numbers()
        return self._manifest(numbers[-1]) if numbers else {}

    def read(self, table: str) -> DataFrame | None:
        version = self.current().get(table)
        return self.spark.read.parquet(f"{self.path}/{table}/{version}") if version else None

    def publish(self, tables: dict[str, DataFrame], partition: str | None = None, files: int | None = None) -> dict[str, str]:
        """Writes new versions of these tables and makes all of them current at once."""
        numbers, version = self._numbers(), uuid.uuid4().hex[:12]
        try:
            for name, df in tables.items():
                w = (df.coalesce(files) if files else df).write
                (w.partitionBy(partition) if partition else w).parquet(f"{self.path}/{name}/{version}")
            manifest = (self._manifest(numbers[-1]) if numbers else {}) | dict.fromkeys(tables, version)
            self._commit(numbers[-1] + 1 if numbers else 0, manifest)
        except BaseException:
            for name in tables:
                self._remove(f"{name}/{version}")
            raise
        self.vacuum()
        return manifest

    def _commit(self, number: int, manifest: dict[str, str]) -> None:
        fs, to = self._fs(f"_manifests/{number:012d}")
        _, new = self._fs(f"_manifests/_{uuid.uuid4().hex}")
        stream = fs.create(new, False)
        try:
            stream.write(bytearray(json.dumps(manifest).encode()))
        finally:
            stream.close()
        if fs.exists(to) or not fs.rename(new, to):
            fs.delete(new, False)
            raise Conflict(f"version {number} of {self.path} is there already")

    def vacuum(self, grace: float | None = None) -> int:
        """Removes manifests that have been out of date for `grace` seconds, and versions that no remaining manifest names; how many versions went."""
        grace, numbers, gone = self.grace if grace is None else grace, self._numbers(), 0
        fs, _ = self._fs("_manifests")
        for old, after in zip(numbers, numbers[1:]):
            since = fs.getFileStatus(self._fs(f"_manifests/{after:012d}")[1]).getModificationTime() / 1000
            if time.time() - since >= grace:
                kept = {(t, v) for n in numbers if n > old for t, v in self._manifest(n).items()}
                for t, v in self._manifest(old).items():
                    if (t, v) not in kept:
                        self._remove(f"{t}/{v}")
                        gone += 1
                self._remove(f"_manifests/{old:012d}")
        return gone

    def compact(self, tables: list[str] | None = None, file_bytes: int = 128 << 20) -> dict[str, str]:
        """SNK15: rewrites tables as files of about `file_bytes`."""
        done = self.current()
        for name in tables if tables is not None else list(done):
            if name in done:
                fs, p = self._fs(f"{name}/{done[name]}")
                done = self.publish({name: self.read(name)}, files=max(1, -(-fs.getContentSummary(p).getLength() // file_bytes)))
        return done

    def _remove(self, path: str) -> None:
        fs, p = self._fs(path)
        fs.delete(p, True)

    def free_bytes(self) -> int:
        fs, p = self._fs("")
        fs.mkdirs(p)
        return fs.getStatus(p).getRemaining()


class Versions:
    """A catalogue of one table."""

    def __init__(self, spark: SparkSession, path: str, grace: float = 86_400):
        self.catalog = Catalog(spark, path, grace)

    def read(self) -> DataFrame | None:
        return self.catalog.read("table")

    def publish(self, df: DataFrame, partition: str | None = None, files: int | None = None) -> str:
        return self.catalog.publish({"table": df}, partition, files)["table"]

    def compact(self) -> str | None:
        return self.catalog.compact().get("table")


# --- rows ----------------------------------------------------------------------------------------------------------------


def item_ids(items: DataFrame, prefix: str, source: str, key: str = "key", generation: str | None = None) -> DataFrame:
    """SNK3: ids of a new generation, so two uploads or two books never collide."""
    gen = F.lit(generation or uuid.uuid4().hex[:8])
    return items.withColumn("id", F.concat_ws("-", F.lit(prefix), source_digest(source), gen, F.col(key).cast("string"))).withColumn("generation", gen)


def replace_generation(stored: DataFrame, new: DataFrame, source: str = "source") -> DataFrame:
    """SNK3/JN14: stored rows without those of the new rows' sources, and the new rows."""
    return stored.join(new.select(source).distinct(), source, "left_anti").unionByName(new.select(*stored.columns))


def upsert(stored: DataFrame, new: DataFrame, key: list[str], order: str) -> DataFrame:
    """SNK1/SNK6: of each key the row with the largest `order`, new rows first among equals."""
    both = stored.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    n = F.row_number().over(W.partitionBy(*key).orderBy(F.desc(order), F.desc("_new")))
    return both.withColumn("_n", n).filter("_n = 1").drop("_n", "_new")


def insert_or_ignore(stored: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """SNK6: new rows whose key is not there yet."""
    return stored.unionByName(new.dropDuplicates(key).join(stored.select(*key), key, "left_anti").select(*stored.columns))


def insert_unique(stored: DataFrame, new: DataFrame, key: Column, what: str) -> DataFrame:
    """SNK18: fails where a key is taken."""
    taken = new.select(key.alias("_k")).join(stored.select(key.alias("_k")), "_k", "left_semi")
    if taken.limit(1).count():
        raise ValueError(f"{what} is taken")
    return stored.unionByName(new.select(*stored.columns))


def bootstrapped(admins: DataFrame, first: DataFrame) -> DataFrame:
    """SNK18: the first account, only where there is none yet; it must change its password."""
    if admins.limit(1).count():
        return admins
    return admins.unionByName(with_missing_columns(first, {"must_change_password": F.lit(True)}).select(*admins.columns))


def delete_ids(table: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """SNK4."""
    return table.join(ids.select(key).distinct(), key, "left_anti")


def delete_source(tables: dict[str, DataFrame], sources: DataFrame, name: str) -> dict[str, DataFrame]:
    """SNK20: every table without a source's rows; refused while it is processed."""
    if sources.filter((F.col("filename") == name) & (F.col("status") == BUSY)).limit(1).count():
        raise ValueError("the source is being processed")
    out = {k: t.filter(F.col("source") != name) for k, t in tables.items()}
    return out | {"sources": sources.filter(F.col("filename") != name)}


def delete_account(admins: DataFrame, sessions: DataFrame, id_: int) -> tuple[DataFrame, DataFrame]:
    """SNK5: an account and its sessions."""
    return admins.filter(F.col("id") != id_), sessions.filter(F.col("admin_id") != id_)


def end_sessions(sessions: DataFrame, admin_id: int, keep: str | None = None) -> DataFrame:
    """SNK19: an account's sessions end, but for the one kept."""
    own = F.col("admin_id") == admin_id
    return sessions.filter(~(own & (F.col("token_hash") != keep)) if keep else ~own)


def with_password(admins: DataFrame, sessions: DataFrame, admin_id: int, password_hash: str, keep: str | None = None) -> tuple[DataFrame, DataFrame]:
    """SNK19: an account with a new password, which it need not change again, and the sessions without its other ones."""
    own = F.col("id") == admin_id
    new = admins.withColumn("password_hash", F.when(own, F.lit(password_hash)).otherwise(F.col("password_hash"))).withColumn("must_change_password", ~own & F.col("must_change_password"))
    return new, end_sessions(sessions, admin_id, keep)


def live(sessions: DataFrame, now: Column) -> DataFrame:
    """FLT4/STR4."""
    return sessions.filter(F.col("expires_at") > now)


def session_admins(sessions: DataFrame, admins: DataFrame, now: Column) -> DataFrame:
    """JN2."""
    return live(sessions, now).join(admins, F.col("admin_id") == admins["id"]).select("token_hash", "admin_id", "username", "expires_at")


def begin(sources: DataFrame, names: DataFrame) -> DataFrame:
    """SNK7/STR5: sources to process: those named and not busy become busy, new ones are added."""
    known = sources.join(names.select("filename").withColumn("_asked", F.lit(True)).distinct(), "filename", "left")
    free = F.coalesce(F.col("_asked"), F.lit(False)) & (F.col("status") != BUSY)
    kept = known.withColumn("status", F.when(free, BUSY).otherwise(F.col("status"))).drop("_asked").select(*sources.columns)
    new = names.select("filename").distinct().join(sources, "filename", "left_anti")
    fill = {"filename": F.col("filename"), "status": F.lit(BUSY)}
    return kept.unionByName(new.select(*[fill.get(f.name, F.lit(0) if f.dataType.typeName() in ("long", "integer") else F.lit(None)).cast(f.dataType).alias(f.name) for f in sources.schema]))


def finish(sources: DataFrame, results: DataFrame) -> DataFrame:
    """STR5: results (filename, ok, chunks, error): ready with new counts, or failed; a failure with a previous version stays ready."""
    r = results.select("filename", "ok", F.col("chunks").alias("_chunks"), F.col("error").alias("_error"))
    j = sources.join(r, "filename", "left")
    status = F.when(F.col("ok").isNull(), F.col("status")).when(F.col("ok") | (F.col("chunks") > 0), READY).otherwise(FAILED)
    return j.withColumn("status", status).withColumn("chunks", F.when(F.coalesce("ok", F.lit(False)), F.col("_chunks")).otherwise(F.col("chunks"))).withColumn("error", F.when(F.col("ok").isNull(), F.col("error")).otherwise(F.col("_error"))).select(*sources.columns)


def recovered(sources: DataFrame) -> DataFrame:
    """SNK8/STR7: after a crash, busy sources with passages are ready, the others failed."""
    return sources.withColumn("status", F.when(F.col("status") != BUSY, F.col("status")).when(F.col("chunks") > 0, READY).otherwise(FAILED))


def with_missing_columns(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """SNK23."""
    return df.withColumns({k: v for k, v in columns.items() if k not in df.columns})


def listed(sources: DataFrame, ready_only: bool = False) -> DataFrame:
    """ORD1."""
    return (sources.filter(F.col("status") == READY) if ready_only else sources).orderBy(F.desc("uploaded_at"), "id")


def oldest(admins: DataFrame) -> DataFrame:
    """ORD7."""
    return admins.orderBy("id").limit(1)


def one(table: DataFrame, key: Column) -> DataFrame:
    """FLT16: at most one row."""
    return table.filter(key).limit(1)


def by_source_and_type(items: DataFrame) -> DataFrame:
    """AGG6."""
    return items.groupBy("source", "type").agg(F.count(F.lit(1)).alias("n")).orderBy("source", "type")


def topics(items: DataFrame, place: str = "ord") -> DataFrame:
    """AGG7: items per topic, most first, then by first place. Counts items: a record with two vectors counts twice."""
    rows = items.filter((F.col("type") == "structured_hadith") & (F.coalesce("topic", F.lit("")) != ""))
    return rows.groupBy("topic").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first")).orderBy(F.desc("n"), "first")


def settings(table: DataFrame, schema: str, defaults: dict[str, str]) -> DataFrame:
    """SCL8: typed settings from (key, value JSON); missing fields take their defaults."""
    import json

    base = F.from_json(F.lit(json.dumps(defaults)), schema)
    v = F.from_json("value", schema)
    names = [f.split(" ")[0] for f in schema.split(", ")]
    return table.select("key", *[F.coalesce(v[n], base[n]).alias(n) for n in names])
