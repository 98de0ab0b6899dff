"""Books: the published title, compiler and rank behind any name a book comes with (JN7, ORD2, ORD9, PRJ9).

The table is small and fixed, so it is part of the expression: no join, no shuffle.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import book_key
from tessera.session import col

# Title, compiler, the compiler's short name, year of death, other names.
BOOKS = (
    ("صحيح البخاري", "الإمام أبو عبد الله محمد بن إسماعيل البخاري", "البخاري", 256, ("bukhari", "bokhari")),
    ("صحيح مسلم", "الإمام أبو الحسين مسلم بن الحجاج القشيري النيسابوري", "مسلم", 261, ("muslim",)),
    ("سنن أبي داود", "الإمام أبو داود سليمان بن الأشعث السجستاني", "أبو داود", 275, ("abu dawud", "abudawud", "abi dawud", "abu daud")),
    ("جامع الترمذي", "الإمام أبو عيسى محمد بن عيسى الترمذي", "الترمذي", 279, ("tirmidhi", "tirmizi", "سنن الترمذي")),
    ("سنن النسائي", "الإمام أبو عبد الرحمن أحمد بن شعيب النسائي", "النسائي", 303, ("nasai", "nasa'i", "nisai", "المجتبى", "السنن الصغرى")),
    ("سنن ابن ماجه", "الإمام أبو عبد الله محمد بن يزيد القزويني ابن ماجه", "ابن ماجه", 273, ("ibn maja", "ibnmajah", "ibn majah")),
    ("موطأ الإمام مالك", "الإمام أبو عبد الله مالك بن أنس الأصبحي", "مالك", 179, ("muwatta", "malik", "موطأ مالك", "الموطأ")),
    ("مسند الإمام أحمد بن حنبل", "الإمام أبو عبد الله أحمد بن محمد بن حنبل الشيباني", "أحمد بن حنبل", 241, ("ahmad", "ahmed", "musnad", "مسند أحمد")),
)

_FOLD = str.maketrans("أإآىة", "ااايه")


def key_of(name: str) -> str:
    """As book_key, for one string."""
    return " ".join(re.sub(r"[-_.]+", " ", re.sub(r"\.(json|csv|txt|pdf|docx?)$", "", name.lower().translate(_FOLD))).split())


#: (key, rank of its book), longest key first, in order of declaration among equals.
ALIASES = sorted(((key_of(n), i) for i, b in enumerate(BOOKS) for n in (b[0], *b[4])), key=lambda x: -len(x[0]))


def best_match(key: Column, aliases: list[tuple[str, int]]) -> Column:
    """The value of the equal alias, else of the longest that fits: one in ASCII anywhere in the key, another at its beginning."""
    exact = F.create_map(*[F.lit(x) for pair in dict(aliases).items() for x in pair])
    table = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(v).alias("v"), F.lit(a.isascii()).alias("ascii")) for a, v in aliases])
    fits = F.filter(table, lambda t: F.when(t["ascii"], key.contains(t["a"])).otherwise(key.startswith(t["a"])))
    return F.coalesce(F.try_element_at(exact, key), F.try_element_at(fits, F.lit(1))["v"])


def rank_or_null(name: Column | str) -> Column:
    name = F.coalesce(col(name), F.lit(""))
    return F.when(name != "", best_match(book_key(name), ALIASES))


def rank(name: Column | str) -> Column:
    """ORD2: place in the order books are cited in; others come after."""
    return F.coalesce(rank_or_null(name), F.lit(len(BOOKS)))


def _of(name: Column | str, values: list) -> Column:
    at = rank_or_null(name)
    return F.when(at.isNotNull(), F.element_at(F.array(*map(F.lit, values)), at + 1))


def title(name: Column | str) -> Column:
    """PRJ9: the published title, or the name."""
    return F.coalesce(_of(name, [b[0] for b in BOOKS]), col(name))


def credit(name: Column | str) -> Column:
    """PRJ9: compiler and year of death; null for other books."""
    return _of(name, [f"{b[1]} (ت {b[3]}هـ)" for b in BOOKS])


def author(name: Column | str) -> Column:
    """The compiler's short name; empty for other books."""
    return F.coalesce(_of(name, [b[2] for b in BOOKS]), F.lit(""))


def matched(df: DataFrame, name: str, dimension: DataFrame, alias: str, value: str, out: str) -> DataFrame:
    """JN7 for a dimension of any size: equal key first, else the longest alias that the name begins with.

    Prefixes of the name, one per distinct alias length (all of them), are looked up by an equality join."""
    keyed = dimension.select(book_key(alias).alias("_k"), F.col(value).alias("_v"), F.monotonically_increasing_id().alias("_o"))
    keyed = keyed.groupBy("_k").agg(F.min_by("_v", "_o").alias("_v"))
    sizes = [r[0] for r in keyed.select(F.length("_k").alias("n")).distinct().orderBy(F.desc("n")).collect()]
    names = df.select(name).distinct().withColumn("_key", book_key(name))
    tries = names.withColumn("_k", F.explode(F.array_distinct(F.array(*[F.substring("_key", 1, n) for n in sizes])))) if sizes else names.withColumn("_k", F.col("_key"))
    best = tries.join(keyed, "_k").groupBy(name).agg(F.max_by("_v", F.length("_k")).alias(out))
    return df.join(best, name, "left")
