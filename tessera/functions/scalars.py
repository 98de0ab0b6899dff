"""Dates, sizes, labels, identifiers and the codec of narrator lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.session import col

# Labels shown for outcomes and kinds of source.
RESULT_LABELS = {
    "verified": "موثّق", "found": "موجود بلا حكم", "distorted": "تحريف محتمل",
    "meaning": "بالمعنى (نص إنجليزي)", "no_match": "لا تطابق", "explore": "بحث بالمعنى",
}
KIND_LABELS = {"document": "مستند", "structured_hadith": "أحاديث منظّمة"}


def labelled(c: Column | str, labels: dict[str, str]) -> Column:
    """PRJ3: the label, or the value itself."""
    pairs = F.create_map(*[F.lit(x) for kv in labels.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, col(c)), col(c))


def human_size(n: Column | str) -> Column:
    """PRJ4."""
    n = col(n)
    mb = F.concat(F.format_string("%.1f", n / 1048576.0), F.lit(" MB"))
    kb = F.concat(F.greatest(F.lit(1), F.bround(n / 1024.0, 0).cast("long")).cast("string"), F.lit(" KB"))
    return F.when(n >= 1048576, mb).otherwise(kb)


def local_day(ts: Column | str, hours: int = 3) -> Column:
    """SCL1: the day of a UTC time under a fixed offset."""
    return F.to_date(col(ts) + F.make_interval(hours=F.lit(hours)))


def visitor_hash(salt: str, visitor: Column | str) -> Column:
    """SNK9: salted, 32 digits."""
    return F.substring(F.sha2(F.concat(F.lit(f"{salt}:"), col(visitor).cast("string")), 256), 1, 32)


def stored_name(name: Column | str) -> Column:
    """SNK14: the name an original is kept under."""
    ext = F.lower(F.regexp_extract(col(name), r"(\.[^./]*)$", 1))
    return F.concat(F.substring(F.sha2(col(name), 256), 1, 24), ext)


def source_digest(name: Column | str) -> Column:
    """SCL6: sixteen digits that stand for a source in item ids."""
    return F.substring(F.sha1(col(name)), 1, 16)


def escape_html(c: Column | str) -> Column:
    """SCL7."""
    x = col(c)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def guarded(c: Column | str) -> Column:
    """SNK11: a cell that a spreadsheet would take for a formula is quoted."""
    return F.when(col(c).rlike("^="), F.concat(F.lit("'"), col(c))).otherwise(col(c))


def shortened(c: Column | str, most: int) -> Column:
    """SNK12: labels of a printed report."""
    return F.when(F.length(col(c)) > most, F.concat(F.substring(col(c), 1, most - 1), F.lit("…"))).otherwise(col(c))


def half_even(c: Column | str, places: int = 0) -> Column:
    """SCL5."""
    return F.bround(col(c), places)


def chain_string(chain: Column | str) -> Column:
    """TXT15: an array of (name, grade) as one string."""
    return F.array_join(F.transform(col(chain), lambda n: F.when(F.coalesce(n["grade"], F.lit("")) != "", F.concat(n["name"], F.lit(" ("), n["grade"], F.lit(")"))).otherwise(n["name"])), " > ")


def chain_array(c: Column | str) -> Column:
    """TXT15: back to an array; the last group in parentheses is the grade."""
    graded = r"(?s)^(.*)\(([^()]*)\)\s*$"
    parts = F.filter(F.transform(F.split(F.coalesce(col(c), F.lit("")), " > "), F.trim), lambda p: p != "")
    return F.transform(
        parts,
        lambda p: F.struct(
            F.when(p.rlike(graded), F.trim(F.regexp_extract(p, graded, 1))).otherwise(p).alias("name"),
            F.when(p.rlike(graded), F.trim(F.regexp_extract(p, graded, 2))).alias("grade"),
        ),
    )


def valid_username(c: Column | str) -> Column:
    """FLT12."""
    return col(c).rlike(r"^[A-Za-z0-9._-]{3,32}$")


def valid_password(c: Column | str, least: int = 8) -> Column:
    """FLT12."""
    return F.length(col(c)) >= least


def account_key(c: Column | str) -> Column:
    """SCL11: account names compare without letter case."""
    return F.lower(F.trim(col(c)))
