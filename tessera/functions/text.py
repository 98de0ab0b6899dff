"""Text functions as Column expressions. Only Unicode normal forms need Python (an Arrow function over whole batches); everything else
stays in the JVM.

Word characters are ``[\\p{L}\\p{N}_]`` and white space is Unicode white space plus U+001C-001F, which is what the text rules here mean.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.session import col

# The marks that a cleaned text does not hold.
DIACRITICS = r"[\u0610-\u061a\u064b-\u065f\u0670\u06d6-\u06dc\u06df-\u06e8\u06ea-\u06ed]"
TATWEEL = "\u0640"
INVISIBLE = r"[\u200b-\u200f\u202a-\u202e\u2066-\u2069\ufeff]"
# Letters folded before words are compared.
FOLD_FROM, FOLD_TO = "أإآٱىة", "اااايه"
SUBJECT_FROM, SUBJECT_TO = "أإآٱى", "ااااي"
# Words too common to tell two texts apart, in normalised form.
STOPWORDS = (
    "من", "في", "علي", "عن", "الي", "ما", "لا", "ان", "قال", "قالت", "ثم", "او", "و", "ف", "ب", "ل",
    "هو", "هي", "هذا", "هذه", "ذلك", "التي", "الذي", "كان", "يا", "قد", "لم", "لن", "كل", "مع", "اذا",
)

_SPACE = r"[\s\x1c-\x1f]"


def _normal(form: str) -> Callable[[pa.Array], pa.Array]:
    def run(x: pa.Array) -> pa.Array:
        """Only texts beyond ASCII are looked at; Arrow's own kernel for normal forms leaves letters decomposed, so it is not used."""
        other = pc.invert(pc.fill_null(pc.string_is_ascii(x), True))
        if not pc.any(other).as_py():
            return x
        done = [unicodedata.normalize(form, v) for v in x.filter(other).to_pylist()]
        return pc.replace_with_mask(x, other, pa.array(done, x.type))

    return run


_forms = {form: F.arrow_udf(_normal(form), T.StringType()) for form in ("NFKC", "NFC")}


def nfkc(c: Column | str) -> Column:
    """Compatibility composition (TXT2), over Arrow batches."""
    return _forms["NFKC"](col(c))


def nfc(c: Column | str) -> Column:
    return _forms["NFC"](col(c))


def strip(c: Column | str) -> Column:
    """Without white space at either end; unlike trim, all of Unicode's."""
    return F.regexp_replace(col(c), rf"(?U)^{_SPACE}+|{_SPACE}+$", "")


def split_words(c: Column | str) -> Column:
    """Words between white space; none for an empty text."""
    return F.filter(F.split(col(c), rf"(?U){_SPACE}+"), lambda w: w != "")


def squeeze(c: Column | str) -> Column:
    """All white space runs as one space, none at the ends."""
    return strip(F.regexp_replace(col(c), rf"(?U){_SPACE}+", " "))


def count_matches(c: Column | str, pattern: str) -> Column:
    """Number of characters in a class, which is given as its complement's removal: length difference."""
    return F.length(col(c)) - F.length(F.regexp_replace(col(c), pattern, ""))


def clean(c: Column | str, strip_diacritics: bool = True, unicode: bool = True) -> Column:
    """TXT1: normal form, line ends, invisible marks, diacritics, tatweel, blanks per line, blank lines."""
    x = nfkc(col(c)) if unicode else col(c)
    x = F.regexp_replace(F.regexp_replace(x, "\r\n?", "\n"), INVISIBLE, "")
    if strip_diacritics:
        x = F.regexp_replace(x, DIACRITICS, "")
    x = F.regexp_replace(F.replace(x, F.lit(TATWEEL), F.lit("")), r"[ \t\u00a0]+", " ")
    x = F.regexp_replace(x, rf"(?Udm)^[{_SPACE}&&[^\n]]+|[{_SPACE}&&[^\n]]+$", "")
    return strip(F.regexp_replace(x, "\n{3,}", "\n\n"))


def tidy(c: Column | str, unicode: bool = True) -> Column:
    """TXT12: cleaned, diacritics kept, on one line."""
    return squeeze(clean(c, strip_diacritics=False, unicode=unicode))


def _words_of(c: Column | str, frm: str, to: str, unicode: bool) -> Column:
    x = nfkc(col(c)) if unicode else col(c)
    x = F.translate(F.regexp_replace(x, f"{DIACRITICS[:-1]}{TATWEEL}]", ""), frm, to)
    return F.filter(F.split(F.regexp_replace(x, r"[^\p{L}\p{N}_]+", " "), " "), lambda w: w != "")


def normal_words(c: Column | str, unicode: bool = True) -> Column:
    return _words_of(c, FOLD_FROM, FOLD_TO, unicode)


def normalize(c: Column | str, unicode: bool = True) -> Column:
    """TXT4: folded words, one space between them."""
    return F.array_join(normal_words(c, unicode), " ")


def subject_words(c: Column | str, unicode: bool = True) -> Column:
    """Words under the folding that keeps the feminine ending apart."""
    return _words_of(c, SUBJECT_FROM, SUBJECT_TO, unicode)


def without_conjunction(w: Column) -> Column:
    return F.when((F.length(w) >= 3) & F.left(w, F.lit(1)).isin("و", "ف"), F.substring(w, 2, 1 << 30)).otherwise(w)


def index_words(c: Column | str, unicode: bool = True) -> Column:
    return F.transform(normal_words(c, unicode), without_conjunction)


def index_form(c: Column | str, unicode: bool = True) -> Column:
    """TXT5: a text as the literal index holds it."""
    return F.array_join(index_words(c, unicode), " ")


def phrase_words(c: Column | str, unicode: bool = True) -> Column:
    """Words as phrases match them: index form, letter case and underscore ignored."""
    return F.filter(F.split(F.lower(F.replace(index_form(c, unicode), F.lit("_"), F.lit(" "))), " "), lambda w: w != "")


def let(fn: Callable[..., Column], *values: Column) -> Column:
    """fn over values that are computed once; inside fn they may be used in lambdas even if Python functions made them."""
    packed = F.struct(*[v.alias(f"v{i}") for i, v in enumerate(values)])
    return F.transform(F.array(packed), lambda s: fn(*[s[f"v{i}"] for i in range(len(values))]))[0]


def word_overlap(query: Column | str, text: Column | str, unicode: bool = True) -> Column:
    """TXT7: share of the query's telling words, with repeats, that the text has; 4 places."""
    asked = F.filter(normal_words(query, unicode), lambda w: ~w.isin(*STOPWORDS) & (F.length(w) > 1))

    def share(words: Column, have: Column) -> Column:
        found = F.size(F.filter(words, lambda w: F.array_contains(have, w)))
        return F.when(F.size(words) == 0, F.lit(0.0)).otherwise(F.round(found / F.size(words), 4))

    return let(share, asked, normal_words(text, unicode))


def is_subject(c: Column | str, unicode: bool = True) -> Column:
    """TXT8: one to six words."""
    return F.size(subject_words(c, unicode)).between(1, 6)


def letters(c: Column | str) -> Column:
    """SCL10: number of letters."""
    return count_matches(c, r"\p{L}")


_ARABIC, _LATIN = r"[\u0600-\u06ff\u0750-\u077f\u08a0-\u08ff]", "[A-Za-z]"


def latin_share(c: Column | str) -> Column:
    a, b = count_matches(c, _ARABIC), count_matches(c, _LATIN)
    return F.when(a + b > 0, b / (a + b)).otherwise(F.lit(0.0))


def looks_garbled(c: Column | str) -> Column:
    """FLT6: at least 20 letters of both scripts, mixed."""
    share = latin_share(c)
    return (count_matches(c, _ARABIC) + count_matches(c, _LATIN) >= 20) & (share > 0.08) & (share < 0.9)


def looks_broken(c: Column | str) -> Column:
    """FLT7: letters set apart, or words stored backwards."""
    w = F.regexp_extract_all(col(c), F.lit("[ء-ي]+"), F.lit(0))
    n = F.size(w)
    single = F.size(F.filter(w, lambda x: F.length(x) == 1))
    starts = F.size(F.filter(w, lambda x: x.startswith("ال") & (F.length(x) > 3)))
    ends = F.size(F.filter(w, lambda x: x.endswith("لا") & (F.length(x) > 3)))
    return (n >= 20) & ((single / F.greatest(n, F.lit(1)) > 0.35) | ((ends >= 5) & (ends > starts * 2)))


def usable_layer(c: Column | str) -> Column:
    """FLT8."""
    return (F.length(strip(c)) >= 20) & ~looks_garbled(c) & ~looks_broken(c)


def choose_layer(ocr: Column | str, layer: Column | str, vision: bool = False) -> Column:
    """TXT28: the reading replaces the layer unless it is blank or, without a vision model, has more Latin letters in it."""
    ocr, layer = col(ocr), col(layer)
    keep = strip(ocr) == ""
    if not vision:
        keep = keep | ((strip(layer) != "") & (latin_share(ocr) > latin_share(layer)))
    return F.when(keep, layer).otherwise(ocr)


def meaningful(c: Column | str, min_letters: int = 8) -> Column:
    """FLT5: a passage worth indexing."""
    return (F.size(split_words(c)) >= 2) & (letters(c) >= min_letters) & ~looks_garbled(c)


def has_arabic(c: Column | str) -> Column:
    """FLT9."""
    return col(c).rlike(r"[\u0600-\u06ff]")


def blank(c: Column | str) -> Column:
    """FLT14: nothing to show."""
    return ~col(c).rlike(r"(?U)\S") | col(c).isNull()


def digits_to_ascii(c: Column | str) -> Column:
    """TXT27."""
    return F.translate(col(c), "٠١٢٣٤٥٦٧٨٩", "0123456789")


def book_key(c: Column | str) -> Column:
    """TXT14: a book's name as it is looked up."""
    x = F.translate(F.lower(col(c)), "أإآىة", "ااايه")
    return squeeze(F.regexp_replace(F.regexp_replace(x, r"\.(json|csv|txt|pdf|docx?)$", ""), r"[-_.]+", " "))


def reading_tidy(c: Column | str, unicode: bool = True) -> Column:
    """TXT16: a model's reading without code fences, with Arabic digits and letters."""
    x = F.regexp_replace(strip(c), r"^```[a-zA-Z]*\s*|\s*```$", "")
    x = F.translate(x, "۰۱۲۳۴۵۶۷۸۹یک", "٠١٢٣٤٥٦٧٨٩يك")
    return strip(nfc(x) if unicode else x)


def paragraphs(c: Column | str) -> Column:
    """TXT29: line breaks of a model's output as paragraph breaks."""
    return F.regexp_replace(col(c), r"(?U)\s*\n\s*", "\n\n")


def truncated(c: Column | str, most: int = 6000) -> Column:
    """TXT30."""
    return F.substring(col(c), 1, most)


def bare(c: Column | str) -> Column:
    """TXT32: key of a heading or a word of kinship."""
    x = F.translate(F.regexp_replace(col(c), r"[\u0610-\u061a\u064b-\u065f\u0670\u0640]", ""), "أإآ", "ااا")
    return F.btrim(x, F.lit(" ،,.:؛"))


def names_a_subject(c: Column | str) -> Column:
    """FLT10: a chapter title about a subject, not one named after a narrator or a variant chain."""
    x = F.coalesce(col(c), F.lit(""))
    x = squeeze(F.translate(F.regexp_replace(x, r"[\u064b-\u065f\u0670]", ""), "أإآة\u0640", "اااه"))
    return (x != "") & ~x.rlike(r"^(?:و?من )?(?:حديث|احاديث|مسند|اخبار|بقيه|تتمه|زياده|ذكر الاختلاف|ذكر اختلاف)(?:(?U)\s|:|$)")


_PROPHET = "صلى الله عليه وسلم|ﷺ"
_LEAD = r"^(?:[\s:،,.«»\"'()]|(?:قال|قالت|قالا|قالوا|فقال|فقالت|فقالوا|وقال|وقالت|يقول|أنه|انه)(?![ء-ي]))+"


def matn_of(c: Column | str, unicode: bool = True, min_words: int = 8, max_share: float = 0.85) -> Column:
    """TXT11: what follows the first mention that ends the chain; empty where it cannot be told apart."""
    x = F.regexp_replace(nfkc(col(c)) if unicode else col(c), r"[\u0610-\u061a\u064b-\u065f\u0670\u06d6-\u06ed\u0640]", "")
    rest = F.regexp_extract(x, rf"(?s)^.*?(?:{_PROPHET})(.*)$", 1)
    matn = F.btrim(F.regexp_replace(rest, f"(?U){_LEAD}", ""), F.lit(" «»\"'."))
    short = (F.size(split_words(matn)) < min_words) | (F.length(matn) > max_share * F.length(x))
    return F.when(~x.rlike(_PROPHET) | short, F.lit("")).otherwise(matn)


def record_matn(matn: Column | str, text: Column | str, unicode: bool = True, min_words: int = 8) -> Column:
    """TXT11: the marked matn if long enough, else the one found in the text."""
    own = F.coalesce(col(matn), F.lit(""))
    return F.when(own != "", F.when(F.size(split_words(own)) >= min_words, own).otherwise(F.lit(""))).otherwise(matn_of(text, unicode))
