"""PII: detected entities are replaced by surrogates of the same type and format.

A surrogate comes from a keyed permutation of the set of all strings that share the entity's type and shape (digits stay digits, letters
keep script and case, separators stay). A permutation maps different entities to different surrogates and the same entity to the same
surrogate, in every document and every task, without any exchange between tasks: distinctness and coreference hold across the corpus,
with no table of entities to gather. Whoever has the key can undo it, so the key is the caller's to give and to guard. In each document the
result is checked: no surrogate may equal an entity of that document (itself included), and different entities must have different surrogates; an
entity that fails is permuted again with a counter (this parts its mentions in that document from those in others), and where that
does not help (values without a replaceable character, or of very few possible forms) gets a fresh keyed value of its type. An original never stands.

Types: e-mail addresses (also with letters beyond ASCII), logins in URLs, web tokens, secrets in assignments (token, password, key), access keys,
long hexadecimal strings, IPv4 and IPv6 addresses, IBAN account numbers (check digits valid or invalid as they were), payment card numbers
(the same), national ids (ddd-dd-dddd, or nine digits after SSN), phone numbers, and person names: after (in Han script: before) a title in
Latin, Cyrillic, Arabic or Han script, after a label such as "Name:", and known given names with a family name. Gender comes from the
title or the given name; known given names map to given names of the same gender, others keep their script, case, vowel pattern and ending.
Other whole-token mentions of a detected value, or of a detected family name, in the same text are replaced alike.

E-mail addresses, logins, tokens, keys, hexadecimal strings and secrets are replaced whole, whatever their length.

Not found: names without a title, a label or a given name of the lists; in Arabic script two words after a title are taken as the name.

Defined results. Null text: null, no entities. Empty text: empty. Empty table: no rows. Repeated rows and copies get equal results. Entities
that overlap: the one that starts first stays, of those the longest. Extra columns are kept by `replace`, whatever their names.
"""

from __future__ import annotations

import hashlib
import ipaddress
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tessera.llm.common import column, load, ready, slices

#: For the query and the pipeline on synthetic data only; anything else needs a key of its own.
TEST_KEY = "public-test-key"
ROUNDS = 8
#: Characters permuted at a time: half of them are a number well below the 320 bits that a round adds.
PIECE = 96

# Given names, by gender.
MALE = (
    "James John Robert Michael William David Richard Joseph Thomas Charles Daniel Matthew Anthony Mark Donald Steven Paul Andrew Joshua Kenneth Kevin Brian George Edward Ronald Timothy Jason Jeffrey Ryan Jacob "
    "Hans Peter Klaus Jürgen Stefan Wolfgang Uwe Dieter Helmut Günther Matthias Thorsten Pierre Jean Jacques Louis Henri Luc Michel François Philippe Olivier José Juan Carlos Luis Miguel Pedro Javier Antonio Manuel Francisco Diego Pablo"
).split()
FEMALE = (
    "Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Nancy Lisa Margaret Betty Sandra Ashley Kimberly Emily Donna Michelle Carol Amanda Melissa Deborah Stephanie Rebecca Laura Helen Anna Amy "
    "Ursula Monika Petra Sabine Heike Renate Gisela Ingrid Brigitte Karin Claudia Katrin Marie Claire Sophie Camille Juliette Louise Nathalie Isabelle Sylvie Monique María Carmen Ana Isabel Lucía Elena Pilar Dolores Teresa Rosa Cristina Marta"
).split()
_GENDER = {x: "m" for x in MALE} | {x: "f" for x in FEMALE}
_MALE_TITLES = ("mr", "herr", "monsieur", "señor", "sr", "don", "г-н", "господин", "السيد", "الدكتور", "الأستاذ", "先生")
_ANY_TITLES = ("dr", "prof", "доктор", "профессор", "博士", "老师")
_TITLE = r"Mr|Mrs|Ms|Miss|Dr|Prof|Herr|Frau|Monsieur|Madame|Mme|Señor|Señora|Sr|Sra|Don|Doña|[Гг]-н|[Гг]-жа|[Гг]осподин|[Гг]оспожа|[Дд]октор|[Пп]рофессор"
_ARABIC_TITLE, _HAN_TITLE = "السيدة|السيد|الدكتورة|الدكتور|الأستاذة|الأستاذ", "先生|女士|小姐|博士|老师"
_UPPER = r"[A-ZÀ-ÖØ-ÞΑ-ΩА-ЯЁ]"
_NAME = rf"{_UPPER}[^\W\d_]+(?:-{_UPPER}[^\W\d_]+)?"
_IPV4 = r"(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"

#: (type, cheap test, pattern); the entity is group 1. Order is the order of preference where two start together.
PATTERNS = [
    ("login", "://", re.compile(r"(?i)\b[a-z][a-z0-9+.-]{1,15}://([^\s/@:\"'<>]++:[^\s/@\"'<>]++)@")),
    ("email", "@", re.compile(r"(?<![\w.%+-])([\w%+-][\w.%+-]*+@[^\W_][\w-]*+(?:\.[\w-]++)++)")),
    ("token", ".", re.compile(r"(?<![\w.-])(eyJ[A-Za-z0-9_-]{6,}+\.[A-Za-z0-9_-]{6,}+\.[A-Za-z0-9_-]{4,}+)")),
    ("secret", None, re.compile(r"(?i)\b(?:token|password|passwd|pwd|secret|api[_-]?key|access[_-]?key)\b\s{0,3}[:=]\s{0,3}[\"']?([^\s\"'<>]{6,}+)")),
    ("secret", "earer", re.compile(r"\b[Bb]earer\s{1,3}([A-Za-z0-9._~+/-]{12,}+=*+)")),
    ("key", None, re.compile(r"(?<![A-Za-z0-9])((?:AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{20,}+|sk-[A-Za-z0-9]{16,}+)(?![A-Za-z0-9])")),
    ("hex", None, re.compile(r"(?<![A-Za-z0-9])((?=[a-f]*+[0-9])[0-9a-f]{32,}+|(?=[A-F]*+[0-9])[0-9A-F]{32,}+)(?![A-Za-z0-9])")),
    ("ip", ".", re.compile(rf"(?<![\d.])({_IPV4})(?!\.?\d)")),
    ("ipv6", ":", re.compile(r"(?<![\w:.])((?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6}|::[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){1,6}|(?:[0-9A-Fa-f]{1,4}:){2,7}:)(?![\w:])")),
    ("iban", None, re.compile(r"(?<![A-Za-z0-9])([A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?)(?![A-Za-z0-9])")),
    ("card", None, re.compile(r"(?<![\w+-])(\d{13,19}|\d{4}(?:[ -]\d{4}){2}[ -]\d{1,7}|\d{4}[ -]\d{6}[ -]\d{5})(?![\w-])")),
    ("national", "-", re.compile(r"(?<![\w-])(\d{3}-\d{2}-\d{4})(?![\w-])")),
    ("national", None, re.compile(r"\b(?:SSN|ssn|[Ss]ocial [Ss]ecurity(?: [Nn]umber| [Nn]o\.?)?)(?: is|:|#)?[ #]{0,2}(\d{3}[ -]?\d{2}[ -]?\d{4})(?![\w-])")),
    ("phone", None, re.compile(r"(?<![\w+(])(\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{1,4}(?:[ .-]?\d{2,4}){1,4}|\(\d{2,4}\) ?\d{3,4}[ .-]\d{3,4}|\d{3}([ .-])\d{3}\2\d{4}|0\d{2,4}[ /-]\d{5,8})(?![\w-])")),
    ("name", None, re.compile(rf"\b(?:{_TITLE})\.? ({_NAME}(?: {_NAME}){{0,2}})")),
    ("name", None, re.compile(rf"\b(?:[Nn]ame|[Pp]atient|[Cc]ustomer|[Cc]ontact|Attn)(?:\s?:| is)\s{{1,2}}({_NAME}(?: {_NAME}){{1,2}})")),
    ("name", "ا", re.compile(rf"(?<!\w)(?:{_ARABIC_TITLE}) ([\u0621-\u064a]+(?: [\u0621-\u064a]+)?)")),
    ("name", None, re.compile(rf"(?<![\u4e00-\u9fff])([\u4e00-\u9fff]{{1,3}}?)(?:{_HAN_TITLE})")),
]
_KNOWN = re.compile(rf"\b([A-Z][^\W\d_]+)(?= {_UPPER})")
_WHOLE = re.compile(rf"{_NAME}(?: {_NAME}){{1,2}}")
_DIGIT, _TITLES, _HAN_TITLES = re.compile(r"[0-9]"), re.compile(rf"\b(?:{_TITLE}|[Nn]ame|[Pp]atient|[Cc]ustomer|[Cc]ontact|Attn)\b|{_ARABIC_TITLE}|{_HAN_TITLE}"), re.compile(_HAN_TITLE)
_NEEDS_DIGIT = {"ip", "hex", "iban", "card", "national", "phone"}


@dataclass(frozen=True)
class Entity:
    type: str
    start: int
    end: int
    value: str
    gender: str = ""


def _gender(kind: str, before: str, after: str, name: str) -> str:
    if kind != "name":
        return ""
    title = (_HAN_TITLES.match(after) or [before])[0].strip(" .:").lower()
    if title in _ANY_TITLES or title.split(" ")[0] in ("name", "patient", "customer", "contact", "attn"):
        return _GENDER.get(name.split(" ")[0], "")
    return "m" if title in _MALE_TITLES else "f"


def find(text: str) -> list[Entity]:
    """Entities in order, without overlaps."""
    digits, titles, found = bool(_DIGIT.search(text)), None, []
    for rank, (kind, has, pattern) in enumerate(PATTERNS):
        if (has and has not in text) or (kind in _NEEDS_DIGIT and not digits):
            continue
        if kind == "name":
            titles = bool(_TITLES.search(text)) if titles is None else titles
            if not titles:
                continue
        for m in pattern.finditer(text):
            if kind == "ipv6" and not _is_ipv6(m[1]):
                continue
            gender, value = _gender(kind, text[m.start() : m.start(1)], text[m.end(1) : m.end(1) + 2], m[1]), m[1]
            if kind == "secret" and len(value) > 6 and value[-1] in ",;":
                value = value[:-1]
            end = m.start(1) + len(value)
            found.append((m.start(1), -end, rank, Entity(kind, m.start(1), end, value, gender)))
    for m in _KNOWN.finditer(text):
        if m[1] in _GENDER and (whole := _WHOLE.match(text, m.start())):
            found.append((m.start(), -whole.end(), len(PATTERNS), Entity("name", m.start(), whole.end(), whole[0], _GENDER[m[1]])))
    return _mentions(text, _apart(found)) if found else []


def _apart(found: list[tuple]) -> list[Entity]:
    out: list[Entity] = []
    for *_, e in sorted(found, key=lambda x: x[:3]):
        if not out or e.start >= out[-1].end:
            out.append(e)
    return out


def _mentions(text: str, found: list[Entity]) -> list[Entity]:
    """found, and the other whole-token places of the same values and of detected family names."""
    import ahocorasick

    known = {e.value: e for e in reversed(found)}
    for e in found:
        if e.type == "name":
            for word in e.value.split(" ")[1:]:
                if len(word) > 3:
                    known.setdefault(word, Entity("name", 0, 0, word, e.gender))
    machine = ahocorasick.Automaton()
    for value, e in known.items():
        machine.add_word(value, e)
    machine.make_automaton()
    more, n = [(e.start, -e.end, 0, e) for e in found], len(text)
    starts = {e.start for e in found}
    for last, e in machine.iter(text):
        start, end = last + 1 - len(e.value), last + 1
        inside = (start > 0 and _joins(text[start - 1], e.value[0])) or (end < n and _joins(text[end], e.value[-1]))
        if start not in starts and not inside:
            more.append((start, -end, 1, Entity(e.type, start, end, e.value, e.gender)))
    return _apart(more) if len(more) > len(found) else found


def _joins(a: str, b: str) -> bool:
    return (a.isalnum() or a == "_") and (b.isalnum() or b == "_")


def _is_ipv6(value: str) -> bool:
    try:
        ipaddress.IPv6Address(value)
    except ValueError:
        return False
    return bool(_DIGIT.search(value))


# --- keyed permutations ---------------------------------------------------------------------------------------------


def _number(key: str, *what: object) -> int:
    return int.from_bytes(hashlib.blake2b("\x1f".join(map(str, what)).encode("utf-8", "surrogatepass"), key=hashlib.sha256(key.encode()).digest(), digest_size=40).digest(), "big")


def permute(digits: list[int], radix: list[int], key: str, tweak: str) -> list[int]:
    """A keyed permutation of the mixed-radix numbers: alternating rounds that add a function of one half to the other."""
    half = (len(digits) + 1) // 2

    def value(x: list[int], r: list[int]) -> int:
        v = 0
        for d, b in zip(x, r):
            v = v * b + d
        return v

    def spread(v: int, r: list[int]) -> list[int]:
        out = []
        for b in reversed(r):
            v, d = divmod(v, b)
            out.append(d)
        return out[::-1]

    ra, rb = radix[:half], radix[half:]
    na, nb = 1, 1
    for b in ra:
        na *= b
    for b in rb:
        nb *= b
    a, b = value(digits[:half], ra), value(digits[half:], rb)
    for i in range(ROUNDS):
        if i % 2:
            b = (b + _number(key, tweak, i, a)) % nb
        else:
            a = (a + _number(key, tweak, i, b)) % na
    return spread(a, ra) + spread(b, rb)


_VOWELS, _CONSONANTS = "aeiou", "bcdfghjklmnpqrstvwxyz"


_SYMBOLS = "!#$%&*+-./:;=?@^_~|"


@lru_cache(4096)
def _class(ch: str, spoken: bool, hexadecimal: bool, symbols: bool) -> str | None:
    """The characters that may stand for ch; None: ch stays."""
    if hexadecimal and ch in "0123456789abcdef":
        return "0123456789abcdef"
    if hexadecimal and ch in "0123456789ABCDEF":
        return "0123456789ABCDEF"
    if "0" <= ch <= "9":
        return "0123456789"
    if symbols and ch in _SYMBOLS:
        return _SYMBOLS
    if spoken:
        low = ch.lower()
        for group in (_VOWELS, _CONSONANTS):
            if low in group:
                return group if ch == low else group.upper()
    for a, z in (("a", "z"), ("A", "Z"), ("а", "я"), ("А", "Я"), ("α", "ρ"), ("σ", "ω"), ("Α", "Ρ"), ("Σ", "Ω"), ("ا", "غ"), ("ف", "ي"), ("א", "ת")):
        if a <= ch <= z:
            return "".join(chr(i) for i in range(ord(a), ord(z) + 1))
    if unicodedata.category(ch) == "Nd":  # digits of other scripts
        return "".join(chr(ord(ch) - unicodedata.digit(ch) + i) for i in range(10))
    if ch.isalpha():  # accented letters and other scripts: within a block of 16 code points, letters of the same category only
        block = ord(ch) & ~15
        return "".join(c for c in map(chr, range(block, block + 16)) if unicodedata.category(c) == unicodedata.category(ch))
    return None


def shaped(value: str, key: str, tweak: str, fixed: frozenset[int] = frozenset(), spoken: bool = False, hexadecimal: bool = False, symbols: bool = False) -> str:
    """Permutes value among the strings of its shape; positions in `fixed` stay. A long value is permuted piece by piece, each under what
    stands before it, so every character is replaced and different values stay different."""
    sets = [None if i in fixed else _class(c, spoken, hexadecimal, symbols) for i, c in enumerate(value)]
    at = [i for i, s in enumerate(sets) if s]
    if not at:
        return value
    shape = "".join(value[i] if s is None else s[0] for i, s in enumerate(sets))
    digits, radix = [sets[i].index(value[i]) for i in at], [len(sets[i]) for i in at]
    if len(at) <= PIECE:
        got = permute(digits, radix, key, f"{tweak}|{shape}")
    else:
        got, before = [], hashlib.blake2b(f"{tweak}|{shape}".encode("utf-8", "surrogatepass"))
        for k in range(0, len(at), PIECE):
            got += permute(digits[k : k + PIECE], radix[k : k + PIECE], key, before.hexdigest())
            before.update(bytes(digits[k : k + PIECE]))
    out = list(value)
    for i, d in zip(at, got):
        out[i] = sets[i][d]
    return "".join(out)


def _luhn(digits: list[int]) -> int:
    """Check digit for digits."""
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = d * 2 if i % 2 == 0 else d
        total += d - 9 if d > 9 else d
    return -total % 10


def _in_format(digits: str, value: str) -> str:
    it = iter(digits)
    return "".join(next(it) if c.isascii() and c.isdigit() else c for c in value)


def _once(e: Entity, value: str, key: str) -> str:
    digits = "".join(c for c in value if c.isascii() and c.isdigit())
    if e.type == "email":
        local, _, domain = value.lower().partition("@")
        labels = domain.split(".")
        held = 2 if labels[-2] == "example" else 1
        own, rest = ".".join(labels[:-held]), ".".join(labels[-held:])
        if not own:
            return f"{shaped(local, key, 'email@' + domain)}@{domain}"
        front = shaped(f"{local}@{own}", key, f"email.{rest}")
        return f"{front}.{rest}"
    if e.type == "ip":
        parts = [int(x) for x in value.split(".")]
        if 1 <= parts[0] <= 223 and 1 <= parts[3] <= 254:
            got = permute([parts[0] - 1, parts[1], parts[2], parts[3] - 1], [223, 256, 256, 254], key, "ip")
            return f"{got[0] + 1}.{got[1]}.{got[2]}.{got[3] + 1}"
        return ".".join(map(str, permute(parts, [256] * 4, key, "ip*")))  # maps the whole set onto itself; see _surrogate
    if e.type == "card":
        n = [int(c) for c in digits]
        off = (n[-1] - _luhn(n[:-1])) % 10
        front = n[:1] + permute(n[1:-1], [10] * (len(n) - 2), key, f"card{len(n)}{n[0]}{off}")
        return _in_format("".join(map(str, [*front, (_luhn(front) + off) % 10])), value)
    if e.type == "phone":
        held = 0
        if value.startswith("+"):
            held = len(re.match(r"\+(\d{1,3}?)(?=\D|\d{8,})|\+(\d{1,3})", value)[0]) - 1
        got = permute([int(c) for c in digits[held:]], [10] * (len(digits) - held), key, f"phone{digits[:held]}|{len(digits)}")
        return _in_format(digits[:held] + "".join(map(str, got)), value)
    if e.type == "name":
        words = value.split(" ")
        return " ".join(_given(w, e.gender, key) if i == 0 and len(words) > 1 else _surname(w, key) for i, w in enumerate(words))
    if e.type == "key":
        head = re.match(r"AKIA|ASIA|gh._|sk-", value)[0]
        return shaped(value, key, "key", frozenset(range(len(head))))
    if e.type == "iban":
        return _iban(value, key)
    if e.type == "token":
        return shaped(value, key, "token", frozenset((0, 1, 2)))
    if e.type == "ipv6":
        return shaped(value, key, "ipv6", hexadecimal=True)
    secret = e.type in ("secret", "login")
    fixed = frozenset((value.index(":"),)) if e.type == "login" else frozenset()
    return shaped(value, key, e.type, fixed, hexadecimal=bool(re.fullmatch(r"[0-9a-f]{16,}|[0-9A-F]{16,}", value)), symbols=secret)


def _remainder(value: str) -> int:
    """Of an account number, its first four characters moved to the end and letters read as 10 to 35, modulo 97."""
    plain = value.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97


def _iban(value: str, key: str) -> str:
    """Valid numbers map to valid ones, others to others with the same check digits."""
    valid = _remainder(value) == 1
    out = shaped(value[:2] + "00" + value[4:], key, "iban", frozenset(range(4))) if valid else shaped(value, key, "iban*" + value[2:4], frozenset(range(4)))
    if valid:
        return f"{out[:2]}{98 - _remainder(out):02d}{out[4:]}"
    while _remainder(out) == 1:  # walked on to the next number that is not valid: still one to one
        out = shaped(out, key, "iban*" + value[2:4], frozenset(range(4)))
    return out


def _surname(word: str, key: str) -> str:
    known = {*MALE, *FEMALE}
    out = shaped(word, key, "name", frozenset((len(word) - 1,)), spoken=True)
    while out in known and out != word:
        out = shaped(out, key, "name", frozenset((len(word) - 1,)), spoken=True)
    return out


def _given(word: str, gender: str, key: str) -> str:
    for names in (MALE, FEMALE):
        title = word if word in names else word.title()
        if title in names and (gender == "" or (gender == "m") == (names is MALE)):
            got = names[permute([names.index(title), 0], [len(names), 1], key, "given")[0]]
            return got.upper() if word.isupper() and len(word) > 1 else got
    return _surname(word, key)


def _valid_ip(value: str) -> bool:
    a, *_, d = (int(x) for x in value.split("."))
    return 1 <= a <= 223 and 1 <= d <= 254


def surrogate(e: Entity, key: str, turn: int = 0) -> str:
    """The surrogate of e; turn picks another permutation. For addresses outside the ordinary ranges the permutation is walked on while it
    stands inside them, which keeps different entities apart."""
    k, value = f"{key}#{turn}" if turn else key, e.value
    for _ in range(64):
        value = _once(e, value, k)
        if e.type == "ip" and not _valid_ip(e.value) and _valid_ip(value):
            continue
        break
    if e.type == "email" and e.value.upper() == e.value:
        value = value.upper()
    return value


def fresh(e: Entity, key: str, turn: int) -> str:
    """A keyed value of the entity's type and length (names: of seven letters at least) where the permutations have none left."""
    n, size = _number(key, "fresh", e.type, e.value, turn), len(e.value)
    signs = "0123456789" if e.type in ("phone", "card", "national", "ip", "iban") else "abcdefghijklmnopqrstuvwxyz"
    out = []
    for i in range(max(7, size) if e.type == "name" else size):
        if i % 32 == 31:
            n = _number(key, "fresh", e.type, e.value, turn, i)
        n, d = divmod(n, len(signs))
        out.append(signs[d])
    return "".join(out).title() if e.type == "name" else "".join(out)


def _same(e: Entity) -> tuple[str, str]:
    """What mentions of one entity share."""
    if e.type in ("card", "phone"):
        return e.type, "".join(c for c in e.value if c.isdigit())
    return e.type, e.value.lower() if e.type == "email" else e.value


def replace_text(text: str | None, key: str) -> tuple[str | None, list[tuple[str, int, int, str]]]:
    """(text with surrogates, entities as (type, start, end, surrogate); positions are those in the given text)."""
    found = find(text) if text else []
    if not found:
        return text, []
    originals, taken, chosen = {e.value.lower() for e in found}, {}, {}
    for e in found:
        who = _same(e)
        for turn in range(16 if (who, e.value) not in chosen else 0):
            s = surrogate(e, key, chosen.get(who, turn))
            if s.lower() not in originals and taken.setdefault(s.lower(), who) == who:
                chosen[who], chosen[who, e.value] = chosen.get(who, turn), s
                break
            chosen.pop(who, None)
        turn = 0
        while (who, e.value) not in chosen:  # ever new values, so this ends
            s = fresh(e, key, turn)
            turn += 1
            if s.lower() not in originals and taken.setdefault(s.lower(), who) == who:
                chosen[who, e.value] = s
    out, at, marks = [], 0, []
    for e in found:
        s = chosen[_same(e), e.value]
        out += [text[at : e.start], s]
        at = e.end
        marks.append((e.type, e.start, e.end, s))
    return "".join([*out, text[at:]]), marks


MARK = T.StructType([T.StructField("type", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("surrogate", T.StringType())])
_MARK = pa.list_(pa.struct([("type", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("surrogate", pa.string())]))


def _texts(col: pa.Array) -> list[str | None]:
    try:
        return col.to_pylist()
    except UnicodeDecodeError:
        return [None if x is None else x.decode("utf-8", "replace") for x in col.cast(pa.large_binary()).to_pylist()]


def replace(docs: DataFrame, key: str, text: str = "text", entities: str | None = None) -> DataFrame:
    """docs with surrogates in its text column; with `entities`, also a column of that name that lists types, places and surrogates (never
    the originals)."""
    ready(docs.sparkSession)
    schema = T.StructType(docs.schema.fields + ([T.StructField(entities, T.ArrayType(MARK))] if entities else []))
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, text):
                done = [replace_text(x, key) for x in _texts(b.column(at))]
                cols = list(b.columns)
                cols[at] = pa.array([x for x, _ in done], pa.string())
                if entities:
                    cols.append(pa.array([[dict(zip(("type", "start", "end", "surrogate"), m)) for m in marks] for _, marks in done], _MARK))
                yield pa.RecordBatch.from_arrays(cols, schema.names)

    return docs.mapInArrow(run, schema)


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = replace(load(spark, sf_dir).select("doc_id", "text"), TEST_KEY, entities="entities")
    return done.selectExpr("doc_id", "coalesce(size(entities), 0) as n_entities", "text", "entities")
