"""Surrogates for personal data and secrets.

Detected entities get keyed replacements of the same type and format: digits for digits, letters for
letters of the same case, card numbers with a valid check digit, IBANs with check digits that are valid
where theirs were, phone numbers of the same country, addresses of the same kind (public, private,
loopback, ...), names of the same gender and script for names after a form of address.  Numbers count as
cards only if their check digit is valid.  All types but names use a keyed permutation of what may vary:
a Feistel network P, of which P backwards after one step on after P is applied.  That is one cycle through all
values, so two different entities of a format never share a replacement and none stays, however
many of the format's values are in use; what has no digit and no letter has nothing to replace.  It works on normalised
entities (digits without separators, lower-cased addresses), so one entity gets one replacement in every
spelling and every document: coreference survives.  Each word of a name is replaced by itself, also
where it stands again in the document without a form of address, and so are the parts between its hyphens and
apostrophes, which stay.  Names that never stand after one of the forms below, or after a greeting with two
words or more, are not found; words for offices (ROLES) are no names.

Latin, Cyrillic and Greek names are spelled from keyed syllables and could meet; ``choose_key`` therefore
checks what would be written for all different spellings of the corpus, in aggregations over entities, for shared
replacements, for entities with several, and for names that would stay as they are, and goes on to
the next key version, with longer names, until there are none.  Names of any other script are permuted among
that script's letters, each within its block of code points.  Entities are found in one pass over the
texts, which writes the texts with their places for the pass that replaces them.

Rows: null texts stay null and empty texts empty; texts without entities stay as they are, byte for
byte; repeated rows get equal results; an empty table gives an empty table; all columns pass through.
"""

from __future__ import annotations

import functools
import hashlib
import hmac
import ipaddress
import re
import struct
import unicodedata
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import by_size, discard, fresh, materialize, without

KEY = b"set your own key"
ROUNDS = 8
VERSIONS = 12  # key versions tried before giving up

# Forms of address: fixed values.
MALE = ("Mr", "Mister", "Sir", "Lord", "Herr", "Monsieur", "Señor", "Signor", "Don", "Господин")
FEMALE = ("Mrs", "Ms", "Miss", "Madam", "Lady", "Frau", "Madame", "Mademoiselle", "Mme", "Mlle", "Señora", "Señorita", "Signora", "Doña", "Госпожа")
NEUTRAL = ("Dr", "Prof", "Professor", "Doctor", "Doktor", "Docteur", "Доктор")
FORMS = (*MALE, *FEMALE, *NEUTRAL)
# Words that stand where a name could and are none.
ROLES = {"President", "Präsident", "Président", "Chairman", "Chairwoman", "Speaker", "Minister", "Secretary", "Mayor", "Judge", "Director", "Manager", "Hiring", "Customer", "Customers", "Colleague", "Colleagues", "Team", "Friend", "Friends", "Members", "Editor", "Client", "Support", "Sales", "Service", "Recruiter", "Committee"}
GREETING = ("Dear", "Liebe", "Lieber", "Cher", "Chère", "Estimado", "Estimada", "Querido", "Querida")
GREETED = {"Liebe": "f", "Lieber": "m", "Cher": "m", "Chère": "f", "Estimado": "m", "Estimada": "f", "Querido": "m", "Querida": "f"}
# Calling codes of two digits; 1 and 7 have one, all others three: fixed values.
TWO_DIGITS = "20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()
# Address blocks that are not public, as (first octets, what may vary after them).
BLOCKS = [
    ((10,), (256, 256, 256)), ((127,), (256, 256, 256)), ((0,), (256, 256, 256)), ((192, 168), (256, 256)), ((169, 254), (256, 256)),
    *(((172, x), (256, 256)) for x in range(16, 32)), *(((x,), (256, 256, 256)) for x in range(224, 256)),
]

_NAME = r"[^\W\d_a-z](?:[^\W\d_]|['’-](?=[^\W\d_]))+"
PATTERNS = [
    ("email", r"(?<![\w.+-])[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)+"),
    ("cloud_key", r"(?<![A-Za-z0-9])(?:(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36})(?![A-Za-z0-9])"),
    ("secret", r"(?i:\b(?:password|passwd|pwd|passphrase|secret|token|api[_-]?key|access[_-]?key))[\"']?\s{0,3}[=:]\s{0,3}[\"']?([^\s\"'<>]{6,})"),
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    ("ip", r"(?<![\w.])(?:25[0-5]|2[0-4]\d|1?\d?\d)(?:\.(?:25[0-5]|2[0-4]\d|1?\d?\d)){3}(?![\w]|\.\d)"),
    ("ip6", r"(?<![\w:.])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![\w:])"),
    ("ip6", r"(?<![\w:.])(?=[0-9A-Fa-f]*[0-9])[0-9A-Fa-f]{3,4}:(?:[0-9A-Fa-f]{1,4}:){0,5}(?::[0-9A-Fa-f]{1,4}){1,6}(?![\w:])"),
    ("ssn", r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"),
    ("card", r"(?<![\w.-])[3-6]\d{3}(?:[ -]?\d{4}){2}[ -]?\d{1,7}(?![\w-])"),
    ("phone", r"(?<![\w.+-])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{2,4}[ .-])\d{3,4}[ .-]\d{3,4}(?![\w-])"),
    ("phone", r"(?<![\w.+-])\+\d{9,15}(?![\w-])"),
    ("phone", r"(?<![\w.+-])00[1-9]\d{0,2}[ .-]\d{2,4}[ .-]\d{4,8}(?![\w-])"),
    ("name", rf"\b(?:(?:{'|'.join(FORMS)})\b\.?[ \u00a0]){{1,3}}{_NAME}(?:[ \u00a0]{_NAME}){{0,2}}"),
    ("name", rf"\b(?:{'|'.join(GREETING)})[ \u00a0](?!(?:{'|'.join(FORMS)})\b){_NAME}(?:[ \u00a0]{_NAME}){{1,2}}"),
]
MASTER = re.compile("|".join(f"(?P<p{i}>{p})" for i, (_, p) in enumerate(PATTERNS)))
HINT = re.compile(rf"\d|@|[=:]|\b(?:{'|'.join((*FORMS, *GREETING))})\b")
NAME = re.compile(_NAME)
WORD = re.compile(r"(?<![^\W_])[^\W\d_](?:[^\W\d_]|['’-](?=[^\W\d_]))*(?![^\W_])")
PART = re.compile(r"[^\W\d_]+")
_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

# Consonants, vowels and endings (male, female, family) of the scripts names are spelled in.
SPELLING = {
    "latin": ("bcdfgklmnprstvz", "aeiou", ("an", "er", "o"), ("a", "ia", "ina"), ("mont", "well", "ard", "ez", "sen")),
    "cyrillic": ("бвгдзклмнпрст", "аеиоу", ("ан", "ир", "ей"), ("а", "ия", "ина"), ("ов", "ин", "ский")),
    "greek": ("βγδκλμνπρστφ", "αειου", ("ος", "ης", "ας"), ("α", "ια", "ινη"), ("ιδης", "ου", "ακης")),
}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def iban_check(country: str, account: str) -> int:
    """The check digits that make an IBAN valid."""
    return 98 - int("".join(str(int(c, 36)) for c in f"{account}{country}00")) % 97


def block_of(octets: list[int]) -> tuple[tuple[int, ...], tuple[int, ...]]:
    """The block of an address that is not public: its first octets and the ranges of the rest; empty for public ones."""
    return next((b for b in BLOCKS if tuple(octets[: len(b[0])]) == b[0]), ((), ()))


def script_of(word: str) -> str | None:
    """The script that a name is spelled in, if names of it are spelled from syllables."""
    return "cyrillic" if re.search("[\u0400-\u04ff]", word) else "greek" if re.search("[\u0370-\u03ff]", word) else "latin" if all(c < "\u0250" or "\u1e00" <= c < "\u1f00" for c in word) else None


@functools.cache
def letters_like(c: str) -> str:
    """The letters of a letter's kind in its block of 256 code points: replacements that keep the script."""
    first = ord(c) >> 8 << 8
    kind = unicodedata.category(c)
    return "".join(x for x in map(chr, range(first, first + 256)) if unicodedata.category(x) == kind)


class Surrogates:
    """Keyed replacements of one key version."""

    def __init__(self, key: bytes = KEY, version: int = 0):
        self.key, self.version = hmac.digest(key, b"version %d" % version, "sha256"), version

    def _number(self, tweak: str, *values: int | str) -> int:
        return int.from_bytes(hashlib.blake2b(repr((tweak, *values)).encode(), key=self.key, digest_size=32).digest(), "big")

    def permute(self, tweak: str, digits: list[int], radices: list[int]) -> list[int]:
        """A keyed permutation of the numbers with these radices (256 at most) in one cycle, so that none stays; in linear time."""
        if len(digits) < 2:
            return [(d + 1 + self._number(tweak, i) % (r - 1)) % r if r > 1 else d for i, (d, r) in enumerate(zip(digits, radices, strict=True))]
        there = self._feistel(tweak, digits, radices)
        for i in reversed(range(len(there))):  # the next number, and the first one after the last
            there[i] = (there[i] + 1) % radices[i]
            if there[i]:
                break
        return self._feistel(tweak, there, radices, back=True)

    def _feistel(self, tweak: str, digits: list[int], radices: list[int], back: bool = False) -> list[int]:
        """Rounds on two halves, or those rounds undone."""
        half = len(digits) // 2
        left, right, n, m = digits[:half], digits[half:], radices[:half], radices[half:]
        for k in range(ROUNDS):
            if back:
                right = self._shift(f"{tweak} {2 * (ROUNDS - k) - 1}", right, m, left, -1)
                left = self._shift(f"{tweak} {2 * (ROUNDS - k) - 2}", left, n, right, -1)
            else:
                left = self._shift(f"{tweak} {2 * k}", left, n, right)
                right = self._shift(f"{tweak} {2 * k + 1}", right, m, left)
        return left + right

    def _shift(self, tweak: str, digits: list[int], radices: list[int], other: list[int], sign: int = 1) -> list[int]:
        """Each digit moved on (or back) by a number that depends on the other half."""
        stream = hashlib.shake_256(self.key + tweak.encode() + b"\0" + bytes(other)).digest(4 * len(digits))
        return [(d + sign * x) % r for d, x, r in zip(digits, struct.unpack(f"<{len(digits)}I", stream), radices, strict=True)]

    def by_class(self, kind: str, text: str, hexadecimal: bool = False) -> str:
        """Each digit and letter for one of its class; other characters stay."""
        sets = [next((s for s in ((_DIGITS + "abcdef",) if hexadecimal else (_DIGITS, _LOWER, _UPPER)) if c in s), "") for c in text]
        at = [i for i, s in enumerate(sets) if s]
        shape = "".join({"": c, _DIGITS: "9", _LOWER: "a", _UPPER: "A"}.get(s, "f") for c, s in zip(text, sets, strict=True))
        new = self.permute(f"{kind} {shape}", [sets[i].index(text[i]) for i in at], [len(sets[i]) for i in at])
        out = list(text)
        for i, d in zip(at, new, strict=True):
            out[i] = sets[i][d]
        return "".join(out)

    def digits(self, kind: str, digits: str) -> str:
        return "".join(map(str, self.permute(f"{kind} {len(digits)}", list(map(int, digits)), [10] * len(digits))))

    def word(self, word: str, gender: str) -> str:
        """A name word for a name word: script, case, gender, hyphens and apostrophes stay."""
        if not word.isalpha():
            return PART.sub(lambda m: self.word(m.group(), gender) if len(m.group()) > 1 else m.group(), word)
        script = script_of(word)
        if script is None:
            sets = [letters_like(c) for c in word]
            return "".join(s[i] for s, i in zip(sets, self.permute(f"name {[s[0] for s in sets]}", [s.index(c) for s, c in zip(sets, word, strict=True)], [len(s) for s in sets]), strict=True))
        consonants, vowels, *endings = SPELLING[script]
        x = self._number(f"name {script} {gender}", word.lower())
        out = ""
        for _ in range(2 + self.version):
            x, a = divmod(x, len(consonants))
            x, b = divmod(x, len(vowels))
            out += consonants[a] + vowels[b]
        ends = endings["mf-".index(gender)]
        out += consonants[x % len(consonants)] + ends[x // len(consonants) % len(ends)]
        return out.upper() if len(word) > 1 and word.isupper() else out.capitalize()

    def normal(self, kind: str, entity: str) -> str:
        """What is the same in all spellings of an entity."""
        if kind == "phone" and entity.startswith("00"):
            return "+" + re.sub(r"\D", "", entity)[2:]
        if kind in ("card", "ssn", "phone"):
            return ("+" if entity.startswith("+") else "") + re.sub(r"\D", "", entity)
        if kind == "ip6":
            return ipaddress.IPv6Address(entity).exploded
        if kind == "email" or kind.startswith("name"):
            return entity.lower()
        return entity.replace(" ", "") if kind == "iban" else entity

    def replace(self, kind: str, entity: str) -> str:
        """The replacement of an entity other than a name, in its spelling."""
        if kind == "ip":
            octets = list(map(int, entity.split(".")))
            first, rest = block_of(octets)
            if first:
                return ".".join(map(str, (*first, *self.permute(f"{kind} {first}", octets[len(first) :], list(rest)))))
            while True:  # walks until the address is public, which keeps this a permutation of public ones
                octets = self.permute(kind, octets, [256] * 4)
                if not block_of(octets)[0]:
                    return ".".join(map(str, octets))
        if kind == "ip6":
            raw = ipaddress.IPv6Address(entity).packed
            new = ipaddress.IPv6Address(raw[:2] + bytes(self.permute(f"{kind} {raw[:2].hex()}", list(raw[2:]), [256] * 14)))
            return new.compressed if "::" in entity else new.exploded
        if kind == "email":
            local, _, domain = entity.lower().partition("@")
            host, dot, top = domain.rpartition(".")
            new = self.by_class(kind, f"{local}@{host}") + dot + top
            return "".join(n.upper() if c.isupper() else n for c, n in zip(entity, new, strict=True))
        if kind == "cloud_key":
            return entity[:4] + self.by_class(kind, entity[4:])
        if kind == "secret":
            return self.by_class(kind, entity, hexadecimal=bool(re.fullmatch("[0-9a-f]+", entity)))
        if kind == "iban":
            raw = entity.replace(" ", "")
            country, check, account = raw[:2], int(raw[2:4]), raw[4:]
            given = self.by_class(f"{kind} {country}", account)
            new = iter(f"{country}{(iban_check(country, given) + check - iban_check(country, account)) % 100:02d}{given}")
            return "".join(c if c == " " else next(new) for c in entity)
        raw = re.sub(r"\D", "", entity)
        if kind == "card":
            valid = luhn(raw)
            new = raw
            while True:  # walks until the number is as valid as it was, which keeps this a permutation
                new = new[0] + self.digits(f"{kind} {raw[0]}", new[1:])
                if luhn(new) == valid:
                    break
        elif kind == "phone":
            out = "00" if entity.startswith("00") else ""
            raw = raw.removeprefix(out)
            keep = 0 if not out and not entity.startswith("+") else 1 if raw[0] in "17" else 2 if raw[:2] in TWO_DIGITS else 3
            new = out + raw[:keep] + self.digits(f"{kind} {raw[:keep]}", raw[keep:])
        else:
            new = self.digits(kind, raw)
        at = iter(new)
        return "".join(next(at) if c.isdigit() else c for c in entity)


def addressed(words: list[str]) -> tuple[str, list[str]]:
    """Gender and name after a greeting or forms of address, the last of which may be a name itself."""
    gender = "-"
    for k, w in enumerate(words):
        if w not in FORMS and w not in GREETING or k == len(words) - 1:
            return gender, [x for x in words[k:] if x not in ROLES]
        if gender == "-":
            gender = "f" if w in FEMALE else "m" if w in MALE else GREETED.get(w, "-")
    return gender, []


def is_ip6(text: str) -> bool:
    try:
        return bool(ipaddress.IPv6Address(text))
    except ValueError:
        return False


def find(text: str) -> list[tuple[int, int, str]]:
    """(first, end, type) of all entities, in order; for names, of each word with its part: name-m, name-f or name--."""
    if not HINT.search(text):
        return []
    out, words = [], {}
    for m in MASTER.finditer(text):
        i = int(m.lastgroup[1:]) if m.lastgroup else next(k for k in range(len(PATTERNS)) if m.group(f"p{k}") is not None)
        kind = PATTERNS[i][0]
        if kind == "secret":
            out.append((*m.span(m.lastindex + 1), kind))  # the value alone; its group follows the pattern's own
        elif kind == "card":
            raw = re.sub(r"\D", "", m.group())
            if 13 <= len(raw) <= 19 and luhn(raw):
                out.append((*m.span(), kind))
        elif kind == "name":
            gender, own = addressed([w.group() for w in NAME.finditer(text, *m.span())])
            for k, w in enumerate(own):
                for x in (w, *(p for p in PART.findall(w) if len(p) > 1)):
                    words.setdefault(x, f"name-{gender if k < len(own) - 1 else '-'}")
        elif kind == "ip6":
            if is_ip6(m.group()):
                out.append((*m.span(), kind))
        else:
            out.append((*m.span(), kind))
    return merge(out, named(text, words)) if words else out


def named(text: str, words: dict[str, str]) -> list[tuple[int, int, str]]:
    """Places of the words of names: whole words, else the parts between apostrophes and hyphens."""
    out = []
    for m in WORD.finditer(text):
        if m.group() in words:
            out.append((*m.span(), words[m.group()]))
        elif not m.group().isalpha():
            out += [(*p.span(), words[p.group()]) for p in PART.finditer(text, *m.span()) if p.group() in words]
    return out


def merge(taken: list[tuple[int, int, str]], more: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Both lists of places in order, without those of the second that meet the first; each is in order."""
    out, i = [], 0
    for a, b, kind in more:
        while i < len(taken) and taken[i][1] <= a:
            out.append(taken[i])
            i += 1
        if i == len(taken) or b <= taken[i][0]:
            out.append((a, b, kind))
    return out + taken[i:]


def replacement(own: Surrogates, kind: str, entity: str) -> str:
    return own.word(entity, kind[-1]) if kind.startswith("name") else own.replace(kind, entity)


def rewrite(text: str, own: Surrogates, found: list[tuple[int, int, str]] | None = None) -> tuple[str, list[tuple[int, int, str]]]:
    """The text with replacements of what was found in it, and where they stand in it."""
    out, spans, at, size = [], [], 0, 0
    for a, b, kind in find(text) if found is None else found:
        new = replacement(own, kind, text[a:b])
        out += [text[at:a], new]
        size += a - at
        spans.append((size, size + len(new), kind.partition("-")[0]))
        size += len(new)
        at = b
    return "".join([*out, text[at:]]), spans


def _bounded(f: Callable, name: str = "text"):
    """Applies a function to slices of batches, so that memory follows the longest text."""
    return lambda batches: (f(batch) for batch in by_size(batches, name))


def _spans(found: list[list[tuple[int, int, str]]]) -> pa.Array:
    """Places as lists of structs, built column by column."""
    flat = [x for own in found for x in own]
    columns = [pa.array([x[i] for x in flat], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.string()))]
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, found)]).astype(np.int32)), pa.StructArray.from_arrays(columns, names=["first", "end", "type"]))


SPANS = "array<struct<first:int,end:int,type:string>>"


def detect(docs: DataFrame, text: str, spans: str) -> DataFrame:
    """All rows and columns, plus the places of entities in a column of this name."""
    schema = T.StructType([*docs.schema.fields, T.StructField(spans, T._parse_datatype_string(SPANS))])
    run = lambda batch: pa.RecordBatch.from_arrays([*batch.columns, _spans([find(x) if x else [] for x in batch.column(text).to_pylist()])], names=[f.name for f in schema])
    return docs.mapInArrow(_bounded(run, text), schema)


def spellings(found: DataFrame, text: str, spans: str) -> DataFrame:
    """The different spellings of all entities found: type and spelling."""
    rows = found.filter(F.size(spans) > 0).select(text, F.explode(spans).alias("x"))
    return rows.select(F.col("x.type").alias("kind"), F.substring(text, F.col("x.first") + 1, F.col("x.end") - F.col("x.first")).alias("entity")).distinct()


def choose_key(docs: DataFrame, key: bytes = KEY, text: str = "text") -> int:
    """The key version that the texts of ``docs`` are rewritten under."""
    places = fresh(docs, "places")
    return key_for(materialize(spellings(detect(docs, text, places), text, places), "pii-spellings"), key)


def key_for(known: DataFrame, key: bytes = KEY) -> int:
    """The first key version under which no two entities (kind, entity) share a replacement, none has several, and no name stays."""
    for version in range(VERSIONS):

        def run(batch, version=version):
            own = Surrogates(key, version)
            kinds, values = batch.column("kind").to_pylist(), batch.column("entity").to_pylist()
            old = [own.normal(k, x) for k, x in zip(kinds, values, strict=True)]
            new = [own.normal(k, replacement(own, k, x)) for k, x in zip(kinds, values, strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in (kinds, old, new)], names=["kind", "old", "new"])

        mapped = known.mapInArrow(_bounded(run, "entity"), "kind string, old string, new string").distinct()
        shared = mapped.groupBy("kind", "new").agg(F.count("*").alias("n"), F.max((F.col("kind").startswith("name") & (F.col("old") == F.col("new"))).cast("int")).alias("stays")).filter("n > 1 or stays = 1")
        several = mapped.groupBy("kind", "old").agg(F.count("*").alias("n"), F.lit(0).alias("stays")).filter("n > 1")
        if shared.select("kind").unionByName(several.select("kind")).limit(1).count() == 0:
            return version
    raise ValueError(f"entities share replacements under {VERSIONS} key versions")


def replace_entities(docs: DataFrame, key: bytes = KEY, text: str = "text", spans: str | None = None) -> DataFrame:
    """All rows and columns with rewritten texts, plus the replacements' places in a column if one is named (a column of that name is replaced)."""
    docs = without(docs, spans) if spans else docs
    places = fresh(docs, "places")
    found = materialize(detect(docs, text, places), "pii-found")
    known = materialize(spellings(found, text, places), "pii-spellings")
    version = key_for(known, key)
    discard(known)
    schema = T.StructType([*docs.schema.fields, *([T.StructField(spans, T._parse_datatype_string(SPANS))] if spans else [])])
    names = docs.columns

    def run(batch):
        own = Surrogates(key, version)
        columns = batch.column(places).flatten()
        flat = list(zip(*(columns.field(i).to_pylist() for i in range(3)), strict=True))
        ends = np.cumsum(pc.list_value_length(batch.column(places)).to_numpy(zero_copy_only=False)).tolist()
        new = [(None, []) if x is None else rewrite(x, own, flat[a:b]) for x, a, b in zip(batch.column(text).to_pylist(), [0, *ends], ends, strict=False)]
        columns = [pa.array([x for x, _ in new], pa.string()) if n == text else batch.column(n) for n in names]
        return pa.RecordBatch.from_arrays(columns + [_spans([x for _, x in new])] * bool(spans), names=[f.name for f in schema])

    return found.mapInArrow(_bounded(run, text), schema)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data and secrets in all texts; n_chars follows the new text where it is there."""
    out = replace_entities(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return replace_entities(docs, spans="entities").select("doc_id", "text", F.size("entities").cast("long").alias("n_entities"), "entities")
