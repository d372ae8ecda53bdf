"""Text functions as Column expressions; they stay inside generated code wherever Spark allows it."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The full-width forms U+FF01..U+FF5E and the ASCII characters that they stand for.
WIDE = "".join(map(chr, range(0xFF01, 0xFF5F)))
NARROW = "".join(map(chr, range(0x21, 0x7F)))
#: White space as Unicode has it, with the four separators that Java leaves out.
SPACES = r"(?U)[\s\x1c-\x1f]+"
#: What a normalised text has none of.
ODD = r"(?U)[\s\x1c-\x1f\uff01-\uff5e]"
#: A signed or parenthesised amount with group commas, a fraction and a per cent sign. Fixed value.
NUMBER = r"[-+(]?\d[\d,]*(?:\.\d+)?%?\)?"
#: Ranges counted as CJK where transcripts are joined. Fixed value.
CJK = r"[　-鿿豈-﫿＀-￯]"


def narrow(c: Column) -> Column:
    """Full-width forms to ASCII."""
    return F.translate(c, WIDE, NARROW)


def widen_digits(c: Column) -> Column:
    """ASCII digits to full-width ones."""
    return F.translate(c, "0123456789", "".join(chr(0xFF10 + i) for i in range(10)))


def normalize(c: Column) -> Column:
    """Full-width forms folded, white space deleted; everything else stays, and a text with nothing of both is only read."""
    return F.when(F.regexp_like(c, F.lit(ODD)), F.regexp_replace(narrow(c), SPACES, "")).otherwise(c)


def numbers(c: Column) -> Column:
    """Numeric tokens, after folding full-width forms and dropping ASCII blanks only."""
    return F.regexp_extract_all(F.replace(narrow(c), F.lit(" "), F.lit("")), F.lit(NUMBER), F.lit(0))


def whole_number(text: Column, token: Column) -> Column:
    """Whether the normalised text holds the normalised token as a number of its own."""
    quoted = F.concat(F.lit(r"(?<![\d.,])\Q"), F.replace(normalize(token), F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E(?![\d.,%])"))
    return F.regexp_like(normalize(text), quoted)


def error_rate(edits: Column, characters: Column) -> Column:
    """Sum of edits over sum of characters; null where there are no characters."""
    return F.try_divide(F.sum(edits).cast("double"), F.sum(characters))


def sequence_edits(a: list, b: list) -> int:
    """Edits between two sequences, by bit vectors over the first one: a few operations on integers for each item of the second."""
    first = 0
    while first < min(len(a), len(b)) and a[first] == b[first]:
        first += 1
    last = 0
    while last < min(len(a), len(b)) - first and a[-1 - last] == b[-1 - last]:
        last += 1
    a, b = a[first : len(a) - last], b[first : len(b) - last]
    if not a or not b:
        return len(a) + len(b)
    places: dict = {}
    for i, x in enumerate(a):
        places.setdefault(x, []).append(i)
    masks = {x: sum(1 << i for i in own) for x, own in places.items()}
    full, top, edits = (1 << len(a)) - 1, 1 << len(a) - 1, len(a)
    more, less = full, 0  # where a column's value is one more, or one less, than the value above it
    for x in b:
        match = masks.get(x, 0)
        down = match | less
        across = (((match & more) + more) ^ more) | match
        up = less | ~(across | more) & full
        drop = more & across
        edits += bool(up & top) - bool(drop & top)
        up, drop = (up << 1 | 1) & full, drop << 1 & full
        more, less = drop | ~(down | up) & full, up & down
    return edits


def word_edits(a: Column, b: Column) -> Column:
    """Edits between two arrays of words, of any number; null where one of them is."""

    @F.pandas_udf("int")
    def run(left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else sequence_edits(list(x), list(y)) for x, y in zip(left, right, strict=True)], dtype="Int32")

    return run(a, b)


def ascii_fold(c: Column) -> Column:
    """Every character beyond ASCII as a question mark (for byte-counting edit distances)."""
    return F.regexp_replace(c, r"[^\x00-\x7f]", "?")


def join_transcript(parts: Column) -> Column:
    """Segments in one text: a blank between two of them unless one of the neighbours is CJK; blank ones are left out."""
    kept = F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != "")
    tight = lambda a, b: F.right(a, F.lit(1)).rlike(CJK) | F.left(b, F.lit(1)).rlike(CJK)
    before = F.concat(F.array(F.lit("")), F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0))))
    return F.array_join(F.zip_with(kept, before, lambda x, b: F.when((b == "") | tight(b, x), x).otherwise(F.concat(F.lit(" "), x))), "")


def modeling_unit(cjk: Column, others: Column) -> Column:
    """Unit of a recogniser by its tokens: whether any is CJK, and whether any other is a word piece; null without tokens."""
    return F.when(cjk & others, "cjkchar+bpe").when(cjk, "cjkchar").when(others, "bpe")


def hotwords(words: Column, most: int = 200, chars: int = 40) -> Column:
    """The first ``most`` words: white space collapsed, non-printing characters dropped, cut, trimmed, first of equals kept."""
    clean = lambda w: F.trim(F.left(F.trim(F.regexp_replace(F.regexp_replace(w, SPACES, " "), r"\p{C}", "")), F.lit(chars)))
    return F.array_distinct(F.filter(F.transform(F.slice(words, 1, most), clean), lambda w: w.isNotNull() & (w != "")))


def upper_ascii(c: Column) -> Column:
    """Upper case for a-z alone."""
    return F.translate(c, "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def package_name(c: Column) -> Column:
    """Lower-cased package name with runs of separators as one hyphen."""
    return F.lower(F.regexp_replace(c, r"[-_.]+", "-"))


def requirement(c: Column) -> Column:
    """Name and version specifier of a requirement; extras and markers are dropped."""
    head = F.trim(F.split_part(c, F.lit(";"), F.lit(1)))
    name = F.regexp_extract(head, r"^([A-Za-z0-9][A-Za-z0-9._-]*)", 1)
    return F.struct(name.alias("name"), F.replace(F.regexp_extract(head, r"^[A-Za-z0-9][A-Za-z0-9._-]*\s*(?:\[[^\]]*\])?\s*(.*)$", 1), F.lit(" "), F.lit("")).alias("spec"))


def _release(v: Column) -> Column:
    """Numbers of a version's release part, null if there are none; local parts and suffixes are ignored."""
    lead = F.regexp_extract(F.split_part(F.trim(v), F.lit("+"), F.lit(1)), r"^(\d+(?:\.\d+)*)", 1)
    return F.when(lead != "", F.transform(F.split(lead, r"\."), lambda x: x.cast("bigint")))


def _padded(a: Column, n: Column) -> Column:
    return F.concat(a, F.array_repeat(F.lit(0).cast("bigint"), F.greatest(n - F.size(a), F.lit(0)).cast("int")))


def satisfies(version: Column, spec: Column) -> Column:
    """Whether a version meets all comma-separated clauses; an empty specifier is met, an unreadable one is not."""
    have = _release(version)

    def clause(raw: Column) -> Column:
        part = F.trim(raw)
        op = F.regexp_extract(part, r"^(~=|==|!=|<=|>=|<|>)\s*[0-9]\S*$", 1)
        rest = F.trim(F.substring(part, F.length(op) + F.lit(1), F.length(part)))
        star = rest.endswith(".*")
        want = _release(F.regexp_replace(rest, r"\.\*$", ""))
        n = F.greatest(F.size(have), F.size(want))
        a, b = _padded(have, n), _padded(want, n)
        prefix = F.slice(_padded(have, F.size(want)), F.lit(1), F.size(want)) == want
        base = F.slice(_padded(have, F.size(want)), F.lit(1), F.greatest(F.size(want) - 1, F.lit(1))) == F.slice(want, F.lit(1), F.greatest(F.size(want) - 1, F.lit(1)))
        met = (
            F.when(op == "==", F.when(star, prefix).otherwise(a == b)).when(op == "!=", a != b)
            .when(op == ">=", a >= b).when(op == "<=", a <= b).when(op == ">", a > b).when(op == "<", a < b).when(op == "~=", (a >= b) & base)
        )
        return (op != "") & F.coalesce(met, F.lit(False))

    return F.when(F.trim(spec) == "", F.lit(True)).otherwise(F.coalesce(have.isNotNull() & F.forall(F.split(spec, ","), clause), F.lit(False)))


def build_variant(version: Column) -> Column:
    """Vendor of a build from its local version part."""
    return F.when(version.contains("+cu"), "nvidia").when(version.contains("+rocm"), "amd").when(version.contains("+cpu"), "cpu").otherwise("unknown")


def model_name(repo: Column) -> Column:
    """Last part of a repository path, lower-cased, without a trailing -hf."""
    leaf = F.regexp_extract(F.regexp_replace(repo, r"[/\\]+$", ""), r"([^/\\]*)$", 1)
    return F.regexp_replace(F.lower(leaf), "-hf$", "")


def split_transcript(raw: Column) -> Column:
    """Language (40 characters at most, empty if none) and text of ``language X<asr_text>...`` without end tokens."""
    has = F.instr(raw, "<asr_text>") > 0
    head = F.trim(F.when(has, F.split_part(raw, F.lit("<asr_text>"), F.lit(1))).otherwise(""))
    text = F.when(has, F.substring(raw, F.instr(raw, "<asr_text>") + F.lit(10), F.length(raw))).otherwise(raw)
    for token in ("<|im_end|>", "<|endoftext|>", "</s>"):
        text = F.replace(text, F.lit(token), F.lit(""))
    lang = F.when(F.lower(head).startswith("language"), F.trim(F.substring(head, F.lit(9), F.length(head)))).otherwise(head)
    return F.struct(F.left(lang, F.lit(40)).alias("lang"), F.trim(text).alias("text"))


def printable(c: Column, most: int = 60) -> Column:
    """Printable characters, cut; a hyphen if nothing is left."""
    left = F.left(F.regexp_replace(c, r"\p{C}", ""), F.lit(most))
    return F.when(left == "", "-").otherwise(left)


def distinct_tags(tags: Column) -> Column:
    """Tag lines a-b-c in one compressed tag: the different values of each field in order."""
    field = lambda i: F.array_join(F.array_distinct(F.transform(tags, lambda t: F.split_part(t, F.lit("-"), F.lit(i)))), ".")
    return F.concat_ws("-", field(1), field(2), field(3))


def format_bytes(n: Column) -> Column:
    """Bytes as B, KB, MB or GB."""
    unit = lambda size, digits, name: F.concat(F.format_number(n / F.lit(float(size)), digits), F.lit(name))
    return F.when(n >= 1 << 30, unit(1 << 30, 1, " GB")).when(n >= 1 << 20, unit(1 << 20, 0, " MB")).when(n >= 1 << 10, unit(1 << 10, 0, " KB")).otherwise(F.concat(n.cast("string"), F.lit(" B")))


def format_duration(seconds: Column) -> Column:
    """Seconds as h:mm:ss, m:ss below an hour, --:-- below zero."""
    s = F.bround(seconds).cast("bigint")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    h, m = F.floor(s / 3600), F.floor(s % 3600 / 60)
    return F.when(seconds < 0, "--:--").when(h > 0, F.concat(h.cast("string"), F.lit(":"), two(m), F.lit(":"), two(s % 60))).otherwise(F.concat(m.cast("string"), F.lit(":"), two(s % 60)))


def timestamp_ms(ms: Column, comma: str = ",") -> Column:
    """Milliseconds as HH:mm:ss,SSS."""
    two = lambda c, n=2: F.lpad(F.floor(c).cast("string"), n, "0")
    return F.concat(two(ms / 3600000), F.lit(":"), two(ms % 3600000 / 60000), F.lit(":"), two(ms % 60000 / 1000), F.lit(comma), two(ms % 1000, 3))


def guard_formula(c: Column) -> Column:
    """Texts that a spreadsheet would take for a formula get an apostrophe; plain numbers do not."""
    return F.when(c.rlike(r"^[=+\-@\t\r]") & ~c.rlike(r"^[-+]?\d+(\.\d+)?$"), F.concat(F.lit("'"), c)).otherwise(c)


def search_terms(c: Column) -> Column:
    """CJK bigrams and lower-cased ASCII words, the same for texts and queries."""
    runs = F.when(F.octet_length(c) > F.length(c), F.regexp_extract_all(c, F.lit(r"[一-鿿]{2,}"), F.lit(0))).otherwise(F.array().cast("array<string>"))  # plain ASCII has none
    pairs = F.flatten(F.transform(runs, lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substring(r, i, F.lit(2)))))
    return F.concat(pairs, F.regexp_extract_all(F.lower(c), F.lit(r"[a-z0-9]+"), F.lit(0)))


def absent_share(gold: Column, block: Column) -> Column:
    """Share of the gold text's characters that the block has nowhere: a lower bound of the edit cost."""
    absent = F.call_function("translate", gold, block, F.lit(""))  # without the characters that the block has
    return F.try_divide(F.length(absent).cast("double"), F.length(gold))


def sniff(data: Column) -> Column:
    """Audio format by its first bytes; below twelve bytes unknown."""
    at = lambda a, n: F.hex(F.substring(data, a, n))
    name = lambda s: s.encode().hex().upper()
    return (
        F.when(F.octet_length(data) < 12, "unknown").when((at(1, 4) == name("RIFF")) & (at(9, 4) == name("WAVE")), "wav").when(at(1, 4) == name("fLaC"), "flac")
        .when(at(1, 4) == name("OggS"), "ogg").when(at(1, 4) == "1A45DFA3", "webm").when(at(5, 4) == name("ftyp"), "m4a").when(at(1, 3) == name("ID3"), "mp3")
        .when(at(1, 2).rlike("^FF[EF]"), "mp3").when(at(1, 4) == name("caff"), "caf").when(at(1, 5) == name("#!AMR"), "amr").otherwise("unknown")
    )


#: Characters that a prompt, a language and a model name are cut to, and bytes that an upload, a chunk and a JSON body may have. Fixed values.
CUTS = {"prompt": 2000, "language": 40, "model": 4096}
CAPS = {"upload": 25 << 20, "chunk": 1 << 20, "json": 64 << 10}


def cut(c: Column, kind: str) -> Column:
    return F.left(c, F.lit(CUTS[kind]))


def body_status(size: Column, kind: str) -> Column:
    """413 for bodies of more bytes than their kind may have."""
    return F.when(size > CAPS[kind], 413).otherwise(200)


def new_tokens(seconds: Column) -> Column:
    """Twenty for each second, between 64 and 1,024."""
    return F.least(F.lit(1024), F.greatest(F.lit(64), F.floor(seconds * 20).cast("int")))


def masked(text: Column, spans: Column, mark: str = "\0") -> Column:
    """The text with every character of the spans (array of start, end) replaced by the mark."""
    fill = lambda t, s: F.concat(F.left(t, s["start"]), F.repeat(F.lit(mark), s["end"] - s["start"]), F.substring(t, s["end"] + 1, F.length(t)))
    return F.aggregate(spans, text, fill)
