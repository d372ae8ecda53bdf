"""BPE with word ends, encoded by forced-boundary splitting, and its decoding.

Bytes that never stand side by side inside a token of the vocabulary can never be merged over: between them
is a certain cut.  Words are cut there, the fragments are merged one by one (lowest rank first, leftmost
first) and their ids are put one after the other, which gives the ids of the uncut word.  Only a word's
last fragment carries the end-of-word mark.

Texts are first taken apart at blanks, tabs and line ends, which the vocabulary's own splitting always drops and
over which its normalisation never reaches; each different part is encoded once and remembered by the worker
in two tables of bounded size, the older of which goes when the newer is full.  Parts of Latin-1 are split
by a pattern that equals the vocabulary's for them and merged together, fragment beside fragment, in numpy.  Special tokens inside a text are found in the raw
text, as the tokenizers library finds them.

Rows: a null text counts as empty (no ids, the empty text); repeated rows give repeated results; an empty
table gives an empty table; other columns pass through ``encode``, but those with the name of an output
column are replaced.  Texts are worked through in slices cut at blanks, so memory follows the ids of the
longest text and its longest run without a blank.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .merges import BLANKS, LATIN, LETTERS, NUMBERS, Pairs, latin_words
from .shared import by_size, strings, without

SLICE = 1 << 20  # characters of a text worked on at once
KNOWN = 300_000  # parts of texts that a worker remembers, and as many of those before
SHORT = 64  # characters of the longest remembered part
WORD = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{NUMBERS}]|[^{BLANKS}{LETTERS}{NUMBERS}]+|\n")


def byte_characters() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: itself if it is printable, else one from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = {b: 0x100 + i for i, b in enumerate(sorted(set(range(256)) - set(shown)))}
    return [chr(hidden.get(b, b)) for b in range(256)]


#: The normalisation and splitting that WORD stands for: canonical composition, lower case, words of these kinds. Fixed value.
PLAIN = json.dumps([
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}])


def slices(text: str, size: int = SLICE) -> Iterator[str]:
    """The text in slices of ``size`` characters or more that end before a blank; the blank between two is left out."""
    a = 0
    while (b := text.find(" ", a + size)) >= 0:
        yield text[a:b]
        a = b + 1
    yield text[a:]


class WordBpe:
    """Encoder and decoder of a vocabulary file; built on the driver, sent once, bounded by the file's size."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            self.file = f.read()
        data = json.loads(self.file)
        model = data["model"]
        if model["type"] != "BPE" or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "byte_fallback", "ignore_merges")) or data["post_processor"] or data["decoder"]:
            raise ValueError("a byte-level BPE with word ends, without post-processor and decoder, is needed")
        mark = model["end_of_word_suffix"] or ""
        vocabulary = model["vocab"]
        added = {x["content"]: x["id"] for x in data["added_tokens"]}
        self.tokens = {i: t for t, i in (vocabulary | added).items()}
        self.special = added
        if any(x["normalized"] or x["lstrip"] or x["rstrip"] or x["single_word"] or re.search(r"\s", x["content"]) for x in data["added_tokens"]):
            raise ValueError("added tokens must be taken from the raw text as they stand, and hold no white space")
        shown = byte_characters()
        byte_of = {c: b for b, c in enumerate(shown)}
        self.to_bytes = {ord(c): b for c, b in byte_of.items()}
        self.inner = [vocabulary[c] for c in shown]
        self.final = [vocabulary[c + mark] for c in shown]
        self.rank, self.made = {}, []
        for r, (a, b) in enumerate(model["merges"]):
            self.rank[vocabulary[a] << 32 | vocabulary[b]] = r
            self.made.append(vocabulary[a.removesuffix(mark) + b if mark else a + b])
        self.pairs = Pairs([k >> 32 for k in self.rank], [k & 0xFFFFFFFF for k in self.rank], list(self.rank.values()), self.made)
        # whether the vocabulary normalises and splits as WORD does after lower-casing, for texts of Latin-1
        self.plain = json.dumps([data["normalizer"], data["pre_tokenizer"]]) == PLAIN
        self.cut = np.ones((256, 256), bool)
        for t in vocabulary:
            own = [byte_of[c] for c in (t.removesuffix(mark) if mark else t)]
            self.cut[own[:-1], own[1:]] = False
        self.library = None
        self._start()

    def _start(self) -> None:
        self.parts: dict[str, bytes] = {"": b""}
        self.before: dict[str, bytes] = {}  # parts of the table that was full

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("parts", "before", "library", "raw")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.library = None
        self._start()

    def merge(self, fragment: bytes, last: bool) -> list[int]:
        """Ids of a fragment; ``last``: it ends its word."""
        ids = [self.inner[b] for b in fragment]
        if last:
            ids[-1] = self.final[fragment[-1]]
        n, get = len(ids), self.rank.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [r * n + i for i in range(n - 1) if (r := get(ids[i] << 32 | ids[i + 1])) is not None]
        heapify(heap)
        while heap:
            r, i = divmod(heappop(heap), n)
            j = after[i]
            if ids[i] < 0 or j == n or get(ids[i] << 32 | ids[j]) != r:
                continue  # one of the two parts has changed since
            ids[i], ids[j] = self.made[r], -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (q := get(ids[i] << 32 | ids[k])) is not None:
                    heappush(heap, q * n + i)
            h = before[i]
            if h >= 0 and (q := get(ids[h] << 32 | ids[i])) is not None:
                heappush(heap, q * n + h)
        return [x for x in ids if x >= 0]

    def words(self, part: str) -> list[bytes | int]:
        """The words of a part as bytes, and the ids of the special tokens in it."""
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_str(self.file)
            self.raw = re.compile(f"({'|'.join(map(re.escape, sorted(self.special, key=len, reverse=True)))})") if self.special else None
        out: list[bytes | int] = []
        for x in self.raw.split(part) if self.raw else [part]:
            if x in self.special:
                out.append(self.special[x])
            elif x:
                found = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(x))
                out += [w.translate(self.to_bytes).encode("latin-1") for w, _ in found]
        return out

    def _slow(self, part: str) -> bytes:
        """Ids of a part of any kind: normalised and split by the library, fragments merged one by one."""
        ids: list[int] = []
        for w in self.words(part):
            if isinstance(w, int):
                ids.append(w)
                continue
            raw = np.frombuffer(w, np.uint8)
            cuts = [0, *(np.flatnonzero(self.cut[raw[:-1], raw[1:]]) + 1).tolist(), len(w)]
            for a, b in zip(cuts, cuts[1:]):
                ids += self.merge(w[a:b], b == len(w))
        return np.array(ids, "<u4").tobytes()

    def learn(self, new: list[str]) -> None:
        """Encodes parts that are not known yet: short ones of Latin-1 all at once, the others one by one."""
        whole = "\n".join(new)
        special = [t for t in self.special if t in whole]
        quick = [x for x in new if len(x) <= SHORT and LATIN.fullmatch(x) and not any(t in x for t in special)] if self.plain else []
        raw, sizes, part = latin_words("\n".join([*quick, ""]).lower(), WORD)
        if len(raw):
            last = np.cumsum(sizes) - 1
            begins = np.ones(len(raw), bool)
            begins[1:] = self.cut[raw[:-1], raw[1:]]
            begins[last[:-1] + 1] = True
            symbols = np.array(self.inner)[raw]
            symbols[last] = np.array(self.final)[raw[last]]
            starts = np.flatnonzero(begins)
            ids, counts = self.pairs.merge(symbols, np.diff(starts, append=len(raw)))
            owner = np.repeat(part, sizes)[starts]
            ends = (4 * np.cumsum(np.bincount(owner, counts, minlength=len(quick)).astype(np.int64))).tolist()
            flat = ids.astype("<u4").tobytes()
            self.parts.update((x, flat[a:b]) for x, a, b in zip(quick, [0, *ends], ends, strict=False))
        else:
            self.parts.update((x, b"") for x in quick)
        for x in set(new).difference(quick):
            self.parts[x] = self._slow(x)

    def encode(self, texts: list[str]) -> Iterator[tuple[int, bytes]]:
        """Number of a text and ids of a slice of it, in order, as little-endian unsigned 32-bit integers; parts that are new are learned together."""
        held: list[tuple[int, list[str]]] = []
        size = 0
        for k, text in enumerate(texts):
            for own in slices(text):
                held.append((k, own.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")))
                size += len(own)
                if size >= SLICE:
                    yield from self._slices(held)
                    held, size = [], 0
        yield from self._slices(held)

    def _slices(self, held: list[tuple[int, list[str]]]) -> Iterator[tuple[int, bytes]]:
        new = set().union(*(own for _, own in held)).difference(self.parts)
        again = new.intersection(self.before)
        self.parts.update((x, self.before[x]) for x in again)
        new -= again
        if new:
            self.learn(sorted(new))
        for k, own in held:
            yield k, b"".join(map(self.parts.__getitem__, own))
        for x in new:
            if len(x) > SHORT:
                del self.parts[x]
        if len(self.parts) > KNOWN:
            self.before, self.parts = self.parts, {"": b""}

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        found: list[list[bytes]] = [[] for _ in texts]
        for k, x in self.encode(texts):
            found[k].append(x)
        return [np.frombuffer(b"".join(x), "<i4") for x in found]

    def decode(self, ids: bytes) -> str:
        """The tokens of the ids, a blank between each two, as a vocabulary without a decoder has it."""
        return " ".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "input_ids", n: str = "n_tokens") -> DataFrame:
    """All rows and columns of ``df`` plus the ids of each whole text and their number."""
    df = without(df, ids, n)
    sent = df.sparkSession.sparkContext.broadcast(WordBpe(path))
    schema = T.StructType([*df.schema.fields, T.StructField(n, T.LongType()), T.StructField(ids, T.ArrayType(T.IntegerType()))])

    def run(batches):
        for batch in by_size(batches, text, 2 << 20):
            found = sent.value.ids(strings(batch.column(text)))
            sizes = np.array([len(x) for x in found], np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), pa.array(np.concatenate([np.empty(0, "<i4"), *found])))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sizes), lists], names=[f.name for f in schema])

    return df.mapInArrow(run, schema)


def decode(df: DataFrame, path: str, ids: str = "input_ids", text: str = "decoded") -> DataFrame:
    """All rows and columns of ``df`` plus the text of its ids; null ids give null, an unknown id is an error."""
    df = without(df, text)
    sent = df.sparkSession.sparkContext.broadcast(WordBpe(path))
    schema = T.StructType([*df.schema.fields, T.StructField(text, T.StringType())])

    def run(batches):
        for batch in batches:
            found = [None if x is None else " ".join(map(sent.value.tokens.__getitem__, x)) for x in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string())], names=[f.name for f in schema])

    return df.mapInArrow(run, schema)


def round_trip_digests(df: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encodes every text, decodes its ids again, and returns the digests of both (null: empty text)."""
    sent = df.sparkSession.sparkContext.broadcast(WordBpe(path))

    def digests(bpe: WordBpe, texts: list[str]) -> list[tuple[int, str, str]]:
        out = [[0, hashlib.sha256(), hashlib.sha256()] for _ in texts]
        for k, ids in bpe.encode(texts):
            if ids:
                own = out[k]
                own[1].update(ids)
                own[2].update(f"{' ' if own[0] else ''}{bpe.decode(ids)}".encode())
                own[0] += len(ids) // 4
        return [(n, a.hexdigest(), b.hexdigest()) for n, a, b in out]

    def run(batches):
        for batch in by_size(batches, text, 4 << 20):
            rows = digests(sent.value, strings(batch.column(text)))
            columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.string(), pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column(key), *columns], names=[key, "n_tokens", "ids_sha256", "decoded_sha256"])

    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    return df.select(key, text).mapInArrow(run, T.StructType([df.schema[key], *fields]))


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return round_trip_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
