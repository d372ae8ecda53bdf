"""Alignment of the tokens of two tokenizers over the same bytes, by elementary intervals.

The ends of both token sequences, as byte offsets, are united (``union1d``); between two neighbours of the
union lies an elementary interval, whose owners in both sequences ``searchsorted`` finds: each interval is one
overlap of two tokens.  Ends that both share close groups, and the product of a group's two sides are its links.

A blank after anything but white space begins a token of both tokenizers, whatever stands before it: the first
one's splitting takes a blank only in front, and no piece of the second one holds a blank behind another character
(the vocabulary is checked for it).  Texts are cut there, and each different part is encoded and aligned once,
all new parts of a batch together, and remembered by the worker in a table of bounded size.  Short parts of printable Latin-1 are merged together in numpy by the merges of both
vocabularies; all others are encoded by the libraries.  A group never
reaches over such a cut, so what a text has is the sum over its parts.

Counts of linked id pairs are made over all texts (each text counts a pair once) by one aggregation.  The
most frequent pairs, ``MOST`` at most by a counted threshold, are broadcast; rarer ones, of which none is in many texts,
are joined by a shuffle, without loss.  The highest count of each id of the first tokenizer is bounded by its vocabulary.

Rows: texts that are null or empty, or whose bytes the tokens of one side don't spell (such as texts that hold U+2581),
have no tokens: all numbers are 0 and the digest is the empty string; repeated rows are documents of their own;
an empty table gives an empty table; columns other than key and text are not read, and the key may have any
name but those of the output columns.  Texts are worked through in slices cut where parts begin, so memory follows the
longest part, and the pairs of the longest text.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .merges import BLANKS, LETTERS, NUMBERS, Pairs, latin_words
from .shared import by_size, discard, materialize, strings
from .wordbpe import byte_characters

SLICE = 1 << 20  # characters of a text worked on at once
KNOWN = 300_000  # parts that a worker remembers; of a full table those stay that stood in texts more than once
SHORT = 64  # characters of the longest remembered part
MOST = 1 << 21  # pairs whose counts are broadcast
PRODUCT = 1 << 16  # links of a group that are spelled out; beyond, equal ids are counted first
CUT = re.compile(r"(?<=\S) ")
WORD = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[{NUMBERS}]+| ?[^\0{BLANKS}{LETTERS}{NUMBERS}]+|\n|\0")


def intervals(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owners of all elementary intervals in both sequences, and which of them close a group.

    Ends are ascending byte offsets of tokens that hold a byte at least, and the last ones are equal.
    """
    edges = np.union1d(ends_a, ends_b)
    a, b = np.searchsorted(ends_a, edges), np.searchsorted(ends_b, edges)
    return a, b, (ends_a[a] == edges) & (ends_b[b] == edges)


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each start, ``size`` numbers each, in one array."""
    last = np.cumsum(sizes)
    return np.arange(int(last[-1]) if len(last) else 0) + np.repeat(starts - (last - sizes), sizes)


def products(a: np.ndarray, b: np.ndarray, first_a: np.ndarray, n_a: np.ndarray, first_b: np.ndarray, n_b: np.ndarray, wide: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links of all groups: group, pair (id of a times ``wide`` plus id of b), and how often the group has it."""
    size = n_a * n_b
    small = np.flatnonzero(size <= PRODUCT)
    rows = np.repeat(small, size[small])
    at = spread(np.zeros(len(small), np.int64), size[small])
    pairs = a[first_a[rows] + at // n_b[rows]] * wide + b[first_b[rows] + at % n_b[rows]]
    groups, codes, times = [rows], [pairs], [np.ones(len(rows), np.int64)]
    for g in np.flatnonzero(size > PRODUCT):
        x, k = np.unique(a[first_a[g] : first_a[g] + n_a[g]], return_counts=True)
        y, m = np.unique(b[first_b[g] : first_b[g] + n_b[g]], return_counts=True)
        codes.append((x[:, None] * wide + y).ravel())
        times.append((k[:, None] * m).ravel())
        groups.append(np.full(len(codes[-1]), g))
    return np.concatenate(groups), np.concatenate(codes), np.concatenate(times)


def summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sums of their values."""
    order = np.argsort(keys, kind="stable")
    keys, values = keys[order], values[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.empty(0, np.int64)
    return keys[first], np.add.reduceat(values, first) if len(first) else values


class Growing:
    """An array that grows at its end."""

    def __init__(self, dtype: type, width: int = 1):
        self.size, self.held = 0, np.zeros((1024, width) if width > 1 else 1024, dtype)

    def add(self, x: np.ndarray) -> None:
        n = self.size + len(x)
        if n > len(self.held):
            self.held = np.concatenate((self.held, np.zeros((max(n, 2 * len(self.held)) - len(self.held), *self.held.shape[1:]), self.held.dtype)))
        self.held[self.size : n] = x
        self.size = n


class Aligner:
    """Encodes and aligns parts of texts; built on the driver, sent once, bounded by the two files."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece

        with open(path_a, encoding="utf-8") as f:
            self.file_a = f.read()
        with open(path_b, "rb") as f:
            self.file_b = f.read()
        data = json.loads(self.file_a)
        byte_of = {c: b for b, c in enumerate(byte_characters())}
        special = {x["id"] for x in data["added_tokens"]}
        bytes_a = {i: bytes(byte_of[c] for c in t) for t, i in data["model"]["vocab"].items() if i not in special}
        self.bytes_a = [bytes_a.get(i, b"") for i in range(max(bytes_a) + 1)]
        pieces = sentencepiece.SentencePieceProcessor(model_proto=self.file_b)
        self.bytes_b = []
        for i in range(len(pieces)):
            piece = pieces.id_to_piece(i)
            if re.search("[^▁]▁", piece):
                raise ValueError("a piece holds a blank behind another character")
            self.bytes_b.append(bytes([int(piece[3:5], 16)]) if pieces.is_byte(i) else b"" if pieces.is_control(i) or pieces.is_unknown(i) else piece.replace("▁", " ").encode())
        self.wide = len(self.bytes_b)
        self._plain(data, pieces)
        self.size_a, self.size_b = (np.array([len(x) for x in own]) for own in (self.bytes_a, self.bytes_b))
        self.spelled = list(map(str, range(max(len(self.bytes_a), self.wide))))
        self.pair_type = T.IntegerType() if len(self.bytes_a) * self.wide < 1 << 31 else T.LongType()
        self._start()

    def _plain(self, data: dict, pieces) -> None:
        """Merges of both sides for parts of printable Latin-1, which are taken together; any other vocabulary goes part by part."""
        model = data["model"]
        byte_level = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
        usual = data["normalizer"] is None and data["pre_tokenizer"] == byte_level and model["type"] == "BPE"
        if not usual or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
            self.short = re.compile("(?!)")
            return
        ids = model["vocab"]
        self.symbol_a = np.array([ids[c] for c in byte_characters()])
        left, right = zip(*((ids[a], ids[b]) for a, b in model["merges"]), strict=True)
        self.pairs_a = Pairs(left, right, range(len(left)), [ids[a + b] for a, b in model["merges"]])
        normal = {pieces.id_to_piece(i): i for i in range(len(pieces)) if self.bytes_b[i] and not pieces.is_byte(i) and not pieces.is_unused(i)}
        splits = [(normal[p[:k]], normal[p[k:]], i) for p, i in normal.items() for k in range(1, len(p)) if p[:k] in normal and p[k:] in normal]
        place = {i: r for r, i in enumerate(sorted(normal.values(), key=lambda i: (-pieces.get_score(i), i)))}
        left, right, made = zip(*splits, strict=True)
        self.pairs_b = Pairs(left, right, [place[i] for i in made], made)
        shown = [c for c in map(chr, (*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100))) if c in normal]
        self.blank, self.symbol_b = normal["▁"], np.zeros(256, np.int64)
        self.symbol_b[[ord(c) for c in shown]] = [normal[c] for c in shown]
        self.symbol_b[10] = normal["\n"] if "\n" in normal else pieces.piece_to_id("<0x0A>")
        shown = f"[{re.escape(''.join(shown))}]+"
        self.short = re.compile(rf"(?=[^\0]{{1,{SHORT}}}\Z){shown}(?:\n{shown})*")  # a line end between two words is a token of its own on both sides

    def _start(self) -> None:
        self.known: dict[str, int] = {}
        self.groups: list[str] = []  # the groups of each part as text
        self.numbers = Growing(np.int64, 5)  # n_a, n_b, n_groups, n_links, and 1 for parts that can't be spelled
        self.begin, self.count = Growing(np.int64), Growing(np.int64)  # where the pairs of each part stand
        self.pairs, self.times = Growing(np.int64), Growing(np.int64)
        self.uses = Growing(np.int64)
        self.library = getattr(self, "library", None)

    def _thin(self) -> None:
        """Keeps of a full table the parts used most, a quarter of it, without those used once."""
        texts, rows = list(self.known), np.fromiter(self.known.values(), np.int64, len(self.known))
        uses = self.uses.held[rows]
        best = np.argsort(-uses, kind="stable")[: KNOWN // 4]
        best = best[uses[best] > 1]
        rows, old = rows[best], (self.groups, self.numbers.held, self.begin.held, self.count.held, self.pairs.held, self.times.held)
        self._start()
        groups, numbers, begin, count, pairs, times = old
        self.known = {texts[i]: k for k, i in enumerate(best.tolist())}
        self.groups = [groups[i] for i in rows.tolist()]
        self.numbers.add(numbers[rows])
        at = spread(begin[rows], count[rows])
        self.begin.add(np.cumsum(count[rows]) - count[rows])
        self.count.add(count[rows])
        self.pairs.add(pairs[at])
        self.times.add(times[at])
        self.uses.add(np.zeros(len(rows), np.int64))

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("known", "groups", "numbers", "begin", "count", "pairs", "times", "uses", "library")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._start()

    def tokens(self, parts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of each part with a blank before it, by both tokenizers."""
        if self.library is None:
            import sentencepiece
            from tokenizers import Tokenizer

            first = Tokenizer.from_str(self.file_a)
            first.encode_special_tokens = True  # their strings in a text are ordinary text
            self.library = first, sentencepiece.SentencePieceProcessor(model_proto=self.file_b)
        first, second = self.library
        blank = [second.piece_to_id("▁")]  # which the library adds to everything but the empty text
        return [first.encode(f" {x}", add_special_tokens=False).ids for x in parts], [own if x else blank for x, own in zip(parts, second.encode(parts, num_threads=1), strict=True)]

    def _quick(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of A and how many each part has, then those of B, for parts that ``short`` matches, all at once."""
        raw, sizes, part = latin_words("".join(f" {x}\0" for x in parts), WORD, 0)
        a, count = self.pairs_a.merge(self.symbol_a[raw], sizes)
        n_a = np.bincount(part, count, minlength=len(parts)).astype(np.int64)
        n = np.fromiter(map(len, parts), np.int64, len(parts)) + 1
        symbols = np.full(int(n.sum()), self.blank)
        inner = np.ones(len(symbols), bool)
        inner[np.cumsum(n) - n] = False
        symbols[inner] = self.symbol_b[np.frombuffer("".join(parts).encode("latin-1"), np.uint8)]
        b, n_b = self.pairs_b.merge(symbols, n)
        return a, n_a, b, n_b

    def learn(self, parts: list[str]) -> None:
        """Encodes and aligns parts that are not known yet, all at once."""
        quick = [x for x in parts if self.short.fullmatch(x)]
        others = sorted(set(parts).difference(quick))
        empty = np.empty(0, np.int64)
        a, own_a, b, own_b = self._quick(quick) if quick else (empty, empty, empty, empty)
        bad = np.zeros(len(parts), bool)
        if others:
            of_a, of_b = self.tokens(others)
            for k, x in enumerate(others):
                whole = f" {x}".encode()
                if b"".join(map(self.bytes_a.__getitem__, of_a[k])) != whole or b"".join(map(self.bytes_b.__getitem__, of_b[k])) != whole:
                    bad[len(quick) + k], of_a[k], of_b[k] = True, [], []
            a, b = (np.concatenate((x, np.array([i for own in more for i in own], np.int64))) for x, more in ((a, of_a), (b, of_b)))
            own_a, own_b = (np.concatenate((x, np.array([len(own) for own in more], np.int64))) for x, more in ((own_a, of_a), (own_b, of_b)))
        parts = quick + others
        owner_a, owner_b, closes = intervals(np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b]))
        end_a, end_b = owner_a[closes] + 1, owner_b[closes] + 1
        n_a, n_b = np.diff(end_a, prepend=0), np.diff(end_b, prepend=0)
        part = np.searchsorted(np.cumsum(own_a), end_a)  # of each group; parts without tokens have none
        n = len(parts)
        link, codes, times = products(a, b, end_a - n_a, n_a, end_b - n_b, n_b, self.wide)
        keys, times = summed(part[link] << 32 | codes, times)
        count = np.bincount(keys >> 32, minlength=n)
        groups = np.bincount(part, minlength=n)
        links = np.zeros(n, np.int64)
        np.add.at(links, part, n_a * n_b)
        text_a, text_b = list(map(self.spelled.__getitem__, a.tolist())), list(map(self.spelled.__getitem__, b.tolist()))
        sides = zip((end_a - n_a).tolist(), end_a.tolist(), (end_b - n_b).tolist(), end_b.tolist(), strict=True)
        spelled = [f"{text_a[i]}|{text_b[k]}" if j - i == 1 == m - k else f"{','.join(text_a[i:j])}|{','.join(text_b[k:m])}" for i, j, k, m in sides]
        at = np.cumsum(groups).tolist()
        self.known |= zip(parts, range(len(self.groups), len(self.groups) + n), strict=True)
        self.groups += [";".join(spelled[i:j]) for i, j in zip([0, *at], at, strict=False)]
        self.numbers.add(np.stack((own_a, own_b, groups, links, bad), axis=1))
        self.uses.add(np.zeros(n, np.int64))
        self.begin.add(self.pairs.size + np.cumsum(count) - count)
        self.count.add(count)
        self.pairs.add(keys & 0xFFFFFFFF)
        self.times.add(times)

    def parts(self, text: str) -> Iterator[list[str]]:
        """The parts of a text, slice by slice; the blank before each is left out."""
        a = 0
        while m := CUT.search(text, a + SLICE):
            yield CUT.split(text[a : m.start()])
            a = m.end()
        yield CUT.split(text[a:])

    def batch(self, texts: list[str], spell: bool = False) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Of each text: n_a, n_b, n_groups, n_links; digest or spelling of its groups; number, values and times of its pairs."""
        numbers = np.zeros((len(texts), 5), np.int64)
        rows, found, amounts = [], [], []
        held: list[tuple[int, np.ndarray]] = []

        def collect() -> None:
            if held:
                ends = np.cumsum([len(x) for _, x in held])
                keys, n = np.unique(np.repeat([k << 32 for k, _ in held], np.diff(ends, prepend=0)) | np.concatenate([x for _, x in held]), return_counts=True)
                row, part = keys >> 32, keys & 0xFFFFFFFF
                self.uses.held[: self.uses.size] += np.bincount(part, n, minlength=self.uses.size).astype(np.int64)
                first = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
                numbers[row[first]] += np.add.reduceat(self.numbers.held[part] * n[:, None], first)
                count = self.count.held[part]
                at = spread(self.begin.held[part], count)
                # pairs of a row are told apart by the row's place among those of the batch
                order = np.lexsort((self.pairs.held[at], np.repeat(row, count)))
                of, pair, times = np.repeat(row, count)[order], self.pairs.held[at][order], (self.times.held[at] * np.repeat(n, count))[order]
                first = np.flatnonzero(np.append(True, (of[1:] != of[:-1]) | (pair[1:] != pair[:-1]))) if len(of) else np.empty(0, np.int64)
                rows.append(of[first])
                found.append(pair[first])
                amounts.append(np.add.reduceat(times, first) if len(first) else times)
                held.clear()
            if len(self.groups) > KNOWN or self.pairs.size > 16 * KNOWN:
                self._thin()

        digest = [hashlib.sha256() for _ in texts]
        whole: list[list[str]] = [[] for _ in texts]
        waiting: list[tuple[int, list[str]]] = []

        def settle() -> None:
            new = sorted(set().union(*(own for _, own in waiting)).difference(self.known))
            if new:
                self.learn(new)
            for k, own in waiting:
                at = list(map(self.known.__getitem__, own))
                held.append((k, np.array(at, np.int64)))
                spelled = ";".join(map(self.groups.__getitem__, at))
                if k in begun:
                    spelled = f";{spelled}"
                begun.add(k)
                digest[k].update(spelled.encode())
                if spell:
                    whole[k].append(spelled)
            for x in new:
                if len(x) > SHORT:
                    del self.known[x]
            waiting.clear()
            collect()

        begun: set[int] = set()
        size = 0
        for k, text in enumerate(texts):
            for parts in self.parts(text) if text else ():
                waiting.append((k, parts))
                size += len(parts)
                if size > SLICE:
                    settle()
                    size = 0
        settle()
        digests = ["".join(x) if spell else d.hexdigest() if t else "" for x, d, t in zip(whole, digest, texts, strict=True)]
        of, pairs, times = (np.concatenate([np.empty(0, np.int64), *x]) for x in (rows, found, amounts))
        if len(rows) > 1:  # a text may reach over collections
            order = np.lexsort((pairs, of))
            of, pairs, times = of[order], pairs[order], times[order]
            first = np.flatnonzero(np.append(True, (of[1:] != of[:-1]) | (pairs[1:] != pairs[:-1])))
            of, pairs, times = of[first], pairs[first], np.add.reduceat(times, first)
        bad = numbers[:, 4] > 0
        numbers[bad] = 0
        keep = ~bad[of]
        return numbers[:, :4], ["" if x else d for x, d in zip(bad, digests, strict=True)], np.bincount(of[keep], minlength=len(texts)), pairs[keep], times[keep]


NUMBERS = ["n_a", "n_b", "n_groups", "n_links"]


def lists(sizes: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), values)


def link_texts(df: DataFrame, aligner: Aligner, key: str, text: str, spell: bool = False) -> DataFrame:
    """Of each row: key, the four numbers, groups_sha256 (or ``groups``, spelled out), and its pairs with how often it has them."""
    sent = df.sparkSession.sparkContext.broadcast(aligner)
    name = "groups" if spell else "groups_sha256"
    kind = aligner.pair_type
    fields = [df.schema[key], *(T.StructField(n, T.LongType()) for n in NUMBERS), T.StructField(name, T.StringType()), T.StructField("pairs", T.ArrayType(kind)), T.StructField("times", T.ArrayType(T.LongType()))]
    arrow = pa.int32() if kind == T.IntegerType() else pa.int64()

    def run(batches):
        for batch in by_size(batches, text, 4 << 20):
            numbers, digests, sizes, pairs, times = sent.value.batch(strings(batch.column(text)), spell)
            columns = [pa.array(numbers[:, i]) for i in range(4)]
            yield pa.RecordBatch.from_arrays([batch.column(key), *columns, pa.array(digests, pa.string()), lists(sizes, pa.array(pairs.astype(arrow.to_pandas_dtype()))), lists(sizes, pa.array(times))], names=[f.name for f in fields])

    return df.select(key, text).mapInArrow(run, T.StructType(fields))


def token_groups(df: DataFrame, path_a: str, path_b: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key, numbers and the groups of each text, spelled ``a1,a2|b1;a3|b2,b3``."""
    return link_texts(df, Aligner(path_a, path_b), key, text, spell=True).drop("pairs", "times")


def pair_counts(linked: DataFrame) -> DataFrame:
    """In how many rows of ``link_texts`` each pair of ids is linked: pair, count."""
    return linked.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("count"))


def threshold(counts: DataFrame, most: int) -> int:
    """The least power of two (or 0) that at most ``most`` pairs have a count above."""
    by_size_of = {r.k: r.n for r in counts.groupBy(F.ceil(F.log2("count")).cast("int").alias("k")).agg(F.count("*").alias("n")).collect()}  # 64 rows at most
    if sum(by_size_of.values()) <= most:
        return 0
    k = min(k for k in range(65) if sum(n for j, n in by_size_of.items() if j > k) <= most)
    return 1 << k


def align(df: DataFrame, path_a: str, path_b: str, key: str = "doc_id", text: str = "text", most: int = MOST) -> DataFrame:
    """Of each row: key, the four numbers, groups_sha256, n_best and count_sum."""
    aligner = Aligner(path_a, path_b)
    wide = aligner.wide
    linked = materialize(link_texts(df, aligner, key, text).withColumn("_row", F.monotonically_increasing_id()), "align-linked")
    counts = materialize(pair_counts(linked), "align-counts")
    best_rows = counts.groupBy((F.col("pair") / wide).cast("long").alias("a")).agg(F.max("count").alias("count")).toArrow()  # bounded by the vocabulary
    best = np.zeros(len(aligner.bytes_a), np.int64)
    best[best_rows.column("a").to_numpy()] = best_rows.column("count").to_numpy()
    above = threshold(counts, most)
    common = counts.filter(F.col("count") > above).toArrow()  # MOST rows at most
    order = np.argsort(common.column("pair").to_numpy())
    sent = df.sparkSession.sparkContext.broadcast((common.column("pair").to_numpy()[order], common.column("count").to_numpy()[order], best))
    names = [key, *NUMBERS, "groups_sha256"]
    fields = [*(linked.schema[n] for n in [*names, "_row"]), *(T.StructField(n, T.LongType()) for n in ("n_best", "count_sum"))]
    rest = [linked.schema["pairs"], linked.schema["times"]] if above else []

    def run(batches):
        pair_at, count_at, best_at = sent.value
        for batch in batches:
            pairs, times = (batch.column(n).flatten().to_numpy() for n in ("pairs", "times"))
            sizes = pc.list_value_length(batch.column("pairs")).to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(sizes)), sizes)
            at = np.minimum(np.searchsorted(pair_at, pairs), max(len(pair_at) - 1, 0))
            hit = pair_at[at] == pairs if len(pair_at) else np.zeros(len(pairs), bool)
            count = np.zeros(len(pairs), np.int64)
            count[hit] = count_at[at[hit]]
            n_best, total = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
            np.add.at(n_best, row, times * (hit & (count == best_at[pairs // wide])))
            np.add.at(total, row, times * count)
            columns = [*(batch.column(n) for n in [*names, "_row"]), pa.array(n_best), pa.array(total)]
            if above:
                left = np.bincount(row[~hit], minlength=len(sizes))
                columns += [lists(left, pa.array(pairs[~hit])), lists(left, pa.array(times[~hit]))]
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in [*fields, *rest]])

    out = linked.mapInArrow(run, T.StructType([*fields, *rest]))
    if above:
        out = materialize(out, "align-rest")
        tops = df.sparkSession.createDataFrame(best_rows.rename_columns(["a", "top"]))
        rare = out.select("_row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("_row", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
        own = rare.join(counts.filter(F.col("count") <= above), "pair").withColumn("a", (F.col("pair") / wide).cast("long")).join(F.broadcast(tops), "a")
        more = own.groupBy("_row").agg(F.sum(F.when(F.col("count") == F.col("top"), F.col("times")).otherwise(0)).alias("b"), F.sum(F.col("times") * F.col("count")).alias("c"))
        out = out.join(more, "_row", "left").withColumn("n_best", F.col("n_best") + F.coalesce("b", F.lit(0))).withColumn("count_sum", F.col("count_sum") + F.coalesce("c", F.lit(0)))
    if not above:
        discard(counts)
    return out.select(*names, "n_best", "count_sum")


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return align(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
