"""Byte-level BPE encoding and decoding with a two-tier lookup.

Tier one is a minimal perfect hash over the vocabulary: it resolves every pre-token that is itself a
vocabulary entry with two table reads and a comparison of all its characters, for whole blocks of text
at a time.  Tier two merges the bytes of the other pre-tokens with a heap of candidate pairs over a
linked list of bytes; its results are kept in a bounded memo.  Fingerprints only propose: hits and groups of
equal pre-tokens count after their characters were compared, and remembered ids after their tokens'
bytes were, so no text can be confused with another of the same fingerprint.

Pre-tokens are found without a regular expression engine: code points are classed as white space,
letter, number or other, and the boundaries that the public pattern draws follow from class changes.

Rows: a null text counts as empty (no ids, empty bytes); repeated rows give repeated results; an empty
table gives an empty table; other columns pass through ``encode``, but those with the name of an output
column are replaced.
Texts of any length are worked through in pieces cut at white space, so memory follows the longest
word and not the longest text.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .shared import by_size, without

BASE = np.uint64(0x9E3779B97F4A7C15)
STEP = np.uint64(0xD6E8FEB86659FD93)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
PIECE = 1 << 17  # code points worked on at once
MEMO, WIDTH = 1 << 20, 6  # pre-tokens whose merges a worker remembers, by fingerprint; ids of each at most

SPACE, LETTER, NUMBER, OTHER = range(4)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xC2B2AE3D27D4EB4F)
    return x ^ (x >> np.uint64(29))


def _code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


class PerfectHash:
    """Minimal perfect hash by bucket displacement: key -> slot in 0..n-1, one slot for each key.

    Buckets of two or more keys get the first displacement that sends their keys to free slots,
    largest buckets first; lone keys take the slots left over directly (stored as ``-slot - 1``).
    """

    def __init__(self, keys: np.ndarray):
        n = len(keys)
        if len(np.unique(keys)) != n:
            raise ValueError("keys must be distinct")
        self.n, self.buckets = n, max(1, n // 4)
        self.shift = np.zeros(self.buckets, np.int64)
        home = self._bucket(keys)
        order = np.argsort(home, kind="stable")
        starts = np.searchsorted(home[order], np.arange(self.buckets + 1))
        sizes = np.diff(starts)
        taken = np.zeros(n, bool)
        self.key_at = np.zeros(n, np.uint64)
        self.item_at = np.zeros(n, np.int64)
        lone = []
        for b in np.argsort(-sizes, kind="stable"):
            own = order[starts[b] : starts[b + 1]]
            if len(own) == 0:
                break
            if len(own) == 1:
                lone.append((b, own[0]))
                continue
            first = 0
            while True:
                tries = np.arange(first, first + 1024)
                slots = np.sort(self._slot(keys[own][:, None], tries[None, :]), axis=0)
                good = ~taken[slots].any(axis=0) & (np.diff(slots, axis=0) > 0).all(axis=0)
                if good.any():
                    d = int(tries[np.argmax(good)])
                    break
                first += 1024
            slots = self._slot(keys[own], np.int64(d))
            self.shift[b] = d
            taken[slots] = True
            self.key_at[slots], self.item_at[slots] = keys[own], own
        for (b, i), slot in zip(lone, np.flatnonzero(~taken), strict=True):
            self.shift[b] = -int(slot) - 1
            self.key_at[slot], self.item_at[slot] = keys[i], i

    def _bucket(self, keys: np.ndarray) -> np.ndarray:
        return ((keys >> np.uint64(20)) % np.uint64(self.buckets)).astype(np.int64)

    def _slot(self, keys: np.ndarray, d: np.ndarray) -> np.ndarray:
        return (_mix(keys + np.asarray(d).astype(np.uint64) * STEP) % np.uint64(self.n)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Item numbers of the keys, -1 for keys that are not in the table."""
        d = self.shift[self._bucket(keys)]
        slot = np.where(d < 0, -d - 1, self._slot(keys, d))
        return np.where(self.key_at[slot] == keys, self.item_at[slot], -1)


def equal_runs(x: np.ndarray, at: np.ndarray, y: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether x[at : at + size] equals y[begin : begin + size], run by run; sizes are positive."""
    if not len(size):
        return np.empty(0, bool)
    last = np.cumsum(size)
    place = np.arange(int(last[-1]))
    same = x[place + np.repeat(at - (last - size), size)] == y[place + np.repeat(begin - (last - size), size)]
    return np.logical_and.reduceat(same, last - size)


def same_texts(points: np.ndarray, starts: np.ndarray, ends: np.ndarray, keys: np.ndarray, text: str) -> tuple[np.ndarray, np.ndarray]:
    """Group of every slice, equal texts alone sharing one, and the first slice of each group."""
    _, first, group = np.unique(keys, return_index=True, return_inverse=True)
    size, rep = ends - starts, first[group]
    odd = size[rep] != size
    rest = np.flatnonzero(~odd)
    odd[rest] = ~equal_runs(points, starts[rest], points, starts[rep[rest]], size[rest])
    if odd.any():  # fingerprints met: these slices are grouped by their characters
        more: dict[str, int] = {}
        extra = []
        for i in np.flatnonzero(odd).tolist():
            word = text[starts[i] : ends[i]]
            if word not in more:
                more[word] = len(first) + len(extra)
                extra.append(i)
            group[i] = more[word]
        first = np.concatenate((first, np.array(extra, first.dtype)))
    return group, first


def merge_bytes(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """BPE ids of a pre-token: lowest rank first, leftmost first among equals.

    A heap entry is one integer: rank, then start, then end of the pair's two parts together.
    """
    n = len(piece)
    wide = n.bit_length()
    low, both = (1 << wide) - 1, 2 * wide
    end = list(range(1, n + 1))  # end[i]: where the part that begins at i ends; 0 once it is merged away
    before = list(range(-1, n - 1))
    get = ranks.get
    heap = [r << both | i << wide | i + 2 for i in range(n - 1) if (r := get(piece[i : i + 2])) is not None]
    heapify(heap)
    while heap:
        x = heappop(heap)
        e = x & low
        i = x >> wide & low
        j = end[i]
        if not j or j >= e or end[j] != e:
            continue  # one of the two parts has changed since
        end[i], end[j] = e, 0
        if e < n:
            before[e] = i
            f = end[e]
            if (r := get(piece[i:f])) is not None:
                heappush(heap, r << both | i << wide | f)
        if i:
            h = before[i]
            if (r := get(piece[h:e])) is not None:
                heappush(heap, r << both | h << wide | e)
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}


def class_table() -> np.ndarray:
    """Class of every code point, by the properties that the public pattern names."""
    import regex

    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    table = np.full(0x110000, OTHER, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (SPACE, r"\p{White_Space}")):
        table[_code_points("".join(regex.findall(pattern, every)))] = kind
    return table


class Encoder:
    """Encodes and decodes whole texts. Built on the driver, sent to the executors once.

    ``path`` is a vocabulary of base64 tokens and ranks, one a line; its size bounds what is sent.
    """

    def __init__(self, path: str):
        self.ranks = read_ranks(path)
        by_id = sorted(self.ranks.items(), key=lambda x: x[1])
        self.token_bytes = np.frombuffer(b"".join(t for t, _ in by_id), np.uint8)
        ranks, sizes = np.array([r for _, r in by_id]), np.array([len(t) for t, _ in by_id])
        self.token_size = np.zeros(ranks.max() + 1, np.int64)
        self.token_start = np.zeros(ranks.max() + 1, np.int64)
        self.token_size[ranks], self.token_start[ranks] = sizes, np.cumsum(sizes) - sizes
        texts, ids = [], []
        for token, rank in by_id:
            try:
                texts.append(token.decode())
                ids.append(rank)
            except UnicodeDecodeError:
                pass  # such a token is never a whole pre-token
        flat = _code_points("".join(texts))
        ends = np.cumsum([len(x) for x in texts])
        self.whole_points, self.whole_ids = flat, np.asarray(ids, np.int64)
        self.whole_start = np.concatenate(([0], ends[:-1]))
        self.whole_size = ends - self.whole_start
        self.hash = PerfectHash(self._keys(flat, self.whole_start, ends))
        self.classes = class_table()
        self.memo = None

    @staticmethod
    def _powers(n: int, base: np.uint64) -> np.ndarray:
        out = np.full(n, base, np.uint64)
        if n:
            out[0] = 1
        return np.cumprod(out, dtype=np.uint64)

    _up = _down = np.ones(1, np.uint64)

    def _keys(self, points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Fingerprint of every slice: a polynomial of its code points, mixed with its length."""
        n = len(points)
        if len(Encoder._up) <= n:
            Encoder._up, Encoder._down = self._powers(n + PIECE, BASE), self._powers(n + PIECE, INVERSE)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((points.astype(np.uint64) + np.uint64(1)) * self._up[:n], out=total[1:])
        value = (total[ends] - total[starts]) * self._down[starts]
        return _mix(value + (ends - starts).astype(np.uint64) * STEP)

    def boundaries(self, points: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Where pre-tokens begin. ``first``: where texts begin; they must not be empty."""
        n = len(points)
        kind = self.classes[points]
        begins = np.zeros(n + 1, bool)
        begins[first] = True
        begins[n] = True
        change = np.ones(n + 1, bool)
        change[1:n] = kind[1:] != kind[:-1]
        change |= begins
        space = kind == SPACE
        last = space & change[1:] & ~begins[1:]  # ends a run of white space before other text
        start = change[:n].copy()
        start |= last
        blank = np.zeros(n, bool)
        blank[1:] = (points[:-1] == 32) & ~begins[1:n]
        start &= space | ~blank  # one blank joins what follows
        quote = np.flatnonzero(start & (points == 39))
        if len(quote):
            pad = np.concatenate((points, np.zeros(3, np.uint32)))
            text_no = np.cumsum(begins[:n])
            for i in quote:
                tail = 0
                if i + 1 < n and text_no[i + 1] == text_no[i]:
                    a = pad[i + 1]
                    if a in (115, 116, 109, 100):
                        tail = 1
                    elif i + 2 < n and text_no[i + 2] == text_no[i] and (int(a), int(pad[i + 2])) in ((114, 101), (118, 101), (108, 108)):
                        tail = 2
                if tail:
                    start[i + 1] = False
                    if i + 1 + tail < n:
                        start[i + 1 + tail] |= kind[i + 1 + tail] == LETTER
        return np.flatnonzero(start)

    def _whole(self, points: np.ndarray, starts: np.ndarray, ends: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """Ids of the pre-tokens that are vocabulary entries, -1 for the others."""
        item = self.hash.find(keys)
        hit = np.flatnonzero(item >= 0)
        hit = hit[self.whole_size[item[hit]] == (ends - starts)[hit]]
        same = equal_runs(points, starts[hit], self.whole_points, self.whole_start[item[hit]], (ends - starts)[hit])
        ids = np.full(len(starts), -1, np.int64)
        ids[hit[same]] = self.whole_ids[item[hit[same]]]
        return ids

    def _block(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of some non-empty texts in one array, and where those of each text end."""
        joined = "".join(texts)
        points = _code_points(joined)
        stops = np.cumsum([len(x) for x in texts])
        starts = self.boundaries(points, np.concatenate(([0], stops[:-1])))
        ends = np.append(starts[1:], len(points))
        keys = self._keys(points, starts, ends)
        ids = self._whole(points, starts, ends, keys)
        counts = np.ones(len(ids), np.int64)
        missed = np.flatnonzero(ids < 0)
        if len(missed):
            inverse, first = same_texts(points, starts[missed], ends[missed], keys[missed], joined)
            words = missed[first]
            flat, sizes = self._merged(keys[words], joined, points, starts[words], ends[words])
            offset = np.cumsum(sizes) - sizes
            counts[missed] = sizes[inverse]
        at = np.cumsum(counts)
        out = np.empty(int(at[-1]), np.uint32)
        known = ids >= 0
        out[at[known] - 1] = ids[known]
        if len(missed):
            reps = counts[missed]
            begin = at[missed] - reps
            step = np.arange(int(reps.sum())) - np.repeat(np.cumsum(reps) - reps, reps)
            out[np.repeat(begin, reps) + step] = flat[np.repeat(offset[inverse], reps) + step]
        return out, at[np.searchsorted(starts, stops) - 1]

    def _merged(self, keys: np.ndarray, text: str, points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct pre-tokens outside the vocabulary, in one array, and how many each has."""
        if self.memo is None:
            self.memo = np.zeros(MEMO, np.uint64), np.zeros(MEMO, np.uint8), np.zeros((MEMO, WIDTH), np.int32)
        key_at, size_at, ids_at = self.memo
        raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
        wide = 1 + (points >= 0x80).astype(np.int64) + ((points >= 0x800) & (points >> 11 != 27)) + (points >= 0x10000) - (points >> 11 == 27)
        byte_at = np.concatenate(([0], np.cumsum(wide)))  # a lone surrogate is one question mark
        first, size = byte_at[starts], byte_at[ends] - byte_at[starts]
        slot = (keys & np.uint64(MEMO - 1)).astype(np.int64)
        known = (key_at[slot] == keys) & (size_at[slot] > 0)
        hit = np.flatnonzero(known)
        known[hit] = self._spells(ids_at[slot[hit]], size_at[slot[hit]], raw, first[hit], size[hit])
        sizes = np.where(known, size_at[slot], 0).astype(np.int64)
        new = np.flatnonzero(~known)
        found = [merge_bytes(raw[a : a + n].tobytes(), self.ranks) for a, n in zip(first[new].tolist(), size[new].tolist(), strict=True)]
        sizes[new] = np.fromiter(map(len, found), np.int64, len(found))
        last = np.cumsum(sizes)
        out = np.empty(int(last[-1]), np.int32)
        cells = np.arange(WIDTH)
        own = cells < sizes[known][:, None]
        out[((last - sizes)[known][:, None] + cells)[own]] = ids_at[slot[known]][own]
        if found:
            flat = np.fromiter(chain.from_iterable(found), np.int32, int(sizes[new].sum()))
            ends_new = np.cumsum(sizes[new])
            out[np.arange(len(flat)) + np.repeat((last - sizes)[new] - (ends_new - sizes[new]), sizes[new])] = flat
            keep = sizes[new] <= WIDTH
            rows, at = slot[new][keep], (ends_new - sizes[new])[keep]
            key_at[rows], size_at[rows] = keys[new][keep], sizes[new][keep]
            ids_at[rows] = flat[np.minimum(at[:, None] + cells, len(flat) - 1)]
        return out, sizes

    def _spells(self, ids: np.ndarray, counts: np.ndarray, raw: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether remembered ids (rows, of which the first ``counts`` count) stand for raw[first : first + size]."""
        own = np.arange(WIDTH) < counts[:, None]
        each = np.where(own, self.token_size[ids], 0)
        good = each.sum(axis=1) == size
        rows = np.flatnonzero(good)
        if len(rows):
            tokens, n = ids[rows][own[rows]], each[rows][own[rows]]
            last = np.cumsum(n)
            spelled = self.token_bytes[np.repeat(self.token_start[tokens] - (last - n), n) + np.arange(int(last[-1]))]
            good[rows] = equal_runs(raw, first[rows], spelled, np.cumsum(size[rows]) - size[rows], size[rows])
        return good

    def _pieces(self, text: str) -> Iterator[str]:
        """The text in pieces of about PIECE code points, cut where white space begins."""
        a = 0
        while len(text) - a > PIECE:
            points = _code_points(text[a : a + 4 * PIECE])
            space = self.classes[points] == SPACE
            cut = np.flatnonzero(space[1:] & ~space[:-1]) + 1
            cut = cut[cut >= min(PIECE // 2, len(points) // 2)]
            if not len(cut):
                i = a + len(points)
                while i < len(text) and not (text[i].isspace() and not text[i - 1].isspace() and self.classes[ord(text[i])] == SPACE and self.classes[ord(text[i - 1])] != SPACE):
                    i += 1
                b = i
            else:
                b = a + int(cut[0])
            yield text[a:b]
            a = b
        if a < len(text):
            yield text[a:]

    def encode_batch(self, texts: list[str]) -> Iterator[np.ndarray]:
        """Ids (uint32) of each text, in order."""
        held: list[tuple[int, str]] = []
        size = done = 0
        parts: dict[int, list[np.ndarray]] = {}

        def flush():
            if held:
                ids, ends = self._block([x for _, x in held])
                a = 0
                for (k, _), b in zip(held, ends, strict=True):
                    parts.setdefault(k, []).append(ids[a:b])
                    a = b
                held.clear()

        for k, text in enumerate(texts):
            for piece in self._pieces(text):
                held.append((k, piece))
                size += len(piece)
                if size >= PIECE:
                    flush()
                    size = 0
                    while done < k:
                        yield np.concatenate(parts.pop(done, [np.empty(0, np.uint32)]))
                        done += 1
        flush()
        while done < len(texts):
            yield np.concatenate(parts.pop(done, [np.empty(0, np.uint32)]))
            done += 1

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of the ids' tokens; ids outside the vocabulary are an error."""
        out = []
        for a in range(0, len(ids), PIECE):
            own = ids[a : a + PIECE]
            begin, size = self.token_start[own], self.token_size[own]
            if (size == 0).any():
                raise ValueError("an id has no token")
            last = np.cumsum(size)
            out.append(self.token_bytes[np.repeat(begin - (last - size), size) + np.arange(int(last[-1]))].tobytes())
        return b"".join(out)

    def __getstate__(self):
        return self.__dict__ | {"memo": None}


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "input_ids", n: str = "n_tokens") -> DataFrame:
    """All rows and columns of ``df`` plus the ids of each whole text and their number."""
    df = without(df, ids, n)
    sent = df.sparkSession.sparkContext.broadcast(Encoder(path))  # bounded by the vocabulary
    schema = T.StructType([*df.schema.fields, T.StructField(n, T.LongType()), T.StructField(ids, T.ArrayType(T.IntegerType()))])

    def run(batches):
        encoder = sent.value
        for batch in by_size(batches, text, 2 << 20):
            found = list(encoder.encode_batch([x or "" for x in batch.column(text).to_pylist()]))
            sizes = np.array([len(x) for x in found], np.int64)
            flat = pa.array(np.concatenate(found).astype(np.int32)) if found else pa.array([], pa.int32())
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), flat)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sizes), lists], names=[*batch.schema.names, n, ids])

    return df.mapInArrow(run, schema)


def round_trip_digests(df: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encodes every text, decodes its ids again, and returns the digests of both (null: empty text)."""
    sent = df.sparkSession.sparkContext.broadcast(Encoder(path))

    def run(batches):
        encoder = sent.value
        for batch in by_size(batches, text, 2 << 20):
            texts = [x or "" for x in batch.column(text).to_pylist()]
            rows = [(len(x), hashlib.sha256(x.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(encoder.decode(x)).hexdigest()) for x in encoder.encode_batch(texts)]
            sizes, of_ids, of_bytes = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(sizes, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string())], names=[key, "n_tokens", "ids_sha256", "decoded_sha256"])

    return df.select(key, text).mapInArrow(run, T.StructType([df.schema[key], T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return round_trip_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
