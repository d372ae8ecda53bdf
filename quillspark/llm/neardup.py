"""Near-duplicate documents: MinHash bands, odd sketches, exact confirmation, connected components.

One pass over the texts makes, per document, the digest of its shingle set, SAMPLES MinHash samples,
the band keys of the first of them, and an odd sketch: every (sample number, value) toggles one of BITS bits.
Documents with equal sets are one entry from then on.  Entries that share a band key are candidates.
For a pair of sketches, the count of differing bits estimates the similarity; pairs whose count is
beyond ``distance_limit`` (the mean at the threshold plus 5.2 standard deviations) are passed over,
the others are confirmed on the full sets: 100 * intersection >= percent * union.

Each entry is first compared with the hubs of its buckets, the members that share most bucket places
(the original among copies of it).  Confirmed links give components.  What is left are pairs of
different components in a bucket.  In buckets of up to WORK such pairs, the members outside the largest
component are compared with those of other components, inside a join that makes links only.  For the
members of all other buckets a prefix join finds the pairs without loss: items are ordered by how
often their hash cell occurs, rare ones first, and a pair that links must share an item between the
first n - ceil(2 t n / (1 + t)) + 1 of the smaller and the first m - ceil(t m) + 1 of the larger set.  So
texts that are alike in what is common among them, but differ in the rest, never meet.  Items that one
component alone holds make no pairs, and members of an item's largest component meet others only.
With 5 rows and 32 bands, a pair of similarity 0.8 shares no band with probability 3e-6, one of 0.85
with 2e-8.

Words are hashed in lanes of eight bytes, each mixed by a bijection; shingles are 64-bit hashes of those.

Rows: null texts and texts without words have empty sets and link with nothing; texts with fewer words
than a shingle have their whole sequence as the one shingle; a null id has no component and is kept; an
id that repeats is one document, linked with what any of its texts link with, so it has one component;
``stage`` judges every row by its own text instead, so that an id that repeats loses no text that has no
near-duplicate; an empty table gives an empty table; further columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import by_size, discard, materialize

ROWS, BANDS = 5, 32
SAMPLES, BITS = 640, 2048  # of the sketch; the bands use the first ROWS * BANDS samples
WORDS = BITS // 64
#: Rows of ids and set keys that may be broadcast: up to 32 bytes each.
SMALL = 200_000

_RNG = np.random.default_rng(20240229)
_MULTIPLY = _RNG.integers(0, 1 << 32, SAMPLES, dtype=np.uint32) | np.uint32(1)
_ADD = _RNG.integers(0, 1 << 32, SAMPLES, dtype=np.uint32)
_FOLD = np.uint64(0xD6E8FEB86659FD93)
_STEP = np.uint64(0xA0761D6478BD642F)
BLOCK = 1 << 19  # bytes hashed at once
LANES = 64  # bytes of a word that are hashed in lanes; longer words are hashed one by one
WORK = 1 << 24  # pairs of a bucket that may be compared one by one; the members of others meet by prefixes
LINKS = 1 << 18  # links that a task contracts at once
CELLS = 18  # bits of the cells in which items are counted to order them
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_KEEP = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)  # the first n bytes of a lane


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _FOLD
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xC2B2AE3D27D4EB4F)
    return x ^ (x >> np.uint64(29))


def _word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all lower-cased words in order, and how many words each text has."""
    raw = _LOWER[np.frombuffer(b" ".join([b"", *texts, b"        "]), np.uint8)]
    gap = _SEPARATOR[raw]
    starts = np.flatnonzero(gap[:-1] & ~gap[1:]) + 1
    ends = np.flatnonzero(~gap[:-1] & gap[1:]) + 1
    size = ends - starts
    lanes = np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,))
    hashes = _mix((size.astype(np.uint64) * _STEP) ^ (lanes[starts] & _KEEP[np.minimum(size, 8)]))
    live = np.arange(len(size))
    for at in range(8, LANES, 8):
        live = live[size[live] > at]
        if not len(live):
            break
        hashes[live] = _mix(hashes[live] * _STEP ^ (lanes[starts[live] + at] & _KEEP[np.minimum(size[live] - at, 8)]))
    for i in np.flatnonzero(size > LANES).tolist():
        hashes[i] = xxhash.xxh3_64_intdigest(raw[starts[i] : ends[i]].tobytes())
    stops = np.cumsum([len(x) + 1 for x in texts]) + 1
    last = np.searchsorted(starts, stops)
    return hashes, np.diff(np.concatenate(([0], last)))


def set_key(items: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(items.tobytes())


def shingle_sets(texts: list[str], k: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    group: list[bytes] = []
    held = 0
    for text in texts:
        group.append(text.encode("utf-8", "surrogatepass"))
        held += len(group[-1])
        if held >= BLOCK:
            yield from _sets(group, k)
            group, held = [], 0
    if group:
        yield from _sets(group, k)


def _sets(texts: list[bytes], k: int) -> Iterator[np.ndarray]:
    hashes, counts = _word_hashes(texts)
    runs = np.full(max(0, len(hashes) - k + 1), k, np.uint64)
    for j in range(k):
        runs = _mix(runs * _STEP + hashes[j : j + len(runs)])
    at = 0
    for n in counts.tolist():
        if n >= k:
            yield np.unique(runs[at : at + n - k + 1])
        elif n:
            own = np.full(1, n, np.uint64)
            for j in range(n):
                own = _mix(own * _STEP + hashes[at + j : at + j + 1])
            yield own
        else:
            yield np.empty(0, np.uint64)
        at += n


def signatures(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Band keys (texts x BANDS) and odd sketches (texts x WORDS) of non-empty sets."""
    sizes = np.array([len(x) for x in sets])
    flat = np.concatenate(sets)
    low, high = flat.astype(np.uint32), (flat >> np.uint64(32)).astype(np.uint32)
    starts = np.cumsum(sizes) - sizes
    samples = np.empty((SAMPLES, len(sets)), np.uint32)
    for i in range(SAMPLES):
        samples[i] = np.minimum.reduceat((high if i % 2 else low) * _MULTIPLY[i] + _ADD[i], starts)
    keys = np.empty((len(sets), BANDS), np.uint64)
    for b in range(BANDS):
        key = np.full(len(sets), b + 1, np.uint64)
        for r in range(ROWS):
            key = _mix(key * _STEP + samples[b * ROWS + r])
        keys[:, b] = key
    spot = _mix(samples.astype(np.uint64) + (np.arange(SAMPLES, dtype=np.uint64)[:, None] << np.uint64(32))) % np.uint64(BITS)
    count = np.zeros((len(sets), BITS), np.uint8)
    for i in range(SAMPLES):
        count[np.arange(len(sets)), spot[i].astype(np.int64)] ^= 1
    sketch = np.packbits(count, axis=1, bitorder="little").view("<u8")
    return keys, sketch


def distance_limit(percent: int) -> int:
    """Differing bits that a pair at the threshold exceeds with a probability of about 1e-7."""
    j = percent / 100

    def bits(thrown: float) -> float:
        return BITS / 2 * (1 - math.exp(-2 * thrown / BITS))

    mean = 2 * SAMPLES * (1 - j)
    spread = 2 * math.sqrt(SAMPLES * j * (1 - j))
    noise = math.sqrt(BITS) / 2 * math.sqrt(1 - math.exp(-4 * mean / BITS))
    return min(BITS, math.ceil(bits(mean + 5.2 * spread) + 2 * noise))


def sketch_table(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, n, key, bands, s0 .. s31) of each row; key, bands and sketch are null for empty sets."""
    names = ["doc_id", "n", "key", "bands", *(f"s{i}" for i in range(WORDS))]

    def run(batches):
        for batch in by_size(batches, "text", 2 << 20):
            sets = list(shingle_sets([x or "" for x in batch.column("text").to_pylist()], k))
            full = [i for i, x in enumerate(sets) if len(x)]
            keys: list = [None] * len(sets)
            bands: list = [None] * len(sets)
            cells = np.zeros((len(sets), WORDS), np.int64)
            for a in range(0, len(full), 256):
                own = full[a : a + 256]
                key, sketch = signatures([sets[i] for i in own])
                for i, x in zip(own, key.view(np.int64).tolist(), strict=True):
                    bands[i] = x
                cells[own] = sketch.view(np.int64)
            for i in full:
                keys[i] = set_key(sets[i])
            sizes = pa.array([len(x) for x in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), sizes, pa.array(keys, pa.binary()), pa.array(bands, pa.list_(pa.int64())), *(pa.array(cells[:, i]) for i in range(WORDS))], names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n long, key binary, bands array<long>, " + ", ".join(f"s{i} long" for i in range(WORDS)))


def _near(a: str, b: str, limit: int, percent: int) -> Column:
    """Whether two entries may link, by their sizes and sketches."""
    apart = sum((F.bit_count(F.col(f"{a}.s{i}").bitwiseXOR(F.col(f"{b}.s{i}"))) for i in range(1, WORDS)), F.bit_count(F.col(f"{a}.s0").bitwiseXOR(F.col(f"{b}.s0"))))
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    return (F.least(n, m) * 100 >= F.greatest(n, m) * percent) & (apart <= limit)


def merged(df: DataFrame) -> DataFrame:
    """Marks a table that grows with the input for a merge join, whatever Spark takes its size for.

    Spark sizes a table by its compressed files and an array by one element, also where it is exploded next: ten million
    places in buckets count as less than 10 MB and would go through the driver as a broadcast.
    """
    return df.hint("merge")


def _few(df: DataFrame) -> DataFrame:
    """Marks a table of ids for broadcasting if it is proven small, else for a merge join."""
    return F.broadcast(df) if df.count() <= SMALL else merged(df)


def full_sets(docs: DataFrame, entries: DataFrame, k: int) -> DataFrame:
    """(eid, items, low) of entries (eid, key, rep): all shingle hashes, in ascending order, and their low halves."""

    def run(batches):
        seen = set()  # rows that repeat an id and its text give their set once a task
        for batch in by_size(batches, "text", 2 << 20):
            sets = list(shingle_sets([x or "" for x in batch.column("text").to_pylist()], k))
            ids, out = [], []
            for x, key, eid in zip(sets, batch.column("key").to_pylist(), batch.column("eid").to_pylist(), strict=True):
                if eid not in seen and set_key(x) == key:
                    seen.add(eid)
                    ids.append(eid)
                    out.append(x)
            flat = np.concatenate(out).view(np.int64) if out else np.empty(0, np.int64)
            ends = pa.array(np.cumsum([0, *map(len, out)]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (flat, flat.view(np.uint64).astype(np.uint32).view(np.int32))]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *lists], names=["eid", "items", "low"])

    wanted = entries.select(F.col("rep").alias("doc_id"), "key", "eid")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(_few(wanted), "doc_id").select("text", "key", "eid")
    sets = materialize(texts.mapInArrow(run, "eid long, items array<long>, low array<int>"), "neardup-sets")
    if sets.count() > entries.count():
        once = materialize(sets.dropDuplicates(["eid"]), "neardup-sets")
        discard(sets)
        return once
    return sets


def confirm(sets: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b) of entries, those that link on their full sets.

    ``b`` may be a hub: its set is joined last and so never moves once per pair.
    """
    both = merged(pairs).join(sets.select(F.col("eid").alias("a"), F.col("items").alias("of_a")), "a").join(sets.select(F.col("eid").alias("b"), F.col("items").alias("of_b")), "b")
    same = F.size(F.array_intersect("of_a", "of_b"))
    return materialize(both.filter(same * 100 >= percent * (F.size("of_a") + F.size("of_b") - same)).select("a", "b"), "neardup-links")


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every id of the links (u, v) but the smallest of its component, with that smallest id."""
    ids, at = np.unique(np.concatenate((u, v)), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    label = np.arange(len(ids))
    while True:
        x, y = label[a], label[b]
        if np.array_equal(x, y):
            break
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(label, further := label[label]):
            label = further
    own = np.flatnonzero(label != np.arange(len(ids)))
    return ids[own], ids[label[own]]


def contracted(links: DataFrame) -> DataFrame:
    """Links (u, v) that reach the same ids: each LINKS of a partition are replaced by stars around their smallest ids."""

    def run(batches):
        held, n = [], 0
        for batch in batches:
            held.append([x.to_numpy(zero_copy_only=False) for x in batch.columns])
            n += batch.num_rows
            if n >= LINKS:
                held = [forest(*(np.concatenate(x) for x in zip(*held, strict=True)))]
                if 2 * len(held[0][0]) > n:  # few links were spared, so more of them would only fill the memory
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in held.pop()], names=["u", "v"])
                n = sum(len(x[0]) for x in held)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in forest(*(np.concatenate(x) for x in zip(*held, strict=True)))], names=["u", "v"])

    return links.mapInArrow(run, "u long, v long")


def components(links: DataFrame) -> DataFrame:
    """(id, component) of every id in links (a, b): the smallest id reachable.

    Alternates large and small stars until the links stay as they are; a few rounds, each two
    aggregations and joins over what is left of the links.  What a task holds of them is contracted before
    and after each round, so most rounds have little to do but to see that nothing changes.  Joins are merged: the
    smallest ids of a round never go through the driver as a broadcast.
    """
    links = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v")
    edges, state = _contracted_table(links)
    while state[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(merged(low), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(merged(low), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        before, last = edges, state
        edges, state = _contracted_table(small)
        discard(before)
        if state == last:
            break
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


def _contracted_table(links: DataFrame) -> tuple[DataFrame, tuple]:
    """The contracted links as a table, and their number and a sum of their hashes, observed as they are written."""
    seen = Observation()
    edges = materialize(contracted(links).observe(seen, F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")), "components")
    return edges, (seen.get["n"], seen.get["h"])


def _near_pairs(pairs: DataFrame, entries: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b), those whose sizes and sketches allow a link."""
    cells = [f"s{i}" for i in range(WORDS)]
    of = lambda c: entries.select(F.col("eid").alias(c), F.struct("n", *cells).alias(f"x{c}"))
    return merged(pairs).join(of("a"), "a").join(of("b"), "b").filter(_near("xa", "xb", distance_limit(percent), percent)).select("a", "b")


def hub_pairs(shared: DataFrame) -> DataFrame:
    """(a, b) of each member (bucket, eid, size) and the hub of its bucket, once."""
    weight = shared.groupBy("eid").agg(F.sum("size").alias("weight"))
    hubs = shared.join(merged(weight), "eid").groupBy("bucket").agg(F.max(F.struct("weight", (-F.col("eid")).alias("eid"))).alias("h")).select("bucket", (-F.col("h.eid")).alias("b"))
    return shared.join(merged(hubs), "bucket").select(F.col("eid").alias("a"), "b").filter("a <> b").distinct()


def count_cells(sets: DataFrame) -> np.ndarray:
    """How many items fall into each of 2**CELLS cells; this bounds what reaches the driver."""

    def run(batches):
        total = np.zeros(1 << CELLS, np.int64)
        for batch in batches:
            total += np.bincount(_cells(batch.column("items").flatten().to_numpy(zero_copy_only=False)), minlength=1 << CELLS)
        full = np.flatnonzero(total)
        for a in range(0, len(full), 1 << 16):
            own = full[a : a + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(total[own])], names=["cell", "n"])

    rows = sets.select("items").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(1 << CELLS, np.int64)
    out[rows.column("cell").to_numpy()] = rows.column("n").to_numpy()
    return out


def _cells(items: np.ndarray) -> np.ndarray:
    return (items.view(np.uint64) >> np.uint64(64 - CELLS)).astype(np.int64)


def prefixes(sets: DataFrame, counts: np.ndarray, percent: int) -> DataFrame:
    """(item, eid, n, c, low) of the items that a link must meet in; low: among those of a smaller set."""

    def run(batches):
        for batch in batches:
            for eid, c, items in zip(batch.column("eid").to_pylist(), batch.column("c").to_pylist(), batch.column("items"), strict=True):
                own = items.values.to_numpy(zero_copy_only=False)
                n = len(own)
                most, least = n - -(-percent * n // 100) + 1, n - -(-2 * percent * n // (100 + percent)) + 1
                first = own[np.lexsort((own, counts[_cells(own)]))[:most]]
                yield pa.RecordBatch.from_arrays([pa.array(first), *(pa.array(np.full(most, x)) for x in (eid, n, c)), pa.array(np.arange(most) < least)], names=["item", "eid", "n", "c", "low"])

    return sets.mapInArrow(_together(run), "item long, eid long, n long, c long, low boolean")


def _together(f, rows: int = 1 << 16):
    """Joins the small batches of a function to some of about so many rows."""

    def run(batches):
        held, n = [], 0
        for batch in f(batches):
            held.append(batch)
            n += batch.num_rows
            if n >= rows:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches()
                held, n = [], 0
        if held:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()

    return run


def crossing_links(mixed: DataFrame, entries: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b) of the entries of different components that share a bucket (bucket, eid, c, main) and link.

    Sketches and sets stand in the join's condition, so that hardly any pairs are made but links.  The
    join has the low halves of the sets' hashes, which may meet by chance: it allows for many times as many
    lost items as chance would take, and what passes is confirmed on the whole hashes.
    """
    cells = [f"s{i}" for i in range(WORDS)]
    rows = materialize(merged(mixed).join(entries.select("eid", "n", "bands", *cells), "eid").join(sets.select("eid", "low"), "eid"), "neardup-crossing")
    x, y = rows.filter("c <> main").alias("x"), rows.alias("y")
    apart = (F.col("x.c") != F.col("y.c")) & ((F.col("y.c") == F.col("y.main")) | (F.col("x.c") < F.col("y.c")))
    once = F.element_at(F.array_intersect("x.bands", "y.bands"), 1) == F.col("x.bucket")  # in the first bucket that a pair shares
    slack = 2 + F.shiftright(F.col("x.n") * F.col("y.n"), 27)
    link = (F.size(F.array_intersect("x.low", "y.low")) + slack) * (100 + percent) >= (F.col("x.n") + F.col("y.n")) * percent
    joined = merged(x).join(y, (F.col("x.bucket") == F.col("y.bucket")) & apart & _near("x", "y", distance_limit(percent), percent) & once & link)
    pairs = materialize(joined.select(F.col("x.eid").alias("a"), F.col("y.eid").alias("b")), "neardup-pairs")
    links = confirm(sets, pairs, percent)
    discard(rows, pairs)
    return links


def crossing_pairs(postings: DataFrame, percent: int) -> DataFrame:
    """(a, b) of different components that share an item of their prefixes, once.

    The smaller of a pair is met on a ``low`` item, so an item that is low in no set makes no pair, and
    of an item's largest component only the members of the others meet it.
    """
    several = (F.min("c") != F.max("c")) & (F.max(F.col("low").cast("int")) == 1)
    mixed = postings.groupBy("item").agg(several.alias("x")).filter("x").select("item")
    live = materialize(postings.join(_few(mixed), "item"), "neardup-items")
    main = live.groupBy("item", "c").agg(F.count("*").alias("m")).groupBy("item").agg(F.max(F.struct("m", "c")).alias("x")).select("item", F.col("x.c").alias("main"))
    live = materialize(live.join(merged(main), "item"), "neardup-items")

    def meet(x: DataFrame, y: DataFrame) -> DataFrame:
        x, y = x.alias("x"), y.alias("y")
        alike = (F.col("x.c") != F.col("y.c")) & F.col("x.n").between(F.ceil(F.col("y.n") * percent / 100), F.col("y.n"))
        return merged(x).join(y, (F.col("x.item") == F.col("y.item")) & alike).select(F.least("x.eid", "y.eid").alias("a"), F.greatest("x.eid", "y.eid").alias("b"))

    other, same = F.col("c") != F.col("main"), F.col("c") == F.col("main")
    return meet(live.filter(F.col("low") & other), live).unionByName(meet(live.filter(F.col("low") & same), live.filter(other))).distinct()


def link_components(docs: DataFrame, table: DataFrame, k: int, percent: int, one_id: bool = True) -> tuple[DataFrame, DataFrame]:
    """(doc_id, eid) of every row with a set, and (key, eid, c, rep) of every different set: its component c and that one's smallest id.

    With ``one_id`` the sets of an id are linked with one another.
    """
    cells = [f"s{i}" for i in range(WORDS)]
    full = table.filter("key is not null and doc_id is not null")
    entries = full.groupBy("key").agg(F.min_by(F.struct("n", *cells, "bands"), "doc_id").alias("x"), F.min("doc_id").alias("rep"))
    entries = materialize(entries.select(F.monotonically_increasing_id().alias("eid"), "key", "rep", "x.*"), "neardup-entries")
    rows = materialize(full.select("doc_id", "key").join(merged(entries.select("key", "eid")), "key").select("doc_id", "eid"), "neardup-rows")
    places = entries.select("eid", F.explode("bands").alias("bucket"))
    sizes = places.groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1")
    shared = materialize(merged(places).join(sizes, "bucket"), "neardup-buckets")
    stars = materialize(_near_pairs(hub_pairs(shared), entries, percent), "neardup-stars")
    chosen = materialize(entries.select("eid", "key", "rep").join(merged(shared.select("eid")), "eid", "left_semi"), "neardup-chosen")
    sets = full_sets(docs, chosen, k)
    links = confirm(sets, stars, percent)
    known = materialize(components(links), "neardup-known")

    named = shared.select("bucket", "eid").join(merged(known), shared.eid == known.id, "left").select("bucket", "eid", F.coalesce("component", "eid").alias("c"))
    groups = named.groupBy("bucket", "c").agg(F.count("*").alias("m")).groupBy("bucket").agg(F.max(F.struct("m", "c")).alias("x"), F.sum("m").alias("size"), F.count("*").alias("parts"))
    groups = groups.filter("parts > 1").select("bucket", F.col("x.c").alias("main"), ((F.col("size") - F.col("x.m")) * F.col("size")).alias("work"))
    mixed = materialize(named.join(merged(groups), "bucket"), "neardup-mixed")
    more = crossing_links(mixed.filter(F.col("work") <= WORK).select("bucket", "eid", "c", "main"), entries, sets, percent)
    hot = materialize(mixed.filter(F.col("work") > WORK).select("eid", "c").distinct(), "neardup-hot")
    if hot.limit(1).count():
        few = more
        open_sets = materialize(sets.select("eid", "items").join(_few(hot), "eid"), "neardup-open")
        postings = materialize(prefixes(open_sets, count_cells(open_sets), percent), "neardup-prefixes")
        crossed = materialize(_near_pairs(crossing_pairs(postings, percent), entries, percent), "neardup-crossed")
        more = materialize(few.unionByName(confirm(sets, crossed, percent)), "neardup-links")
        discard(few, open_sets, postings, crossed)
    edges = more
    if one_id:
        several = rows.groupBy("doc_id").agg(F.min("eid").alias("b"), F.max("eid").alias("last")).filter("b <> last").select("doc_id", "b")
        edges = materialize(edges.unionByName(rows.join(_few(several), "doc_id").select(F.col("eid").alias("a"), "b").filter("a <> b").distinct()), "neardup-links")
    found = known
    if edges.limit(1).count():
        found = materialize(components(known.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(edges)), "neardup-known")
    discard(shared, stars, chosen, sets, links, mixed, hot)
    label = F.coalesce("component", "eid")
    own = entries.join(merged(found), entries.eid == found.id, "left").select("key", "eid", "rep", label.alias("c"))
    least = own.groupBy("c").agg(F.min("rep").alias("least"))
    return rows, own.join(merged(least), "c").select("key", "eid", "c", F.col("least").alias("rep"))


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of ``docs``."""
    table = materialize(sketch_table(docs, k), "neardup-sketches")
    rows, named = link_components(docs, table, k, percent)
    of_id = rows.join(merged(named.select("eid", "rep")), "eid").groupBy("doc_id").agg(F.min("rep").alias("rep"))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("rep", "doc_id"))
    return table.select("doc_id", "n").join(merged(of_id), "doc_id", "left").select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def with_set_key(docs: DataFrame, k: int) -> DataFrame:
    """(key, row, doc_id) of every row; key is null for empty sets."""

    def run(batches):
        for batch in by_size(batches, "text", 2 << 20):
            keys = [set_key(x) if len(x) else None for x in shingle_sets([x or "" for x in batch.column("text").to_pylist()], k)]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), batch.column("row"), batch.column("doc_id")], names=["key", "row", "doc_id"])

    packed = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return packed.mapInArrow(run, T.StructType([T.StructField("key", T.BinaryType()), packed.schema["row"], T.StructField("doc_id", T.LongType())]))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates: five-word shingles, similarity 0.8 or more.

    Each row is judged by its own text: the one with the smallest id of its group stays.  Where an id
    repeats, the rows of that id with other texts are other documents; of equal rows one stays.  Rows
    without words or without an id stay.
    """
    k, percent = 5, 80
    table = materialize(sketch_table(docs.select("doc_id", "text"), k), "neardup-sketches")
    rows, named = link_components(docs, table, k, percent, one_id=False)
    named = materialize(named, "neardup-named")
    times = materialize(table.filter("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id"), "neardup-repeated")
    gone = rows.join(merged(named.select("eid", "rep")), "eid").filter("rep <> doc_id").select("doc_id").unionByName(times).distinct()
    gone = materialize(gone, "neardup-gone")
    rest = docs.join(_few(gone), docs.doc_id.cast("long") == gone.doc_id, "left_anti")
    if not times.limit(1).count():
        return rest
    own = with_set_key(docs.join(_few(times), docs.doc_id.cast("long") == times.doc_id, "left_semi"), k).join(merged(named), "key", "left")
    empty = own.filter("key is null").select("row.*")
    full = own.filter("rep = doc_id").groupBy("c").agg(F.first("row").alias("row")).select("row.*")
    return rest.unionByName(empty).unionByName(full)


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), k=2, percent=80)
