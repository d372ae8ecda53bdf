"""Toxicity by maximum-scoring segments of token log-odds.

Training counts, for each word, the labelled documents of either class that hold it.  Every counted word
is scored by its log-odds under an informative Dirichlet prior, weighted by the probability that its rate
differs between the classes at all (the share of such words is estimated from all counts), and by the
slightly negative log-odds of the other words for the rest of that probability.  A document's words then
form a sequence of positive and negative scores; words that the fit has not seen, that only RARE
clean documents hold, or that score within NEAR of the other words, score as those.  A linear-time scan finds all maximal scoring segments.  Extreme-value statistics turn a
segment's score S in a text of n words into E = K n exp(-lambda S): lambda solves the Karlin-Altschul
equation under the clean words' frequencies, K comes from the largest segments of clean documents.
Segments of E < 1 count; a logistic link, fitted on documents that the scoring lexicon was not counted
on (FOLDS folds), maps the sum of their normalised scores to 0..1.

The fit uses labelled rows only, at most ``bound`` of them for each class, chosen by a hash of the id
(documented bound); every document is scored, over its whole text.

Rows: null and empty texts have no segments and get the score of a text without evidence; a null id
is never held out; repeated rows get equal scores; a document with several labels counts as toxic if
one of them says so; without labels of both classes all scores are 0; an empty table gives an empty
table; further columns pass through ``score``, but those with the name of an output column are replaced.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import by_size, fresh, materialize, uniform, without

WORD = re.compile(r"\w+")
BOUND = 8000  # labelled rows of a class used by the fit, about
PRIOR = 0.01  # prior weight as a share of all counts
NEAR = 0.05  # nats within which a score is rounded to that of the other words, which are not stored
RARE = 2  # words of so many clean and no toxic documents are counted together, as they score near the other words
FOLDS = 8
HELD = 200_000  # words of documents that a task counts before it passes them on
LOW, HIGH = -4.0, 12.0  # range of the evidence that the link sees
THRESHOLD = 0.7
TIE = 1e-9  # sums that differ by less count as equal, as rounding makes them differ


def held_out(doc_id: str = "doc_id", of: int = 3, rest: int = 1) -> Column:
    """Whether crc32 of the id as text leaves this remainder; false for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % of == rest, F.lit(False))


def words_of(text: str) -> list[str]:
    """The lower-cased words of a text, one for each place that ``WORD`` finds in it."""
    low = text.lower()
    return WORD.findall(low) if len(low) == len(text) else [w.lower() for w in WORD.findall(text)]


def segments(hits: list[tuple[int, float]], gap: float) -> list[tuple[float, int, int]]:
    """All maximal scoring segments, in linear time: (score, first word, last word).

    ``hits``: positions and scores of either sign, ascending; every other word scores ``gap`` (negative).
    A candidate points to the last one before it with a smaller left sum, so that a search passes over
    those between them once and never again.
    """
    kept: list[list] = []  # left sum, right sum, first, last, the candidate pointed to
    total, at = 0.0, -1
    for pos, weight in hits:
        total += gap * (pos - at - 1)
        new = [total, total + weight, pos, pos, -1]
        total, at = new[1], pos
        if weight <= 0:
            continue
        while True:
            j = len(kept) - 1
            while j >= 0 and kept[j][0] >= new[0] - TIE:
                j = kept[j][4]
            if j < 0 or kept[j][1] >= new[1] - TIE:
                break
            new[0], new[2] = kept[j][0], kept[j][2]
            del kept[j:]
        new[4] = j
        kept.append(new)
    return [(r - left, a, b) for left, r, a, b, _ in kept]


def evidence(strengths: list[float]) -> float:
    """Sum of the significant strengths, else the largest of the others, within LOW..HIGH."""
    return min(HIGH, max(LOW, sum(x for x in strengths if x > 0) or max([LOW, *strengths])))


@dataclass
class Scorer:
    """Word scores and the extreme-value parameters that go with them."""

    words: dict[str, float] = field(default_factory=dict)
    gap: float = -0.01
    lam: float = 1.0
    log_k: float = 0.0
    a: float = -20.0
    b: float = 0.0

    def find(self, text: str) -> tuple[int, list[tuple[float, int, int]]]:
        tokens = words_of(text)
        words = self.words
        hits = [(i, words[t]) for i, t in enumerate(tokens) if t in words]
        return len(tokens), segments(hits, self.gap)

    def strengths(self, n: int, found: list[tuple[float, int, int]]) -> list[float]:
        """lambda S - ln(K n): minus the logarithm of each segment's E."""
        return [self.lam * s - self.log_k - math.log(max(n, 1)) for s, _, _ in found]

    def statistic(self, text: str) -> float:
        n, found = self.find(text)
        return evidence(self.strengths(n, found))

    def score(self, text: str) -> tuple[float, list[tuple[int, int, float]]]:
        """Probability of label 1, and the character spans of significant segments with their E."""
        n, found = self.find(text)
        each = self.strengths(n, found)
        stat = evidence(each)
        spans = []
        if any(x > 0 for x in each):
            places = [m.span() for m in WORD.finditer(text)]
            spans = [(places[i][0], places[j][1], math.exp(-x)) for x, (_, i, j) in zip(each, found, strict=True) if x > 0]
        z = max(-60.0, min(60.0, self.a + self.b * stat))
        return 1 / (1 + math.exp(-z)), spans


def _count(sample: DataFrame) -> tuple[pa.ChunkedArray, np.ndarray, np.ndarray, np.ndarray]:
    """All words of the sample (null: so many rare ones with these counts), and of each the documents that hold it by class (2) and fold (FOLDS); the classes' totals by fold."""

    def run(batches):
        counts = [[Counter() for _ in range(FOLDS)] for _ in range(2)]
        totals, held = np.zeros((2, FOLDS), np.int64), 0

        def out():
            for f in range(FOLDS):
                words = list(counts[0][f].keys() | counts[1][f].keys())
                both = [[int(totals[k, f]), *(counts[k][f][w] for w in words)] for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([pa.array(["", *words], pa.string()), pa.array([f] * (len(words) + 1), pa.int32()), *(pa.array(x, pa.int64()) for x in both)], names=["word", "fold", "clean", "toxic"])
                counts[0][f].clear()
                counts[1][f].clear()
            totals[:] = 0

        for batch in by_size(batches, "text"):
            for text, label, fold in zip(*(batch.column(c).to_pylist() for c in ("text", "toxic", "fold")), strict=True):
                found = set(words_of(text or ""))
                counts[label][fold].update(found)
                totals[label, fold] += len(found)
                held += len(found)
            if held > HELD:
                yield from out()
                held = 0
        yield from out()

    own = lambda c: [F.sum(F.when(F.col("fold") == f, F.col(c)).otherwise(0)).cast("int").alias(f"{c}{f}") for f in range(FOLDS)]
    all_of = lambda c: sum((F.col(f"{c}{f}") for f in range(1, FOLDS)), F.col(f"{c}0"))
    by_word = sample.select("text", "toxic", "fold").mapInArrow(run, "word string, fold int, clean long, toxic long").groupBy("word").agg(*own("clean"), *own("toxic"))
    columns = [f"{c}{f}" for c in ("clean", "toxic") for f in range(FOLDS)]
    totals = by_word.filter("word = ''").select(*columns).collect()
    name = F.when((all_of("toxic") > 0) | (all_of("clean") > RARE), F.col("word"))
    # bounded by the sample's words
    rows = by_word.filter("word <> ''").groupBy(name.alias("word"), *columns).agg(F.count("*").cast("int").alias("times")).toArrow().sort_by([("word", "ascending"), *((c, "ascending") for c in columns)])
    counts = np.stack([rows.column(c).to_numpy() for c in columns], axis=1).reshape(-1, 2, FOLDS)
    return rows.column("word"), rows.column("times").to_numpy(), counts, np.array(totals[0] if totals else [0] * (2 * FOLDS), np.int64).reshape(2, FOLDS)


def _differs(toxic: np.ndarray, clean: np.ndarray, times: np.ndarray, share: float) -> np.ndarray:
    """Of each word, the probability that its share of class 1 is its own (uniform) and not ``share``; the part of such words is found by EM."""
    both = toxic + clean
    log_fact = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, both.max(initial=0) + 1)))])
    ways = log_fact[both] - log_fact[toxic] - log_fact[clean]
    bayes = -np.log(both + 1) - ways - toxic * math.log(share) - clean * math.log(1 - share)
    part = 0.01
    for _ in range(500):
        q = 1 / (1 + np.exp(-np.clip(math.log(part / (1 - part)) + bayes, -60, 60)))
        last, part = part, min(0.5, max(1e-6, float(np.average(q, weights=times)))) if len(q) else part
        if abs(part - last) < 1e-9:
            break
    return q


def _lexicon(named: np.ndarray, times: np.ndarray, counts: np.ndarray, totals: np.ndarray) -> tuple[Scorer, np.ndarray] | None:
    """The scorer of word counts (words x 2) and class totals, without its words, and their scores (nan: as the other words)."""
    n0, n1 = totals.tolist()
    if not n0 or not n1:
        return None
    seen = np.flatnonzero(counts.sum(axis=1))
    clean, toxic, times = counts[seen, 0], counts[seen, 1], times[seen]
    prior = PRIOR * (clean + toxic)
    rest = PRIOR * (n0 + n1)
    delta = np.log((toxic + prior) / (n1 + rest - toxic - prior)) - np.log((clean + prior) / (n0 + rest - clean - prior))
    q = _differs(toxic, clean, times, n1 / (n0 + n1))
    gap = min(-1e-3, math.log(max(n1 - (q * toxic * times).sum(), 1) / n1) - math.log(max(n0 - (q * clean * times).sum(), 1) / n0))
    far = np.flatnonzero(named[seen] & (abs(q * (delta - gap)) > NEAR))
    s, p = (gap + q * (delta - gap))[far], ((clean + prior) / (n0 + rest))[far]
    scores = np.full(len(named), np.nan)
    scores[seen[far]] = s
    scorer = Scorer({}, gap)
    if len(far):
        f = lambda x: float((p * np.exp(x * s)).sum() + (1 - p.sum()) * math.exp(x * gap) - 1)
        low, high = 1e-3, 4.0
        for _ in range(60):
            mid = (low + high) / 2
            low, high = (mid, high) if f(mid) < 0 else (low, mid)
        scorer.lam = low
    return scorer, scores


def _statistics(sample: DataFrame, words: pa.Array, by_fold: list[tuple[Scorer, np.ndarray]], log_k: float = 0.0) -> list:
    """Of each sampled document, by the scores counted without its fold: label, fold, words, the best segment's score, and the evidence of all."""
    table = np.stack([scores for _, scores in by_fold])
    kept = np.flatnonzero(~np.isnan(table).all(axis=0))
    scorers = [Scorer({}, x.gap, x.lam, log_k) for x, _ in by_fold]
    sent = sample.sparkSession.sparkContext.broadcast((words.take(pa.array(kept)), scorers, table[:, kept]))

    def run(batches):
        words, scorers, scores = sent.value
        row = {w: i for i, w in enumerate(words.to_pylist())}  # the folds share the words
        for batch in by_size(batches, "text"):
            rows = []
            for text, label, fold in zip(*(batch.column(c).to_pylist() for c in ("text", "toxic", "fold")), strict=True):
                tokens, own = words_of(text or ""), scores[fold]
                hits = [(i, x) for i, t in enumerate(tokens) if (j := row.get(t)) is not None and (x := float(own[j])) == x]
                found = segments(hits, scorers[fold].gap)
                rows.append((label, fold, len(tokens), max([0.0, *(s for s, _, _ in found)]), evidence(scorers[fold].strengths(len(tokens), found))))
            cols = zip(*rows, strict=True) if rows else ([], [], [], [], [])
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["label", "fold", "n", "best", "evidence"])

    # a row of numbers for each of the sample's documents, however long they are
    found = sample.select("text", "toxic", "fold").mapInArrow(run, "label int, fold int, n long, best double, evidence double").collect()
    sent.destroy()
    return found


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 2.0) -> tuple[float, float]:
    """Intercept and slope by damped Newton steps; the slope is drawn to 1, as evidence is in nats."""

    def loss(a: float, b: float) -> float:
        z = a + b * x
        return float((np.logaddexp(0, z) - y * z).sum() + ridge * ((b - 1) ** 2 + a * a / 50) / 2)

    a, b = -2.0, 1.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a + b * x, -60, 60)))
        w = p * (1 - p)
        g = np.array([(p - y).sum() + ridge * a / 50, ((p - y) * x).sum() + ridge * (b - 1)])
        h = np.array([[w.sum() + ridge / 50, (w * x).sum()], [(w * x).sum(), (w * x * x).sum() + ridge]])
        step, size, now = np.linalg.solve(h, g), 1.0, loss(a, b)
        while size > 1e-6 and loss(a - size * step[0], b - size * step[1]) > now:
            size /= 2
        a, b = a - size * float(step[0]), b - size * float(step[1])
        if size * abs(step).max() < 1e-8:
            break
    return a, b


def fit(docs: DataFrame, labels: DataFrame, bound: int = BOUND) -> Scorer:
    """Learns from labelled documents outside the held-out third."""
    usable = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    counts = {r.toxic: r["count"] for r in usable.groupBy("toxic").count().collect()}
    if len(counts) < 2:
        return Scorer()
    chance = F.when(F.col("toxic") == 1, min(1.0, bound / counts[1])).otherwise(min(1.0, bound / counts[0]))
    chosen = usable.filter(uniform("doc_id") < chance)  # about 2 * bound rows at most
    sample = materialize(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(FOLDS)).cast("int")), "toxicity-sample")
    words, times, by_word, totals = _count(sample)
    named = words.is_valid().to_numpy()
    whole = _lexicon(named, times, by_word.sum(axis=2), totals.sum(axis=1))
    if whole is None:
        return Scorer()
    final, scores = whole
    folds = [_lexicon(named, times, by_word.sum(axis=2) - by_word[:, :, f], totals.sum(axis=1) - totals[:, f]) or whole for f in range(FOLDS)]
    kept = np.flatnonzero(~np.isnan(scores))
    final.words = dict(zip(words.take(pa.array(kept)).to_pylist(), scores[kept].tolist(), strict=True))
    clean = [folds[r.fold][0].lam * r.best - math.log(max(r.n, 1)) for r in _statistics(sample, words.combine_chunks(), folds) if r.label == 0]
    log_k = float(np.clip(np.mean(clean) - 0.5772156649, -12, 0)) if clean else 0.0
    rows = _statistics(sample, words.combine_chunks(), folds, log_k)
    stats, y = [r.evidence for r in rows], [r.label for r in rows]
    final.log_k = log_k
    weight = {k: counts[k] / max(1, y.count(k)) for k in (0, 1)}
    x, y = np.array(stats), np.array(y, float)
    final.a, final.b = _logistic(x, y)
    final.a += math.log(weight[1] / weight[0]) if weight[0] and weight[1] else 0.0
    return final


def score(docs: DataFrame, scorer: Scorer, text: str = "text", value: str = "toxicity", where: str = "toxic_spans") -> DataFrame:
    """All rows and columns plus the score (0 to 1) and the toxic spans (characters and E)."""
    docs = without(docs, value, where)
    sent = docs.sparkSession.sparkContext.broadcast(scorer)  # bounded by the fit's sample
    span = "array<struct<first:int,end:int,evalue:double>>"
    schema = T.StructType([*docs.schema.fields, T.StructField(value, T.DoubleType()), T.StructField(where, T._parse_datatype_string(span))])
    kind = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32()), ("evalue", pa.float64())]))

    def run(batches):
        own = sent.value
        for batch in by_size(batches, text):
            found = [own.score(x or "") for x in batch.column(text).to_pylist()]
            spans = [[{"first": a, "end": b, "evalue": e} for a, b, e in s] for _, s in found]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([x for x, _ in found], pa.float64()), pa.array(spans, kind)], names=[*batch.schema.names, value, where])

    return docs.mapInArrow(run, schema)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that are not predicted toxic."""
    scorer = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    value, where = fresh(docs, "toxicity"), fresh(docs, "toxic_spans")
    return score(docs, scorer, value=value, where=where).filter(F.col(value) < THRESHOLD).select(*docs.columns)


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = score(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    value = F.col("toxicity")
    return found.select("doc_id", held_out().alias("held_out"), value.alias("score"), (value >= THRESHOLD).cast("int").alias("predicted"), F.size("toxic_spans").cast("long").alias("n_spans"))
