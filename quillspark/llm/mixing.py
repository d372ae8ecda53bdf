"""Mixing sources to target weights by temperature.

The shares p of the sources' tokens are exponentiated and normalised: w ~ p**alpha.  The exponent is
found by bisection (GRID points a pass), either so that the entropy of w meets a target, for which it is
any number from 0 on and an entropy that no exponent gives is an error, as is one that shows a source more than MOST_EPOCHS times, or as the smallest (flattest) in
0..1 under which no source is repeated more than ``max_repeat`` times.  The budget of tokens is given,
or is the smallest that shows every document at least once.  Sources stay a table: a pass sums powers
over it, and only sums reach the driver.

Weights become a sequence of blocks: each source's documents are dealt into up to BLOCKS blocks by a
hash of all their columns but maps, and every epoch of a source runs through its blocks in a keyed permutation of its own.  Whole
epochs show all blocks; the last one stops within the block that reaches the source's budget (the block
is taken if at least half of it is wanted).  A document's place in the mixture is the keyed order of its
(epoch, block) among all sources', spread over 0..1, so that a prefix of the mixture has about the target
weights too.

Only sums per (source, block) are gathered: BLOCKS rows a source at most, from which the plan is made.
A source that holds a third of all rows is dealt into as many blocks as its size asks for.

Rows: null texts have no tokens and follow their block; a null source is a source of its own; null or
repeated ids are dealt out by their other columns; rows equal in all columns are documents of their own
that share a block; an empty table, or one without tokens, passes through once; all columns
pass through ``mix``, but those with the name of an output column are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import materialize

BLOCKS = 1024
BLOCK_TOKENS = 20_000
MAX_REPEAT = 2.0
#: Epochs of a source beyond which a target is an error.
MOST_EPOCHS = 1000
#: Plan rows that may be broadcast: about 60 bytes each.
SMALL = 200_000
SEED = 20240229
GRID = 16  # exponents tried in a pass
CLOSE, STEEPEST = 1e-7, 2.0**60


@dataclass
class Totals:
    """What an exponent depends on: sources with tokens, the least and the most tokens of one, and power sums."""

    n: int
    least: float
    most: float
    ties: int  # sources with the most tokens
    sums: Callable[[list[float]], list[tuple[float, float]]]  # per exponent a: sums of x**a and of x**a ln x, x = tokens / most


def array_totals(tokens: np.ndarray) -> Totals:
    x = np.asarray(tokens, float)
    r = x / x.max()
    return Totals(len(x), float(x.min()), float(x.max()), int((x == x.max()).sum()), lambda found: [(float((r**a).sum()), float((r**a * np.log(r)).sum())) for a in found])


def table_totals(totals: DataFrame, c: str = "t") -> Totals | None:
    """The same of a table with a positive column; None for an empty one."""
    own = totals.agg(F.count("*").alias("n"), F.min(c).alias("least"), F.max(c).alias("most")).collect()[0]
    if not own.n:
        return None
    x = F.col(c) / F.lit(float(own.most))
    ties = totals.filter(F.col(c) == own.most).count()

    def sums(found: list[float]) -> list[tuple[float, float]]:
        row = totals.agg(*(f for i, a in enumerate(found) for f in (F.sum(F.pow(x, F.lit(a))).alias(f"s{i}"), F.sum(F.pow(x, F.lit(a)) * F.log(x)).alias(f"e{i}")))).collect()[0]
        return [(row[2 * i], row[2 * i + 1]) for i in range(len(found))]

    return Totals(own.n, float(own.least), float(own.most), ties, sums)


def entropy_of(a: float, total: float, logs: float) -> float:
    """Entropy in nats of weights x**a / total, with ``logs`` the sum of x**a ln x."""
    return math.log(total) - a * logs / total


def solve(totals: Totals, budget: float | None = None, max_repeat: float | None = None, entropy: float | None = None) -> float:
    """The exponent that meets the target: ``entropy`` in nats, or ``max_repeat`` in epochs (within 0..1)."""
    if entropy is not None and not math.log(totals.ties) - CLOSE <= entropy <= math.log(totals.n) + CLOSE:
        raise ValueError(f"no exponent gives an entropy of {entropy}: it lies in {math.log(totals.ties):.6g}..{math.log(totals.n):.6g}")

    def too_flat(found: list[float]) -> list[bool]:
        if entropy is not None:
            return [entropy_of(a, *x) > entropy + CLOSE * CLOSE for a, x in zip(found, totals.sums(found), strict=True)]
        epochs = [(totals.least / totals.most) ** (a - 1) for a in found]  # of the smallest source, if the largest is shown once
        if budget:
            epochs = [e * budget / (s * totals.most) for e, (s, _) in zip(epochs, totals.sums(found), strict=True)]
        return [e > max_repeat * (1 + 1e-12) for e in epochs]

    low, high = 0.0, 1.0
    if not too_flat([0.0])[0]:
        return 0.0
    if entropy is not None:
        while too_flat([high])[0] and high < STEEPEST:
            low, high = high, 2 * high
    while high - low > CLOSE * CLOSE * max(1.0, high):
        inner = [low + (high - low) * (i + 1) / (GRID + 1) for i in range(GRID)]
        if inner[0] <= low or inner[-1] >= high:
            break
        flat = sum(too_flat(inner))
        low, high = ([low, *inner][flat], [*inner, high][flat])
    return high


def exponent(tokens: np.ndarray, budget: float | None = None, max_repeat: float | None = None, entropy: float | None = None) -> float:
    return solve(array_totals(tokens), budget, max_repeat, entropy)


def targets(tokens: dict, budget: float | None = None, max_repeat: float | None = MAX_REPEAT, entropy: float | None = None) -> dict:
    """Of each source with tokens: (weight, budget in tokens, epochs)."""
    names = [k for k, n in tokens.items() if n > 0]
    if not names:
        return {}
    n = np.array([tokens[k] for k in names], float)
    w = (n / n.max()) ** exponent(n, budget, max_repeat, entropy)
    w /= w.sum()
    total = budget or float((n / w).max())
    return {k: (float(a), float(a) * total, float(a) * total / float(m)) for k, a, m in zip(names, w, n, strict=True)}


def source_targets(totals: DataFrame, budget: float | None = None, max_repeat: float | None = MAX_REPEAT, entropy: float | None = None) -> DataFrame:
    """(s, t, parts, weight, wanted, epochs) of sources (s, t): blocks, target weight, its tokens, and how often that shows the source."""
    full = totals.filter("t > 0")
    own = table_totals(full)
    weight = wanted = F.lit(0.0)
    if own is not None:
        a = solve(own, budget, max_repeat, entropy)
        total = own.sums([a])[0][0]
        weight = F.pow(F.col("t") / F.lit(own.most), F.lit(a)) / F.lit(total)
        shown = own.most * total * max(1.0, (own.least / own.most) ** (1 - a))  # shows every source once at least
        wanted = weight * F.lit(float(budget or shown))
    has = F.col("t") > 0
    parts = F.least(F.lit(BLOCKS), F.pow(F.lit(2), F.floor(F.log2(F.greatest(F.col("t") / BLOCK_TOKENS, F.lit(1.0))) + 1e-9)).cast("int"))
    return totals.select("s", "t", parts.alias("parts"), F.when(has, weight).otherwise(0.0).alias("weight"), F.when(has, wanted).otherwise(0.0).alias("wanted"), F.when(has, wanted / F.col("t")).otherwise(1.0).alias("epochs"))


def count_tokens(text: str = "text") -> Column:
    """Tokens of a text: its runs of characters other than white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def mix(docs: DataFrame, tokens: Column, budget: float | None = None, max_repeat: float | None = MAX_REPEAT, entropy: float | None = None, seed: int = SEED) -> DataFrame:
    """The rows of ``docs`` once for each epoch that shows them, with epoch, block and place (0..1)."""
    source = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))
    kept = [c for c in docs.columns if c.lower() not in ("epoch", "block", "place")]
    dealt = [f.name for f in docs.schema if f.name in kept and not isinstance(f.dataType, T.MapType)]
    cell = F.pmod(F.xxhash64(F.lit(seed), *dealt), F.lit(BLOCKS)).cast("int")
    packed = docs.select(F.struct(*kept).alias("row"), source.alias("s"), cell.alias("fine"), tokens.alias("t"))
    # a source's own number of blocks needs its size, so blocks are first counted at the finest grain
    fine = materialize(packed.groupBy("s", "fine").agg(F.sum("t").alias("t")), "mixing-blocks")
    totals = materialize(fine.groupBy("s").agg(F.coalesce(F.sum("t"), F.lit(0)).alias("t")), "mixing-totals")
    by_source = materialize(source_targets(totals, budget, max_repeat, entropy).select("s", "parts", "wanted", "epochs"), "mixing-sources")
    most = by_source.agg(F.max("epochs")).first()[0] or 0
    if most > MOST_EPOCHS:
        raise ValueError(f"the target shows a source {most:.6g} times, more than {MOST_EPOCHS}")
    by_source = F.broadcast(by_source) if by_source.count() <= SMALL else by_source
    blocks = fine.join(by_source, "s").groupBy("s", "parts", "wanted", "epochs", F.pmod("fine", F.col("parts")).alias("block")).agg(F.sum("t").alias("t"))
    each = blocks.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil("epochs"), F.lit(1)).cast("int") - 1)))
    order = F.xxhash64(F.lit(seed + 1), "s", "epoch", "block")
    run = Window.partitionBy("s", "epoch").orderBy(order, "block")
    before = F.sum("t").over(run.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("t")
    total = F.sum("t").over(Window.partitionBy("s", "epoch"))
    left = F.col("wanted") - F.col("epoch") * F.col("total") - F.col("before")
    plan = each.withColumns({"before": before, "total": total, "n": F.row_number().over(run)}).filter((F.col("epochs") >= F.col("epoch") + 1 - 1e-9) | (left >= F.col("t") / 2) & (left > 0) | (F.col("total") == 0))
    spread = F.pmod(F.xxhash64(F.lit(seed + 2), "s", "epoch", "block"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    place = (F.col("epoch") + (F.col("n") - 1 + spread) / F.col("parts")) / F.greatest("epochs", F.lit(1.0))
    plan = materialize(plan.select("s", "parts", "block", "epoch", F.least(place, F.lit(1.0)).alias("place")), "mixing-plan")
    shown = plan.groupBy("s", "block").agg(F.max("parts").alias("parts"), F.sort_array(F.collect_list(F.struct("epoch", "place"))).alias("epochs"))
    shown = F.broadcast(shown) if shown.count() <= SMALL else shown
    named = packed.join(by_source.select("s", F.col("parts").alias("own")), "s").withColumn("block", F.pmod("fine", F.col("own")))
    found = named.join(shown.select("s", "block", "epochs"), ["s", "block"]).withColumn("e", F.explode("epochs"))
    return found.select("row.*", F.col("e.epoch").alias("epoch"), "block", F.col("e.place").alias("place"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shows every document once and those of small sources up to MAX_REPEAT times."""
    packed = docs.select("doc_id", "source", "text", F.struct(*docs.columns).alias("row"))  # keeps columns that mix would replace
    return mix(packed, count_tokens()).select("row.*")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", count_tokens().alias("n_tokens"))
    docs = materialize(docs, "mixing-tokens")  # texts are read and counted once
    return mix(docs, F.col("n_tokens")).select("doc_id", "source", "n_tokens", "epoch", "block", F.round("place", 9).alias("place"))
