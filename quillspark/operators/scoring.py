"""Scores aligned blocks against gold blocks: counters per category and the ratios of their sums.

Gold is always the left side: what an engine did not return keeps its place in every denominator.
Duplicate and unknown keys are errors: counters find them while they pair blocks, before anything is summed.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import normalize, whole_number
from ..storage import materialize
from .ordered import in_order

COUNTERS = (
    "characters", "edits", "blocks", "correctSources", "numbers", "correctNumbers", "cells", "correctCells", "correctCellTexts",
    "cellNeighbours", "correctCellNeighbours", "orderPairs", "correctOrderPairs", "allOrderPairs", "correctAllOrderPairs",
)
#: Ratio -> numerator and denominator. Fixed values.
RATIOS = {
    "cellAccuracy": ("correctCells", "cells"), "cellTextAccuracy": ("correctCellTexts", "cells"), "cellNeighbourAccuracy": ("correctCellNeighbours", "cellNeighbours"),
    "numberAccuracy": ("correctNumbers", "numbers"), "sourceAccuracy": ("correctSources", "blocks"), "orderAccuracy": ("correctOrderPairs", "orderPairs"),
    "allPairsOrderAccuracy": ("correctAllOrderPairs", "allOrderPairs"), "characterErrorRate": ("edits", "characters"),
}


class GuardError(ValueError):
    """The input breaks a rule that scoring relies on."""


def require_unique(df: DataFrame, *keys: str) -> None:
    if df.groupBy(*keys).count().filter("count > 1").limit(1).count():
        raise GuardError(f"{', '.join(keys)} repeat")


def require_known(df: DataFrame, known: DataFrame, *keys: str) -> None:
    if df.join(known, list(keys), "left_anti").limit(1).count():
        raise GuardError(f"unknown {', '.join(keys)}")


def located(verified: Column, proposed: Column, provisional: bool, sha: Column, want_sha: Column, page: Column) -> Column:
    """Whether a location counts: verified, or proposed in a provisional run, in the right file and page."""
    flag = F.coalesce(verified, F.lit(False)) | (F.lit(provisional) & F.coalesce(proposed, F.lit(False)))
    return flag & F.coalesce((sha == want_sha) & (page == 1), F.lit(False))


def counters(gold: DataFrame, actual: DataFrame, provisional: bool = False) -> DataFrame:
    """Counters per category.

    gold: page_id, category, sha, pos, gold_id, text, cell, key_number, numbers; actual: page_id, gold_id,
    text, ord, sha, page, cell, verified, proposed (pages that failed simply have no rows here).
    """
    keys = "page_id", "gold_id"
    g = F.struct(*("category", "sha", "pos", "text", "cell", "key_number", "numbers"))
    a = F.struct(*("text", "ord", "sha", "page", "cell", "verified", "proposed"))
    g, a = gold.select(*keys, g.alias("g")), actual.select(*keys, a.alias("a"))
    both = g.withColumn("a", F.lit(None).cast(a.schema["a"].dataType)).unionByName(a.withColumn("g", F.lit(None).cast(g.schema["g"].dataType)))
    # dealt once by page: pairing, guards and windows below need no more
    each = both.repartition("page_id").groupBy(*keys).agg(F.first("g", True).alias("g"), F.first("a", True).alias("a"), F.count("g").alias("n_gold"), F.count("a").alias("n_actual"))
    rows = each.select(*keys, "g.*", *(F.col(f"a.{c}").alias(f"a_{c}") for c in ("text", "ord", "sha", "page", "cell", "verified", "proposed")), "n_gold", "n_actual")
    want, have = normalize(F.col("text")), F.coalesce(normalize(F.col("a_text")), F.lit(""))
    got, is_cell = F.col("a_text").isNotNull(), F.col("cell").isNotNull()
    key = F.coalesce("key_number", F.lit(False))
    tokens = F.coalesce("numbers", F.array().cast("array<string>"))
    holds = lambda t: F.when(have == normalize(t), True).when(~F.contains(have, normalize(t)), False).otherwise(stands_alone(have, normalize(t)))
    whole = F.size(F.filter(tokens, holds))
    order = Window.partitionBy("page_id").orderBy("pos")
    rows = rows.withColumns({"want": want, "have": have})
    want, have = F.col("want"), F.col("have")
    rows = rows.withColumns({
        "next_ord": F.lead("a_ord").over(order), "has_next": F.lead(F.lit(True)).over(order).isNotNull(),
        "text_ok": got & (want == have), "n_num": key.cast("int") + F.size(tokens), "ok_num": (key & got & (want == have)).cast("int") + F.when(got, whole).otherwise(0),
    })
    rows = rows.select(
        "category", "page_id", "pos", "a_ord", "cell", "a_cell", "text_ok", "n_num", "ok_num", "has_next", F.length("want").alias("n_want"), F.when(want == have, 0).otherwise(F.levenshtein("want", "have")).alias("edits"),
        located(F.col("a_verified"), F.col("a_proposed"), provisional, F.col("a_sha"), F.col("sha"), F.col("a_page")).alias("right_source"), F.coalesce(F.col("a_ord") < F.col("next_ord"), F.lit(False)).alias("rises"),
        ((F.col("n_gold") > 1) | (F.col("n_actual") > 1)).alias("repeats"), ((F.col("n_actual") > 0) & ((F.col("n_gold") == 0) | F.col("page_id").isNull() | F.col("gold_id").isNull())).alias("unknown"),
    )
    rows = materialize(rows, "score-rows")  # read by the guards, by the sums and by both sides of the pairs; texts stay behind
    broken = rows.agg(F.bool_or("repeats").alias("repeats"), F.bool_or("unknown").alias("unknown")).collect()[0]
    if broken.repeats or broken.unknown:
        raise GuardError("page_id, gold_id repeat" if broken.repeats else "unknown page_id, gold_id")
    n = lambda c: F.sum(c.cast("long"))
    blocks = rows.groupBy("category").agg(
        n(F.col("n_want")).alias("characters"), n(F.col("edits")).alias("edits"), F.count("*").alias("blocks"), n(F.col("right_source")).alias("correctSources"),
        n(F.col("n_num")).alias("numbers"), n(F.col("ok_num")).alias("correctNumbers"), n(is_cell).alias("cells"),
        n(is_cell & F.col("text_ok") & F.coalesce(F.col("cell") == F.col("a_cell"), F.lit(False))).alias("correctCells"), n(is_cell & F.col("text_ok")).alias("correctCellTexts"),
        n(F.col("has_next")).alias("orderPairs"), n(F.col("rises")).alias("correctOrderPairs"),
    )
    slim = rows.select("category", "page_id", "pos", "a_ord", "cell", "a_cell")
    pairs = later_pairs(slim, "page_id", "pos", "a_ord", "category").groupBy("category").agg(F.sum("pairs").alias("allOrderPairs"), F.sum("rising").alias("correctAllOrderPairs"))
    cells = slim.filter("cell is not null").repartition("page_id")  # one exchange for both neighbours
    x, y = cells.alias("x"), cells.alias("y")
    same = F.col("x.page_id") == F.col("y.page_id")
    right = (F.col("y.cell.row") == F.col("x.cell.row")) & (F.col("y.cell.col") == F.col("x.cell.col") + F.col("x.cell.colSpan"))
    down = (F.col("y.cell.col") == F.col("x.cell.col")) & (F.col("y.cell.row") == F.col("x.cell.row") + F.col("x.cell.rowSpan"))
    keeps = lambda a, b, c, s: (F.col(f"y.a_cell.{a}") == F.col(f"x.a_cell.{a}")) & (F.col(f"y.a_cell.{b}") == F.col(f"x.a_cell.{b}") + F.col(f"x.a_cell.{s}"))
    sides = [x.join(y, same & where).select(F.col("x.category").alias("category"), F.coalesce(keeps(*names), F.lit(False)).alias("ok")) for where, names in ((right, ("row", "col", "col", "colSpan")), (down, ("col", "row", "row", "rowSpan")))]
    near = sides[0].unionByName(sides[1]).groupBy("category").agg(F.count("*").alias("cellNeighbours"), n(F.col("ok")).alias("correctCellNeighbours"))
    out = blocks.join(pairs, "category", "left").join(near, "category", "left")
    return out.select("category", *(F.coalesce(c, F.lit(0)).alias(c) for c in COUNTERS))


def stands_alone(text: Column, number: Column) -> Column:
    """Whether a normalised text holds a normalised number that no digits, points or commas go on from, nor a per cent sign.

    A number of digits, points and commas is marked and looked for by one pattern for all rows: where two of its
    places overlap, the second one is preceded by such a character.  Any other number needs a pattern of its own.
    """
    marked = F.regexp_like(F.replace(text, number, F.lit("\1")), F.lit("(?<![\\d.,\1])\1(?![\\d.,%\1])"))
    return F.when(number.rlike(r"^\d[\d.,]*$") & ~F.contains(text, F.lit("\1")), marked).otherwise(whole_number(text, number))


def later_pairs(rows: DataFrame, by: str, order: str, value: str, kind: str | None = None) -> DataFrame:
    """Of each group (and kind of the earlier row): pairs of rows in their order, and those whose value rises.

    Rows are streamed from the last to the first, and the values so far are kept sorted, so a row is compared with all
    later ones by one search.  Missing values rise to nothing and from nothing.
    """
    each = rows.select(by, F.col(order).alias("o"), F.col(value).cast("double").alias("v"), (F.col(kind) if kind else F.lit("")).cast("string").alias("kind"), (-F.col(order)).alias("back"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, at, seen, held, waiting, counts = object(), None, 0, [], [], {}
        for frame in frames:
            out = []
            for r in frame.itertuples(index=False):
                if r[0] != now:
                    out += [(now, k, *n) for k, n in counts.items()]
                    now, at, seen, held, waiting, counts = r[0], None, 0, [], [], {}
                if r.o != at:  # rows of the same order are no pairs
                    at = r.o
                    for v in waiting:
                        bisect.insort(held, v)
                    waiting, seen_before = [], seen
                own = counts.setdefault(r.kind, [0, 0])
                own[0] += seen_before
                seen += 1
                if r.v == r.v and r.v is not None:
                    own[1] += len(held) - bisect.bisect_right(held, r.v)
                    waiting.append(r.v)
            yield pd.DataFrame(out, columns=names)
        yield pd.DataFrame([(now, k, *n) for k, n in counts.items()], columns=names)

    names = [by, kind or "kind", "pairs", "rising"]
    schema = T.StructType([each.schema[by], T.StructField(names[1], T.StringType()), T.StructField("pairs", T.LongType()), T.StructField("rising", T.LongType())])
    return in_order(each, [by], ["back"], run, schema)


def ratios(counts: DataFrame) -> DataFrame:
    """The eight ratios of summed counters; null where there is nothing to count."""
    return counts.select("*", *(F.try_divide(F.col(a).cast("double"), F.col(b)).alias(k) for k, (a, b) in RATIOS.items()))


def manifest_problems(manifest: DataFrame, found: DataFrame) -> DataFrame:
    """(page_id, problem) of a manifest (page_id, sha, annotation_sha, split, pilot, reviewed) against what is found (page_id, sha, annotation_sha)."""
    repeats = manifest.groupBy("page_id").agg(F.count("*").alias("n")).filter("n > 1").select("page_id", F.lit("repeats").alias("problem"))
    have = found.select("page_id", F.col("sha").alias("f_sha"), F.col("annotation_sha").alias("f_annotation"), F.lit(True).alias("here"))
    rows = manifest.join(have, "page_id", "left")
    rules = {
        "no source": F.col("here").isNull(), "source changed": F.col("here") & ~F.col("sha").eqNullSafe(F.col("f_sha")), "annotation changed": F.col("here") & ~F.col("annotation_sha").eqNullSafe(F.col("f_annotation")),
        "holdout in pilot": (F.col("split") == "holdout") & F.col("pilot"), "unreviewed": ~F.coalesce("reviewed", F.lit(False)),
    }
    broken = F.array_compact(F.array(*(F.when(F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items())))
    return rows.select("page_id", F.explode(broken).alias("problem")).distinct().unionByName(repeats)


def rising_pairs(rows: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """Rows with ``rising``: whether the value is below that of the next row of its group; false where one is missing."""
    after = F.lead(value).over(Window.partitionBy(*by).orderBy(order))
    return rows.withColumn("rising", F.coalesce(F.col(value) < after, F.lit(False)))


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Different rows that one table alone has, with ``only``: 1 for those of the first, 2 for those of the second.

    Nulls are equal, as in EXCEPT. Both tables' rows are summed up by tasks, move once and meet in one aggregation.
    """
    both = a.select("*", F.lit(1).alias("only")).unionByName(b.select("*", F.lit(2).alias("only")))
    return both.groupBy(*a.columns).agg(F.bit_or("only").alias("only")).filter("only < 3")


def minus(a: DataFrame, b: DataFrame) -> DataFrame:
    """Different rows of the first table that the second hasn't."""
    return differences(a, b).filter("only = 1").drop("only")


def shape_differences(have: DataFrame, want: DataFrame, key: str) -> DataFrame:
    """Keys whose number ``n`` is not the expected one, on either side: key, have, want."""
    both = have.select(key, F.col("n").alias("have")).join(want.select(key, F.col("n").alias("want")), key, "full")
    return both.filter(~F.col("have").eqNullSafe(F.col("want")))


def page_status(pages: DataFrame, results: DataFrame) -> DataFrame:
    """Every selected page with its status, ``missing`` without a result; results of other pages are an error."""
    require_unique(results, "id")
    require_known(results, pages, "id")
    return pages.join(results.select("id", "status"), "id", "left").withColumn("status", F.coalesce("status", F.lit("missing")))


def select_pages(pages: DataFrame, selection: str, runner: bool = False) -> DataFrame:
    """Pages of a pilot or a split; a runner never gets the holdout."""
    if runner and selection == "holdout":
        raise GuardError("the holdout is not for runs")
    return pages.filter(F.col("pilot") if selection == "pilot" else F.col("split") == selection)
