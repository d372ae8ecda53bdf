"""Speech: who spoke when, against a truth, and transcripts of overlapping windows (from the design specification).

Segments are rows (key, speaker, start_ms, end_ms); those that don't last are left out, and a speaker's segments that
meet count once.  Time is swept in elementary intervals: between two neighbouring borders nothing changes.

Rows: null speakers, starts or ends leave a segment out; a key without truth has no rate (null); empty
tables give empty tables; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ordered import in_order

#: Milliseconds of the pieces in which segments meet: long ones are cut, so no join is over all pairs of a key.
PIECE = 10_000


def merged(segments: DataFrame, key: str = "key") -> DataFrame:
    """A speaker's segments without overlaps."""
    own = segments.filter("end_ms > start_ms").select(key, "speaker", "start_ms", "end_ms").na.drop()
    w = Window.partitionBy(key, "speaker").orderBy("start_ms", "end_ms")
    reach = F.max("end_ms").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = own.withColumn("island", F.sum((F.coalesce(F.col("start_ms") > reach, F.lit(True))).cast("int")).over(w))
    return marked.groupBy(key, "speaker", "island").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms")).drop("island")


def _pieces(segments: DataFrame) -> DataFrame:
    each = segments.withColumn("piece", F.explode(F.sequence(F.floor(F.col("start_ms") / PIECE), F.floor((F.col("end_ms") - 1) / PIECE))))
    return each.withColumns({"start_ms": F.greatest("start_ms", F.col("piece") * PIECE), "end_ms": F.least("end_ms", (F.col("piece") + 1) * PIECE)})


def overlaps(truth: DataFrame, found: DataFrame, key: str = "key") -> DataFrame:
    """Milliseconds in which two speakers of both sides speak: key, speaker, other, ms."""
    a = _pieces(truth)
    b = _pieces(found).select(key, "piece", F.col("speaker").alias("other"), F.col("start_ms").alias("o_start"), F.col("end_ms").alias("o_end"))
    met = a.join(b, [key, "piece"]).withColumn("ms", F.least("end_ms", "o_end") - F.greatest("start_ms", "o_start")).filter("ms > 0")
    return met.groupBy(key, "speaker", "other").agg(F.sum("ms").alias("ms"))


def best_mapping(gain: np.ndarray) -> int:
    """Largest sum of a matrix with each row and each column used once at most: shortest augmenting paths with potentials."""
    if not gain.size:
        return 0
    if gain.shape[0] > gain.shape[1]:
        gain = gain.T
    n, m = gain.shape
    cost = gain.max() - gain
    row_at = np.full(m, -1)  # row of each column
    u, v = np.zeros(n), np.zeros(m)
    for i in range(n):
        least, before, seen = np.full(m, np.inf), np.full(m, -1), np.zeros(m, bool)
        row, column, reached = i, -1, 0.0
        while True:
            way = reached + cost[row] - u[row] - v
            better = ~seen & (way < least)
            least[better], before[better] = way[better], column
            column = int(np.argmin(np.where(seen, np.inf, least)))
            seen[column], reached = True, least[column]
            if row_at[column] < 0:
                break
            row = row_at[column]
        u[i] += reached
        for c in np.flatnonzero(seen):
            if row_at[c] >= 0:
                u[row_at[c]] += reached - least[c]
            v[c] -= reached - least[c]
        while column >= 0:
            c = before[column]
            row_at[column] = row_at[c] if c >= 0 else i
            column = int(c)
    return int(gain[row_at[row_at >= 0], np.flatnonzero(row_at >= 0)].sum())


def _swept(truth: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """Of each key: milliseconds of truth by speaker, and of the more numerous side, from running counts over all borders."""
    step = lambda df, side, at, by: df.select(key, F.col(at).alias("ms"), F.lit(by if side == "t" else 0).alias("t"), F.lit(by if side == "f" else 0).alias("f"))
    borders = step(truth, "t", "start_ms", 1).unionByName(step(truth, "t", "end_ms", -1)).unionByName(step(found, "f", "start_ms", 1)).unionByName(step(found, "f", "end_ms", -1))
    borders = borders.groupBy(key, "ms").agg(F.sum("t").alias("t"), F.sum("f").alias("f"))
    w = Window.partitionBy(key).orderBy("ms")
    runs = borders.select(key, (F.lead("ms").over(w) - F.col("ms")).alias("lasts"), F.sum("t").over(w).alias("t"), F.sum("f").over(w).alias("f")).filter("lasts is not null")
    return runs.groupBy(key).agg(F.sum(F.col("lasts") * F.col("t")).alias("speech_ms"), F.sum(F.col("lasts") * F.greatest("t", "f")).alias("most_ms"))


def speaker_errors(truth: DataFrame, found: DataFrame, key: str = "key") -> DataFrame:
    """Of each key: speech_ms (truth), right_ms under the best mapping of speakers, and der, the share of speech that is missed, added or another's."""
    truth, found = merged(truth, key), merged(found, key)

    @F.pandas_udf("long")
    def mapped(rows: pd.Series) -> pd.Series:
        out = []
        for own in rows:  # pairs of speakers of one key
            a, b = ({x: i for i, x in enumerate(sorted({r[n] for r in own}))} for n in ("speaker", "other"))
            gain = np.zeros((len(a), len(b)))
            for r in own:
                gain[a[r["speaker"]], b[r["other"]]] = r["ms"]
            out.append(best_mapping(gain))
        return pd.Series(out)

    pairs = overlaps(truth, found, key).groupBy(key).agg(F.collect_list(F.struct("speaker", "other", "ms")).alias("pairs"))
    right = pairs.select(key, mapped("pairs").alias("right_ms"))
    out = _swept(truth, found, key).join(right, key, "left").withColumn("right_ms", F.coalesce("right_ms", F.lit(0)))
    return out.select(key, "speech_ms", "right_ms", F.round(F.try_divide((F.col("most_ms") - F.col("right_ms")).cast("double"), F.col("speech_ms")), 9).alias("der"))


def boundary_errors(truth: DataFrame, found: DataFrame, key: str = "key", share: float = 0.95) -> DataFrame:
    """Of each key: borders of the truth, and the distance in ms to the nearest found border that ``share`` of them keep within (null without found ones).

    Distances are counted by value first, so the quantile is of as many rows as there are different distances.
    """
    ends = lambda df, n: df.select(key, F.explode(F.array("start_ms", "end_ms")).alias("ms"), F.lit(n).alias("found"))
    rows = ends(merged(truth, key), 0).unionByName(ends(merged(found, key), 1))
    at = F.when(F.col("found") == 1, F.col("ms"))
    w = Window.partitionBy(key).orderBy("ms")
    before = F.last(at, ignorenulls=True).over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    after = F.last(at, ignorenulls=True).over(Window.partitionBy(key).orderBy(F.desc("ms")).rangeBetween(Window.unboundedPreceding, Window.currentRow))
    gaps = rows.withColumns({"b": before, "a": after}).filter("found = 0").select(key, F.least(F.col("ms") - F.col("b"), F.col("a") - F.col("ms")).alias("gap"))
    counted = gaps.groupBy(key, "gap").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy(key))
    run = F.sum("n").over(Window.partitionBy(key).orderBy(F.col("gap").asc_nulls_last()))
    held = counted.withColumns({"total": total, "run": run}).filter(F.col("run") >= F.ceil(F.col("total") * share))
    return held.groupBy(key).agg(F.max("total").alias("borders"), F.min(F.struct(F.col("run"), F.col("gap"))).alias("q")).select(key, "borders", F.col("q.gap").alias("within_ms"))


def joined_windows(windows: DataFrame, least: int = 2, key: str = "key") -> DataFrame:
    """Transcripts of overlapping windows (key, no, text) in one: key and text.

    The words that a window begins with and the text so far ends with stand once: the longest overlap of ``least``
    words or more, or of one word if a window has no more.  Windows are streamed in their order; of the text so far a
    window's length of words is compared, by the borders of one string matched against the other.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, words = None, None
        for frame in frames:
            out = []
            for r in frame.itertuples(index=False):
                if words is None or r[0] != now:
                    out += [(now, " ".join(words))] if words is not None else []
                    now, words = r[0], []
                new = r[2].split()
                words += new[overlap(words, new, least) :]
            yield pd.DataFrame(out, columns=[key, "text"])
        if words is not None:
            yield pd.DataFrame([(now, " ".join(words))], columns=[key, "text"])

    rows = windows.select(key, "no", F.coalesce("text", F.lit("")).alias("text"))
    return in_order(rows, [key], ["no"], run, f"{key} {rows.schema[key].dataType.simpleString()}, text string")


def overlap(before: list[str], new: list[str], least: int) -> int:
    """Most words that ``before`` ends with and ``new`` begins with, in linear time; 0 below ``least`` unless a side is no longer."""
    tail = before[len(before) - min(len(before), len(new)) :]
    mark = [*new, None, *tail]
    border = [0] * len(mark)
    for i in range(1, len(mark)):
        k = border[i - 1]
        while k and mark[i] != mark[k]:
            k = border[k - 1]
        border[i] = k + (mark[i] == mark[k])
    n = border[-1] if tail else 0
    return n if n >= min(least, len(new), len(before)) else 0


def active(levels: DataFrame, loud: float, gap_ms: int = 300, least_ms: int = 200, frame_ms: int = 10, key: str = "key") -> DataFrame:
    """Segments of sound from frames (key, no, level): those of ``loud`` or more, gaps up to ``gap_ms`` closed, shorter ones than ``least_ms`` left out."""
    own = levels.filter(F.col("level") >= loud).select(key, (F.col("no") * frame_ms).cast("long").alias("at"))
    w = Window.partitionBy(key).orderBy("at")
    new = F.coalesce(F.col("at") - F.lag("at").over(w) > gap_ms + frame_ms, F.lit(True))
    runs = own.withColumn("island", F.sum(new.cast("int")).over(w)).groupBy(key, "island").agg(F.min("at").alias("start_ms"), (F.max("at") + frame_ms).alias("end_ms"))
    return runs.filter(F.col("end_ms") - F.col("start_ms") >= least_ms).select(key, "start_ms", "end_ms")
