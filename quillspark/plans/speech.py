"""Queries of speaker errors, borders, joined windows and sound activity."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import speech
from .registry import register
from .tables import table

#: Events as segments of three speakers, a second as a millisecond; what was found is shifted, renamed, partly missing and partly another's.
ISLANDS = """SELECT k, s, min(a) AS a, max(b) AS b FROM (SELECT *, sum(n) OVER (PARTITION BY k, s ORDER BY a, b) AS i FROM (
      SELECT *, CASE WHEN a > max(b) OVER (PARTITION BY k, s ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS n FROM {0})) GROUP BY k, s, i"""
SEGMENTS = f"""
    e AS (SELECT user_id AS k, event_id AS id, floor(epoch(ts))::BIGINT AS a, floor(epoch(ts))::BIGINT + (1 + event_id % 50) * 600 AS b FROM events),
    t0 AS (SELECT k, id % 3 AS s, a, b FROM e),
    f0 AS (SELECT k, CASE WHEN id % 17 = 0 THEN id % 2 ELSE (id + 1) % 3 END AS s, a + id % 7 * 60 AS a, b + id % 5 * 60 AS b FROM e WHERE id % 13 <> 0),
    t AS ({ISLANDS.format("t0")}), f AS ({ISLANDS.format("f0")})"""


def _segments(spark, d):
    n = F.col("event_id")
    start = F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")
    e = table(spark, d, "events").select(F.col("user_id").alias("key"), "event_id", start.alias("a"), (start + (1 + n % 50) * 600).alias("b"))
    truth = e.select("key", (n % 3).alias("speaker"), F.col("a").alias("start_ms"), F.col("b").alias("end_ms"))
    speaker = F.when(n % 17 == 0, n % 2).otherwise((n + 1) % 3)
    return truth, e.filter(n % 13 != 0).select("key", speaker.alias("speaker"), (F.col("a") + n % 7 * 60).alias("start_ms"), (F.col("b") + n % 5 * 60).alias("end_ms"))


@register("asr_speaker_errors", f"""
    WITH {SEGMENTS}, o AS (SELECT t.k, t.s, f.s AS o, sum(least(t.b, f.b) - greatest(t.a, f.a)) AS ms FROM t JOIN f ON t.k = f.k AND t.a < f.b AND f.a < t.b GROUP BY ALL),
    m AS (SELECT k, max(ms) AS ms FROM (SELECT k, x, y, z, sum(CASE WHEN o = [x, y, z][s + 1] THEN ms ELSE 0 END) AS ms FROM o, (VALUES (0, 1, 2), (0, 2, 1), (1, 0, 2), (1, 2, 0), (2, 0, 1), (2, 1, 0)) p(x, y, z) GROUP BY ALL) GROUP BY k),
    c AS (SELECT k, p, sum(t) AS t, sum(f) AS f FROM (SELECT k, a AS p, 1 AS t, 0 AS f FROM t UNION ALL SELECT k, b, -1, 0 FROM t UNION ALL SELECT k, a, 0, 1 FROM f UNION ALL SELECT k, b, 0, -1 FROM f) GROUP BY ALL),
    r AS (SELECT k, lead(p) OVER w - p AS lasts, sum(t) OVER w AS t, sum(f) OVER w AS f FROM c WINDOW w AS (PARTITION BY k ORDER BY p)),
    z AS (SELECT k, sum(lasts * t) AS speech, sum(lasts * greatest(t, f)) AS most FROM r WHERE lasts IS NOT NULL GROUP BY k)
    SELECT k AS user_id, speech::BIGINT AS speech_ms, coalesce(ms, 0)::BIGINT AS right_ms, round((most - coalesce(ms, 0))::DOUBLE / nullif(speech, 0), 9) AS der FROM z LEFT JOIN m USING (k)""")
def asr_speaker_errors(spark, d):
    """From the design specification: errors of who spoke when, under each user's best mapping of speakers."""
    return speech.speaker_errors(*_segments(spark, d)).withColumnRenamed("key", "user_id")


@register("asr_boundary_errors", f"""
    WITH {SEGMENTS}, x AS (SELECT k, unnest([a, b]) AS p FROM t), y AS (SELECT k, unnest([a, b]) AS p FROM f), g AS (SELECT x.k, x.p, (SELECT min(abs(x.p - y.p)) FROM y WHERE y.k = x.k) AS gap FROM x)
    SELECT k AS user_id, count(*)::BIGINT AS borders, list_sort(list(gap))[ceil(count(*) * 0.95)::INT]::BIGINT AS within_ms FROM g GROUP BY k""")
def asr_boundary_errors(spark, d):
    """From the design specification: how near the found borders are to 95 per cent of the true ones."""
    return speech.boundary_errors(*_segments(spark, d)).withColumnRenamed("key", "user_id")


@register("asr_joined_windows", """
    WITH w AS (SELECT doc_id, list_transform(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> ''), lambda x, i: x || '_' || i) AS w FROM documents WHERE text IS NOT NULL)
    SELECT doc_id, len(w)::INT AS words, sha256(array_to_string(w, ' ')) AS digest FROM w""")
def asr_joined_windows(spark, d):
    """From the design specification: whole texts from windows of forty words, ten of which the next window repeats."""
    numbered = F.transform(F.filter(F.split("text", r"\s+"), lambda x: x != ""), lambda x, i: F.concat(x, F.lit("_"), (i + 1).cast("string")))
    words = table(spark, d, "documents").filter("text is not null").select("doc_id", numbered.alias("w"))
    windows = words.select("doc_id", "w", F.explode(F.sequence(F.lit(0), F.greatest(F.size("w") - 1, F.lit(0)), F.lit(30))).alias("no"))
    joined = speech.joined_windows(windows.select(F.col("doc_id").alias("key"), "no", F.array_join(F.slice("w", F.col("no") + 1, F.lit(40)), " ").alias("text")))
    return joined.select(F.col("key").alias("doc_id"), F.size(F.filter(F.split("text", " "), lambda x: x != "")).alias("words"), F.sha2("text", 256).alias("digest"))


@register("asr_activity", """
    WITH l AS (SELECT user_id, event_id % 10 AS level, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) * 10 AS p FROM events),
    n AS (SELECT user_id, p, CASE WHEN p - lag(p) OVER w <= 30 THEN 0 ELSE 1 END AS new FROM l WHERE level >= 4 WINDOW w AS (PARTITION BY user_id ORDER BY p)),
    i AS (SELECT user_id, min(p) AS a, max(p) + 10 AS b FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY p) AS k FROM n) GROUP BY user_id, k)
    SELECT user_id, a::BIGINT AS start_ms, b::BIGINT AS end_ms FROM i WHERE b - a >= 40""")
def asr_activity(spark, d):
    """From the design specification: segments of sound, with events as frames of ten milliseconds."""
    no = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    levels = table(spark, d, "events").select(F.col("user_id").alias("key"), no.alias("no"), (F.col("event_id") % 10).alias("level"))
    return speech.active(levels, 4, gap_ms=20, least_ms=40).withColumnRenamed("key", "user_id")
