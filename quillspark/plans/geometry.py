"""Queries over boxes and numbers; boxes are made from line items so that both engines compute them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import text as t
from .registry import register
from .tables import sql_literal, table

BOXES = """
    WITH b AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, (l_quantity / 100)::DOUBLE AS a, (l_discount * 2)::DOUBLE AS b,
               (l_quantity / 100 + 0.2 + l_tax)::DOUBLE AS c, (l_discount * 2 + 0.3)::DOUBLE AS d, (l_tax * 3)::DOUBLE AS e, (l_discount)::DOUBLE AS f, (l_tax * 3 + 0.5)::DOUBLE AS g, (l_discount + 0.4)::DOUBLE AS h FROM lineitem)"""


def boxes(spark, d):
    q, disc, tax = F.col("l_quantity"), F.col("l_discount"), F.col("l_tax")
    first = F.array(q / 100, disc * 2, q / 100 + 0.2 + tax, disc * 2 + 0.3)
    second = F.array(tax * 3, disc, tax * 3 + 0.5, disc + 0.4)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", first.alias("x"), second.alias("y"))


CONTAINED = "coalesce(greatest(0, least(c, g) - greatest(a, e)) * greatest(0, least(d, h) - greatest(b, f)) / nullif((c - a) * (d - b), 0), 0)"


@register("geo_contained", f"{BOXES} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round({CONTAINED}, 6) AS share FROM b")
def geo_contained(spark, d):
    return boxes(spark, d).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(g.contained(F.col("x"), F.col("y")), 6).alias("share"))


@register("geo_area", f"{BOXES} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round((c - a) * (d - b), 6) AS area, round(greatest(0, e - a) * greatest(0, f - b), 6) AS between_corners FROM b")
def geo_area(spark, d):
    """Areas of boxes, and of those from one's first corner to another's, which have none where they are inverted."""
    x, y = F.col("x"), F.col("y")
    between = F.array(x[0], x[1], y[0], y[1])
    return boxes(spark, d).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(g.area(x), 6).alias("area"), F.round(g.area(between), 6).alias("between_corners"))


@register("geo_location_ok", f"""{BOXES} SELECT l_orderkey, count(*)::BIGINT AS n, count(*) FILTER ({CONTAINED} >= 0.5 AND (l_linenumber % 2 = 0 OR (g - e) * (h - f) <= 12 * (c - a) * (d - b)))::BIGINT AS located FROM b GROUP BY 1""")
def geo_location_ok(spark, d):
    ok = g.located(F.col("x"), F.col("y"), F.col("l_linenumber") % 2 == 0, g.area(F.col("x")))
    return boxes(spark, d).groupBy("l_orderkey").agg(F.count("*").alias("n"), F.count_if(ok).alias("located"))


@register("geo_valid_box", f"{BOXES} SELECT l_linenumber, count(*) FILTER (0 <= a AND a < c AND c <= 1 AND 0 <= b AND b < d AND d <= 1)::BIGINT AS good, count(*)::BIGINT AS n FROM b GROUP BY 1")
def geo_valid_box(spark, d):
    return boxes(spark, d).groupBy("l_linenumber").agg(F.count_if(g.valid(F.col("x"))).alias("good"), F.count("*").alias("n"))


@register("ag_union_box", f"{BOXES} SELECT l_orderkey, round(min(a), 6) AS l, round(min(b), 6) AS t, round(max(c), 6) AS r, round(max(d), 6) AS bo FROM b GROUP BY 1")
def ag_union_box(spark, d):
    a, b, c, e = g.parts(F.col("x"))
    return boxes(spark, d).groupBy("l_orderkey").agg(F.round(F.min(a), 6).alias("l"), F.round(F.min(b), 6).alias("t"), F.round(F.max(c), 6).alias("r"), F.round(F.max(e), 6).alias("bo"))


@register("geo_box", f"""{BOXES} SELECT l_orderkey, round(max(greatest(0, a * 900 / 1000)), 6) AS l, round(min(least(1, c * 900 / 800)), 6) AS r FROM b GROUP BY 1""")
def geo_box(spark, d):
    x = F.col("x")
    a, b, c, e = g.parts(x)
    box = g.unit_box(a * 900, b * 900, c * 900, e * 900, F.lit(1000.0), F.lit(1000.0))
    wide = g.unit_box(a * 900, b * 900, c * 900, e * 900, F.lit(800.0), F.lit(800.0))
    return boxes(spark, d).groupBy("l_orderkey").agg(F.round(F.max(F.element_at(box, 1)), 6).alias("l"), F.round(F.min(F.element_at(wide, 3)), 6).alias("r"))


@register("geo_flip", f"{BOXES} SELECT l_orderkey, round(sum(CASE WHEN l_linenumber % 2 = 0 THEN 2 - d ELSE b END), 4) AS top, round(sum(CASE WHEN l_linenumber % 2 = 0 THEN 2 - b ELSE d END), 4) AS bottom FROM b GROUP BY 1")
def geo_flip(spark, d):
    even = F.col("l_linenumber") % 2 == 0
    _, b, _, e = g.parts(F.col("x"))
    top, bottom = g.flip(F.when(even, e).otherwise(b), F.when(even, b).otherwise(e), F.lit(2.0), F.when(even, "BOTTOMLEFT").otherwise("TOPLEFT"))
    return boxes(spark, d).groupBy("l_orderkey").agg(F.round(F.sum(top), 4).alias("top"), F.round(F.sum(bottom), 4).alias("bottom"))


@register("geo_gold_box", f"{BOXES} SELECT l_orderkey, round(sum(CASE WHEN l_suppkey % 3 = 0 THEN e WHEN l_linenumber % 2 = 0 THEN a END), 4) AS l, count(CASE WHEN l_suppkey % 3 = 0 OR l_linenumber % 2 = 0 THEN 1 END)::BIGINT AS n FROM b GROUP BY 1")
def geo_gold_box(spark, d):
    box = g.gold_box(F.when(F.col("l_suppkey") % 3 == 0, F.col("y")), F.col("x"), F.col("l_linenumber") % 2)
    return boxes(spark, d).groupBy("l_orderkey").agg(F.round(F.sum(F.element_at(box, 1)), 4).alias("l"), F.count(box).alias("n"))


@register("geo_rotate", f"""{BOXES},
    p AS (SELECT *, radians(l_linenumber) AS r FROM b),
    k AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, unnest([
        {{'x': (a - 0.5) * cos(r) + (b - 0.5) * 1.25 * sin(r) + 0.5, 'y': ((b - 0.5) * 1.25 * cos(r) - (a - 0.5) * sin(r)) / 1.25 + 0.5}},
        {{'x': (c - 0.5) * cos(r) + (b - 0.5) * 1.25 * sin(r) + 0.5, 'y': ((b - 0.5) * 1.25 * cos(r) - (c - 0.5) * sin(r)) / 1.25 + 0.5}},
        {{'x': (c - 0.5) * cos(r) + (d - 0.5) * 1.25 * sin(r) + 0.5, 'y': ((d - 0.5) * 1.25 * cos(r) - (c - 0.5) * sin(r)) / 1.25 + 0.5}},
        {{'x': (a - 0.5) * cos(r) + (d - 0.5) * 1.25 * sin(r) + 0.5, 'y': ((d - 0.5) * 1.25 * cos(r) - (a - 0.5) * sin(r)) / 1.25 + 0.5}}]) AS q FROM p)
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(greatest(0, min(q.x)), 6) AS l, round(least(1, max(q.y)), 6) AS bo FROM k GROUP BY ALL""")
def geo_rotate(spark, d):
    box = g.rotated(F.col("x"), F.col("l_linenumber"), F.lit(1.0), F.lit(1.25))
    keys = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return boxes(spark, d).groupBy(*keys).agg(F.round(F.min(F.element_at(box, 1)), 6).alias("l"), F.round(F.max(F.element_at(box, 4)), 6).alias("bo"))


@register("num_ms", "SELECT event_id, round_even(value * 1000 / 16, 0)::BIGINT AS ms FROM events")
def num_ms(spark, d):
    return table(spark, d, "events").select("event_id", F.bround(F.col("value") * 1000 / 16).cast("bigint").alias("ms"))


@register("num_clamp", "SELECT event_id, round(least(60, greatest(5, value)), 6) AS clamped, least(1024, greatest(64, 20 * ceil(value)))::BIGINT AS tokens FROM events")
def num_clamp(spark, d):
    v = F.col("value")
    return table(spark, d, "events").select("event_id", F.round(F.least(F.lit(60.0), F.greatest(F.lit(5.0), v)), 6).alias("clamped"), F.least(F.lit(1024), F.greatest(F.lit(64), 20 * F.ceil(v))).cast("bigint").alias("tokens"))


@register("num_eta", """
    WITH f AS (SELECT event_id, value, least(1, greatest(0, (event_id % 101) / 100.0::DOUBLE)) AS f FROM events)
    SELECT event_id, round(CASE WHEN f >= 0.03 AND f < 1 THEN value / f * (1 - f) ELSE -1 END, 6) AS eta FROM f""")
def num_eta(spark, d):
    f = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("event_id") % 101 / F.lit(100.0)))
    return table(spark, d, "events").select("event_id", F.round(F.when((f >= 0.03) & (f < 1), F.col("value") / f * (1 - f)).otherwise(-1.0), 6).alias("eta"))


@register("num_parse_default", "SELECT event_id, coalesce(TRY_CAST(CASE event_id % 3 WHEN 0 THEN event_id::VARCHAR WHEN 1 THEN '' ELSE 'x' END AS INT), 7)::INT AS n FROM events")
def num_parse_default(spark, d):
    raw = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit(" "), F.col("event_id").cast("string"))).when(F.col("event_id") % 3 == 1, "").otherwise("x")
    return table(spark, d, "events").select("event_id", F.coalesce(F.trim(raw).try_cast("int"), F.lit(7)).alias("n"))


@register("hash_sha256", "SELECT doc_id, sha256(text) AS digest FROM documents")
def hash_sha256(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))


@register("aud_split", """
    WITH s AS (SELECT doc_id, text, unnest(range(0, greatest(length(text), 1), 448)) AS a FROM documents)
    SELECT doc_id, (a // 448)::INT AS chunk, length(substr(text, (a + 1)::BIGINT, 448))::INT AS n, sha256(substr(text, (a + 1)::BIGINT, 448)) AS digest FROM s""")
def aud_split(spark, d):
    """Fixed windows of 28 units of 16; the last is short."""
    at = table(spark, d, "documents").select("doc_id", "text", F.explode(F.sequence(F.lit(0), F.greatest(F.length("text") - 1, F.lit(0)), F.lit(448))).alias("a"))
    own = F.substring("text", F.col("a") + 1, F.lit(448))
    return at.select("doc_id", F.floor(F.col("a") / 448).cast("int").alias("chunk"), F.length(own).alias("n"), F.sha2(own, 256).alias("digest"))


@register("aud_window_sec", "SELECT event_id, CASE WHEN value > 50 THEN value WHEN event_id % 2 = 0 THEN event_id / 16000.0::DOUBLE ELSE 30 END::DOUBLE AS seconds FROM events")
def aud_window_sec(spark, d):
    length, samples = F.when(F.col("value") > 50, F.col("value")), F.when(F.col("event_id") % 2 == 0, F.col("event_id"))
    return table(spark, d, "events").select("event_id", F.coalesce(length, samples / F.lit(16000.0), F.lit(30.0)).alias("seconds"))


MAGIC = [("52494646000000005741564500", "wav"), ("664C61430000000000000000", "flac"), ("4F6767530000000000000000", "ogg"), ("1A45DFA30000000000000000", "webm"), ("00000018667479704D344100", "m4a"), ("494433040000000000000000", "mp3"), ("FFFB90000000000000000000", "mp3"), ("63616666000100000000000000", "caf"), ("2321414D520A000000000000", "amr"), ("68656C6C6F20776F726C6421", "unknown"), ("FFFB", "unknown")]


@register("aud_sniff", f"SELECT p_partkey, CASE WHEN p_size % 13 = 0 THEN 'unknown' ELSE {sql_literal([k for _, k in MAGIC])}[p_partkey % {len(MAGIC)} + 1] END AS kind FROM part")
def aud_sniff(spark, d):
    """Files of all formats by their first bytes; some end before the twelfth."""
    head = F.get(F.array(*(F.lit(m) for m, _ in MAGIC)), (F.col("p_partkey") % len(MAGIC)).cast("int"))
    data = F.when(F.col("p_size") % 13 == 0, F.left(head, F.lit(8))).otherwise(F.concat(head, F.when(F.length(head) > 4, F.repeat(F.lit("00"), F.col("p_size"))).otherwise("")))
    return table(spark, d, "part").select("p_partkey", t.sniff(F.unhex(data)).alias("kind"))
