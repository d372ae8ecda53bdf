"""Queries over joins, guards, scores and windows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.text import absent_share
from ..operators import relations, scoring
from ..operators.manifests import pick_files
from ..operators.spans import assign
from ..sources import documents
from ..sources.media import html_cells
from ..storage import materialize
from .registry import register
from .tables import table

def _gold(spark, d):
    """Line items with a place each as gold blocks: the pair (order, line) is the row of a table of parts."""
    return table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("part"), F.min("l_suppkey").alias("supp"), F.min("l_returnflag").alias("category"))


GOLD = "WITH g AS (SELECT l_orderkey, l_linenumber, min(l_partkey) AS part, min(l_suppkey) AS supp, min(l_returnflag) AS category FROM lineitem GROUP BY 1, 2)"


@register("score_metrics", """
    WITH r AS (SELECT d.lang, length(d.text) AS n, l.quality, l.toxic, l.doc_id IS NOT NULL AS found FROM documents d LEFT JOIN labels l USING (doc_id))
    SELECT lang, count(*)::BIGINT AS blocks, count(*) FILTER (found)::BIGINT AS found, count(*) FILTER (quality = 1)::BIGINT AS good, sum(CASE WHEN found THEN 0 ELSE n END)::BIGINT AS edits,
           round(count(*) FILTER (quality = 1)::DOUBLE / count(*), 6) AS good_ratio, round(sum(CASE WHEN found THEN 0 ELSE n END)::DOUBLE / sum(n), 6) AS error_rate FROM r GROUP BY lang""")
def score_metrics(spark, d):
    labels = table(spark, d, "labels").select("doc_id", "quality", F.lit(True).alias("has"))
    r = table(spark, d, "documents").join(labels, "doc_id", "left")
    edits = F.sum(F.when(F.col("has"), 0).otherwise(F.length("text")))
    good = F.count_if(F.col("quality") == 1)
    return r.groupBy("lang").agg(
        F.count("*").alias("blocks"), F.count("has").alias("found"), good.alias("good"), edits.alias("edits"),
        F.round(F.try_divide(good.cast("double"), F.count("*")), 6).alias("good_ratio"), F.round(F.try_divide(edits.cast("double"), F.sum(F.length("text"))), 6).alias("error_rate"))


COUNTED = """
    l AS (SELECT l_orderkey, l_linenumber, min(l_partkey) AS part, min(l_returnflag) AS category FROM lineitem GROUP BY 1, 2),
    r AS (SELECT *, part % 5 <> 0 AS got, part % 3 <> 0 AS same, CASE WHEN part % 7 = 0 THEN 100 - l_linenumber ELSE l_linenumber END AS ord, length(part::VARCHAR) AS chars FROM l),
    n AS (SELECT *, lead(CASE WHEN got THEN ord END) OVER w AS no, lead(1) OVER w AS nx FROM r WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber)),
    p AS (SELECT x.category, count(*) AS pairs, count(*) FILTER (x.got AND y.got AND x.ord < y.ord) AS ok FROM r x JOIN r y ON x.l_orderkey = y.l_orderkey AND x.l_linenumber < y.l_linenumber GROUP BY 1),
    s AS (SELECT x.category, count(*) AS sides, count(*) FILTER (x.got AND y.got AND (x.part % 4 = 0) = (y.part % 4 = 0)) AS kept FROM r x JOIN r y ON x.l_orderkey = y.l_orderkey AND y.l_linenumber = x.l_linenumber + 1 GROUP BY 1),
    c AS (SELECT category, sum(chars)::BIGINT AS characters, sum(CASE WHEN got AND same THEN 0 ELSE chars END)::BIGINT AS edits, count(*)::BIGINT AS blocks, count(*) FILTER (got AND part % 2 = 0)::BIGINT AS "correctSources",
          sum(1 + (part % 11 = 0)::INT)::BIGINT AS numbers, sum(CASE WHEN got AND same THEN 1 + (part % 11 = 0)::INT ELSE 0 END)::BIGINT AS "correctNumbers",
          count(*)::BIGINT AS cells, count(*) FILTER (got AND same AND part % 4 <> 0)::BIGINT AS "correctCells", count(*) FILTER (got AND same)::BIGINT AS "correctCellTexts",
          coalesce(max(s.sides), 0)::BIGINT AS "cellNeighbours", coalesce(max(s.kept), 0)::BIGINT AS "correctCellNeighbours", count(nx)::BIGINT AS "orderPairs", count(*) FILTER (got AND ord < no)::BIGINT AS "correctOrderPairs",
          coalesce(max(p.pairs), 0)::BIGINT AS "allOrderPairs", coalesce(max(p.ok), 0)::BIGINT AS "correctAllOrderPairs" FROM n LEFT JOIN p USING (category) LEFT JOIN s USING (category) GROUP BY category)"""
RATIO_SQL = ", ".join(f'round("{a}"::DOUBLE / nullif("{b}", 0), 6) AS "{k}"' for k, (a, b) in scoring.RATIOS.items())


def _counted(spark, d):
    """All 15 counters over all orders: lines as table cells, some lost, some misread, moved or out of order."""
    rows = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("part"), F.min("l_returnflag").alias("category"))
    page, part, line = F.col("l_orderkey").cast("string"), F.col("part"), F.col("l_linenumber")
    cell = lambda shift: F.struct(line.alias("row"), (F.lit(1) + shift).cast("int").alias("col"), F.lit(1).alias("rowSpan"), F.lit(1).alias("colSpan"))
    name, text = line.cast("string"), part.cast("string")
    gold = rows.select(page.alias("page_id"), "category", F.lit("h").alias("sha"), line.alias("pos"), name.alias("gold_id"), text.alias("text"), cell(F.lit(0)).alias("cell"), (part % 11 == 0).alias("key_number"), F.array(text).alias("numbers"))
    actual = rows.filter("part % 5 <> 0").select(
        page.alias("page_id"), name.alias("gold_id"), F.when(part % 3 != 0, text).otherwise("x").alias("text"), F.when(part % 7 == 0, 100 - line).otherwise(line).cast("bigint").alias("ord"), F.lit("h").alias("sha"), F.lit(1).alias("page"),
        cell(F.when(part % 4 == 0, 1).otherwise(0)).alias("cell"), (part % 2 == 0).alias("verified"), F.lit(None).cast("boolean").alias("proposed"))
    return scoring.counters(gold, actual)


@register("ag_counts", f"WITH {COUNTED} SELECT * FROM c")
def ag_counts(spark, d):
    return _counted(spark, d)


@register("ag_metrics", f"WITH {COUNTED} SELECT category, {RATIO_SQL} FROM c")
def ag_metrics(spark, d):
    return scoring.ratios(_counted(spark, d)).select("category", *(F.round(k, 6).alias(k) for k in scoring.RATIOS))


def _aligned(spark, d):
    """Gold lines with a category and engine blocks of all orders.

    A line's text is a digest in letters of its own; a fifth of the lines is lost and a third of the others
    misread at the end.  Even orders come as one block that holds the lines in a wrong order, odd ones as
    cells, some a column off and some with a box elsewhere.
    """
    rows = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("part"), F.min("l_returnflag").alias("category"))
    rows = materialize(rows, "aligned-lines")  # four short columns that gold and engine blocks are made from, each more than once
    line, part, odd = F.col("l_linenumber"), F.col("part"), F.col("l_orderkey") % 2 == 1
    letters = [F.translate("digest", "0123456789abcdef", "".join(chr(0x4E00 + 16 * n + i) for i in range(16))) for n in range(1, 8)]
    rows = rows.withColumn("digest", F.md5(F.concat_ws("-", "l_orderkey", "l_linenumber").cast("binary"))).withColumn("text", F.coalesce(*(F.when(line == n, x) for n, x in enumerate(letters, 1))))
    rows = rows.withColumn("read", F.when(part % 3 == 0, F.concat(F.left("text", F.lit(28)), F.lit("XXXX"))).otherwise(F.col("text"))).withColumn("ord", F.when(part % 7 == 0, 100 - line).otherwise(line))
    box = F.array(F.lit(0.0), (line - 1) / F.lit(10.0), F.lit(1.0), line / F.lit(10.0))
    cell = lambda col: F.when(odd, F.struct(line.cast("int").alias("row"), F.lit(col).cast("int").alias("col") if isinstance(col, int) else col.alias("col"), F.lit(1).alias("rowSpan"), F.lit(1).alias("colSpan")))
    page = F.col("l_orderkey").cast("string")
    gold = rows.select(page.alias("page_id"), line.alias("pos"), line.cast("string").alias("gold_id"), "text", box.alias("box"), cell(1).alias("cell"), "category", F.lit("h").alias("sha"), (part % 11 == 0).alias("key_number"), F.array().cast("array<string>").alias("numbers"))
    kept = rows.filter("part % 5 <> 0")
    elsewhere = F.array(F.lit(0.0), F.lit(0.95), F.lit(0.1), F.lit(1.0))
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("ord")) - 1
    cells = kept.filter("l_orderkey % 2 = 1").select(page.alias("page_id"), place.alias("idx"), F.col("read").alias("text"), F.when(part % 2 == 0, box).otherwise(elsewhere).alias("box"), cell((F.lit(1) + (part % 4 == 0).cast("int"))).alias("cell"), F.concat(F.lit("c"), line).alias("engine_ref"))
    whole = kept.filter("l_orderkey % 2 = 0").groupBy(page.alias("page_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "read"))), lambda x: x["read"]), " ").alias("text"))
    merged = whole.select("page_id", F.lit(0).alias("idx"), "text", F.array(*map(F.lit, (0.0, 0.0, 1.0, 1.0))).alias("box"), F.lit(None).cast(cells.schema["cell"].dataType).alias("cell"), F.lit("b0").alias("engine_ref"))
    return gold, cells.unionByName(merged)


@register("score_report", f"""
    WITH l AS (SELECT l_orderkey, l_linenumber, min(l_partkey) AS part, min(l_returnflag) AS category FROM lineitem GROUP BY 1, 2),
    r AS (SELECT *, part % 5 <> 0 AS got, part % 3 <> 0 AS same, l_orderkey % 2 = 1 AS cell, CASE WHEN part % 7 = 0 THEN 100 - l_linenumber ELSE l_linenumber END AS ord FROM l),
    n AS (SELECT *, lead(CASE WHEN got THEN ord END) OVER w AS no, lead(1) OVER w AS nx FROM r WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber)),
    p AS (SELECT x.category, count(*) AS pairs, count(*) FILTER (x.got AND y.got AND x.ord < y.ord) AS ok FROM r x JOIN r y ON x.l_orderkey = y.l_orderkey AND x.l_linenumber < y.l_linenumber GROUP BY 1),
    s AS (SELECT x.category, count(*) AS sides, count(*) FILTER (x.got AND y.got AND (x.part % 4 = 0) = (y.part % 4 = 0)) AS kept FROM r x JOIN r y ON x.l_orderkey = y.l_orderkey AND y.l_linenumber = x.l_linenumber + 1 WHERE x.cell GROUP BY 1),
    c AS (SELECT category, (32 * count(*))::BIGINT AS characters, sum(CASE WHEN NOT got THEN 32 WHEN same THEN 0 ELSE 4 END)::BIGINT AS edits, count(*)::BIGINT AS blocks, count(*) FILTER (got AND (NOT cell OR part % 2 = 0))::BIGINT AS "correctSources",
          count(*) FILTER (part % 11 = 0)::BIGINT AS numbers, count(*) FILTER (got AND same AND part % 11 = 0)::BIGINT AS "correctNumbers",
          count(*) FILTER (cell)::BIGINT AS cells, count(*) FILTER (cell AND got AND same AND part % 4 <> 0)::BIGINT AS "correctCells", count(*) FILTER (cell AND got AND same)::BIGINT AS "correctCellTexts",
          coalesce(max(s.sides), 0)::BIGINT AS "cellNeighbours", coalesce(max(s.kept), 0)::BIGINT AS "correctCellNeighbours", count(nx)::BIGINT AS "orderPairs", count(*) FILTER (got AND ord < no)::BIGINT AS "correctOrderPairs",
          coalesce(max(p.pairs), 0)::BIGINT AS "allOrderPairs", coalesce(max(p.ok), 0)::BIGINT AS "correctAllOrderPairs" FROM n LEFT JOIN p USING (category) LEFT JOIN s USING (category) GROUP BY category)
    SELECT c.* REPLACE (characters AS characters), {RATIO_SQL} FROM c""")
def score_report(spark, d):
    """Engine blocks through assignment, counters and ratios to the report by category."""
    gold, engine = _aligned(spark, d)
    found = assign(gold, engine).filter("status = 'proposed'")
    actual = found.select("page_id", "gold_id", "text", "ord", F.lit("h").alias("sha"), F.lit(1).alias("page"), "cell", F.lit(None).cast("boolean").alias("verified"), F.col("located").alias("proposed"))
    report = scoring.ratios(scoring.counters(gold, actual, provisional=True))
    return report.select("category", *scoring.COUNTERS, *(F.round(k, 6).alias(k) for k in scoring.RATIOS))


@register("jn_gold_actual", "SELECT d.doc_id, l.quality, coalesce(l.toxic, 0)::INT AS toxic FROM documents d LEFT JOIN labels l USING (doc_id)")
def jn_gold_actual(spark, d):
    return relations.with_defaults(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels"), "doc_id", toxic=0).select("doc_id", "quality", "toxic")


@register("jn_unknown", "SELECT DISTINCT o_custkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_acctbal > 0)")
def jn_unknown(spark, d):
    known = table(spark, d, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"))
    return relations.unknown(table(spark, d, "orders"), known, "o_custkey")


@register("jn_leakage", "SELECT doc_id FROM labels EXCEPT SELECT doc_id FROM documents WHERE lang = 'en'")
def jn_leakage(spark, d):
    return relations.unknown(table(spark, d, "labels"), table(spark, d, "documents").filter("lang = 'en'"), "doc_id")


@register("jn_pages", "SELECT o_orderkey AS id, CASE WHEN n > 0 THEN 'succeeded' ELSE 'missing' END AS status FROM (SELECT o_orderkey, count(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1)")
def jn_pages(spark, d):
    results = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id")).distinct().withColumn("status", F.lit("succeeded"))
    pages = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"))
    return scoring.page_status(pages, results)


@register("jn_complete", "SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'failed/timeout' ELSE 'succeeded' END AS status FROM documents d LEFT JOIN labels l USING (doc_id)")
def jn_complete(spark, d):
    done = table(spark, d, "labels").select("doc_id", F.lit("succeeded").alias("status"))
    return relations.with_defaults(table(spark, d, "documents").select("doc_id"), done, "doc_id", status="failed/timeout")


@register("ag_failures", """
    WITH r AS (SELECT d.doc_id, l.doc_id IS NOT NULL AS done FROM documents d LEFT JOIN labels l USING (doc_id))
    SELECT doc_id, 'missing' AS status, 1::BIGINT AS n FROM r WHERE NOT done
    UNION ALL SELECT NULL, 'expected', count(*) FROM r UNION ALL SELECT NULL, 'accounted', count(*) FROM r WHERE done""")
def ag_failures(spark, d):
    """A row for every failure, beside the totals."""
    pages = table(spark, d, "documents").select(F.col("doc_id").alias("id"))
    done = table(spark, d, "labels").select(F.col("doc_id").alias("id"), F.lit("succeeded").alias("status")).distinct()
    rows = scoring.page_status(pages, done.join(pages, "id", "left_semi"))
    one = F.count("*").alias("n")
    totals = rows.groupBy(F.lit("expected").alias("status")).agg(one).unionByName(rows.filter("status = 'succeeded'").groupBy(F.lit("accounted").alias("status")).agg(one))
    return rows.filter("status <> 'succeeded'").select(F.col("id").alias("doc_id"), "status", F.lit(1).cast("long").alias("n")).unionByName(totals.select(F.lit(None).cast("long").alias("doc_id"), "status", "n"))


@register("jn_neighbour", f"""{GOLD}
    SELECT 'right' AS side, count(*)::BIGINT AS pairs, count(*) FILTER (x.part < y.part)::BIGINT AS rising FROM g x JOIN g y ON y.l_orderkey = x.l_orderkey AND y.l_linenumber = x.l_linenumber + 1
    UNION ALL SELECT 'down', count(*), count(*) FILTER (x.part < y.part) FROM g x JOIN g y ON y.l_linenumber = x.l_linenumber AND y.l_orderkey = x.l_orderkey + 1""")
def jn_neighbour(spark, d):
    return relations.beside(_gold(spark, d), "l_orderkey", "l_linenumber", "part")


@register("jn_pairs_adj", "SELECT conv_id, turn, lead(turn) OVER w AS next, (length(text) < lead(length(text)) OVER w) AS longer FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def jn_pairs_adj(spark, d):
    return relations.followed(table(spark, d, "conversations"), "conv_id", "turn", F.length("text")).select("conv_id", "turn", "next", "longer")


@register("jn_pairs_all", "SELECT a.conv_id, count(*)::BIGINT AS pairs, count(*) FILTER (length(a.text) < length(b.text))::BIGINT AS rising FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn < b.turn GROUP BY 1")
def jn_pairs_all(spark, d):
    t = table(spark, d, "conversations").select("conv_id", "turn", F.length("text").alias("n"))
    return scoring.later_pairs(t, "conv_id", "turn", "n").filter("pairs > 0").select("conv_id", "pairs", "rising")


@register("jn_candidate", """
    SELECT a.item_id AS gold, b.item_id AS block FROM benchmark a JOIN benchmark b ON a.item_id // 10 = b.item_id // 10 AND abs(length(a.text) - length(b.text)) <= length(a.text) * 0.5
    WHERE len(list_filter(string_split(a.text, ''), lambda x: NOT contains(b.text, x))) <= 0.02 * length(a.text)""")
def jn_candidate(spark, d):
    """Pairs within a page of ten that the cheap bounds let through; a page's blocks are few, so the join is bounded."""
    t = table(spark, d, "benchmark").withColumn("page", F.floor(F.col("item_id") / 10))
    a, b = t.alias("a"), t.alias("b")
    near = (F.col("a.page") == F.col("b.page")) & (F.abs(F.length("a.text") - F.length("b.text")) <= F.length("a.text") * 0.5)
    return a.join(b, near).filter(absent_share(F.col("a.text"), F.col("b.text")) <= 0.02).select(F.col("a.item_id").alias("gold"), F.col("b.item_id").alias("block"))


@register("jn_specs", "SELECT p_partkey, lower(p_brand) AS norm, CASE WHEN s.k IS NULL THEN 'missing' ELSE 'local' END AS status FROM part LEFT JOIN (SELECT DISTINCT lower(p_brand) AS k FROM part WHERE p_size > 49) s ON s.k = lower(p_brand)")
def jn_specs(spark, d):
    part = table(spark, d, "part").withColumn("norm", F.lower("p_brand"))
    return relations.availability(part.select("p_partkey", "norm"), part.filter("p_size > 49"), "norm").select("p_partkey", "norm", "status")


@register("jn_models", "SELECT s_suppkey, coalesce(n_name, 'default') AS model FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey AND n_regionkey < 3")
def jn_models(spark, d):
    catalog = table(spark, d, "nation").filter("n_regionkey < 3").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("model"))
    return relations.with_defaults(table(spark, d, "supplier").select("s_suppkey", "s_nationkey"), catalog, "s_nationkey", model="default").select("s_suppkey", "model")


@register("jn_bundle", "SELECT n.n_name, r.r_name FROM nation n JOIN region r ON r_regionkey = n_regionkey WHERE r_name IN ('ASIA', 'EUROPE') UNION ALL SELECT v, NULL FROM (VALUES ('NOWHERE')) t(v)")
def jn_bundle(spark, d):
    wanted = spark.createDataFrame([("ASIA",), ("EUROPE",), ("NOWHERE",)], "r_name string")
    nations = table(spark, d, "nation").withColumnRenamed("n_regionkey", "r_regionkey")
    return relations.members(wanted, table(spark, d, "region"), nations, "r_name", "r_regionkey", "n_name").withColumnRenamed("member", "n_name")


def _listed(spark, d):
    """Each order as the raw JSON of a parsing list: a line of text, then a table of its lines; odd orders lack the last cell's box."""
    line = F.col("l_linenumber")
    rows = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(line, F.isnull("l_partkey").alias("none"), F.col("l_partkey").alias("part")))).alias("all"))
    first = F.filter("all", lambda x, i: (i == 0) | ~x["l_linenumber"].eqNullSafe(F.get("all", i - 1)["l_linenumber"]))  # the smallest part of each line
    rows = rows.select("l_orderkey", first.alias("lines"))
    html = F.concat(F.lit("<table>"), F.array_join(F.transform("lines", lambda x: F.concat(F.lit("<tr><td>"), x["part"].cast("string"), F.lit("</td></tr>"))), ""), F.lit("</table>"))
    boxes = F.transform("lines", lambda x: F.array(F.lit(0), x["l_linenumber"] * 10, F.lit(50), x["l_linenumber"] * 10 + 10))
    boxes = F.when(F.col("l_orderkey") % 2 == 0, boxes).otherwise(F.slice(boxes, F.lit(1), F.size(boxes) - 1))
    block = lambda box, content, label: F.struct(F.array(*map(F.lit, box)).alias("block_bbox"), content.alias("block_content"), F.lit(label).alias("block_label"))
    blocks = F.array(block((0, 0, 10, 10), F.concat(F.lit("order "), "l_orderkey"), "text"), block((20, 10, 60, 100), html, "table"))
    raw = F.to_json(F.struct(F.lit(100).alias("width"), F.lit(200).alias("height"), blocks.alias("parsing_res_list"), F.array(F.struct(boxes.alias("cell_box_list"))).alias("table_res_list")))
    return documents.engine_blocks(rows.select(F.col("l_orderkey").cast("string").alias("page_id"), raw.alias("raw")), "list")


LISTED = "l AS (SELECT l_orderkey, l_linenumber, min(l_partkey) AS part, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS n FROM lineitem GROUP BY 1, 2)"


@register("src_paddle", f"""
    WITH {LISTED}
    SELECT l_orderkey::VARCHAR AS page_id, 0::INT AS idx, 'order ' || l_orderkey AS text, NULL::INT AS "row", 'parsing/0' AS ref FROM l GROUP BY l_orderkey
    UNION ALL SELECT l_orderkey::VARCHAR, n::INT, part::VARCHAR, (n - 1)::INT, 'parsing/1' FROM l""")
def src_paddle(spark, d):
    return _listed(spark, d).select("page_id", "idx", "text", "cell.row", F.col("engineRef").alias("ref"))


@register("jn_table_boxes", f"""
    WITH {LISTED}
    SELECT l_orderkey::VARCHAR AS page_id, n::INT AS idx, CASE WHEN l_orderkey % 2 = 0 THEN 0 ELSE 0.2 END::DOUBLE AS "left", round(CASE WHEN l_orderkey % 2 = 0 THEN l_linenumber * 10 / 200.0 ELSE 0.05 END::DOUBLE, 6) AS top FROM l""")
def jn_table_boxes(spark, d):
    """Cells have their own boxes if there are as many as cells, else the block's."""
    return _listed(spark, d).filter("cell is not null").select("page_id", "idx", F.get("bbox", F.lit(0)).alias("left"), F.round(F.get("bbox", F.lit(1)), 6).alias("top"))


@register("jn_provenance", "SELECT c.c_custkey, o.o_orderkey FROM customer c JOIN orders o ON o_custkey = c_custkey AND o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'")
def jn_provenance(spark, d):
    key = spark.createDataFrame([("F", "1-URGENT")], "o_orderstatus string, o_orderpriority string")
    cited = table(spark, d, "orders").join(F.broadcast(key), ["o_orderstatus", "o_orderpriority"])  # one row of keys
    return cited.join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("c_custkey", "o_orderkey")


@register("guard_duplicate", "SELECT l_orderkey, l_linenumber, count(*)::BIGINT AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def guard_duplicate(spark, d):
    return table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n")).filter("n > 1")


@register("sel_split", "SELECT doc_id, doc_id % 10 < 2 AS pilot FROM documents WHERE doc_id % 3 <> 0 AND doc_id % 10 < 2")
def sel_split(spark, d):
    pages = table(spark, d, "documents").select("doc_id", (F.col("doc_id") % 10 < 2).alias("pilot"), F.when(F.col("doc_id") % 3 == 0, "holdout").otherwise("dev").alias("split"))
    return scoring.select_pages(scoring.select_pages(pages, "dev", runner=True), "pilot").select("doc_id", "pilot")


@register("pred_location", "SELECT event_id, ((event_id % 3 = 0) OR (event_id % 4 = 0)) AND user_id % 2 = 0 AND event_type <> 'error' AS located FROM events")
def pred_location(spark, d):
    e = F.col("event_id")
    verified, proposed = F.when(e % 3 == 0, True).when(e % 3 == 1, False), F.when(e % 4 == 0, True)
    ok = scoring.located(verified, proposed, True, F.when(F.col("user_id") % 2 == 0, "h").otherwise("x"), F.lit("h"), F.when(F.col("event_type") != "error", 1).otherwise(2))
    return table(spark, d, "events").select("event_id", ok.alias("located"))


@register("pred_cell_exact", f"{GOLD} SELECT l_orderkey, count(*) FILTER (part = supp AND l_linenumber % 2 = 0)::BIGINT AS exact, count(*)::BIGINT AS n FROM (SELECT l_orderkey, l_linenumber, part % 4 AS part, supp % 4 AS supp FROM g) GROUP BY 1")
def pred_cell_exact(spark, d):
    cell = lambda c: F.struct(F.col(c).alias("row"), F.lit(1).alias("col"))
    g = _gold(spark, d).withColumns({"part": F.col("part") % 4, "supp": F.col("supp") % 4})
    exact = cell("part").eqNullSafe(cell("supp")) & (F.col("l_linenumber") % 2 == 0)
    return g.groupBy("l_orderkey").agg(F.count_if(exact).alias("exact"), F.count("*").alias("n"))


@register("wn_first_wins", "SELECT min(doc_id) AS doc_id FROM documents GROUP BY text")
def wn_first_wins(spark, d):
    return relations.first_of_equal(table(spark, d, "documents"), F.col("text"), "doc_id")


@register("wn_order_key", "SELECT conv_id, turn, turn * 100000 + length(text) AS ord FROM conversations")
def wn_order_key(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", (F.col("turn") * 100000 + F.length("text")).alias("ord"))


@register("wn_priority", "SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY (length(text) < 100), length(text) % 7, (role <> 'user'), turn)::INT AS place FROM conversations")
def wn_priority(spark, d):
    order = F.length("text") < 100, F.length("text") % 7, F.col("role") != "user", "turn"
    return relations.placed(table(spark, d, "conversations"), "conv_id", *order).select("conv_id", "turn", "place")


@register("wn_topk_one", "SELECT p_brand, coalesce(max(p_partkey) FILTER (p_size = m), min(p_partkey)) AS pick FROM (SELECT *, max(p_size) FILTER (p_size <= 30) OVER (PARTITION BY p_brand) AS m FROM part) GROUP BY 1")
def wn_topk_one(spark, d):
    return relations.largest_fitting(table(spark, d, "part"), "p_brand", "p_size", 30, "p_partkey")


@register("wn_pick_file", """
    WITH f AS (SELECT s_nationkey::VARCHAR AS model, CASE s_suppkey % 3 WHEN 0 THEN 'encoder' WHEN 1 THEN 'decoder' ELSE 'joiner' END AS role, s_acctbal > 3000 AS small, s_name FROM supplier),
    n AS (SELECT *, role || '-' || s_name || CASE WHEN small THEN '.int8' ELSE '' END || '.onnx' AS file FROM f)
    SELECT model, role, coalesce(min(file) FILTER (small = (role <> 'decoder')), min(file)) AS file FROM n GROUP BY 1, 2""")
def wn_pick_file(spark, d):
    """Of a model's files of a role: a small one, or for decoders a full one, where there is one."""
    role = F.when(F.col("s_suppkey") % 3 == 0, "encoder").when(F.col("s_suppkey") % 3 == 1, "decoder").otherwise("joiner")
    file = F.concat(role, F.lit("-"), "s_name", F.when(F.col("s_acctbal") > 3000, ".int8").otherwise(""), F.lit(".onnx"))
    return pick_files(table(spark, d, "supplier").select(F.col("s_nationkey").cast("string").alias("model"), file.alias("file")))


@register("wn_vendor", "SELECT o_custkey, CASE WHEN bool_or(o_orderpriority LIKE '1-%') THEN 'nvidia' WHEN bool_or(o_orderpriority LIKE '2-%') THEN 'amd' ELSE 'cpu' END AS vendor FROM orders GROUP BY 1")
def wn_vendor(spark, d):
    rules = [(F.col("o_orderpriority").startswith("1-"), "nvidia"), (F.col("o_orderpriority").startswith("2-"), "amd")]
    return relations.by_precedence(table(spark, d, "orders"), "o_custkey", rules, "cpu", "vendor")


@register("wn_dedupe_adj", "SELECT event_id FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events) WHERE p IS DISTINCT FROM event_type")
def wn_dedupe_adj(spark, d):
    return relations.changes(table(spark, d, "events"), "user_id", ["ts", "event_id"], "event_type").select("event_id")


@register("set_equal", "SELECT side, doc_id FROM (SELECT 'missing' AS side, * FROM (SELECT doc_id FROM documents EXCEPT ALL SELECT doc_id FROM labels) UNION ALL SELECT 'extra', * FROM (SELECT doc_id FROM labels EXCEPT ALL SELECT doc_id FROM documents))")
def set_equal(spark, d):
    return relations.both_ways(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels").select("doc_id"))


@register("ag_shape", """
    WITH h AS (SELECT lang, count(*)::BIGINT AS n FROM documents GROUP BY 1), w(lang, n) AS (VALUES ('en', 600::BIGINT), ('de', 145), ('fr', 145), ('es', 145), ('it', 1))
    SELECT coalesce(h.lang, w.lang) AS lang, h.n AS have, w.n AS want FROM h FULL JOIN w USING (lang) WHERE h.n IS DISTINCT FROM w.n""")
def ag_shape(spark, d):
    """Categories whose size is not as expected, absent ones too."""
    have = table(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n"))
    return scoring.shape_differences(have, spark.createDataFrame([("en", 600), ("de", 145), ("fr", 145), ("es", 145), ("it", 1)], "lang string, n long"), "lang")


@register("set_exclude", "SELECT n_name FROM nation WHERE n_regionkey NOT IN (SELECT r_regionkey FROM region WHERE r_name LIKE 'A%')")
def set_exclude(spark, d):
    out = table(spark, d, "region").filter("r_name like 'A%'").select(F.col("r_regionkey").alias("n_regionkey"))
    return relations.excluded(table(spark, d, "nation"), out, "n_regionkey").select("n_name")


@register("set_union_cat", "SELECT 0::INT AS place, 'auto' AS name UNION ALL SELECT row_number() OVER (ORDER BY r_name)::INT, r_name FROM region")
def set_union_cat(spark, d):
    named = relations.numbered(table(spark, d, "region").select(F.col("r_name").alias("name")), "name")
    return spark.createDataFrame([(0, "auto")], "place int, name string").unionByName(named)


@register("assign_greedy")
def assign_greedy(spark, d):
    """Whole benchmark passages as gold, their reversed order in two merged blocks as engine output, per page of ten."""
    items = table(spark, d, "benchmark").select(F.floor(F.col("item_id") / 10).cast("string").alias("page_id"), "item_id", "text")
    none = F.lit(None)
    cell, box = none.cast("struct<row:int,col:int,rowSpan:int,colSpan:int>"), none.cast("array<double>")
    gold = items.select("page_id", F.col("item_id").alias("pos"), F.col("item_id").cast("string").alias("gold_id"), "text", box.alias("box"), cell.alias("cell"))
    merged = items.groupBy("page_id", (F.col("item_id") % 2).cast("int").alias("idx")).agg(F.array_join(F.transform(F.reverse(F.array_sort(F.collect_list(F.struct("item_id", "text")))), lambda x: x["text"]), " ").alias("text"))
    return assign(gold, merged.select("page_id", "idx", "text", box.alias("box"), cell.alias("cell"), F.concat(F.lit("b"), "idx").alias("engine_ref"))).select("page_id", "gold_id", "status", "ord", "cost", "whole")


@register("src_html_table", """
    WITH s AS (SELECT n_regionkey, n_nationkey, n_name, row_number() OVER w::INT AS y, lag(n_nationkey) OVER w AS above FROM nation WINDOW w AS (PARTITION BY n_regionkey ORDER BY n_nationkey)),
    k AS (SELECT *, CASE WHEN y % 2 = 0 AND above % 2 = 0 THEN 1 ELSE 0 END AS moved FROM s WHERE y % 2 = 1 OR n_nationkey % 2 = 1)
    SELECT r_regionkey, 0::INT AS "row", 0::INT AS col, 1::INT AS "rowSpan", 2::INT AS "colSpan", r_name AS text FROM region
    UNION ALL SELECT n_regionkey, y, moved, CASE WHEN n_nationkey % 2 = 0 THEN 2 ELSE 1 END, 1, n_nationkey::VARCHAR FROM k
    UNION ALL SELECT n_regionkey, y, moved + 1, 1, 1, n_name || ' <&>' FROM k""")
def src_html_table(spark, d):
    """A table a region: a heading over both columns, then rows of number and name; even numbers reach into the next row, whose cells move on."""
    row = lambda x: F.concat(F.lit("<tr><td rowspan="), F.when(x["n_nationkey"] % 2 == 0, "2").otherwise("1"), F.lit(">"), x["n_nationkey"].cast("string"), F.lit("</td><td> "), x["n_name"], F.lit(" &lt;&amp;&gt; </td></tr>"))
    nations = table(spark, d, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("n"))
    rows = F.transform("n", lambda x, i: F.when((i % 2 == 0) | (x["n_nationkey"] % 2 == 1), row(x)).otherwise("<tr></tr>"))
    joined = table(spark, d, "region").join(nations, F.col("r_regionkey") == F.col("n_regionkey"), "left")
    html = F.concat(F.lit("<table><tr><th colspan=2>"), "r_name", F.lit("</th></tr>"), F.coalesce(F.array_join(rows, ""), F.lit("")), F.lit("</table>"))
    return joined.select("r_regionkey", F.explode(html_cells(html)).alias("c")).select("r_regionkey", "c.*")


@register("html_blocks", "SELECT page_id, len(regexp_extract_all(html, '<p[ >]'))::INT AS paragraphs, len(regexp_extract_all(html, '<li[ >]'))::INT AS items, len(regexp_extract_all(html, '<a '))::INT AS anchors FROM pages")
def html_blocks(spark, d):
    n = lambda p: F.regexp_count("html", F.lit(p))
    return table(spark, d, "pages").select("page_id", n("<p[ >]").alias("paragraphs"), n("<li[ >]").alias("items"), n("<a ").alias("anchors"))


@register("sel_runner", "SELECT 'dev' AS selection, count(*)::BIGINT AS pages FROM documents WHERE doc_id % 3 <> 0 UNION ALL SELECT 'holdout', NULL")
def sel_runner(spark, d):
    """What a runner gets of each split; the holdout is refused (null)."""
    pages = table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 3 == 0, "holdout").otherwise("dev").alias("split"), F.lit(False).alias("pilot"))
    rows = []
    for split in ("dev", "holdout"):
        try:
            rows.append((split, scoring.select_pages(pages, split, runner=True).count()))
        except scoring.GuardError:
            rows.append((split, None))
    return spark.createDataFrame(rows, "selection string, pages long")


@register("wn_lead_pair", "SELECT l_orderkey, l_linenumber, coalesce(part < lead(part) OVER w, false) AS rising FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS part FROM lineitem GROUP BY 1, 2) WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber)")
def wn_lead_pair(spark, d):
    """Whether a block's order is below that of the next one; the last has none."""
    return scoring.rising_pairs(_gold(spark, d), ["l_orderkey"], "l_linenumber", "part").select("l_orderkey", "l_linenumber", "rising")


@register("set_minus", "SELECT 'unknown' AS side, l_orderkey AS k FROM lineitem EXCEPT SELECT 'unknown', o_orderkey FROM orders UNION ALL (SELECT 'unused', o_orderkey FROM orders EXCEPT SELECT 'unused', l_orderkey FROM lineitem)")
def set_minus(spark, d):
    """Keys that one table has and the other hasn't, both ways."""
    lines, orders = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k")), table(spark, d, "orders").select(F.col("o_orderkey").alias("k"))
    return scoring.differences(lines, orders).select(F.when(F.col("only") == 1, "unknown").otherwise("unused").alias("side"), "k")


@register("guard_manifest", """
    SELECT doc_id AS page_id, 'repeats' AS problem FROM documents WHERE doc_id % 100 = 1 UNION ALL SELECT doc_id, 'no source' FROM documents WHERE doc_id % 90 = 5
    UNION ALL SELECT doc_id, 'source changed' FROM documents WHERE doc_id % 50 = 0 AND doc_id % 90 <> 5 UNION ALL SELECT doc_id, 'annotation changed' FROM documents WHERE doc_id % 60 = 0 AND doc_id % 90 <> 5
    UNION ALL SELECT doc_id, 'holdout in pilot' FROM documents WHERE doc_id % 3 = 0 AND doc_id % 10 = 0 UNION ALL SELECT doc_id, 'unreviewed' FROM documents WHERE doc_id % 7 = 0""")
def guard_manifest(spark, d):
    """A manifest of all documents with pages that repeat, are gone, were changed, are held out of the pilot, or unreviewed."""
    docs, k = table(spark, d, "documents"), F.col("doc_id")
    sha = lambda c, every: F.sha2(F.concat(F.coalesce(c, F.lit("")), F.when(k % every == 0, "x").otherwise("") if every else F.lit("")), 256)
    rows = docs.select(k.alias("page_id"), sha("text", 0).alias("sha"), sha("lang", 0).alias("annotation_sha"), F.when(k % 3 == 0, "holdout").otherwise("dev").alias("split"), (k % 10 == 0).alias("pilot"), (k % 7 != 0).alias("reviewed"))
    found = docs.filter(k % 90 != 5).select(k.alias("page_id"), sha("text", 50).alias("sha"), sha("lang", 60).alias("annotation_sha"))
    return scoring.manifest_problems(rows.unionByName(rows.filter("page_id % 100 = 1")), found)
