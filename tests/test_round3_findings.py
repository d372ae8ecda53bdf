"""What the findings of round 3 were about: partitions of sequential kernels, plans that stay small, what moves between tasks."""

import json

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from quillspark.llm import neardup
from quillspark.operators.library import Library
from quillspark.operators.reading import chunks
from quillspark.operators.scoring import GuardError, counters, differences, minus
from quillspark.sources import documents, media
from quillspark.storage import shared_dir
from quillspark.streaming import sessions


def test_union_of_unlike_sides_keeps_documents_whole(spark):
    """Sides of a union that lie by their keys already, and of which adaptive execution merges partitions by size, are still dealt by key."""
    lines = spark.range(60_000).select((F.col("id") % 9_000).alias("doc"), (F.col("id") / 9_000).cast("int").alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("text"))
    set_to = {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "200000"}
    before = {k: spark.conf.get(k) for k in set_to}
    for k, v in set_to.items():
        spark.conf.set(k, v)
    try:
        at = F.row_number().over(Window.partitionBy("doc").orderBy("k"))
        rows = lines.select("doc", F.lit(1).alias("page"), at.alias("ord"), F.lit("paragraph").alias("kind"), "text")
        heads = lines.select("doc").distinct().select("doc", F.lit(1).alias("page"), F.lit(0).alias("ord"), F.lit("heading").alias("kind"), F.lit("head").alias("text"))
        got = chunks(heads.unionByName(rows), 100, 10, "doc").collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(got) == 9_000
    assert {(r.chunk, r.text.split("\n")[0], r.n_tokens) for r in got} == {(0, "head", 7), (0, "head", 8)}


def test_library_moves_postings_and_texts_once(spark):
    """Changes count right, and the shuffles of two additions hold each posting once and no text of a first addition."""
    def shuffled():
        store = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
        return {store.apply(i).stageId(): store.apply(i).shuffleWriteRecords() for i in range(store.size())}

    rows = [(i, " ".join(f"w{(i * 7 + j) % 900}" for j in range(60))) for i in range(300)]
    own = Library(spark, shared_dir(spark, "library"))
    before = set(shuffled())
    assert own.add(spark.createDataFrame(rows, "doc_id long, text string")) == {"added": 300, "changed": 0, "unchanged": 0, "failed": 0}
    moved = sum(n for k, n in shuffled().items() if k not in before)
    assert 18_000 <= moved < 20_000  # 18,000 postings, sums by partitions and ids
    later = [(i, f"{t} more" if i % 10 == 0 else t) for i, t in rows[:200]] + [(1000, None), (1001, "new")]
    assert own.add(spark.createDataFrame(later, "doc_id long, text string")) == {"added": 1, "changed": 20, "unchanged": 180, "failed": 1}
    got = own.status().collect()[0]
    assert (got.documents, got.terms, got.failed) == (301, 300 * 60 + 20 + 1, 1)
    with pytest.raises(GuardError):
        own.add(spark.createDataFrame([(1, "a"), (1, "b")], "doc_id long, text string"))
    assert own.status().collect()[0].documents == 301


def test_counters_pair_blocks_in_one_shuffle(spark):
    """Gold and actual rows move once to be paired, checked and put in order; guards still find what repeats and what is unknown."""
    def shuffled():
        store = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
        return {store.apply(i).stageId(): store.apply(i).shuffleWriteRecords() for i in range(store.size())}

    k = F.col("id")
    rows = spark.range(3_000).select((k / 10).cast("int").cast("string").alias("page_id"), (k % 10).cast("string").alias("gold_id"), (k % 10).alias("pos"), F.concat(F.lit("t"), k).alias("text"))
    none = F.lit(None).cast("struct<row:int,col:int,rowSpan:int,colSpan:int>")
    gold = rows.select("*", F.lit("c").alias("category"), F.lit("h").alias("sha"), none.alias("cell"), F.lit(False).alias("key_number"), F.array().cast("array<string>").alias("numbers"))
    actual = rows.filter("pos <> 0").select("page_id", "gold_id", "text", F.col("pos").alias("ord"), F.lit("h").alias("sha"), F.lit(1).alias("page"), none.alias("cell"), F.lit(True).alias("verified"), F.lit(None).cast("boolean").alias("proposed"))
    before = set(shuffled())
    got = counters(gold, actual).collect()
    moved = sum(n for x, n in shuffled().items() if x not in before)
    assert [(r.blocks, r.correctSources, r.edits, r.orderPairs, r.correctOrderPairs, r.allOrderPairs, r.correctAllOrderPairs) for r in got] == [(3_000, 2_700, sum(len(f"t{i}") for i in range(0, 3_000, 10)), 2_700, 2_400, 13_500, 10_800)]
    assert moved < 3_000 + 2_700 + 3_000 + 700  # both sides once, and what pairs in order need
    for broken in (actual.unionByName(actual.limit(1)), actual.unionByName(actual.limit(1).withColumn("gold_id", F.lit("x")))):
        with pytest.raises(GuardError):
            counters(gold, broken)
    with pytest.raises(GuardError):
        counters(gold.unionByName(gold.limit(1)), actual)


def test_chunks_are_measured_before_they_move(spark):
    """Audio stays where it lies; its measures give what feeding frame by frame gave."""
    rng = np.random.default_rng(7)
    for n in [0, 1, 159, 160, 161, 400, 801, 1600, 4000]:
        for share in (0.0, 0.002, 0.01, 1.0):
            samples = np.where(rng.random(n) < share, 800, 0).astype("<i2")
            speech = tail = 0
            for a in range(0, n, sessions.FRAME):
                frame = samples[a : a + sessions.FRAME]
                speech, tail = (speech + len(frame), 0) if frame.any() else (speech, tail + len(frame))
            assert sessions.measure(samples.tobytes()) == (n, speech, tail)

    rows = spark.range(40_000).select((F.col("id") % 50).cast("string").alias("session_id"), F.col("id").alias("seq"), F.when(F.col("id") < 50, "open").otherwise("audio").alias("control"), F.unhex(F.repeat(F.sha2(F.col("id").cast("string"), 512), 20)).alias("pcm16"))
    bad = rows.filter("seq = 57").select("session_id", F.lit(99_999).cast("long").alias("seq"), "control", F.unhex(F.lit("00")).alias("pcm16"))
    store = spark.sparkContext._jsc.sc().statusStore()
    stages = lambda: store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    before = {stages().apply(i).stageId() for i in range(stages().size())}
    got = {r.status: r.n for r in sessions.segment_batch(rows.unionByName(bad)).groupBy("status").agg(F.count("*").alias("n")).collect()}
    assert got == {"open": 50, "ok": 39_950, "bad_audio": 1}
    after = stages()
    assert sum(after.apply(i).shuffleWriteBytes() for i in range(after.size()) if after.apply(i).stageId() not in before) < 4_000_000  # of 51 MB of audio


def test_differences_meet_in_one_aggregation(spark):
    """Nulls are equal, rows that repeat count once, and each table moves once with no join after it."""
    k = F.when(F.col("id") % 10 > 0, F.col("id") % 1_000).alias("k")
    a, b = spark.range(20_000).select(k), spark.range(500, 2_500).select((F.col("id") % 1_500).alias("k")).unionByName(spark.range(1).select(F.lit(None).cast("long").alias("k")))
    got = {(r.only, r.k) for r in differences(a, b).collect()}
    assert got == {(2, x) for x in range(1_500) if x >= 1_000 or x % 10 == 0}
    rows = spark.createDataFrame([(1, None), (1, None), (2, "x")], "a int, b string")
    assert minus(rows, rows.filter("b is null")).collect() == [(2, "x")]
    plan = differences(a, b)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 1


def test_a_page_is_one_row_from_json_to_blocks(spark):
    """Blocks are laid out within their page: no shuffle, sort or second reading of the JSON; a page id that repeats is numbered by row."""
    boxes = lambda n: {"cell_box_list": [[0, 10 * i, 50, 10 * i + 10] for i in range(n)]}
    html = lambda *x: "<table>" + "".join(f"<tr><td>{c}</td></tr>" for c in x) + "</table>"
    block = lambda content, label: {"block_bbox": [0, 0, 100, 100], "block_content": content, "block_label": label}
    page = {"width": 100, "height": 200, "table_res_list": [boxes(2), boxes(1), boxes(1)], "parsing_res_list": [
        block("a", "text"), block(html("b", "c"), "table"), block("no tags", "table"), block(html(), "table"), None, block(html("d&amp;e"), "table"), block(None, "table")]}
    given = spark.createDataFrame([("p", json.dumps(page)), ("p", json.dumps(page)), ("q", json.dumps({"res": page | {"parsing_res_list": []}}))], "page_id string, raw string")
    found = documents.engine_blocks(given, "list")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan and "Sort" not in plan and "Union" not in plan
    whole, cell = [0.0, 0.0, 1.0, 0.5], lambda row: (row, 0, 1, 1)
    want = [("a", whole, None, 0), ("b", [0.0, 0.0, 0.5, 0.05], cell(0), 1), ("c", [0.0, 0.05, 0.5, 0.1], cell(1), 1), ("no tags", whole, None, 2), ("", [0.0, 0.0, 1.0, 1.0], None, 4), ("d&e", [0.0, 0.0, 0.5, 0.05], cell(0), 5), ("", whole, None, 6)]
    got = [(r.page_id, r.idx, r.text, r.bbox, r.cell and tuple(r.cell), r.engineRef) for r in found.collect()]
    assert got == [("p", i, x, b, c, f"parsing/{n}") for _ in range(2) for i, (x, b, c, n) in enumerate(want)]


def test_plain_tables_are_read_as_by_the_parser():
    """HTML of table tags and plain text alone takes a short way, which finds what the whole parser finds."""
    rng = np.random.default_rng(3)
    pieces = ["<table>", "</table>", "<tr>", "</tr>", "<td>", "</td>", "<th>", "</th>", '<td rowspan="2">', "<td colspan='3' rowspan=\"2\">", '<th colspan="0">', "<tbody>", "</tfoot>", "x", " y ", "中", "a > b", "\n", '"']
    odd = ["&amp;", "<br>", "<TD>", "<td rowspan=2>", "<td/>", "a < b", "<!-- <td> -->", "<", '<td title=">">', "<td >"]
    plain = 0
    for i in range(4_000):
        html = "".join(rng.choice(pieces + odd * (i % 2), rng.integers(0, 30)).tolist())
        rows = media._plain_rows(html)
        plain += rows is not None
        assert rows is None or list(media.place_cells(rows)) == list(media.place_cells(media._Rows(html).rows)), html
    assert plain >= 2_000


def test_components_contract_links_in_tasks_and_broadcast_nothing(spark, monkeypatch):
    """A path in random order, a star and random links in unlike partitions: right components, no broadcast of ids, few jobs."""
    rng = np.random.default_rng(5)
    path = rng.permutation(600) + 10**12
    links = [*zip(path[:-1].tolist(), path[1:].tolist(), strict=True), *((-7, i) for i in range(1000, 1300)), *rng.integers(0, 900, (500, 2)).tolist(), (5, 5)]
    root: dict[int, int] = {}

    def least(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        if a != b:
            a, b = least(a), least(b)
            root[max(a, b)] = min(a, b)
    df = spark.createDataFrame(links, "a long, b long").repartition(5)
    monkeypatch.setattr(neardup, "LINKS", 40, raising=False)  # several contractions a task
    rows = neardup.components(df).collect()
    assert len(rows) == len(root) and {r.id: r.component for r in rows} == {x: least(x) for x in list(root)}
    monkeypatch.setattr(neardup, "LINKS", 1 << 18)
    executions = spark._jsparkSession.sharedState().statusStore()
    last = executions.executionsCount()
    rows = neardup.components(df).collect()
    assert {r.id: r.component for r in rows} == {x: least(x) for x in list(root)}
    plans = executions.executionsList()
    own = [plans.apply(i) for i in range(last, plans.size())]
    assert own and not any("BroadcastHashJoin" in x.physicalPlanDescription() for x in own)
    assert sum(x.jobs().size() for x in own) <= 30
    assert neardup.components(df.limit(0)).collect() == []
