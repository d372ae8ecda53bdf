"""What the findings of round 4 were about: what goes through the driver, and what a page's work costs."""

import numpy as np
from pyspark.sql import functions as F

from quillspark.functions.text import SPACES, narrow, normalize
from quillspark.llm import neardup
from quillspark.operators import spans
from quillspark.plans import registry


def test_places_in_buckets_are_never_broadcast(spark):
    """Spark takes exploded band keys for a small table whatever their number; they are merged, with the groups as they were."""
    texts = [" ".join(f"w{(i // 3 * 97 + j) % 5000}" for j in range(80)) + (" and" if i % 3 == 1 else "") for i in range(90)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    executions = spark._jsparkSession.sharedState().statusStore()
    last = executions.executionsCount()
    rows = neardup.near_duplicates(docs, k=2).collect()
    assert {r.doc_id: r.component_id for r in rows} == {i: i // 3 * 3 for i in range(90)}
    plans = executions.executionsList()
    own = [plans.apply(i).physicalPlanDescription() for i in range(last, plans.size())]
    exploded = [p for p in own if "Generate" in p]
    assert exploded and not any("Broadcast" in p for p in exploded)


def test_score_report_reads_its_lines_once(spark):
    """Gold and engine blocks are made from one small table of lines: the input is read and grouped by one plan, not by each that needs a block."""
    executions = spark._jsparkSession.sharedState().statusStore()
    last = executions.executionsCount()
    assert registry.queries()["score_report"](spark, "/root/testdata/sf0.001").count() == 3
    plans = executions.executionsList()
    own = [plans.apply(i).physicalPlanDescription() for i in range(last, plans.size())]
    assert sum("lineitem.parquet" in p for p in own) == 1


def test_spans_side_by_side_are_those_of_each_pair(spark):
    """Cells of two, four and eight bytes, long texts beside short ones, few pairs and many; offers of texts that stand there unchanged; raw texts."""
    r = np.random.default_rng(1)
    patterns = [r.integers(0, 4, int(n)) for n in r.integers(1, 40, 400)] + [r.integers(0, 3, 50)] * 3
    texts = [r.integers(0, 4, int(n)) for n in r.integers(0, 300, 400)] + [r.integers(0, 3, n) for n in (50_000, 4_000, 0)]
    want = [spans.span_search(p, t) for p, t in zip(patterns, texts, strict=True)]
    assert spans.span_search_many(patterns, texts) == want == spans.span_search_many(patterns, texts, 5_000)
    pairs = [("ab\U0001f600", "x\U0001f600ab\U0001f600ab\U0001f600", False), ("ab", "ab", True), ("ab", "abc", True), ("abcd", "xabxd", False), ("zzzz", "abcd", False), ("", "", False), ("abcd", "abxd", True)]
    got = spans._priced(spark.createDataFrame(pairs, "want string, have string, whole boolean")).collect()
    assert sorted(tuple(x) for x in got) == sorted([(*pairs[0], 0, 2, 5), (*pairs[1], 0, 0, 2), (*pairs[3], 1, 1, 5), (*pairs[5], 0, 0, 0), (*pairs[6], 1, 0, 4)])
    raw = [("a b\u3000cd", 1, 3), ("abc", 1, 2), (" ab ", 0, 2), (" ", 0, 0), ("a", 1, 1)]
    got = spark.createDataFrame(raw, "t string, a int, b int").coalesce(1).select(spans.raw_span("t", "a", "b")).collect()
    assert [x[0] for x in got] == ["b\u3000c", "b", "ab", " ", ""]
    odd = spark.range(0x10000).filter("id < 55296 or id > 57343").select(F.expr("concat('a', decode(unhex(lpad(hex(id), 4, '0')), 'UTF-16BE'), 'b')").alias("t"))
    assert odd.filter(normalize(F.col("t")) != F.regexp_replace(narrow(F.col("t")), SPACES, "")).count() == 0
