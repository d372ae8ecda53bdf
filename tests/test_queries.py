"""Registered queries against their SQL, at the smallest scale; names and pairs of queries and SQL."""

import glob
import hashlib
import os
import re

import duckdb
import pytest

from quillspark.operators import retrieval
from quillspark.plans import registry

DATA = "/root/testdata/sf0.001"


def test_every_sql_has_a_query():
    assert set(registry.oracle_sql()) <= set(registry.queries())


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    cursor = con.execute(registry.oracle_sql()[name])
    columns = sorted(c[0] for c in cursor.description)
    at = [[c[0] for c in cursor.description].index(c) for c in columns]
    want = sorted(str([r[i] for i in at]) for r in cursor.fetchall())
    df = registry.queries()[name](spark, DATA)
    assert sorted(df.columns) == columns
    assert sorted(str([r[c] for c in columns]) for r in df.collect()) == want


def test_counts_of_all_orders(spark):
    """At sf0.01 most orders have keys of 3000 and more."""
    data, sql = "/root/testdata/sf0.01", registry.oracle_sql()["ag_counts"]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{data}/lineitem.parquet'")
    cursor = con.execute(sql)
    columns = [c[0] for c in cursor.description]
    want = sorted(cursor.fetchall())
    got = registry.queries()["ag_counts"](spark, data).collect()
    assert sorted(tuple(r[c] for c in columns) for r in got) == want
    assert sum(r.blocks for r in got) == con.execute("SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)").fetchone()[0]


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_distances_of_whole_passages(spark):
    texts = {r.item_id: r.text for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()}
    want = {i: (edits(x, texts[i + 1]), len(x)) for i, x in texts.items() if i + 1 in texts}
    assert {r.item_id: (r.edits, r.chars) for r in registry.queries()["txt_distance"](spark, DATA).collect()} == want
    bare = {i: "".join(x.split()) for i, x in texts.items()}
    rates = {p: round(sum(edits(bare[i], bare[i + 1]) for i in want if i % 4 == p) / sum(len(bare[i]) for i in want if i % 4 == p), 6) for p in {i % 4 for i in want}}
    assert {r.part: r.cer for r in registry.queries()["txt_cer"](spark, DATA).collect()} == pytest.approx(rates, abs=1e-6)


def test_word_error_rates(spark):
    texts = {r.item_id: r.text for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()}
    got = {r.item_id: (r.edits, r.words) for r in registry.queries()["txt_wer"](spark, DATA).collect()}
    words = {i: re.split(r"\s+", x) for i, x in texts.items()}
    assert got == {i: (edits(words[i], words[i + 1]), len(words[i])) for i in texts if i + 1 in texts}


def test_inventory_of_the_tables(spark):
    want = sorted((os.path.basename(f), os.path.getsize(f), hashlib.sha256(open(f, "rb").read()).hexdigest()) for f in glob.glob(f"{DATA}/*.parquet"))
    assert sorted(map(tuple, registry.queries()["src_inventory"](spark, DATA).collect())) == want


def test_search_in_blocks(spark, monkeypatch):
    whole = sorted(map(tuple, registry.queries()["vec_cosine"](spark, DATA).collect()))
    monkeypatch.setattr(retrieval, "BLOCK", 2)
    assert whole and sorted(map(tuple, registry.queries()["vec_cosine"](spark, DATA).collect())) == whole


def test_assigned_passages_and_wrapped_lines(spark):
    found = registry.queries()["assign_greedy"](spark, DATA).collect()
    items = spark.read.parquet(f"{DATA}/benchmark.parquet").collect()
    assert len(found) == len(items) and all(r.status == "proposed" and r.cost == 0 for r in found)
    lines = {}
    for r in registry.queries()["txt_wrap"](spark, DATA).orderBy("item_id", "line").collect():
        lines.setdefault(r.item_id, []).append(r.text)
    assert all("".join("".join(lines[r.item_id]).split()) == "".join(r.text.split()) for r in items)
    first = registry.queries()["src_synth_text"](spark, DATA)
    assert sorted(map(tuple, first.collect())) == sorted(map(tuple, registry.queries()["src_synth_text"](spark, DATA).repartition(3).collect()))
