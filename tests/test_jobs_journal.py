"""Job logs, journals written by streams that fail, and lineage over several groupings."""

import pytest

from quillspark.operators import jobs, transform
from quillspark.storage import shared_dir
from quillspark.streaming import journal


def test_states_and_verdicts(spark):
    log = [("a", i, e) for i, e in enumerate(["start", "queue", "queue", "start", "succeed", "fail", "cancel", "succeed"])] + [("b", 0, "queue"), ("b", 1, "start"), ("c", 0, None), ("c", 1, "dance"), ("d", 0, "queue"), ("d", 1, "cancel"), ("d", 2, "start")]
    df = spark.createDataFrame(log, "job_id string, seq int, event string")
    got = [(x.state, x.verdict) for x in jobs.replay(df).filter("job_id = 'a'").orderBy("seq").collect()]
    assert got == [("none", "illegal"), ("queued", "applied"), ("queued", "repeated"), ("running", "applied"), ("succeeded", "applied"), ("succeeded", "illegal"), ("succeeded", "illegal"), ("succeeded", "repeated")]
    assert {x.job_id: (x.state, x.applied, x.repeated, x.illegal) for x in jobs.states(df).collect()} == {"a": ("succeeded", 3, 2, 3), "b": ("running", 2, 0, 0), "c": ("none", 0, 0, 2), "d": ("cancelled", 2, 0, 1)}
    more = jobs.recover(df)
    assert sorted(map(tuple, more.collect())) == [("b", 2, "interrupt"), ("b", 3, "queue")]
    again = df.unionByName(more.withColumn("seq", more.seq.cast("int")))
    assert {x.job_id: x.state for x in jobs.states(again).collect()}["b"] == "queued" and jobs.recover(again).collect() == []
    assert jobs.states(df.limit(0)).collect() == []


def test_equal_requests_are_one_job(spark):
    rows = [("r1", 5, "h", {"a": "1", "b": "2"}), ("r2", 3, "h", {"b": "2", "a": "1"}), ("r3", 4, "h", {"a": "2"}), ("r4", 9, "g", None), ("r5", 9, "g", {})]
    got = {x.request_id: (x.job_id, x.repeats) for x in jobs.identified(spark.createDataFrame(rows, "request_id string, at int, input_hash string, options map<string,string>")).collect()}
    assert got == {"r1": ("r2", True), "r2": ("r2", False), "r3": ("r3", False), "r4": ("r4", False), "r5": ("r4", True)}


def test_a_journal_survives_a_broken_batch(spark, monkeypatch):
    path = shared_dir(spark, "journal")
    spark.range(30).repartition(3).write.parquet(f"{path}/in")
    stream = lambda: spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    broken = []

    def breaks(df, n):
        df.write.mode("overwrite").json(f"{path}/rows/{journal.BATCH}={n}")
        if n == 1 and not broken:
            broken.append(n)
            raise RuntimeError("lost after the rows were written, before the batch counts as done")

    with pytest.raises(Exception, match="lost"):
        stream().writeStream.foreachBatch(breaks).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    for _ in range(2):
        journal.write_journal(stream(), f"{path}/rows", f"{path}/checkpoint").awaitTermination()
    rows = journal.read_journal(spark, f"{path}/rows", "id long").collect()
    assert sorted(x.id for x in rows) == list(range(30)) and {x[journal.BATCH] for x in rows} == {0, 1, 2}


def test_lineage_through_two_groupings(spark):
    df = spark.createDataFrame([(i, i % 4, i % 2, i) for i in range(40)], "_row long, a long, b long, v long")
    steps = [{"step": "filter", "column": "v", "op": "<", "value": 38}, {"step": "group", "by": ["a", "b"], "aggregates": [{"function": "sum", "column": "v", "as": "s"}]}, {"step": "group", "by": ["b"], "aggregates": [{"function": "sum", "column": "s", "as": "t"}]}, {"step": "filter", "column": "b", "op": "=", "value": 1}]
    out, links = transform.traced(df, steps)
    assert [(r.b, r.t) for r in out.collect()] == [(1, sum(i for i in range(38) if i % 2))]
    assert sorted(int(r._source) for r in links.collect()) == [i for i in range(38) if i % 2]
    assert transform.traced(df.drop("_row"), steps)[1] is None
