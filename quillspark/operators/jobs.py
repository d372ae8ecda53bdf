"""Jobs as an event log: states, idempotent requests, and what a restart has to take up again (from the design specification).

A log has rows (job_id, seq, event).  Each event asks for a state; it is applied if the job may go there from where it
is, repeated if it is there already, and illegal otherwise, in which case the job stays where it is.

Rows: null or unknown events are illegal; jobs without events have no state; events of equal seq are taken by name;
an empty log gives empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ordered import by_key, in_order

#: Event -> state it asks for, and the states it may come from. Fixed values.
EVENTS = {
    "queue": ("queued", ("none", "interrupted")), "start": ("running", ("queued",)), "succeed": ("succeeded", ("running",)), "partial": ("partial", ("running",)), "fail": ("failed", ("running",)),
    "cancel": ("cancelled", ("queued", "running", "interrupted")), "interrupt": ("interrupted", ("running",)),
}
ENDED = ("succeeded", "partial", "failed", "cancelled")


def replay(log: DataFrame) -> DataFrame:
    """Every event with ``state`` after it and ``verdict``; a job's events are streamed in their order, with its state alone kept."""

    def step(state: str, r) -> tuple[str, tuple]:
        asked, sources = EVENTS.get(r.event, (None, ()))
        verdict = "repeated" if asked == state else "applied" if state in sources else "illegal"
        state = asked if verdict == "applied" else state
        return state, (r.job_id, r.seq, r.event, state, verdict)

    rows = log.select("job_id", F.col("seq").cast("long").alias("seq"), "event")
    kind = log.schema["job_id"].dataType.simpleString()
    return in_order(rows, ["job_id"], ["seq", "event"], by_key(lambda: "none", step, ["job_id", "seq", "event", "state", "verdict"], "job_id"), f"job_id {kind}, seq long, event string, state string, verdict string")


def states(log: DataFrame) -> DataFrame:
    """Of each job: its state, and how many events were applied, repeated and illegal."""
    n = lambda v: F.count_if(F.col("verdict") == v).alias(v)
    return replay(log).groupBy("job_id").agg(F.max_by("state", F.struct("seq", "event")).alias("state"), n("applied"), n("repeated"), n("illegal"))


def recover(log: DataFrame) -> DataFrame:
    """Events (job_id, seq, event) that a restart adds: what was running is interrupted and queued again; what ended stays."""
    last = log.groupBy("job_id").agg(F.max("seq").cast("long").alias("last"))
    running = states(log).filter("state = 'running'").select("job_id").join(last, "job_id")
    return running.select("job_id", F.posexplode(F.array(F.lit("interrupt"), F.lit("queue"))).alias("i", "event"), "last").select("job_id", (F.col("last") + 1 + F.col("i")).alias("seq"), "event")


def identified(requests: DataFrame) -> DataFrame:
    """Requests (request_id, at, input_hash, options map) with ``key`` and ``job_id``: equal input and options are one job, that of the first request.

    Options count in the order of their names, so a map's own order makes no other job.
    """
    options = F.array_sort(F.map_entries(F.coalesce("options", F.create_map().cast("map<string,string>"))))
    key = F.sha2(F.concat_ws("\0", F.coalesce("input_hash", F.lit("")), F.to_json(options)), 256)
    rows = requests.withColumn("key", key)
    first = rows.groupBy("key").agg(F.min_by("request_id", F.struct("at", "request_id")).alias("job_id"))
    return rows.join(first, "key").select(*requests.columns, "key", "job_id", (F.col("request_id") != F.col("job_id")).alias("repeats"))
