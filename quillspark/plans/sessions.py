"""Queries over event streams: sessions, concurrency, admission, engine lifecycle, segments, jobs."""

from __future__ import annotations

import struct

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import jobs
from ..streaming import sessions as s
from .registry import register
from .tables import sql_literal, sql_values, table

ISLANDS = """
    m AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events),
    n AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM m),
    sessions AS (SELECT user_id, min(ts) AS first_ts, max(ts) AS last_ts, count(*)::BIGINT AS events FROM n GROUP BY user_id, k)"""


def _sessions(spark, d):
    return s.idle_sessions(table(spark, d, "events"), "user_id", "ts", "6 hours", "event_id")


@register("st_sessions", f"WITH {ISLANDS} SELECT user_id, first_ts, last_ts, events FROM sessions")
def st_sessions(spark, d):
    return _sessions(spark, d)


@register("st_idle", f"WITH {ISLANDS} SELECT user_id, first_ts, last_ts, events FROM sessions")
def st_idle(spark, d):
    """The same sessions from the built-in session window, whose gap is strict as well."""
    w = F.session_window(F.col("ts").cast("timestamp"), "6 hours")
    return table(spark, d, "events").groupBy("user_id", w).agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("events")).select("user_id", "first_ts", "last_ts", "events")


@register("st_counts", f"WITH {ISLANDS} SELECT user_id, count(*)::BIGINT AS sessions, sum(events)::BIGINT AS chunks, sum(events > 1)::BIGINT AS finals FROM sessions GROUP BY 1")
def st_counts(spark, d):
    return _sessions(spark, d).groupBy("user_id").agg(F.count("*").alias("sessions"), F.sum("events").alias("chunks"), F.count_if(F.col("events") > 1).alias("finals"))


@register("st_concurrency", f"""
    WITH {ISLANDS}, e AS (SELECT first_ts AS ts, 1 AS d FROM sessions UNION ALL SELECT last_ts, -1 FROM sessions), t AS (SELECT ts, sum(d) AS d FROM e GROUP BY 1)
    SELECT ts::DATE AS day, max(n)::BIGINT AS most FROM (SELECT ts, sum(d) OVER (ORDER BY ts) AS n FROM t) GROUP BY 1""")
def st_concurrency(spark, d):
    """Most sessions open at once by day: running sums within days over the sum of all days before."""
    x = _sessions(spark, d)
    steps = x.select(F.col("first_ts").alias("ts"), F.lit(1).alias("d")).unionByName(x.select(F.col("last_ts").alias("ts"), F.lit(-1).alias("d")))
    steps = steps.groupBy("ts").agg(F.sum("d").alias("d")).withColumn("day", F.to_date("ts"))
    before = steps.groupBy("day").agg(F.sum("d").alias("d"))
    before = before.select("day", (F.sum("d").over(Window.partitionBy(F.lit(0)).orderBy("day")) - F.col("d")).alias("before"))  # a row a day
    run = F.sum("d").over(Window.partitionBy("day").orderBy("ts"))
    return steps.withColumn("n", run).join(before, "day").groupBy("day").agg(F.max(F.col("n") + F.col("before")).alias("most"))


@register("eng_load_sim", """
    WITH m AS (SELECT *, lag(event_type) OVER w AS p, ts - lag(ts) OVER w AS gap FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
    SELECT CASE WHEN p IS NULL THEN 'first' WHEN gap >= INTERVAL 30 MINUTE THEN 'idle' WHEN p <> event_type THEN 'switch' ELSE 'warm' END AS kind, count(*)::BIGINT AS requests FROM m GROUP BY 1""")
def eng_load_sim(spark, d):
    return s.load_counts(table(spark, d, "events"), "user_id", "event_type", "ts", "30 minutes", "event_id")


@register("eng_lifecycle", """
    WITH m AS (SELECT *, lag(event_type) OVER w AS p, ts - lag(ts) OVER w AS gap FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    k AS (SELECT user_id, CASE WHEN p IS NULL THEN 'first' WHEN gap >= INTERVAL 30 MINUTE THEN 'idle' WHEN p <> event_type THEN 'switch' ELSE 'warm' END AS kind FROM m)
    SELECT user_id, count(*) FILTER (kind <> 'warm')::BIGINT AS loads, count(*) FILTER (kind = 'idle')::BIGINT AS idle_unloads, count(*) FILTER (kind = 'switch')::BIGINT AS switch_unloads, count(*) FILTER (kind = 'warm')::BIGINT AS warm FROM k GROUP BY 1""")
def eng_lifecycle(spark, d):
    return s.lifecycle(table(spark, d, "events"), "user_id", "event_type", "ts", "30 minutes", "event_id")


@register("st_segments", """
    WITH m AS (SELECT *, CASE WHEN (event_type = 'error') IS DISTINCT FROM (lag(event_type) OVER w = 'error') THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    n AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM m)
    SELECT user_id, min(event_id) AS first, max(event_id) AS last, count(*)::BIGINT AS n FROM n WHERE event_type <> 'error' GROUP BY user_id, k""")
def st_segments(spark, d):
    """Runs of events between errors, which stand for silence."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    silent = F.col("event_type") == "error"
    new = ~silent.eqNullSafe(F.lag(silent).over(w))
    runs = table(spark, d, "events").withColumn("new", new.cast("int")).withColumn("k", F.sum("new").over(w)).filter(~silent)
    return runs.groupBy("user_id", "k").agg(F.min("event_id").alias("first"), F.max("event_id").alias("last"), F.count("*").alias("n")).drop("k")


@register("st_open", f"""
    WITH RECURSIVE {ISLANDS},
    i AS (SELECT user_id % 15 AS server, user_id || '-' || lpad(row_number() OVER (PARTITION BY user_id ORDER BY first_ts)::VARCHAR, 4, '0') AS session_id, first_ts, last_ts FROM sessions),
    q AS (SELECT *, row_number() OVER (PARTITION BY server ORDER BY first_ts, session_id) AS k FROM i),
    a AS (
      SELECT server, 0::BIGINT AS k, NULL::VARCHAR AS session_id, NULL::TIMESTAMP AS x, NULL::TIMESTAMP AS y, true AS ok FROM (SELECT DISTINCT server FROM q)
      UNION ALL
      SELECT server, k, session_id, CASE WHEN x IS NULL THEN last_ts ELSE x END, CASE WHEN x IS NULL THEN y WHEN y IS NULL THEN last_ts ELSE y END, x IS NULL OR y IS NULL FROM (
        SELECT q.server, q.k, q.session_id, q.last_ts, CASE WHEN a.x >= q.first_ts THEN a.x END AS x, CASE WHEN a.y >= q.first_ts THEN a.y END AS y FROM a JOIN q ON q.server = a.server AND q.k = a.k + 1))
    SELECT session_id, CASE WHEN ok THEN 'open' ELSE 'rejected' END AS status FROM a WHERE k > 0""")
def st_open(spark, d):
    """Sessions of fifteen servers with two places each, in order of arrival; a rejected one holds no place."""
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("first_ts"))
    rows = _sessions(spark, d).select((F.col("user_id") % 15).alias("server"), F.concat("user_id", F.lit("-"), F.lpad(n.cast("string"), 4, "0")).alias("session_id"), "first_ts", "last_ts")
    return s.admit(rows, 2, by="server")


def _chunks(spark):
    """The timeline that fixes the segmentation: speech, speech, silence, speech, finish; then an unknown session."""
    loud, still = struct.pack("<h", 8000), struct.pack("<h", 0)
    sec = lambda x, n: x * int(16000 * n)
    rows = [("s", 0, "open", None), ("s", 1, "audio", sec(loud, 1.0)), ("s", 2, "audio", sec(loud, 0.5)), ("s", 3, "audio", sec(still, 0.8)), ("s", 4, "audio", sec(loud, 0.5)), ("s", 5, "finish", None), ("s", 6, "audio", sec(loud, 0.1)), ("t", 0, "delete", None)]
    return spark.createDataFrame(rows, "session_id string, seq long, control string, pcm16 binary")


TIMELINE = [("s", 0, "open", "", 0, 0), ("s", 1, "ok", "字字", 0, 0), ("s", 2, "ok", "字字字", 0, 0), ("s", 3, "ok", "", 1, 2300), ("s", 4, "ok", "字", 0, 0), ("s", 5, "finished", "", 1, 2800), ("s", 6, "unknown_session", "", 0, 0), ("t", 0, "unknown_session", "", 0, 0)]


@register("st_feed", sql_values("session_id, seq, status, partial, finals, end_ms", TIMELINE))
def st_feed(spark, d):
    out = s.segment_batch(_chunks(spark))
    return out.select("session_id", "seq", "status", "partial", F.size("finals").alias("finals"), F.coalesce(F.get("finals", F.lit(0))["endMs"], F.lit(0)).alias("end_ms"))


def _audio(spark, d, unit: int = 480):
    """Every user's events as chunks of audio of 30 to 240 ms, two in five without sound, after an opening and before a finish."""
    e = table(spark, d, "events")
    # events are numbered before their audio is made: what stands in one select with a window moves through its sort
    numbered = e.select("user_id", "event_id", "event_type", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("seq"))
    n = ((1 + F.col("event_id") % 8) * unit).cast("int")
    still = F.col("event_type").isin("error", "view")
    chunks = numbered.select(F.col("user_id").cast("string").alias("session_id"), F.col("seq").cast("long").alias("seq"), F.lit("audio").alias("control"), F.unhex(F.repeat(F.when(still, "0000").otherwise("401F"), n)).alias("pcm16"))
    control = lambda at, name: e.select(F.col("user_id").cast("string").alias("session_id")).distinct().select("session_id", F.lit(at).cast("long").alias("seq"), F.lit(name).alias("control"), F.lit(None).cast("binary").alias("pcm16"))
    return chunks.unionByName(control(0, "open")).unionByName(control(1 << 40, "finish")).unionByName(control((1 << 40) + 1, "audio")).unionByName(control((1 << 40) + 2, "delete"))


#: Rules at a tenth of their usual length, for chunks at a tenth of theirs; 30 ms of speech are a character.
SHORT_RULES = s.Rules(still=0.2, silence=0.08, longest=2.0, char_seconds=0.03)


SEGMENTED = """
    c AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, (1 + event_id % 8) * 480 AS n, event_type IN ('error', 'view') AS still FROM events),
    r AS (
      SELECT user_id, 0::BIGINT AS seq, 0::BIGINT AS total, 0::BIGINT AS first, 0::BIGINT AS speech, 0::BIGINT AS quiet, 0::BIGINT AS chars, false AS ended, 0::BIGINT AS a, 0::BIGINT AS b FROM (SELECT DISTINCT user_id FROM events)
      UNION ALL
      SELECT user_id, seq, total, CASE WHEN ended THEN total ELSE first END, CASE WHEN ended THEN 0 ELSE speech END, CASE WHEN ended THEN 0 ELSE quiet END, speech // 480, ended, first, total FROM (
        SELECT *, quiet >= CASE WHEN speech > 0 THEN 1280 ELSE 3200 END OR total - first >= 32000 AS ended FROM (
          SELECT r.user_id, c.seq, r.total + c.n AS total, r.first, r.speech + CASE WHEN still THEN 0 ELSE c.n END AS speech, CASE WHEN still THEN r.quiet + c.n ELSE 0 END AS quiet
          FROM r JOIN c ON c.user_id = r.user_id AND c.seq = r.seq + 1))),
    z AS (SELECT user_id, max_by(total, seq) AS total, max_by(first, seq) AS first, max_by(speech, seq) AS speech FROM r GROUP BY 1)"""


@register("st_endpoint", f"""
    WITH RECURSIVE {SEGMENTED}
    SELECT user_id::VARCHAR AS session_id, seq, 'ok' AS status, CASE WHEN ended THEN 0 ELSE chars END::INT AS partial, CASE WHEN ended AND chars > 0 THEN 1 ELSE 0 END::INT AS finals,
           CASE WHEN ended AND chars > 0 THEN a // 16 END::BIGINT AS start_ms, CASE WHEN ended AND chars > 0 THEN b // 16 END::BIGINT AS end_ms, CASE WHEN ended AND chars > 0 THEN chars ELSE 0 END::INT AS chars FROM r WHERE seq > 0
    UNION ALL SELECT DISTINCT user_id::VARCHAR, 0, 'open', 0, 0, NULL, NULL, 0 FROM events
    UNION ALL SELECT user_id::VARCHAR, 1099511627776, 'finished', 0, CASE WHEN speech >= 480 THEN 1 ELSE 0 END, CASE WHEN speech >= 480 THEN first // 16 END, CASE WHEN speech >= 480 THEN total // 16 END, (speech // 480)::INT FROM z
    UNION ALL SELECT DISTINCT user_id::VARCHAR, 1099511627777, 'unknown_session', 0, 0, NULL, NULL, 0 FROM events
    UNION ALL SELECT DISTINCT user_id::VARCHAR, 1099511627778, 'unknown_session', 0, 0, NULL, NULL, 0 FROM events""")
def st_endpoint(spark, d):
    """All sessions chunk by chunk under the three rules; leading silence moves the start, a finish closes, later rows find no session."""
    out = s.segment_batch(_audio(spark, d), SHORT_RULES)
    last = F.get("finals", F.lit(0))
    return out.select("session_id", "seq", "status", F.length("partial").alias("partial"), F.size("finals").alias("finals"), last["startMs"].alias("start_ms"), last["endMs"].alias("end_ms"), F.coalesce(F.length(last["text"]), F.lit(0)).alias("chars"))


@register("st_serial", f"""
    WITH RECURSIVE {SEGMENTED}, f AS (
      SELECT user_id, seq > 0 AS chunk, ended AND chars > 0 AS final, CASE WHEN ended THEN chars ELSE 0 END AS chars FROM r UNION ALL SELECT user_id, false, speech >= 480, speech // 480 FROM z)
    SELECT user_id::VARCHAR AS session_id, count(*) FILTER (chunk)::BIGINT AS chunks, count(*) FILTER (final)::BIGINT AS finals, sum(chars)::BIGINT AS chars FROM f GROUP BY 1""")
def st_serial(spark, d):
    """What sessions come to, whatever order their rows arrive in: each is worked through in its own order."""
    mixed = _audio(spark, d).repartition(F.xxhash64("session_id", "seq"))
    out = s.segment_batch(mixed, SHORT_RULES)
    return out.groupBy("session_id").agg(F.count_if(F.col("status") == "ok").alias("chunks"), F.sum(F.size("finals")).cast("long").alias("finals"), F.sum(F.coalesce(F.length(F.get("finals", F.lit(0))["text"]), F.lit(0))).alias("chars"))


def _fed(spark, d):
    return s.segment_batch(_audio(spark, d), SHORT_RULES)


@register("st_finish", f"""
    WITH RECURSIVE {SEGMENTED}
    SELECT user_id::VARCHAR AS session_id, CASE WHEN speech >= 480 THEN first // 16 END AS start_ms, CASE WHEN speech >= 480 THEN total // 16 END AS end_ms FROM z""")
def st_finish(spark, d):
    """The tail that a finish gives out, if it holds text."""
    last = F.get("finals", F.lit(0))
    return _fed(spark, d).filter("status = 'finished'").select("session_id", last["startMs"].alias("start_ms"), last["endMs"].alias("end_ms"))


@register("st_partial_reset", f"""
    WITH RECURSIVE {SEGMENTED}, n AS (SELECT *, lead(first) OVER w AS next_first, lead(speech) OVER w AS next_speech FROM r WINDOW w AS (PARTITION BY user_id ORDER BY seq))
    SELECT user_id::VARCHAR AS session_id, count(*) FILTER (ended AND chars > 0)::BIGINT AS finals, count(*) FILTER (seq > 0 AND (ended OR chars = 0))::BIGINT AS empty_partials FROM n GROUP BY 1""")
def st_partial_reset(spark, d):
    """Finals, and chunks after which the partial text is empty: each end of a segment empties it."""
    chunks = _fed(spark, d).filter("status = 'ok'")
    return chunks.groupBy("session_id").agg(F.count_if(F.size("finals") > 0).alias("finals"), F.count_if(F.col("partial") == "").alias("empty_partials"))


@register("st_unknown", "SELECT user_id::VARCHAR AS session_id, 2::BIGINT AS unknown FROM events GROUP BY 1")
def st_unknown(spark, d):
    """Audio and a close after a finish find no session."""
    return _fed(spark, d).filter("status = 'unknown_session'").groupBy("session_id").agg(F.count("*").alias("unknown"))


@register("st_close", "SELECT DISTINCT user_id::VARCHAR AS session_id, 'closed' AS first, 'unknown_session' AS second, 'open' AS again FROM events")
def st_close(spark, d):
    """An explicit close, a second one, and an opening after it."""
    users = table(spark, d, "events").select(F.col("user_id").cast("string").alias("session_id")).distinct()
    control = F.array(*map(F.lit, ("open", "delete", "delete", "open")))
    rows = users.select("session_id", F.posexplode(control).alias("seq", "control")).select("session_id", F.col("seq").cast("long").alias("seq"), "control", F.lit(None).cast("binary").alias("pcm16"))
    at = lambda n: F.max(F.when(F.col("seq") == n, F.col("status")))
    return s.segment_batch(rows).groupBy("session_id").agg(at(1).alias("first"), at(2).alias("second"), at(3).alias("again"))


#: Events as those of jobs: every user's of a day are one log.
JOB_EVENTS = tuple(jobs.EVENTS)
LEGAL = " OR ".join(f"(event = '{e}' AND state IN ({', '.join(map(sql_literal, sources))}))" for e, (_, sources) in jobs.EVENTS.items())
ASKED = "CASE event " + " ".join(f"WHEN '{e}' THEN '{state}'" for e, (state, _) in jobs.EVENTS.items()) + " END"
JOBS = f"""
    v AS (SELECT user_id || ' ' || ts::DATE AS job_id, row_number() OVER (PARTITION BY user_id, ts::DATE ORDER BY ts, event_id) AS seq, [{", ".join(map(sql_literal, JOB_EVENTS))}][event_id % 7 + 1] AS event FROM events),
    r AS (
      SELECT job_id, 0::BIGINT AS seq, 'none' AS state, '' AS verdict FROM (SELECT DISTINCT job_id FROM v)
      UNION ALL
      SELECT job_id, seq, CASE WHEN legal AND asked <> state THEN asked ELSE state END, CASE WHEN asked = state THEN 'repeated' WHEN legal THEN 'applied' ELSE 'illegal' END FROM (
        SELECT v.job_id, v.seq, r.state, {ASKED} AS asked, ({LEGAL}) AS legal FROM r JOIN v ON v.job_id = r.job_id AND v.seq = r.seq + 1))"""


def _job_log(spark, d):
    seq = F.row_number().over(Window.partitionBy("user_id", F.to_date("ts")).orderBy("ts", "event_id"))
    event = F.element_at(F.array(*map(F.lit, JOB_EVENTS)), (F.col("event_id") % 7 + 1).cast("int"))
    return table(spark, d, "events").select(F.concat_ws(" ", "user_id", F.to_date("ts")).alias("job_id"), seq.cast("long").alias("seq"), event.alias("event"))


@register("st_job", f"""
    WITH RECURSIVE {JOBS}
    SELECT job_id, max_by(state, seq) AS state, count(*) FILTER (verdict = 'applied')::BIGINT AS applied, count(*) FILTER (verdict = 'repeated')::BIGINT AS repeated, count(*) FILTER (verdict = 'illegal')::BIGINT AS illegal FROM r GROUP BY 1""")
def st_job(spark, d):
    """From the design specification: the state of every job after its log, and how many events were applied, repeated or illegal."""
    return jobs.states(_job_log(spark, d))


@register("st_job_recovery", f"""
    WITH RECURSIVE {JOBS}, z AS (SELECT job_id, max_by(state, seq) AS state, max(seq) AS last FROM r GROUP BY 1)
    SELECT job_id, last + k AS seq, CASE k WHEN 1 THEN 'interrupt' ELSE 'queue' END AS event FROM z, (VALUES (1), (2)) t(k) WHERE state = 'running'""")
def st_job_recovery(spark, d):
    """From the design specification: what a restart adds to the logs of jobs that were running."""
    return jobs.recover(_job_log(spark, d))


@register("st_job_requests", """
    SELECT request_id, first AS job_id, request_id <> first AS repeats FROM (
      SELECT o_orderkey AS request_id, arg_min(o_orderkey, (o_orderdate, o_orderkey)) OVER (PARTITION BY o_custkey, o_orderpriority) AS first FROM orders)""")
def st_job_requests(spark, d):
    """From the design specification: requests with equal input and options, which are one job; the options' order does not count."""
    k = F.col("o_orderkey")
    pairs = [F.lit("priority"), F.col("o_orderpriority")], [F.lit("profile"), F.lit("cpu")]
    options = F.when(k % 2 == 0, F.create_map(*pairs[0], *pairs[1])).otherwise(F.create_map(*pairs[1], *pairs[0]))
    rows = table(spark, d, "orders").select(k.alias("request_id"), F.col("o_orderdate").alias("at"), F.sha2(F.col("o_custkey").cast("string"), 256).alias("input_hash"), options.alias("options"))
    return jobs.identified(rows).select("request_id", "job_id", "repeats")


@register("library_index", "SELECT min(doc_id) AS doc_id, sha256(text) AS digest FROM documents WHERE doc_id % 2 = 1 AND text NOT IN (SELECT text FROM documents WHERE doc_id % 2 = 0) GROUP BY text")
def library_index(spark, d):
    """From the design specification: what an incremental index adds, by content digest."""
    docs = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))
    known = docs.filter("doc_id % 2 = 0").select("digest")
    return docs.filter("doc_id % 2 = 1").join(known, "digest", "left_anti").groupBy("digest").agg(F.min("doc_id").alias("doc_id"))
