"""Queries over manifests, requests, sinks and the specified table and retrieval operators."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import manifests as m
from ..operators import retrieval, transform
from ..sources import tabular
from ..sources.documents import read_journal, read_json
from ..storage import discard, materialize, shared_dir
from ..streaming import journal
from .registry import register
from .tables import sql_literal, table

@register("pred_path_safe", """
    SELECT doc_id, doc_id % 7 IN (3, 5, 6) AS safe FROM documents""")
def pred_path_safe(spark, d):
    """Absolute paths, parent steps, drive letters, empty paths, and names that only begin with two dots."""
    k, name = F.col("doc_id") % 7, F.concat(F.col("source"), F.lit("-"), F.col("doc_id").cast("string"))
    path = F.when(k == 0, F.concat(F.lit("/"), name)).when(k == 1, F.concat(name, F.lit("/../x"))).when(k == 2, F.concat(F.lit("C:\\"), name)).when(k == 3, F.concat(F.lit("a/.."), name)).when(k == 4, "").when(k == 5, F.concat(name, F.lit("/b.txt"))).otherwise(name)
    return table(spark, d, "documents").select("doc_id", m.safe_path(path).alias("safe"))


@register("pred_installed", """
    SELECT s_nationkey::VARCHAR AS dir, bool_or(s_suppkey % 4 = 0) AND bool_or(s_suppkey % 4 = 1) AS installed FROM supplier GROUP BY 1""")
def pred_installed(spark, d):
    k = F.col("s_suppkey") % 4
    name = F.when(k == 0, "config.json").when(k == 1, F.concat("s_name", F.lit(".safetensors"))).when(k == 2, F.concat("s_name", F.lit(".bin.incomplete"))).otherwise(F.concat("s_name", F.lit(".txt")))
    return m.installed(table(spark, d, "supplier").select(F.col("s_nationkey").cast("string").alias("dir"), name.alias("name")))


@register("pred_lang_fmt", "SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'json' WHEN o_orderkey % 4 = 1 THEN 'text' ELSE 'error' END AS format FROM orders")
def pred_lang_fmt(spark, d):
    given = F.when(F.col("o_orderkey") % 4 == 0, "json").when(F.col("o_orderkey") % 4 == 1, "text").otherwise("srt")
    return table(spark, d, "orders").select("o_orderkey", F.when(given.isin(*m.FORMATS), given).otherwise("error").alias("format"))


@register("chk_problems", "SELECT c_custkey, concat_ws('|', CASE WHEN c_acctbal < 0 THEN 'balance' END, CASE WHEN c_mktsegment NOT IN ('BUILDING', 'MACHINERY') THEN 'segment' END) AS problems FROM customer")
def chk_problems(spark, d):
    broken = m.problems((F.col("c_acctbal") >= 0, "balance"), (F.col("c_mktsegment").isin("BUILDING", "MACHINERY"), "segment"))
    return table(spark, d, "customer").select("c_custkey", F.array_join(broken, "|").alias("problems"))


@register("rt_method_path", """
    WITH r AS (SELECT event_id, CASE event_type WHEN 'click' THEN 'GET' WHEN 'view' THEN 'POST' ELSE 'DELETE' END AS verb, event_id % 7 AS k FROM events)
    SELECT event_id, CASE k WHEN 0 THEN CASE WHEN verb = 'GET' THEN '/health' ELSE '405' END WHEN 1 THEN CASE WHEN verb = 'GET' THEN '/v1/models' ELSE '405' END WHEN 2 THEN CASE WHEN verb = 'POST' THEN '/v1/stream/sessions' ELSE '405' END
           WHEN 3 THEN CASE WHEN verb = 'POST' THEN 'audio' ELSE '405' END WHEN 4 THEN CASE WHEN verb = 'POST' THEN 'finish' ELSE '405' END WHEN 5 THEN CASE WHEN verb = 'DELETE' THEN 'session' ELSE '405' END ELSE '404' END AS route FROM r""")
def rt_method_path(spark, d):
    """Requests with queries, fragments and trailing slashes."""
    k, e = F.col("event_id") % 7, F.col("event_id").cast("string")
    verb = F.when(F.col("event_type") == "click", "GET").when(F.col("event_type") == "view", "POST").otherwise("DELETE")
    inner = F.concat(F.lit("/v1/stream/sessions/s"), e)
    path = F.when(k == 0, F.concat(F.lit("/health?x="), e)).when(k == 1, "/v1/models/").when(k == 2, "/v1/stream/sessions").when(k == 3, F.concat(inner, F.lit("/audio#f"))).when(k == 4, F.concat(inner, F.lit("/finish/?a=b"))).when(k == 5, inner).otherwise(F.concat(F.lit("/nope/"), e))
    return table(spark, d, "events").select("event_id", m.route(verb, path).alias("route"))


@register("err_classify", """
    SELECT event_id, CASE event_id % 7 WHEN 0 THEN 'disk' WHEN 1 THEN 'timeout' WHEN 2 THEN 'permission' WHEN 3 THEN 'network' WHEN 4 THEN 'hash' WHEN 5 THEN 'disk' ELSE '' END AS kind FROM events""")
def err_classify(spark, d):
    """Messages of each class, and some of two classes, of which the first counts."""
    found = ("No space left on device", "Read Timed out", "Access Denied", "SSL error", "sha256 differs", "connection lost: ENOSPC", "what")
    text = F.concat(F.lit("item "), F.col("event_id").cast("string"), F.lit(": "), F.get(F.array(*map(F.lit, found)), (F.col("event_id") % 7).cast("int")))
    return table(spark, d, "events").select("event_id", m.classify_error(text).alias("kind"))


@register("flt_only_skip", "SELECT count(*) FILTER (quality = 1)::BIGINT AS ok, count(*) FILTER (quality <> 1)::BIGINT AS failed FROM labels WHERE doc_id % 2 = 0 AND doc_id % 5 <> 0")
def flt_only_skip(spark, d):
    kept = table(spark, d, "labels").filter((F.col("doc_id") % 2 == 0) & (F.col("doc_id") % 5 != 0))
    return kept.agg(F.count_if(F.col("quality") == 1).alias("ok"), F.count_if(F.col("quality") != 1).alias("failed"))


@register("flt_discover", """
    WITH f AS (SELECT s_nationkey, bool_or(s_suppkey % 3 = 0) AND bool_or(s_suppkey % 3 = 1) AS ok FROM supplier GROUP BY 1)
    SELECT CASE WHEN s_nationkey % 4 = 1 THEN 'mcp/' ELSE '' END || 'c' || s_nationkey AS component FROM f WHERE ok AND s_nationkey % 4 < 3""")
def flt_discover(spark, d):
    """Folders (below mcp one level deeper) that have both files; tools is no component."""
    n, k = F.col("s_nationkey"), F.col("s_suppkey") % 3
    folder = F.when(n % 4 == 1, F.concat(F.lit("mcp/c"), n)).when(n % 4 == 3, "tools").otherwise(F.concat(F.lit("c"), n))
    paths = table(spark, d, "supplier").select(F.concat(folder, F.when(k == 0, "/install.ps1").when(k == 1, "/README.md").otherwise("/other.txt")).alias("path"))
    return m.discover(paths)


@register("prj_compress", """
    WITH f AS (SELECT p_partkey, repeat(replace(p_name, ' ', '_'), 1 + p_partkey % 9) || CASE p_partkey % 3 WHEN 0 THEN '.PNG' WHEN 1 THEN '.txt' ELSE '.safetensors' END AS path, 1970 + p_size AS y FROM part)
    SELECT p_partkey, CASE WHEN p_partkey % 3 = 1 THEN 'deflate' ELSE 'store' END AS method, greatest(y, 1980)::INT AS "year", CASE WHEN length(path) > 60 THEN '…' || right(path, 59) ELSE path END AS label FROM f""")
def prj_compress(spark, d):
    k = F.col("p_partkey")
    path = F.concat(F.repeat(F.replace("p_name", F.lit(" "), F.lit("_")), (1 + k % 9).cast("int")), F.when(k % 3 == 0, ".PNG").when(k % 3 == 1, ".txt").otherwise(".safetensors"))
    return table(spark, d, "part").select("p_partkey", m.archive_entry(path, F.col("p_size") + 1970).alias("e")).select("p_partkey", "e.method", "e.year", "e.label")


@register("prj_placeholder", "SELECT s_suppkey, '--dir ' || s_name || '/x ' || s_name AS args FROM supplier")
def prj_placeholder(spark, d):
    args = F.transform(F.array(F.lit("--dir"), F.lit("{CompDir}/x"), F.lit("{CompDir}")), lambda a: F.replace(a, F.lit("{CompDir}"), F.col("s_name")))
    return table(spark, d, "supplier").select("s_suppkey", F.array_join(args, " ").alias("args"))


@register("ag_sizes", "SELECT source, count(*)::BIGINT AS files, sum(strlen(text))::BIGINT AS bytes FROM documents WHERE NOT regexp_matches(source, '1$') GROUP BY 1")
def ag_sizes(spark, d):
    return table(spark, d, "documents").filter(~F.col("source").rlike("1$")).groupBy("source").agg(F.count("*").alias("files"), F.sum(F.octet_length("text")).alias("bytes"))


@register("ag_weights", "SELECT o_orderkey, round(o_totalprice * 1000 / 180e6 + o_custkey * 1000 / 30e6 + (o_totalprice * 1000 + 0.55 * o_custkey * 1000) / 200e6, 4) AS seconds FROM (SELECT o_orderkey, o_totalprice, o_custkey::DOUBLE AS o_custkey FROM orders)")
def ag_weights(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.round(m.stage_seconds(F.col("o_totalprice") * 1000, F.col("o_custkey").cast("double") * 1000), 4).alias("seconds"))


@register("ag_download_est", "SELECT c_custkey, (c_nationkey * 10000000 + CASE WHEN c_acctbal > 0 THEN 0 ELSE 150000000 END + CASE WHEN c_custkey % 2 = 0 THEN 5 ELSE 0 END)::BIGINT AS bytes FROM customer")
def ag_download_est(spark, d):
    est = m.download_estimate(F.col("c_nationkey").cast("bigint"), F.col("c_acctbal") > 0, F.when(F.col("c_custkey") % 2 == 0, 5))
    return table(spark, d, "customer").select("c_custkey", est.cast("bigint").alias("bytes"))


@register("ag_preflight", """
    WITH p AS (SELECT 'v' || (o_orderkey % 3) AS a, 'v' || (o_custkey % 3) AS b, o_orderkey::DOUBLE AS n FROM orders)
    SELECT volume, round(sum(need))::BIGINT AS need FROM (SELECT a AS volume, n * 1.05::DOUBLE + 50000000 AS need FROM p UNION ALL SELECT b, n * 0.95::DOUBLE FROM p) GROUP BY 1""")
def ag_preflight(spark, d):
    v = lambda c: F.concat(F.lit("v"), (F.col(c) % 3).cast("string"))
    return m.disk_needed(table(spark, d, "orders").select(v("o_orderkey").alias("stage_volume"), v("o_custkey").alias("zip_volume"), F.col("o_orderkey").alias("bytes")))


@register("ag_percentile", "SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY 1")
def ag_percentile(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.round(F.percentile("value", 0.5), 6).alias("p50"), F.round(F.percentile("value", 0.95), 6).alias("p95"))


@register("ag_asr_metrics", """
    WITH p AS (SELECT item_id, regexp_replace(text, '[^\\x00-\\x7f]', '?', 'g') AS a FROM benchmark)
    SELECT item_id % 5 AS part, round(sum(levenshtein(a, replace(a, 'e', '')))::DOUBLE / sum(length(a)), 6) AS cer, round(sum(item_id)::DOUBLE / sum(length(a)), 6) AS rtf FROM p GROUP BY 1""")
def ag_asr_metrics(spark, d):
    """Over whole passages, folded to ASCII as the SQL counts bytes."""
    rows = table(spark, d, "benchmark").select("item_id", t.ascii_fold(F.col("text")).alias("a"))
    return rows.groupBy((F.col("item_id") % 5).alias("part")).agg(
        F.round(t.error_rate(F.levenshtein("a", F.replace("a", F.lit("e"), F.lit(""))), F.length("a")), 6).alias("cer"), F.round(F.try_divide(F.sum("item_id").cast("double"), F.sum(F.length("a"))), 6).alias("rtf"))


@register("snk_response", """SELECT conv_id, turn, sha256(CASE turn % 3 WHEN 0 THEN to_json({text: text})::VARCHAR WHEN 1 THEN to_json({task: 'transcribe', text: text, segments: []::VARCHAR[]})::VARCHAR ELSE text END) AS digest FROM conversations""")
def snk_response(spark, d):
    """Bodies of three formats with whole texts; digests, as the results are long."""
    short = F.to_json(F.struct("text"))
    long = F.to_json(F.struct(F.lit("transcribe").alias("task"), "text", F.array().cast("array<string>").alias("segments")))
    body = F.when(F.col("turn") % 3 == 0, short).when(F.col("turn") % 3 == 1, long).otherwise(F.col("text"))
    return table(spark, d, "conversations").select("conv_id", "turn", F.sha2(body, 256).alias("digest"))


@register("snk_wheel", "SELECT item_id, 'p/' || item_id || '.py,sha256=' || rtrim(translate(to_base64(unhex(sha256(text))), '+/', '-_'), '=') || ',' || strlen(text) AS line FROM benchmark")
def snk_wheel(spark, d):
    path = F.concat(F.lit("p/"), F.col("item_id").cast("string"), F.lit(".py"))
    return table(spark, d, "benchmark").select("item_id", m.record_line(path, F.col("text").cast("binary")).alias("line"))


@register("snk_zip_verify", """
    SELECT 'whole' AS copy, count(*)::BIGINT AS files, sum(strlen(text))::BIGINT AS bytes, true AS same FROM documents
    UNION ALL SELECT 'cut', count(*), sum(strlen(text)), false FROM documents WHERE doc_id % 10 <> 0""")
def snk_zip_verify(spark, d):
    """Copies that were written and read back against their source: a whole one, and one that lost a tenth of its files."""
    source = table(spark, d, "documents").select("doc_id", F.octet_length("text").alias("bytes"))
    copies = [(n, materialize(df, "copy")) for n, df in (("whole", source), ("cut", source.filter("doc_id % 10 <> 0")))]
    rows = [(n, *df.agg(F.count("*"), F.sum("bytes")).first(), tabular.same_content(df, source)) for n, df in copies]
    discard(*(df for _, df in copies))
    return spark.createDataFrame(rows, "copy string, files long, bytes long, same boolean")


def _back(spark, d, kind):
    return shared_dir(spark, kind), table(spark, d, "labels")


@register("snk_json_once", "SELECT doc_id, quality, toxic, 'refused' AS again FROM labels")
def snk_json_once(spark, d):
    """Writes a table once and reads it back; writing it again is refused."""
    path, labels = _back(spark, d, "once")
    tabular.publish(labels, path)
    try:
        tabular.publish(labels.limit(0), path)
        again = "written"
    except AnalysisException:
        again = "refused"
    return spark.read.schema(labels.schema).json(path).withColumn("again", F.lit(again))


@register("snk_json_replace", "SELECT doc_id, quality, toxic FROM labels WHERE quality = 1")
def snk_json_replace(spark, d):
    path, labels = _back(spark, d, "replace")
    tabular.publish(labels, path)
    tabular.publish(labels.filter("quality = 1"), path, replace=True)
    return spark.read.schema(labels.schema).json(path)


@register("src_json", "SELECT n_regionkey, n_nationkey, n_name FROM nation")
def src_json(spark, d):
    """JSON documents of many lines, one a file."""
    path, _ = _back(spark, d, "json")
    rows = table(spark, d, "nation").groupBy("n_regionkey").agg(F.collect_list(F.struct("n_nationkey", "n_name")).alias("nations"))
    pretty = F.to_json(F.struct("n_regionkey", "nations"), {"pretty": "true"})
    rows.select(pretty.alias("value"), F.col("n_regionkey").alias("file")).write.partitionBy("file").text(path)
    read = read_json(spark, path, "n_regionkey int, nations array<struct<n_nationkey:int,n_name:string>>")
    return read.select("n_regionkey", F.explode("nations").alias("n")).select("n_regionkey", "n.*")


@register("snk_journal", "SELECT doc_id, quality, toxic FROM labels")
def snk_journal(spark, d):
    """A journal that a stream wrote in batches, replayed after a restart that finds nothing new."""
    path = shared_dir(spark, "journal")
    table(spark, d, "labels").repartition(3).write.parquet(f"{path}/in")
    rows = spark.readStream.schema("doc_id long, quality int, toxic int").option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    for _ in range(2):
        journal.write_journal(rows, f"{path}/rows", f"{path}/checkpoint").awaitTermination()
    return journal.read_journal(spark, f"{path}/rows", "doc_id long, quality int, toxic int").select("doc_id", "quality", "toxic")


@register("snk_export", """
    SELECT k.format, 'p_partkey,p_name,formula' AS columns, count(*)::BIGINT AS rows, CASE WHEN k.format = 'csv' THEN count(*) FILTER (p_partkey % 3 = 0) ELSE 0 END::BIGINT AS guarded, count(*)::BIGINT AS read_back
    FROM part, (VALUES ('csv'), ('parquet')) k(format) GROUP BY 1""")
def snk_export(spark, d):
    """Exports with their manifests, read back: guarded texts are in the CSV alone, negative numbers stay."""
    k = F.col("p_partkey")
    df = table(spark, d, "part").select("p_partkey", "p_name", F.when(k % 3 == 0, F.concat(F.lit("=A"), k)).when(k % 3 == 1, F.concat(F.lit("-"), k)).otherwise("p_name").alias("formula"))
    out = []
    for kind in ("csv", "parquet"):
        path, _ = _back(spark, d, "export")
        made = tabular.export(df, path, kind)
        read = spark.read.schema(df.schema).option("header", True).csv(f"{path}/data") if kind == "csv" else spark.read.parquet(f"{path}/data")
        restored = read.withColumn("formula", F.regexp_replace("formula", "^'", ""))
        out.append(made.select("format", "columns", "rows", "guarded").withColumn("read_back", F.lit(restored.join(df, df.columns, "left_semi").count())))
    return out[0].unionByName(out[1])


def _stamp(ms, mark):
    return f"lpad(({ms} // 3600000)::VARCHAR, 2, '0') || ':' || lpad(({ms} % 3600000 // 60000)::VARCHAR, 2, '0') || ':' || lpad(({ms} % 60000 // 1000)::VARCHAR, 2, '0') || '{mark}' || lpad(({ms} % 1000)::VARCHAR, 3, '0')"


@register("snk_audio_export", f"""
    WITH s AS (SELECT user_id, event_id, event_type, event_id * 997 AS a, event_id * 997 + 900 AS b, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events)
    SELECT user_id, 'txt' AS kind, sha256(string_agg(event_type, chr(10) ORDER BY n)) AS digest FROM s GROUP BY 1
    UNION ALL SELECT user_id, 'json', sha256('[' || string_agg('{{"startMs":' || a || ',"endMs":' || b || ',"text":"' || event_type || '"}}', ',' ORDER BY n) || ']') FROM s GROUP BY 1
    UNION ALL SELECT user_id, 'srt', sha256(string_agg(n || chr(10) || {_stamp('a', ',')} || ' --> ' || {_stamp('b', ',')} || chr(10) || event_type || chr(10), chr(10) ORDER BY n)) FROM s GROUP BY 1
    UNION ALL SELECT user_id, 'vtt', sha256('WEBVTT' || chr(10) || chr(10) || string_agg({_stamp('a', '.')} || ' --> ' || {_stamp('b', '.')} || chr(10) || event_type || chr(10), chr(10) ORDER BY n)) FROM s GROUP BY 1""")
def snk_audio_export(spark, d):
    """A user's events as segments of a recording, in the four formats."""
    at = F.col("event_id") * 997
    rows = table(spark, d, "events").select("user_id", "event_id", at.alias("first_ms"), (at + 900).alias("last_ms"), F.col("event_type").alias("text"))
    out = None
    for kind in ("txt", "json", "srt", "vtt"):
        one = tabular.subtitles(rows, kind, key="user_id", order="event_id").select("user_id", F.lit(kind).alias("kind"), F.sha2("body", 256).alias("digest"))
        out = one if out is None else out.unionByName(one)
    return out


@register("snk_html_sheet", """
    WITH r AS (SELECT o_orderkey AS k, '<' || o_orderpriority || '>' AS want, CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 5 = 0 THEN 'a & b' ELSE '<' || o_orderpriority || '>' END AS have FROM orders),
    c AS (SELECT *, CASE WHEN have IS NULL THEN 'missing' WHEN want = have THEN 'ok' ELSE 'diff' END AS kind FROM r)
    SELECT '<tr class="' || kind || '"><td>' || k || '</td><td>' || replace(replace(want, '<', '&lt;'), '>', '&gt;') || '</td><td>' || coalesce(replace(replace(replace(have, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '') || '</td></tr>' AS line FROM c""")
def snk_html_sheet(spark, d):
    """Comparison sheets of all orders, written and read back: every row is on one of the pages."""
    k, want, path = F.col("o_orderkey"), F.concat(F.lit("<"), "o_orderpriority", F.lit(">")), shared_dir(spark, "sheet")
    rows = table(spark, d, "orders").select(k.alias("k"), want.alias("want"), F.when(k % 7 != 0, F.when(k % 5 == 0, "a & b").otherwise(want)).alias("have"))
    tabular.write_sheet(rows, path, "k", "want", "have")
    return spark.read.text(path).filter(F.col("value").startswith("<tr")).select(F.col("value").alias("line"))


@register("src_progress", """
    SELECT event_id, CASE event_id % 4 WHEN 0 THEN event_id::VARCHAR WHEN 2 THEN (event_id % 50)::VARCHAR WHEN 3 THEN (event_id % 100) || '.5' END AS done, CASE event_id % 4 WHEN 0 THEN (event_id * 2)::VARCHAR WHEN 2 THEN '120' WHEN 3 THEN '100' END AS total FROM events""")
def src_progress(spark, d):
    e = F.col("event_id")
    raw = F.when(e % 4 == 0, F.concat(F.lit("PROG "), e, F.lit(" "), e * 2)).when(e % 4 == 1, F.concat(F.lit("noise "), e)).when(e % 4 == 2, F.concat(F.lit("Progress "), e % 50, F.lit(" of 120"))).otherwise(F.concat(e % 100, F.lit(".5%")))
    return table(spark, d, "events").select("event_id", m.progress(raw).alias("p")).select("event_id", "p.done", "p.total")


@register("src_pyproject", "SELECT n_regionkey, replace(n_name, ' ', '-') || '>=' || n_nationkey AS dep FROM nation")
def src_pyproject(spark, d):
    """Project files with one list of dependencies and other lists around it."""
    dep = F.concat(F.lit('  "'), F.replace("n_name", F.lit(" "), F.lit("-")), F.lit(">="), "n_nationkey", F.lit('",\n'))
    raw = F.concat(F.lit('[project]\nkeywords = ["a"]\ndependencies = [\n'), F.array_join(F.collect_list(dep), ""), F.lit(']\n[tool.x]\nother = ["z"]\n'))
    return table(spark, d, "nation").groupBy("n_regionkey").agg(raw.alias("raw")).select("n_regionkey", F.explode(m.dependencies(F.col("raw"))).alias("dep"))


@register("src_distinfo", """
    WITH p AS (SELECT p_partkey, lower(regexp_replace(CASE WHEN p_partkey % 2 = 0 THEN replace(p_name, ' ', '_') ELSE upper(replace(p_name, ' ', '.')) END, '[-_.]+', '-', 'g')) AS norm,
               CASE WHEN p_size = 1 THEN 'no metadata' WHEN p_size = 2 THEN 'editable' ELSE '' END AS skip FROM part)
    SELECT norm, p_partkey AS scan, skip FROM (SELECT *, row_number() OVER (PARTITION BY norm ORDER BY p_partkey) AS n FROM p) WHERE n = 1""")
def src_distinfo(spark, d):
    """Installed packages as found by a scan: of a name in any spelling the first counts, with why it is left out."""
    name = F.when(F.col("p_partkey") % 2 == 0, F.replace("p_name", F.lit(" "), F.lit("_"))).otherwise(F.upper(F.replace("p_name", F.lit(" "), F.lit("."))))
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("scan"), name.alias("name"), (F.col("p_size") != 1).alias("has_metadata"), (F.col("p_size") == 2).alias("editable"))
    return m.distributions(rows)


@register("src_text_pdf", """
    WITH t AS (SELECT page_id, regexp_replace(regexp_replace(html, '<[^>]*>', '', 'g'), '[ \\t\\n\\r\\f]', '', 'g') AS layer FROM pages UNION ALL SELECT -page_id - 1, '' FROM pages WHERE page_id % 10 = 0)
    SELECT page_id, CASE WHEN layer = '' THEN 'unsupported/no_text_layer' ELSE 'succeeded' END AS status, length(layer)::INT AS chars FROM t""")
def src_text_pdf(spark, d):
    """Status by the text of the whole page without its tags; for every tenth page, one with tags alone as well."""
    pages = table(spark, d, "pages").select("page_id", "html")
    bare = pages.filter("page_id % 10 = 0").select((-F.col("page_id") - 1).alias("page_id"), F.array_join(F.regexp_extract_all("html", F.lit("<[^>]*>"), F.lit(0)), "\n ").alias("html"))
    layer = F.regexp_replace(F.regexp_replace("html", "<[^>]*>", ""), r"[ \t\n\r\f]", "")
    return pages.unionByName(bare).select("page_id", F.when(layer == "", "unsupported/no_text_layer").otherwise("succeeded").alias("status"), F.length(layer).alias("chars"))


@register("src_synth", """
    SELECT lang || '-' || n AS id, CASE WHEN n % 10 < CASE WHEN lang IN ('en', 'de') THEN 6 ELSE 7 END THEN 'dev' ELSE 'holdout' END AS split, n % 10 < 2 AS pilot
    FROM (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS n FROM documents)""")
def src_synth(spark, d):
    """Pages of each category in tens: the first six or seven for development, the rest held out, the first two a pilot."""
    rows = table(spark, d, "documents").select("lang", (F.row_number().over(Window.partitionBy("lang").orderBy("doc_id")) - 1).alias("n"))
    dev = F.when(F.col("lang").isin("en", "de"), 6).otherwise(7)
    return rows.select(F.concat_ws("-", "lang", "n").alias("id"), F.when(F.col("n") % 10 < dev, "dev").otherwise("holdout").alias("split"), (F.col("n") % 10 < 2).alias("pilot"))


@register("src_synth_text", """
    WITH h AS (SELECT p_partkey AS id, ('0x' || substr(md5('a' || p_partkey), 1, 8))::BIGINT AS a, ('0x' || substr(md5('b' || p_partkey), 1, 8))::BIGINT AS b, ('0x' || substr(md5('m' || p_partkey), 1, 8))::BIGINT AS m FROM part)
    SELECT id, ['revenue', 'cost', 'margin'][a % 3 + 1] || ' ' || ['rose', 'fell'][b % 2 + 1] || ' to ' || format('{:,.2f}', (m % 10000000 / 100)::DOUBLE) AS sentence FROM h""")
def src_synth_text(spark, d):
    """Sentences and amounts that depend on their key alone."""
    digest = lambda salt: F.conv(F.substring(F.md5(F.concat(F.lit(salt), "p_partkey").cast("binary")), 1, 8), 16, 10).cast("long")
    pick = lambda words, salt: F.element_at(F.array(*map(F.lit, words)), (1 + digest(salt) % len(words)).cast("int"))
    money = F.format_number(digest("m") % 10_000_000 / 100, 2)
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.concat_ws(" ", pick(("revenue", "cost", "margin"), "a"), pick(("rose", "fell"), "b"), F.lit("to"), money).alias("sentence"))


ORDERS = """
    o AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 11 = 0 THEN 'not a price' WHEN o_orderkey % 2 = 0 THEN format('{:,.2f}', o_totalprice::DOUBLE) ELSE printf('%.2f', o_totalprice::DOUBLE) END AS price, o_orderkey % 7 = 0 AS bad, o_orderkey % 11 = 0 AS failed FROM orders)"""


def _orders_csv(spark, d) -> str:
    """All orders as CSV files: every second price with group commas, every eleventh none, every seventh row with a field too many."""
    k, path = F.col("o_orderkey"), shared_dir(spark, "orders")
    price = F.when(k % 11 == 0, "not a price").when(k % 2 == 0, F.concat(F.lit('"'), F.format_number(F.col("o_totalprice").cast("double"), 2), F.lit('"'))).otherwise(F.format_string("%.2f", F.col("o_totalprice").cast("double")))
    line = F.concat_ws(",", k, price, F.lpad((k % 1000).cast("string"), 6, "0"), F.when(k % 5 == 0, "").otherwise("2024-01-31"), F.when(k % 7 == 0, "extra,field"))
    rows = table(spark, d, "orders").select(line.alias("value"))
    rows.write.text(f"{path}/rows")
    # a header stands at the head of every file
    files = spark.read.text(f"{path}/rows").withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.spark_partition_id())
    heads = files.select("part").distinct().select("part", F.lit(-1).cast("long").alias("at"), F.lit("key,price,code,day").alias("value"))
    files.select("part", "at", "value").unionByName(heads).repartition("part").sortWithinPartitions("part", "at").select("part", "value").write.partitionBy("part").text(f"{path}/files")
    return f"{path}/files/*"


@register("src_tabular", f"""
    WITH {ORDERS}, g AS (SELECT *, NOT bad AS good FROM o)
    SELECT 'key' AS name, 'bigint' AS type, count(*)::BIGINT AS rows, count(*)::BIGINT AS "values", 0::BIGINT AS without, 0::BIGINT AS failed, '' AS warnings FROM g WHERE good
    UNION ALL SELECT 'price', 'decimal(12,2)', count(*), count(*), 0, count(*) FILTER (failed), 'thousands separators; values of several kinds' FROM g WHERE good
    UNION ALL SELECT 'code', 'string', count(*), count(*), 0, 0, 'leading zeros' FROM g WHERE good
    UNION ALL SELECT 'day', 'date', count(*), count(*) FILTER (k % 5 <> 0), count(*) FILTER (k % 5 = 0), 0, '' FROM g WHERE good""")
def src_tabular(spark, d):
    """From the design specification: the import report of all orders, with the price's type given and the others inferred."""
    _, report = tabular.import_csv(spark, _orders_csv(spark, d), {"price": "decimal(12,2)", "key": "bigint"})
    return report.withColumn("warnings", F.array_join("warnings", "; "))


@register("src_preview", f"""
    WITH {ORDERS} SELECT count(*)::BIGINT AS rows, count(*) FILTER (bad)::BIGINT AS bad_rows, count(*) FILTER (failed AND NOT bad)::BIGINT AS failed_rows,
      sum(CASE WHEN NOT bad AND NOT failed THEN replace(price, ',', '')::DECIMAL(12,2) END)::DECIMAL(22,2) AS total, 0::BIGINT AS repeats FROM o""")
def src_preview(spark, d):
    """From the design specification: counts of all rows, the sum of what could be read, and row numbers that repeat in a file or leave a gap."""
    rows, _ = tabular.import_csv(spark, _orders_csv(spark, d), {"price": "decimal(12,2)"})
    gaps = rows.groupBy("_source").agg((F.max("_row") - F.countDistinct("_row")).alias("gap")).agg(F.sum("gap").alias("repeats"))
    total = rows.agg(F.sum("price").alias("total"))
    return tabular.preview(rows)[1].join(F.broadcast(total)).join(F.broadcast(gaps))  # a row each


@register("flt_transform", "SELECT o_orderpriority, sum(o_totalprice::DECIMAL(18,2))::DECIMAL(28,2) AS total, count(o_orderkey)::BIGINT AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1")
def flt_transform(spark, d):
    """From the design specification: a list of structured steps."""
    steps = [
        {"step": "filter", "column": "o_orderstatus", "op": "=", "value": "F"}, {"step": "cast", "column": "o_totalprice", "type": "decimal(18,2)"}, {"step": "select", "columns": ["o_orderpriority", "o_totalprice", "o_orderkey"]},
        {"step": "group", "by": ["o_orderpriority"], "aggregates": [{"function": "sum", "column": "o_totalprice", "as": "total"}, {"function": "count", "column": "o_orderkey", "as": "n"}]},
    ]
    return transform.transform(table(spark, d, "orders"), steps)


@register("jn_transform", "SELECT count(DISTINCT o_orderkey)::BIGINT AS rows_before, count(l_orderkey)::BIGINT AS rows_after, (SELECT max(n) FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey))::BIGINT AS most_per_key FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey")
def jn_transform(spark, d):
    return transform.inflation(table(spark, d, "orders").select(F.col("o_orderkey").alias("k")), table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k")), ["k"])


@register("jn_reconcile", """
    WITH l AS (SELECT o_orderkey AS k, count(*) AS n, sum(o_totalprice::DECIMAL(18,2)) AS a FROM orders WHERE o_orderkey % 11 <> 0 GROUP BY 1),
    r AS (SELECT l_orderkey AS k, count(*) AS n, sum(l_extendedprice::DECIMAL(18,2)) AS a FROM lineitem GROUP BY 1)
    SELECT CASE WHEN l.n IS NULL THEN 'missing_left' WHEN r.n IS NULL THEN 'missing_right' WHEN l.n > 1 OR r.n > 1 THEN 'duplicate' WHEN abs(l.a - r.a) <= 0.01 THEN 'matched' ELSE 'different' END AS status, count(*)::BIGINT AS keys,
           sum(coalesce(l.a, 0))::DECIMAL(38,2) AS left_amount FROM l FULL JOIN r USING (k) GROUP BY 1""")
def jn_reconcile(spark, d):
    left = table(spark, d, "orders").filter("o_orderkey % 11 <> 0").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("a"))
    right = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_extendedprice").alias("a"))
    return transform.reconcile(left, right, ["k"], "a").groupBy("status").agg(F.count("*").alias("keys"), F.sum(F.coalesce("left_amount", F.lit(0))).cast("decimal(38,2)").alias("left_amount"))


@register("ag_group", "SELECT o_custkey, top, o_orderkey::VARCHAR AS source FROM orders JOIN (SELECT o_custkey, max(o_totalprice) AS top FROM orders GROUP BY 1) USING (o_custkey)")
def ag_group(spark, d):
    """Groups with the rows that contributed to them, a row each."""
    steps = [{"step": "group", "by": ["o_custkey"], "aggregates": [{"function": "max", "column": "o_totalprice", "as": "top"}]}]
    out, links = transform.traced(table(spark, d, "orders").withColumn(transform.LINEAGE, F.col("o_orderkey")), steps)
    return out.join(links, transform.LINEAGE).select("o_custkey", "top", F.col("_source").alias("source"))


@register("dedupe_report", "SELECT count(*)::BIGINT AS before, count(DISTINCT text)::BIGINT AS after FROM documents")
def dedupe_report(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    kept = transform.transform(docs, [{"step": "deduplicate", "by": ["h"], "order": "doc_id"}])
    return docs.select(F.lit(1).alias("b"), F.lit(0).alias("a")).unionByName(kept.select(F.lit(0).alias("b"), F.lit(1).alias("a"))).agg(F.sum("b").alias("before"), F.sum("a").alias("after"))


def _queries(spark, d):
    return table(spark, d, "embeddings").filter("vec_id % 100 = 0")


COSINE = """
    q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS q, label AS ql FROM embeddings WHERE vec_id % 100 = 0),
    s AS (SELECT query_id, ql, vec_id AS id, label, round(list_inner_product(q, embedding::DOUBLE[]) / (sqrt(list_inner_product(q, q)) * sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]))), 9) AS score FROM q JOIN embeddings ON vec_id <> query_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s)"""


@register("vec_cosine", f"WITH {COSINE} SELECT query_id, id, round(score, 6) AS score, rank::INT AS rank FROM r WHERE rank <= 8")
def vec_cosine(spark, d):
    """From the design specification: exact scan for a stated set of queries; a top-k report."""
    return retrieval.cosine_ranks(_queries(spark, d), table(spark, d, "embeddings"), top=retrieval.TOP).select("query_id", "id", F.round("score", 6).alias("score"), "rank")


@register("wn_rank_rrf", f"""
    WITH {COSINE},
    o AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY id) AS rank FROM s WHERE label = ql),
    f AS (SELECT query_id, id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM (SELECT query_id, id, rank FROM r WHERE rank <= 100 UNION ALL SELECT * FROM o WHERE rank <= 100) GROUP BY 1, 2)
    SELECT query_id, id, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM f) WHERE rank <= 8""")
def wn_rank_rrf(spark, d):
    """Fusion of the 100 nearest and the first 100 of the same label."""
    vectors, queries = table(spark, d, "embeddings"), _queries(spark, d)
    first = retrieval.cosine_ranks(queries, vectors)
    of_label = Window.partitionBy("label").orderBy("vec_id")
    leading = vectors.withColumn("n", F.row_number().over(of_label)).filter(F.col("n") <= retrieval.DEPTH + 1).select("label", F.col("vec_id").alias("id"))
    second = queries.select(F.col("vec_id").alias("query_id"), "label").join(leading, "label").filter("id <> query_id")
    second = second.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("id"))).filter(F.col("rank") <= retrieval.DEPTH)
    return retrieval.fuse([first, second]).select("query_id", "id", "rank")


@register("ag_ir_metrics", f"""
    WITH {COSINE},
    t AS (SELECT query_id, count(*) AS total FROM s WHERE label = ql GROUP BY 1),
    h AS (SELECT query_id, count(*) FILTER (rank <= 5) AS found, sum(CASE WHEN rank <= 10 THEN 1 / log2(rank + 1.0) ELSE 0 END) AS dcg FROM r WHERE label = ql GROUP BY 1)
    SELECT t.query_id, round(coalesce(found, 0)::DOUBLE / total, 6) AS recall_5, round(coalesce(dcg, 0) / list_sum(list_transform(range(1, least(total, 10) + 1), lambda i: 1 / log2(i + 1.0))), 6) AS ndcg_10 FROM t LEFT JOIN h USING (query_id)""")
def ag_ir_metrics(spark, d):
    """Relevant are the others of a query's label."""
    vectors, queries = table(spark, d, "embeddings"), _queries(spark, d)
    label = queries.select(F.col("vec_id").alias("query_id"), F.col("label").alias("ql"))
    sizes = vectors.groupBy(F.col("label").alias("ql")).agg((F.count("*") - 1).alias("total"))
    ranks = retrieval.cosine_ranks(queries, vectors, top=10).join(vectors.select(F.col("vec_id").alias("id"), "label"), "id").join(label, "query_id")
    return retrieval.retrieval_metrics(ranks, F.col("label") == F.col("ql"), label.join(sizes, "ql").select("query_id", "total"))
