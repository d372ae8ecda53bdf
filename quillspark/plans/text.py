"""Queries over the text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as t
from ..operators.spans import near_spans
from ..sources.media import wrapped
from .registry import register
from .tables import sql_literal, sql_values, table

WIDE_DIGITS = "０１２３４５６７８９"
SQL_SPACES = r"[\s\p{Z}\x{85}\x{1c}-\x{1f}\v]+"


def sql_narrow(x: str) -> str:
    return f"translate({x}, {sql_literal(t.WIDE)}, {sql_literal(t.NARROW)})"


def sql_normal(x: str) -> str:
    return f"regexp_replace({sql_narrow(x)}, '{SQL_SPACES}', '', 'g')"


@register("txt_normalize", f"""
    WITH w AS (SELECT doc_id, translate(text, '0123456789', '{WIDE_DIGITS}') AS text FROM documents)
    SELECT doc_id, length(n)::INT AS chars, sha256(n) AS digest FROM (SELECT doc_id, {sql_normal('text')} AS n FROM w)""")
def txt_normalize(spark, d):
    n = t.normalize(t.widen_digits(F.col("text")))
    return table(spark, d, "documents").select("doc_id", F.length(n).alias("chars"), F.sha2(n, 256).alias("digest"))


@register("txt_fullwidth", f"SELECT doc_id, sha256(translate(text, '0123456789', '{WIDE_DIGITS}')) AS digest FROM documents")
def txt_fullwidth(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2(t.widen_digits(F.col("text")), 256).alias("digest"))


@register("txt_numbers", f"""
    SELECT doc_id, len(regexp_extract_all(replace({sql_narrow('text')}, ' ', ''), '{t.NUMBER}'))::INT AS n,
           array_to_string(regexp_extract_all(replace({sql_narrow('text')}, ' ', ''), '{t.NUMBER}'), '|') AS tokens FROM documents""")
def txt_numbers(spark, d):
    n = t.numbers(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.size(n).alias("n"), F.array_join(n, "|").alias("tokens"))


@register("pred_number_whole", f"""
    WITH a AS (SELECT doc_id, {sql_normal('text')} AS n, unnest(list_distinct(regexp_extract_all(text, '[0-9][0-9.,]*'))) AS tok FROM documents)
    SELECT doc_id, tok, regexp_matches(n, '(^|[^\\d.,])' || replace(tok, '.', '\\.') || '($|[^\\d.,%])') AS whole FROM a""")
def pred_number_whole(spark, d):
    """Every different number of a text against the whole text."""
    rows = table(spark, d, "documents").select("doc_id", "text", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("[0-9][0-9.,]*"), F.lit(0)))).alias("tok"))
    return rows.select("doc_id", "tok", t.whole_number(F.col("text"), F.col("tok")).alias("whole"))


def _passages(spark, d):
    """Each benchmark passage with the one of the next id."""
    own = table(spark, d, "benchmark").select("item_id", "text")
    return own.join(own.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("other")), "item_id")


PASSAGES = "p AS (SELECT a.item_id, a.text, b.text AS other FROM benchmark a JOIN benchmark b ON b.item_id = a.item_id + 1)"
FOLDED = f"{PASSAGES}, f AS (SELECT item_id, regexp_replace(text, '[^\\x00-\\x7f]', '?', 'g') AS a, regexp_replace(other, '[^\\x00-\\x7f]', '?', 'g') AS b FROM p)"


@register("txt_distance_folded", f"WITH {FOLDED} SELECT item_id, levenshtein(a, b)::INT AS edits, length(a)::INT AS chars FROM f")
def txt_distance_folded(spark, d):
    """Edits between whole passages, folded to ASCII as the SQL counts bytes."""
    a, b = t.ascii_fold(F.col("text")), t.ascii_fold(F.col("other"))
    return _passages(spark, d).select("item_id", F.levenshtein(a, b).alias("edits"), F.length(a).alias("chars"))


@register("txt_distance")
def txt_distance(spark, d):
    """Edits between whole passages, by characters."""
    return _passages(spark, d).select("item_id", F.levenshtein("text", "other").alias("edits"), F.length("text").alias("chars"))


@register("txt_cer_folded", f"WITH {FOLDED} SELECT (item_id % 4)::INT AS part, round(sum(levenshtein(a, b))::DOUBLE / sum(length(a)), 6) AS cer FROM f GROUP BY 1")
def txt_cer_folded(spark, d):
    a, b = t.ascii_fold(F.col("text")), t.ascii_fold(F.col("other"))
    rows = _passages(spark, d).select((F.col("item_id") % 4).cast("int").alias("part"), F.levenshtein(a, b).alias("e"), F.length(a).alias("n"))
    return rows.groupBy("part").agg(F.round(t.error_rate(F.col("e"), F.col("n")), 6).alias("cer"))


@register("txt_cer")
def txt_cer(spark, d):
    """Error rate of whole passages after normalising both."""
    a, b = t.normalize(F.col("text")), t.normalize(F.col("other"))
    rows = _passages(spark, d).select((F.col("item_id") % 4).cast("int").alias("part"), F.levenshtein(a, b).alias("e"), F.length(a).alias("n"))
    return rows.groupBy("part").agg(F.round(t.error_rate(F.col("e"), F.col("n")), 6).alias("cer"))


@register("txt_wer")
def txt_wer(spark, d):
    """Word error rate of each passage against the next."""
    a, b = F.split("text", r"\s+"), F.split("other", r"\s+")
    rows = _passages(spark, d).select("item_id", t.word_edits(a, b).alias("edits"), F.size(a).alias("words"))
    return rows.select("item_id", "edits", "words", F.round(F.try_divide(F.col("edits").cast("double"), "words"), 6).alias("wer"))


@register("txt_absent_share", f"WITH {PASSAGES} SELECT item_id, round(len(list_filter(string_split(text, ''), lambda x: NOT contains(other, x)))::DOUBLE / length(text), 6) AS absent FROM p")
def txt_absent_share(spark, d):
    return _passages(spark, d).select("item_id", F.round(t.absent_share(F.col("text"), F.col("other")), 6).alias("absent"))


@register("txt_join_cjk", """
    WITH p AS (SELECT conv_id, turn, trim(text, ' ') || CASE WHEN turn % 2 = 0 THEN '。' ELSE '' END AS s FROM conversations),
    l AS (SELECT conv_id, turn, s, lag(s) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM p WHERE s <> '')
    SELECT conv_id, sum(length(CASE WHEN before IS NULL OR right(before, 1) = '。' OR left(s, 1) = '。' THEN s ELSE ' ' || s END))::INT AS chars,
           sha256(string_agg(CASE WHEN before IS NULL OR right(before, 1) = '。' OR left(s, 1) = '。' THEN s ELSE ' ' || s END, '' ORDER BY turn)) AS digest FROM l GROUP BY conv_id""")
def txt_join_cjk(spark, d):
    """Whole turns in one transcript each; digests, as the results are long."""
    part = F.concat(F.trim(F.col("text")), F.when(F.col("turn") % 2 == 0, "。").otherwise(""))
    rows = table(spark, d, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", part.alias("s")))).alias("parts"))
    joined = rows.select("conv_id", t.join_transcript(F.col("parts.s")).alias("joined")).filter("joined <> ''")
    return joined.select("conv_id", F.length("joined").alias("chars"), F.sha2("joined", 256).alias("digest"))


@register("txt_hotwords", """
    WITH w AS (SELECT conv_id, turn, list_slice(string_split(text, ','), 1, 200) AS words FROM conversations),
    e AS (SELECT conv_id, turn, trim(left(trim(regexp_replace(regexp_replace(x, '\\s+', ' ', 'g'), '[\\p{C}]', '', 'g')), 40)) AS x FROM w, unnest(words) AS u(x))
    SELECT conv_id, turn, count(DISTINCT x) FILTER (x <> '')::INT AS n, coalesce(string_agg(DISTINCT x, '|' ORDER BY x) FILTER (x <> ''), '') AS words FROM e GROUP BY conv_id, turn""")
def txt_hotwords(spark, d):
    words = t.hotwords(F.split("text", ","))
    return table(spark, d, "conversations").select("conv_id", "turn", F.size(words).alias("n"), F.array_join(F.array_sort(words), "|").alias("words"))


@register("txt_upper_ascii", "SELECT doc_id, sha256(translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ')) AS digest FROM documents")
def txt_upper_ascii(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2(t.upper_ascii(F.col("text")), 256).alias("digest"))


VERSIONS = [
    ("5.17.0", ">=5.13.0", True), ("5.12.9", ">=5.13.0", False), ("1.5", ">=1.2,<2", True), ("2.0", ">=1.2,<2", False), ("1.2.3", "==1.2.*", True), ("1.3.0", "==1.2.*", False),
    ("1.4.2", "~=1.4", True), ("2.0", "~=1.4", False), ("2.11.0+cu128", ">=2.5", True), ("1.0rc1", ">=1.0", True), ("1.0", "===weird", False), ("", ">=1", False), ("0.1", "", True), ("1.0", "!=1.0.0", False),
]


@register("pred_version", sql_values("version, spec, ok", VERSIONS))
def pred_version(spark, d):
    """The golden cases; pred_version_parts has the operators over a table."""
    rows = spark.createDataFrame([r[:2] for r in VERSIONS], "version string, spec string")
    return rows.select("version", "spec", t.satisfies(F.col("version"), F.col("spec")).alias("ok"))


@register("pred_version_parts", """
    WITH v AS (SELECT p_partkey, p_partkey % 8 AS k, [p_size, p_partkey % 7, p_partkey % 3] AS a, [25, p_partkey % 5, 1] AS b FROM part)
    SELECT p_partkey, CASE k WHEN 0 THEN a >= b WHEN 1 THEN a <= b WHEN 2 THEN a > b WHEN 3 THEN a < b WHEN 4 THEN a = b WHEN 5 THEN a <> b WHEN 6 THEN a[1:2] = b[1:2] ELSE a >= b AND a[1:2] = b[1:2] END AS ok FROM v""")
def pred_version_parts(spark, d):
    """Versions of three numbers, some with a local part, against each kind of clause."""
    k = F.col("p_partkey")
    version = F.concat(F.concat_ws(".", "p_size", k % 7, k % 3), F.when(k % 5 == 0, "+cu128").otherwise(""))
    want = F.concat_ws(".", F.lit(25), k % 5, F.lit(1))
    ops = F.array(*map(F.lit, (">=", "<=", ">", "<", "==", "!=", "==", "~=")))
    spec = F.when(k % 8 == 6, F.concat(F.lit("=="), F.concat_ws(".", F.lit(25), k % 5), F.lit(".*"))).otherwise(F.concat(F.get(ops, (k % 8).cast("int")), want))
    return table(spark, d, "part").select("p_partkey", t.satisfies(version, spec).alias("ok"))


@register("txt_requirement", """
    SELECT p_partkey, replace(p_name, ' ', '_') AS name, CASE p_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN '>=' || p_size || '.0' WHEN 2 THEN '>=1,<' || (p_size + 1) ELSE '==' || p_size || '.*' END AS spec FROM part""")
def txt_requirement(spark, d):
    k, n = F.col("p_partkey") % 4, F.col("p_size")
    spec = F.when(k == 0, "").when(k == 1, F.concat(F.lit(" >="), n, F.lit(".0"))).when(k == 2, F.concat(F.lit(">=1, <"), n + 1)).otherwise(F.concat(F.lit(" == "), n, F.lit(".*")))
    raw = F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.when(F.col("p_partkey") % 3 == 0, "[standard,x]").otherwise(""), spec, F.when(F.col("p_partkey") % 5 == 0, " ; python_version > '3.9'").otherwise(""))
    return table(spark, d, "part").select("p_partkey", t.requirement(raw).alias("r")).select("p_partkey", "r.name", "r.spec")


@register("txt_pkg_norm", "SELECT p_partkey, lower(regexp_replace(p_name, '[-_.]+', '-', 'g')) AS norm FROM (SELECT p_partkey, replace(p_name, ' ', '._') AS p_name FROM part)")
def txt_pkg_norm(spark, d):
    return table(spark, d, "part").select("p_partkey", t.package_name(F.replace("p_name", F.lit(" "), F.lit("._"))).alias("norm"))


@register("txt_torch_variant", """
    SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'nvidia' WHEN 1 THEN 'amd' WHEN 2 THEN 'cpu' ELSE 'unknown' END AS variant FROM part""")
def txt_torch_variant(spark, d):
    k = F.col("p_partkey") % 4
    local = F.when(k == 0, F.concat(F.lit("+cu1"), "p_size")).when(k == 1, F.concat(F.lit("+rocm7."), "p_size")).when(k == 2, "+cpu").otherwise("")
    return table(spark, d, "part").select("p_partkey", t.build_variant(F.concat(F.lit("2."), "p_size", local)).alias("variant"))


@register("txt_model_name", """
    WITH m AS (SELECT p_partkey, replace(p_name, ' ', '-') || '-' || p_size || '.5B' AS leaf FROM part)
    SELECT p_partkey, lower(leaf) AS name FROM m""")
def txt_model_name(spark, d):
    """Repository paths of one to three parts, with and without a suffix and a trailing slash."""
    k, leaf = F.col("p_partkey"), F.concat(F.replace("p_name", F.lit(" "), F.lit("-")), F.lit("-"), "p_size", F.lit(".5B"))
    path = F.concat(F.when(k % 3 == 0, "").when(k % 3 == 1, "Org/").otherwise("a/Org/"), leaf, F.when(k % 2 == 0, "-HF").otherwise(""), F.when(k % 5 == 0, "/").otherwise(""))
    return table(spark, d, "part").select("p_partkey", t.model_name(path).alias("name"))


@register("txt_split_raw", """
    WITH r AS (SELECT doc_id, left(lang, 40) AS lang, trim(replace(replace(replace(text, '<|im_end|>', ''), '<|endoftext|>', ''), '</s>', ''), ' ') AS text FROM documents)
    SELECT doc_id, lang, length(text)::INT AS chars, sha256(text) AS digest FROM r""")
def txt_split_raw(spark, d):
    raw = F.concat(F.lit(" language "), F.col("lang"), F.lit("<asr_text> "), F.col("text"), F.lit("<|im_end|></s>"))
    rows = table(spark, d, "documents").select("doc_id", t.split_transcript(raw).alias("r"))
    return rows.select("doc_id", "r.lang", F.length("r.text").alias("chars"), F.sha2("r.text", 256).alias("digest"))


@register("txt_printable", """
    SELECT doc_id, CASE WHEN p = '' THEN '-' ELSE p END AS token FROM (SELECT doc_id, left(regexp_replace(text, '[\\p{C}]', '', 'g'), 60) AS p FROM documents)""")
def txt_printable(spark, d):
    return table(spark, d, "documents").select("doc_id", t.printable(F.col("text")).alias("token"))


@register("txt_wheel_tag", """
    SELECT p_partkey, 'cp310' || CASE WHEN p_partkey % 2 = 1 THEN '.cp311' ELSE '' END || CASE WHEN p_partkey % 3 = 2 THEN '.cp312' WHEN p_partkey % 3 = 1 AND p_partkey % 2 = 0 THEN '.cp311' ELSE '' END || '-cp310.abi3-linux.any' AS tag FROM part""")
def txt_wheel_tag(spark, d):
    k = F.col("p_partkey")
    tags = F.array(F.lit("cp310-cp310-linux"), F.concat(F.lit("cp31"), k % 2, F.lit("-abi3-linux")), F.concat(F.lit("cp31"), k % 3, F.lit("-abi3-any")))
    return table(spark, d, "part").select("p_partkey", t.distinct_tags(tags).alias("tag"))


ALIASES = {"gpu": "cuda", "nvidia": "cuda", "cuda": "cuda", "amd": "rocm", "rocm": "rocm", "cpu": "cpu", "auto": "auto"}


@register("txt_pref_alias", "SELECT p_partkey, CASE p_brand WHEN 'Brand#1' THEN 'cuda' ELSE 'auto' END AS pref FROM part")
def txt_pref_alias(spark, d):
    known = F.create_map(*[F.lit(x) for kv in (ALIASES | {"brand#1": "cuda"}).items() for x in kv])
    return table(spark, d, "part").select("p_partkey", F.coalesce(F.try_element_at(known, F.lower(F.trim("p_brand"))), F.lit("auto")).alias("pref"))


@register("txt_modeling_unit", """
    WITH t AS (SELECT l_suppkey AS model, CASE WHEN l_suppkey % 3 = 0 OR l_suppkey % 3 = 2 AND l_partkey % 2 = 0 THEN chr(19968 + (l_partkey % 20000)::INT) ELSE '▁' || l_returnflag || l_linestatus || CASE WHEN l_suppkey % 2 = 0 THEN 'x' ELSE '' END END AS token FROM lineitem),
    c AS (SELECT model, bool_or(regexp_matches(token, '[一-鿿]')) AS cjk, bool_or(NOT regexp_matches(token, '[一-鿿]')) AS other, bool_or(regexp_matches(token, '[A-Z]')) AS up, bool_or(regexp_matches(token, '[a-z]')) AS low FROM t GROUP BY model)
    SELECT model, CASE WHEN cjk AND other THEN 'cjkchar+bpe' WHEN cjk THEN 'cjkchar' ELSE 'bpe' END AS unit, up AND NOT low AS upper_only FROM c""")
def txt_modeling_unit(spark, d):
    """Units of models from their token tables: characters, word pieces or both; and whether letters are all upper case."""
    m, k = F.col("l_suppkey"), F.col("l_partkey")
    token = F.when((m % 3 == 0) | (m % 3 == 2) & (k % 2 == 0), F.decode(F.unhex(F.hex(19968 + k % 20000)), "UTF-16BE")).otherwise(F.concat(F.lit("▁"), "l_returnflag", "l_linestatus", F.when(m % 2 == 0, "x").otherwise("")))
    has = lambda test: F.bool_or(test)
    is_cjk = F.col("token").rlike("[一-鿿]")
    rows = table(spark, d, "lineitem").select(m.alias("model"), token.alias("token")).groupBy("model").agg(has(is_cjk).alias("cjk"), has(~is_cjk).alias("other"), has(F.col("token").rlike("[A-Z]")).alias("up"), has(F.col("token").rlike("[a-z]")).alias("low"))
    return rows.select("model", t.modeling_unit(F.col("cjk"), F.col("other")).alias("unit"), (F.col("up") & ~F.col("low")).alias("upper_only"))


@register("txt_format_bytes", """
    WITH b AS (SELECT doc_id, n_chars * 7919 AS n FROM documents)
    SELECT doc_id, CASE WHEN n >= 1073741824 THEN format('{:,.1f} GB', n / 1073741824.0::DOUBLE) WHEN n >= 1048576 THEN format('{:,.0f} MB', n / 1048576.0::DOUBLE)
           WHEN n >= 1024 THEN format('{:,.0f} KB', n / 1024.0::DOUBLE) ELSE n || ' B' END AS size FROM b""")
def txt_format_bytes(spark, d):
    return table(spark, d, "documents").select("doc_id", t.format_bytes(F.col("n_chars") * 7919).alias("size"))


@register("txt_format_duration", """
    SELECT doc_id, CASE WHEN n_chars >= 3600 THEN (n_chars // 3600) || ':' || lpad(((n_chars % 3600) // 60)::VARCHAR, 2, '0') ELSE ((n_chars // 60))::VARCHAR END || ':' || lpad((n_chars % 60)::VARCHAR, 2, '0') AS took FROM documents""")
def txt_format_duration(spark, d):
    return table(spark, d, "documents").select("doc_id", t.format_duration(F.col("n_chars")).alias("took"))


@register("txt_csv_guard", """
    WITH c AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN '=' WHEN 1 THEN '-' WHEN 2 THEN '@' ELSE '' END || CASE WHEN o_orderkey % 8 < 4 THEN o_orderpriority ELSE '12.5' END AS v FROM orders)
    SELECT o_orderkey, CASE WHEN regexp_matches(v, '^[=+\\-@\\t\\r]') AND NOT regexp_matches(v, '^[-+]?[0-9]+(\\.[0-9]+)?$') THEN '''' || v ELSE v END AS cell FROM c""")
def txt_csv_guard(spark, d):
    k = F.col("o_orderkey")
    lead = F.when(k % 4 == 0, "=").when(k % 4 == 1, "-").when(k % 4 == 2, "@").otherwise("")
    v = F.concat(lead, F.when(k % 8 < 4, F.col("o_orderpriority")).otherwise("12.5"))
    return table(spark, d, "orders").select("o_orderkey", t.guard_formula(v).alias("cell"))


@register("txt_bigram", """
    WITH w AS (SELECT conv_id, turn, list_concat(['合计', '计表'], regexp_extract_all(lower(text), '[a-z0-9]+')) AS terms FROM conversations)
    SELECT conv_id, turn, len(terms)::INT AS n, sha256(array_to_string(terms, '|')) AS digest FROM w""")
def txt_bigram(spark, d):
    terms = t.search_terms(F.concat(F.lit("合计表"), "text"))
    return table(spark, d, "conversations").select("conv_id", "turn", F.size(terms).alias("n"), F.sha2(F.array_join(terms, "|"), 256).alias("digest"))


@register("txt_specs_cli", """
    WITH s AS (SELECT n_regionkey, 'c' || n_regionkey AS component, CASE WHEN n_nationkey % 3 = 0 THEN 'streaming' ELSE 'offline' END AS kind, n_name FROM nation)
    SELECT component, kind, string_agg(n_name, '|' ORDER BY n_name) AS models FROM s GROUP BY 1, 2""")
def txt_specs_cli(spark, d):
    """Specifications such as a=x,streaming:y, one line a component."""
    k = F.col("n_nationkey") % 3
    item = F.concat(F.when(k == 0, "streaming:").when(k == 1, "offline:").otherwise(""), "n_name")
    lines = table(spark, d, "nation").groupBy("n_regionkey").agg(F.concat(F.lit("c"), "n_regionkey", F.lit("="), F.array_join(F.collect_list(item), ",")).alias("s"))
    each = lines.select(F.split_part("s", F.lit("="), F.lit(1)).alias("component"), F.explode(F.split(F.split_part("s", F.lit("="), F.lit(2)), ",")).alias("m"))
    kind = F.when(F.instr("m", ":") > 0, F.split_part("m", F.lit(":"), F.lit(1))).otherwise("offline")
    return each.groupBy("component", kind.alias("kind")).agg(F.array_join(F.array_sort(F.collect_list(F.element_at(F.split("m", ":"), -1))), "|").alias("models"))


@register("txt_best_span", """
    SELECT b.item_id, d.doc_id, 0::INT AS cost, (strpos(d.text, b.text) - 1)::INT AS start, (strpos(d.text, b.text) - 1 + length(b.text))::INT AS "end" FROM benchmark b JOIN documents d ON contains(d.text, b.text)""")
def txt_best_span(spark, d):
    """Whole passages in whole documents, with spans of up to a tenth of the passage's characters in edits.

    SQL knows exact hits alone; the tables hold no others, and tests hold near ones against brute force.
    """
    items = table(spark, d, "benchmark").select("item_id", F.col("text").alias("pattern"))
    return near_spans(table(spark, d, "documents"), items)


@register("txt_wrap")
def txt_wrap(spark, d):
    lines = table(spark, d, "benchmark").select("item_id", wrapped("text", 40).alias("lines"))
    return lines.select("item_id", F.posexplode("lines").alias("line", "text"))


@register("txt_mask", """
    SELECT doc_id, sha256(left(text, 3) || repeat('#', greatest(0, least(5, length(text) - 3))::INT) || substr(text, 9, 12) || repeat('#', greatest(0, least(10, length(text) - 20))::INT) || substr(text, 31)) AS digest FROM documents""")
def txt_mask(spark, d):
    """Two claimed spans of every text replaced, as far as the text goes."""
    n = F.length("text")
    spans = F.array(*(F.struct(F.least(F.lit(a), n).alias("start"), F.least(F.lit(b), n).alias("end")) for a, b in ((3, 8), (20, 30))))
    return table(spark, d, "documents").select("doc_id", F.sha2(t.masked(F.col("text"), spans, "#"), 256).alias("digest"))


@register("txt_bound", f"""
    WITH {FOLDED}
    SELECT item_id, (len(list_filter(string_split(a, ''), lambda x: NOT contains(b, x))) <= levenshtein(a, b)) AS holds, len(list_filter(string_split(a, ''), lambda x: NOT contains(b, x)))::INT AS absent FROM f""")
def txt_bound(spark, d):
    """Characters that the other passage lacks are a lower bound of the edits."""
    rows = _passages(spark, d).select("item_id", t.ascii_fold(F.col("text")).alias("a"), t.ascii_fold(F.col("other")).alias("b"))
    absent = F.round(t.absent_share(F.col("a"), F.col("b")) * F.length("a")).cast("int")
    return rows.select("item_id", (absent <= F.levenshtein("a", "b")).alias("holds"), absent.alias("absent"))


@register("set_missing_chars", f"""
    WITH {PASSAGES} SELECT item_id, array_to_string(list_sort(list_distinct(list_filter(string_split(text, ''), lambda x: NOT contains(other, x)))), '') AS chars FROM p""")
def set_missing_chars(spark, d):
    chars = F.array_except(F.split("text", ""), F.split("other", ""))
    return _passages(spark, d).select("item_id", F.array_join(F.array_sort(F.filter(chars, lambda x: x != "")), "").alias("chars"))


@register("lim_caps", """
    WITH c AS (SELECT doc_id, repeat(text, 8) AS x, n_chars * 100 AS size FROM documents)
    SELECT doc_id, length(left(x, 2000))::INT AS prompt, length(left(x, 40))::INT AS language, length(left(x, 4096))::INT AS model, CASE WHEN size > 26214400 THEN 413 ELSE 200 END::INT AS upload, CASE WHEN size > 1048576 THEN 413 ELSE 200 END::INT AS chunk,
           CASE WHEN size > 65536 THEN 413 ELSE 200 END::INT AS json, least(1024, greatest(64, size // 1000 * 20))::INT AS tokens FROM c""")
def lim_caps(spark, d):
    """Texts cut and bodies refused beyond their limits; tokens by seconds."""
    x, size = F.repeat("text", F.lit(8)), F.col("n_chars") * 100
    cuts = [F.length(t.cut(x, k)).alias(k) for k in ("prompt", "language", "model")]
    return table(spark, d, "documents").select("doc_id", *cuts, *(t.body_status(size, k).alias(k) for k in ("upload", "chunk", "json")), t.new_tokens(F.floor(size / 1000)).alias("tokens"))
