"""Queries over the decoders and readers, on bodies and files that are built from the tables."""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..functions.audio import mixed_down, pcm16_column
from ..operators.spans import raw_span
from ..sources import documents, media
from .registry import register
from .tables import sql_values, table


def _little(n, width):
    """A number's bytes, low byte first, as hexadecimal digits."""
    digits = F.lpad(F.hex(n.cast("long")), 16, "0")
    return F.concat(*(F.substring(digits, 15 - 2 * i, 2) for i in range(width)))


def _recordings(spark, d):
    """Every part as a WAV file of p_size hundredths of a second: 1, 2, 3 or 4 bytes a sample, one or two channels, 8 or 16 kHz; half the full amplitude."""
    k = F.col("p_partkey")
    width, channels, rate = 1 + k % 4, 1 + F.floor(k / 4) % 2, F.when(F.floor(k / 8) % 2 == 0, 16000).otherwise(8000)
    half = F.get(F.array(F.lit("C0"), F.lit("0040"), F.lit("000040"), F.lit("00000040")), (k % 4).cast("int"))
    frames = F.col("p_size") * rate / 100
    data = F.repeat(half, (frames * channels).cast("int"))
    size = frames * channels * width
    head = F.concat(F.lit("52494646"), _little(size + 36, 4), F.lit("57415645666D7420"), _little(F.lit(16), 4), _little(F.lit(1), 2), _little(channels, 2), _little(rate, 4), _little(rate * channels * width, 4), _little(channels * width, 2), _little(8 * width, 2), F.lit("64617461"), _little(size, 4))
    content = F.when(k % 11 == 0, F.lit("6A756E6B")).otherwise(F.concat(head, data))
    return table(spark, d, "part").select("p_partkey", F.unhex(content).alias("content"))


@register("src_wav_std", """
    SELECT p_partkey, CASE WHEN p_partkey % 11 = 0 THEN 'unsupported' ELSE 'ok' END AS status, CASE WHEN p_partkey % 11 <> 0 THEN p_size * 160 END::BIGINT AS samples, CASE WHEN p_partkey % 11 <> 0 THEN 0.5 END::DOUBLE AS peak FROM part""")
def src_wav_std(spark, d):
    """PCM of 8, 16, 24 and 32 bits, mixed down and resampled to 16 kHz; every eleventh is no WAV file."""
    return _recordings(spark, d).select("p_partkey", media.wav_frames("content").alias("r")).select("p_partkey", "r.status", "r.samples", F.round("r.peak", 6).alias("peak"))


@register("src_wav_strict", "SELECT p_partkey, CASE WHEN p_partkey % 11 = 0 THEN 'unsupported' ELSE 'ok' END AS status, CASE WHEN p_partkey % 11 <> 0 THEN p_size / 100.0 END::DOUBLE AS seconds FROM part")
def src_wav_strict(spark, d):
    return _recordings(spark, d).select("p_partkey", media.wav_frames("content", strict=True).alias("r")).select("p_partkey", "r.status", F.round("r.seconds", 6).alias("seconds"))


@register("src_soundfile", "SELECT p_partkey, 'unsupported' AS status FROM part")
def src_soundfile(spark, d):
    """Compressed audio is decoded by an optional library only; these are no valid files for it either, and every one is reported."""

    @F.pandas_udf("string")
    def status(values: pd.Series) -> pd.Series:
        out = []
        for v in values:
            try:
                media.decode_compressed(bytes(v))
                out.append("ok")
            except Exception:  # noqa: BLE001  the library has errors of its own
                out.append("unsupported")
        return pd.Series(out)

    content = F.concat(F.lit(b"fLaC"), F.col("p_name").cast("binary"))
    return table(spark, d, "part").select("p_partkey", status(content).alias("status"))


@register("aud_pcm16", "SELECT p_partkey, round(((p_partkey * 7919) % 65536 - 32768) / 32768.0::DOUBLE, 6) AS first, round(-(p_size::DOUBLE) / 32768, 6) AS last FROM part")
def aud_pcm16(spark, d):
    """Little-endian samples without leaving the engine."""
    raw = lambda n: _little(F.pmod(n, F.lit(65536)), 2)
    data = F.unhex(F.concat(raw(F.col("p_partkey") * 7919 % 65536 - 32768), raw(-F.col("p_size"))))
    rows = table(spark, d, "part").select("p_partkey", pcm16_column(data).alias("x"))
    return rows.select("p_partkey", F.round(F.get("x", F.lit(0)), 6).alias("first"), F.round(F.get("x", F.lit(1)), 6).alias("last"))


@register("aud_mixdown", """
    WITH f AS (SELECT l_orderkey, l_linenumber, min(l_partkey) AS part, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1 AS n FROM lineitem GROUP BY 1, 2)
    SELECT l_orderkey, (n // 2)::INT AS frame, sum(part)::DOUBLE / 2 AS mean FROM f GROUP BY 1, 2 HAVING count(*) = 2""")
def aud_mixdown(spark, d):
    """Means of two channels, the lines of an order in turn; a ragged tail is dropped."""
    lines = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("part")).groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "part"))).alias("x"))
    return lines.select("l_orderkey", F.posexplode(mixed_down(F.transform("x", lambda v: v["part"].cast("double")), 2)).alias("frame", "mean"))


@register("aud_resample", """
    SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_size * 2 ELSE round_even(p_size / 2.0, 0) END::BIGINT AS n, CASE WHEN p_partkey % 2 = 0 OR p_size > 2 THEN p_size - 1 END::DOUBLE AS last FROM part""")
def aud_resample(spark, d):
    """Ramps of p_size samples at 8 and 32 kHz; lengths are rounded half to even, and of more than one sample the last stays."""

    @F.pandas_udf("n long, last double")
    def run(rate: pd.Series, size: pd.Series) -> pd.DataFrame:
        out = [media.resample_linear(np.arange(n, dtype=np.float32), int(r)) for r, n in zip(rate, size, strict=True)]
        return pd.DataFrame({"n": [len(x) for x in out], "last": [float(x[-1]) if len(x) > 1 else None for x in out]})

    rate = F.when(F.col("p_partkey") % 2 == 0, 8000).otherwise(32000)
    return table(spark, d, "part").select("p_partkey", run(rate, "p_size").alias("r")).select("p_partkey", "r.n", "r.last")


def _forms(spark, d):
    """Every customer as a form body: a file whose data hold the mark, and a field."""
    head = F.concat(F.lit("--b\r\nContent-Disposition: form-data; name=\"file\"; filename*=UTF-8''%E4%B8%AD"), "c_custkey", F.lit(".wav\r\nContent-Type: audio/wav\r\n\r\n"))
    body = F.concat(head, F.repeat(F.lit("data --b inside "), (F.col("c_custkey") % 5).cast("int")), F.lit('\r\n--b\r\nContent-Disposition: form-data; name="language"\r\n\r\n'), "c_mktsegment", F.when(F.col("c_custkey") % 7 == 0, "").otherwise("\r\n--b--\r\n"))
    return table(spark, d, "customer").select("c_custkey", F.encode(body, "UTF-8").alias("body"), F.lit("b").alias("mark"))


@register("src_multipart", """
    SELECT c_custkey, 'file' AS name, '中' || c_custkey || '.wav' AS filename, 'audio/wav' AS content_type, (c_custkey % 5 * 16)::INT AS bytes FROM customer WHERE c_custkey % 7 <> 0
    UNION ALL SELECT c_custkey, 'language', NULL, '', strlen(c_mktsegment)::INT FROM customer WHERE c_custkey % 7 <> 0""")
def src_multipart(spark, d):
    """Parts of all bodies; those that are cut off have none."""
    rows = _forms(spark, d).select("c_custkey", media.form_parts("body", "mark").alias("r"))
    return rows.select("c_custkey", F.explode("r.parts").alias("p")).select("c_custkey", "p.name", "p.filename", "p.content_type", F.octet_length("p.data").alias("bytes"))


@register("sel_part", "SELECT c_custkey, CASE WHEN c_custkey % 7 <> 0 THEN c_mktsegment ELSE '' END AS language, '' AS file, '' AS none FROM customer")
def sel_part(spark, d):
    rows = _forms(spark, d).select("c_custkey", media.form_parts("body", "mark").alias("r"))
    parts = F.col("r.parts")
    first = lambda name: F.coalesce(media.first_field(parts, name), F.lit(""))
    return rows.select("c_custkey", first("language").alias("language"), first("file").alias("file"), first("x").alias("none"))


@register("src_chunked", """
    SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 OR length(p_name) + length(p_type) > 18 THEN 'error' ELSE p_name || p_type END AS result FROM part""")
def src_chunked(spark, d):
    """Bodies of two chunks under a limit of 18 bytes; every fifth is cut off."""

    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        def one(v):
            try:
                return media.decode_chunked(bytes(v), 18).decode()
            except ValueError:
                return "error"

        return values.map(one)

    size = lambda c: F.lower(F.hex(F.length(c)))
    body = F.concat(size("p_name"), F.lit("\r\n"), "p_name", F.lit("\r\n"), size("p_type"), F.lit(";x=1\r\n"), "p_type", F.when(F.col("p_partkey") % 5 == 0, "").otherwise("\r\n0\r\n\r\n"))
    return table(spark, d, "part").select("p_partkey", run(F.encode(body, "UTF-8")).alias("result"))


@register("txt_params", """
    SELECT s_suppkey, 'name' AS name, s_name || '"x' AS value FROM supplier UNION ALL SELECT s_suppkey, 'filename*', '中 ' || s_suppkey FROM supplier UNION ALL SELECT s_suppkey, 'q', s_nationkey::VARCHAR FROM supplier""")
def txt_params(spark, d):
    """Quoted, extended and plain parameters of headers."""

    @F.pandas_udf("map<string,string>")
    def run(values: pd.Series) -> pd.Series:
        return values.map(media.header_params)

    value = F.concat(F.lit('form-data; name="'), "s_name", F.lit("\\\"x\"; filename*=UTF-8''%E4%B8%AD%20"), "s_suppkey", F.lit("; q="), "s_nationkey")
    return table(spark, d, "supplier").select("s_suppkey", F.explode(run(value)).alias("name", "value"))


@register("src_docling", """
    WITH l AS (SELECT l_orderkey, l_linenumber, min(l_partkey) AS part, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS n FROM lineitem GROUP BY 1, 2)
    SELECT l_orderkey::VARCHAR AS page_id, 0::INT AS idx, 'order ' || l_orderkey AS text, 0.1::DOUBLE AS "left", 0.05::DOUBLE AS top, 0::INT AS spans FROM l GROUP BY l_orderkey
    UNION ALL SELECT l_orderkey::VARCHAR, n::INT, part::VARCHAR, NULL, NULL, 2 FROM l""")
def src_docling(spark, d):
    """Orders as layout trees: a group with a line of text, and a table whose cells span two columns and so come twice in the grid."""
    rows = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("part")).groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "part"))).alias("lines"))
    ref = lambda x: F.struct(F.lit(x).alias("$ref"))
    size = F.struct(F.struct(F.struct(F.lit(100).alias("width"), F.lit(200).alias("height")).alias("size")).alias("1"))
    box = F.struct(F.lit(10).alias("l"), F.lit(190).alias("t"), F.lit(50).alias("r"), F.lit(180).alias("b"), F.lit("BOTTOMLEFT").alias("coord_origin"))
    cell = lambda x: F.struct(x["l_linenumber"].alias("start_row_offset_idx"), F.lit(0).alias("start_col_offset_idx"), x["part"].cast("string").alias("text"), F.lit(1).alias("row_span"), F.lit(2).alias("col_span"))
    grid = F.transform("lines", lambda x: F.array(cell(x), cell(x)))
    raw = F.to_json(F.struct(
        size.alias("pages"), F.struct(F.array(ref("#/groups/0"), ref("#/tables/0")).alias("children")).alias("body"), F.array(F.struct(F.lit("#/groups/0").alias("self_ref"), F.array(ref("#/texts/0")).alias("children"))).alias("groups"),
        F.array(F.struct(F.lit("#/texts/0").alias("self_ref"), F.concat(F.lit("order "), "l_orderkey").alias("text"), F.array(F.struct(box.alias("bbox"))).alias("prov"))).alias("texts"),
        F.array(F.struct(F.lit("#/tables/0").alias("self_ref"), F.struct(grid.alias("grid")).alias("data"))).alias("tables")))
    found = documents.engine_blocks(rows.select(F.col("l_orderkey").cast("string").alias("page_id"), raw.alias("raw")), "tree")
    return found.select("page_id", "idx", "text", F.get("bbox", F.lit(0)).alias("left"), F.round(F.get("bbox", F.lit(1)), 6).alias("top"), F.coalesce("cell.colSpan", F.lit(0)).alias("spans"))


@register("src_jsonl", "SELECT conv_id::VARCHAR AS id, turn::INT AS n FROM conversations")
def src_jsonl(spark, d):
    """A journal for each conversation, all with a blank line and a last record that is cut off."""
    record = F.to_json(F.struct(F.col("conv_id").cast("string").alias("id"), F.col("turn").alias("n")))
    journals = table(spark, d, "conversations").groupBy("conv_id").agg(F.concat(F.array_join(F.collect_list(record), "\n\n"), F.lit('\n{"id": "cut')).alias("value"))

    def run(frames):
        for frame in frames:
            yield pd.DataFrame([(json.dumps(r),) for v in frame.value for r in documents.journal_records(v)], columns=["json"])

    return journals.select("value").mapInPandas(run, "json string").select(F.from_json("json", "id string, n int").alias("r")).select("r.*")


@register("src_inventory")
def src_inventory(spark, d):
    """All tables' files with sizes and digests."""
    return documents.inventory(spark, d)


@register("txt_span_map", """
    SELECT item_id, substr(regexp_replace(text, '\\s+', '', 'g'), length(regexp_extract(text, '^\\S*')) + 1, 1) AS after, left(regexp_extract(text, '\\S+'), 1) AS first FROM benchmark""")
def txt_span_map(spark, d):
    """Spans of normalised passages back to the raw text: the first character after a blank, and the very first."""
    rows = table(spark, d, "benchmark").select("item_id", "text", F.length(F.regexp_extract("text", r"^\S*", 0)).alias("a"))
    return rows.select("item_id", raw_span("text", "a", F.col("a") + 1).alias("after"), raw_span("text", F.lit(0), F.lit(1)).alias("first"))
