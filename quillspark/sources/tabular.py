"""Tabular import, preview and export, and atomic publishing (import and export from the design specification)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.inference import KINDS, kind, least_type, typed
from ..functions.text import guard_formula, timestamp_ms
from ..storage import materialize

BAD = "_bad_record"


def read_rows(spark: SparkSession, path: str, columns: list[str], sep: str = ",", encoding: str = "UTF-8", header: bool = True) -> DataFrame:
    """Rows of delimited text files as texts, with _source (file), _row (from 1 within the file, without its header) and ``_bad_record``.

    Rows with other than the header's number of fields are kept, their whole text in ``_bad_record``.  Files are split as
    Spark splits them: a split's rows are numbered where they are read, and the sums of rows over the splits before
    it, which are few, are added.  A record is one line.
    """
    schema = T.StructType([*(T.StructField(c, T.StringType()) for c in columns), T.StructField(BAD, T.StringType())])
    options = {"header": header, "sep": sep, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD, "encoding": encoding, "enforceSchema": True, "nullValue": "\0", "emptyValue": ""}
    read = spark.read.options(**options).schema(schema).csv(path)
    split = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    rows = materialize(read.select(*columns, BAD, split.alias("_split"), F.monotonically_increasing_id().alias("_at")), "tabular-rows")
    splits = rows.groupBy("_split").agg(F.min("_at").alias("_first"), F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("_split.file").orderBy("_split.start")) - F.col("n")
    places = splits.select("_split", "_first", before.alias("_before"))
    out = rows.join(F.broadcast(places), "_split")  # a row a split of 128 MB
    return out.select(F.col("_split.file").alias("_source"), (F.col("_before") + F.col("_at") - F.col("_first") + 1).alias("_row"), *columns, BAD)


def header_of(spark: SparkSession, path: str, sep: str = ",", encoding: str = "UTF-8") -> list[str]:
    """Column names of the first file; repeated and empty ones get a number."""
    names = spark.read.options(header=True, sep=sep, encoding=encoding).csv(path).columns
    return [c if c and names.index(c) == i else f"{c or 'column'}_{i + 1}" for i, c in enumerate(names)]


def profile(rows: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """A row for each text column: inferred type, rows, values, missing, and warnings; counts merge over partitions in one aggregation."""
    columns = columns or [c for c in rows.columns if c not in (BAD, "_source", "_row")]
    names = [*KINDS, "text", "missing", "empty", "null"]
    each = rows.select(F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(c).alias("name"), F.col(c).alias("v")) for i, c in enumerate(columns)))).alias("c")).select("c.*")
    number = F.col("k").isin("integer", "decimal", "thousands")
    plain = F.regexp_replace("v", r"[^0-9.]", "")
    point = F.instr(plain, ".")
    digits = F.when(number, F.when(point > 0, point - 1).otherwise(F.length(plain)))
    scale = F.when(number, F.when(point > 0, F.length(plain) - point).otherwise(0))
    counted = each.withColumn("k", kind(F.col("v"))).groupBy("i", "name").agg(
        *(F.count_if(F.col("k") == x).alias(x) for x in names), F.coalesce(F.max(digits), F.lit(1)).alias("digits"), F.coalesce(F.max(scale), F.lit(0)).alias("scale"),
        F.count_if(F.contains("v", F.lit("\ufffd"))).alias("broken"), F.count_if(F.col("v") != F.trim("v")).alias("padded"))
    n = {x: F.col(x) for x in names}
    warn = lambda test, text: F.when(test, F.lit(text))
    several = lambda *kinds: sum((n[x] > 0).cast("int") for x in kinds) > 1
    warnings = F.array_compact(F.array(
        warn(n["zeros"] > 0, "leading zeros"), warn(n["thousands"] > 0, "thousands separators"), warn(n["percent"] > 0, "per cent signs"), warn(F.col("broken") > 0, "encoding"),
        warn(F.col("padded") > 0, "blanks around values"), warn((n["empty"] > 0) & (n["null"] > 0), "empty and null values"), warn(several("date", "timestamp"), "dates with and without time"),
        warn((n["text"] > 0) & (sum((n[x] for x in KINDS), F.lit(0)) > 0), "values of several kinds")))
    total = sum(n.values(), F.lit(0))
    return counted.select("name", least_type(n, F.col("digits"), F.col("scale")).alias("type"), total.alias("rows"), (total - n["missing"] - n["empty"] - n["null"]).alias("values"), (n["missing"] + n["empty"] + n["null"]).alias("without"), warnings.alias("warnings"))


def import_csv(spark: SparkSession, path: str, types: dict[str, str] | None = None, sep: str = ",", encoding: str = "UTF-8") -> tuple[DataFrame, DataFrame]:
    """Typed rows of delimited text files, and the report of their columns: what ``profile`` says, and the values that don't fit.

    Types that are not given are inferred from all rows that have the right number of fields.  Every row is kept: ``_bad_record``
    has the text of those that were no record, and ``_failed`` the names of the columns whose value did not fit.
    """
    columns = header_of(spark, path, sep, encoding)
    rows = materialize(read_rows(spark, path, columns, sep, encoding), "tabular-import")
    report = profile(rows.filter(F.col(BAD).isNull()), columns)
    given = {r.name: r.type for r in report.select("name", "type").collect()} | (types or {})  # a row a column
    given = {c: given.get(c, "string") for c in columns}
    here = lambda c: F.col(BAD).isNull() & ~kind(F.col(c)).isin("missing", "empty", "null")
    failed = F.array_compact(F.array(*(F.when(here(c) & typed(F.col(c), t).isNull(), F.lit(c)) for c, t in given.items())))
    out = rows.select("_source", "_row", *(F.when(F.col(BAD).isNull(), typed(F.col(c), t)).alias(c) for c, t in given.items()), BAD, failed.alias("_failed"))
    fits = out.select(F.explode("_failed").alias("name")).groupBy("name").agg(F.count("*").alias("failed"))
    known = spark.createDataFrame(list(given.items()), "name string, given string")
    report = report.join(F.broadcast(fits), "name", "left").join(F.broadcast(known), "name")
    return out, report.select("name", F.col("given").alias("type"), "rows", "values", "without", F.coalesce("failed", F.lit(0)).alias("failed"), "warnings")


def read_csv(spark: SparkSession, path: str, schema: str, sep: str = ",") -> DataFrame:
    """Rows of a known schema with their source file; rows that don't fit are kept, with their text in ``_bad_record``."""
    return spark.read.option("header", True).option("sep", sep).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", BAD).schema(f"{schema}, {BAD} string").csv(path).withColumn("_source", F.input_file_name())


def preview(df: DataFrame, n: int = 20) -> tuple[DataFrame, DataFrame]:
    """A look at the first rows by file and row number, and the counts of all rows, of bad ones, and of ones with failed values if they are known."""
    order = [c for c in ("_source", "_row") if c in df.columns]
    bad = F.count_if(F.col(BAD).isNotNull()) if BAD in df.columns else F.lit(0).cast("bigint")
    failed = [F.count_if(F.size("_failed") > 0).alias("failed_rows")] if "_failed" in df.columns else []
    return (df.orderBy(*order) if order else df).limit(n), df.agg(F.count("*").alias("rows"), bad.alias("bad_rows"), *failed)


def publish(df: DataFrame, path: str, replace: bool = False, kind: str = "json") -> None:
    """Writes a table in one commit; an existing target is an error unless it is to be replaced."""
    df.write.format(kind).mode("overwrite" if replace else "errorifexists").save(path)


def export_csv(df: DataFrame, path: str) -> None:
    """Writes text columns with formulas guarded, to a path that doesn't exist yet."""
    names = {c for c, k in df.dtypes if k == "string"}
    df.select(*(guard_formula(F.col(c)).alias(c) if c in names else c for c in df.columns)).write.option("header", True).mode("errorifexists").csv(path)


def append_journal(df: DataFrame, path: str) -> None:
    """Adds a table's rows to a journal of JSON lines, in one commit: a reader sees all of them or none."""
    df.write.mode("append").json(path)


def export(df: DataFrame, path: str, kind: str = "csv") -> DataFrame:
    """Writes a table to a path that doesn't exist yet, and the manifest of it below: format, columns, rows, digest of all rows.

    CSV has its text guarded against formulas; the manifest counts the texts that were.  Returns the manifest.
    """
    names = [c for c, k in df.dtypes if k == "string"]
    hit = sum((F.coalesce((guard_formula(F.col(c)) != F.col(c)).cast("int"), F.lit(0)) for c in names), F.lit(0)) if kind == "csv" else F.lit(0)
    if kind == "csv":
        export_csv(df, f"{path}/data")
    else:
        publish(df, f"{path}/data", kind=kind)
    digest = F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)"))
    made = df.agg(F.lit(kind).alias("format"), F.lit(",".join(df.columns)).alias("columns"), F.count("*").alias("rows"), F.coalesce(F.sum(hit), F.lit(0)).alias("guarded"), F.hex(F.xxhash64(digest)).alias("digest"))
    publish(made, f"{path}/manifest")
    return df.sparkSession.read.schema(made.schema).json(f"{path}/manifest")


SHEET = "<!doctype html><meta charset=utf-8><style>.diff{background:#fdd}.missing{background:#eee}</style><table>"


def escaped(c: Column) -> Column:
    """A text for HTML; null is empty."""
    out = F.coalesce(c.cast("string"), F.lit(""))
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def sheet_rows(rows: DataFrame, key: str, want: str, have: str) -> DataFrame:
    """key, class (ok, diff or missing) and html, a row of a comparison sheet for each row; nulls are missing."""
    kind = F.when(F.col(have).isNull(), "missing").when(F.col(want).eqNullSafe(F.col(have)), "ok").otherwise("diff")
    cells = F.concat(*(F.concat(F.lit("<td>"), escaped(F.col(c)), F.lit("</td>")) for c in (key, want, have)))
    return rows.select(key, kind.alias("class"), F.concat(F.lit('<tr class="'), kind, F.lit('">'), cells, F.lit("</tr>")).alias("html"))


def write_sheet(rows: DataFrame, path: str, key: str, want: str, have: str) -> None:
    """Comparison sheets of many rows: a file for each range of keys, each a page of its own; the path must not exist."""
    made = sheet_rows(rows, key, want, have).repartitionByRange(key).sortWithinPartitions(key).select(key, "html")

    def page(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        begun = False
        for frame in frames:
            yield pd.DataFrame({"value": ([] if begun else [SHEET]) + frame.html.tolist()})
            begun = True
        if begun:
            yield pd.DataFrame({"value": ["</table>"]})

    made.mapInPandas(page, "value string").write.mode("errorifexists").text(path)


def subtitles(rows: DataFrame, kind: str, key: str = "doc", first: str = "first_ms", last: str = "last_ms", text: str = "text", order: str = "no") -> DataFrame:
    """One text per ``key`` of its segments, in order: kind txt, json, srt or vtt."""
    comma = "," if kind == "srt" else "."
    span = lambda x: F.concat(timestamp_ms(x["a"], comma), F.lit(" --> "), timestamp_ms(x["b"], comma))
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(first).alias("a"), F.col(last).alias("b"), F.col(text).alias("t"))))
    held = rows.groupBy(key).agg(parts.alias("p"))
    if kind == "txt":
        body = F.array_join(F.transform("p", lambda x: x["t"]), "\n")
    elif kind == "json":
        body = F.to_json(F.transform("p", lambda x: F.struct(x["a"].alias("startMs"), x["b"].alias("endMs"), x["t"].alias("text"))))
    elif kind == "srt":
        body = F.array_join(F.transform("p", lambda x, i: F.concat((i + 1).cast("string"), F.lit("\n"), span(x), F.lit("\n"), x["t"], F.lit("\n"))), "\n")
    elif kind == "vtt":
        body = F.concat(F.lit("WEBVTT\n\n"), F.array_join(F.transform("p", lambda x: F.concat(span(x), F.lit("\n"), x["t"], F.lit("\n"))), "\n"))
    else:
        raise ValueError(f"no subtitles of kind {kind}")
    return held.select(key, body.alias("body"))


def same_content(a: DataFrame, b: DataFrame) -> bool:
    """Whether two inventories have as many files and bytes."""
    count = lambda x: tuple(x.agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0))).collect()[0])
    return count(a) == count(b)
