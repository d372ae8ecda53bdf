"""Structured table transforms, reconciliation and lineage (from the design specification).

Steps are data, not SQL text: columns must be in the registered schema and functions on the list below,
so nothing that a caller writes is ever parsed as an expression.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COMPARE = {"=": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}
AGGREGATES = {"sum": F.sum, "min": F.min, "max": F.max, "avg": F.avg, "count": F.count}
TYPES = ("string", "int", "bigint", "double", "boolean", "date", "timestamp")
LINEAGE = "_row"


class StepError(ValueError):
    """A step that names unknown columns, functions or types."""


def _known(df: DataFrame, *names: str) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise StepError(f"unknown columns {missing}")


def _condition(df: DataFrame, step: Mapping) -> Column:
    _known(df, step["column"])
    if step["op"] in ("is null", "is not null"):
        c = F.col(f"`{step['column']}`")
        return c.isNull() if step["op"] == "is null" else c.isNotNull()
    if step["op"] not in COMPARE:
        raise StepError(f"unknown comparison {step['op']!r}")
    return COMPARE[step["op"]](F.col(f"`{step['column']}`"), F.lit(step["value"]))


def transform(df: DataFrame, steps: Sequence[Mapping], tables: Mapping[str, DataFrame] | None = None) -> DataFrame:
    """Applies select, filter, cast, join, group and deduplicate steps in turn."""
    return traced(df, steps, tables)[0]


def traced(df: DataFrame, steps: Sequence[Mapping], tables: Mapping[str, DataFrame] | None = None) -> tuple[DataFrame, DataFrame | None]:
    """What ``transform`` gives, and its lineage: a table (_row of the result, _source row) if the input has a column ``_row`` and a step groups.

    The lineage has a row for each contributing row, so a group of any size is spread over tasks; steps that drop
    ``_row`` end it.  A group's ``_row`` is its keys as JSON.
    """
    links = None
    for step in steps:
        kind = step.get("step")
        if kind == "select":
            _known(df, *step["columns"])
            df = df.select(*(F.col(f"`{c}`") for c in step["columns"]))
        elif kind == "filter":
            df = df.filter(_condition(df, step))
        elif kind == "cast":
            _known(df, step["column"])
            if step["type"] not in TYPES and not (step["type"].startswith("decimal(") and step["type"][8:-1].replace(",", "").replace(" ", "").isdigit()):
                raise StepError(f"unknown type {step['type']!r}")
            df = df.withColumn(step["column"], F.col(f"`{step['column']}`").try_cast(step["type"]))
        elif kind == "join":
            if step["table"] not in (tables or {}):
                raise StepError(f"unknown table {step['table']!r}")
            other, keys = tables[step["table"]], list(step["on"])
            _known(df, *keys)
            _known(other, *keys)
            if step.get("how", "inner") not in ("inner", "left"):
                raise StepError("joins are inner or left")
            df = df.join(other, keys, step.get("how", "inner"))
        elif kind == "group":
            _known(df, *step["by"], *(a["column"] for a in step["aggregates"]))
            if any(a["function"] not in AGGREGATES for a in step["aggregates"]):
                raise StepError("unknown aggregate")
            keys = F.to_json(F.struct(*(F.col(f"`{c}`") for c in step["by"])), {"ignoreNullFields": "false"})
            if LINEAGE in df.columns:
                own = df.select(keys.alias("_to"), F.col(LINEAGE).cast("string").alias("_from"))
                through = links.select(F.col(LINEAGE).alias("_from"), "_source") if links is not None else None
                links = (own.join(through, "_from").select(F.col("_to").alias(LINEAGE), "_source") if links is not None else own.select(F.col("_to").alias(LINEAGE), F.col("_from").alias("_source")))
            grouped = df.groupBy(*step["by"]).agg(*(AGGREGATES[a["function"]](F.col(f"`{a['column']}`")).alias(a["as"]) for a in step["aggregates"]))
            df = grouped.withColumn(LINEAGE, keys) if LINEAGE in df.columns else grouped
        elif kind == "deduplicate":
            _known(df, *step["by"], step["order"])
            ranked = F.min_by(F.struct(*(F.col(f"`{c}`") for c in df.columns)), F.struct(F.col(f"`{step['order']}`"), *(F.col(f"`{c}`") for c in df.columns if c != step["order"])))
            df = df.groupBy(*step["by"]).agg(ranked.alias("_first")).select("_first.*")
        else:
            raise StepError(f"unknown step {kind!r}")
    if links is not None and LINEAGE in df.columns:
        links = links.join(df.select(LINEAGE), LINEAGE, "left_semi")
    return df, links


def inflation(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows before and after an inner join, and the most rows a key has on the right, without joining rows."""
    a, b = left.groupBy(*keys).agg(F.count("*").alias("n")), right.groupBy(*keys).agg(F.count("*").alias("m"))
    both = a.join(b, list(keys), "left")
    return both.agg(F.sum("n").alias("rows_before"), F.sum(F.col("n") * F.coalesce("m", F.lit(0))).alias("rows_after"), F.coalesce(F.max("m"), F.lit(0)).alias("most_per_key"))


def reconcile(left: DataFrame, right: DataFrame, keys: Sequence[str], amount: str, tolerance: str = "0.01", precision: str = "decimal(18,2)") -> DataFrame:
    """Status of every key of two datasets: matched, missing_left, missing_right, duplicate or different."""
    side = lambda df, p: df.groupBy(*keys).agg(F.count("*").alias(f"{p}_rows"), F.sum(F.col(amount).cast(precision)).alias(f"{p}_amount"))
    both = side(left, "left").join(side(right, "right"), list(keys), "full")
    gap = F.abs(F.col("left_amount") - F.col("right_amount"))
    status = (
        F.when(F.col("left_rows").isNull(), "missing_left").when(F.col("right_rows").isNull(), "missing_right")
        .when((F.col("left_rows") > 1) | (F.col("right_rows") > 1), "duplicate").when(gap <= F.lit(tolerance).cast(precision), "matched").otherwise("different")
    )
    return both.withColumn("status", status)


def result_hash(df: DataFrame) -> DataFrame:
    """Row count and a hash of all rows that does not depend on their order."""
    return df.agg(F.count("*").alias("rows"), F.sum(F.xxhash64(*(F.col(f"`{c}`").cast("string") for c in sorted(df.columns))).cast("decimal(38,0)")).alias("hash"))
