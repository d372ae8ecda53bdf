"""Helpers that queries share: reading tables and writing literals for both engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sql_literal(x) -> str:
    if x is None:
        return "NULL"
    if isinstance(x, bool):
        return str(x).upper()
    if isinstance(x, (list, tuple)):
        return "[" + ", ".join(map(sql_literal, x)) + "]"
    return str(x) if isinstance(x, (int, float)) else "'" + x.replace("'", "''") + "'"


def sql_values(names: str, rows: list[tuple]) -> str:
    """A SELECT of literal rows."""
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(sql_literal, r)) + ')' for r in rows)}) AS t({names})"
