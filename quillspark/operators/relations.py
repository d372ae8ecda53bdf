"""Small relations between two tables, or between the rows of one, that reports and manifests are made of.

Rows: keys compare as in joins, so null keys match nothing; repeated rows count as often as they stand unless a
function says otherwise; empty tables give empty tables.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import materialize


def with_defaults(rows: DataFrame, found: DataFrame, keys: str | list[str], **defaults) -> DataFrame:
    """All rows with what was found for them; named columns get a default where nothing was found or it is null."""
    out = rows.join(found, keys, "left")
    return out.withColumns({c: F.coalesce(c, F.lit(x)) for c, x in defaults.items()}) if defaults else out


def unknown(rows: DataFrame, known: DataFrame, *keys: str) -> DataFrame:
    """Different keys of the rows that the other table does not have."""
    return rows.select(*keys).distinct().join(known.select(*keys), list(keys), "left_anti")


def excluded(rows: DataFrame, out: DataFrame, *keys: str) -> DataFrame:
    """Rows whose key the other table does not have."""
    return rows.join(out.select(*keys), list(keys), "left_anti")


def availability(rows: DataFrame, have: DataFrame, key: str, yes: str = "local", no: str = "missing") -> DataFrame:
    """All rows with ``status``: whether the other table has their key."""
    known = have.select(key).distinct().withColumn("_here", F.lit(True))
    return rows.join(known, key, "left").withColumn("status", F.when(F.col("_here"), yes).otherwise(no)).drop("_here")


def members(wanted: DataFrame, groups: DataFrame, rows: DataFrame, name: str, key: str, member: str) -> DataFrame:
    """(member, name) of all members of the groups wanted by name, and a row (name, null) for each name that is no group."""
    found = groups.join(wanted.select(name).distinct(), name).join(rows, key).select(F.col(member).alias("member"), name)
    return found.unionByName(unknown(wanted, groups, name).select(F.col(name).alias("member"), F.lit(None).cast(groups.schema[name].dataType).alias(name)))


def both_ways(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that one table has more often than the other, with ``side``: missing (of the first) or extra (of the second)."""
    return a.exceptAll(b).withColumn("side", F.lit("missing")).unionByName(b.exceptAll(a).withColumn("side", F.lit("extra")))


def first_of_equal(rows: DataFrame, content: Column, key: str) -> DataFrame:
    """The smallest key of each different content, told apart by its digest."""
    return rows.groupBy(F.sha2(content, 256).alias("_digest")).agg(F.min(key).alias(key)).drop("_digest")


def placed(rows: DataFrame, by: str | list[str], *order, name: str = "place") -> DataFrame:
    """All rows with their place within their group."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(by).orderBy(*order)))


def numbered(rows: DataFrame, *order, name: str = "place") -> DataFrame:
    """All rows with their place among all rows: sorted by ranges, numbered within each, and moved by the sums of those before it."""
    held = materialize(rows.orderBy(*order).select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_at")), "numbered")
    parts = held.groupBy("_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))  # a row a partition
    parts = parts.select("_part", "_first", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    return held.join(F.broadcast(parts), "_part").withColumn(name, (F.col("_before") + F.col("_at") - F.col("_first") + 1).cast("int")).drop("_part", "_at", "_first", "_before")


def largest_fitting(rows: DataFrame, by: str, size: str, limit: int, pick: str) -> DataFrame:
    """Of each group the pick of the largest size within a limit (ties: the greater pick), or the smallest pick if none fits."""
    fits = F.when(F.col(size) <= limit, F.struct(size, pick))
    return rows.groupBy(by).agg(F.coalesce(F.max(fits)[pick], F.min(pick)).alias("pick"))


def by_precedence(rows: DataFrame, by: str, rules: Iterable[tuple[Column, str]], default: str, name: str) -> DataFrame:
    """Of each group the value of the first rule that any of its rows meets."""
    out = F.lit(default)
    for rule, value in reversed(list(rules)):
        out = F.when(F.bool_or(F.coalesce(rule, F.lit(False))), value).otherwise(out)
    return rows.groupBy(by).agg(out.alias(name))


def changes(rows: DataFrame, by: str, order: list[str], value: str) -> DataFrame:
    """Rows whose value differs from that of the row before it in its group; the first of a group always does."""
    w = Window.partitionBy(by).orderBy(*order)
    return rows.withColumns({"_before": F.lag(value).over(w), "_n": F.row_number().over(w)}).filter((F.col("_n") == 1) | ~F.col("_before").eqNullSafe(F.col(value))).drop("_before", "_n")


def followed(rows: DataFrame, by: str, order: str, value: Column) -> DataFrame:
    """All rows with ``next`` (the order of the next row of its group) and ``longer``, whether the next row's value is greater; null at the end."""
    w = Window.partitionBy(by).orderBy(order)
    return rows.withColumns({"next": F.lead(order).over(w), "longer": value < F.lead(value).over(w)})


def beside(cells: DataFrame, row: str, column: str, value: str) -> DataFrame:
    """Pairs of neighbouring cells and how many of them rise, by ``side``: right and down; cells are unique."""
    side = lambda name, a, b: cells.select(F.lit(name).alias("side"), (F.lead(value).over(w := Window.partitionBy(a).orderBy(b)) > F.col(value)).alias("rises"), (F.lead(b).over(w) == F.col(b) + 1).alias("near"))
    pairs = side("right", row, column).unionByName(side("down", column, row)).filter("near")
    return pairs.groupBy("side").agg(F.count("*").alias("pairs"), F.count_if("rises").alias("rising"))
