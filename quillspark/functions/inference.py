"""Types of text columns, from counts that merge over partitions (from the design specification).

A value is of the first kind below that its whole text fits.  A column's type is the least kind above those of all
its values: whole numbers lie below decimals, decimals below doubles, dates below timestamps, and text above all.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Texts that stand for no value. Fixed values.
NULLS = ("null", "NULL", "NA", "N/A", "nan", "NaN", "-")
#: Kind -> pattern of its whole text.
KINDS = {
    "boolean": r"(?i)true|false",
    "zeros": r"[-+]?0\d+",  # an identifier: as a number it would lose its zeros
    "integer": r"[-+]?\d{1,18}",
    "decimal": r"[-+]?(?:\d{1,28}\.\d{1,10}|\d{19,28})",
    "thousands": r"[-+]?\d{1,3}(?:,\d{3})+(?:\.\d{1,10})?",
    "percent": r"[-+]?\d{1,28}(?:\.\d{1,10})?%",
    "double": r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d{1,3})?",
    "date": r"\d{4}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01])",
    "timestamp": r"\d{4}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01])[T ]\d{2}:\d{2}(?::\d{2}(?:\.\d{1,6})?)?(?:Z|[-+]\d{2}:?\d{2})?",
}


def kind(c: Column) -> Column:
    """Kind of a value: missing (null), empty, null (a word for it), one of KINDS, or text."""
    text = F.trim(c)
    out = F.when(c.isNull(), "missing").when(text == "", "empty").when(text.isin(*NULLS), "null")
    for name, pattern in KINDS.items():
        out = out.when(text.rlike(f"^(?:{pattern})$"), name)
    return out.otherwise("text")


def least_type(n: dict[str, Column], digits: Column, scale: Column) -> Column:
    """Type above all kinds that were counted; ``digits`` and ``scale``: most digits before and behind the point."""
    has = lambda *kinds: sum((n[k] for k in kinds), F.lit(0)) > 0
    others = lambda *kinds: ~has(*(k for k in (*KINDS, "text") if k not in kinds))
    exact = F.concat(F.lit("decimal("), F.least(digits + scale, F.lit(38)).cast("string"), F.lit(","), scale.cast("string"), F.lit(")"))
    return (
        F.when(~has(*KINDS, "text"), "string").when(others("boolean"), "boolean").when(others("integer"), F.when(digits < 10, "int").otherwise("bigint"))
        .when(others("integer", "decimal", "thousands") & (digits + scale <= 38), exact).when(others("integer", "decimal", "thousands", "double"), "double")
        .when(others("date"), "date").when(others("date", "timestamp"), "timestamp").otherwise("string")
    )


def typed(c: Column, name: str) -> Column:
    """A text as a type, null where it can't be; thousands separators are dropped for numbers."""
    text = F.trim(c)
    empty = (text == "") | text.isin(*NULLS)
    if name == "string":
        return c
    if name in ("int", "bigint", "double") or name.startswith("decimal"):
        text = F.when(text.rlike(f"^(?:{KINDS['thousands']})$"), F.replace(text, F.lit(","), F.lit(""))).otherwise(text)
    return F.when(~empty, text.try_cast(name))
