"""Storage and Arrow helpers of the corpus operators; tables and folders are those of ``quillspark.storage``."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import discard, materialize, shared_dir

__all__ = ["bounded", "by_size", "discard", "fresh", "materialize", "open_store", "shared_dir", "strings", "uniform", "without"]

ARROW_BYTES = 8 << 20


def open_store(uri: str) -> tuple[pafs.FileSystem, str]:
    """Filesystem and path of a shared folder's URI, usable in executors (file, hdfs, s3, gs)."""
    if "://" in uri:
        return pafs.FileSystem.from_uri(uri)
    return pafs.LocalFileSystem(), uri.removeprefix("file:")


def strings(column: pa.Array | pa.ChunkedArray) -> list[str]:
    """Python strings of a column, null as the empty text."""
    return [x or "" for x in column.to_pylist()]


def by_size(batches: Iterator[pa.RecordBatch], column: str, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose ``column`` holds about ``most`` bytes, a single row at least."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        start, held = 0, 0
        for i, n in enumerate(sizes):
            if i > start and held + n > most:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        if start < len(sizes):
            yield batch.slice(start)


def bounded(f: Callable) -> Callable:
    """A query or stage that runs with Arrow batches of ARROW_BYTES at most, as executors' memory is shared with Python."""

    @functools.wraps(f)
    def run(spark: SparkSession, *args):
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)
        return f(spark, *args)

    return run


def uniform(*columns: str) -> F.Column:
    """A stable pseudo-random number in [0, 1) made from columns."""
    return F.pmod(F.xxhash64(*columns), F.lit(1 << 40)) / F.lit(float(1 << 40))


def fresh(df: DataFrame, name: str) -> str:
    """The name, with underscores before it as long as the table has such a column."""
    while name.lower() in {c.lower() for c in df.columns}:
        name = f"_{name}"
    return name


def without(df: DataFrame, *names: str) -> DataFrame:
    """The table without its columns of these names, which output columns will have."""
    return df.drop(*(c for c in df.columns if c.lower() in {n.lower() for n in names}))
