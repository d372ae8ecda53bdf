"""Tables written to the folder that the cluster shares between the driver and its executors.

Files that more than one process needs go below ``spark.checkpoint.dir``.  A temporary folder is used
only where that setting is unset and Spark runs inside this one process (``local[...]``), as in tests.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder name below the shared folder; nothing is created yet."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        if app not in _LOCAL:
            _LOCAL[app] = tempfile.mkdtemp(prefix="quill-")
        base = _LOCAL[app]
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage and survives lost executors."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.quill_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes materialised tables that no later plan reads."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.quill_path)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def in_blocks(spark: SparkSession, rows: DataFrame, block: int, search: Callable[[list[tuple]], DataFrame], schema: str) -> DataFrame:
    """``search`` of each block of rows, appended to one folder, so that the plan read back has one scan however many blocks there are."""
    path = shared_dir(spark, "blocks")
    spark.createDataFrame([], schema).write.parquet(path)
    held: list[tuple] = []
    for r in rows.toLocalIterator():
        held.append(tuple(r))
        if len(held) == block:
            search(held).write.mode("append").parquet(path)
            held = []
    if held:
        search(held).write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)


def _file(spark: SparkSession, path: str) -> tuple:
    """File system and path of a file in any store that Spark reaches."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def create_text(spark: SparkSession, path: str, text: str) -> None:
    """Writes a small file that must not exist yet: of two writers one gets an error."""
    fs, p = _file(spark, path)
    stream = fs.create(p, False)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()


def read_text(spark: SparkSession, path: str) -> str:
    fs, p = _file(spark, path)
    stream = fs.open(p)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, in order; none if it doesn't exist."""
    fs, p = _file(spark, path)
    return sorted(x.getPath().getName() for x in fs.listStatus(p)) if fs.exists(p) else []


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _file(spark, path)
    fs.delete(p, True)
