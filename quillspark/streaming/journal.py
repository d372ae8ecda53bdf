"""A journal that a stream writes: each micro-batch is one folder, so one that is written again after a failure adds no row twice."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

BATCH = "_batch"


def write_journal(stream: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Starts a stream's writing to a journal of JSON lines; with the same checkpoint it goes on where it ended.

    A batch overwrites the folder of its own number, whatever a broken attempt left there.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").json(f"{path}/{BATCH}={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def read_journal(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All rows of a journal, with the number of the batch that wrote them."""
    return spark.read.schema(f"{schema}, {BATCH} long").json(path)
