"""Hybrid retrieval (from the design specification): exact cosine, term overlap, rank fusion, metrics."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import in_blocks

#: Constant of reciprocal rank fusion; the specification leaves it open.
FUSION = 60
TOP, MOST = 8, 20
#: Ranks kept of each list, and query vectors sent to the tasks at a time.
DEPTH, BLOCK = 100, 1024


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def cosine_ranks(queries: DataFrame, vectors: DataFrame, top: int = DEPTH) -> DataFrame:
    """The ``top`` best of all other vectors for each query: query_id, id, score, rank; ties to smaller ids.

    Queries go out in blocks of BLOCK vectors, each compared with all vectors in one pass; a task keeps the
    ``top`` best of each query, so what is ranked at the end grows with the tasks and not with the pairs.
    Rows with null vectors take no part; a vector without length has the score 0 with all.
    """
    spark = vectors.sparkSession
    rows = vectors.filter("embedding is not null").select(F.col("vec_id").alias("id"), "embedding")

    def compare(block: list) -> DataFrame:
        sent = spark.sparkContext.broadcast((np.array([q for q, _ in block]), _unit(np.array([v for _, v in block], float))))

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            ids, given = sent.value
            best: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0), np.empty(0, np.int64))] * len(ids)
            for frame in frames:
                own = frame.id.to_numpy()
                scores = np.round(given @ _unit(np.array(frame.embedding.tolist(), float)).T, 9)
                for i, q in enumerate(ids):
                    keep = own != q
                    score, at = np.concatenate((best[i][0], scores[i][keep])), np.concatenate((best[i][1], own[keep]))
                    order = np.lexsort((at, -score))[:top]
                    best[i] = score[order], at[order]
            n = [len(a) for _, a in best]
            yield pd.DataFrame({"query_id": np.repeat(ids, n), "id": np.concatenate([a for _, a in best]), "score": np.concatenate([s for s, _ in best])})

        return rows.mapInPandas(run, "query_id long, id long, score double")

    found = in_blocks(spark, queries.filter("embedding is not null").select("vec_id", "embedding"), BLOCK, compare, "query_id long, id long, score double")
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))).filter(F.col("rank") <= top)


def _unit(vectors: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; those without length stay."""
    size = np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))
    return vectors / np.where(size > 0, size, 1)


def fuse(lists: Sequence[DataFrame], top: int = TOP) -> DataFrame:
    """Reciprocal rank fusion of lists (query_id, id, rank): the ``top`` best of each query (MOST at most)."""
    every = lists[0].select("query_id", "id", "rank")
    for other in lists[1:]:
        every = every.unionByName(other.select("query_id", "id", "rank"))
    scored = every.groupBy("query_id", "id").agg(F.round(F.sum(F.lit(1.0) / (F.col("rank") + FUSION)), 9).alias("score"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return scored.withColumn("rank", place).filter(F.col("rank") <= min(top, MOST))


def retrieval_metrics(ranked: DataFrame, relevant: Column, total: DataFrame) -> DataFrame:
    """Per query: recall at 5 and nDCG at 10 of ranks with a condition for relevant ones, and how many there are (query_id, total)."""
    hits = ranked.filter(relevant).groupBy("query_id").agg(
        F.count_if(F.col("rank") <= 5).alias("found"), F.sum(F.when(F.col("rank") <= 10, 1 / F.log2(F.col("rank") + 1.0)).otherwise(0.0)).alias("dcg"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("total", F.lit(10)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))
    joined = total.filter("total > 0").join(hits, "query_id", "left")
    return joined.select("query_id", F.round(F.coalesce("found", F.lit(0)) / F.col("total"), 6).alias("recall_5"), F.round(F.coalesce("dcg", F.lit(0.0)) / ideal, 6).alias("ndcg_10"))
