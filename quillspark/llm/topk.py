"""Exact top-k inner-product search with a vector-approximation file.

Every distinct vector is stored twice: as one byte per component (the cell of an even grid between the
component's extremes) and exactly.  A block of queries is scanned against all cells: a cell bounds its
components, hence the score, from both sides.  A vector whose upper bound lies below the k-th largest
lower bound of a query cannot be among its k best.  Exact vectors are then read in the order of their
bounds, in two reads: the 2k most promising of each query first, which fixes the k-th best score so
far, then every vector whose bound still reaches that score; after that the result is certain.

Queries come in blocks of about BLOCK vectors, all that is sent to the scanning tasks at a time.
Equal vectors are one entry that lists its k + 1 smallest ids, enough for any query's k best.

Rows: vectors that are null or hold null or non-finite components, and rows without an id, take no
part; shorter vectors count as padded with zeros; a row that repeats an id and vector counts once; an id
with several vectors is a candidate with its best score, and as a query stands for its smallest vector;
an empty table gives an empty result; further columns are not read.  Components are whole numbers of
up to 2**53 in size after scaling, and scores of up to 2**63; beyond that nothing is promised.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import discard, materialize, shared_dir

CELLS = 256
BLOCK = 4096
HELD = 64 << 20
K = 10


def integer_vectors(df: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, ints) with ints = floor(1024 x) of the rows that take part."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    ints = F.transform(vector, lambda x: F.floor(F.lit(1024.0) * x.cast("double")))
    return df.filter(F.col(key).isNotNull() & F.col(vector).isNotNull() & ~F.coalesce(bad, F.lit(True))).select(F.col(key).cast("long").alias("vec_id"), ints.alias("ints"))


def distinct_vectors(rows: DataFrame, k: int) -> DataFrame:
    """One row per different vector: its k + 1 smallest ids. Tasks collapse their own copies first, HELD bytes of vectors at a time."""

    def run(batches):
        held: dict[bytes, list[int]] = {}
        size = 0

        def out():
            ends = pa.array(np.cumsum([0, *(len(x) // 8 for x in held)]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(ends, pa.array(np.frombuffer(b"".join(held), np.int64))), pa.array(list(held.values()), pa.list_(pa.int64()))], names=["ints", "ids"])
            held.clear()

        for batch in batches:
            column = batch.column("ints")
            flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            ends = np.cumsum(np.asarray(pc.list_value_length(column).to_numpy(zero_copy_only=False))).tolist()
            for i, a, b in zip(batch.column("vec_id").to_pylist(), [0, *ends], ends, strict=False):
                x = flat[a:b].tobytes()
                if x not in held:
                    size += len(x)
                own = held.setdefault(x, [])
                if i not in own:
                    own.append(i)
                    own.sort()
                    del own[k + 1 :]
            if size > HELD:
                yield from out()
                size = 0
        yield from out()

    merged = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, k + 1)
    return rows.mapInArrow(run, "ints array<bigint>, ids array<bigint>").groupBy("ints").agg(merged.alias("ids")).select(F.col("ids")[0].alias("rep"), "ids", "ints", F.col("ids")[0].alias("vid"))


def _matrix(column, dim: int) -> np.ndarray:
    """Lists of integers as rows of floats (exact below 2**53), padded with zeros."""
    sizes = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(column), dim))
    out[np.arange(dim) < np.asarray(sizes)[:, None]] = flat
    return out


def extremes(vectors: DataFrame, dim: int) -> tuple[np.ndarray, np.ndarray]:
    def run(batches):
        low, high = np.full(dim, np.inf), np.full(dim, -np.inf)
        for batch in batches:
            if batch.num_rows:
                m = _matrix(batch.column("ints"), dim)
                low, high = np.minimum(low, m.min(axis=0)), np.maximum(high, m.max(axis=0))
        if np.isfinite(low).all() and dim:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim)), pa.array(low), pa.array(high)], names=["d", "low", "high"])

    rows = vectors.select("ints").mapInArrow(run, "d long, low double, high double").groupBy("d").agg(F.min("low").alias("low"), F.max("high").alias("high")).orderBy("d").collect()
    return np.array([r.low for r in rows]), np.array([r.high for r in rows])


def grid(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Edges of the cells, components x (CELLS + 1): cell c holds the integers edges[c] .. edges[c + 1] - 1."""
    return low[:, None] + np.floor(np.arange(CELLS + 1)[None, :] * (high - low + 1)[:, None] / CELLS)


def approximate(vectors: DataFrame, edges: np.ndarray) -> DataFrame:
    """(vid, alone, cells): alone is the only id of the vector, or null."""

    def run(batches):
        for batch in batches:
            m = _matrix(batch.column("ints"), len(edges))
            cells = np.empty(m.shape, np.uint8)
            for d in range(len(edges)):
                cells[:, d] = np.searchsorted(edges[d], m[:, d], side="right") - 1
            yield pa.RecordBatch.from_arrays([batch.column("vid"), batch.column("alone"), pa.array([x.tobytes() for x in cells], pa.binary())], names=["vid", "alone", "cells"])

    return vectors.select("vid", F.when(F.size("ids") == 1, F.col("rep")).alias("alone"), "ints").mapInArrow(run, "vid long, alone long, cells binary")


def scan(cells: DataFrame, ids: np.ndarray, queries: np.ndarray, edges: np.ndarray, k: int) -> DataFrame:
    """(query_id, vid, low, high) of all vectors that the tasks' own bounds can't rule out."""
    q_id, dim = ids, len(edges)
    plus, minus = np.maximum(queries, 0).T.copy(), np.minimum(queries, 0).T.copy()

    def run(batches):
        n_q = len(q_id)
        best = np.full((n_q, k), -np.inf)
        kept: list[tuple[np.ndarray, ...]] = []
        size = 0

        def prune():
            q, v, lo, hi = (np.concatenate(x) for x in zip(*kept, strict=True))
            good = hi >= best.min(axis=1)[q]
            return q[good], v[good], lo[good], hi[good]

        def rows(q, v, lo, hi):
            return pa.RecordBatch.from_arrays([pa.array(q_id[q]), pa.array(v), pa.array(lo.astype(np.int64)), pa.array(hi.astype(np.int64))], names=["query_id", "vid", "low", "high"])

        for batch in batches:
            vids = batch.column("vid").to_numpy()
            alone = batch.column("alone").fill_null(-(1 << 63)).to_numpy()
            codes = np.frombuffer(b"".join(batch.column("cells").to_pylist()), np.uint8).reshape(len(vids), dim)
            for a in range(0, len(vids), 512):
                c = codes[a : a + 512]
                low, high = edges[np.arange(dim), c], edges[np.arange(dim), c.astype(int) + 1] - 1
                most, least = high @ plus + low @ minus, low @ plus + high @ minus
                own = alone[a : a + 512][:, None] == q_id[None, :]
                most[own] = least[own] = -np.inf
                best = -np.partition(-np.hstack((best, least.T)), k - 1, axis=1)[:, :k]
                v, q = np.nonzero((most >= best.min(axis=1)) & np.isfinite(most))
                kept.append((q, vids[a : a + 512][v], least[v, q], most[v, q]))
                size += len(q)
                if size > 500_000:
                    kept[:] = [prune()]
                    size = len(kept[0][0])
                    if size > 250_000:
                        yield rows(*kept.pop())
                        size = 0
        if kept:
            yield rows(*prune())

    return cells.mapInArrow(run, "query_id long, vid long, low long, high long")


def exact(rows: DataFrame, ids: np.ndarray, queries: np.ndarray) -> DataFrame:
    """Adds the exact score to rows of (query_id, ids, ints)."""
    order = np.argsort(ids)
    sorted_ids, matrix = ids[order], queries[order].astype(np.int64)

    def run(batches):
        for batch in batches:
            m = _matrix(batch.column("ints"), matrix.shape[1]).astype(np.int64)
            at = np.searchsorted(sorted_ids, batch.column("query_id").to_numpy())
            yield pa.RecordBatch.from_arrays([batch.column("query_id"), batch.column("ids"), pa.array((m * matrix[at]).sum(axis=1))], names=["query_id", "ids", "score"])

    found = rows.select("query_id", "ids", "ints").mapInArrow(run, "query_id long, ids array<bigint>, score long")
    each = found.select("query_id", F.explode("ids").alias("vec_id"), "score").filter("vec_id <> query_id")
    return each.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))


def search(rows: DataFrame, is_query, k: int = K, block: int = BLOCK) -> DataFrame:
    """k best of all rows for each row with ``is_query`` (a condition on vec_id): query_id, rank, vec_id, score."""
    spark = rows.sparkSession
    kept = materialize(rows, "topk-rows")
    shape = kept.agg(F.max(F.size("ints")).alias("dim"), F.count_if(is_query).alias("q")).collect()[0]
    dim, n_q = max(1, shape.dim or 0), shape.q or 0
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    if not n_q:
        return empty
    vectors = materialize(distinct_vectors(kept, k), "topk-vectors")
    edges = grid(*extremes(vectors, dim))
    cells = materialize(approximate(vectors, edges), "topk-cells")
    blocks = math.ceil(n_q / block)
    path = shared_dir(spark, "topk-found")
    empty.write.parquet(path)  # blocks are added to one folder, so that the plan stays one scan however many there are
    for b in range(blocks):
        own = kept.filter(is_query & (F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b)).groupBy("vec_id").agg(F.min("ints").alias("ints")).collect()
        if not own:
            continue
        ids = np.array([r.vec_id for r in own], np.int64)
        queries = np.zeros((len(own), dim))
        for i, r in enumerate(own):
            queries[i, : len(r.ints)] = r.ints
        by_low = Window.partitionBy("query_id").orderBy(F.desc("low"), "vid")
        by_high = Window.partitionBy("query_id").orderBy(F.desc("high"), "vid")
        bounds = scan(cells, ids, queries, edges, k).withColumn("n", F.row_number().over(by_low))
        limit = F.max(F.when(F.col("n") == k, F.col("low"))).over(Window.partitionBy("query_id"))
        bounds = bounds.withColumn("limit", limit).filter("limit is null or high >= limit").withColumn("place", F.row_number().over(by_high)).select("query_id", "vid", "high", "place")
        bounds = materialize(bounds, "topk-bounds")
        first = materialize(exact(bounds.filter(F.col("place") <= 2 * k).join(vectors, "vid"), ids, queries), "topk-first")
        ranked = first.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
        sure = ranked.filter(F.col("n") == k).select("query_id", F.col("score").alias("kth"))
        rest = bounds.filter(F.col("place") > 2 * k).join(sure, "query_id", "left").filter("kth is null or high >= kth")
        both = first.unionByName(exact(rest.join(vectors, "vid"), ids, queries)).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        final = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        found = both.withColumn("rank", F.row_number().over(final)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
        found.write.mode("append").parquet(path)
        discard(bounds, first)
    return spark.read.schema(empty.schema).parquet(path)


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = integer_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return search(rows, F.col("vec_id") % 100 == 0)


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, rank::INT AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10"""
