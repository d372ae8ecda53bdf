"""Queries of the searchable library, of cursor reading and of chunks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.text import search_terms
from ..operators.library import Library
from ..operators.reading import all_reads, chunks
from ..storage import shared_dir
from .registry import register
from .tables import table

LIBRARY = """
    d AS (SELECT doc_id, CASE WHEN doc_id % 10 = 4 THEN text || ' nachtrag' ELSE text END AS text FROM documents WHERE doc_id % 10 <> 3 AND text IS NOT NULL),
    t AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM d)"""


def _library(spark, d) -> Library:
    """Even documents, then all of them with every tenth changed, then some removed."""
    docs, own = table(spark, d, "documents").select("doc_id", "text"), Library(spark, shared_dir(spark, "library"))
    own.add(docs.filter("doc_id % 2 = 0"))
    own.add(docs.withColumn("text", F.when(F.col("doc_id") % 10 == 4, F.concat("text", F.lit(" nachtrag"))).otherwise(F.col("text"))))
    own.remove(docs.filter("doc_id % 10 = 3").select("doc_id"))
    return own


@register("library_search", f"""
    WITH {LIBRARY}, s AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM t),
    p AS (SELECT doc_id, size, term, count(*) AS tf FROM (SELECT doc_id, len(w) AS size, unnest(w) AS term FROM t) GROUP BY ALL), f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
    q AS (SELECT item_id, substr(unnest(list_slice(list_sort(list_transform(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')), lambda w: lpad((1000 - length(w))::VARCHAR, 4, '0') || w)), 1, 3)), 5) AS term FROM benchmark),
    r AS (SELECT item_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / mean))), 9) AS score FROM q JOIN p USING (term) JOIN f USING (term), s GROUP BY ALL)
    SELECT item_id, rank::INT AS rank, doc_id, round(score, 6) AS score, 'lexical' AS mode FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM r) WHERE rank <= 8""")
def library_search(spark, d):
    """From the design specification: the best documents for the three longest words of each passage, after additions, changes, removals and a merge."""
    own = _library(spark, d)
    own.merge()
    words = F.transform(F.array_distinct(search_terms(F.col("text"))), lambda w: F.concat(F.lpad((1000 - F.length(w)).cast("string"), 4, "0"), w))
    longest = F.transform(F.slice(F.array_sort(words), 1, 3), lambda w: F.substring(w, F.lit(5), F.length(w)))
    found = own.search(table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.array_join(longest, " ").alias("query")))
    return found.select(F.col("query_id").alias("item_id"), "rank", "doc_id", F.round("score", 6).alias("score"), "mode")


@register("library_status", f"WITH {LIBRARY} SELECT 3::BIGINT AS generation, 2::BIGINT AS segments, 2::BIGINT AS tombstones, count(*)::BIGINT AS documents, sum(len(w))::BIGINT AS terms FROM t")
def library_status(spark, d):
    """From the design specification: what an index holds, after two additions and a removal."""
    return _library(spark, d).status().select("generation", "segments", "tombstones", "documents", "terms")


@register("library_read", f"WITH {LIBRARY} SELECT doc_id, 'ok' AS status, length(left(text, 12000))::INT AS n, sha256(left(text, 12000)) AS digest, length(text) > 12000 AS more FROM d UNION ALL SELECT doc_id, 'source_unavailable', NULL, NULL, NULL FROM documents WHERE doc_id % 10 = 3")
def library_read(spark, d):
    """From the design specification: bounded originals of all documents, and which ones the library no longer has."""
    ids = table(spark, d, "documents").filter("text is not null").select("doc_id")
    return _library(spark, d).read(ids).select("doc_id", "status", F.length("text").alias("n"), F.sha2("text", 256).alias("digest"), "more")


@register("document_read", """
    WITH c AS (SELECT conv_id, turn, text, length(text) AS n, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) - length(text) AS since FROM conversations WHERE text IS NOT NULL),
    r AS (SELECT *, unnest(range((since // 1000)::BIGINT, ((since + n - 1) // 1000 + 1)::BIGINT)) AS read FROM c WHERE n > 0),
    e AS (SELECT *, greatest(0, read * 1000 - since)::INT AS first, least(n, (read + 1) * 1000 - since)::INT AS "end" FROM r)
    SELECT conv_id, read::BIGINT AS read, turn::BIGINT AS turn, first, "end", sha256(substr(text, first + 1, "end" - first)) AS digest FROM e""")
def document_read(spark, d):
    """From the design specification: all bounded reads of conversations, 1,000 characters each."""
    blocks = table(spark, d, "conversations").select("conv_id", F.lit(1).alias("page"), F.col("turn").cast("long").alias("ord"), "text")
    return all_reads(blocks, 1000, "conv_id").select("conv_id", "read", F.col("ord").alias("turn"), "first", "end", F.sha2("text", 256).alias("digest"))


@register("txt_chunk", """
    WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL),
    s AS (SELECT doc_id, w, unnest(range(0, greatest(len(w) - 32, 1), 224)) AS a FROM w WHERE len(w) > 0)
    SELECT doc_id, (a // 224)::INT AS chunk, len(list_slice(w, a + 1, a + 256))::INT AS n, sha256(array_to_string(list_slice(w, a + 1, a + 256), ' ')) AS digest FROM s""")
def txt_chunk(spark, d):
    """Chunks of whole texts, 256 tokens each, of which the first 32 are the last of the one before."""
    blocks = table(spark, d, "documents").select("doc_id", F.lit(1).alias("page"), F.lit(1).alias("ord"), F.lit("paragraph").alias("kind"), "text")
    return chunks(blocks, doc="doc_id").select("doc_id", "chunk", F.col("n_tokens").alias("n"), F.sha2(F.regexp_replace("text", r"\s+", " "), 256).alias("digest"))


@register("txt_chunk_tables", """
    WITH l AS (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey FROM lineitem), o AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) - 1 AS k FROM l)
    SELECT l_orderkey, (k // 3)::INT AS chunk, (6 + 3 * count(*))::INT - CASE WHEN k // 3 > 0 THEN 2 ELSE 0 END AS n,
           CASE WHEN k // 3 = 0 THEN 'Order ' || l_orderkey || chr(10) ELSE '' END || 'line part | quantity' || chr(10) || string_agg('row ' || l_linenumber || ': ' || l_partkey, chr(10) ORDER BY l_linenumber, l_partkey) AS text
    FROM o GROUP BY l_orderkey, k // 3""")
def txt_chunk_tables(spark, d):
    """Orders as a heading and a table, whose header stands in every chunk of it."""
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").distinct()
    at = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey"))
    block = lambda rows, n, kind, text: rows.select("l_orderkey", F.lit(1).alias("page"), n.alias("ord"), F.lit(kind).alias("kind"), text.alias("text"))
    orders = lines.select("l_orderkey").distinct()
    rows = block(lines, at + 1, "table_row", F.concat(F.lit("row "), "l_linenumber", F.lit(": "), "l_partkey"))
    every = block(orders, F.lit(0), "heading", F.concat_ws(" ", F.lit("Order"), "l_orderkey")).unionByName(block(orders, F.lit(1), "table_header", F.lit("line part | quantity"))).unionByName(rows)
    return chunks(every, 15, 4, "l_orderkey").select("l_orderkey", "chunk", F.col("n_tokens").alias("n"), "text")
