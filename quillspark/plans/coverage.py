"""Flagship query: how far labels cover the documents, by language."""

from __future__ import annotations

from pyspark.sql import functions as F

from .registry import register


@register(
    "entry_label_coverage",
    """
    SELECT d.lang, count(*)::BIGINT AS documents, count(l.doc_id)::BIGINT AS labelled,
           sum(length(coalesce(d.text, '')))::BIGINT AS characters,
           round(count(l.doc_id)::DOUBLE / count(*), 6) AS coverage,
           round(count(*) FILTER (l.quality = 1)::DOUBLE / nullif(count(l.doc_id), 0), 6) AS good_share
    FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY d.lang""",
)
def entry_label_coverage(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality", F.lit(True).alias("has"))
    good, labelled = F.count_if(F.col("quality") == 1), F.count("has")
    return docs.join(labels, "doc_id", "left").groupBy("lang").agg(
        F.count("*").alias("documents"), labelled.alias("labelled"), F.sum(F.length(F.coalesce("text", F.lit("")))).alias("characters"),
        F.round(F.try_divide(labelled.cast("double"), F.count("*")), 6).alias("coverage"), F.round(F.try_divide(good.cast("double"), labelled), 6).alias("good_share"),
    )
