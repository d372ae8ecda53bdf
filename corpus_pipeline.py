"""Corpus pipeline: toxicity, near-duplicates, surrogates for personal data, source mixing, token ids.

Each stage reads what the stage before it wrote as Parquet.  Stages return the columns of documents,
the last one doc_id, source, n_tokens and input_ids.  What stages do with nulls, empty and long texts,
repeated rows and ids, and empty tables stands in the modules of their operators.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quillspark.llm import bpe, mixing, neardup, pii, toxicity
from quillspark.llm.shared import bounded, materialize


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every whole text.

    Null and empty texts have none; repeated rows and ids give a row each; an empty table gives an empty table;
    columns other than doc_id, source and text are not read.
    """
    return bpe.encode(docs.select("doc_id", "source", "text"), public_tokenizers.path("byte_bpe_50k.tiktoken")).drop("text")


STAGES = [
    ("toxicity", bounded(toxicity.stage)),
    ("near_duplicates", bounded(neardup.stage)),
    ("surrogates", bounded(pii.stage)),
    ("mixing", bounded(mixing.stage)),
    ("token_ids", bounded(encode)),
]

#: SQL cannot express the learned, randomised and tokenising stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies all stages to ``documents``, each over what its predecessor wrote."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
