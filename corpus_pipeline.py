"""A training corpus from ``documents``, stage by stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from driftline.llm import stages

STAGES = [
    ("language_id", stages.language_id),
    ("near_dedup", stages.near_dedup),
    ("decontaminate", stages.decontaminate_documents),
    ("mix_sources", stages.mix_sources),
    ("pack_tokens", stages.pack_tokens),
]

#: A trained network and a tokenizer cannot be written in SQL; tests/llm holds the stages
#: against brute-force versions instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, from ``documents`` to packed rows of token ids."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
