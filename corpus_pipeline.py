"""Five corpus stages in a row: quality, line dedup, near-dedup, mixing, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stripweave.llm import stages
from stripweave.llm.common import discard, materialise

STAGES = [
    ("quality_classifier", stages.keep_quality),
    ("line_dedup", stages.drop_repeated_lines),
    ("simhash_near_dedup", stages.keep_one_of_near_copies),
    ("mixing", stages.mix),
    ("packing", stages.pack),
]

#: The stages train a classifier, hash with XXH64 and run a tokenizer: not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each result is written as Parquet and reread, and its predecessor deleted."""
    docs, done = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for _, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir))
        discard(*done)
        done = [docs]
    return docs
