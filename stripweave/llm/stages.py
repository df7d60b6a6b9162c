"""Stages of the corpus pipeline; each takes (spark, docs, sf_dir) and returns a DataFrame.

All but the last return the columns of their input. ``n_chars``, where there is one, follows the
text. Empty inputs give empty outputs; the operators' docstrings define what nulls and ties do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, spread_rank, word_count
from .line_dedup import dedup_lines
from .mixing import mix_sources
from .near_copies import keep_one
from .packing import pack_documents
from .quality_trees import score_documents, train_quality

QUALITY_THRESHOLD = 0.3


def _with_text(docs: DataFrame, text: Column) -> DataFrame:
    """The columns of ``docs`` with a new text and its length."""
    new = {"text": text}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length(text).cast(docs.schema["n_chars"].dataType)
    return docs.withColumns(new)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    model = train_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_documents(docs, model, "__score").where(F.col("__score") >= QUALITY_THRESHOLD).select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that many of them share; null texts stay null."""
    done = dedup_lines(docs, prefix="__")
    text = F.when(F.col("text").isNotNull(), F.col("__kept"))
    return _with_text(done, text).select(*docs.columns)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of five-word similarity 0.8 or more: of smallest doc_id, rows without one last."""
    return keep_one(docs).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; the last copy may be cut after some words."""
    keys = ["doc_id", "source", "size"]
    taken = mix_sources(docs)["documents"].groupBy(*keys).agg(F.sum("taken").alias("__all"), F.count(F.lit(1)).alias("__n"))
    taken = materialise(taken.select(*[F.col(k).alias(f"__{k}") for k in keys], "__all", "__n"))
    rows = docs.withColumn("__words", word_count(F.col("text")))
    same = (
        F.col("doc_id").eqNullSafe(F.col("__doc_id"))
        & F.col("source").cast("string").eqNullSafe(F.col("__source"))
        & (F.col("__words") == F.col("__size"))
    )
    rows = rows.join(taken, same)
    rows = rows.where("__n = 1").withColumn("__k", F.lit(0).cast("long")).unionByName(_ranked_by_content(rows.where("__n > 1"), docs.columns))
    own = F.least(2 * F.col("__words"), F.greatest(F.lit(0), F.col("__all") - 2 * F.col("__words") * F.col("__k")))
    whole = F.expr("__own div greatest(__words, 1)")
    rest = F.expr("__own % greatest(__words, 1)")
    copies = F.concat(
        F.array_repeat(F.lit(None).cast("long"), whole.cast("int")),
        F.when(rest > 0, F.array(rest)).otherwise(F.array().cast("array<long>")),
    )
    rows = rows.withColumn("__own", own).where("__own > 0").withColumn("__cut", F.explode(copies))
    tokens = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"), F.lit(0))
    start = F.regexp_replace(F.array_join(F.slice(tokens, F.lit(1), F.col("__cut").cast("int")), ""), r"[\x20\x09-\x0D]+$", "")
    text = F.when(F.col("__cut").isNull(), F.col("text")).otherwise(start)
    return _with_text(rows, text).select(*docs.columns)


def _ranked_by_content(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Rows that share id, source and size take their turns (``__k`` from 0) by their contents, however they are partitioned.

    The order is that of a digest of the whole row; equal rows can stand for each other, a written number splits them.
    """
    digest = F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)
    numbered = materialise(rows.withColumns({"__digest": digest, "__row": F.monotonically_increasing_id()}))
    keys = ["__doc_id", "__source", "__words"]
    ranked = materialise(spread_rank(numbered, [*keys, "__digest", "__row"], "__rank"))
    first = ranked.groupBy(*keys).agg(F.min("__rank").alias("__first")).select(*[F.col(k).alias(f"__of{k}") for k in keys], "__first")
    own = F.col("__doc_id").eqNullSafe(F.col("__of__doc_id")) & F.col("__source").eqNullSafe(F.col("__of__source")) & (F.col("__words") == F.col("__of__words"))
    both = ranked.join(first, own).withColumn("__k", F.col("__rank") - F.col("__first"))
    return both.drop(*[f"__of{k}" for k in keys], "__digest", "__row", "__rank", "__first")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 1024 tokens."""
    return pack_documents(docs)
