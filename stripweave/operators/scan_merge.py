"""Reconciling a project's pages with a new scan of its folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def merge_file_scan(old: DataFrame, new: DataFrame) -> DataFrame:
    """``project_uid, path, old_uid, ord, change_type``: kept, renamed, added or removed.

    ``old`` has ``uid, file_path, sha256, ord``, ``new`` has ``file_path, sha256, ord``. A path keeps its
    record. Another path of the same hash claims the record too; the claim is a rename if it comes
    first of all claims on that record. Of several records with one hash the last one counts.
    """
    by_path = old.groupBy("project_uid", "file_path").agg(F.max_by("uid", "ord").alias("__path_uid"))
    by_hash = old.where("sha256 <> ''").groupBy("project_uid", "sha256").agg(F.max_by("uid", "ord").alias("__hash_uid"))
    by_hash = by_hash.withColumnRenamed("sha256", "__key")
    # files that cannot match must not meet under one key: theirs is their own place
    alone = F.concat(F.lit("\0"), F.col("ord").cast("string"))
    claims = new.withColumn("__key", F.when(F.coalesce("sha256", F.lit("")) != "", F.col("sha256")).otherwise(alone))
    claims = claims.join(by_path, ["project_uid", "file_path"], "left").join(by_hash, ["project_uid", "__key"], "left")
    claims = claims.withColumn("__uid", F.coalesce("__path_uid", "__hash_uid")).withColumn("__claim", F.coalesce("__uid", alone))
    # the first claim on each record: tasks send one minimum for each record that they meet, however many files claim it
    first = claims.where("__uid IS NOT NULL").groupBy("project_uid", F.col("__uid").alias("__claim")).agg(F.min("ord").alias("__first"))
    claims = claims.join(first, ["project_uid", "__claim"], "left")
    kind = (
        F.when(F.col("__path_uid").isNotNull(), "kept")
        .when(F.col("__uid").isNotNull() & (F.col("ord") == F.col("__first")), "renamed")
        .otherwise("added")
    )
    claims = claims.withColumn("change_type", kind)
    taken = claims.where("change_type <> 'added'").select("project_uid", F.col("__uid").alias("uid")).distinct()
    gone = old.join(taken, ["project_uid", "uid"], "left_anti").select(
        "project_uid", F.col("file_path").alias("path"), F.col("uid").alias("old_uid"), F.lit(None).cast("long").alias("ord"), F.lit("removed").alias("change_type")
    )
    seen = claims.select(
        "project_uid", F.col("file_path").alias("path"), F.when(F.col("change_type") != "added", F.col("__uid")).alias("old_uid"), F.col("ord").cast("long").alias("ord"), "change_type"
    )
    return seen.unionByName(gone)


def outputs_invalidated(merged: DataFrame, old: DataFrame) -> DataFrame:
    """``project_uid, outputs_invalidated``: any page added, removed or at another place."""
    places = old.select("project_uid", F.col("uid").alias("old_uid"), F.col("ord").alias("__was"))
    rows = merged.join(places, ["project_uid", "old_uid"], "left")
    moved = F.col("change_type").isin("added", "removed") | (F.col("ord") != F.col("__was"))
    return rows.groupBy("project_uid").agg(F.bool_or(moved).alias("outputs_invalidated"))


def content_duplicates(files: DataFrame) -> DataFrame:
    """``sha256, n, first_path``: contents that several files share."""
    return files.where("sha256 <> ''").groupBy("sha256").agg(F.count(F.lit(1)).alias("n"), F.min("file_path").alias("first_path")).where("n > 1")


def hash_files(rows: DataFrame, key: str, content: str) -> DataFrame:
    """``key, sha256`` of contents that a table holds; "" where there is none."""
    return rows.select(F.col(key).alias("key"), F.coalesce(F.sha2(F.col(content), 256), F.lit("")).alias("sha256"))
