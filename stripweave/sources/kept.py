"""Intermediate tables that cut the lineage of long plans."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_own_folder: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session, else the context's checkpoint folder.

    Only where both are unset and everything runs on one machine (tests) a temporary folder takes their place.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder:
        return folder
    if not re.fullmatch(r"local(\[.*\])?", context.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = context.applicationId
    if app not in _own_folder:
        _own_folder[app] = tempfile.mkdtemp(prefix="spark-")
    return _own_folder[app]


def keep(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back; the table goes when the application ends."""
    path = f"{shared_folder(df.sparkSession)}/stripweave-{uuid.uuid4().hex}"
    df.write.parquet(path)
    delete_at_end(df.sparkSession, path)
    made = df.sparkSession.read.schema(df.schema).parquet(path)
    made.kept_in = path
    return made


def keep_bucketed(df: DataFrame, key: str, n: int) -> DataFrame:
    """``keep`` dealt into ``n`` buckets by ``key``: joins and sums by it need no shuffle of the table any more.

    Spark writes buckets only as tables of its catalog; the entry is dropped at once, the frame needs the files alone.
    """
    spark, name = df.sparkSession, f"stripweave_{uuid.uuid4().hex}"
    path = f"{shared_folder(spark)}/{name}"
    df.write.bucketBy(n, key).option("path", path).saveAsTable(name)
    delete_at_end(spark, path)
    made = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # an external table: its files stay
    made.kept_in = path
    return made


def scratch(spark: SparkSession) -> str:
    """A new folder name below the shared folder; what is written there goes when the application ends."""
    path = f"{shared_folder(spark)}/stripweave-{uuid.uuid4().hex}"
    delete_at_end(spark, path)
    return path


def running_total(df: DataFrame, order: list[str], value: Column, name: str) -> DataFrame:
    """Add ``name``: the sum of ``value`` over all rows up to this one in the total order ``order``.

    Ranges of rows are summed on their own and shifted by the sums of the ranges before them, so no task sees more than its range.
    """
    ranged = keep(df.withColumn("__v", value).repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sums = ranged.groupBy("__part").agg(F.sum("__v").alias("__s"))  # one row for each range
    sums = sums.select("__part", F.coalesce(F.sum("__s").over(before), F.lit(0)).alias("__shift"))
    inside = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    shifted = F.sum("__v").over(inside) + F.col("__shift")
    return ranged.join(F.broadcast(sums), "__part").withColumn(name, shifted).drop("__part", "__v", "__shift")


def delete_at_end(spark: SparkSession, path: str) -> None:
    """Delete a path of any store when the driver's JVM ends."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)


def discard(*kept: DataFrame) -> None:
    """Delete tables of ``keep`` that nothing will read again."""
    for df in kept:
        where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.kept_in)
        where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)
