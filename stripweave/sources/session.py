"""Settings of Spark that follow the size of the tables."""

from __future__ import annotations

from pyspark.sql import SparkSession

from .fixtures import TABLES

#: Bytes of input tables for each partition of a shuffle, and of a shuffle for each task: rows grow tenfold between the two.
INPUT_BYTES, SHUFFLE_BYTES = 3 << 19, 4 << 20
#: Bytes of a file for each task that reads it, as a shuffle into many partitions holds what its task has read.
SPLIT_BYTES = 16 << 20
#: The setting that holds how many partitions a shuffle starts with.
PARTITIONS = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"


def table_bytes(spark: SparkSession, sf_dir: str) -> int:
    """Bytes of the tables of a data folder, of any store."""
    total = 0
    for name in TABLES:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
        store = path.getFileSystem(spark._jsc.hadoopConfiguration())
        if store.exists(path):
            total += store.getContentSummary(path).getLength()
    return total


def sized_session(spark: SparkSession, sf_dir: str) -> SparkSession:
    """A session of the same context, with the settings of ``spark``, whose tasks stay small however large the tables are.

    Shuffles start with partitions in proportion to the input and are merged up to ``SHUFFLE_BYTES``; tasks read ``SPLIT_BYTES`` of a file. Tables dealt by project join on longer keys
    without a shuffle. A table counts as ten times its files, as rows are that much larger in memory, before it may be broadcast. The settings of ``spark`` itself stay as they are.
    """
    own = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if key.startswith("spark.sql.") and spark.conf.isModifiable(key):
            own.conf.set(key, value)
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    own.conf.set(PARTITIONS, str(max(least, table_bytes(spark, sf_dir) // INPUT_BYTES)))
    own.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", str(SHUFFLE_BYTES))
    own.conf.set("spark.sql.files.maxPartitionBytes", str(SPLIT_BYTES))
    own.conf.set("spark.sql.sources.fileCompressionFactor", "10")
    own.conf.set("spark.sql.parquet.compression.codec", "zstd")  # hashes in hex halve
    own.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    return own
