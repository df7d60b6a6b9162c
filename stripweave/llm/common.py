"""Helpers that several corpus operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.kept import delete_at_end, discard, keep, keep_bucketed, shared_folder  # noqa: F401

#: Fixed value: a word is a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


class PerWorker(dict):
    """What a worker process makes once; it arrives there empty, so functions that use it are pickled without it."""

    def __reduce__(self):
        return PerWorker, ()


def tidy(function):
    """A function of batches after which its worker process, which Spark keeps for other tasks, gives free memory back."""

    def run(batches):
        import ctypes

        import pyarrow

        yield from function(batches)
        pyarrow.default_memory_pool().release_unused()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):
            pass  # another C library

    return run


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: cuts the lineage."""
    return keep(df)


def words(text: Column) -> Column:
    """All words of a text; null counts as empty."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def word_count(text: Column) -> Column:
    """Number of words of a text as long; null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def let(value: Column, body) -> Column:
    """Bind ``value`` once inside an expression: ``body`` may use it many times."""
    return F.element_at(F.transform(F.array(value), body), 1)


def spread_rank(df: DataFrame, order: list, name: str, parts: int | None = None) -> DataFrame:
    """Add ``name``: the row's 1-based rank in the total order ``order`` over the whole frame.

    Rows are range-partitioned and written once; each part is ranked on its own and shifted by
    the row counts of the parts before it, so no task sees more than its own range.
    """
    spark = df.sparkSession
    ranged = df.repartitionByRange(parts, *order) if parts else df.repartitionByRange(*order)
    kept = materialise(ranged.withColumn("__part", F.spark_partition_id()))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    counts = (
        kept.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
        # one row for each range partition: bounded by the number of partitions
        .select(F.col("__part"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    )
    inside = Window.partitionBy("__part").orderBy(*order)
    return (
        kept.withColumn("__in", F.row_number().over(inside))
        .join(F.broadcast(counts), "__part")
        .withColumn(name, (F.col("__in") + F.col("__before")).cast("long"))
        .drop("__part", "__in", "__before")
    )
