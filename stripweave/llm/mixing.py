"""Mix sources to target weights with a low-discrepancy schedule of equal-token blocks.

Golden-ratio points are mapped through the sources' cumulative slot weights; the r-th slot of a
source takes the r-th block of its shuffled documents, starting over when the source is used up.
Built from DataFrame functions only.

Defined results: null text has size 0; null is a source of its own, last in order; documents of
size 0 are taken 0 times; repeated rows are separate documents; an empty table gives an empty
result; other columns are ignored. Equal shuffle keys (repeated ids) fall back to doc_id and size, then to a
written random number, which decides nothing but which of two equal rows comes first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, spread_rank, word_count

GOLDEN = 0.6180339887498949
#: A table of sources is broadcast up to this many rows and joined by shuffle beyond it.
BROADCAST_SOURCES = 50_000


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_SOURCES else df


def source_targets(sizes: DataFrame, weights=(5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """Per source: ``source, source_size, n_docs, source_no, weight, target``.

    Targets share ``share`` times all words by weight, none above ``cap`` times its source's size.
    """
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    ranked = spread_rank(per_source, [F.col("source").asc_nulls_last()], "source_no")
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    table = materialise(
        ranked.withColumn("weight", F.get(cycle, ((F.col("source_no") - 1) % len(weights)).cast("int")))
        .withColumn("cap", cap * F.col("source_size"))
    )
    total, level = None, None
    while True:  # the level only rises, and each round caps at least one more source
        full = F.lit(False) if level is None else F.col("weight") * level > F.col("cap")
        got = table.agg(
            F.sum("source_size").alias("all"),
            F.sum(F.when(full, F.col("cap"))).alias("capped"),
            F.sum(F.when(~full, F.col("weight"))).alias("open"),
        ).first()
        total = share * (got["all"] or 0)
        if not got["open"]:
            break
        new = (total - (got["capped"] or 0.0)) / got["open"]
        if level is not None and new == level:
            break
        level = new
    target = F.least(F.col("weight") * (level or 0.0), F.col("cap"))
    return table.withColumn("target", target).drop("cap")


def schedule(targets: DataFrame, block_tokens: int, n_sources: int) -> DataFrame:
    """Slots ``slot_no, source_no, source_rank``: which source the mix draws a block from next.

    ``source_rank`` counts a source's slots from 0. A source gets as many slots as its target
    needs. Three points for each slot always suffice, as the gaps between n golden-ratio points
    stay under 2.62 / n.
    """
    spark = targets.sparkSession
    b = F.lit(block_tokens)
    want = F.floor("target").cast("long")
    size = F.greatest(F.col("source_size"), F.lit(1))
    blocks = F.ceil(size / b).cast("long")
    full = F.floor(want / size).cast("long")
    need = (full * blocks + F.ceil((want - full * size) / b)).cast("long")
    slots = targets.select("source_no", need.alias("need")).where("need > 0")
    upto = Window.orderBy("source_no").rowsBetween(Window.unboundedPreceding, 0)
    # one row for each source; beyond the broadcast bound the running sum is taken in two levels
    if n_sources <= BROADCAST_SOURCES:
        edges = slots.withColumn("high", F.sum("need").over(upto))
    else:
        group = F.floor(F.col("source_no") / 10_000)
        inner = Window.partitionBy("g").orderBy("source_no").rowsBetween(Window.unboundedPreceding, 0)
        sums = slots.groupBy(group.alias("g")).agg(F.sum("need").alias("n"))
        before = Window.orderBy("g").rowsBetween(Window.unboundedPreceding, -1)
        sums = sums.select("g", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("low0"))
        edges = (
            slots.withColumn("g", group)
            .withColumn("high", F.sum("need").over(inner))
            .join(sums, "g")
            .withColumn("high", F.col("high") + F.col("low0"))
            .drop("g", "low0")
        )
    edges = materialise(edges.withColumn("low", F.col("high") - F.col("need")))
    n_slots = edges.agg(F.max("high")).first()[0] or 0
    # a source's interval is found through a grid of equal cells, not by comparing with all
    cells = max(1, min(2 * n_sources, n_slots))
    width = n_slots / cells if n_slots else 1.0
    grid = edges.withColumn(
        "cell", F.explode(F.sequence(F.floor(F.col("low") / width), F.floor((F.col("high") - 1e-9) / width)))
    )
    turn = F.col("id") * F.lit(GOLDEN)
    points = (
        spark.range(3 * n_slots)
        .select(F.col("id").alias("slot_no"), ((turn - F.floor(turn)) * float(n_slots)).alias("point"))
        .withColumn("cell", F.floor(F.col("point") / width))
    )
    drawn = points.join(_small(grid, 4 * n_sources), "cell").where("point >= low AND point < high")
    # rank inside stretches of the schedule, then shift by the counts of earlier stretches
    drawn = drawn.select("slot_no", "source_no", "need", F.expr("slot_no div 65536").alias("stretch"))
    counts = drawn.groupBy("source_no", "stretch").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("source_no").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("shift", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    inside = Window.partitionBy("source_no", "stretch").orderBy("slot_no")
    return (
        drawn.withColumn("k", F.row_number().over(inside) - 1)
        .join(counts.select("source_no", "stretch", "shift"), ["source_no", "stretch"])
        .withColumn("source_rank", F.col("k") + F.col("shift"))
        .where("source_rank < need")
        .select("slot_no", "source_no", "source_rank")
    )


def mix_sources(docs: DataFrame, block_tokens: int = 4096, **target_options) -> dict:
    """``documents``: what the mix takes of each; ``slots``: the schedule with block numbers.

    A slot takes ``slot_tokens`` words from the start of block ``block`` of its source; blocks
    hold ``block_tokens`` words of the source's documents in shuffled order (md5 of doc_id).
    """
    sizes = materialise(
        docs.select(
            F.col("doc_id"),
            F.col("source").cast("string").alias("source"),
            word_count(F.col("text")).alias("size"),
            F.rand(seed=3).alias("__salt"),
        )
    )
    targets = materialise(source_targets(sizes, **target_options))
    n_sources = targets.count()
    b = F.lit(block_tokens)
    known = targets.select(F.col("source").alias("__source"), "source_no", "source_size", "target")
    joined = (
        sizes.join(_small(known, n_sources), F.col("source").eqNullSafe(F.col("__source")))
        .drop("__source")
        .withColumn("key", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    )
    # each range of the shuffled order is summed up on its own and shifted by the ranges before it;
    # the salt lets rows of one id and size fall into several ranges
    order = ["key", "doc_id", "size", "__salt"]
    ranged = materialise(joined.repartitionByRange("source_no", *order).withColumn("__part", F.spark_partition_id()))
    earlier = Window.partitionBy("source_no").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sums = ranged.groupBy("source_no", "__part").agg(F.sum("size").alias("n"))
    sums = sums.select("source_no", "__part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("shift"))
    upto = Window.partitionBy("source_no", "__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    placed = (
        ranged.withColumn("start", F.sum("size").over(upto) - F.col("size"))
        .join(sums, ["source_no", "__part"])
        .withColumn("start", F.col("start") + F.col("shift"))
        .select("doc_id", "source", "source_no", "size", "source_size", "target", "start")
    )
    placed = materialise(placed)
    facts = targets.select("source_no", "source_size", F.floor("target").cast("long").alias("want"))
    slots = (
        schedule(targets, block_tokens, n_sources)
        .join(_small(facts, n_sources), "source_no")
        .withColumn("blocks", F.ceil(F.col("source_size") / b).cast("long"))
        .withColumn("block", F.expr("source_rank % blocks"))
        .withColumn("begin", F.expr("source_rank div blocks") * F.col("source_size") + F.col("block") * b)
        .withColumn("block_size", F.least(b, F.col("source_size") - F.col("block") * b))
        .withColumn("slot_tokens", F.greatest(F.lit(0), F.least(F.col("block_size"), F.col("want") - F.col("begin"))))
        .select("slot_no", "source_no", "source_rank", "block", "block_size", "slot_tokens")
    )
    whole = F.col("slot_tokens") == F.col("block_size")
    drawn = slots.groupBy("source_no", "block").agg(
        F.count(F.when(whole, 1)).alias("n_whole"),
        F.coalesce(F.max(F.when(~whole, F.col("slot_tokens"))), F.lit(0)).alias("part"),
    )
    pieces = (
        placed.where("size > 0")
        .withColumn("block", F.explode(F.expr(f"sequence(start div {block_tokens}, (start + size - 1) div {block_tokens})")))
        .withColumn("from", F.greatest(F.lit(0), F.col("start") - F.col("block") * b))
        .withColumn("len", F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * b) - F.greatest(F.col("start"), F.col("block") * b))
        .join(drawn, ["source_no", "block"], "left")
        .withColumn(
            "taken",
            F.coalesce(F.col("n_whole"), F.lit(0)) * F.col("len")
            + F.greatest(F.lit(0), F.least(F.col("len"), F.coalesce(F.col("part"), F.lit(0)) - F.col("from"))),
        )
    )
    same = ["doc_id", "source", "source_no", "size", "source_size", "target", "start"]
    filled = pieces.groupBy(*same).agg(F.sum("taken").cast("long").alias("taken"))
    empty = placed.where("size = 0").select(*same, F.lit(0).cast("long").alias("taken"))
    return {"documents": filled.unionByName(empty), "slots": slots, "targets": targets}


def op5_mixing(spark, sf_dir: str) -> DataFrame:
    """Words the mix takes of every document."""
    mixed = mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet"))["documents"]
    return mixed.select("doc_id", "size", "source_size", F.col("target").cast("double").alias("target"), "taken", "source", "start")
