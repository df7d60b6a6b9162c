"""Approximate nearest neighbours by inner product over several shifted Hilbert orderings.

Every distinct vector is projected on some axes, shifted, and placed on a Hilbert curve; Spark
range-partitions and ranks each ordering. A query meets the vectors of its window in all orderings that
are used; their best are merged and reranked by the exact inner product. The axes are fitted on a bounded
sample of vectors (``sample_vectors``). How many orderings are used, and how wide the window is, is fitted
on a bounded sample of queries (``sample_queries``), whose truth comes from comparing that sample with all
rows block by block: the choice that finds ``target_recall`` of the true neighbours with the fewest
comparisons. Vectors without clusters have no such ordering; then one wide window remains, which compares
no more than all rows. Windows are cut into blocks and their queries into parts, so no task holds more than
``block_rows`` vectors of either side at a time.

Defined results: vectors that are null, empty, all zero or hold a null or non-finite component take
no part, nor do rows with a null vec_id or another length than most; equal vectors are indexed once
with their smallest ids; repeated rows of one vec_id and vector count once; ties go to the smaller
vec_id; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, spread_rank


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Position on the Hilbert curve of integer points (n, p) with coordinates under 2 ** bits.

    Walks down from the coarsest level. At each level the cube's corner, in Gray order from where
    the curve enters, is the next digit; entry point and direction then turn for the level below.
    """
    n, p = cells.shape
    one, full = np.uint64(1), np.uint64(2**p - 1)
    entry, turn, key = np.zeros(n, np.uint64), np.zeros(n, np.int64), np.zeros(n, np.uint64)

    def rotated(x: np.ndarray, by: np.ndarray) -> np.ndarray:  # p-bit rotation to the right
        by = (by % p).astype(np.uint64)
        return ((x >> by) | (x << (np.uint64(p) - by))) & full

    for level in range(bits - 1, -1, -1):
        corner = np.zeros(n, np.uint64)
        for axis in range(p):
            corner |= (cells[:, axis].astype(np.uint64) >> np.uint64(level) & one) << np.uint64(axis)
        code = rotated(corner ^ entry, turn + 1)
        digit = code.copy()
        for s in (1, 2, 4, 8, 16, 32):
            digit ^= digit >> np.uint64(s)
        key = key << np.uint64(p) | digit
        even = np.where(digit > 0, (digit - (digit > 0)) & ~one, 0).astype(np.uint64)
        start = even ^ (even >> one)
        entry = entry ^ rotated(start, p - (turn + 1) % p)
        odd = np.where(digit & one, digit, np.where(digit > 0, digit - (digit > 0), 0)).astype(np.uint64)
        trailing = np.zeros(n, np.int64)
        rest = odd.copy()
        for _ in range(p):
            is_one = (rest & one).astype(bool)
            trailing += is_one
            rest = np.where(is_one, rest >> one, 0).astype(np.uint64)
        turn = (turn + np.where(digit > 0, trailing, 0) + 1) % p
    return key


def _orderings(sample: np.ndarray, n_orderings: int, axes: int, seed: int, variance: float = 0.9) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each ordering its axes (dims, axes), and the mean and spread of the sample along them.

    Axes are random rotations inside the principal components that hold ``variance`` of the sample's
    variance: clustered vectors are told apart by few components, even ones by nearly all.
    """
    rng = np.random.default_rng(seed)
    values, vectors = np.linalg.eigh(np.cov(sample.T).reshape(sample.shape[1], -1) + 1e-12 * np.eye(sample.shape[1]))
    values, vectors = values[::-1], vectors[:, ::-1]
    held = int(np.searchsorted(np.cumsum(values), variance * values.sum()) + 1)
    held = min(sample.shape[1], max(axes, held))
    columns: list[np.ndarray] = []
    while len(columns) < n_orderings * axes:
        columns += list((vectors[:, :held] @ np.linalg.qr(rng.normal(size=(held, held)))[0]).T)
    made = []
    for k in range(n_orderings):
        own = np.array(columns[k * axes : (k + 1) * axes]).T
        x = sample @ own
        made.append((own, x.mean(axis=0), np.maximum(x.std(axis=0), 1e-12)))
    return made


def usable_vectors(rows: DataFrame) -> DataFrame:
    """Rows ``vec_id, v`` that take part."""
    v = F.col("embedding")
    good = F.size(v) > 0
    good &= F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good &= F.exists(v, lambda x: x != 0)
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & v.isNotNull() & good)
    lengths = rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").first()
    return rows.where(F.size("v") == (lengths["d"] if lengths else 0))


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


def _best(queries: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, score) of the k best rows for every query; scores are summed pair by pair."""
    k = min(k, len(rows))
    qs, cs = [], []
    for at in range(0, len(queries), 256):
        s = queries[at : at + 256] @ rows.T
        top = np.argpartition(-s, k - 1, axis=1)[:, :k]
        qs.append(np.repeat(np.arange(at, at + len(s)), k))
        cs.append(top.ravel())
    q, c = np.concatenate(qs), np.concatenate(cs)
    return q, c, np.einsum("ij,ij->i", queries[q], rows[c])


class Index:
    """Entries of the index, their places in the orderings that are used, and what the fit chose.

    ``entries``: ``entry, v, ids``; ``ranked``: ``entry, ordering, place``; ``asked``: ``query_id, v``;
    ``heads``: entries of the queries. ``window`` is the distance in places up to which a query meets
    entries, in each of ``n_orderings`` orderings.
    """

    def __init__(self, **parts):
        self.__dict__.update(parts)


def build_index(
    vectors: DataFrame,
    query_filter: str,
    k: int,
    n_orderings: int,
    axes: int,
    bits: int,
    target_recall: float,
    sample_queries: int,
    sample_vectors: int,
    block_rows: int,
    seed: int,
) -> Index | None:
    """The fitted index; None without usable vectors. Parameters as of ``nearest``."""
    rows = materialise(usable_vectors(vectors).dropDuplicates(["vec_id", "v"]))
    # equal vectors are one entry of the index with its k + 1 smallest ids
    order = Window.partitionBy("v").orderBy("vec_id")
    few = rows.withColumn("__k", F.row_number().over(order)).where(F.col("__k") <= k + 1)
    entries = materialise(few.groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")).withColumn("entry", F.get("ids", F.lit(0))))
    n = entries.count()
    if not n:
        return None
    # the axes are fitted on at most sample_vectors entries, chosen by hash
    some = entries.select("v").orderBy(F.xxhash64("entry"), "entry").limit(sample_vectors).toPandas()
    frames = _orderings(_matrix(some["v"]) if n > 1 else np.repeat(_matrix(some["v"]), 2, axis=0), n_orderings, axes, seed)
    shifts = np.random.default_rng(seed + 1).random((n_orderings, axes))

    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            x = _matrix(frame["v"])
            for o, (own, mean, spread) in enumerate(frames):
                unit = np.clip((x @ own - mean) / (8 * spread) + 0.5, 0, 1)  # four standard deviations to each side
                cells = ((unit + shifts[o]) / 2 * (2**bits - 1)).astype(np.int64)
                yield pd.DataFrame({"entry": frame["entry"], "ordering": o, "key": hilbert_index(cells, bits).astype(np.int64)})

    ranked = spread_rank(
        entries.select("entry", "v").mapInPandas(keys, "entry long, ordering int, key long"), ["ordering", "key", "entry"], "place"
    )
    # each ordering holds every entry once
    ranked = materialise(ranked.select("entry", "ordering", (F.col("place") - 1 - F.col("ordering") * n).alias("place")))
    asked = materialise(rows.where(query_filter).select("v", F.col("vec_id").alias("query_id")))
    heads = materialise(asked.select("v").distinct().join(entries.select("v", "entry"), "v").select("entry"))
    used, window = _fit(entries, heads, ranked, n, n_orderings, k, target_recall, sample_queries, block_rows)
    return Index(entries=entries, ranked=ranked.where(F.col("ordering") < used), asked=asked, heads=heads, n=n, n_orderings=used, window=window, block=_block(window, block_rows))


def _block(window: int, block_rows: int) -> int:
    return max(1, min(max(window // 2, 64), block_rows))


def meetings(index: Index, block_rows: int) -> tuple[DataFrame, DataFrame]:
    """Who meets whom: queries and entries, both with ``ordering, block, part``.

    A block holds at most ``block_rows`` entries. The queries that a block is near to are cut into parts
    of at most ``block_rows``, and the block is copied to each part.
    """
    window, block = index.window, index.block
    asked = spread_rank(index.ranked.join(index.heads, "entry"), ["ordering", "place"], "__rank")
    first, last = F.floor((F.col("place") - window) / block), F.floor((F.col("place") + window) / block)
    left = asked.withColumn("block", F.explode(F.sequence(F.greatest(first, F.lit(0)), F.least(last, F.lit((index.n - 1) // block)))))
    left = materialise(left.select("entry", "ordering", "block", F.expr(f"(__rank - 1) div {block_rows}").alias("part")))
    right = index.ranked.select("entry", "ordering", F.floor(F.col("place") / block).alias("block"))
    right = right.join(left.select("ordering", "block", "part").distinct(), ["ordering", "block"])
    return left, right


def compared_rows(index: Index, block_rows: int = 4096) -> float:
    """Entries that a query meets, counted as often as it meets them, on average."""
    left, right = meetings(index, block_rows)
    keys = ["ordering", "block", "part"]
    sizes = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("q")).join(right.groupBy(*keys).agg(F.count(F.lit(1)).alias("c")), keys)
    return float(sizes.agg(F.sum(F.col("q") * F.col("c"))).first()[0] or 0) / max(1, index.heads.count())


def nearest(
    vectors: DataFrame,
    query_filter: str = "vec_id % 20 = 0",
    k: int = 20,
    n_orderings: int = 16,
    axes: int = 4,
    bits: int = 8,
    target_recall: float = 0.95,
    sample_queries: int = 64,
    sample_vectors: int = 10_000,
    block_rows: int = 4096,
    seed: int = 11,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k nearest found for every row of ``query_filter``."""
    index = build_index(vectors, query_filter, k, n_orderings, axes, bits, target_recall, sample_queries, sample_vectors, block_rows, seed)
    if index is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    entries, asked = index.entries, index.asked
    # new names for both sides, as they come from the same tables
    left, right = (rows.toDF(*rows.columns) for rows in (rows.join(entries.select("entry", "v"), "entry") for rows in meetings(index, block_rows)))

    def meet(key, q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(c):
            return pd.DataFrame({"head": [], "entry": [], "score": []})
        i, j, s = _best(_matrix(q["v"]), _matrix(c["v"]), k + 1)
        return pd.DataFrame({"head": q["entry"].to_numpy()[i], "entry": c["entry"].to_numpy()[j], "score": s})

    keys = ["ordering", "block", "part"]
    found = (
        left.groupBy(*keys)
        .cogroup(right.groupBy(*keys))
        .applyInPandas(meet, "head long, entry long, score double")
        .groupBy("head", "entry")
        .agg(F.max("score").alias("score"))
    )
    best = Window.partitionBy("head").orderBy(F.desc("score"), "entry")
    found = found.withColumn("__k", F.row_number().over(best)).where(F.col("__k") <= k + 1)
    named = found.join(entries.select("entry", "ids"), "entry").select("head", "score", F.explode("ids").alias("vec_id"))
    top = Window.partitionBy("head").orderBy(F.desc("score"), "vec_id")
    named = materialise(named.withColumn("__k", F.row_number().over(top)).where(F.col("__k") <= k + 1).select("head", "score", "vec_id"))
    who = asked.join(entries.select("v", F.col("entry").alias("head")), "v").select("query_id", "head")
    out = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        who.distinct()
        .join(named, "head")
        .where("vec_id <> query_id")
        .withColumn("rank", F.row_number().over(out))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def _fit(entries: DataFrame, heads: DataFrame, ranked: DataFrame, n: int, n_orderings: int, k: int, target: float, sample: int, block_rows: int) -> tuple[int, int]:
    """How many orderings to use and how wide a window, so that ``target`` of the true neighbours of
    ``sample`` queries are met and the fewest entries compared.

    One ordering whose window spans all entries compares each of them once; several that would compare
    more than that are never chosen.
    """
    some = heads.orderBy(F.xxhash64("entry"), "entry").limit(sample).join(entries.select("entry", "v"), "entry").toPandas()
    if not len(some):
        return 1, 1
    some = some.sort_values("entry")
    q, ids = _matrix(some["v"]), some["entry"].to_numpy()

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            i, j, s = _best(q, _matrix(frame["v"]), k + 1)
            yield pd.DataFrame({"head": ids[i], "entry": frame["entry"].to_numpy()[j], "score": s})

    order = Window.partitionBy("head").orderBy(F.desc("score"), "entry")
    true = (
        entries.select("entry", "v").mapInPandas(compare, "head long, entry long, score double")
        .where("head <> entry").withColumn("__k", F.row_number().over(order)).where(F.col("__k") <= k).select("head", "entry")
    )
    true = materialise(true)  # sample * k rows
    at = materialise(ranked.join(F.broadcast(true.select("entry").union(true.select("head")).distinct()), "entry"))
    far = (
        true.join(at, "entry")
        .join(at.select(F.col("entry").alias("head"), "ordering", F.col("place").alias("own")), ["head", "ordering"])
        .groupBy("head", "entry")
        .pivot("ordering", list(range(n_orderings)))
        .agg(F.min(F.abs(F.col("place") - F.col("own"))))
        .toPandas()
    )
    if not len(far):
        return 1, 1
    nearest_yet = np.minimum.accumulate(far[[str(o) for o in range(n_orderings)]].to_numpy(dtype=float), axis=1)
    best = None
    for m in range(1, n_orderings + 1):
        window = int(min(n, max(1, np.ceil(np.quantile(nearest_yet[:, m - 1], target)))))
        cost = m * min(n, 2 * window + 2 * _block(window, block_rows))
        if best is None or cost < best[0]:
            best = (cost, m, window)
    return best[1:]


def op8_hilbert_ann(spark, sf_dir: str) -> DataFrame:
    """The 20 nearest found for every query row of ``embeddings``."""
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
