"""Centroid clustering of integer vectors by a tournament of bisector tests.

Components become floor(scale * x). For each pair of centroids a < b the integer normal 2(b - a) and the
threshold |b|^2 - |a|^2 are worked out once a round: x is at least as near to a exactly if the product of x and
the normal is at most the threshold, so equal distances favour the smaller number. The centroids play a
knock-out; k - 1 such sign tests leave the nearest one, and only its distance is worked out, exactly. Each round
sends one row for each task, cluster and component through the shuffle, and their sums to the driver.

Defined results: vectors that are null, have another size, a null or non-finite component, or one of
2^27 / scale or more in size (beyond which sums of squares leave 64 bits) take no part. Starting centroids are the k
vectors of smallest SHA-256 of ``seed:id``, repeated rows included, equal hashes by their components; rows without an
id come last there. Fewer vectors than k give fewer clusters; ties go to the smaller number; empty
clusters keep their centroid; empty tables give empty results; other columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, materialise

MAX_CLUSTERS = 256  # normals of all pairs are held: k^2 / 2 vectors
_ROWS = 8192  # rows of a tournament at a time


def integer_vectors(df: DataFrame, id_col: str, vector_col: str, size: int, scale: int) -> DataFrame:
    """``id`` and ``v``, floor(scale * x) of each component; vectors that take no part are left out."""
    limit = float(2**27)

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("v")
            lengths = pa.compute.fill_null(pa.compute.list_value_length(lists), -1).to_numpy(zero_copy_only=False)
            rows = np.flatnonzero(lengths == size)
            values = pa.compute.list_flatten(lists.take(pa.array(rows)))
            flat = np.asarray(values.cast(pa.float64()).to_numpy(zero_copy_only=False), dtype=np.float64).reshape(-1, size)
            with np.errstate(invalid="ignore", over="ignore"):  # a null is NaN by now
                scaled = np.floor(flat * scale)
                fit = (np.abs(scaled) < limit).all(axis=1)
            whole = scaled[fit].astype(np.int32)
            ends = pa.array(np.arange(len(whole) + 1, dtype=np.int32) * size)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(pa.array(rows[fit])), pa.ListArray.from_arrays(ends, pa.array(whole.ravel()))], names=["id", "v"]
            )

    kind = df.schema[id_col].dataType
    schema = T.StructType([T.StructField("id", kind), T.StructField("v", T.ArrayType(T.IntegerType()))])
    return df.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")).mapInArrow(convert, schema)


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size).astype(np.int64)


class _Tournament:
    """Nearest of k integer centroids by k - 1 sign tests."""

    def __init__(self, centroids: np.ndarray):
        self.k, self.centroids = len(centroids), centroids
        squares = (centroids**2).sum(axis=1)
        self.normals = 2 * (centroids[None, :, :] - centroids[:, None, :])  # [a, b]: 2 (b - a)
        self.thresholds = squares[None, :] - squares[:, None]
        self.exact = [self.normals.astype(np.float64), self.thresholds.astype(np.float64)]
        self.largest = int(np.abs(self.normals).max(initial=0)), int(np.abs(self.thresholds).max(initial=0))

    def winners(self, x: np.ndarray) -> np.ndarray:
        # doubles hold every partial sum exactly below 2^53, and are added faster
        bound = int(np.abs(x).max(initial=0)) * self.largest[0] * x.shape[1] + self.largest[1]
        if bound < 2**53:
            normals, thresholds, x = *self.exact, x.astype(np.float64)
        else:
            normals, thresholds = self.normals, self.thresholds
        rounds = [np.full(len(x), i, dtype=np.int64) for i in range(self.k)]
        first = True
        while len(rounds) > 1:
            ahead = []
            for a, b in zip(rounds[::2], rounds[1::2]):  # numbers on the left are smaller
                if first:
                    side = x @ normals[a[0], b[0]] - thresholds[a[0], b[0]] if len(x) else np.zeros(0)
                else:
                    side = np.einsum("ij,ij->i", x, normals[a, b]) - thresholds[a, b]
                ahead.append(np.where(side <= 0, a, b))
            rounds, first = ahead + rounds[len(rounds) - len(rounds) % 2 :], False
        return rounds[0]

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cluster and squared distance of each row."""
        won = np.concatenate([self.winners(x[i : i + _ROWS]) for i in range(0, len(x), _ROWS)] or [np.zeros(0, dtype=np.int64)])
        return won, ((x - self.centroids[won]) ** 2).sum(axis=1)


def _totals(vectors: DataFrame, centroids: np.ndarray) -> dict[int, tuple[int, int, list[int]]]:
    """Count, distance sum and component sums of each non-empty cluster."""
    k, size = centroids.shape

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        play = _Tournament(centroids)
        # a task's sums stay exact: 2^27 times the rows of a task; distances are cut in two halves
        counts, near, sums = np.zeros(k, dtype=np.int64), np.zeros((k, 2), dtype=np.int64), np.zeros((k, size), dtype=np.int64)
        for batch in batches:
            x = _matrix(batch.column("v"), size)
            won, distance = play.assign(x)
            counts += np.bincount(won, minlength=k)
            np.add.at(near, won, np.stack((distance >> 31, distance & (2**31 - 1)), axis=1))
            for c in np.unique(won):
                sums[c] += x[won == c].sum(axis=0)
        some = np.flatnonzero(counts)
        table = np.concatenate((counts[some, None], near[some], sums[some]), axis=1)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(some, table.shape[1])), pa.array(np.tile(np.arange(table.shape[1]), len(some))), pa.array(table.ravel())], names=["cluster", "part", "total"]
        )

    rows = vectors.select("v").mapInArrow(partial, "cluster long, part long, total long")
    done = rows.groupBy("cluster", "part").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()  # at most k rows for each component
    parts: dict[int, dict[int, int]] = {}
    for r in done:
        parts.setdefault(r["cluster"], {})[r["part"]] = int(r["total"])
    return {c: (v[0], (v[1] << 31) + v[2], [v[3 + i] for i in range(size)]) for c, v in parts.items()}


def cluster_vectors(
    df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", size: int = 64, k: int = 8, rounds: int = 10, scale: int = 1024, seed: str = "3"
) -> tuple[DataFrame, list[dict]]:
    """``(assigned, clusters)``: ``id_col``, ``cluster`` and ``distance`` of each vector, and of each cluster its
    ``centroid``, count ``n`` and ``inertia`` (distance summed)."""
    if not 1 <= k <= MAX_CLUSTERS:
        raise ValueError(f"k must be from 1 to {MAX_CLUSTERS}")
    vectors = materialise(integer_vectors(df, id_col, vector_col, size, scale))
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    start = vectors.orderBy(key.asc_nulls_last(), "v").limit(k).collect()  # at most k rows
    centroids = np.array([r["v"] for r in start], dtype=np.int64).reshape(len(start), size)
    for _ in range(rounds if len(start) else 0):
        before = centroids.copy()
        for c, (n, _, sums) in _totals(vectors, centroids).items():
            centroids[c] = [s // n for s in sums]
        if (before == centroids).all():
            break  # further rounds would change nothing
    totals = _totals(vectors, centroids) if len(start) else {}

    def final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        play = _Tournament(centroids)
        for batch in batches:
            won, distance = play.assign(_matrix(batch.column("v"), size))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(won.astype(np.int32)), pa.array(distance)], names=[id_col, "cluster", "distance"])

    kind = vectors.schema["id"].dataType
    schema = T.StructType([T.StructField(id_col, kind), T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])
    if not len(start):
        discard(vectors)
        return df.sparkSession.createDataFrame([], schema), []
    clusters = [
        {"cluster": c, "centroid": centroids[c].tolist(), "n": totals.get(c, (0,))[0], "inertia": totals.get(c, (0, 0))[1]} for c in range(len(centroids))
    ]
    return vectors.mapInArrow(final, schema), clusters


def op12_centroids(spark, sf_dir: str) -> DataFrame:
    """Cluster of every vector, with its distance, the inertia and a digest of the cluster's centroid."""
    assigned, clusters = cluster_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    digests = [hashlib.sha256(",".join(map(str, c["centroid"])).encode()).hexdigest() for c in clusters]
    inertia = [c["inertia"] for c in clusters]

    def by_cluster(values: list, kind: str):
        return F.get(F.array(*[F.lit(v) for v in values]), F.col("cluster")).cast(kind) if values else F.lit(None).cast(kind)

    return assigned.select(
        "vec_id", "cluster", "distance", by_cluster(inertia, "long").alias("cluster_inertia"),
        F.lit(sum(inertia)).cast("long").alias("inertia"), by_cluster(digests, "string").alias("centroid_sha256"),
    )
