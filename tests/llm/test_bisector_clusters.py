"""Clusters against plain rounds of whole-number k-means."""

import hashlib
import math
import random

import numpy as np
import pytest

from stripweave.llm import bisector_clusters as B


def brute(rows, size, k, rounds, scale=1024, seed="3"):
    kept = []
    for i, v in rows:
        if v is not None and len(v) == size and all(x is not None and math.isfinite(x) and abs(math.floor(scale * x)) < 2**27 for x in v):
            kept.append((i, [math.floor(scale * x) for x in v]))
    start = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    centroids = [list(v) for _, v in start[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centroids))

    for _ in range(rounds):
        own = [nearest(v)[1] for _, v in kept]
        for n in range(len(centroids)):
            mine = [v for (_, v), o in zip(kept, own) if o == n]
            if mine:
                centroids[n] = [sum(x) // len(mine) for x in zip(*mine)]
    return sorted(((i, nearest(v)[1], nearest(v)[0]) for i, v in kept), key=repr), centroids


def check(spark, rows, size=4, k=3, rounds=5, kind="array<double>"):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], f"vec_id long, embedding {kind}, cluster int, id string").repartition(3)
    assigned, clusters = B.cluster_vectors(df, size=size, k=k, rounds=rounds)
    want, centroids = brute(rows, size, k, rounds)
    got = sorted(((r["vec_id"], r["cluster"], r["distance"]) for r in assigned.collect()), key=repr)
    assert got == want
    assert [c["centroid"] for c in clusters] == centroids
    for c in clusters:
        own = [d for _, n, d in want if n == c["cluster"]]
        assert (c["n"], c["inertia"]) == (len(own), sum(own))


def test_random_vectors_with_odd_rows(spark):
    rng = random.Random(5)
    rows = [(i, [rng.gauss(i % 3, 0.4) for _ in range(4)]) for i in range(200)]
    rows += [(2**53 + 1, [0.0] * 4), (2**63 - 1, [1.0] * 4), (None, [0.5] * 4), (None, None), (7, None), (8, []), (9, [1.0] * 3), (10, [1.0] * 5), (11, [1.0, None, 2.0, 3.0])]
    rows += [(12, [float("nan")] * 4), (13, [float("inf"), 0.0, 0.0, 0.0]), (14, [1e30] * 4), (15, [-131071.0] * 4), (0, rows[0][1]), (0, rows[0][1])]
    check(spark, rows)
    check(spark, rows, k=7, rounds=3)


def test_hot_vector_ties_and_empty_clusters(spark):
    rows = [(i, [1.0, 0.0, 0.0, 0.0]) for i in range(60)] + [(100 + i, [float(i % 2), float(i % 2), 0.0, 0.0]) for i in range(40)]
    check(spark, rows, k=8, rounds=4)


def test_fewer_vectors_than_clusters(spark):
    check(spark, [(1, [0.1, 0.2, 0.3, 0.4]), (2, [5.0, 0.0, 0.0, 0.0])], k=8)
    check(spark, [(1, [0.5] * 4)], k=8, kind="array<float>")


def test_no_vectors(spark):
    df = spark.createDataFrame([(1, [1.0])], "vec_id long, embedding array<double>")
    for frame in (df, df.limit(0)):
        assigned, clusters = B.cluster_vectors(frame, size=4)
        assert assigned.collect() == [] and clusters == [] and assigned.columns == ["vec_id", "cluster", "distance"]


@pytest.mark.parametrize("spread", [30, 2**26])
def test_tournament_is_nearest_centroid(spread):
    rng = np.random.default_rng(3)
    for k in (1, 2, 3, 5, 8, 13):
        centroids, x = rng.integers(-spread, spread, (k, 6)), rng.integers(-spread, spread, (500, 6))
        x[:k] = centroids
        far = ((x[:, None, :] - centroids[None]) ** 2).sum(axis=2)
        won, distance = B._Tournament(centroids).assign(x)
        assert (won == far.argmin(axis=1)).all() and (distance == far.min(axis=1)).all()
