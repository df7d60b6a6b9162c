"""How many rows a query meets, and what it finds, on even and on clustered vectors."""

import numpy as np
import pytest

from stripweave.llm import hilbert_ann

OPTIONS = {"query_filter": "vec_id % 20 = 0", "k": 20, "n_orderings": 16, "axes": 4, "bits": 8, "target_recall": 0.95, "sample_queries": 64, "sample_vectors": 10_000, "block_rows": 4096, "seed": 11}


def recall(got, x):
    hits = []
    for q, own in got.groupby("query_id"):
        s = x @ x[q]
        s[q] = -np.inf
        hits.append(len(set(np.argsort(-s, kind="stable")[:20]) & set(own.vec_id)) / 20)
    return float(np.mean(hits))


def frame(spark, x):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)


def test_clusters_cost_far_less_than_all_rows(spark):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(60, 32)) * 3
    x = centres[rng.integers(60, size=6000)] + rng.normal(size=(6000, 32)) * 0.5
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = frame(spark, x)
    index = hilbert_ann.build_index(rows, **OPTIONS)
    assert hilbert_ann.compared_rows(index) < 0.6 * len(x)
    got = hilbert_ann.nearest(rows).toPandas()
    assert got.query_id.nunique() == 300 and recall(got, x) >= 0.9


def test_even_vectors_cost_no_more_than_all_rows(spark):
    x = np.random.default_rng(9).normal(size=(2000, 64))
    rows = frame(spark, x)
    assert hilbert_ann.compared_rows(hilbert_ann.build_index(rows, **OPTIONS)) <= len(x)
    assert recall(hilbert_ann.nearest(rows).toPandas(), x) >= 0.9


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.01"])
def test_given_vectors(spark, folder):
    rows = spark.read.parquet(f"/root/testdata/{folder}/embeddings.parquet")
    index = hilbert_ann.build_index(rows, **OPTIONS)
    assert hilbert_ann.compared_rows(index) <= index.n


def test_blocks_and_parts_change_nothing(spark):
    x = np.random.default_rng(10).normal(size=(700, 6))
    rows = frame(spark, x)
    whole, cut = (sorted(map(tuple, hilbert_ann.nearest(rows, query_filter="vec_id % 3 = 0", n_orderings=4, target_recall=1.0, sample_queries=300, block_rows=b).select("query_id", "rank", "vec_id").collect())) for b in (4096, 50))
    same = len(set(whole) & set(cut)) / len(whole)
    assert len(whole) == len(cut) and same > 0.98


def test_one_vector(spark):
    rows = spark.createDataFrame([(0, [1.0, 2.0]), (20, [1.0, 2.0])], "vec_id long, embedding array<double>")
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in hilbert_ann.nearest(rows).collect()) == [(0, 1, 20, 5.0), (20, 1, 0, 5.0)]
