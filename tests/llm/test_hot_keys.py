"""Rows that share one id, or have none, and are alike: nothing may be lost, and results must be whole."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from stripweave.llm import mixing, packing


@pytest.fixture(scope="module")
def alike(spark):
    rows = [(None, "one two three", "hot")] * 600 + [(7, "four five", "hot")] * 300 + [(i, "six " * (i % 9), "b") for i in range(100, 400)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(6)


def test_mixing(alike):
    got = mixing.mix_sources(alike, block_tokens=64)["documents"].toPandas()
    assert len(got) == alike.count() and (got.taken <= 2 * got["size"]).all()
    per = got.groupby("source").agg(taken=("taken", "sum"), target=("target", "first"))
    assert (per.taken == np.floor(per.target)).all()
    for _, own in got.groupby("source"):  # the order of a source has no gap and no overlap
        own = own[own["size"] > 0].sort_values("start")
        assert (own.start.to_numpy() == np.r_[0, own["size"].cumsum().to_numpy()[:-1]]).all()


def test_packing(alike):
    got = packing.pack_documents(alike).toPandas()
    assert len(got) == alike.count() and got.groupby("sequence_id").length.sum().max() <= 1024
    ordered = got.sort_values(["sequence_id", "offset"])
    assert (ordered.groupby("sequence_id").length.cumsum() - ordered.length == ordered.offset).all()


def test_reruns_of_the_mix_agree(alike):
    once, again = (sorted(map(tuple, mixing.mix_sources(alike)["documents"].select(F.coalesce("doc_id", F.lit(-1)), "size", "taken").collect())) for _ in range(2))
    assert once == again
