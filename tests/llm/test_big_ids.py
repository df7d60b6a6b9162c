"""Ids that no double holds, beside a null in the same batch; workers without the package; one result for any partitioning."""

import os
import pickle
import subprocess
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from stripweave.llm import decontamination, katz, langid, line_dedup, line_rules, mixing, near_copies, packing, quality_trees, simhash, stages, wrapper_html

IDS = [2**53 + 1, None, 7, 2**63 - 1, -(2**53) - 1]
KNOWN = sorted(i for i in IDS if i is not None)


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, f"text number {n} of its own, quite unlike the other {'abcdefgh'[n] * 9} texts\nand one more line of words {n * 977}", "en", "s") for n, i in enumerate(IDS)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").coalesce(1)


def ids(frame, name="doc_id"):
    return sorted({r[0] for r in frame.select(name).collect()} - {None})


def test_ids_pass_whole(docs, odd_labels):
    assert ids(packing.pack_documents(docs)) == KNOWN
    assert ids(katz.katz_scores(docs, F.lit(True))) == KNOWN
    model = quality_trees.train_quality(docs, odd_labels)
    assert ids(quality_trees.score_documents(docs, model, "__s")) == KNOWN
    assert ids(line_rules.line_quality(docs)) == KNOWN
    assert ids(mixing.mix_sources(docs)["documents"]) == KNOWN
    assert ids(line_dedup.dedup_lines(docs)) == KNOWN
    assert ids(langid.predict_languages(docs.select("doc_id", "text"), langid.train_languages(docs))) == KNOWN
    assert ids(simhash.near_duplicates(docs)) == KNOWN
    assert ids(simhash.near_duplicates(docs), "component_id") == KNOWN
    assert ids(near_copies.near_copies(docs)) == KNOWN and near_copies.keep_one(docs).count() == len(IDS)
    assert ids(decontamination.find_contamination(docs, docs.select(F.col("doc_id").alias("item_id"), "text"))) == KNOWN


def test_pages_keep_their_ids(docs):
    pages = docs.select(F.col("doc_id").alias("page_id"), F.lit("https://a.example/").alias("url"), F.col("text").alias("html"))
    assert ids(wrapper_html.main_text(pages), "page_id") == KNOWN


def test_mix_is_the_same_for_any_partitioning(spark):
    rows = [(i, f"{c} shares {n} words with others of its {c * 4}", "s", n) for n, (i, c) in enumerate([(5, c) for c in "abcdefgh"] + [(None, c) for c in "abcdefgh"] * 3)]
    rows += [(100 + i, "filler words " * 9, "t", 0) for i in range(30)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string, n int")
    results = [sorted(map(repr, stages.mix(spark, frame.orderBy(*order).repartition(parts), None).collect())) for parts, order in ((1, ["n"]), (3, ["text"]), (7, [F.desc("n")]))]
    assert results[0] == results[1] == results[2]


@pytest.mark.parametrize("function, argument", [(katz.squeeze, "np.arange(5)"), (langid.gram_counts, "'some text'"), (wrapper_html.is_furniture, "'nav'"), (packing._Encoder, "'a', None"), (decontamination._powers, "np.uint64(3), 4")])
def test_functions_arrive_without_the_package(function, argument, tmp_path):
    katz.squeeze(__import__("numpy").arange(3)), wrapper_html.is_furniture("menu")  # what this process has made stays here
    (tmp_path / "f").write_bytes(cloudpickle.dumps(function))
    code = f"import pickle, numpy as np; f = pickle.load(open({str(tmp_path / 'f')!r}, 'rb')); f({argument}); import sys; assert 'stripweave' not in sys.modules"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], check=True, cwd=tmp_path, env=env)
    assert pickle.loads(cloudpickle.dumps(function)) is not None
