"""The classifier's and the language model's scores against plain walks and plain cosines; ties and repeats."""

import collections
import math

import numpy as np
import pytest

from stripweave.llm import langid, quality_trees

MASK = (1 << 64) - 1


def walk(model, features):
    """One document through one tree after the other."""
    total = model["base"]
    for t in range(len(model["leaf"])):
        node = 0
        while 2 * node + 2 < len(model["leaf"][t]):
            node = 2 * node + (2 if features[model["feature"][t][node]] > model["cut"][t][node] else 1)
        total += model["leaf"][t][node]
    return 1 / (1 + math.exp(-total))


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")


def test_trees_against_a_plain_walk(spark, sf, docs):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    model = quality_trees.train_quality(docs, labels)
    twice = docs.unionByName(docs.limit(20))
    got = quality_trees.score_documents(twice, model).collect()
    assert len(got) == docs.count() + 20
    for r in got:
        assert abs(r.score - walk(model, quality_trees.document_statistics(r.text))) < 1e-9
    assert len({(r.doc_id, r.score) for r in got}) == docs.count()
    # labels of the held-out fold change nothing
    held = quality_trees.id_remainder(labels["doc_id"], 5) == 0
    other = labels.withColumn("quality", (~held).cast("int") * labels["quality"] + held.cast("int") * (1 - labels["quality"]))
    again = quality_trees.train_quality(docs, other)
    assert all(np.array_equal(model[k], again[k]) for k in ("feature", "cut", "leaf"))


def test_tied_rows_are_never_split():
    x = np.array([[1.0, 5.0]] * 30 + [[2.0, 5.0]] * 30)
    y = np.array([0.0, 1.0] * 15 + [1.0] * 30)
    model = quality_trees.fit_trees(x, y)
    p = quality_trees.tree_scores(model, x)
    assert len(set(np.round(p[:30], 12))) == 1 and p[0] < p[-1]
    constant = quality_trees.fit_trees(np.ones((40, 2)), np.array([0.0, 1.0] * 20))
    assert np.allclose(quality_trees.tree_scores(constant, np.ones((3, 2))), 0.5)


def test_one_id_with_many_rows_stays_within_the_bound(spark):
    rows = [(1, f"text number {i} of one id") for i in range(3000)] + [(i, "same text") for i in range(2, 60)] + [(1, "copy")] * 500
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 60)], "doc_id long, quality int")
    model = quality_trees.train_quality(frame, labels, max_rows=100)
    assert quality_trees.score_documents(frame.limit(5), model).where("score BETWEEN 0 AND 1").count() == 5


def plain_vector(text, idf):
    """Weights of a text's hashed letter grams, one gram at a time."""
    letters, word = [], False
    for c in text.lower():
        if c.isalpha():
            letters.append(ord(c))
        elif word:
            letters.append(32)
        word = c.isalpha()
    letters = [32, *letters, 32]
    grams = collections.Counter()
    for i, c in enumerate(letters):
        keys = [c]
        if i + 1 < len(letters):
            keys.append(c * 0x1F35D + letters[i + 1] + (1 << 40))
        if i + 2 < len(letters):
            keys.append((c * 0x1F35D + letters[i + 1]) * 0x1F35D + letters[i + 2] + (1 << 50))
        grams.update((k * 0x9E3779B97F4A7C15 & MASK) >> 52 for k in keys)
    return {g: math.log1p(n) * float(idf[g]) for g, n in grams.items()}


def test_languages_against_plain_cosines(docs):
    model = langid.train_languages(docs)
    got = langid.predict_languages(docs.select("doc_id", "text"), model).collect()
    some = [r for r in got if r.text and any(c.isalpha() for c in r.text)][:60]
    for r in some:
        v = plain_vector(r.text, model["idf"])
        size = math.sqrt(sum(x * x for x in v.values()))
        cosines = [sum(x * float(c[g]) for g, x in v.items()) / size for c in model["centers"]]
        best = max(range(len(cosines)), key=lambda k: cosines[k])
        assert abs(r.score - max(0.0, min(1.0, cosines[best]))) < 1e-4
        assert r.lang_pred == model["langs"][best] or max(cosines) - max(c for c, lang in zip(cosines, model["langs"]) if lang == r.lang_pred) < 1e-5
    # the held-out fold teaches nothing
    held = quality_trees.id_remainder(docs["doc_id"], 3) == 1
    fewer = langid.train_languages(docs.where(~held))
    assert np.array_equal(model["idf"], fewer["idf"]) and model["langs"] == fewer["langs"] and np.array_equal(model["centers"], fewer["centers"])


def test_equal_centroids_go_to_the_smaller_language(spark):
    text = "der hund und die katze laufen durch den wald"
    frame = spark.createDataFrame([(i, text, lang) for i, lang in enumerate(["zz", "aa"] * 12)], "doc_id long, text string, lang string")
    model = langid.train_languages(frame)
    got = langid.predict_languages(frame.select("doc_id", "text"), model).collect()
    assert {r.lang_pred for r in got} == {"aa"} and len({r.score for r in got}) == 1
