"""Language identification by the nearest of several TF-IDF centroids per language.

A text's vector holds hashed letter 1- to 3-grams, weighted by inverse document frequency over all
training documents and scaled to length 1. Each language has a few centroids, found by spherical
k-means on a bounded sample of its documents; the largest cosine decides. A text farther from its
centroid than all but a small share of the training sample is flagged as ``rejected``.

Defined results: null texts and texts without a letter are ``und`` with score 0; documents with a
null lang or a null doc_id are not learned from; without training documents all are ``und``; ties
go to the smaller lang; repeated rows get equal results; empty tables give empty results.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PerWorker, materialise
from .quality_trees import id_remainder

DIMS = 4096


_tables = PerWorker()


def _letters() -> np.ndarray:
    if "letters" not in _tables:
        _tables["letters"] = np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), dtype=bool, count=sys.maxunicode + 1)
    return _tables["letters"]


def gram_counts(text: str | None) -> np.ndarray | None:
    """Counts of hashed letter 1-, 2- and 3-grams of a whole text; None without a letter."""
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
    letter = _letters()[codes]
    if not letter.any():
        return None
    c = np.where(letter, codes, 32).astype(np.uint64)
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # one space stands for what is between two words
    c = np.concatenate(([32], c[keep], [32])).astype(np.uint64)
    two = c[:-1] * np.uint64(0x1F35D) + c[1:] + np.uint64(1 << 40)
    three = (c[:-2] * np.uint64(0x1F35D) + c[1:-1]) * np.uint64(0x1F35D) + c[2:] + np.uint64(1 << 50)
    grams = np.concatenate((c, two, three)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - 12)
    return np.bincount(grams.astype(np.int64), minlength=DIMS)


def vectors(texts, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit TF-IDF vectors of texts, and which of them have a letter."""
    out, has = np.zeros((len(texts), DIMS), dtype=np.float32), np.zeros(len(texts), dtype=bool)
    for i, text in enumerate(texts):
        n = gram_counts(text)
        if n is not None:
            v = np.log1p(n) * idf
            out[i], has[i] = v / max(np.linalg.norm(v), 1e-12), True
    return out, has


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """At most k unit centroids of unit vectors."""
    rng = np.random.default_rng(seed)
    centers = x[rng.choice(len(x), size=min(k, len(x)), replace=False)]
    for _ in range(rounds):
        own = (x @ centers.T).argmax(axis=1)
        sums = np.zeros_like(centers)
        np.add.at(sums, own, x)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centers = np.where(norm > 0, sums / np.maximum(norm, 1e-12), centers)
    return centers


def train_languages(docs: DataFrame, folds: int = 3, held_fold: int = 1, clusters: int = 4, max_rows: int = 1000, reject_share: float = 0.005) -> dict:
    """Centroids per language; ``max_rows`` bounds the documents of a language that are clustered."""
    learn = docs.select("doc_id", "text", F.col("lang").cast("string").alias("lang")).where(
        F.col("lang").isNotNull() & (id_remainder(F.col("doc_id"), folds) != held_fold)
    )

    def document_frequency(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = np.zeros(DIMS, dtype=np.int64), 0
        for frame in batches:
            for text in frame["text"]:
                counts = gram_counts(text)
                if counts is not None:
                    total += counts > 0
                    n += 1
        yield pd.DataFrame({"bin": np.arange(DIMS + 1), "n": np.append(total, n)})

    found = learn.select("text").mapInPandas(document_frequency, "bin int, n long").groupBy("bin").agg(F.sum("n").alias("n")).collect()
    freq = np.zeros(DIMS + 1)
    for r in found:  # DIMS + 1 rows
        freq[r["bin"]] = r["n"]
    idf = (np.log((1 + freq[DIMS]) / (1 + freq[:DIMS])) + 0.1).astype(np.float32)
    sizes = materialise(learn.groupBy("lang").agg(F.count(F.lit(1)).alias("__n")))
    share = F.least(F.lit(1.0), max_rows / F.col("__n"))
    picked = learn.join(F.broadcast(sizes), "lang").where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20)) <= share * (1 << 20))
    picked = picked.dropDuplicates(["lang", "doc_id", "text"])  # repeated rows count once

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["doc_id", "text"])
        x, has = vectors(frame["text"].tolist(), idf)
        if not has.any():
            return pd.DataFrame({"lang": [], "center": [], "limit": []})
        x = x[has]
        centers = spherical_kmeans(x, clusters)
        near = (x @ centers.T).max(axis=1)
        return pd.DataFrame({"lang": frame["lang"].iloc[0], "center": list(centers.astype(float)), "limit": float(np.quantile(near, reject_share))})

    rows = picked.select("doc_id", "text", "lang").groupBy("lang").applyInPandas(fit, "lang string, center array<double>, limit double").collect()
    rows.sort(key=lambda r: r["lang"])  # clusters rows for each language
    return {
        "idf": idf,
        "langs": [r["lang"] for r in rows],
        "centers": np.array([r["center"] for r in rows], dtype=np.float32).reshape(len(rows), DIMS),
        "limits": np.array([r["limit"] for r in rows]),
    }


def predict_languages(docs: DataFrame, model: dict) -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` (cosine, 0 to 1) and ``rejected``."""
    idf, langs, centers, limits = model["idf"], np.array(model["langs"], dtype=object), model["centers"], model["limits"]

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def predict(texts: pd.Series) -> pd.DataFrame:
        n = len(texts)
        lang, score, rejected = np.full(n, "und", dtype=object), np.zeros(n), np.ones(n, dtype=bool)
        for at in range(0, n if len(langs) else 0, 512):
            x, has = vectors(texts.iloc[at : at + 512].tolist(), idf)
            near = x @ centers.T
            best = near.argmax(axis=1)
            part = slice(at, at + len(x))
            lang[part] = np.where(has, langs[best], "und")
            score[part] = np.where(has, np.clip(near.max(axis=1), 0, 1), 0)
            rejected[part] = ~has | (score[part] < limits[best])
        return pd.DataFrame({"lang_pred": lang, "score": score, "rejected": rejected})

    return docs.withColumn("__p", predict(F.col("text"))).select(*[c for c in docs.columns], "__p.*")


def op7_langid(spark, sf_dir: str) -> DataFrame:
    """Predicted language of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = train_languages(docs)
    return predict_languages(docs.select("doc_id", "text"), model).select(
        "doc_id", F.coalesce(id_remainder(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected"
    )
