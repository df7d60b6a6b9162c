"""Quality classifier: histogram gradient-boosted trees over statistics of whole texts.

The trees are fitted on a bounded sample of labelled rows (``max_rows``, chosen by hash) and laid out
as complete binary trees in arrays, so that a batch of documents walks all trees together with a few
numpy steps for each level.

Defined results: null text counts as empty and is scored like any text; rows with a null doc_id are
never held out; labels that are null are ignored and several labels of one doc_id count as the
lowest; without any labelled row every score is 0.5; repeated rows get equal scores; empty tables
give empty results; other columns are kept by ``score_documents``.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: Byte classes counted in one pass.
_CLASSES = {
    "space": b" \t\x0b\x0c\r",
    "newline": b"\n",
    "lower": bytes(range(97, 123)),
    "upper": bytes(range(65, 91)),
    "digit": b"0123456789",
    "stop": b".?",
    "bang": b"!",
    "comma": b",;:'\"-()",
    "symbol": b"#*$%&<>",
    "bar": b"|",
    "other": b"/\\@[]^_`{}~+=",
    "high": bytes(range(192, 256)),
}
_TABLE = np.full(256, len(_CLASSES), dtype=np.uint8)
for _k, _members in enumerate(_CLASSES.values()):
    _TABLE[list(_members)] = _k

FEATURES = [
    "log_chars", "log_words", "log_lines", "word_length", "word_length_spread", "distinct_words", "top_word", "top_five_words",
    "doubled_words", "repeated_pairs", "repeated_lines", "full_stops_at_line_ends", "short_lines", "words_per_line",
    "capital_words", "words_ending_in_letters", *(f"share_{k}" for k in _CLASSES),
]


def document_statistics(text: str | None) -> list[float]:
    """The features of one whole text."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    counts = np.bincount(_TABLE[np.frombuffer(raw, dtype=np.uint8)], minlength=len(_CLASSES) + 1)[: len(_CLASSES)]
    n_bytes = max(1, len(raw))
    words = raw.split()
    n = len(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    m = max(1, len(lines))
    if n:
        lengths = np.fromiter(map(len, words), dtype=np.int32, count=n)
        seen = Counter(words)
        common = [k for _, k in seen.most_common(5)]
        pairs = len(set(zip(words, words[1:])))
        doubled = sum(map(bytes.__eq__, words, words[1:]))
        capital = sum(65 <= w[0] <= 90 for w in words)
        plain = sum(97 <= w[-1] <= 122 or w[-1] >= 128 for w in words)
        word = [lengths.mean(), lengths.std(), len(seen) / n, common[0] / n, sum(common) / n, doubled / n, 1 - pairs / max(1, n - 1) if n > 1 else 0.0]
    else:
        capital = plain = 0
        word = [0.0] * 7
    return [
        np.log1p(n_bytes), np.log1p(n), np.log1p(len(lines)), *word, 1 - len(set(lines)) / m,
        sum(x.rstrip()[-1:] in b".!?" for x in lines) / m, sum(len(x.split(None, 4)) < 4 for x in lines) / m, n / m,
        capital / max(1, n), plain / max(1, n), *(counts / n_bytes),
    ]


def fit_trees(x: np.ndarray, y: np.ndarray, n_trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, l2: float = 1.0, min_rows: int = 10) -> dict:
    """Boosted trees for the log-odds of y = 1, each grown level by level on binned features."""
    size = 2 ** (depth + 1) - 1
    model = {"depth": depth, "base": 0.0, "feature": np.zeros((n_trees, size), np.int32), "cut": np.full((n_trees, size), np.inf), "leaf": np.zeros((n_trees, size))}
    if not len(y):
        return model
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    model["base"] = float(np.log(share / (1 - share)))
    n, k = x.shape
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for j in range(k)]
    binned = np.stack([np.searchsorted(cuts[j], x[:, j], side="left") for j in range(k)], axis=1)
    flat = binned + np.arange(k) * bins
    score = np.full(n, model["base"])
    for t in range(n_trees):
        p = 1 / (1 + np.exp(-score))
        g, h = y - p, p * (1 - p)
        node = np.zeros(n, dtype=np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            at = ((node - first)[:, None] * (k * bins) + flat).ravel()
            shape = (width, k, bins)
            sums = [np.bincount(at, weights=np.repeat(v, k), minlength=width * k * bins).reshape(shape) for v in (g, h)]
            rows = np.bincount(at, minlength=width * k * bins).reshape(shape)
            gl, hl, nl = (np.cumsum(v, axis=2) for v in (*sums, rows))
            ga, ha, na = gl[:, :, -1:], hl[:, :, -1:], nl[:, :, -1:]
            gain = gl**2 / (hl + l2) + (ga - gl) ** 2 / (ha - hl + l2) - ga**2 / (ha + l2)
            gain[(nl < min_rows) | (na - nl < min_rows)] = 0
            best = gain.reshape(width, -1).argmax(axis=1)
            for i in range(width):
                j, b = divmod(int(best[i]), bins)
                if gain[i, j, b] > 1e-6 and b < len(cuts[j]):
                    model["feature"][t, first + i], model["cut"][t, first + i] = j, cuts[j][b]
            node = 2 * node + 1 + (x[np.arange(n), model["feature"][t, node]] > model["cut"][t, node])
        g_sum, h_sum = (np.bincount(node, weights=v, minlength=size) for v in (g, h))
        model["leaf"][t] = rate * g_sum / (h_sum + l2)
        score += model["leaf"][t, node]
    return model


def tree_scores(model: dict, x: np.ndarray) -> np.ndarray:
    """Probability of y = 1 for each row: all trees are walked together, one step a level."""
    n_trees = len(model["leaf"])
    trees, rows = np.arange(n_trees)[None, :], np.arange(len(x))[:, None]
    node = np.zeros((len(x), n_trees), dtype=np.int64)
    for _ in range(model["depth"]):
        node = 2 * node + 1 + (x[rows, model["feature"][trees, node]] > model["cut"][trees, node])
    return 1 / (1 + np.exp(-(model["base"] + model["leaf"][trees, node].sum(axis=1))))


def id_remainder(doc_id: Column, by: int) -> Column:
    """crc32 of the id as text, modulo ``by``; null ids have remainder null."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(by))


def train_quality(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, folds: int = 5, held_fold: int = 0) -> dict:
    """Trees fitted on at most about ``max_rows`` labelled ids outside the held-out fold, and twice as many
    rows; repeated rows count once."""
    usable = (
        labels.select(F.col("doc_id").alias("__id"), F.col("quality").alias("__y"))
        .where(F.col("__y").isNotNull() & (id_remainder(F.col("__id"), folds) != held_fold))
        .groupBy("__id")
        .agg(F.min("__y").alias("__y"))
    )
    usable = materialise(usable)
    share = min(1.0, max_rows / max(1, usable.count()))
    picked = usable.where(F.pmod(F.xxhash64("__id"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            x = [document_statistics(t) for t in frame["text"]]
            yield pd.DataFrame({"id": frame["__id"], "y": frame["__y"].astype("float64"), "x": x})

    # picked holds about max_rows ids; an id with many rows is brought back to the bound by content
    labelled = docs.select("doc_id", "text").join(F.broadcast(picked), F.col("doc_id") == F.col("__id"))
    once = labelled.withColumn("__t", F.xxhash64("text")).dropDuplicates(["__id", "__t"])
    rows = materialise(once.select("__id", "__y", "text").mapInPandas(measure, "id long, y double, x array<double>"))
    share = min(1.0, 2 * max_rows / max(1, rows.count()))
    got = rows.where(F.pmod(F.xxhash64("id", "x"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).toPandas()
    if not len(got):
        return fit_trees(np.zeros((0, len(FEATURES))), np.zeros(0))
    x = np.stack(got["x"].to_numpy())
    order = np.lexsort((*x.T, got["y"].to_numpy(), got["id"].to_numpy()))
    return fit_trees(x[order], (got["y"].to_numpy()[order] > 0).astype(float))


def score_documents(docs: DataFrame, model: dict, column: str = "score") -> DataFrame:
    """``docs`` with the score of every whole text."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        if not len(texts):
            return pd.Series([], dtype="float64")
        return pd.Series(tree_scores(model, np.array([document_statistics(t) for t in texts])))

    return docs.withColumn(column, score(F.col("text")))


def op3_quality_trees(spark, sf_dir: str, threshold: float = 0.3) -> DataFrame:
    """Quality score of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_documents(docs, model).select(
        "doc_id",
        F.coalesce(id_remainder(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
