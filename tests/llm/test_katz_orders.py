"""The backoff model against a plain recursive one, word by word."""

import collections
import math
import zlib

import pytest
from pyspark.sql import functions as F

from stripweave.llm import katz

K = 5


def discounts(counts, total_of_type=None):
    """Katz's discounts from an iterable of counts; ``total_of_type`` counts the items that occur once."""
    n = collections.Counter(counts)
    if total_of_type is not None:
        n[1] = total_of_type
    out = {}
    for r in range(1, K + 1):
        cut = (K + 1) * n[K + 1] / n[1] if n[1] else 1.0
        d = ((r + 1) * n[r + 1] / n[r] / r - cut) / (1 - cut) if n[r] and cut < 1 else 0.0
        if not 0 < d < 1:
            shift = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.5
            d = 1 - min(max(shift, 0.05), 0.95) / r
        out[r] = d
    return lambda c: out.get(c, 1.0)


class Plain:
    def __init__(self, texts, order, min_count=2):
        self.min_count = min_count
        self.grams = [collections.Counter() for _ in range(order + 1)]  # by length; the start counts as one word
        for t in texts:
            padded = ["<s>", *t]
            for m in range(1, order + 1):
                for i in range(1, len(padded)):
                    if i - m + 1 >= 0:
                        self.grams[m][tuple(padded[i - m + 1 : i + 1])] += 1
        self.order, self.total = order, sum(self.grams[1].values())
        self.after = collections.Counter()
        for m in range(2, order + 1):
            for g, c in self.grams[m].items():
                self.after[g[:-1]] += c
        self.d, self.kept, self.followers = {}, {}, collections.defaultdict(list)
        for m in range(1, order + 1):
            least = min_count if m >= 3 else 1
            self.kept[m] = {g: c for g, c in self.grams[m].items() if c >= least}
            self.d[m] = discounts(self.grams[m].values())
            if m > 1:
                for g in self.kept[m]:
                    self.followers[g[:-1]].append(g[-1])
        self.vocabulary = [g[0] for g in self.grams[1]]
        self.memo, self.known = {}, None

    def uni(self, w):
        c = self.grams[1][(w,)]
        if self.known is None:
            self.known = sum(self.d[1](x) * x for x in self.grams[1].values()) / max(1, self.total)
        known = self.known
        scale, unknown = (1.0, 1 - known) if known < 1 - 1e-15 else (self.total / (self.total + 1), 1 / (self.total + 1))
        return self.d[1](c) * c / self.total * scale if c else (unknown if self.total else 1.0)

    def p(self, h, w):
        """p(w | h) for a history of any length up to order - 1."""
        if not h:
            return self.uni(w)
        key = (h, w)
        if key not in self.memo:
            self.memo[key] = self._p(h, w)
        return self.memo[key]

    def _p(self, h, w):
        m, of = len(h) + 1, self.after[h]
        frequent = self.min_count if m >= 3 else 1
        if not self.kept[m - 1].get(h, 0) >= frequent and h != ("<s>",) or not of:
            return self.p(h[1:], w)
        if h not in self.memo:
            seen = sum(self.d[m](self.kept[m][h + (x,)]) * self.kept[m][h + (x,)] for x in self.followers[h]) / of
            self.memo[h] = seen, sum(self.p(h[1:], x) for x in self.followers[h])
        seen, lower = self.memo[h]
        whole, c = 1 - seen < 1e-9, self.kept[m].get(h + (w,), 0)
        if c:
            return c / (of + 1) if whole else self.d[m](c) * c / of
        if not self.followers[h]:
            return self.p(h[1:], w)
        return (1 / (of + 1) if whole else 1 - seen) / (1 - lower) * self.p(h[1:], w)


def words(text):
    return [*(text or "").encode().lower().split(), "</s>"]


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 7 == 2


@pytest.mark.parametrize("order, small", [(1, False), (2, True), (3, False), (3, True), (4, False)])
def test_scores_equal_the_plain_model(spark, sf, order, small):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) == 2
    # small batches and buckets: many of both, and histories that are dealt to several buckets
    options = {"batch_tokens": 20_000, "bucket_tokens": 20_000} if small else {}
    got = katz.katz_scores(docs, ~held, order=order, **options).collect()
    texts = {r.doc_id: words(r.text) for r in docs.collect()}
    model = Plain([t for i, t in texts.items() if not held_out(i)], order)
    assert len(got) == len(texts)
    for r in got:
        t = texts[r.doc_id]
        padded = ["<s>", *t]
        want = sum(math.log10(model.p(tuple(padded[max(0, i - order + 1) : i]) if order > 1 else (), padded[i])) for i in range(1, len(padded)))
        assert abs(r.score - want) < 1e-6 * max(1, abs(want)), r.doc_id
        one = model.grams[1]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.learned) == (len(t), sum(one[(w,)] > 0 for w in t), model.total, not held_out(r.doc_id))
        assert abs(r.base_score - sum(math.log10((one[(w,)] + 1) / (model.total + len(one) + 1)) for w in t)) < 1e-6
    histories = [g for m in range(1, order) for g in list(model.kept[m])[:40] if g[-1] != "</s>"] + ([("<s>",)] if order > 1 else [])
    for h in histories:
        assert abs(sum(model.p(h, w) for w in model.vocabulary) + model.p(h, b"\xff never seen") - 1) < 1e-8


def test_longer_histories_predict_better(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    learn = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) != 2
    sums = []
    for order in (1, 2, 3):
        r = katz.katz_scores(docs, learn, order=order).where("NOT learned").agg(F.sum("score"), F.sum("base_score")).first()
        sums.append(r[0])
        assert r[0] > r[1]
    assert sums[0] < sums[1] < sums[2]


def test_a_text_that_occurs_twice_scores_apart(spark):
    base = [(i, " ".join(f"w{(i * 37 + k * k * 11 + k) % 300}" for k in range(80))) for i in range(120)]
    twice = " ".join(f"w{(k * 53 + 5 * k * k) % 300}" for k in range(80))
    once = " ".join(f"w{(k * 59 + 7 * k * k + 3) % 300}" for k in range(80))
    frame = spark.createDataFrame([*base, (900, twice), (901, twice), (902, once)], "doc_id long, text string")
    got = {r.doc_id: r.score for r in katz.katz_scores(frame, F.lit(True)).collect()}
    assert got[900] == got[901] > got[902] + 20


@pytest.mark.parametrize("min_count", [1, 2])
def test_pruning_is_a_parameter(spark, sf, min_count):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) == 2
    got = {r.doc_id: r.score for r in katz.katz_scores(docs, ~held, min_count=min_count).collect()}
    texts = {r.doc_id: words(r.text) for r in docs.collect()}
    model = Plain([t for i, t in texts.items() if not held_out(i)], 3, min_count)
    for i, t in texts.items():
        padded = ["<s>", *t]
        want = sum(math.log10(model.p(tuple(padded[max(0, k - 2) : k]), padded[k])) for k in range(1, len(padded)))
        assert abs(got[i] - want) < 1e-6 * max(1, abs(want)), i


def test_other_counts_are_refused(spark, sf):
    with pytest.raises(ValueError):
        katz.katz_scores(spark.read.parquet(f"{sf}/documents.parquet"), F.lit(True), min_count=3)
