"""The near-copy stage against all pairs in plain Python."""

import random
import re

import numpy as np
from pyspark.sql import functions as F

from stripweave.llm import near_copies, stages

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def brute(rows):
    """Smallest id of the group of every document, over all pairs of exact similarity 0.8 or more."""
    sets = {}
    for i, text in rows:
        w = WORD.findall(lower(text or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
    root, links = {i: i for i in sets}, 0

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for at, a in enumerate(ids):
        for b in ids[at + 1 :]:
            x, y = sets[a], sets[b]
            if min(len(x), len(y)) * 10 < max(len(x), len(y)) * 8:
                continue
            both = len(x & y)
            if both * 10 >= (len(x) + len(y) - both) * 8:
                links += x != y
                lo, hi = sorted((find(a), find(b)))
                root[hi] = lo
    return {i: find(i) for i in ids}, links


def made_rows():
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(3000)]
    passage = [rng.choice(vocabulary) for _ in range(60)]
    rows, bases = [], [[rng.choice(vocabulary) for _ in range(rng.choice([6, 12, 40, 150, 400]))] for _ in range(60)]
    for base in bases:
        rows.append(base)
        for _ in range(4):  # up to a twelfth of the words changed: similarities on both sides of 0.8
            copy = list(base)
            for _ in range(rng.randint(0, 1 + len(base) // 25)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append(copy)
    chain = [rng.choice(vocabulary) for _ in range(200)]
    for _ in range(25):  # each is near to the one before only
        chain = chain[6:] + [rng.choice(vocabulary) for _ in range(6)]
        rows.append(chain)
    rows += [passage + [rng.choice(vocabulary) for _ in range(10 + i)] for i in range(30)]
    rng.shuffle(rows)
    return [(i, " ".join(w)) for i, w in enumerate(rows)] + [(9000, None), (9001, " "), (9002, "One two"), (9003, "one  two")]


def test_all_pairs(spark):
    rows = made_rows()
    want, links = brute(rows)
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert {r.doc_id: r.component_id for r in near_copies.near_copies(frame).collect()} == want and links > 100
    assert {r.doc_id for r in stages.keep_one_of_near_copies(spark, frame, "").collect()} == set(want.values())


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want, links = brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    assert {r.doc_id: r.component_id for r in near_copies.near_copies(docs).collect()} == want and links > 0


def test_rows_with_shared_or_missing_ids(spark):
    base = [f"word{i}" for i in range(80)]
    other = " ".join(f"other{i}" for i in range(60))
    near = " ".join(["changed", *base[1:]])
    rows = [(1, " ".join(base)), (1, other), (1, other), (None, " ".join(base)), (None, near), (None, "alone without an id"), (None, "alone without an id"), (2, near), (3, None), (None, "")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = sorted(stages.keep_one_of_near_copies(spark, frame, "").collect(), key=str)
    assert kept == sorted([(1, " ".join(base)), (1, other), (None, "alone without an id"), (3, None)], key=str)


def test_shared_shingle_in_blocks(spark):
    rng = random.Random(3)
    rows = []
    for i in range(60):  # every text starts with one passage; pairs of them are near copies
        words = [f"p{k}" for k in range(9)] + [f"own{i // 2}x{k}" for k in range(90)]
        words[-1 - rng.randrange(20)] = f"edit{i}"
        rows.append((i, " ".join(words)))
    want, links = brute(rows)
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    sets = near_copies.add_sets(frame, np.zeros(0, dtype=np.uint64), 80, 5, 42).withColumn("root", F.col("fp"))
    held = sets.select("fp", "n", "root", F.posexplode("first").alias("pos", "key"))
    held = held.select("key", "fp", "root", F.shiftleft(F.col("n").cast("long"), 32).bitwiseOR(F.col("pos").cast("long")).alias("np"))
    facts = sets.select("fp", "bits").dropDuplicates(["fp"])
    whole, cut = (sorted(near_copies.pairs_apart(held, facts, 80, True, block).collect()) for block in (2048, 7))
    assert whole == cut and len(whole) >= links == 30
    assert 0 < near_copies.pairs_apart(held, facts, 80, False).count() <= 60  # one for each text
    assert {r.doc_id: r.component_id for r in near_copies.near_copies(frame, hot_rows=5).collect()} == want


def test_bitmaps_only_refuse_what_disagrees():
    rng = np.random.default_rng(5)
    refused = 0
    for n, m, both in [(100, 100, 89), (100, 80, 80), (1000, 900, 845), (5, 5, 5), (300, 300, 20), (128, 129, 60), (40, 50, 10)] * 5:
        h = np.unique(rng.integers(0, 1 << 64, size=n + m - both, dtype=np.uint64))
        order = rng.permutation(h)
        a, b = np.sort(order[:n]), np.sort(order[n - both :])
        allowed = near_copies.may_agree(near_copies.bitmap(a), near_copies.bitmap(b), len(a), len(b), 80)
        similar = both * 10 >= (n + m - both) * 8
        assert allowed or not similar
        refused += not allowed
    assert refused == 15
