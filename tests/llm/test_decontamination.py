"""Benchmark hits against plain sets of words, on both ways of finding them."""

import re

import pytest

from stripweave.llm import decontamination as D

WORD = re.compile(D.WORD)
BENCH = [
    (1, "One two three four five six seven eight nine ten eleven twelve thirteen"),
    (2, "THREE four, five six seven eight nine ten eleven twelve! thirteen fourteen"),
    (3, "short item only"), (4, ""), (5, None), (None, "an item that has no id at all but still ten words and more"),
    (2**53 + 1, "short   ITEM, only"), (7, "Ünï-çödé wörter gehören ÄUSSERSTE dazu"), (8, "..., --"), (1, "another text of the very same id that repeats it in eleven"),
]
DOCS = [
    (1, "x One two three four five six seven eight nine ten eleven y"), (2, None), (3, ""), (4, "... !!"), (5, "a short item only, a short item only"),
    (2**53 + 1, "an item that has no id at all but still ten words and more"), (2**63 - 1, "nothing here"), (None, "Short. Item; only"), (None, None),
    (9, "ünï çödé"), (10, "Ünï çödé wörter gehören ÄUSSERSTE dazu"), (11, "ünï çödé wörter gehören äusserste dazu"),
    (12, "pad " * 50_000 + "short item only" + " pad" * 60_000), (13, "z" * 400_000 + " short item only " + "é" * 200_000),
    (14, "one two three four five six seven eight nine ten three four five six seven eight nine ten eleven twelve"), (5, "a short item only, a short item only"),
    (15, "short"), (16, "item only"), (17, "\x00short\x00item\x00only\x00"),
]


def lower(s):
    return (s or "").translate(str.maketrans(D.UPPER, D.LOWER))


def brute(docs, bench, n=10):
    windows = {}
    for item, text in bench:
        w = WORD.findall(lower(text))
        for k in range(max(1, len(w) - n + 1) if w else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add(item)
    out = []
    for doc, text in docs:
        found = list(WORD.finditer(lower(text)))
        w, hit, items = [m[0] for m in found], set(), set()
        for size in {len(x) for x in windows}:
            for k in range(len(w) - size + 1):
                if (own := windows.get(tuple(w[k : k + size]))) is not None:
                    hit |= set(range(k, k + size))
                    items |= {str(i) for i in own if i is not None}
        spans, data = [], lower(text)
        for k in sorted(hit):
            a, b = (len(data[:x].encode()) for x in found[k].span())
            if k - 1 in hit:
                spans[-1] = (spans[-1][0], b)
            else:
                spans.append((a, b))
        out.append((doc, len(w), len(hit), sorted(items), spans))
    return sorted(out, key=repr)


def rows(found):
    return sorted(((r["doc_id"], r["n_words"], r["n_hit"], list(r["items"]), [tuple(s) for s in r["spans"]]) for r in found.collect()), key=repr)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, "x", "y") for r in DOCS], "doc_id long, text string, items string, window string").repartition(3)


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(*r, "x") for r in BENCH], "item_id long, text string, words string")


@pytest.mark.parametrize("limit", [32 << 20, 200])
def test_like_plain_sets(docs, bench, limit):
    found = D.find_contamination(docs, bench, max_broadcast_bytes=limit, prefix="__")
    assert found.columns == [*docs.columns, "__n_words", "__n_hit", "__items", "__spans"]
    plain = found.select("doc_id", *[found[f"__{c}"].alias(c) for c in ("n_words", "n_hit", "items", "spans")])
    assert rows(plain) == brute(DOCS, BENCH)


@pytest.mark.parametrize("limit", [32 << 20, 100])
def test_hot_passage_in_most_documents(spark, limit):
    passage = "this passage of a benchmark stands word for word in most of the documents"
    some = [(i, f"doc {i} {passage if i % 3 else ''} end {i}") for i in range(600)] + [(1000, passage)] * 300
    items = [(i, passage + f" {i % 7}") for i in range(40)]
    found = D.find_contamination(spark.createDataFrame(some, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), max_broadcast_bytes=limit)
    assert rows(found) == brute(some, items)


@pytest.mark.parametrize("limit", [32 << 20, 200])
def test_removal(docs, bench, limit):
    clean = D.remove_spans(docs, bench, max_broadcast_bytes=limit)
    assert clean.columns == docs.columns
    want = []
    by_doc = {}
    for r, (doc, text) in zip([brute([d], BENCH)[0] for d in DOCS], DOCS):
        data = text.encode() if text is not None else None
        for a, b in reversed(r[4]):
            data = data[:a] + data[b:]
        want.append((doc, data.decode() if data is not None else None))
        by_doc[(doc, text)] = r[2]
    assert sorted(((r["doc_id"], r["text"]) for r in clean.collect()), key=repr) == sorted(want, key=repr)
    left = D.remove_documents(docs, bench, max_broadcast_bytes=limit)
    assert sorted(((r["doc_id"], r["text"]) for r in left.collect()), key=repr) == sorted((d for d in DOCS if not by_doc[d]), key=repr)
    half = D.remove_documents(docs, bench, max_share=0.5, max_broadcast_bytes=limit)
    assert {r["doc_id"] for r in half.collect()} >= {12, 15}


def test_empty_tables(docs, bench):
    assert D.find_contamination(docs.limit(0).select("doc_id", "text"), bench).collect() == []
    none = D.find_contamination(docs.select("doc_id", "text"), bench.limit(0))
    assert rows(none) == brute(DOCS, [])
