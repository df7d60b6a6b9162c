"""Corpus operators on the smallest tables against plain Python."""

import collections
import hashlib
import html
import math
import re
import zlib

import numpy as np
import pytest

from stripweave.llm import hilbert_ann, katz, langid, line_dedup, line_rules, mixing, packing, quality_trees, simhash, wrapper_html
from stripweave.llm import queries as registered

WS = " \t\n\x0b\x0c\r"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").toPandas()


def remainder(doc_id, by):
    return zlib.crc32(str(doc_id).encode()) % by


def test_line_rules(spark, sf, docs):
    got = line_rules.op4_line_rules(spark, sf).toPandas().set_index("doc_id")
    for i, text in zip(docs.doc_id, docs.text):
        w = WORD.findall(text)
        windows = collections.Counter(zip(w, w[1:], w[2:]))
        inside = {k + d for k in range(len(w) - 2) if windows[tuple(w[k : k + 3])] > 1 for d in range(3)}
        lines = [x for x in text.split("\n") if x.strip(WS)]
        r = got.loc[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (
            len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(inside)
        )
        assert r.base_failed == (len(w) < 50 or 100 * len(inside) > 50 * len(w)) and not (r.base_failed and r.kept)


def test_mixing(spark, sf, docs):
    got = mixing.op5_mixing(spark, sf).toPandas()
    assert sorted(got.doc_id) == sorted(docs.doc_id) and (got.taken <= 2 * got["size"]).all()
    per = got.groupby("source", dropna=False).agg(taken=("taken", "sum"), target=("target", "first"), size=("size", "sum"))
    assert (per.taken == np.floor(per.target)).all() and abs(per.target.sum() - 1.5 * per["size"].sum()) < 1e-6
    again = mixing.op5_mixing(spark, sf).toPandas()
    assert got.sort_values("doc_id").taken.tolist() == again.sort_values("doc_id").taken.tolist()


def test_schedule_spreads_sources(spark, sf):
    made = mixing.mix_sources(spark.read.parquet(f"{sf}/documents.parquet"), block_tokens=64)
    slots = made["slots"].toPandas().sort_values("slot_no")
    for _, own in slots.groupby("source_no"):
        assert sorted(own.source_rank) == list(range(len(own)))
        share = len(own) / len(slots)
        head = own[own.slot_no <= slots.slot_no.max() / 6]
        assert abs(len(head) - share * (slots.slot_no <= slots.slot_no.max() / 6).sum()) <= 12


def test_line_dedup(spark, sf, docs):
    got = line_dedup.op6_line_dedup(spark, sf).toPandas().set_index("doc_id")
    keys = [[lower(x.strip(WS)) for x in t.split("\n")] for t in docs.text]
    held = collections.defaultdict(set)
    for i, ks in zip(docs.doc_id, keys):
        for k in ks:
            held[k].add(i)
    for i, text, ks in zip(docs.doc_id, docs.text, keys):
        kept = [x for x, k in zip(text.split("\n"), ks) if len(k) < 20 or len(held[k]) < 3 or max(held[k]) == i]
        r = got.loc[i]
        assert (r.n_lines, r.n_dropped, r.kept_sha256) == (len(ks), len(ks) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest())


def test_a_full_filter_only_suspects_more(spark, sf):
    frame = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    key = lambda r: (r.doc_id, r.n_dropped)
    tight = line_dedup.dedup_lines(frame, max_filter_bytes=1 << 7).select("doc_id", "n_dropped").collect()
    assert sorted(map(key, tight)) == sorted(map(key, line_dedup.dedup_lines(frame).select("doc_id", "n_dropped").collect()))


def groups(codes, limit):
    root = list(range(len(codes)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a in range(len(codes)):
        near = np.flatnonzero(simhash.bits(codes[a] ^ codes[a + 1 :]) <= limit) + a + 1
        for b in near.tolist():
            root[max(find(a), find(b))] = min(find(a), find(b))
    return [find(x) for x in range(len(codes))]


def test_simhash(spark, sf, docs):
    import xxhash

    got = simhash.op10_simhash(spark, sf).toPandas().sort_values("doc_id")
    fp = {}
    for i, text in zip(docs.doc_id, docs.text):
        w = WORD.findall(lower(text))
        shingles = [" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))] if w else []
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        fp[i] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    assert [fp[i] for i in got.doc_id] == [int(x, 16) for x in got.fingerprint]
    ids = got.doc_id.tolist()
    root = groups(np.array([fp[i] for i in ids], dtype=np.uint64), 2)
    assert got.component_id.tolist() == [ids[r] for r in root]


def test_large_nodes_are_split_without_losing_links(spark):
    rng = np.random.default_rng(1)
    centre = int(rng.integers(1 << 63))
    codes = {centre}
    frontier = [centre]
    while len(codes) < 900:  # a family of near codes, and strangers
        x = frontier[int(rng.integers(len(frontier)))]
        for b in rng.choice(64, size=2, replace=False).tolist():
            x ^= 1 << b
        codes.add(x)
        frontier.append(x)
    codes |= {int(x) for x in rng.integers(1 << 63, size=300)}
    signed = [c - (1 << 64) if c >= 1 << 63 else c for c in sorted(codes)]
    frame = spark.createDataFrame([(c,) for c in signed], "fp long")
    links = simhash.near_links(frame, 2, node_size=64)
    label = {r.node: r.root for r in simhash.components(links).collect()}
    array = np.array(signed, dtype=np.int64).view(np.uint64)
    root = groups(array, 2)
    seen = {}
    for c, r in zip(signed, root):
        assert seen.setdefault(r, label.get(c, c)) == label.get(c, c)
    assert len(set(seen.values())) == len(seen)


def test_long_chains_settle(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001)], "a long, b long")
    got = {r.node: r.root for r in simhash.components(links).collect()}
    assert got == {i: 0 for i in range(1, 301)} | {1001: 1000}


def test_packing(spark, sf, docs):
    from tokenizers import Tokenizer

    import public_tokenizers

    full = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = packing.op1_packing(spark, sf).toPandas()
    ids = {i: np.array(full.encode(t or "", add_special_tokens=False).ids + [0], dtype="<u4") for i, t in zip(docs.doc_id, docs.text)}
    for i, own in got.groupby("doc_id"):
        own = own.sort_values("start")
        assert own.start.tolist() == [0, *own.length.cumsum().tolist()[:-1]] and own.length.sum() == len(ids[i]) == own.doc_tokens.iloc[0]
        assert all(zlib.crc32(ids[i][r.start : r.start + r.length].tobytes()) == r.ids_crc32 for r in own.itertuples())
    size = got.groupby("sequence_id").length.sum()
    padded = size[(size & (size - 1)) != 0]
    assert size.max() <= 1024 and (1024 - padded).sum() < 0.03 * size.sum()


@pytest.mark.parametrize("text", ["", "plain words", "  two  spaces\n\n", "a<|endoftext|>b", "ümlaut ß 漢字 🙂‍🙂", "x" * 5000, "1234567890 12,5 'tis they'll", "\x00\x01﻿", "tabs\t\tand\r\nlines"])
def test_fast_ids_equal_the_tokenizer(text):
    from tokenizers import Tokenizer

    import public_tokenizers

    path = public_tokenizers.path
    encoder = packing._Encoder(path("byte_bpe_50k.json"), path("byte_bpe_50k.tiktoken"))
    assert encoder.ids(text).tolist() == Tokenizer.from_file(path("byte_bpe_50k.json")).encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("run", [" " * 2_000_000, "\n" * 2_000_000, "a\n" + " \t" * 1_000_000 + "b"])
def test_long_runs_of_white_space(spark, run):
    from tokenizers import Tokenizer

    import public_tokenizers

    got = packing.pack_documents(spark.createDataFrame([(1, run), (2, "short"), (3, None)], "doc_id long, text string")).toPandas()
    ids = np.array(Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode(run, add_special_tokens=False).ids + [0], dtype="<u4")
    own = got[got.doc_id == 1].sort_values("start")
    assert own.length.sum() == len(ids) and set(got.doc_id) == {1, 2, 3}
    assert all(zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for r in own.itertuples())


def test_patterns_hold_every_item():
    rng = np.random.default_rng(0)
    for n in (1, 30, 4000):
        lengths, counts = np.unique(np.minimum(rng.integers(1, 140, n), 128), return_counts=True)
        want = dict(zip(lengths.tolist(), counts.tolist()))
        held = collections.Counter()
        plan = packing.plan_patterns(want, 128)
        for copies, items in plan:
            assert sum(items) <= 128
            for k in items:
                held[k] += copies
        assert held == want
        if n == 4000:
            assert sum(c for c, _ in plan) < 1.02 * sum(k * c for k, c in want.items()) / 128


def test_quality_on_held_out_labels(spark, sf):
    sf = "/root/testdata/sf0.01"
    got = quality_trees.op3_quality_trees(spark, sf).toPandas()
    both = got.merge(spark.read.parquet(f"{sf}/labels.parquet").toPandas(), on="doc_id")
    held = both[both.held_out]
    assert (held.held_out == held.doc_id.map(lambda i: remainder(i, 5) == 0)).all() and len(held) > 30
    assert (held.predicted == held.quality).mean() > 0.9 and got.score.between(0, 1).all()


def test_language_on_held_out_documents(spark, sf, docs):
    sf = "/root/testdata/sf0.01"
    got = langid.op7_langid(spark, sf).toPandas().merge(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").toPandas(), on="doc_id")
    held = got[got.held_out]
    assert (held.lang == held.lang_pred).mean() > 0.95


def test_neighbours_reach_the_recall(spark, sf):
    got = hilbert_ann.op8_hilbert_ann(spark, sf).toPandas()
    e = spark.read.parquet(f"{sf}/embeddings.parquet").toPandas()
    x, ids = np.stack(e.embedding.to_numpy()).astype(float), e.vec_id.to_numpy()
    hits = []
    for q, own in got.groupby("query_id"):
        s = x @ x[ids == q][0]
        other = ids != q
        best = ids[other][np.lexsort((ids[other], -s[other]))[:20]]
        hits.append(len(set(best) & set(own.vec_id)) / 20)
        assert np.allclose(own.score, [float(x[ids == q][0] @ x[ids == v][0]) for v in own.vec_id])
    assert len(hits) == (ids % 20 == 0).sum() and np.mean(hits) >= 0.9


@pytest.mark.parametrize("axes, bits", [(1, 4), (2, 4), (3, 3), (4, 2)])
def test_hilbert_steps_to_a_neighbour(axes, bits):
    cells = np.stack(np.meshgrid(*[np.arange(2**bits)] * axes, indexing="ij"), -1).reshape(-1, axes)
    order = np.argsort(hilbert_ann.hilbert_index(cells, bits))
    assert (np.abs(np.diff(cells[order], axis=0)).sum(axis=1) == 1).all()


def test_pages(spark, sf):
    got = wrapper_html.op9_wrapper_text(spark, sf).toPandas().set_index("page_id")
    pages = spark.read.parquet(f"{sf}/pages.parquet").toPandas()
    for i, page in zip(pages.page_id, pages.html):
        inner = re.search(r"<article>(.*?)(</article>|$)", page, re.S).group(1)
        inner = re.sub(r"<[^>]*>", "", re.sub(r"</?(p|h1|br)\b[^>]*>", " ", inner))
        assert got.text[i] == re.sub(r"[\x20\x09-\x0D]+", " ", html.unescape(inner)).strip(" ")
        assert got.n_chars[i] == len(got.text[i])


def test_pipeline_end_to_end(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    columns, frames = docs.columns, []
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialise(stage(spark, docs, sf))
        frames.append(docs)
    assert all(f.columns == columns for f in frames[:-1])
    kept = {r.doc_id for r in frames[0].select("doc_id").collect()}
    assert sum(labels[i] == 0 for i in kept if i in labels) <= 3
    near = [r.doc_id for r in frames[2].select("doc_id").collect()]
    assert len(near) == len(set(near)) < len(kept)
    packed = frames[-1].toPandas()
    assert packed.groupby("sequence_id").length.sum().max() <= 1024
    assert set(packed.doc_id) <= set(near)


def test_every_query_is_registered():
    names = list(registered.queries())
    assert [n.split("_")[0] for n in names] == [f"op{i}" for i in range(1, 11)]
    assert set(registered.oracle_sql()) == {"op4_line_rules", "op5_mixing", "op6_line_dedup"}
