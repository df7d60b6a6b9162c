"""Every operator on nulls, empty and long texts, ties, repeated rows, empty tables, clashing names."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from stripweave.llm import hilbert_ann, katz, langid, line_dedup, line_rules, mixing, packing, quality_trees, simhash, stages, wrapper_html


def test_line_rules(odd_documents, no_documents):
    rows = line_rules.line_quality(odd_documents).toPandas()
    assert len(rows) == odd_documents.count()
    empty = rows[rows.n_words == 0]
    assert len(empty) == 4 and empty.base_failed.all() and not empty.kept.any()
    assert rows.kept.notna().all() and rows.base_failed.notna().all()
    assert line_rules.line_quality(no_documents).count() == 0


def test_mixing(odd_documents, no_documents):
    rows = mixing.mix_sources(odd_documents, block_tokens=50)["documents"].toPandas()
    assert len(rows) == odd_documents.count()
    assert (rows.taken <= 2 * rows["size"]).all()
    per = rows.groupby("source", dropna=False).agg(taken=("taken", "sum"), target=("target", "first"), size=("size", "sum"), own=("source_size", "first"))
    assert (per.taken == np.floor(per.target)).all() and (per["size"] == per.own).all()
    assert abs(per.target.sum() - 1.5 * per["size"].sum()) < 1e-6
    assert mixing.mix_sources(no_documents)["documents"].count() == 0


def test_line_dedup(odd_documents, no_documents):
    rows = line_dedup.dedup_lines(odd_documents).toPandas()
    assert len(rows) == odd_documents.count()
    held = rows[rows.kept.str.lower().str.contains("this very passage")]
    assert set(held.doc_id) == {65}
    assert (rows[rows.doc_id == 1].n_lines == 1).all() and (rows[rows.doc_id == 1].kept == "").all()
    assert line_dedup.dedup_lines(no_documents).count() == 0


def test_simhash(odd_documents, no_documents):
    rows = simhash.near_duplicates(odd_documents).toPandas()
    assert len(rows) == odd_documents.count()
    assert (rows[rows.doc_id.isin([1, 2, 3])].fingerprint == "0" * 16).all()
    assert set(rows[rows.doc_id.between(40, 47)].component_id) == {40}
    assert simhash.near_duplicates(no_documents).count() == 0


def test_packing(odd_documents, no_documents):
    rows = packing.pack_documents(odd_documents).toPandas()
    sizes = rows.groupby("sequence_id").length.sum()
    assert sizes.max() <= 1024
    ordered = rows.sort_values(["sequence_id", "offset"])
    assert (ordered.groupby("sequence_id").length.cumsum() - ordered.length == ordered.offset).all()
    assert set(rows.doc_id.dropna()) == {r["doc_id"] for r in odd_documents.where("doc_id is not null").select("doc_id").distinct().collect()}
    assert rows[rows.start == 0].shape[0] == odd_documents.count()
    assert packing.pack_documents(no_documents).count() == 0


def test_katz(odd_documents, no_documents):
    rows = katz.katz_scores(odd_documents, F.col("doc_id") % 7 != 2).toPandas()
    assert len(rows) == odd_documents.count()
    assert np.isfinite(rows.score).all() and (rows.score <= 1e-9).all() and (rows.n_tokens >= 1).all()
    assert katz.katz_scores(no_documents, F.lit(True)).count() == 0
    unlearned = katz.katz_scores(odd_documents, F.lit(False)).toPandas()
    assert (unlearned.train_tokens == 0).all() and (unlearned.n_known == 0).all() and np.allclose(unlearned.score, 0)


def test_quality(odd_documents, no_documents, odd_labels):
    model = quality_trees.train_quality(odd_documents, odd_labels)
    rows = quality_trees.score_documents(odd_documents, model, "__s").toPandas()
    assert len(rows) == odd_documents.count() and rows["__s"].between(0, 1).all()
    assert quality_trees.score_documents(no_documents, model, "__s").count() == 0
    none = quality_trees.train_quality(odd_documents, odd_labels.limit(0))
    assert (quality_trees.score_documents(odd_documents, none, "__s").toPandas()["__s"] == 0.5).all()


def test_language(odd_documents, no_documents):
    model = langid.train_languages(odd_documents)
    rows = langid.predict_languages(odd_documents.select("doc_id", "text"), model).toPandas()
    assert len(rows) == odd_documents.count() and rows.score.between(0, 1).all()
    assert (rows[rows.doc_id.isin([1, 2, 3, 7])].lang_pred == "und").all()
    assert (rows[rows.doc_id.between(60, 65)].lang_pred == "de").all()
    empty = langid.train_languages(no_documents)
    assert (langid.predict_languages(odd_documents.select("doc_id", "text"), empty).toPandas().lang_pred == "und").all()


def test_neighbours(spark):
    rng = np.random.default_rng(3)
    good = [(i, [float(x) for x in rng.normal(size=8)], 1) for i in range(120)]
    same = [(200 + i, [1.0] * 8, 2) for i in range(60)]
    odd = [(300, None, 0), (301, [0.0] * 8, 0), (302, [1.0, None] * 4, 0), (303, [float("nan")] * 8, 0), (304, [float("inf")] * 8, 0), (305, [], 0), (306, [1.0], 0), (None, [1.0] * 8, 0), good[0]]
    frame = spark.createDataFrame(good + same + odd, "vec_id long, embedding array<double>, label int")
    rows = hilbert_ann.nearest(frame).toPandas()
    x, ids = np.array([v for _, v, _ in good + same]), np.array([i for i, _, _ in good + same])
    hits = []
    for q, own in rows.groupby("query_id"):
        s = x @ x[list(ids).index(q)]
        order = [i for i in np.lexsort((ids, -np.round(s, 9))) if ids[i] != q][:20]
        own = own.sort_values("rank")
        assert list(own["rank"]) == list(range(1, 21))
        hits.append(len(set(own.vec_id) & set(ids[order])) / 20)
    assert len(hits) == sum(i % 20 == 0 for i in ids) and np.mean(hits) >= 0.9
    assert hilbert_ann.nearest(frame.limit(0)).count() == 0


def test_pages(spark):
    body = "<nav><a href='/'>Home</a></nav><div class=cookie-notice>We use cookies</div><article><h1>Title {0}</h1><p>First &amp; <b>bold</b>\n text {0}.<p>Second{0} block.<aside>Also</aside></article><div id=comments><p>Nice!</p></div><footer>c</footer>"
    rows = [(i, f"https://host{i % 2}.example/{i}", f"<html><head><title>t</title></head><body>{body.format(i)}</body></html>") for i in range(12)]
    rows += [(20, None, None), (21, "", ""), (22, "not a url", "just words &lt;here"), (None, "https://host0.example/x", "<p>loose"), rows[0], (23, "https://host0.example/y", "<div>" * 3000 + "deep text")]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string")
    got = wrapper_html.main_text(frame).toPandas()
    assert len(got) == len(rows)
    by = {r.page_id: r for r in got.itertuples() if r.page_id == r.page_id}
    assert by[3].text == "Title 3 First & bold text 3. Second3 block." and by[3].n_chars == len(by[3].text)
    assert by[20].text == "" and by[21].text == "" and by[22].text == "just words <here" and by[23].text == "deep text"
    assert wrapper_html.main_text(frame.limit(0)).count() == 0


@pytest.mark.parametrize("stage", [stages.drop_repeated_lines, stages.keep_one_of_near_copies, stages.mix])
def test_stages_keep_columns(spark, odd_documents, no_documents, stage, sf):
    out = stage(spark, odd_documents, sf)
    assert out.columns == odd_documents.columns
    assert stage(spark, no_documents, sf).count() == 0
    rows = out.toPandas()
    assert (rows["size"] == "x").all() and (rows.kept == "x").all()


def test_quality_stage(spark, odd_documents, no_documents, sf):
    assert stages.keep_quality(spark, odd_documents, sf).columns == odd_documents.columns
    assert stages.keep_quality(spark, no_documents, sf).count() == 0


def test_near_copy_stage_keeps_one(spark, odd_documents, sf):
    ids = [r["doc_id"] for r in stages.keep_one_of_near_copies(spark, odd_documents, sf).select("doc_id").collect()]
    assert ids.count(40) == 1 and not set(range(41, 48)) & set(ids)
    assert len([i for i in ids if i is not None]) == len({i for i in ids if i is not None})


def test_mix_stage_takes_words(spark, odd_documents, sf):
    before = mixing.mix_sources(odd_documents)["documents"].agg(F.sum("taken")).first()[0]
    after = stages.mix(spark, odd_documents, sf)
    words = after.select(F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")))).first()[0]
    assert words == before
