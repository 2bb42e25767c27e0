"""Toxicity: held-out accuracy, gradients, pooling by its definition, calibration, odd rows."""

import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from marginalia.llm import langid, toxicity as tx
from marginalia.llm.queries import op12_toxicity

SF = "/root/testdata/sf0.1"


def test_held_out_labels(spark):
    out = {r.doc_id: r for r in op12_toxicity(spark, SF).collect()}
    assert len(out) == spark.read.parquet(f"{SF}/documents.parquet").count()
    labels = spark.read.parquet(f"{SF}/labels.parquet").collect()
    assert all(o.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= o.score <= 1 and o.predicted == (o.score >= 0.5) for i, o in out.items())
    held = [(out[r.doc_id].predicted, r.toxic) for r in labels if r.doc_id in out and out[r.doc_id].held_out]
    hits = sum(p and t for p, t in held)
    assert len(held) > 500 and hits / sum(t for _, t in held) > 0.8 and hits / sum(p for p, _ in held) > 0.85  # some labels are wrong


def test_only_texts_and_learned_labels_count(spark):
    docs = spark.createDataFrame([(i, f"{'you idiot' if i % 4 == 0 else 'fine words'} and text {i % 7}", "en", i % 4 == 0) for i in range(400)], "doc_id long, text string, lang string, bad boolean").withColumn("label", F.col("bad").cast("int"))
    learned = docs.filter(~tx.held_out())
    model = tx.train(learned, docs, langid.train(learned))
    got = {r.doc_id: r for r in tx.score_texts(docs, model).collect()}
    assert all(got[i].predicted == (i % 4 == 0) for i in range(400))
    other = docs.withColumns({"label": F.lit(1), "lang": F.lit("xx"), "doc_id": F.col("doc_id") + 10_000, "score": F.lit("clash"), "predicted": F.lit(9)})
    assert {r.doc_id - 10_000: r.score for r in tx.score_texts(other, model).collect()} == {i: r.score for i, r in got.items()}


def test_odd_rows(spark):
    rows = [(i, "bad trash here" if i % 2 else "good words here", i % 2) for i in range(60)]
    labelled = spark.createDataFrame(rows + [(None, "good", 0), (70, None, 1), (71, "", 0), (72, "good", None), (73, "good", 5), (1, "bad trash here", 0), (1, "bad trash here", 1)], "doc_id long, text string, label int").withColumn("lang", F.lit("en"))
    langs = langid.train(labelled)
    model = tx.train(labelled, labelled, langs)
    odd = [(1, None), (2, ""), (3, "., --"), (None, "bad trash here"), (5, "bad trash here"), (5, "bad trash here"), (6, "good words here " * 60_000), (7, "good " * 70_000 + "bad trash here")]
    docs = spark.createDataFrame(odd, "doc_id long, text string")
    got = sorted(((r.doc_id, round(r.score, 6), r.predicted) for r in tx.score_texts(docs, model).collect()), key=str)
    by = {}
    for i, s, p in got:
        by.setdefault(i, []).append((s, p))
    assert len(got) == len(odd) and by[1] == by[2] == by[3] and by[None] == by[5][:1] and by[5][0] == by[5][1] and by[5][0][1] == 1 and by[6][0][1] == 0
    assert by[7][0][0] > by[6][0][0]
    assert tx.score_texts(docs.limit(0), model).count() == 0
    for few in (labelled.limit(0), labelled.filter("label = 1")):  # nothing to tell apart
        assert {round(r.score, 6) for r in tx.score_texts(docs, tx.train(labelled, few, langs)).collect()} == {0.5}


def test_the_bound_on_the_sample_holds(spark):
    rows = [(i, f"{'bad' if i % 2 else 'good'} words {i}" + " x" * 200, i % 2) for i in range(2000)]
    labelled = spark.createDataFrame(rows, "doc_id long, text string, label int").withColumn("lang", F.lit("en"))
    whole = labelled.agg(F.sum(F.length("text"))).first()[0]
    held = []
    fit = tx.fit_network
    tx.fit_network = lambda texts, labels, **kw: held.append(sum(map(len, texts))) or fit(texts, labels, epochs=1)
    try:
        tx.train(labelled, labelled, langid.train(labelled), chars=whole // 20)
        tx.train(labelled, labelled, langid.train(labelled), texts=50)
    finally:
        tx.fit_network = fit
    assert 0.04 * 203 * 2000 < held[0] < 0.16 * 203 * 2000  # a tenth of the words, less the fifth that calibrates
    assert 50 * 203 < held[1] < 120 * 203


def test_pooling_by_its_definition():
    net = tx.Network(3)
    rng = np.random.default_rng(1)
    texts = [rng.integers(0, tx.BUCKETS, n).astype(np.int32) for n in (0, 1, 2, 127, 128, 129, 700, 0, 5)]
    got = net.logits(np.concatenate(texts), np.append(0, np.cumsum([len(t) for t in texts])))
    for words, value in zip(texts, got, strict=True):
        rows = np.concatenate([net.table[words], np.zeros((4, tx.DIM), np.float32)])
        answers = [[sum(float(rows[i + j] @ net.filters[w][j][:, f]) for j in range(k)) + net.bias[w, f] for w, k in enumerate(tx.WIDTHS) for f in range(tx.FILTERS)] for i in range(len(words))]
        tops = [np.max(answers[a : a + tx.WINDOW], axis=0) for a in range(0, len(words), tx.WINDOW)]
        both = np.concatenate([np.mean(tops, axis=0), np.max(tops, axis=0)]) if tops else np.zeros(len(net.out))
        assert value == pytest.approx(float(both @ net.out), abs=1e-4)


def test_long_texts_are_judged_like_short_ones():
    """A text beyond one span of words is pooled by pieces, with the same result."""
    net, words = tx.Network(5), np.random.default_rng(2).integers(0, tx.BUCKETS, 3000).astype(np.int32)
    span, whole = tx._SPAN, net.pooled(words)
    tx._SPAN = 4 * tx.WINDOW
    try:
        assert np.allclose(net.pooled(words), whole, atol=1e-5)
    finally:
        tx._SPAN = span


def test_threshold_lies_in_the_gap():
    assert tx.threshold(np.array([-3.0, -1, 2, 4]), np.array([0, 0, 1, 1])) == 0.5
    assert tx.threshold(np.array([1.0, 1, 1, 5]), np.array([0, 1, 0, 1])) == 3.0  # equal logits stay together
    assert tx.threshold(np.zeros(0), np.zeros(0)) == 0 and tx.threshold(np.array([1.0, 2]), np.array([1, 1])) == 0


def test_words_are_hashed_without_case():
    words, places = tx.word_buckets(pa.array(["Bad DOG", None, "bad dog", ""]))
    assert places.tolist() == [0, 2, 2, 4, 4] and words[:2].tolist() == words[2:].tolist()


def test_all_labelled_texts_are_learned_from(spark):
    """The sample the network starts from holds none of the words that tell; texts over its bounds still count, in any layout."""
    rows = [(i, f"{'bad' if i % 2 else 'good'} words and more {i % 5}" + (" x y z" * 20 if i < 100 else ""), i % 2) for i in range(2000)]
    rows = [(i, t.replace("bad", "vile") if i >= 100 else t, y) for i, t, y in rows]
    labelled = spark.createDataFrame(rows, "doc_id long, text string, label int").withColumn("lang", F.lit("en"))
    langs = langid.train(labelled)
    started = []
    fit = tx.fit_network
    tx.fit_network = lambda texts, labels, **kw: started.append((len(texts), kw["sizes"].sum())) or fit(texts, labels, **kw)
    try:
        models = [tx.train(d, labelled, langs, texts=60, shard=20_000) for d in (labelled, labelled.repartition(7))]
    finally:
        tx.fit_network = fit
    assert started[0] == started[1] and started[0][0] < 150 and started[0][1] > 1500  # of about 1600 that don't calibrate
    assert np.array_equal(models[0].network.table, models[1].network.table) and models[0].general == models[1].general
    docs = spark.createDataFrame([(i, f"{w} words and more {i}") for i, w in enumerate(["bad", "vile", "good"])], "doc_id long, text string")
    assert [r.predicted for r in tx.score_texts(docs, models[0]).orderBy("doc_id").collect()] == [1, 1, 0]


def test_rare_word_beyond_the_sample(spark):
    """A word that no sampled text holds has its log odds from the others."""
    rows = [(i, f"{'rareword ' if i % 40 == 1 else ''}{'bad' if i % 2 else 'good'} words {i}", i % 2) for i in range(4000)]
    labelled = spark.createDataFrame(rows, "doc_id long, text string, label int").withColumn("lang", F.lit("en"))
    model = tx.train(labelled, labelled, langid.train(labelled), texts=10)
    bucket = tx.word_buckets(pa.array(["rareword"]))[0][0]
    assert model.network.table[bucket, 0] > 1


def test_bins_give_the_cut_of_single_logits():
    z, y = np.array([-3.0, -1, 2, 4]), np.array([0, 0, 1, 1])
    assert tx._cut(np.array([-3.0, 2]), np.array([-1.0, 4]), np.array([0, 2]), np.array([2, 2])) == tx.threshold(z, y) == 0.5
