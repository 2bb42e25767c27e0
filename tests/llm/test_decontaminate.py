"""Benchmark passages: alignment scores against a plain dynamic programme, and planted copies."""

import random

import numpy as np
import pyarrow as pa

from marginalia.llm import decontaminate as d


def plain(item, text):
    """The Smith-Waterman score cell by cell, as a share of the item's own."""
    best, above = 0, [0] * (len(text) + 1)
    for x in item:
        now = [0]
        for j, y in enumerate(text):
            now.append(max(0, above[j] + (d.MATCH if x == y else d.MISMATCH), above[j + 1] + d.GAP, now[j] + d.GAP))
        best, above = max(best, *now), now
    return best / (d.MATCH * len(item))


def test_alignment_matches_the_plain_one():
    rng = np.random.default_rng(2)
    items = [rng.integers(1, 6, rng.integers(1, 30)).astype(np.uint64) for _ in range(120)]
    texts = [rng.integers(1, 6, rng.integers(0, 60)).astype(np.uint64) for _ in range(120)]
    got = d.align(items, texts, cells=500)
    assert np.allclose(got, [plain(i.tolist(), t.tolist()) for i, t in zip(items, texts, strict=True)])


def edited(rng, words, share):
    out = []
    for w in words:
        x = rng.random()
        if x < share / 3:
            continue
        out.append(f"q{rng.randrange(10**6)}" if x < share * 2 / 3 else w)
        if share * 2 / 3 <= x < share:
            out.append(f"q{rng.randrange(10**6)}")
    return out


def world(seed=4):
    rng = random.Random(seed)
    item = lambda: [f"w{rng.randrange(5000)}" for _ in range(rng.randint(15, 60))]
    items = [item() for _ in range(30)]
    docs, leaks = [], set()
    for i in range(400):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.randint(0, 300))]
        if i % 10 == 0:
            k, at = rng.randrange(30), rng.randint(0, len(words))
            copy = edited(rng, items[k], [0, 0.15, 0.3][i // 10 % 3])
            words = words[:at] + copy + words[at:]
            leaks.add((i, k))
        docs.append((i, rng.choice([" ", ", ", "\n"]).join(words).upper() if i % 20 == 0 else " ".join(words)))
    return docs, [(k, " ".join(w)) for k, w in enumerate(items)], leaks


def tokens(text):
    words, _ = d._words(pa.array([text]))
    return words.tolist()


def test_planted_copies_and_nothing_else(spark):
    docs, items, leaks = world()
    out = d.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), block_words=300).collect()
    texts, wanted = dict(docs), dict(items)
    full = {(i, k): plain(tokens(wanted[k]), tokens(texts[i])) for i, k in leaks}
    assert {(r.doc_id, r.item_id) for r in out} == {pair for pair, x in full.items() if x >= 0.5}
    assert sum(x >= 0.5 for x in full.values()) >= 0.95 * len(leaks)
    for r in out:  # a window around the seeds holds the best alignment of the whole text
        assert abs(r.score - plain(tokens(wanted[r.item_id]), tokens(texts[r.doc_id]))) < 1e-9


def test_all_pairs_of_the_smallest_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    got = {(r.doc_id, r.item_id): r.score for r in d.contaminated(docs, bench).collect()}
    items = [(r.item_id, np.array(tokens(r.text), np.uint64)) for r in bench.collect()]
    for r in docs.collect():
        words = np.array(tokens(r.text), np.uint64)
        scores = d.align([w for _, w in items], [words] * len(items))
        want = {(r.doc_id, i): x for (i, _), x in zip(items, scores, strict=True) if x >= 0.5}
        assert {k: v for k, v in got.items() if k[0] == r.doc_id}.keys() == want.keys()


def test_a_passage_that_most_texts_hold(spark):
    item = " ".join(f"w{i}" for i in range(30))
    docs = [(i, f"a{i} b{i} {item} c{i}") for i in range(200)] + [(900, "w1 w2 w3 other words")]
    out = d.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string")).collect()
    assert sorted(r.doc_id for r in out) == list(range(200)) and all(r.score == 1 for r in out)


def test_odd_rows(spark):
    item = "one two three four five"
    docs = spark.createDataFrame([(1, f"x {item} y", 0), (1, f"x {item} y", 0), (None, item, 1), (2, None, 2), (3, "", 3)], "doc_id long, text string, item_id int")
    items = spark.createDataFrame([(5, item, "s"), (5, item, "s"), (None, item, "s"), (6, None, "s"), (7, "", "s"), (8, "two words", "s")], "item_id long, text string, doc_id string")
    assert [tuple(r) for r in d.contaminated(docs, items).collect()] == [(1, 5, 1.0)]
    assert d.contaminated(docs.limit(0), items).collect() == [] and d.contaminated(docs, items.limit(0)).collect() == []


def test_a_very_long_text(spark):
    rng = random.Random(8)
    words = [f"w{rng.randrange(50_000)}" for _ in range(300_000)]
    item = words[250_000:250_040]
    out = d.contaminated(spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string"), spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")).collect()
    assert [tuple(r) for r in out] == [(1, 1, 1.0)]


def test_a_spread_item_of_three_words_and_edited_copies_of_a_spread_passage(spark):
    """Every copy that scores the threshold is found, in a corpus that is full of the passage as in a small one."""
    rng = random.Random(6)
    items = {1: "alpha beta gamma", 2: " ".join(f"p{i}" for i in range(16)), 3: " ".join(f"r{i}" for i in range(8)), 4: " ".join(f"s{i % 5}" for i in range(11))}
    docs = {i: f"a{i} {items[1]} b{i} {items[2]} c{i} {items[3]} {items[4]}" for i in range(1500)}
    for i in range(1500, 2100):
        k = 1 + i % 4
        words = items[k].split()
        copy = [w if j % 3 < 2 else f"x{i}" for j, w in enumerate(words)] if i % 5 == 0 else [x for w in words for x in (w, f"y{i}")] if i % 5 == 1 else edited(rng, words, 0.4)
        docs[i] = " ".join([f"f{i}", *copy, f"g{i}", *rng.sample(items[2].split(), 4)])
    out = d.contaminated(spark.createDataFrame(list(docs.items()), "doc_id long, text string"), spark.createDataFrame(list(items.items()), "item_id long, text string")).collect()
    want = {(i, k): 1.0 for i in range(1500) for k in items} | {(i, k): plain(tokens(items[k]), tokens(docs[i])) for i in range(1500, 2100) for k in items}
    want = {pair: x for pair, x in want.items() if x >= 0.5}
    got = {(r.doc_id, r.item_id): r.score for r in out}
    assert got.keys() == want.keys() and all(abs(got[pair] - want[pair]) < 1e-9 for pair in want)


def test_seeds_are_enough_at_other_thresholds():
    """Random texts over few words: what the windows hold is what the alignment with whole texts finds."""
    rng = np.random.default_rng(3)
    for threshold in (0.4, 0.5, 0.7, 0.9, 1.0):
        items = [rng.integers(1, 9, rng.integers(3, 14)).astype(np.uint64) for _ in range(40)]
        own = d.Items(list(range(40)), items, threshold)
        texts = [rng.integers(1, 9, rng.integers(0, 40)).astype(np.uint64) for _ in range(60)]
        places = np.cumsum([0, *map(len, texts)])
        got = {}
        for text, item, lo, hi in d._windows(own, np.concatenate(texts), places):
            for t, i, a, b in zip(text, item, lo, hi, strict=True):
                got[t, i] = max(got.get((t, i), 0), plain(items[i].tolist(), np.concatenate(texts)[a:b].tolist()))
        want = {(t, i): x for t, w in enumerate(texts) for i, own_words in enumerate(items) if (x := plain(own_words.tolist(), w.tolist())) >= threshold}
        assert want.keys() == {k for k, x in got.items() if x >= threshold} and all(got[k] == x for k, x in want.items())
