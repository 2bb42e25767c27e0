"""Ranked search: all scores by plain Python, WAND against full sums, odd rows."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from marginalia.llm import ranked_search as rs

SF = "/root/testdata/sf0.001"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, items, k=10):
    """(item, rank, doc, score) by the definition; docs and items are lists of (id, text)."""
    cut = [(i, Counter(TERM.findall((t or "").translate(UP)))) for i, t in docs]
    cut = [(i, c) for i, c in cut if c]
    n, words, df = len(cut), sum(sum(c.values()) for _, c in cut), Counter(w for _, c in cut for w in c)
    out = []
    for item, text in items:
        asked = [w for w in set(TERM.findall((text or "").translate(UP))) if w in df]
        scored = []
        for doc, c in cut:
            m = 100 - 90 + (90 * sum(c.values()) * n) // words
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * ((10**9 * c[w]) // (1000 * c[w] + 8 * m)) for w in asked if w in c)
            if score > 0:
                scored.append((-score, doc is None, doc or 0, doc))
        out += [(item, r, doc, -score) for r, (score, _, _, doc) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def rows(df):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect()), key=str)


@pytest.mark.parametrize("shard_bytes, block_terms", [(rs.SHARD_BYTES, rs.BLOCK_TERMS), (20_000, 50)])
def test_scores_of_all_documents(spark, shard_bytes, block_terms):
    docs, items = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    index = rs.build_index(docs.repartition(3), shard_bytes=shard_bytes)
    assert (index.count() > 10) == (shard_bytes < 1 << 20)
    assert rows(rs.search(index, items, block_terms=block_terms)) == want


def test_odd_rows(spark):
    texts = [(1, "red fox"), (2, "Red FOX red"), (2, "Red FOX red"), (3, None), (4, ""), (5, "., --"), (None, "red fox"), (7, "ÉTÉ été Été"), (8, "blue 42"), (9, "a\x00b\u0085c"), (10, "word " * 50_000 + "fox")]
    texts += [(100 + i, f"filler{i} text") for i in range(30)]
    items = [(1, "red, fox!"), (1, "red, fox!"), (2, None), (3, ""), (4, "--"), (5, "ÉTÉ"), (None, "blue"), (6, "unknown"), (7, "b 42 42 42 word")]
    docs = spark.createDataFrame(texts, "doc_id long, text string").withColumns({"score": F.lit(1), "rank": F.lit(2), "terms": F.lit("x")})
    asked = spark.createDataFrame(items, "item_id long, text string").withColumns({"doc_id": F.lit(1), "score": F.lit("x")})
    assert rows(rs.ranked_search(docs, asked)) == brute(texts, items)
    assert rows(rs.ranked_search(docs, asked, k=2)) == brute(texts, items, 2)
    assert rows(rs.ranked_search(docs.limit(0), asked)) == [] and rows(rs.ranked_search(docs, asked.limit(0))) == []
    assert rows(rs.ranked_search(docs.filter("doc_id IN (3, 4, 5)"), asked)) == []


def test_many_equal_scores_in_all_shards(spark):
    """Copies tie everywhere: the smallest ids win, whichever shard they stand in."""
    texts = [((i * 37) % 500, "same words here") for i in range(500)] + [(1000 + i, f"other{i}") for i in range(600)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(5)
    index = rs.build_index(docs, shard_bytes=500)
    got = rows(rs.search(index, spark.createDataFrame([(1, "words same")], "item_id long, text string")))
    assert [r[2] for r in sorted(got, key=lambda r: r[1])] == list(range(10)) and got == brute(texts, [(1, "words same")])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.dictionaries(st.integers(0, 60), st.integers(1, 9), max_size=40), max_size=8), st.integers(1, 5), st.sampled_from([1, 7, 64]))
def test_wand_against_sums(terms, k, run):
    lists = [(np.array(sorted(t), np.int32), np.array([t[d] for d in sorted(t)], np.int64), max(t.values())) for t in terms if t]
    total = Counter()
    for t in terms:
        total.update(t)
    want = sorted(((-s, d) for d, s in total.items()))[:k]
    places, scores = rs.wand(lists, k, rs.first_floor(lists, k, 4), run)
    assert [(-s, d) for d, s in zip(places.tolist(), scores.tolist(), strict=True)] == want


def test_pivots_alone_are_scored():
    """A common weak term's documents are skipped once the heap is full."""
    common = np.arange(10_000, dtype=np.int32), np.ones(10_000, np.int64), 1
    rare = np.arange(0, 10_000, 100, dtype=np.int32), np.full(100, 50, np.int64), 50
    places, scores = rs.wand([common, rare], 3, rs.first_floor([common, rare], 3))
    assert places.tolist() == [0, 100, 200] and scores.tolist() == [51] * 3


def test_long_lengths_stay_exact():
    lengths = np.array([10, 1 << 40])
    assert rs.saturations(np.array([3, 3]), lengths, 1 << 30, 1 << 62).tolist() == [10**9 * 3 // (3000 + 8 * (10 + 90 * n * (1 << 30) // (1 << 62))) for n in lengths.tolist()]
