"""Near-duplicate texts against all pairs of plain Python sets."""

import random
import re

import numpy as np
import pytest

from marginalia.llm import near_dup
from marginalia.llm.components import connected_components

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, k=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else {tuple(words)} if words else set()


def brute(rows, percent=85):
    sets = {i: shingles(t) for i, t in rows}
    ids = sorted(sets)
    low = {i: i for i in ids}

    def root(x):
        while low[x] != x:
            x = low[x]
        return x

    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                low[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in ids}


def corpus(seed=3, bases=25):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)] + ["Ärger", "naïve", "ÀB", "x y", "日本"]
    texts = []
    for _ in range(bases):
        words = rng.choices(vocabulary, k=rng.choice([3, 5, 8, 40, 90, 200]))
        for _ in range(rng.randint(1, 6)):
            now = list(words)
            for _ in range(rng.randint(0, max(1, len(now) // 40))):
                now[rng.randrange(len(now))] = rng.choice(vocabulary)
            text = rng.choice([" ", "\n", "\t ", "\x0b"]).join(now)
            texts.append(text.upper() if rng.random() < 0.2 else text)
    return texts + ["", None, " \n\t", "one", "ONE", "one two"]


def test_components_match_all_pairs(spark):
    rows = list(enumerate(corpus()))
    out = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == brute(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in out)


def test_a_large_group_of_near_copies_is_one_component(spark):
    """One bucket of many texts, worked off in several blocks, in which not all are near the first one."""
    rng = random.Random(5)
    base = [f"b{i}" for i in range(60)]
    rows = []
    for i in range(300):
        words = list(base)
        at = rng.randrange(60)
        words[at] = f"c{i}"
        rows.append((i, " ".join(words)))
    out = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == brute(rows)


def test_blocks_of_a_mixed_bucket(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "BLOCK_SHINGLES", 300)
    rows = list(enumerate(corpus(seed=11, bases=15)))
    out = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), rows=1, bands=26, stars=1).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == brute(rows)


def test_lower_threshold(spark):
    assert [near_dup.bands_for(p) for p in (85, 80)] == [26, 38]
    rows = list(enumerate(corpus(seed=21)))
    out = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), percent=80).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == brute(rows, 80)
    assert brute(rows, 80) != brute(rows, 85)


def test_odd_rows(spark):
    text = "a b c d e f g h i j"
    rows = [(1, text, 0, "x"), (1, text, 1, "x"), (None, text, 2, "x"), (7, text, 3, None), (8, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, key int, bands string")
    out = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dup.near_duplicates(df).collect()), key=str)
    assert out == sorted([(1, 6, 1, True), (1, 6, 1, True), (None, 6, None, None), (7, 6, 1, False), (8, 0, 8, True)], key=str)
    assert near_dup.near_duplicates(df.limit(0)).collect() == []


def test_very_long_texts(spark):
    rng = random.Random(9)
    long = " ".join(f"v{rng.randrange(10**6)}" for _ in range(400_000))
    rows = [(1, long), (2, long + " end"), (3, "z" * 3_000_000), (4, "z" * 3_000_000 + " y")]
    out = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out == {i: (len(shingles(t)), c) for (i, t), c in zip(rows, [1, 1, 3, 4], strict=True)}


def test_sketch_fills_every_coordinate_and_estimates_similarity():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    a, b = np.sort(pool[:2000]), np.sort(pool[500:2500])  # 1500 of 2500 shared
    t = 2000
    with np.errstate(over="ignore"):
        s = near_dup.sketches([a, b, pool[:1], pool[:0]], t)
    assert (s[:3] > 0).all() and not s[3].any()
    assert abs((s[0] == s[1]).mean() - 0.6) < 0.05
    assert len(np.unique(s[2])) == t  # one element fills all bins, each with a value of its own


@pytest.mark.parametrize("edges", [[], [(1, 2), (2, 3), (9, 8), (3, 3), (None, 4)], [(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 60)]])
def test_connected_components(spark, edges):
    low = {}
    for a, b in edges:
        if a is not None and a != b:
            for x in (a, b):
                low.setdefault(x, x)
    for _ in low:
        for a, b in edges:
            if a in low and b in low:
                low[a] = low[b] = min(low[a], low[b])
    out = connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()
    assert {r.id: r.component_id for r in out} == low


def by_rows(rows, percent=85):
    """Each row a node of its own: (id, smallest id reachable) of every row, in order."""
    found = brute([(n, t) for n, (_, t) in enumerate(rows)], percent)
    least = {}
    for n, (i, _) in enumerate(rows):
        c = found[n][1]
        least[c] = min(least.get(c, i), i)
    return sorted((i, found[n][0], least[found[n][1]]) for n, (i, _) in enumerate(rows))


@pytest.mark.parametrize("turned", [False, True])
def test_an_id_with_several_texts_loses_no_link(spark, turned):
    """Id 5 holds two texts, each near another row; ids 3 hold many, some of them alike."""
    a, b = (" ".join(f"{c}{i}" for i in range(60)) for c in "ab")
    rows = [(5, a), (5, b), (6, a + " x"), (7, b + " y"), (1, b + " z"), (8, "c d e f g h"), (8, "i j k l m n"), (9, "I j k l m n"), (8, "c d e f g h")]
    rows += [(3, t) for t in corpus(seed=31, bases=6) if t]
    rows = rows[::-1] if turned else rows
    out = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in out) == by_rows(rows)


def test_star_rounds_go_on_while_large_buckets_shrink(spark, monkeypatch):
    """Chains of near copies in one bucket: blocks of two texts, each round of stars joins more."""
    monkeypatch.setattr(near_dup, "BLOCK_SHINGLES", 2000)
    monkeypatch.setattr(near_dup, "ROUND", 0)
    base = [f"b{i}" for i in range(60)]
    rows = [(i, " ".join(base[:k] + [f"c{k}{i}"] + base[k + 1 :])) for i, k in enumerate([3, 9, 20, 40, 3, 57, 9, 31, 44, 12])]
    out = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), rows=1, bands=30, stars=1).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == brute(rows)
