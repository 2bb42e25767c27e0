"""Near-duplicate vectors against all pairs."""

import math

import numpy as np
from pyspark.sql import functions as F

from marginalia.llm import vector_dedup

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, threshold=0.95):
    usable = {i: np.array(v, np.float64) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    ids = sorted(usable)
    unit = np.stack([usable[i] / np.linalg.norm(usable[i]) for i in ids])
    near = unit @ unit.T >= threshold
    links = {i: 0 for i, _ in rows} | {i: int(near[n].sum()) - 1 for n, i in enumerate(ids)}
    low = {i: i for i, _ in rows}
    changed = True
    while changed:
        changed = False
        for n, i in enumerate(ids):
            m = min(low[ids[k]] for k in np.flatnonzero(near[n]))
            if m < low[i]:
                low[i], changed = m, True
    return {i: (links[i], low[i]) for i, _ in rows}


def groups(seed=2, dim=32, centres=40):
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(centres):
        c = rng.standard_normal(dim)
        c /= np.linalg.norm(c)
        for _ in range(rng.integers(1, 12)):
            v = c + rng.standard_normal(dim) * rng.choice([0.0, 0.01, 0.03, 0.06])
            out.append((v * rng.choice([1.0, 3.0])).astype(np.float32).tolist())
    return out


def test_links_match_all_pairs(spark):
    odd = [None, [], [0.0] * 32, [None] + [1.0] * 31, [float("nan")] + [1.0] * 31, [float("inf")] + [1.0] * 31]
    rows = list(enumerate(groups() + odd))
    df = spark.createDataFrame([(i, v, i % 3) for i, v in rows], SCHEMA)
    out = vector_dedup.near_duplicate_vectors(df).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in out} == brute(rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in out)


def test_a_hot_group_is_worked_off_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(vector_dedup, "BLOCK", 8)
    rng = np.random.default_rng(4)
    rows = [(i, (np.ones(16) + rng.standard_normal(16) * 0.25).astype(np.float32).tolist()) for i in range(300)]
    rows += [(300 + i, rows[0][1]) for i in range(100)]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)
    out = {r.vec_id: (r.n_links, r.component_id) for r in vector_dedup.near_duplicate_vectors(df).collect()}
    want = brute(rows)
    assert {i: c for i, (_, c) in out.items()} == {i: c for i, (_, c) in want.items()}
    assert all(n <= want[i][0] for i, (n, _) in out.items())  # none below the threshold
    assert sum(n for n, _ in out.values()) >= 0.999 * sum(n for n, _ in want.values())


def test_the_whole_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    out = vector_dedup.near_duplicate_vectors(df).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in out} == brute(rows)


def test_repeats_null_ids_and_lengths(spark):
    rows = [(5, [1.0, 0.0], 0), (5, [1.0, 0.0], 0), (6, [2.0, 0.0], 1), (None, [1.0, 0.0], 1), (7, [1.0, 0.0, 0.0], 1)]
    df = spark.createDataFrame(rows, SCHEMA).withColumnRenamed("label", "rep")
    out = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in vector_dedup.near_duplicate_vectors(df).collect()), key=str)
    assert out == sorted([(5, 2, 5, True), (5, 2, 5, True), (6, 2, 5, False), (None, 0, None, None), (7, 0, 7, True)], key=str)
    assert vector_dedup.near_duplicate_vectors(df.limit(0)).collect() == []


def test_plan_has_the_recall_that_is_asked_for():
    near = vector_dedup.same_cell(math.sqrt(0.1))
    for n in (500, 10**6, 10**9):
        k, tables = vector_dedup.plan(n, 0.95, 0.9999)
        assert 1 - (1 - near**k) ** tables >= 0.9999


def test_an_id_with_several_vectors(spark):
    """Id 5 holds two orthogonal vectors, each with one near vector; every row has the links of its own vector."""
    vectors = [(5, [1.0, 0.0, 0.0]), (5, [0.0, 1.0, 0.0]), (6, [1.0, 0.1, 0.0]), (7, [0.1, 1.0, 0.0]), (4, [0.0, -0.0, 1.0]), (4, [0.0, 0.0, 1.0])]
    for rows in (vectors, vectors[::-1]):
        df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)
        out = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in vector_dedup.near_duplicate_vectors(df).collect())
        assert out == [(4, 1, 4, True), (4, 1, 4, True), (5, 1, 5, True), (5, 1, 5, True), (6, 1, 5, False), (7, 1, 5, False)]


def test_double_vectors_and_clashing_columns(spark):
    rows = [(1, [1e300, 1.0], 7), (2, [2e300, 2.0], 7), (3, [0.0, 1e-300], 7)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, cls int").withColumn("links", F.lit(1))
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in vector_dedup.near_duplicate_vectors(df).collect()) == [(1, 1, 1), (2, 1, 1), (3, 0, 3)]
