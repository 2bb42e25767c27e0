"""Stored indexes against scans: recall, exact search, pruning, odd rows."""

import random

import numpy as np
import pytest

from marginalia.operators import cells, postings, retrieval
from marginalia.queries.retrieval import WORDS

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def vectors(spark):
    return spark.read.parquet(f"{SF}/embeddings.parquet").selectExpr("vec_id AS id", "embedding").cache()


@pytest.fixture(scope="module")
def index(vectors, tmp_path_factory):
    return cells.build(vectors, str(tmp_path_factory.mktemp("cells")))


def test_recall_of_every_fiftieth_vector(spark, vectors, index):
    rows = vectors.collect()
    unit = np.array([r.embedding for r in rows], np.float64)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    ids = np.array([r.id for r in rows])
    asked = np.flatnonzero(ids % 50 == 0)
    exact = {int(ids[i]): set(ids[np.lexsort((ids, -(unit @ unit[i]).round(12)))[:20]].tolist()) for i in asked}
    found = {}
    for r in cells.nearest_of_all(index, vectors.filter("id % 50 = 0").withColumnRenamed("id", "query_id"), 20).collect():
        found.setdefault(r.query_id, set()).add(r.id)
    recall = np.mean([len(exact[q] & found[q]) / 20 for q in exact])
    assert set(found) == set(exact) and recall >= 0.9, recall
    assert spark.read.parquet(f"{index.path}/vectors").count() == len(rows)


def test_a_search_of_clustered_vectors_reads_few_files(spark, tmp_path):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(5)
    middles = rng.normal(size=(40, 16))
    rows = [(i, (middles[i % 40] + rng.normal(scale=0.1, size=16)).tolist()) for i in range(2000)]
    df = spark.createDataFrame(rows, "id long, embedding array<double>")
    index = cells.build(df, str(tmp_path / "c"))
    query = np.array(rows[7][1])
    away = np.linalg.norm(index.centroids - query / np.linalg.norm(query), axis=1)
    part = cells._read(index, spark, query, np.argsort(away)[: index.probes].tolist())
    files = lambda d: d.select(F.input_file_name().alias("f")).distinct().count()
    assert index.probes <= 6 and files(part) <= 0.2 * files(index.rows(spark))
    scan = part._jdf.queryExecution().executedPlan().toString()
    assert "cell" in scan[scan.index("PartitionFilters") :][:60]
    got = {r.id for r in cells.nearest(index, spark, rows[7][1], 20).collect()}
    assert len(got & {r.id for r in retrieval.nearest(df, rows[7][1], 20).collect()}) >= 18


@pytest.mark.parametrize("probes", [1, 3, None])
def test_exact_search_reads_what_the_bound_asks(spark, vectors, index, probes):
    for i in (7, 50, 1999):
        query = list(vectors.filter(f"id = {i}").first().embedding)
        want = [(r.id, round(r.cosine, 9)) for r in retrieval.nearest(vectors, query, 30).orderBy("vector_rank").collect()]
        got = [(r.id, round(r.cosine, 9)) for r in cells.nearest(cells.load(spark, index.path), spark, query, 30, probes=probes, exact=True).orderBy("vector_rank").collect()]
        assert got == want


def test_odd_vectors(spark, tmp_path):
    nan = float("nan")
    rows = [(i, [float(i % 5 + 1), float(i % 3), 1.0]) for i in range(40)] + [(100, None), (101, [0.0, 0.0, 0.0]), (102, [nan, 1.0, 1.0]), (103, [1.0, 2.0]), (104, [float("inf"), 0.0, 1.0]), (7, [8.0, 1.0, 1.0]), (None, [1.0, 1.0, 1.0])]
    df = spark.createDataFrame(rows, "id long, embedding array<double>")
    index = cells.build(df, str(tmp_path / "a"), cells=4)
    assert index.rows(spark).count() == len(rows) and index.rows(spark).filter("cell = -1").count() == 5
    got = cells.nearest(index, spark, [1.0, 1.0, 1.0], 100, exact=True).collect()
    assert len(got) == 42 and got[0].id is None and all(r.cosine is not None for r in got)
    for query in ([0.0, 0.0, 0.0], [nan, 1.0, 1.0], [1.0, 2.0]):
        assert cells.nearest(index, spark, query, 3).count() == 0
    queries = spark.createDataFrame([(1, [1.0, 1.0, 1.0]), (2, None), (3, [0.0, 0.0, 0.0]), (4, [1.0])], "query_id long, embedding array<double>")
    assert {r.query_id for r in cells.nearest_of_all(index, queries, 2).collect()} == {1}
    assert cells.nearest(cells.build(df.limit(0), str(tmp_path / "b")), spark, [1.0, 1.0, 1.0], 3).count() == 0


def test_postings_give_what_scans_give(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").selectExpr("doc_id AS id", "text")
    path = postings.build(docs, str(tmp_path / "w"), buckets=8)
    for words, k in ((WORDS, 100), (("the",), 5), (("nowhere", "the", "THE"), 7), (("nowhere",), 3), ((), 3)):
        want = [(r.id, r.score) for r in retrieval.bm25(docs, words, k).orderBy("fts_rank").collect()] if words else []
        assert [(r.id, r.score) for r in postings.search(spark, path, words, k).orderBy("fts_rank").collect()] == want


def test_a_search_reads_its_buckets_and_no_text(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").selectExpr("doc_id AS id", "text")
    path = postings.build(docs, str(tmp_path / "w"))
    plan = postings.search(spark, path, ["the", "thre"], 5)._jdf.queryExecution().executedPlan().toString()
    assert "documents.parquet" not in plan and "bucket" in plan[plan.index("PartitionFilters"):][:120] and "In(term" in plan


def test_odd_texts(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice("ab cd ef gh".split()) for _ in range(rng.randint(0, 9)))) for i in range(60)] + [(100, None), (101, ""), (102, "--"), (103, "ab " * 50_000)]
    docs = spark.createDataFrame(rows, "id long, text string")
    path = postings.build(docs, str(tmp_path / "w"), buckets=3)
    for words in (["ab"], ["ab", "cd"], ["ab", "cd", "zz"], ["a b"]):
        held = {i: set((t or "").split()) for i, t in rows}
        asked = [w for w in words if " " not in w]
        assert {r.id for r in postings.matching(spark, path, words).collect()} == {i for i, t in held.items() if asked and all(w in t for w in asked)}
        assert {r.id for r in postings.matching(spark, path, words, every=False).collect()} == {i for i, t in held.items() if any(w in t for w in asked)}
    empty = postings.build(docs.limit(0), str(tmp_path / "e"))
    assert postings.search(spark, empty, ["ab"], 3).count() == 0


def test_many_queries_are_compared_in_blocks(spark, tmp_path):
    """One row of a join for each pair of blocks, not of vectors; copies tie and stand by id, wherever a block ends."""
    rng = np.random.default_rng(9)
    unit = rng.normal(size=(70, 8))
    rows = [(i, unit[i % 70].tolist()) for i in range(210)]
    df = spark.createDataFrame(rows, "id long, embedding array<double>")
    index = cells.build(df, str(tmp_path / "c"), cells=2)
    asked = df.filter("id % 50 = 0").withColumnRenamed("id", "query_id")
    found = cells.nearest_of_all(index, asked, 7, probes=2)
    assert found._jdf.queryExecution().optimizedPlan().toString().split("Join", 1)[1].count("MapInPandas") == 2  # blocks on both sides
    small = unit / np.linalg.norm(unit, axis=1, keepdims=True)
    want = {}
    for q in range(0, 210, 50):
        cosine = np.array([(small[i % 70] * small[q % 70]).sum() for i in range(210)])
        want[q] = sorted(range(210), key=lambda i: (-cosine[i], i))[:7]
    got = {}
    for r in found.orderBy("query_id", "vector_rank").collect():
        got.setdefault(r.query_id, []).append(r.id)
    assert got == want
    a, ids = np.array([[1.0, 0.0]]), np.array([4, 2, 9])
    assert cells._best(np.array([1]), a, ids, np.array([[2.0, 0.0], [3.0, 0.0], [0.0, 1.0]]), 2)["id"].tolist() == [2, 4]


def test_landed_files_share_folders(spark, tmp_path):
    """A folder for many files instead of one for each; rows that repeat a key, null keys and lines inside texts are kept."""
    from marginalia.sources import harvest

    rows = [(i, f"text {i}\nof two lines") for i in range(60)] + [(7, "again"), (None, "nameless"), (-3, "é")]
    root = f"{tmp_path}/files"
    harvest.land_files(spark.createDataFrame(rows, "k long, t string"), root, "k", "t", per_folder=20)
    assert len(list((tmp_path / "files").iterdir())) <= 4
    got = sorted(bytes(r.content) for r in harvest.attachments(spark, f"{root}/*").collect())
    assert got == sorted(t.encode() + b"\n" for _, t in rows)


def test_words_are_counted_without_holding_a_task_s_texts(spark):
    """no aggregation and no shuffle stand before a posting, and the sorted words are not worked out anew in a filter."""
    texts = {1: "b a B c a", 2: None, 3: "", 4: "--", 5: "zz " * 3000 + " ".join(f"w{i}" for i in range(4000))}
    rows = postings.counted(spark.createDataFrame(list(texts.items()), "id long, text string"), "id", "text")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and "Exchange" not in plan and plan.count("sort_array(") == 1
    got = {(r.id, r.term): (r.len, r.tf) for r in rows.collect()}
    assert {k: v for k, v in got.items() if k[0] != 5} == {(1, "a"): (5, 2), (1, "b"): (5, 2), (1, "c"): (5, 1)}
    assert len(got) == 3 + 4001 and got[5, "zz"] == (7000, 3000) and got[5, "w7"] == (7000, 1)


def test_an_index_cuts_its_texts_once(spark, tmp_path, monkeypatch):
    """F16: the counts come from the postings; before, all texts were cut into words again for them."""
    calls = []
    real = postings.tokens
    monkeypatch.setattr(postings, "tokens", lambda text: calls.append(1) or real(text))
    path = postings.build(spark.createDataFrame([(1, "a b a"), (2, None), (3, "c")], "id long, text string"), str(tmp_path / "w"), buckets=2)
    counts = spark.read.parquet(f"{path}/counts").first()
    assert len(calls) == 1 and counts.n == 3 and counts.avg_len == 4 / 3


def test_terms_share_files_and_buckets_are_found_without_python(spark, tmp_path, monkeypatch):
    """F16: a file of terms a bucket, where each task wrote one to each; the words' buckets are constants of the plan, not a job of Python rows."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").selectExpr("doc_id AS id", "text")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # as where the terms are many
    try:
        path = postings.build(docs, str(tmp_path / "w"), buckets=4)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(list((tmp_path / "w" / "terms").glob("bucket=*/*.parquet"))) == 4
    monkeypatch.setattr(type(spark), "createDataFrame", None)
    plan = postings.matching(spark, path, ["the", "of"])._jdf.queryExecution().executedPlan().toString()
    assert "hash" not in plan[plan.index("PartitionFilters") :].split("]", 1)[0]
    words = {r.id: set(r.t or []) for r in docs.select("id", postings.tokens("text").alias("t")).collect()}
    assert {r.id for r in postings.matching(spark, path, ["the", "of"]).collect()} == {i for i, t in words.items() if {"the", "of"} <= t}
