"""Whole analyses over small tables."""

from pyspark.sql import functions as F

from marginalia.plans import enrichment, neighbours, story


def test_enriched_is_repeatable(spark):
    title = "A sufficiently long title about learning"
    papers = spark.createDataFrame([(1, title, 2020, ["kim"], None), (2, "Another quite different long title here", 2020, ["lee"], "x9"), (3, "short", 2021, ["ahn"], None)], "id long, title string, year int, surnames array<string>, ext_id string")
    external = spark.createDataFrame([("x1", title.upper(), 2020, ["kim"])], "ext_id string, title string, created_year int, surnames array<string>")
    citations = spark.createDataFrame([("x1", 5), ("x9", 7), ("x9", 7)], "ext_id string, citation_count long")
    once = enrichment.enriched(papers, external, citations)
    got = sorted((r.id, r.ext_id, r.citation_count, r.percentile) for r in once.collect())
    assert got == [(1, "x1", 5, 0.5), (2, "x9", 7, 1.0), (3, None, None, None)]
    again = enrichment.enriched(once.drop("citation_count", "percentile"), external, citations)
    assert sorted((r.id, r.ext_id, r.citation_count, r.percentile) for r in again.collect()) == got


def test_version_links(spark):
    rows = [(1, "x1", "t", "ICLR", 2020), (2, "x1", "t", "NeurIPS", 2021), (3, None, "t", "ICLR", 2019), (4, "x1", "u", "ICLR", 2020)]
    papers = spark.createDataFrame(rows, "id long, ext_id string, norm_title string, venue string, year int")
    out = sorted((r.earlier, r.later, r.method) for r in enrichment.version_links(papers, "ICLR").collect())
    assert out == [(1, 2, "arxiv"), (3, 1, "exact"), (3, 2, "exact"), (4, 2, "arxiv")]


def test_nothing_selected(spark):
    out = spark.createDataFrame([("weak", "m"), ("strong", "m")], "level string, message string").select(story.nothing_selected(F.col("level"), F.col("message")).alias("s")).collect()
    assert out[0].s == f"> ⚠️ **m**\n\n{story.NO_REVIEWS}" and out[1].s == story.NO_MATCH


def test_leaks_among_hits(spark):
    """Of the pairs asked for, those that leaks() gives for all papers."""
    samples = spark.createDataFrame([(i, f"t{i % 3}") for i in range(12)], "sample_id long, title string")
    papers = spark.createDataFrame([(i, f"T{i % 4}") for i in range(40)], "id long, title string")
    links = spark.createDataFrame([(1, 20), (21, 2), (30, 31), (5, 5)], "earlier long, later long")
    hits = spark.createDataFrame([(s, p) for s in range(14) for p in range(0, 40, 1 + s % 3)], "sample_id long, paper_id long")
    want = {tuple(r) for r in neighbours.leaks(samples, links, papers).collect()} & {tuple(r) for r in hits.collect()}
    got = [tuple(r) for r in neighbours.leaks(samples, links, papers, hits).collect()]
    assert len(got) == len(set(got)) and set(got) == want
