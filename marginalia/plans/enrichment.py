"""The enrichment job: external ids by title, citations by id, links between versions, percentiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from marginalia.operators.match import merged_links, oriented, pairs_by_key, title_matches
from marginalia.operators.sinks import fill
from marginalia.operators.stats import citation_percentile


def enriched(papers: DataFrame, external: DataFrame, citations: DataFrame) -> DataFrame:
    """papers with ext_id filled where a record matches, citation_count by ext_id, and the percentile within the year.

    papers: id, title, year, surnames, ext_id; external as in title_matches(); citations: ext_id, citation_count.
    Running it again on its own result (without citation_count and percentile) gives the same rows.
    """
    found = title_matches(papers, external).select(F.col("paper_id").alias("id"), "ext_id")
    counts = citations.groupBy("ext_id").agg(F.max("citation_count").alias("citation_count"))
    return citation_percentile(fill(papers, found, "id", "ext_id").join(counts, "ext_id", "left"))


def version_links(papers: DataFrame, first_venue: str, *, every: bool = False) -> DataFrame:
    """(earlier, later, method, confidence) of papers with one external id, else with one normalised title, in another venue or year.

    papers: id, ext_id, norm_title, venue, year. Each paper is linked with one of every other venue and year that shares its
    key, or with every such paper, as in pairs_by_key().
    """
    found = merged_links(pairs_by_key(papers, "ext_id", "arxiv", 1.0, every=every), pairs_by_key(papers, "norm_title", "exact", 0.95, every=every))
    return oriented(found, first_venue)
