"""Neighbours of held-out papers without those that would leak their reviews."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

#: How many hits more than wanted a search returns, so that enough are left without the leaks.
MARGIN = 10


def leaks(samples: DataFrame, links: DataFrame, papers: DataFrame, among: DataFrame | None = None) -> DataFrame:
    """(sample_id, paper_id): the sample itself, papers linked with it either way, and papers with its title in any case.

    samples: sample_id, title; links: earlier, later; papers: id, title. With among (sample_id, paper_id) only its pairs are
    asked for, and papers of one title don't multiply.
    """
    if among is not None:
        return _leaks_among(among.select("sample_id", "paper_id").distinct(), samples, links, papers)
    own = samples.select("sample_id", F.col("sample_id").alias("paper_id"))
    ends = links.select(F.col("earlier").alias("sample_id"), F.col("later").alias("paper_id")).unionByName(links.select(F.col("later").alias("sample_id"), F.col("earlier").alias("paper_id")))
    linked = ends.join(samples.select("sample_id").distinct(), "sample_id", "left_semi")
    titles = papers.select(F.lower("title").alias("t"), F.col("id").alias("paper_id"))
    same = samples.select("sample_id", F.lower("title").alias("t")).join(titles, "t").select("sample_id", "paper_id")
    return own.unionByName(linked).unionByName(same).distinct()


def _leaks_among(pairs: DataFrame, samples: DataFrame, links: DataFrame, papers: DataFrame) -> DataFrame:
    ends = links.select(F.col("earlier").alias("sample_id"), F.col("later").alias("paper_id"))
    ends = ends.unionByName(links.select(F.col("later").alias("sample_id"), F.col("earlier").alias("paper_id")))
    mine = pairs.join(samples.select("sample_id", F.lower("title").alias("t")).distinct(), "sample_id")
    own = mine.filter("sample_id = paper_id").select("sample_id", "paper_id")
    linked = mine.select("sample_id", "paper_id").join(ends, ["sample_id", "paper_id"], "left_semi")
    titles = papers.select(F.col("id").alias("paper_id"), F.lower("title").alias("t"))
    return own.unionByName(linked).unionByName(mine.join(titles, ["paper_id", "t"], "left_semi").select("sample_id", "paper_id")).distinct()


def clean_neighbours(hits: DataFrame, banned: DataFrame, want: int) -> DataFrame:
    """(sample_id, paper_id, position): the first want hits that aren't banned; every smaller k is a prefix of them.

    hits: sample_id, paper_id, rank, of one search with want + MARGIN results.
    """
    left = hits.filter(F.col("rank") <= want + MARGIN).join(banned, ["sample_id", "paper_id"], "left_anti")
    position = F.row_number().over(Window.partitionBy("sample_id").orderBy("rank"))
    return left.select("sample_id", "paper_id", position.alias("position")).filter(F.col("position") <= want)
