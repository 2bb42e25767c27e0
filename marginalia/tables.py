"""The driver's tables, and papers, reviews, points and authors as views of them.

Each view is a pair: a DataFrame function and the same in SQL, so that a query and the SQL that checks it start alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as papers: priority is the venue, status the decision, price the citations (unknown for every tenth)."""
    o = read(spark, sf_dir, "orders")
    decision = F.when(F.col("o_orderstatus") == "F", "accept-poster").when(F.col("o_orderstatus") == "O", "reject").otherwise("withdrawn")
    cites = F.when(F.col("o_orderkey") % 10 != 0, F.floor("o_totalprice"))
    return o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("author_id"), F.col("o_orderpriority").alias("venue"), F.year("o_orderdate").alias("year"), decision.alias("decision"), cites.alias("citation_count"))


PAPERS = """papers AS (SELECT o_orderkey AS id, o_custkey AS author_id, o_orderpriority AS venue, year(o_orderdate)::INT AS year,
  CASE o_orderstatus WHEN 'F' THEN 'accept-poster' WHEN 'O' THEN 'reject' ELSE 'withdrawn' END AS decision,
  CASE WHEN o_orderkey % 10 <> 0 THEN floor(o_totalprice)::BIGINT END AS citation_count FROM orders)"""


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as reviews: quantity is the rating, return flag N an unsplit body."""
    li = read(spark, sf_dir, "lineitem")
    return li.select(F.col("l_orderkey").alias("paper_id"), F.col("l_linenumber").alias("review_no"), F.col("l_quantity").alias("rating"), (F.col("l_returnflag") == "N").alias("unsplit"), F.col("l_suppkey").alias("reviewer_id"))


REVIEWS = """reviews AS (SELECT l_orderkey AS paper_id, l_linenumber AS review_no, l_quantity AS rating, l_returnflag = 'N' AS unsplit,
  l_suppkey AS reviewer_id FROM lineitem)"""


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as review points: the line number is the aspect (7 is other), status F a weakness."""
    li = read(spark, sf_dir, "lineitem")
    aspect = F.when(F.col("l_linenumber") == 7, F.lit("other")).otherwise(F.concat(F.lit("aspect_"), F.col("l_linenumber").cast("string")))
    sentiment = F.when(F.col("l_linestatus") == "F", "weakness").otherwise("question")
    return li.select(F.col("l_orderkey").alias("paper_id"), aspect.alias("aspect"), sentiment.alias("sentiment"), F.col("l_partkey").alias("point_id"), (F.col("l_returnflag") == "N").alias("from_unsplit"))


POINTS = """points AS (SELECT l_orderkey AS paper_id, CASE WHEN l_linenumber = 7 THEN 'other' ELSE 'aspect_' || l_linenumber END AS aspect,
  CASE WHEN l_linestatus = 'F' THEN 'weakness' ELSE 'question' END AS sentiment, l_partkey AS point_id, l_returnflag = 'N' AS from_unsplit FROM lineitem)"""
