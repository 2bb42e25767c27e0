"""An index of words on disk: postings by term, of which a search reads the query's alone.

Three tables: postings (term, id, tf, len) in buckets of terms and sorted by term in each file, so that a search prunes partitions by
the bucket and row groups by the term; terms (term, df) in the same buckets; and one row of counts. Ids are keys of the
texts; null and empty texts count as texts without words.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from marginalia.functions.text import tokens
from marginalia.operators.retrieval import BM25_B, K1

BUCKETS = 64
#: Given on reading, since an index of no words has no files to take them from.
_SCHEMAS = {"postings": "term string, id {}, len int, tf int, bucket int", "terms": "term string, df long, bucket int"}


def _bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def counted(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(term, id, len, tf): the words of each text, counted within its row, so no task holds those of more than one text."""
    cut = docs.select(F.col(id_col).alias("id"), F.sort_array(F.coalesce(tokens(F.col(text_col)), F.array().cast("array<string>"))).alias("t"))
    places = F.when(F.size("t") > 0, F.sequence(F.lit(0), F.size("t") - 1)).otherwise(F.array().cast("array<int>"))
    cut = cut.select("id", "t", F.size("t").alias("len"), F.filter(places, lambda i: (i == 0) | (F.get("t", i - 1) != F.get("t", i))).alias("at"))  # where each term begins
    term = lambda i, k: F.struct(F.get("t", i).alias("term"), (F.coalesce(F.get("at", k + 1), F.col("len")) - i).alias("tf"))
    # outer: else a filter on the size of p would be put below it all, in which each step works out the sorted words anew
    return cut.select("id", "len", F.transform("at", term).alias("p")).select("id", "len", F.inline_outer("p")).filter("term IS NOT NULL").select("term", "id", "len", "tf")


def build(docs: DataFrame, path: str, id_col: str = "id", text_col: str = "text", *, buckets: int = BUCKETS) -> str:
    """Write the postings of docs to path. Texts are cut into words once; a bucket with a frequent word is split over tasks."""
    spark = docs.sparkSession
    rows = counted(docs, id_col, text_col).withColumn("bucket", _bucket(F.col("term"), buckets)).hint("rebalance", "bucket").sortWithinPartitions("bucket", "term", "id")
    rows.write.partitionBy("bucket").parquet(f"{path}/postings")
    id_type = rows.schema["id"].dataType.simpleString()
    held = spark.read.schema(_SCHEMAS["postings"].format(id_type)).parquet(f"{path}/postings")
    often = held.groupBy("bucket", "term").agg(F.count("*").alias("df")).hint("rebalance", "bucket")  # a file or two a bucket, not one for each task
    often.write.partitionBy("bucket").parquet(f"{path}/terms")
    total = held.agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("total"))  # a row, as is the number of texts: all words without cutting again
    average = F.try_divide(F.col("total").cast("double"), F.col("n"))
    docs.agg(F.count("*").alias("n")).crossJoin(F.broadcast(total)).select("n", average.alias("avg_len"), F.lit(buckets).alias("buckets"), F.lit(id_type).alias("id_type")).write.parquet(f"{path}/counts")
    return path


def _lists(spark: SparkSession, path: str, table: str, words: Sequence[str]) -> DataFrame:
    """Rows of the words, by the buckets they hash to: both filters reach the scan."""
    counts = spark.read.parquet(f"{path}/counts").first()
    asked = F.col("bucket").isin([_bucket(F.lit(w), counts.buckets) for w in words])  # constants to the optimizer
    return spark.read.schema(_SCHEMAS[table].format(counts.id_type)).parquet(f"{path}/{table}").filter(asked & F.col("term").isin(list(words)))


def _asked(words: Sequence[str]) -> list[str]:
    return sorted(w for w in set(words) if re.fullmatch("[a-z0-9]+", w))


def search(spark: SparkSession, path: str, words: Sequence[str], k: int) -> DataFrame:
    """(id, score, fts_rank): the k best texts that hold any of the words by BM25, as bm25() finds them by a scan."""
    words, counts = _asked(words), spark.read.parquet(f"{path}/counts")
    if not words:
        return spark.createDataFrame([], "id long, score double, fts_rank int")
    often = F.broadcast(_lists(spark, path, "terms", words).select("term", "df"))  # a row for each word
    rows = _lists(spark, path, "postings", words).join(often, "term").crossJoin(F.broadcast(counts.select("n", "avg_len")))  # one row
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - BM25_B + BM25_B * F.col("len") / F.col("avg_len")))
    top = rows.groupBy("id").agg(F.round(F.sum(part), 9).alias("score")).orderBy(F.desc("score"), "id").limit(k)
    return top.withColumn("fts_rank", F.row_number().over(Window.orderBy(F.desc("score"), "id")))  # of k rows


def matching(spark: SparkSession, path: str, words: Sequence[str], *, every: bool = True) -> DataFrame:
    """(id): the texts that hold all of the words, or any of them; all words that can't stand in a text match none."""
    words = _asked(words)
    if not words:
        return spark.createDataFrame([], "id long")
    held = _lists(spark, path, "postings", words).groupBy("id").agg(F.count("*").alias("n"))
    return held.filter(F.col("n") >= (len(words) if every else 1)).select("id")
