"""The corpus pipeline: five stages over documents, each by one operator of marginalia.llm.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from public_tokenizers import path as tokenizer_path
from pyspark.sql import DataFrame, SparkSession, functions as F

from marginalia.llm import decontaminate, langid, near_dup, packing, secret_scan
from marginalia.llm.queries import table
from marginalia.llm.storage import written


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a letter go on; those without one (und) go. Labels are those of the training part; where there are
    none no language is told, and all documents with a letter go on.

    Each row is judged by its own text: null and repeated ids, ties and repeated rows are like any other. Null and empty
    texts go, very long ones are judged whole, other columns are kept as they are, an empty table gives an empty one.
    """
    return langid.told(docs, langid.train(docs.filter(~langid.held_out())))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, that with the smallest id: five words, a similarity of 0.8 or more.

    A row with a null id stays if its group has no other; of rows that repeat, or tie for the smallest id, one stays. Null
    texts and those without a word are alike to none; of those, rows that repeat an id and text count as one. Very long
    texts are compared whole, other columns are kept as they are, an empty table gives an empty one.
    """
    row = "_row"
    while row in docs.columns:
        row += "_"
    keyed = written(docs.withColumn(row, F.monotonically_increasing_id()), "keyed")  # written, so that a row's key stays its own
    found = near_dup.near_duplicates(keyed, row, percent=80).select(row, "n_shingles", "component_id")
    blank = F.when(~F.col("text").rlike(r"[^\x00-\x20]"), F.col("text"))
    rows = found.join(keyed.select(row, "doc_id", blank.alias("blank"), F.col("text").isNull().alias("missing")), row)
    empty = F.col("n_shingles") == 0
    group = F.when(empty, F.struct("doc_id", "blank", "missing"))
    first = rows.groupBy(F.when(~empty, F.col("component_id")), group).agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", row)).alias("first"))
    return keyed.join(first.select(F.col(f"first.{row}").alias(row)), row, "left_semi").select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go, each by its own text: null and repeated ids, ties and repeated rows are like any other.

    Null and empty texts stay, very long ones are searched whole, other columns are kept as they are; an empty table gives
    an empty one, an empty benchmark lets all stay.
    """
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a secret go, each by its own text: null and repeated ids, ties and repeated rows are like any other.

    Null and empty texts stay, very long ones are searched whole, other columns are kept as they are; an empty table gives
    an empty one.
    """
    return secret_scan.clean_rows(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents that are left, with their sequences.

    Every row is a document of its own: null and repeated ids are kept, a null or empty text is its end token alone, very long
    ones are cut into pieces, ties go either way; other columns play no part, an empty table gives an empty one.
    """
    return packing.pack_documents(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secrets", secrets),
    ("packing", packing_stage),
]

#: SQL has no form for hyperdimensional profiles, alignment scores or the search for bins; tests/llm checks each stage.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
