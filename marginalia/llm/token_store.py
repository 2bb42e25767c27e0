"""Token ids in Parquet files: list columns, dictionary pages for ids, deltas for counters, page indexes.

A store is a folder with data/ (one file for each range of document ids, sorted by id within and across files) and
manifest/ (a row for each file: its range, documents, tokens, and the tokens of all files before it). Ids are
dictionary-encoded and so take two bytes or less; doc_id, local_start and n_tokens are delta-encoded. Small pages and the
column index let a reader take the ids of a few documents, or no ids at all.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from marginalia.llm.tokens import encoder

SCHEMA = "part int, doc_id long, local_start long, n_tokens long, ids array<int>"


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", *, end_id: int = 1, files: int | None = None, file_bytes: int = 128 << 20, row_group_bytes: int = 16 << 20, page_bytes: int = 64 << 10) -> None:
    """Encode each text (null: empty) and its end id, and write the store in ascending id order.

    There is a file for each file_bytes of text, but while tasks of a 32nd of that aren't enough for the cluster's cores, as
    many as there are such. Rows that repeat an id stand one after the other in text order; null ids come first. An empty table gives a store
    without rows.
    """

    def work(batches):
        enc = encoder(tokenizer_path, end_id)
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            doc_ids = batch.column(0)
            for lo, places, ids in enc.encode(batch.column(1)):
                n = len(places) - 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, part, np.int32)), doc_ids.slice(lo, n), pa.array(at + places[:-1]), pa.array(np.diff(places)), pa.ListArray.from_arrays(pa.array(places.astype(np.int32)), pa.array(ids))],
                    ["part", "doc_id", "local_start", "n_tokens", "ids"],
                )
                at += len(ids)

    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    if files is None:
        size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
        files = max(1, -(-size // file_bytes), min(spark.sparkContext.defaultParallelism, -(-32 * size // file_bytes)))
    rows = rows.repartitionByRange(files, "doc_id").sortWithinPartitions("doc_id", "text")
    options = {
        "compression": "zstd", "parquet.writer.version": "PARQUET_2_0", "parquet.enable.dictionary": "true",
        "parquet.enable.dictionary#doc_id": "false", "parquet.enable.dictionary#local_start": "false", "parquet.enable.dictionary#n_tokens": "false",
        "parquet.block.size": str(row_group_bytes), "parquet.page.size": str(page_bytes), "parquet.dictionary.page.size": str(1 << 20),
    }
    rows.mapInArrow(work, SCHEMA).write.options(**options).parquet(f"{path}/data")
    stored = spark.read.schema(SCHEMA).parquet(f"{path}/data").select("part", "doc_id", "n_tokens")
    manifest = stored.groupBy("part").agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"), F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
    before = F.sum("n_tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))  # a row for each file
    manifest.withColumn("base", F.coalesce(before, F.lit(0))).coalesce(1).write.parquet(f"{path}/manifest")


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens) of all documents; no page of ids is read."""
    return _placed(spark, path, ["doc_id", "n_tokens"]).select("doc_id", "start", "n_tokens")


def read_tokens(spark: SparkSession, path: str, first_id: int | None = None, last_id: int | None = None) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of the documents of an id range; other row groups and pages are skipped."""
    out = _placed(spark, path, ["doc_id", "n_tokens", "ids"])
    if first_id is not None:
        out = out.filter(F.col("doc_id") >= first_id)
    if last_id is not None:
        out = out.filter(F.col("doc_id") <= last_id)
    return out.select("doc_id", "start", "n_tokens", "ids")


def _placed(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    data = spark.read.schema(SCHEMA).parquet(f"{path}/data").select("part", "local_start", *columns)
    manifest = spark.read.parquet(f"{path}/manifest").select("part", "base")
    return data.join(manifest, "part").withColumn("start", F.col("base") + F.col("local_start"))


def digests(tokens: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) with n_tokens and the checksum from the ids themselves."""

    def work(batches):
        for batch in batches:
            lists = batch.column(2)
            ends = lists.offsets.to_numpy()
            values = memoryview(np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False), "<i4")).cast("B")
            crc = [zlib.crc32(values[4 * a : 4 * b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.diff(ends).astype(np.int64)), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return tokens.select("doc_id", "start", "ids").mapInArrow(work, "doc_id long, start long, n_tokens long, ids_crc32 long")
