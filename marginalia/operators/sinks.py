"""Writes that can be repeated: upserts, replacement of children, fills, caches, checkpoints of stages.

Each returns the new table; replace_table() writes it beside the old one and renames, since a Parquet folder can't be
overwritten while it is read.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from marginalia.operators.timeline import newest


def upsert(old: DataFrame, new: DataFrame, key: str, *, keep: tuple[str, ...] = (), keep_blank: tuple[str, ...] = ()) -> DataFrame:
    """Rows of new replace those of old with the same key; rows of new without a key are skipped.

    In columns of keep a null in new leaves the old value, in those of keep_blank an empty text does too.
    """
    n = new.filter(F.col(key).isNotNull()).withColumn("_new", F.lit(True)).alias("n")
    both = old.withColumn("_old", F.lit(True)).alias("o").join(n, key, "full_outer")

    def value(c: str) -> Column:
        fresh, held = F.col(f"n.{c}"), F.col(f"o.{c}")
        if c in keep:
            fresh = F.coalesce(fresh, held)
        elif c in keep_blank:
            fresh = F.coalesce(F.nullif(fresh, F.lit("")), held)
        return F.when(F.col("_new"), fresh).otherwise(held).alias(c)

    return both.select(key, *[value(c) for c in old.columns if c != key])


def replace_children(children: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """All children of the keys that new has are replaced by new's."""
    return children.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def fill(rows: DataFrame, found: DataFrame, key: str, column: str, overwrite: bool = False) -> DataFrame:
    """rows with column taken from found where it was null, or wherever found has it."""
    f = found.select(key, F.col(column).alias("_found"))
    value = F.coalesce("_found", column) if overwrite else F.coalesce(column, "_found")
    return rows.join(f, key, "left").withColumn(column, value).drop("_found")


def changed_only(old: DataFrame, new: DataFrame, key: str, column: str) -> DataFrame:
    """Rows of new whose value differs from old's, null counting as a value: the writes that aren't no-ops."""
    return new.alias("n").join(old.alias("o"), key).filter(~F.col(f"n.{column}").eqNullSafe(F.col(f"o.{column}"))).select(key, F.col(f"n.{column}").alias(column))


def missing(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't done yet: where a resumed load starts."""
    return rows.join(done.select(key).distinct(), key, "left_anti")


def cached(cache: DataFrame, key: Column, now: Column, days: int = 30, needs_llm: bool = False) -> DataFrame:
    """Cache rows of a key that are younger than days, made with the LLM where that is asked for, and still parse."""
    fresh = F.col("built_at") > now - F.make_dt_interval(days=F.lit(days))
    return cache.filter((F.col("key") == key) & fresh & (F.col("used_llm") | F.lit(not needs_llm)) & F.try_parse_json("payload").isNotNull())


def set_status(status: DataFrame, new: DataFrame) -> DataFrame:
    """Stage checkpoints by (venue, stage), newest first."""
    return newest(status.withColumn("_at", F.lit(0)).unionByName(new.withColumn("_at", F.lit(1))), ["venue", "stage"], [F.desc("_at")]).drop("_at")


def replace_table(df: DataFrame, path: str) -> None:
    """Write df to path, which df may be reading: into a folder beside it, which then takes its name."""
    spark: SparkSession = df.sparkSession
    aside = f"{path.rstrip('/')}.{uuid.uuid4().hex}"
    df.write.parquet(aside)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    target, source = hadoop(path), hadoop(aside)
    system = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    system.delete(target, True)
    if not system.rename(source, target):
        raise OSError(f"{aside} can't be renamed to {path}")
