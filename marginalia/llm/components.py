"""Connected components of an edge table, by large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from marginalia.llm.storage import dropped, written


def _stars(pairs: DataFrame, large: bool) -> DataFrame:
    """Join every neighbour that is larger (or not larger) than a node to the node's smallest neighbour."""
    both = pairs.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        both = both.unionByName(pairs.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    out = both.join(least, "u")
    if large:
        out = out.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = out.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(out.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.filter("a <> b").distinct()


def connected_components(edges: DataFrame, src: str, dst: str) -> DataFrame:
    """(id, component_id) of every node that has an edge; component_id is the smallest id reachable.

    Null ends and loops are ignored; an empty edge table gives an empty result. Hub nodes are pre-aggregated and then met
    in a join, which Spark can split, so no node's neighbours have to fit into one task.
    """
    pairs = edges.select(F.greatest(src, dst).cast("long").alias("a"), F.least(src, dst).cast("long").alias("b")).filter("a <> b").distinct()
    pairs = written(pairs, "edges")
    sign = None
    while True:
        nxt = written(_stars(_stars(pairs, True), False), "edges")
        row = nxt.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        dropped(pairs)
        pairs = nxt
        if (row.n, row.h) == sign:
            break
        sign = (row.n, row.h)
    low = pairs.select(F.col("a").alias("id"), F.col("b").alias("component_id"))
    return low.unionByName(pairs.select(F.col("b").alias("id"), F.col("b").alias("component_id"))).groupBy("id").agg(F.min("component_id").alias("component_id"))


def smallest_ids(label: DataFrame, classes: DataFrame) -> DataFrame:
    """(cls, component_id): for each labelled class the smallest id (column least of classes) of its component.

    label is a connected_components table over class keys. The minima are a table of their own, so that the join back reads
    two plain shuffles and Spark can split a component that holds a large share of all classes.
    """
    low = written(label.join(classes.select(F.col("cls").alias("id"), "least"), "id").groupBy("component_id").agg(F.min("least").alias("least")), "least")
    return label.join(low, "component_id").select(F.col("id").alias("cls"), F.col("least").alias("component_id"))
