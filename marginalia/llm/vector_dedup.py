"""Near-duplicate vectors: p-stable hashing into buckets of several tables, then exact cosines.

A unit vector's bucket in a table is the tuple of its quantised projections on k random Gaussian directions (Datar,
Immorlica, Indyk and Mirrokni, 2004). Vectors with a cosine of at least the threshold lie at most
sqrt(2 - 2 threshold) apart, which gives the chance of sharing a bucket; the number of tables follows from the recall that
is asked for, the number of projections from the number of vectors, so that buckets stay small at any size.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import FloatType

from marginalia.llm.components import connected_components, smallest_ids
from marginalia.llm.runs import forest, runs
from marginalia.llm.storage import written

WIDTH = 2.0
BLOCK = 512


def same_cell(distance: float, width: float = WIDTH) -> float:
    """The chance that two vectors at a distance share a cell of one projection."""
    x = width / distance
    below = 0.5 * (1 + math.erf(-x / math.sqrt(2)))
    return 1 - 2 * below - 2 / (math.sqrt(2 * math.pi) * x) * (1 - math.exp(-x * x / 2))


def plan(n: int, threshold: float, recall: float = 0.9999, chance_bucket: int = 64) -> tuple[int, int]:
    """Projections for a bucket of about chance_bucket unrelated (orthogonal) vectors, and tables for the recall."""
    near, far = same_cell(math.sqrt(2 - 2 * threshold)), same_cell(math.sqrt(2))
    k = max(1, math.ceil(math.log(max(n, 2) / chance_bucket) / -math.log(far)))
    return k, math.ceil(math.log(1 - recall) / math.log(1 - near**k))


@lru_cache(8)
def _projections(dim: int, n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.standard_normal((n, dim)), rng.random(n)


def bucket_keys(vectors: np.ndarray, k: int, tables: int, seed: int = 1, first: int | None = None) -> np.ndarray:
    """The bucket of each vector in each of the tables, or in the first few of them."""
    directions, shifts = _projections(vectors.shape[1], tables * k, seed)
    first = tables if first is None else first
    cells = np.floor(vectors @ directions[: first * k].T / WIDTH + shifts[: first * k]).astype(np.int64).reshape(-1, first, k)
    key = np.full(cells.shape[:2], 0x2545F4914F6CDD1D * (vectors.shape[1] + 1) % (1 << 64), np.uint64)  # vectors of other lengths get other keys
    for i in range(k):
        key = (key ^ cells[:, :, i].view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


def unit(raw: np.ndarray) -> np.ndarray:
    """Vectors of length 1, in double precision."""
    v = raw.astype(np.float64)
    v /= np.abs(v).max(axis=1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _links(ids: np.ndarray, vectors: np.ndarray, left: np.ndarray, same: bool, threshold: float):
    """Links inside one block, or of one pair of blocks: (left item, right item) indices."""
    a, b = np.flatnonzero(left), np.flatnonzero(left if same else ~left)
    x, y = np.nonzero(vectors[a] @ vectors[b].T >= threshold)
    x, y = a[x], b[y]
    keep = ids[x] < ids[y] if same else ids[x] != ids[y]
    return x[keep], y[keep]


def _new(vectors: np.ndarray, x: np.ndarray, y: np.ndarray, k: int, tables: int, table: int):
    """Those of the links (x, y) of a table whose ends share no bucket of an earlier one."""
    if not table or not len(x):
        return x, y
    ends, at = np.unique(np.concatenate([x, y]), return_inverse=True)
    keys = bucket_keys(vectors[ends], k, tables, seed=vectors.shape[1], first=table)
    fresh = np.ones(len(x), bool)
    for i, j, key in ((at[: len(x)], at[len(x) :], keys[:, t]) for t in range(table)):
        fresh &= key[i] != key[j]
    return x[fresh], y[fresh]


def near_duplicate_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", *, threshold: float = 0.95, recall: float = 0.9999) -> DataFrame:
    """(id_col, n_links, component_id, kept): one row for each row of vectors.

    Vectors link if their cosine, in double precision, reaches the threshold. Equal vectors form a class that stands in
    the tables once, with its number of rows and a key of its own. A bucket is worked off in pairs of blocks of BLOCK classes
    by matrix products, each of which returns counts and the few edges that hold its links together, so no pairs are
    emitted, and a link that several tables have is counted in the first. Links between different vectors are found with
    the recall asked for at the threshold (surely if closer); no pair below it is linked.

    Every row is a node, whatever its id: rows that repeat an id have the links of their own vector. component_id is the
    smallest id of the rows reachable, kept is id = component_id. Vectors that are null, empty, zero, or hold a null or a
    non-finite component link with nothing and have component_id = id. Vectors of different lengths never link. A row with
    a null id links with nothing and has a null component_id. Other columns are ignored; an empty table gives an empty one.
    """
    v = F.col(vector_col)
    single = isinstance(vectors.schema[vector_col].dataType.elementType, FloatType)
    kind = "float" if single else "double"
    odd = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.transform(v, lambda x: x.cast(kind) + F.lit(0).cast(kind)).alias("v"))  # no negative zeros
    usable = F.coalesce(F.col("id").isNotNull() & (F.size("v") > 0) & ~odd & F.exists("v", lambda x: x != 0), F.lit(False))
    rows = rows.withColumn("v", F.when(usable, F.col("v")))
    prints = (F.xxhash64("v").alias("fp1"), F.xxhash64(F.lit(1), "v").alias("fp2"))
    groups = rows.filter("v IS NOT NULL").groupBy("v").agg(F.min("id").alias("least"), F.count("*").alias("weight"))
    groups = written(groups.select("v", *prints, "least", "weight", F.monotonically_increasing_id().alias("cls")), "classes")
    k, tables = plan(groups.count(), threshold, recall)

    def keyed(batches):
        for batch in batches:
            sizes = pc.list_value_length(batch.column(1)).to_numpy()
            for size in np.unique(sizes).tolist():
                at = pa.array(np.flatnonzero(sizes == size))
                raw = batch.column(1).take(at).flatten().to_numpy().reshape(-1, size)
                keys = bucket_keys(unit(raw), k, tables, seed=size)
                ends = pa.array(np.arange(0, keys.size + 1, tables, dtype=np.int32))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), pa.ListArray.from_arrays(ends, pa.array(keys.ravel()))], ["cls", "keys"])

    hashed = written(groups.select("cls", "v").mapInArrow(keyed, "cls long, keys array<long>"), "keys")
    placed = hashed.select("cls", F.posexplode("keys").alias("tbl", "key"))
    shared = placed.groupBy("tbl", "key").agg(F.count("*").alias("m")).filter("m > 1")
    blocks = F.ceil(F.col("m") / BLOCK).cast("int")
    mine = F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int")
    dealt = placed.join(shared, ["tbl", "key"]).withColumn("blocks", blocks).withColumn("mine", mine)
    # a row for each pair of blocks that the row's own block is part of
    dealt = dealt.select("cls", "tbl", "key", "mine", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    dealt = dealt.select("cls", "tbl", "key", "mine", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"))
    full = dealt.join(groups.select("cls", "v", "weight"), "cls").withColumn("left", F.col("mine") == F.col("i"))
    full = full.select("tbl", "key", "i", "j", "left", "cls", "weight", "v").repartition("tbl", "key", "i", "j").sortWithinPartitions("tbl", "key", "i", "j", "cls")

    def work(batches):
        for run in runs(batches, ("tbl", "key", "i", "j")):
            ids, weight, left = (run.column(c).to_numpy() for c in ("cls", "weight", "left"))
            raw = run.column("v").combine_chunks().flatten().to_numpy()
            if len(raw) % len(ids):  # never the case: the length is part of the keys
                raise ValueError("vectors of different lengths in one bucket")
            u = unit(raw.reshape(len(ids), -1))
            same = run.column("i")[0].as_py() == run.column("j")[0].as_py()
            x, y = _links(ids, u, left, same, threshold)
            x, y = _new(u, x, y, k, tables, int(run.column("tbl")[0].as_py()))
            if len(x):
                links = np.bincount(x, weight[y], len(ids)) + np.bincount(y, weight[x], len(ids))
                at, to = forest(x, y, len(ids))
                n = np.flatnonzero(links)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([ids[n], ids[at]])), pa.array(np.concatenate([links[n].astype(np.int64), np.zeros(len(at), np.int64)])), pa.array(np.concatenate([ids[n], ids[to]]))],
                    ["cls", "links", "other"],
                )

    found = written(full.mapInArrow(work, "cls long, links long, other long"), "links")
    counts = found.groupBy("cls").agg(F.sum("links").alias("links"))
    label = connected_components(found.filter("cls <> other"), "cls", "other")

    slim = groups.select("cls", "fp1", "fp2", "least", "weight")
    known = slim.join(counts, "cls", "left").join(smallest_ids(label, slim), "cls", "left")
    known = known.select("fp1", "fp2", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component_id", "least").alias("component_id"))
    member = F.col("v").isNotNull()
    out = rows.select("id", *(F.when(member, p).alias(f"fp{n}") for n, p in enumerate(prints, 1))).join(written(known, "known"), ["fp1", "fp2"], "left")
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("id") == component).alias("kept"))
