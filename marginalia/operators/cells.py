"""An index of vectors on disk: cells around centroids, of which a search reads the nearest.

Vectors are assigned to the centroids of a k-means fit and written partitioned by cell, so a search for one vector is a scan with
a partition filter, and one for many is a join on the cell. Two ways: approximate, over a number of cells; exact, which reads
some cells first and then all that may, by the triangle inequality, hold a nearer vector.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from marginalia.functions import rank as R

#: Vectors that the centroids are fitted on, and the most cells that an index has.
SAMPLE, MOST_CELLS = 20_000, 4096
#: How many cells a search reads: as many as held this share of the nearest neighbours of some of some vectors.
RECALL, TUNED, ASKED, NEAR = 0.95, 4000, 200, 20
NO_CELL = -1  # null, zero and not finite vectors, and those of another length than most
#: Vectors or queries of a cell that are compared at once.
BLOCK = 1024
_CENTROIDS = "cell int, centroid array<double>, radius double, probes int"


@dataclass
class Cells:
    """An index: its folder, of each cell the centroid and the distance of its farthest unit vector, and the cells that a search reads."""

    path: str
    centroids: np.ndarray
    radius: np.ndarray
    probes: int = 1

    def rows(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/vectors")


def _unit(v: Column) -> Column:
    return R.normalized(v)


def build(vectors: DataFrame, path: str, id_col: str = "id", vector_col: str = "embedding", *, cells: int | None = None, sample: int = SAMPLE, seed: int = 1) -> Cells:
    """Write all rows of vectors (id, embedding) to path, by cell; about the square root of their number of cells.

    Centroids are fitted on about `sample` vectors, taken by a hash of the id; every vector is assigned and written. Cells that
    hold many rows are written as several files. How many cells a search reads is measured on TUNED vectors (see RECALL), so
    vectors without clusters ask for more of them. Vectors that have no cosine are kept in a cell of their own that no
    search reads.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("embedding"))
    size = R.norm(F.col("embedding"))
    sound = F.coalesce((size > 0) & (size < float("inf")) & ~F.isnan(size), F.lit(False))
    lengths = rows.filter(sound).groupBy(F.size("embedding").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").first()
    if lengths is None:
        rows.withColumn("cell", F.lit(NO_CELL)).write.partitionBy("cell").parquet(f"{path}/vectors")
        spark.createDataFrame([], _CENTROIDS).write.parquet(f"{path}/centroids")
        return Cells(path, np.zeros((0, 0)), np.zeros(0))
    fits = sound & (F.size("embedding") == lengths.dim)
    k = cells or min(MOST_CELLS, max(1, round(math.sqrt(lengths.n))))
    usable = rows.filter(fits).withColumn("unit", _unit(F.col("embedding")))
    drawn = usable.filter(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 32)) < min(1.0, sample / lengths.n) * (1 << 32))
    model = KMeans(k=k, seed=seed, maxIter=12, featuresCol="v", predictionCol="cell").fit(drawn.select(array_to_vector("unit").alias("v")))
    centroids = np.array(model.clusterCenters())
    placed = model.transform(usable.withColumn("v", array_to_vector("unit"))).select("id", "embedding", "cell")
    other = rows.filter(~fits).withColumn("cell", F.lit(NO_CELL))
    # rebalanced, not repartitioned: a cell with a large share of the rows is split over several tasks and files
    placed.unionByName(other).hint("rebalance", "cell").write.partitionBy("cell").parquet(f"{path}/vectors")

    def farthest(batches):
        for pdf in batches:
            unit = np.stack(pdf["embedding"].to_numpy()).astype(np.float64)
            unit /= np.linalg.norm(unit, axis=1, keepdims=True)
            yield pd.DataFrame({"cell": pdf["cell"], "d": np.linalg.norm(unit - centroids[pdf["cell"].to_numpy()], axis=1)})

    held = spark.read.parquet(f"{path}/vectors").filter(F.col("cell") != NO_CELL).select("cell", "embedding")
    far = held.mapInPandas(farthest, "cell int, d double").groupBy("cell").agg(F.max("d").alias("d")).collect()  # a row for each cell
    radius = np.zeros(len(centroids))
    for r in far:
        radius[r.cell] = r.d
    few = drawn.limit(TUNED).select("unit").toPandas()["unit"]
    probes = _probes(np.stack(few.to_numpy()) if len(few) else np.zeros((0, lengths.dim)), centroids)
    table = [(i, c.tolist(), r, probes) for i, (c, r) in enumerate(zip(centroids, radius.tolist(), strict=True))]
    spark.createDataFrame(table, _CENTROIDS).coalesce(1).write.parquet(f"{path}/centroids")
    return Cells(path, centroids, radius, probes)


def _probes(unit: np.ndarray, centroids: np.ndarray) -> int:
    """The cells, nearest first, that hold RECALL of the nearest neighbours of some vectors among all of them."""
    square = lambda a, b: (a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * a @ b.T
    if not len(unit):
        return len(centroids)
    cell = square(unit, centroids).argmin(1)
    asked = unit[:ASKED]
    place = np.empty((len(asked), len(centroids)), np.int64)
    np.put_along_axis(place, square(asked, centroids).argsort(1), np.arange(len(centroids))[None], 1)
    near = (asked @ unit.T).argsort(1)[:, ::-1][:, : NEAR + 1]
    return int(np.quantile(np.take_along_axis(place, cell[near], 1), RECALL)) + 1


def load(spark: SparkSession, path: str) -> Cells:
    """The index written to path; its centroids, MOST_CELLS at most by default, come to the driver."""
    rows = spark.read.schema(_CENTROIDS).parquet(f"{path}/centroids").orderBy("cell").collect()
    return Cells(path, np.array([r.centroid for r in rows]), np.array([r.radius for r in rows]), max((r.probes for r in rows), default=1))


def _read(index: Cells, spark: SparkSession, query: np.ndarray, cells: list[int]) -> DataFrame:
    cosine = R.cosine(F.col("embedding"), F.array(*[F.lit(float(x)) for x in query]))
    return index.rows(spark).filter(F.col("cell").isin(cells)).select("id", cosine.alias("cosine"))


def nearest(index: Cells, spark: SparkSession, query: list[float], k: int, *, probes: int | None = None, exact: bool = False) -> DataFrame:
    """(id, cosine, vector_rank): the k nearest rows by cosine, ties by id, among the cells nearest to the query.

    exact reads, besides those, each cell that may hold a vector as near as the k-th found: one whose centroid is no farther from
    the query than that vector and the cell's radius together. A query without a direction has no neighbours.
    """
    q = np.array(query, np.float64)
    size = np.linalg.norm(q)
    empty = spark.createDataFrame([], "id long, cosine double")
    if not len(index.centroids) or q.shape != index.centroids.shape[1:] or not np.isfinite(size) or size == 0:
        top = empty
    else:
        away = np.linalg.norm(index.centroids - q / size, axis=1)
        first = np.argsort(away, kind="stable")[: probes or index.probes].tolist()
        top = _read(index, spark, q, first).orderBy(F.desc("cosine"), "id").limit(k)
        if exact:
            found = [r.cosine for r in top.select("cosine").collect()]  # k numbers
            reach = math.sqrt(max(0.0, 2 - 2 * min(found))) if len(found) == k else math.inf
            more = np.flatnonzero(away - index.radius <= reach + 1e-9)
            top = _read(index, spark, q, sorted({*first, *more.tolist()})).orderBy(F.desc("cosine"), "id").limit(k)
    return top.withColumn("vector_rank", F.row_number().over(Window.orderBy(F.desc("cosine"), "id")))  # of k rows


def nearest_of_all(index: Cells, queries: DataFrame, k: int, *, probes: int | None = None) -> DataFrame:
    """(query_id, id, cosine, vector_rank) for each of queries (query_id, embedding), over its nearest cells.

    A join on the cell of blocks of queries with blocks of vectors, which Spark splits where a cell is asked for by many or holds
    much; a pair of blocks is one product, of which the k best of each query go on. Ties in cosine are by id.
    """
    spark = queries.sparkSession
    shared, most = spark.sparkContext.broadcast(index.centroids), probes or index.probes  # of MOST_CELLS rows by default
    rows = index.rows(spark).filter(F.col("cell") != NO_CELL).select("id", "embedding", "cell")
    query_type, id_type = queries.schema["query_id"].dataType.simpleString(), rows.schema["id"].dataType.simpleString()

    def of_queries(batches):
        for pdf in batches:
            held = [(n, np.asarray(x, np.float64)) for n, x in zip(pdf["query_id"], pdf["q"], strict=True) if x is not None]
            held = [(n, x) for n, x in held if x.shape == shared.value.shape[1:] and np.isfinite(x).all() and x.any()]
            if held:
                ids, q = pd.Series([n for n, _ in held]), np.stack([x for _, x in held])
                away = (shared.value**2).sum(1) - 2 * (q / np.linalg.norm(q, axis=1, keepdims=True)) @ shared.value.T
                near = away.argsort(1, kind="stable")[:, :most]
                yield from _blocks(near.ravel(), np.repeat(np.arange(len(q)), near.shape[1]), ids, q, "query_id", "q")

    def of_vectors(batches):
        for pdf in batches:
            yield from _blocks(pdf["cell"].to_numpy(), np.arange(len(pdf)), pdf["id"], np.stack(pdf["embedding"].to_numpy()).astype(np.float64), "id", "v")

    def products(batches):
        for pdf in batches:
            for asked, q, ids, v in pdf[["query_id", "q", "id", "v"]].itertuples(index=False, name=None):
                yield _best(np.asarray(asked), np.frombuffer(q).reshape(len(asked), -1), np.asarray(ids), np.frombuffer(v).reshape(len(ids), -1), k)

    asked = queries.select("query_id", F.col("embedding").alias("q")).mapInPandas(of_queries, f"cell int, query_id array<{query_type}>, q binary")
    held = rows.mapInPandas(of_vectors, f"cell int, id array<{id_type}>, v binary")
    found = asked.join(held, "cell").select("query_id", "q", "id", "v").mapInPandas(products, f"query_id {query_type}, id {id_type}, cosine double")
    order = Window.partitionBy("query_id").orderBy(F.desc("cosine"), "id")
    return found.withColumn("vector_rank", F.row_number().over(order)).filter(F.col("vector_rank") <= k)


def _blocks(cells: np.ndarray, place: np.ndarray, ids: pd.Series, vectors: np.ndarray, id_name: str, name: str):
    """Rows of a cell, BLOCK at most, with their ids and vectors: cells are those of the rows at place."""
    order = np.argsort(cells, kind="stable")
    edges = np.flatnonzero(np.diff(cells[order])) + 1
    for run in np.split(order, edges):
        for lo in range(0, len(run), BLOCK):
            at = place[run[lo : lo + BLOCK]]
            yield pd.DataFrame({"cell": [int(cells[run[0]])], id_name: [ids.iloc[at].tolist()], name: [vectors[at].tobytes()]})


def _best(asked: np.ndarray, q: np.ndarray, ids: np.ndarray, v: np.ndarray, k: int) -> pd.DataFrame:
    """The k of ids nearest to each of asked, with their cosines, which are summed up pair by pair: equal vectors have equal ones."""
    q, v = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in (q, v))
    rough, parts = q @ v.T, []
    least = np.partition(rough, -k, axis=1)[:, -k] - 1e-9 if len(ids) > k else np.full(len(q), -np.inf)
    for n in range(len(q)):
        near = np.flatnonzero(rough[n] >= least[n])
        cosine = (v[near] * q[n]).sum(1)
        first = np.lexsort((ids[near], -cosine))[:k]
        parts.append(pd.DataFrame({"query_id": np.repeat(asked[n : n + 1], len(first)), "id": ids[near][first], "cosine": cosine[first]}))
    return pd.concat(parts)
