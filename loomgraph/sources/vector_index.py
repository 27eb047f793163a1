"""A persisted vector index: cells around centroids, searched exactly by bounds.

Vectors are kept by cell (a partition), each with its distance on the unit sphere from its cell's centroid. A search
first looks into each query's nearest cells until they hold k vectors; what it finds there bounds the k-th distance. By
the triangle inequality a cell whose centroid is farther from the query than that, by more than the cell's radius, can't
have a nearer one; only the others are read. So nothing is lost, and partitions that no query needs aren't read at all.
A descriptor says which model made the vectors, of what length, and for which root of the data; opening checks it.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import cosine_distance
from .store import Store, cut

DESCRIPTOR = "model string, root string, size int, cells int"
#: What rounding may make of a distance.
SLACK = 1e-5


class Mismatch(ValueError):
    """The index is another model's, of other lengths or of other data."""


def unit(x: np.ndarray) -> np.ndarray:
    norm = np.sqrt((x * x).sum(1, keepdims=True))
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def nearest_cells(centroids: np.ndarray):
    """Adds the cell of each row's vector and its distance on the unit sphere; the first of equals."""

    def run(batches):
        for b in batches:
            x = unit(b.column("vector").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(b.num_rows, -1))
            near = (x @ centroids.T).argmax(1)
            away = np.sqrt(((x - centroids[near]) ** 2).sum(1))
            yield pa.record_batch([*b.columns, pa.array(away), pa.array(near.astype(np.int32))], [*b.schema.names, "away", "cell"])

    return run


def centroids_of(vectors: DataFrame, cells: int, rounds: int = 2) -> np.ndarray:
    """Unit vectors: first those of the `cells` rows of least hash, then the means of what is nearest to each."""
    some = vectors.where(F.exists("vector", lambda v: v != 0))  # a direction
    first = some.select(F.xxhash64("key").alias("h"), "key", "vector").orderBy("h", "key").limit(cells).collect()  # at most `cells` rows
    if not first:
        first = vectors.limit(1).collect()
    centroids = unit(np.array([r.vector for r in first], float).reshape(len(first), -1)) if first else np.zeros((0, 0))
    rounds = rounds if len(first) else 0
    for _ in range(rounds):
        near = vectors.mapInArrow(nearest_cells(centroids), schema(vectors))
        length = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, v: s + v * v))
        own = near.where(length > 0).select("cell", F.posexplode(F.transform("vector", lambda v: v / length)).alias("at", "v"))
        for r in own.groupBy("cell", "at").agg(F.avg("v").alias("v")).groupBy("cell").agg(F.array_sort(F.collect_list(F.struct("at", "v"))).alias("m")).collect():  # a row for each cell
            if any(p.v for p in r.m):
                centroids[r["cell"]] = [p.v for p in r.m]
        centroids = unit(centroids)
    return centroids


def schema(vectors: DataFrame) -> str:
    return f"key {vectors.schema['key'].dataType.simpleString()}, vector array<double>, away double, cell int"


class VectorIndex:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.store = spark, path.rstrip("/"), Store(spark, path)

    def build(self, vectors: DataFrame, model: str, root: str = "", cells: int = 32) -> None:
        """vectors (key, vector: doubles of one length)."""
        vectors = cut(vectors)
        centroids = centroids_of(vectors, cells)
        name, expected = f"full-{uuid.uuid4().hex}", self.store.generation()
        folder = f"{self.path}/data/{name}"
        if len(centroids):
            near = vectors.mapInArrow(nearest_cells(centroids), schema(vectors))
            near.repartition("cell", F.pmod(F.xxhash64("key"), F.lit(4))).write.partitionBy("cell").parquet(f"{folder}/vectors")
            rows = [(i, c) for i, c in enumerate(centroids.tolist())]
            radius = self.spark.read.parquet(f"{folder}/vectors").groupBy("cell").agg(F.min("away").alias("inner"), F.max("away").alias("outer"), F.count("*").alias("n"))
            self.spark.createDataFrame(rows, "cell int, centroid array<double>").join(radius, "cell").coalesce(1).write.parquet(f"{folder}/cells")
        size = centroids.shape[1] if len(centroids) else 0
        self.spark.createDataFrame([(model, root, size, len(centroids))], DESCRIPTOR).coalesce(1).write.parquet(f"{folder}/descriptor")
        self.store.publish(name, expected)

    def open(self, model: str, root: str, size: int) -> VectorIndex:
        """Checks that the index is what the caller thinks it is."""
        name = self.store.marks().get(self.store.generation())
        if name is None:
            raise Mismatch("there is no index")
        self.folder = f"{self.path}/data/{name}"
        found = self.spark.read.schema(DESCRIPTOR).parquet(f"{self.folder}/descriptor").first()
        for what, want, has in (("model", model, found.model), ("root", root, found.root), ("size", size, found["size"])):
            if want != has and not (what == "size" and not found.cells):
                raise Mismatch(f"the index has {what} {has}, not {want}")
        self.cells = found.cells
        return self

    def vectors(self, cells: list[int]) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/vectors").where(F.col("cell").isin(cells))

    def _scan(self, asked: DataFrame) -> DataFrame:
        """(query, key, distance) of asked (query, vector, cell) in their cells."""
        wanted = [r["cell"] for r in asked.select("cell").distinct().collect()]  # as many as there are cells, at most
        rows = self.vectors(wanted).select("cell", "key", F.col("vector").alias("other"))
        return rows.join(asked, "cell").select("query", "key", cosine_distance(F.col("other"), F.col("vector")).alias("distance"))

    def search(self, queries: DataFrame, k: int, digits: int = 5) -> DataFrame:
        """(query, key, distance, rank) of queries (query, vector): the k least cosine distances, rounded, ties by key."""
        if not self.cells:
            return queries.select("query").where("false").withColumns({"key": F.lit(None), "distance": F.lit(0.0), "rank": F.lit(0)})
        cells = self.spark.read.parquet(f"{self.folder}/cells")
        sphere = lambda a, b: F.sqrt(F.greatest(2 * cosine_distance(a, b), F.lit(0.0)))
        pairs = queries.join(F.broadcast(cells)).withColumn("to", sphere(F.col("vector"), F.col("centroid")))  # each query with each of the bounded number of cells
        at = Window.partitionBy("query").orderBy("to", "cell")
        pairs = pairs.withColumn("before", F.coalesce(F.sum("n").over(at.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        pairs = cut(pairs.select("query", "vector", "cell", "to", "inner", "outer", (F.col("before") < k).alias("first")))
        ranked = lambda rows: rows.withColumn("distance", F.round("distance", digits)).withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy("distance", "key"))).where(F.col("rank") <= k)
        found = cut(ranked(self._scan(pairs.where("first").select("query", "vector", "cell"))))
        worst = found.groupBy("query").agg(F.max("distance").alias("worst"), F.count("*").alias("found"))
        least = F.greatest(F.lit(0.0), F.col("to") - F.col("outer"), F.col("inner") - F.col("to"))
        near = (least - 1e-9) * F.abs(least - 1e-9) / 2 <= F.col("worst") + SLACK + 10.0**-digits
        more = cut(pairs.where("not first").join(worst, "query").where((F.col("found") < k) | near).select("query", "vector", "cell"))
        return ranked(found.drop("rank").unionByName(self._scan(more)))
