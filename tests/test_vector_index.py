"""The persisted vector index against a search of all vectors."""

import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.sources.store import checkpoint_dir
from loomgraph.sources.vector_index import Mismatch, VectorIndex


def frame(spark, x, name="key"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(np.asarray(x, float).tolist())], f"{name} long, vector array<double>")


def plain(x, q, k):
    out = {}
    for i, v in enumerate(q):
        norm = np.sqrt((x * x).sum(1)) * np.sqrt(v @ v)
        d = np.where(norm > 0, 1 - np.divide(x @ v, norm, out=np.zeros(len(x)), where=norm > 0), 1.0)
        out[i] = [j for _, j in sorted(zip(np.round(d, 5).tolist(), range(len(x))))[:k]]
    return out


def got(df):
    out = {}
    for r in df.orderBy("query", "rank").collect():
        out.setdefault(r["query"], []).append(r["key"])
    return out


def test_search_equals_all(spark):
    rng = np.random.default_rng(3)
    middle = rng.normal(size=(12, 6))
    x = np.vstack([m + 0.05 * rng.normal(size=(40, 6)) for m in middle] + [np.zeros((2, 6)), np.repeat(middle[:1], 30, 0)])
    q = np.vstack([middle[:5] + 0.02, rng.normal(size=(4, 6)), np.zeros((1, 6))])
    path = f"{checkpoint_dir(spark)}/vectors-{uuid.uuid4().hex}"
    VectorIndex(spark, path).build(frame(spark, x).repartition(4), "m", "r", 16)
    index = VectorIndex(spark.newSession(), path).open("m", "r", 6)
    for k in (1, 7, 60, 1000):
        assert got(index.search(frame(index.spark, q, "query"), k)) == plain(x, q, k)
    # a query in a cell of its own reads few partitions
    read = []
    scan = index.vectors
    index.vectors = lambda cells: read.append(set(cells)) or scan(cells)
    assert got(index.search(frame(index.spark, middle[2:3], "query"), 5)) == plain(x, middle[2:3], 5)
    assert len(set.union(*read)) < 16 / 2
    plan = scan([3])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(cell#" in plan


def test_descriptor_is_checked(spark):
    path = f"{checkpoint_dir(spark)}/vectors-{uuid.uuid4().hex}"
    index = VectorIndex(spark, path)
    with pytest.raises(Mismatch):
        index.open("m", "r", 2)
    index.build(frame(spark, [[1, 0], [0, 1], [1, 1]]), "m", "r", 2)
    for model, root, size in (("x", "r", 2), ("m", "x", 2), ("m", "r", 3)):
        with pytest.raises(Mismatch):
            index.open(model, root, size)
    index.build(frame(spark, [[1, 0]]), "m", "later", 2)  # the newest counts
    assert got(index.open("m", "later", 2).search(frame(spark, [[0.0, 1.0]], "query"), 3)) == {0: [0]}
    index.build(frame(spark, [[1, 0]]).where("false"), "m", "empty", 2)
    assert index.open("m", "empty", 2).search(frame(spark, [[0.0, 1.0]], "query").withColumn("x", F.lit(1)), 3).count() == 0
