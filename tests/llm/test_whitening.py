"""Whitening against numpy's solvers and plain integers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.llm import queries, whitening
from loomgraph.llm.bidiagonal import leading

RNG = np.random.default_rng(5)


def spread(s, n=64):
    """A matrix of given singular values."""
    q = np.linalg.qr(RNG.normal(size=(n, n)))[0]
    return (np.linalg.qr(RNG.normal(size=(n, n)))[0] * np.append(s, np.full(n - len(s), 0.1))) @ q.T


WILKINSON = np.diag(np.abs(np.arange(-10.0, 11))) + np.diag(np.ones(20), 1) + np.diag(np.ones(20), -1) + 2 * np.eye(21)
CASES = {
    "normal": RNG.normal(size=(500, 64)), "graded": RNG.normal(size=(500, 64)) * np.logspace(0, -8, 64), "graded up": RNG.normal(size=(500, 64)) * np.logspace(-8, 0, 64), "one hot": np.eye(64) - 1 / 64, "identity": np.eye(64), "zero": np.zeros((70, 64)),
    "rank 3": np.vstack([RNG.normal(size=(3, 64)), np.zeros((61, 64))]), "5": RNG.normal(size=(100, 5)), "1": RNG.normal(size=(100, 1)), "2": RNG.normal(size=(100, 2)), "wilkinson": np.linalg.cholesky(WILKINSON).T, "pairs of columns": np.repeat(RNG.normal(size=(200, 32)), 2, 1),
} | {f"near {g}": spread([1, 1 - g, 1 - 2 * g, 1 - 3 * g]) for g in (0, 1e-15, 1e-12, 1e-8, 1e-4, 1e-2)}


@pytest.mark.parametrize("name", CASES)
def test_leading(name):
    r = np.linalg.qr(CASES[name], mode="r")
    k = min(4, len(r))
    values, z = leading(r, k)
    want = np.linalg.svd(r, compute_uv=False) ** 2
    most = max(want[0], 1e-300)
    assert np.abs(values - want).max() <= 1e-13 * most and np.abs(values[:k] - want[:k]).max() <= 1e-12 * most
    assert np.abs(z.T @ z - np.eye(k)).max() < 1e-12 and np.abs(r.T @ (r @ z) - z * values[:k]).max() < 1e-12 * most


def plain(vectors, scale=256, components=4):
    """{vec_id: [(n, deviation, whitened, explained) by component]} of (vec_id, vector), whitened up to its sign."""
    kept = [(i, [int(np.floor(scale * float(c))) for c in v]) for i, v in vectors if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in kept})
    n, total = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    mean = np.array([t / n for t in total])
    centred = np.array(fit, float) - mean
    e, v = np.linalg.eigh(centred.T @ centred / n)
    e, v = e[::-1], v[:, ::-1]
    return {i: [(n, sum((n * c - t) ** 2 for c, t in zip(x, total, strict=True)), float((np.array(x) - mean) @ v[:, k] / np.sqrt(e[k])), float(e[k] / e.sum())) for k in range(min(components, len(e)))] for i, x in kept}


def same(df, want):
    got = {}
    for r in df.orderBy("vec_id", "component").collect():
        got.setdefault(r.vec_id, []).append(r)
    assert got.keys() == want.keys()
    signs = {}
    for i, rows in got.items():
        assert [r.component for r in rows] == list(range(1, len(want[i]) + 1))
        for r, (n, deviation, whitened, explained) in zip(rows, want[i], strict=True):
            assert (r.n, r.deviation) == (n, deviation) and abs(r.explained / explained - 1) < 1e-9 and r.identity_error < 1e-9
            if abs(whitened) > 1e-6:
                sign = signs.setdefault(r.component, np.sign(whitened * r.whitened))
                assert abs(sign * r.whitened - whitened) < 1e-6 * max(1, abs(whitened))


def test_table(spark, sf_dir):
    vectors = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    same(queries.QUERIES["op12_whitening"](spark, sf_dir), plain(vectors))


def test_repeated_and_unusable_rows(spark):
    vectors = [(i, [float(x) for x in RNG.normal(size=7)]) for i in range(40)]
    vectors += [(100 + i, vectors[3][1]) for i in range(50)] + [(200, None), (201, [1.0, None] + [0.0] * 5), (202, [float("nan")] * 7), (203, [float("-inf")] + [0.0] * 6)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>").withColumn("x", F.lit("clash")).withColumn("n", F.lit(1)).repartition(5)
    vectors = [(i, v and [None if c is None else float(np.float32(c)) for c in v]) for i, v in vectors]
    same(whitening.whiten(df), plain(vectors))
    extra = df.unionByName(spark.createDataFrame([(300, [1.0, 2.0]), (301, [])], "vec_id long, embedding array<float>"), allowMissingColumns=True)
    same(whitening.whiten(extra), plain(vectors))  # other lengths take no part
    assert whitening.whiten(df.where("false")).count() == 0


def test_triangles_meet_in_a_tree(spark, monkeypatch):
    monkeypatch.setattr(whitening, "TRIANGLE_BYTES", 1)
    vectors = [(i, [float(x) for x in RNG.normal(size=3)]) for i in range(60)]
    same(whitening.whiten(spark.createDataFrame(vectors, "vec_id long, embedding array<double>")), plain(vectors))


def test_directions_without_variation(spark):
    one = spark.createDataFrame([(1, [0.5, 1.0, 2.0]), (2, [0.5, 1.0, 2.0]), (None, [0.5, 1.0, 2.0])], "vec_id long, embedding array<double>")
    got = whitening.whiten(one).collect()
    assert len(got) == 9 and {(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in got} == {(1, 0, 0.0, 0.0, 0.0)}
    line = spark.createDataFrame([(i, [float(i), 2.0 * i, 1.0]) for i in range(5)], "vec_id long, embedding array<double>")
    got = {(r.vec_id, r.component): r for r in whitening.whiten(line).collect()}
    assert abs(got[0, 1].whitened) > 1 and got[0, 2].whitened == got[0, 3].whitened == 0.0 and abs(got[0, 1].explained - 1) < 1e-12 and got[0, 1].identity_error < 1e-12


def test_large_components(spark):
    df = spark.createDataFrame([(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [1e12, 5.0])], "vec_id long, embedding array<double>")
    assert {r.deviation for r in whitening.whiten(df).where("component = 1").collect()} == {whitening.END}
    edge = [[0, 3037000499], [3, 1518500249], [-5, 2**31]]
    x = np.array(edge)
    want = [min(2**63 - 1, sum((3 * c - t) ** 2 for c, t in zip(row, x.sum(0).tolist(), strict=True))) for row in edge]
    assert whitening.deviations(x, 3, x.sum(0).tolist()).tolist() == want
