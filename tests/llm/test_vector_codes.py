"""Vector codes against Lloyd rounds that search everything every time."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.llm import vector_codes

RNG = np.random.default_rng(9)


def plain(rows, parts=4, entries=256, rounds=4, scale=1024):
    """[(vec_id, code, error, label_error, digest)] of (vec_id, vector, label) in the order of vec_id."""
    kept = [(i, [int(np.floor(scale * float(c))) for c in v], g) for i, v, g in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    w = -(-len(kept[0][1]) // parts)
    x = np.array([v + [0] * (w * parts - len(v)) for _, v, _ in kept], object).reshape(len(kept), parts, w)
    books = [[list(map(int, row)) for row in x[:entries, p]] for p in range(parts)]
    near = lambda p: [min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(books[p])) for v in x[:, p].tolist()]
    for _ in range(rounds):
        for p in range(parts):
            got = [j for _, j in near(p)]
            for j in set(got):
                own = [v for v, c in zip(x[:, p].tolist(), got, strict=True) if c == j]
                books[p][j] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    best = [near(p) for p in range(parts)]
    digest = hashlib.sha256(",".join(str(c) for book in books for row in book for c in row).encode()).hexdigest()
    errors = [sum(best[p][i][0] for p in range(parts)) for i in range(len(kept))]
    by = {}
    for (_, _, g), e in zip(kept, errors, strict=True):
        by[g] = by.get(g, 0) + e
    return [(i, "".join(f"{best[p][n][1]:02x}" for p in range(parts)), errors[n], by[g], digest) for n, (i, _, g) in enumerate(kept)]


def frame(spark, rows, kind="double"):
    return spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int")


def got(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(vector_codes, "BLOCK_BYTES", 4 * 8 * 40)  # several blocks
    rows = [(int(i), [float(c) for c in np.round(RNG.normal(size=8), 1)], int(i) % 3 or None) for i in range(500)]
    rows += [(1000 + i, rows[7][1], 1) for i in range(200)]  # a very common vector, and so equal entries
    rows += [(5, rows[9][1], 2), (None, rows[11][1], None), (None, [9.0] * 8, 7)]
    dropped = [(2000, None, 1), (2001, [1.0, None] + [0.0] * 6, 1), (2002, [float("nan")] * 8, 1), (2003, [float("inf")] + [0.0] * 7, None), (2004, [], 1), (2005, [1.0], 1)]
    df = frame(spark, rows + dropped).withColumn("x", F.lit("clash")).withColumn("block", F.lit(1)).withColumn("error", F.lit(1)).repartition(7)
    assert got(vector_codes.encode(df)) == sorted(plain(rows), key=repr)
    assert got(vector_codes.encode(df, entries=300)) != got(vector_codes.encode(df))


@pytest.mark.parametrize(("n", "size"), [(1, 4), (3, 8), (400, 1), (300, 6)])
def test_sizes(spark, n, size):
    rows = [(int(i), [float(c) for c in np.round(RNG.normal(size=size), 2)], None) for i in RNG.permutation(n)]
    assert got(vector_codes.encode(frame(spark, rows))) == sorted(plain(rows), key=repr)


def test_empty(spark):
    assert vector_codes.encode(frame(spark, [])).count() == 0


def test_large_components(spark):
    most = vector_codes.limit(4)
    rows = [(i, [1e300 * (-1) ** i, float(i), 1e6 * i, -1e300], 1) for i in range(300)]
    cut = [(i, [max(-most, min(most, c * 1024)) / 1024 for c in v], g) for i, v, g in rows]
    assert got(vector_codes.encode(frame(spark, rows))) == sorted(plain(cut), key=repr)


def test_active_entries_save_searches():
    x = np.concatenate([RNG.integers(-5, 5, (50, 3)) + 100 * i for i in range(8)])
    book = x[::50].copy()
    code, error, full = vector_codes.assign(x, book, np.ones(8, bool), None, None)
    assert full == len(x)
    moved = np.arange(8) == 3
    book[3] += 1
    again, errors, full = vector_codes.assign(x, book, moved, code, error)
    assert full == (code == 3).sum() == 50
    d = vector_codes.distances(x, book)
    assert (again == d.argmin(1)).all() and (errors == d.min(1)).all()
    big = RNG.integers(-(2**27), 2**27, (5, 16))
    assert (vector_codes.distances(big, big[:2]) == ((big[:, None] - big[None, :2]) ** 2).sum(2)).all()


def test_rounds_shuffle_no_vectors(spark, tmp_path):
    with vector_codes.Tables(spark, 3) as tables:
        a = tables.save(spark.range(100).select(F.col("id").alias("block"), F.lit("x" * 1000).alias("x")))
        b = tables.save(a.select("block"))
        plan = a.join(b.hint("merge"), "block")._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
        names = list(tables.names)
    assert not [n for n in names if spark.catalog.tableExists(n)]
