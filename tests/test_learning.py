"""Boosted trees against a plain version that sorts every node's values."""

import random
from math import exp, log

import pytest
from pyspark.sql import functions as F

from loomgraph.operators.learning import Trees


def plain_fit(rows, features, depth, rounds, rate):
    """rows: (features..., label)."""
    good = sum(r[-1] > 0.5 for r in rows)
    base = log(good / (len(rows) - good)) if 0 < good < len(rows) else 0.0
    odds, trees = [base] * len(rows), []

    def build(index, g, left):
        leaf = sum(g[i] for i in index) / len(index) if index else 0.0
        if not left or len(index) <= 1:
            return leaf
        total, n, best, least = sum(g[i] for i in index), len(index), None, float("inf")
        for f in range(len(features)):
            values = sorted(rows[i][f] or 0.0 for i in index)
            if values[0] == values[-1]:
                continue
            cuts = min(10, n - 1)
            for t in range(1, cuts + 1):
                k = t * n // (cuts + 1)
                if not 0 < k < n:
                    continue
                at = (values[k - 1] + values[k]) / 2
                low = [i for i in index if (rows[i][f] or 0.0) <= at]
                if len(low) in (0, n):
                    continue
                s = sum(g[i] for i in low)
                error = -(s * s / len(low) + (total - s) ** 2 / (n - len(low)))
                if error < least - 1e-12:
                    best, least = (f, at), error
        if best is None:
            return leaf
        f, at = best
        return [features[f], at, build([i for i in index if (rows[i][f] or 0.0) <= at], g, left - 1), build([i for i in index if (rows[i][f] or 0.0) > at], g, left - 1)]

    def value(tree, r):
        while isinstance(tree, list):
            tree = tree[2] if (r[features.index(tree[0])] or 0.0) <= tree[1] else tree[3]
        return tree

    for _ in range(rounds):
        g = [r[-1] - 1 / (1 + exp(-o)) for r, o in zip(rows, odds, strict=True)]
        trees.append(build(list(range(len(rows))), g, depth))
        odds = [o + rate * value(trees[-1], r) for o, r in zip(odds, rows, strict=True)]
    return base, trees, odds


def flat(tree):
    return [tree[0], tree[1], *flat(tree[2]), *flat(tree[3])] if isinstance(tree, list) else [tree]


@pytest.mark.parametrize("depth", [0, 1, 3])
def test_trees_equal_a_plain_version(spark, depth):
    rng = random.Random(depth)
    rows = []
    for _ in range(300):
        a, b, c = rng.randrange(40) / 40, rng.choice([None, 0.0, 0.25, 1.0]), rng.random() // 0.01 / 100
        rows.append((a, b, c, 7.0, int(a + (b or 0) + rng.random() * 0.4 > 1.0)))
    features = ["a", "b", "c", "same"]
    base, trees, odds = plain_fit(rows, features, depth, 4, 0.5)
    df = spark.createDataFrame(rows, "a double, b double, c double, same double, y int").repartition(5)
    model = Trees.fit(df, features, "y", depth, 4, 0.5)
    assert model.base == pytest.approx(base) and len(model.trees) == 4
    for got, want in zip(model.trees, trees, strict=True):
        assert flat(got) == pytest.approx(flat(want)) if depth == 0 else [type(x) for x in flat(got)] == [type(x) for x in flat(want)]
        assert [x for x in flat(got) if isinstance(x, str)] == [x for x in flat(want) if isinstance(x, str)]
        assert [x for x in flat(got) if isinstance(x, float)] == pytest.approx([x for x in flat(want) if isinstance(x, float)])
    again = Trees.loads(model.dumps())
    got = sorted(r.s for r in df.select(again.odds().alias("s")).collect())
    assert got == pytest.approx(sorted(odds))


def test_edges(spark):
    none = spark.createDataFrame([], "a double, y int")
    assert Trees.fit(none, ["a"], "y").trees == []
    same = spark.createDataFrame([(1.0, 1), (1.0, 1)], "a double, y int")
    model = Trees.fit(same, ["a"], "y", rounds=2)
    assert model.base == 0.0 and all(isinstance(t, float) for t in model.trees)
    ranked = Trees(0.0, 1.0, [["a", 0.5, -1.0, 1.0]]).rerank(spark.createDataFrame([("q", 1, 0.4), ("q", 2, None), ("q", 3, 0.6)], "q string, id long, a double"), "q", "id")
    assert [r.id for r in ranked.orderBy("rank").collect()] == [3, 1, 2]
    assert ranked.where("id = 3").select(F.round("score", 6)).first()[0] == 0.731059
