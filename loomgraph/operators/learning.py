"""Gradient-boosted regression trees for re-ranking: grown by one aggregation a level, scored by one expression."""

from __future__ import annotations

import json
from bisect import bisect_left
from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.store import cut

#: Values of a feature that are told apart while trees grow, and thresholds tried for a feature in a node.
BINS, CUTS = 256, 10


class Trees:
    """base: log-odds; trees: nested [feature, threshold, left, right] or a leaf's value; left is at most the threshold."""

    def __init__(self, base: float = 0.0, rate: float = 0.1, trees: list | None = None):
        self.base, self.rate, self.trees = base, rate, trees or []

    def dumps(self) -> str:
        return json.dumps({"base": self.base, "rate": self.rate, "trees": self.trees})

    @classmethod
    def loads(cls, text: str) -> Trees:
        return cls(**json.loads(text))

    def odds(self) -> Column:
        """The score in log-odds as one expression of the feature columns; a null feature counts as 0."""
        total = F.lit(float(self.base))
        for tree in self.trees:
            total = total + self.rate * expression(tree)
        return total

    def score(self) -> Column:
        return 1 / (1 + F.exp(-self.odds()))

    def rerank(self, rows: DataFrame, group: str, key: str) -> DataFrame:
        """rows with their score and their rank by it in a group; equal scores in the order of the key."""
        from .retrieval import top

        return top(rows.withColumn("score", self.score()), group, [F.desc("score"), key], 1 << 30)

    def sql(self) -> str:
        return f"1 / (1 + exp(-({self.base!r}{''.join(f' + {self.rate!r} * ({tree_sql(t)})' for t in self.trees)})))"

    @classmethod
    def fit(cls, rows: DataFrame, features: list[str], label: str, depth: int = 3, rounds: int = 20, rate: float = 0.1) -> Trees:
        """Fits each tree to the residuals of those before it.

        A feature's values are told apart in BINS classes by quantiles over all rows (exactly, if it has fewer values). A
        level of a tree is one aggregation of counts and residuals by node, feature and class; its size depends on these
        parameters alone. In each node, thresholds lie halfway between neighbours at CUTS quantiles of the node's rows.
        """
        values = F.array(*[F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features])
        data = cut(rows.select(values.alias("x"), F.col(label).cast("double").alias("y")))
        shares = [i / BINS for i in range(1, BINS)] + [1.0]
        stat = data.agg(F.count(F.when(F.col("y") > 0.5, 1)).alias("good"), F.count("*").alias("n"), *[F.percentile_approx(F.col("x")[i], shares, 100_000).alias(f"q{i}") for i in range(len(features))]).first()
        good, bad = stat.good, stat.n - stat.good
        model = cls(log(good / bad) if good and bad else 0.0, rate)
        if not stat.n:
            return model
        edges = [sorted(set(stat[f"q{i}"])) for i in range(len(features))]
        classes = F.array(*[class_of(F.col("x")[i], e) for i, e in enumerate(edges)])
        data = cut(data.select(classes.alias("x"), "y", F.lit(model.base).alias("p")))
        for _ in range(rounds):
            tree = grow(data, edges, depth)
            model.trees.append(named(tree, features, edges))
            data = cut(data.withColumn("p", F.col("p") + rate * in_classes(tree)))
        return model


def class_of(value: Column, edges: list[float]) -> Column:
    """How many edges are below a value."""
    return F.size(F.filter(F.array(*map(F.lit, edges)), lambda edge: edge < value))


def expression(tree) -> Column:
    if not isinstance(tree, list):
        return F.lit(float(tree))
    feature, threshold, left, right = tree
    return F.when(F.coalesce(F.col(feature).cast("double"), F.lit(0.0)) <= threshold, expression(left)).otherwise(expression(right))


def tree_sql(tree) -> str:
    if not isinstance(tree, list):
        return f"{float(tree)!r}::DOUBLE"
    feature, threshold, left, right = tree
    return f"CASE WHEN coalesce({feature}::DOUBLE, 0) <= {threshold!r} THEN {tree_sql(left)} ELSE {tree_sql(right)} END"


def in_classes(tree) -> Column:
    """A tree over classes of features (feature, class, next class, left, right) as an expression of x."""
    if not isinstance(tree, tuple):
        return F.lit(float(tree))
    feature, at, _, left, right = tree
    return F.when(F.col("x")[feature] <= at, in_classes(left)).otherwise(in_classes(right))


def named(tree, features: list[str], edges: list[list[float]]):
    if not isinstance(tree, tuple):
        return tree
    feature, at, after, left, right = tree
    return [features[feature], (edges[feature][at] + edges[feature][after]) / 2, named(left, features, edges), named(right, features, edges)]


def grow(data: DataFrame, edges: list[list[float]], depth: int):
    """A tree over rows (x: classes, y, p: the log-odds so far)."""
    splits: dict[int, tuple | float] = {}  # by node: 1, then 2n and 2n + 1
    level = [1]
    residual = F.col("y") - 1 / (1 + F.exp(-F.col("p")))
    rows = data.select("x", residual.alias("g"))
    for at in range(depth + 1):
        sums = rows.withColumn("node", node_of(splits)).where(F.col("node").isin(level))
        if at == depth:
            for r in sums.groupBy("node").agg(F.avg("g").alias("v")).collect():  # a row for each leaf
                splits[r.node] = r.v
            break
        found = sums.select("node", "g", F.posexplode("x").alias("feature", "class")).groupBy("node", "feature", "class").agg(F.count("*").alias("n"), F.sum("g").alias("g")).collect()  # a row for each node, feature and class
        by: dict[int, dict[int, list]] = {}
        for r in found:
            by.setdefault(r.node, {}).setdefault(r.feature, []).append((r["class"], r.n, r.g))
        after = []
        for node in level:
            own = {f: sorted(c) for f, c in sorted(by.get(node, {}).items())}
            n, total = (sum(c[i] for c in own[0]) for i in (1, 2)) if own else (0, 0.0)
            best = best_split(own, n, total) if n > 1 else None
            splits[node] = best if best else total / n if n else 0.0
            after += [2 * node, 2 * node + 1] if best else []
        level = after
        if not level:
            break

    def built(node):
        here = splits.get(node, 0.0)
        return (*here, built(2 * node), built(2 * node + 1)) if isinstance(here, tuple) else here

    return built(1)


def node_of(splits: dict) -> Column:
    """The node that a row is in, by the splits so far."""

    def below(node):
        here = splits.get(node)
        return F.when(F.col("x")[here[0]] <= here[1], below(2 * node)).otherwise(below(2 * node + 1)) if isinstance(here, tuple) else F.lit(node)

    return below(1)


def best_split(own: dict[int, list[tuple[int, int, float]]], n: int, total: float) -> tuple[int, int, int] | None:
    """(feature, last class on the left, next one) of the least squared error; the first of equals."""
    best, least = None, float("inf")
    for feature, classes in own.items():
        if len(classes) < 2:
            continue
        upto, left_n, left_g = [], 0, 0.0
        for _, m, g in classes:
            left_n, left_g = left_n + m, left_g + g
            upto.append((left_n, left_g))
        tried = set()
        cuts = min(CUTS, n - 1)
        for t in range(1, cuts + 1):
            rank = t * n // (cuts + 1)
            if not 0 < rank < n:
                continue
            i = bisect_left(upto, (rank,))  # the class of the rank-th value
            j = i if upto[i][0] > rank else i + 1  # that of the next one
            if (i, j) in tried or upto[i][0] == n:
                continue
            tried.add((i, j))
            m, g = upto[i]
            error = -(g * g / m + (total - g) ** 2 / (n - m))
            if error < least - 1e-12:
                best, least = (feature, classes[i][0], classes[j][0]), error
    return best

