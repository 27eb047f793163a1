"""Operator 6: exact top-k by inner product, branch and bound over a ball tree in each shard.

Every row belongs to a shard by a hash of its id. A shard builds its ball tree once and stores it: nodes split at the
median along their widest component down to LEAF rows, and keep their mean and radius. A query's score in a node is at
most query . mean + |query| * radius. Queries go down the tree together, level by level; what cannot reach a query's
current k-th score leaves. Leaves are visited best bound first in waves of 1, 2, 4, ... for each query, and each wave
raises the k-th score for the next. The k-th score is shared between shards too: first every query searches its own
shard, and the others start from what that found.

Queries are a stated set (ids divisible by `every`); they travel in blocks of QUERIES. A shard's tree and TOGETHER of
these blocks meet in a cogroup, so that a tree goes along once for as many blocks, and a task holds no more than that. Components are floor(scale * x) as doubles. Floating-point products, with
their error allowed for, only tell what cannot be among the k best; scores are 64-bit integers, and those beyond their
range count as its end. Ties go to the smaller id. A query leaves out its own row; other rows of its id are candidates.

Rows take no part whose id is null, or whose vector is null or holds a null or a value that isn't finite when scaled; vectors of
other lengths than the query's don't meet it. Repeated rows are candidates and queries each. Empty tables give no rows;
other columns of any name are not read.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import width, written

LEAF, QUERIES, SHARD_ROWS, TOGETHER = 64, 1024, 20_000, 32
LOW, HIGH = np.iinfo(np.int64).min, np.iinfo(np.int64).max
FOUND = "row long, query_id long, vec_id long, score long"


class BallTree:
    """Levels of nodes over rows of x; node i of a level has children 2i and 2i + 1 in the next."""

    def __init__(self, x: np.ndarray):
        self.order = np.arange(len(x))
        edges = np.array([0, len(x)])
        self.levels = []
        while True:
            lo, hi = edges[:-1], edges[1:]
            mean = np.stack([x[self.order[a:b]].mean(0) if b > a else np.zeros(x.shape[1]) for a, b in zip(lo.tolist(), hi.tolist(), strict=True)])
            radius = np.array([np.sqrt(((x[self.order[a:b]] - m) ** 2).sum(1).max()) if b > a else -np.inf for a, b, m in zip(lo.tolist(), hi.tolist(), mean, strict=True)])
            self.levels.append((mean, radius))
            if (hi - lo).max(initial=0) <= LEAF:
                self.edges = edges
                return
            cut = []
            for a, b in zip(lo.tolist(), hi.tolist(), strict=True):
                own = self.order[a:b]
                if b - a > 1:
                    axis = int(np.ptp(x[own], axis=0).argmax())
                    self.order[a:b] = own[np.argpartition(x[own, axis], (b - a) // 2)]
                cut += [a, a + (b - a + 1) // 2 if b - a > 1 else b]
            edges = np.array([*cut, len(x)])


class Best:
    """The k best (score, id) of each query so far."""

    def __init__(self, n: int, k: int, floor: np.ndarray):
        self.k, self.score, self.id = k, np.full((n, k), LOW), np.full((n, k), HIGH)
        self.floor = floor

    def least(self) -> np.ndarray:
        return np.maximum(self.score[:, -1], self.floor)

    def add(self, query, score, ids):
        if not len(query):
            return
        touched = np.unique(query)
        query = np.concatenate([query, np.repeat(touched, self.k)])
        score, ids = np.concatenate([score, self.score[touched].ravel()]), np.concatenate([ids, self.id[touched].ravel()])
        order = np.lexsort((ids, ~score, query))  # ~score falls as score grows, in all of its range
        query, score, ids = query[order], score[order], ids[order]
        first = np.searchsorted(query, touched)
        take = first[:, None] + np.arange(self.k)
        self.score[touched], self.id[touched] = score[take], ids[take]


def products(a: np.ndarray, b: np.ndarray, small: bool) -> np.ndarray:
    """The inner products of rows of integers held as doubles, cut to 64 bits; small: nothing comes near that."""
    if small:
        return np.einsum("ij,ij->i", a.astype(np.int64), b.astype(np.int64))
    return np.array([min(max(sum(int(x) * int(y) for x, y in zip(u, v, strict=True)), LOW + 1), HIGH) for u, v in zip(a.tolist(), b.tolist(), strict=True)], np.int64)


def search(tree: BallTree, x: np.ndarray, ids: np.ndarray, rows: np.ndarray, q: np.ndarray, q_rows: np.ndarray, best: Best) -> None:
    """Raises best by the rows x of a tree."""
    norm = np.sqrt((q * q).sum(1))
    far = np.sqrt((x * x).sum(1)).max(initial=0.0)
    slack = 1 + 1e-15 * (x.shape[1] + 4) * norm * far  # error of a product, and of the rounding of a k-th score
    small = x.shape[1] * max(np.abs(x).max(initial=0), 1) * max(np.abs(q).max(initial=0), 1) < 2**62

    def bound(query, node, level):
        mean, radius = level
        b = np.einsum("ij,ij->i", q[query], mean[node]) if len(query) < 4 * len(q) else (q @ mean.T)[query, node]
        b = b + norm[query] * np.where(np.isfinite(radius[node]), radius[node], 0)
        return np.where(np.isfinite(radius[node]), np.maximum(b + 1e-9 * np.abs(b) + 2 * slack[query], LOW), -np.inf)

    query, node = np.arange(len(q)), np.zeros(len(q), np.int64)
    for depth, level in enumerate(tree.levels):
        if depth:
            query, node = np.repeat(query, 2), np.stack([2 * node, 2 * node + 1], 1).ravel()
        upper = bound(query, node, level)
        keep = (upper >= best.least()[query]) & np.isfinite(upper)
        query, node, upper = query[keep], node[keep], upper[keep]
    order = np.lexsort((-upper, query))
    query, node, upper = query[order], node[order], upper[order]
    wave = 1
    while len(query):
        place = np.arange(len(query)) - np.searchsorted(query, query)
        now = place < wave
        got = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)]]
        least = best.least()
        by_leaf = np.argsort(node[now], kind="stable")
        some, leaf = query[now][by_leaf], node[now][by_leaf]
        cut = np.append(np.flatnonzero(np.append(True, leaf[1:] != leaf[:-1])), len(leaf))
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            own, asked = tree.order[tree.edges[leaf[a]] : tree.edges[leaf[a] + 1]], some[a:b]
            i, j = np.nonzero((np.maximum(q[asked] @ x[own].T, LOW) >= least[asked, None] - slack[asked, None]) & (rows[own][None] != q_rows[asked, None]))
            got[0].append(asked[i])
            got[1].append(own[j])
        of, at = (np.concatenate(g) for g in got)
        score = products(q[of], x[at], small)
        pick = score >= least[of]
        best.add(of[pick], score[pick], ids[at[pick]])
        query, node, upper = query[~now], node[~now], upper[~now]
        keep = upper >= best.least()[query]
        query, node, upper, wave = query[keep], node[keep], upper[keep], 2 * wave


def matrix(t: pa.Table) -> np.ndarray:
    return t["vector"].combine_chunks().flatten().to_numpy().reshape(t.num_rows, -1)


def plant(key, t):
    """shard, size, tree: the rows of one shard and length of vectors, with their tree."""
    x = matrix(t)
    held = pickle.dumps((BallTree(x), x, t["vec_id"].to_numpy(), t["row"].to_numpy()), 5)
    return pa.table({"shard": t["shard"].slice(0, 1), "size": t["size"].slice(0, 1), "tree": pa.array([held], pa.binary())})


def gather(key, t):
    """shard, block, size, asked: queries of one length as one row."""
    t = t.sort_by("row")
    held = pickle.dumps((matrix(t), *(t[n].to_numpy() for n in ("row", "vec_id", "shard", "least"))), 5)
    return pa.table({"shard": t["shard"].slice(0, 1), "block": t["block"].slice(0, 1), "size": t["size"].slice(0, 1), "asked": pa.array([held], pa.binary())})


def answers(k: int, own: bool):
    """Searches a tree for blocks of queries: own, those of the tree's shard; else all others."""

    def run(key, trees, asked):
        out = [pa.table([pa.array([], pa.int64())] * 4, ["row", "query_id", "vec_id", "score"])]
        if trees.num_rows:
            tree, x, ids, rows = pickle.loads(trees["tree"][0].as_buffer())
            for block in asked["asked"]:
                q, q_rows, q_ids, shard, least = pickle.loads(block.as_buffer())
                pick = np.flatnonzero((shard == key[0].as_py()) == own)
                best = Best(len(pick), k, least[pick])
                search(tree, x, ids, rows, q[pick], q_rows[pick], best)
                n, j = np.nonzero(best.id != HIGH)
                cols = (q_rows[pick[n]], q_ids[pick[n]], best.id[n, j], best.score[n, j])
                out.append(pa.table([pa.array(c, pa.int64()) for c in cols], ["row", "query_id", "vec_id", "score"]))
        return pa.concat_tables(out)

    return run


def nearest(vectors: DataFrame, every: int = 50, k: int = 5, scale: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows of every row whose id is divisible by `every`."""
    spark, x = vectors.sparkSession, F.col("x")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("x"))
    rows = rows.where("vec_id is not null and x is not null").where(~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v * scale) == float("inf"))))
    rows = written(rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", F.transform(x, lambda v: F.when(F.abs(v * scale) < 2.0**53, F.floor(v * scale).cast("double")).otherwise(v * scale)).alias("vector")), "vectors")
    n = rows.count()
    shards = max(1, min(width(spark), -(-n // LEAF)), -(-n // SHARD_ROWS))
    rows = rows.withColumn("size", F.size("vector")).withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int"))
    trees = written(rows.groupBy("shard", "size").applyInArrow(plant, "shard int, size int, tree binary"), "trees")
    asked = rows.where(F.col("vec_id") % every == 0)
    blocks = max(1, -(-asked.count() // QUERIES))

    def ask(queries, block, own):
        queries = queries.withColumn("block", block)
        packed = queries.groupBy("size", "block", *(["shard"] if own else [])).applyInArrow(gather, "shard int, block int, size int, asked binary")
        if not own:
            packed = packed.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
        packed = packed.withColumn("chunk", F.floor(F.col("block") / TOGETHER).cast("int"))
        planted = trees.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit((-(-blocks // shards) if own else blocks) // TOGETHER))))
        return planted.groupBy("shard", "size", "chunk").cogroup(packed.groupBy("shard", "size", "chunk")).applyInArrow(answers(k, own), FOUND)

    first = written(ask(asked.withColumn("least", F.lit(int(LOW))), F.pmod(F.xxhash64("row"), F.lit(-(-blocks // shards))).cast("int"), True), "own")
    least = first.groupBy("row").agg(F.min("score").alias("low"), F.count("*").alias("n")).select("row", F.when(F.col("n") == k, F.col("low")).alias("low"))
    others = asked.join(least, "row", "left").withColumn("least", F.coalesce("low", F.lit(int(LOW))))
    found = first.unionByName(ask(others, F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int"), False))
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v))
SELECT query_id, rank, vec_id, score FROM (SELECT query_id, vec_id, score, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank FROM s) WHERE rank <= 5
"""
