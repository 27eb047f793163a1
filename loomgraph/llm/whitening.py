"""Operator 12: whitening of vectors through a bidiagonal qd solver.

The fit list is each distinct vector x = floor(256 * c) once: a distinct() that drops repeats before its shuffle. One
pass sums its components; a second centres the rows in blocks and reduces each task's blocks to one triangle R by QR.
Triangles meet in a tree, `fan` at a time, so that no task holds more than a few MB whatever the number of rows. The
last R, whose size is that of the covariance, is solved on the driver: Householder reflections make it bidiagonal, dqds
finds its singular values to nearly full accuracy, twisted factorisations give the directions. All rows are then
projected where they lie.

Rows that integers() finds unusable take no part, nor do other columns of any name; repeated rows and ids have rows
each, a null vec_id stays null. Components are cut to 2^53. Vectors of fewer than 4 components have as many rows. A
direction in which the vectors don't vary (up to rounding) has whitened and explained 0 and doesn't count in
identity_error, which is 0 if there is no other. A deviation beyond 64 bits counts as their end. Signs are such that a
direction's largest entry is positive (the first of equal ones). An empty table has no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bidiagonal import EPS, leading
from .common import written
from .vectors import integers, matrix

ROWS = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
#: Bytes of triangles that meet in one task.
TRIANGLE_BYTES = 64 << 20
END = np.iinfo(np.int64).max


def sums(fit: DataFrame, size: int) -> tuple[int, list[int]]:
    """(rows, sum of each component); a task sends one row for each component."""

    def run(batches):
        n, high, low = 0, np.zeros(size, np.int64), np.zeros(size, np.int64)
        for b in batches:
            x = matrix(b.column("x"), size).astype(np.int64)
            n, high, low = n + len(x), high + (x >> 26).sum(0), low + (x & ((1 << 26) - 1)).sum(0)
        yield pa.record_batch([pa.array(np.arange(size)), pa.array(np.full(size, n)), pa.array(high), pa.array(low)], ["at", "n", "high", "low"])

    got = fit.mapInArrow(run, "at long, n long, high long, low long").groupBy("at").agg(*[F.sum(c).alias(c) for c in ("n", "high", "low")]).orderBy("at").collect()  # a row for each component
    return (got[0].n if got else 0), [(r.high << 26) + r.low for r in got]


def triangle(fit: DataFrame, size: int, mean: np.ndarray) -> np.ndarray:
    """R of the centred rows' QR factorisation."""

    def reduced(a: np.ndarray) -> np.ndarray:
        out = np.zeros((size, size))
        r = np.linalg.qr(a, mode="r")
        out[: len(r)] = r
        return out

    def row(at: int, r: np.ndarray):
        return pa.table({"at": pa.array([at], pa.int64()), "r": pa.array([r.tobytes()], pa.binary())})

    def run(batches):
        r, some = np.zeros((size, size)), False
        step = max(4 * size, 4096)
        for b in batches:
            x = matrix(b.column("x"), size)
            for lo in range(0, len(x), step):
                r, some = reduced(np.vstack([r, x[lo : lo + step] - mean])), True
        if some:
            yield from row(TaskContext.get().partitionId(), r).to_batches()

    fan = max(2, TRIANGLE_BYTES // (8 * size * size))

    def meet(key, t):
        r = np.zeros((size, size))
        for other in t.sort_by("at")["r"].to_pylist():
            r = reduced(np.vstack([r, np.frombuffer(other).reshape(size, size)]))
        return row(key[0].as_py(), r)

    level = written(fit.mapInArrow(run, "at long, r binary"), "triangles")
    while level.count() > 1:
        level = written(level.groupBy(F.floor(F.col("at") / fan).alias("of")).applyInArrow(meet, "at long, r binary"), "triangles")
    return np.frombuffer(level.first().r).reshape(size, size)


def deviations(x: np.ndarray, n: int, total: list[int]) -> np.ndarray:
    """Sums of (n * x - S)^2, exact; those beyond 64 bits are cut to their end."""
    rough = ((x * float(n) - np.array(total, float)) ** 2).sum(1)
    with np.errstate(over="ignore"):  # 64-bit arithmetic wraps, which leaves differences right
        away = x * np.int64(n) - np.array([(t + (1 << 63)) % (1 << 64) - (1 << 63) for t in total], np.int64)
        out = (away * away).sum(1)
    out[rough > 2.0**62] = END
    for i in np.flatnonzero((rough > 2.0**62) & (rough < 2.0**64)):
        out[i] = min(END, sum((n * int(v) - t) ** 2 for v, t in zip(x[i].tolist(), total, strict=True)))
    return out


def whiten(vectors: DataFrame, scale: int = 256, components: int = 4) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: the leading components of every usable row."""
    spark = vectors.sparkSession
    rows, size, _ = integers(vectors, scale)
    if not size:
        return spark.createDataFrame([], ROWS)
    most = rows.agg(F.max(F.array_max(F.transform("x", F.abs))).alias("m")).first().m
    fit = written(rows.select(F.col("x").cast("array<int>") if most < 1 << 31 else "x").distinct(), "fit")
    n, total = sums(fit, size)
    mean = np.array([t / n for t in total])
    square, directions = leading(triangle(fit, size, mean), min(components, size))
    value = np.where(square <= (8 * size * EPS) ** 2 * square[0], 0.0, square)[: directions.shape[1]] / n
    explained = value / max(square.sum() / n, np.finfo(float).tiny)
    directions = directions * np.sign(directions[np.abs(directions).argmax(0), np.arange(directions.shape[1])])
    project = np.divide(directions, np.sqrt(value), out=np.zeros_like(directions), where=value > 0)

    def fitted(batches):
        for b in batches:
            yield pa.record_batch(list(((matrix(b.column("x"), size) - mean) @ project).T), [f"w{i}" for i in range(len(value))])

    live = np.flatnonzero(value > 0).tolist()
    pairs = [(i, j) for i in live for j in live if i <= j]
    white = fit.mapInArrow(fitted, ", ".join(f"w{i} double" for i in range(len(value))))
    found = white.agg(F.lit(0.0), *[F.covar_pop(f"w{i}", f"w{j}") for i, j in pairs]).first()
    error = float(max((abs(c - (i == j)) for c, (i, j) in zip(found[1:], pairs, strict=True)), default=0.0))

    def projected(batches):
        k = len(value)
        for b in batches:
            x = matrix(b.column("x"), size).astype(np.int64)
            row = np.repeat(np.arange(len(x)), k)
            cols = [b.column("vec_id").take(pa.array(row)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(len(row), n)), pa.array(deviations(x, n, total)[row])]
            yield pa.record_batch([*cols, pa.array(((x - mean) @ project).ravel()), pa.array(np.tile(explained, len(x))), pa.array(np.full(len(row), error))], [c.split()[0] for c in ROWS.split(", ")])

    return rows.mapInArrow(projected, ROWS)
