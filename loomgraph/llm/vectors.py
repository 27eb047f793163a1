"""Vectors of a table as integers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Components are cut to this, so that doubles hold them exactly.
MOST = 1 << 53


def integers(vectors: DataFrame, scale: int, *keep: str) -> tuple[DataFrame, int, int]:
    """(vec_id, kept columns, x: array of floor(scale * component)) of the usable rows, the vectors' length (0: no rows) and how many there are at most.

    A row is usable if its vector is neither null nor empty, holds no null and no value that isn't finite, and is as long
    as that of the least vec_id (rows without one come after all others; the shorter of two).
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), *keep, F.col("embedding").cast("array<double>").alias("x"))
    rows = rows.where(F.col("x").isNotNull() & (F.size("x") > 0) & ~F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))))
    rows = rows.withColumn("x", F.transform("x", lambda v: F.floor(F.greatest(F.least(v * scale, F.lit(float(MOST))), F.lit(-float(MOST))))))
    got = rows.agg(F.min_by(F.size("x"), F.struct(F.col("vec_id").isNull().alias("last"), "vec_id", F.size("x").alias("size"))).alias("size"), F.count("*").alias("n")).first()
    return rows.where(F.size("x") == (got["size"] or 0)), got["size"] or 0, got.n


def matrix(column, size: int) -> np.ndarray:
    """An Arrow column of lists of one length as rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), size)
