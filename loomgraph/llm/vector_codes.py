"""Operator 11: vector codes by product quantisation, its codebooks trained by active-entry Lloyd rounds.

Components are integers, so distances and sums are exact and nothing depends on the order of rows. Vectors are packed
once into blocks, dealt out to buckets of a table in the shared folder. A round reads each block beside its state of the
round before (the entry of each part and its exact distance); both tables have the same buckets, so only the state is
written, and nothing is shuffled. In a round

- a part whose entry didn't move keeps its distance, and compares only the entries that did move with it;
- any other part looks through all entries.

In both, ties go to the lower index. A block then tells which entries lost or won parts, by what numbers and sums; these
differences meet in one aggregation, with a row for each component of a codebook, and the driver moves the entries.

Rows that integers() finds unusable take no part, nor do other columns of any name. Vectors whose length is no multiple
of the number of parts count as if they ended in zeros. Components are cut so that a vector's error fits into 64 bits
(2^27 for 64 components). The first entries are those of the least vec_ids, those without one after all others, equal
ones in the order of their vectors; a table of fewer rows has smaller codebooks. Repeated rows count each. Sums beyond
64 bits count as their end. An empty table has no rows.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_dir, width, written
from .vectors import integers, matrix

BLOCK_BYTES, BUCKET_BYTES = 4 << 20, 64 << 20
STATE = "block long, codes binary, errors binary, moves array<struct<slot:int,n:long,sum:array<long>>>"
END = np.iinfo(np.int64).max


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows of x from rows of c."""
    most = int(max(np.abs(x).max(initial=0), np.abs(c).max(initial=0)))
    if x.shape[1] * (2 * most) ** 2 < 1 << 53:  # doubles hold every sum
        a, b = x.astype(float), c.astype(float)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)).astype(np.int64)
    return np.stack([((x - row) ** 2).sum(1) for row in c], 1)


def assign(x: np.ndarray, book: np.ndarray, moved: np.ndarray, code: np.ndarray | None, error: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, int]:
    """The entries and errors of the parts x of one position, and how many looked through all entries.

    code and error: those of the round before, exact for entries that haven't moved.
    """
    if code is None:
        code, error, full = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64), np.ones(len(x), bool)
    else:
        code, error, full = code.astype(np.int64), error.copy(), moved[code]
        active, own = np.flatnonzero(moved), np.flatnonzero(~full)
        if len(active) and len(own):
            d = distances(x[own], book[active])
            best = d.argmin(1)
            entry, d = active[best], d[np.arange(len(own)), best]
            won = (d < error[own]) | (d == error[own]) & (entry < code[own])
            code[own[won]], error[own[won]] = entry[won], d[won]
    own = np.flatnonzero(full)
    if len(own):
        d = distances(x[own], book)
        code[own] = d.argmin(1)
        error[own] = d[np.arange(len(own)), code[own]]
    return code, error, len(own)


def moves(x: np.ndarray, before: np.ndarray | None, after: np.ndarray, slot: int) -> list[tuple[int, int, np.ndarray]]:
    """(slot of an entry, parts it won less those it lost, and their sum) where either isn't nothing."""
    changed = np.arange(len(x)) if before is None else np.flatnonzero(before != after)
    entry, x, sign = after[changed], x[changed], np.ones(len(changed), np.int64)
    if before is not None:
        entry, x, sign = np.append(entry, before[changed]), np.vstack([x, -x]), np.append(sign, -sign)
    if not len(entry):
        return []
    order = np.argsort(entry, kind="stable")
    first = np.flatnonzero(np.append(True, np.diff(entry[order]) != 0))
    return list(zip((slot + entry[order][first]).tolist(), np.add.reduceat(sign[order], first).tolist(), np.add.reduceat(x[order], first), strict=True))


def limit(size: int) -> int:
    """The bound of components for which the squared distance of two vectors fits into 64 bits."""
    return 1 << ((62 - (size - 1).bit_length()) // 2 - 1)


class Tables:
    """Tables of blocks with the same buckets, in the shared folder; they leave the catalog (not the folder) at the end."""

    def __init__(self, spark, buckets: int):
        self.spark, self.buckets, self.folder, self.names = spark, buckets, shared_dir(spark), []

    def __enter__(self):
        return self

    def __exit__(self, *_):
        for name in self.names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")

    def save(self, df: DataFrame) -> DataFrame:
        self.names.append(name := f"loomgraph_{uuid.uuid4().hex}")
        df.write.format("parquet").option("compression", "zstd").option("path", f"{self.folder}/{name}").bucketBy(self.buckets, "block").saveAsTable(name)
        return self.spark.table(name)


def encode(vectors: DataFrame, scale: int = 1024, parts: int = 4, entries: int = 256, rounds: int = 4) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of every usable row of (vec_id, embedding, label)."""
    spark = vectors.sparkSession
    rows, size, n = integers(vectors, scale, "label")
    label = rows.schema["label"].dataType
    wide, most = -(-size // parts) * parts, limit(-(-size // parts) * parts or 1)
    w = wide // parts

    def padded(x: np.ndarray) -> np.ndarray:
        return np.pad(np.clip(x.astype(np.int64), -most, most), ((0, 0), (0, wide - x.shape[1])))

    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(entries).select("x").collect()  # at most `entries` rows
    if not first:
        return spark.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    book = padded(np.array([r.x for r in first], np.int64)).reshape(-1, parts, w).transpose(1, 0, 2)
    k = book.shape[1]
    block_rows = max(1, min(BLOCK_BYTES // (4 * wide), max(256, n // (2 * width(spark)))))

    def pack(batches):
        part, count, held = TaskContext.get().partitionId(), 0, []

        def flush():
            nonlocal count, held
            t = pa.Table.from_batches(held)
            x = padded(matrix(t["x"], size)).astype("<i4").tobytes()
            lists = [pa.ListArray.from_arrays(pa.array([0, t.num_rows], pa.int32()), t[c].combine_chunks() if t[c].num_chunks != 1 else t[c].chunk(0)) for c in ("vec_id", "label")]
            count, held = count + 1, []
            return pa.record_batch([pa.array([(part << 33) + count]), *lists, pa.array([x], pa.binary())], ["block", "ids", "labels", "x"])

        for b in batches:
            lo = 0
            while lo < b.num_rows:
                more = b.slice(lo, block_rows - sum(h.num_rows for h in held))
                held.append(more)
                lo += more.num_rows
                if sum(h.num_rows for h in held) == block_rows:
                    yield flush()
        if held:
            yield flush()

    def step(book, moved, tell):
        def run(batches):
            for b in batches:
                was = "codes" in b.schema.names
                for i in range(b.num_rows):
                    x = np.frombuffer(b.column("x")[i].as_buffer(), "<i4").reshape(-1, parts, w).astype(np.int64)
                    old = np.frombuffer(b.column("codes")[i].as_buffer(), "<u2").reshape(-1, parts) if was else None
                    error = np.frombuffer(b.column("errors")[i].as_buffer(), "<i8").reshape(-1, parts) if was else None
                    codes, errors, told = [], [], []
                    for p in range(parts):
                        own = x[:, p]
                        c, e, _ = assign(own, book[p], moved[p], old[:, p] if was else None, error[:, p] if was else None)
                        codes.append(c)
                        errors.append(e)
                        if tell:
                            told += moves(own, old[:, p].astype(np.int64) if was else None, c, p * k)
                    sums = pa.array([s.tolist() for _, _, s in told], pa.list_(pa.int64()))
                    structs = pa.StructArray.from_arrays([pa.array([s for s, _, _ in told], pa.int32()), pa.array([m for _, m, _ in told], pa.int64()), sums], ["slot", "n", "sum"])
                    out = [np.ascontiguousarray(np.stack(v, 1).astype(t)).tobytes() for v, t in ((codes, "<u2"), (errors, "<i8"))]
                    yield pa.record_batch([b.column("block").slice(i, 1), *[pa.array([o], pa.binary()) for o in out], pa.ListArray.from_arrays(pa.array([0, len(told)], pa.int32()), structs)], ["block", "codes", "errors", "moves"])

        return run

    def unpack(batches):
        for b in batches:
            for i in range(b.num_rows):
                codes = np.frombuffer(b.column("codes")[i].as_buffer(), "<u2").reshape(-1, parts)
                error = np.frombuffer(b.column("errors")[i].as_buffer(), "<i8").reshape(-1, parts).sum(1)
                text = [digits * parts % tuple(c) for c in codes.tolist()]
                yield pa.record_batch([b.column("ids").slice(i, 1).flatten(), b.column("labels").slice(i, 1).flatten(), pa.array(text), pa.array(error)], ["vec_id", "label", "code", "error"])

    digits = f"%0{max(2, len(f'{entries - 1:x}'))}x"
    blocks = f"block long, ids array<long>, labels array<{label.simpleString()}>, x binary"
    with Tables(spark, max(width(spark), -(-4 * n * wide // BUCKET_BYTES))) as tables:
        packed = rows.select("vec_id", "label", "x").mapInArrow(pack, blocks).repartition(tables.buckets, "block")
        packed = tables.save(packed)
        state, moved = None, np.ones((parts, k), bool)
        sums, counts = np.zeros((parts * k, w), np.int64), np.zeros(parts * k, np.int64)
        for r in range(rounds + 1):
            both = packed.select("block", "x")
            both = both.join(state.select("block", "codes", "errors"), "block") if state is not None else both
            state = tables.save(both.mapInArrow(step(book, moved, r < rounds), STATE))
            if r == rounds:
                break
            told = state.select(F.explode("moves").alias("m")).select("m.slot", "m.n", F.posexplode("m.sum").alias("at", "v"))
            for row in told.groupBy("slot", "at").agg(F.sum("v").alias("v"), F.sum("n").alias("n")).collect():  # a row for each component of a codebook
                sums[row.slot, row.at] += row.v
                counts[row.slot] += row.n if row.at == 0 else 0
            after = np.where(counts[:, None] > 0, sums // np.maximum(counts, 1)[:, None], book.reshape(-1, w)).reshape(parts, k, w)
            moved, book = (after != book).any(2), after
        coded = written(packed.select("block", "ids", "labels").join(state.select("block", "codes", "errors"), "block").mapInArrow(unpack, f"vec_id long, label {label.simpleString()}, code string, error long"), "codes")
    total = coded.groupBy("label").agg(F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(END)).cast("long").alias("label_error"))
    total = written(total.withColumnRenamed("label", "of"), "labels")  # so that the join can split a label that is very common
    digest = hashlib.sha256(",".join(map(str, book.ravel().tolist())).encode()).hexdigest()
    return coded.join(total, F.col("label").eqNullSafe(F.col("of")), "left").select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def oracle(parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> str:
    """The same by full searches in every round, for vectors whose length the number of parts divides."""
    ctes = [
        f"""v AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"p AS MATERIALIZED (SELECT r, part, x[(part * (len(x) // {parts}) + 1):((part + 1) * (len(x) // {parts}))] AS x FROM v, range({parts}) t(part))",
        f"c0 AS MATERIALIZED (SELECT part, r - 1 AS entry, x AS c FROM p WHERE r <= {entries})",
    ]
    for i in range(rounds + 1):
        ctes.append(f"a{i} AS MATERIALIZED (SELECT r, part, min({{'d': list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT, 'entry': entry}}) AS best, any_value(x) AS x FROM p JOIN c{i} USING (part) GROUP BY r, part)")
        if i < rounds:
            ctes.append(f"""s{i} AS (SELECT part, entry, list(m ORDER BY pos) AS c FROM (SELECT part, best.entry AS entry, pos, floor(sum(x[pos])::DECIMAL(38,0) / count(*))::BIGINT AS m FROM a{i}, range(1, (SELECT max(len(x)) + 1 FROM p)) t(pos) GROUP BY part, best.entry, pos) GROUP BY part, entry)""")
            ctes.append(f"c{i + 1} AS MATERIALIZED (SELECT c.part, c.entry, coalesce(s.c, c.c) AS c FROM c{i} c LEFT JOIN s{i} s USING (part, entry))")
    return "WITH " + ",\n".join(ctes) + f""",
h AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM c{rounds}),
e AS (SELECT r, string_agg(printf('%02x', best.entry), '' ORDER BY part) AS code, sum(best.d)::BIGINT AS error FROM a{rounds} GROUP BY r)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM e JOIN v USING (r), h"""


ORACLE = oracle()
