"""Operator 8: language ID by the nearest of several centroids per language.

A text's letters, lower-cased, with every other character as a boundary, give its 1- to 3-grams, hashed to DIMS places.
Their TF-IDF vector ((1 + ln tf) * idf, length 1) is compared by cosine with the centroids that spherical k-means finds
for each language; the nearest one's language is the prediction and its cosine the score. A text too far from every
centroid is rejected: its cosine is 0 or, with 2^SHORT n-grams or more, below a quarter of what 95 % of the sample's texts
of like length (in powers of two of their number of n-grams) reach; lengths with fewer than ENOUGH texts in the sample
take the least of the others. Rejection is a column of its own; the prediction stays.

Learning reads a sample: of each language some `per_language` rows, picked by a hash of doc_id and text over all rows,
never more than that in expectation, repeated rows once. Document frequencies and centroids come from that sample; every
row is predicted, from its whole text alone, some ROWS texts or CHUNK_BYTES at a time. Of equally near centroids the
first in the order of the languages' names wins.

Null texts and those without a letter: `und`, score 0, rejected. Without labelled rows every text is `und`. Rows of a
null doc_id are predicted, not learned from. Empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import raw, spans, text_col
from .pretoken import LETTER, classes

DIMS, ROWS = 8192, 256  # places of n-grams; documents in one matrix
PER_LANGUAGE, CENTROIDS, STEPS = 1500, 4, 8
BINS, SHORT, ENOUGH = 24, 6, 30


@cache
def lower() -> np.ndarray:
    """Each letter's lower case if that is one code point; 0 for everything that is no letter."""
    kind = classes()
    out = np.zeros(0x110000, np.uint32)
    for c in np.flatnonzero(kind == LETTER).tolist():
        low = chr(c).lower()
        out[c] = ord(low) if len(low) == 1 else c
    return out


def counts(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Counts of hashed n-grams, documents x DIMS."""
    rows = len(off) - 1
    text = data.tobytes().decode("utf-8", "replace")
    lead = (data & 0xC0) != 0x80
    points = lower()[np.frombuffer(text.encode("utf-32-le"), np.uint32)] if len(text) == int(lead.sum()) else None
    if points is None:  # not UTF-8: bytes above 127 count as boundaries
        points, lead = lower()[np.where(data < 128, data, 0)], np.ones(len(data), bool)
    before = np.append(0, np.cumsum(lead))[off]
    # one boundary between documents, before the first and behind the last
    row = np.repeat(np.arange(rows), np.diff(before))
    c = np.zeros(len(points) + rows + 1, np.uint64)
    at = np.arange(len(points)) + row + 1
    c[at] = points
    full = c[at] > 0
    at, row = at[full], row[full]
    one, two, three = c[at], c[at + 1], np.where(c[at + 1] > 0, c[np.minimum(at + 2, len(c) - 1)], 0).astype(np.uint64)
    prev = c[at - 1]
    start = np.uint64(1) << np.uint64(63)
    grams = [one, one << np.uint64(21) | two | np.uint64(1 << 62), one << np.uint64(42) | two << np.uint64(21) | three | start]
    head = prev == 0
    grams.append((one[head] << np.uint64(21) | two[head]) ^ np.uint64(0x5DEECE66D))
    rowed = [row, row, row, row[head]]
    place = [((g * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 13)).astype(np.int64) for g in grams]
    return np.bincount(np.concatenate(rowed) * DIMS + np.concatenate(place), minlength=rows * DIMS).reshape(rows, DIMS)


def weighed(n: np.ndarray, idf: np.ndarray) -> np.ndarray:
    out = np.zeros(n.shape, np.float32)
    np.log(n, out=out, where=n > 0, dtype=np.float32)
    out += n > 0
    out *= idf
    return out / np.maximum(np.sqrt((out * out).sum(1, keepdims=True)), 1e-12)


def matrices(column):
    data, off = raw(column)
    for lo, hi in spans(off, rows=ROWS):
        yield lo, hi, counts(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])


def k_means(x: np.ndarray, k: int) -> np.ndarray:
    """Spherical k-means from the mean and the rows farthest from what there is."""
    centre = [x.mean(0)]
    near = x @ centre[0]
    for _ in range(min(k, len(x)) - 1):
        centre.append(x[int(near.argmin())])
        near = np.maximum(near, x @ centre[-1])
    c = np.stack(centre)
    for _ in range(STEPS):
        own = (x @ (c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)).T).argmax(1)
        c = np.stack([x[own == j].mean(0) if (own == j).any() else c[j] for j in range(len(c))])
    return (c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)).astype(np.float32)


def length_bin(n: np.ndarray) -> np.ndarray:
    return np.minimum(BINS - 1, np.log2(np.maximum(n, 1)).astype(np.int64))


class Model:
    def __init__(self, idf, names, centroids, floor):
        self.idf, self.names, self.centroids, self.floor = idf, names, centroids, floor

    def predict(self, column):
        """(index of the name or -1, cosine, length bin) of every text."""
        best, score, size = [], [], []
        for _, _, n in matrices(column):
            total = n.sum(1)
            cos = weighed(n, self.idf) @ self.centroids.T if len(self.names) else np.zeros((len(n), 1), np.float32)
            at = cos.argmax(1)
            best.append(np.where((total > 0) & bool(len(self.names)), at, -1))
            score.append(np.clip(cos[np.arange(len(n)), at].astype(float), 0, 1) * (total > 0))
            size.append(length_bin(total))
        return [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (best, score, size)]


def learn(rows: DataFrame, per_language: int = PER_LANGUAGE, k: int = CENTROIDS) -> Model:
    """A model from rows (doc_id, text, lang) with labels."""
    spark = rows.sparkSession
    rows = rows.where("lang is not null and text is not null and doc_id is not null")
    sizes = {r.lang: r["count"] for r in rows.groupBy("lang").count().collect()}  # a row for each language
    scale = 1 << 30
    cut = {lang: min(scale, per_language * scale // n) for lang, n in sizes.items()}
    if not cut:
        return Model(np.ones(DIMS, np.float32), [], np.zeros((0, DIMS), np.float32), np.zeros(BINS))
    limits = spark.createDataFrame(list(cut.items()), "lang string, most long")
    sample = rows.join(F.broadcast(limits), "lang").where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(scale)) < F.col("most")).select("lang", "doc_id", "text").distinct()

    def sparse(batches):
        for b in batches:
            blobs = []
            for _, _, n in matrices(b.column("text")):
                for row in n:
                    i = np.flatnonzero(row)
                    blobs.append(np.concatenate([i, row[i]]).astype("<u4").tobytes())
            yield pa.record_batch([b.column("lang"), b.column("doc_id"), pa.array(blobs, pa.binary())], ["lang", "doc_id", "grams"])

    from .common import written

    grams = written(sample.mapInArrow(sparse, "lang string, doc_id long, grams binary"), "sample")

    def frequencies(batches):
        seen, total = np.zeros(DIMS, np.int64), 0
        for b in batches:
            for g in b.column("grams").to_pylist():
                a = np.frombuffer(g, "<u4")
                seen[a[: len(a) // 2]] += 1
                total += 1
        yield pa.record_batch([pa.array(np.append(np.flatnonzero(seen), DIMS)), pa.array(np.append(seen[seen > 0], total))], ["place", "n"])

    frequency = np.zeros(DIMS + 1)
    for r in grams.select("grams").mapInArrow(frequencies, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).collect():  # DIMS + 1 rows
        frequency[r.place] = r.n
    idf = (np.log((1 + frequency[-1]) / (1 + frequency[:-1])) + 0.1).astype(np.float32)

    def dense(column):
        n = np.zeros((len(column), DIMS), np.float32)
        for i, g in enumerate(column.to_pylist()):
            a = np.frombuffer(g, "<u4")
            n[i, a[: len(a) // 2]] = a[len(a) // 2 :]
        return n

    def centroids(key, t):
        t = t.sort_by("doc_id")
        x = weighed(dense(t["grams"]), idf)
        x = x[(x * x).sum(1) > 0]
        c = k_means(x, k) if len(x) else np.zeros((0, DIMS), np.float32)
        return pa.table({"lang": pa.array([key[0].as_py()] * len(c), pa.string()), "part": pa.array(range(len(c)), pa.int32()), "centroid": pa.array([v.tobytes() for v in c], pa.binary())})

    got = sorted(grams.groupBy("lang").applyInArrow(centroids, "lang string, part int, centroid binary").collect(), key=lambda r: (r.lang, r.part))
    names, centres = [r.lang for r in got], np.array([np.frombuffer(r.centroid, np.float32) for r in got]).reshape(len(got), DIMS)

    def cosines(batches):
        for b in batches:
            for lo in range(0, b.num_rows, ROWS):
                n = dense(b.column("grams").slice(lo, ROWS))
                yield pa.record_batch([pa.array(length_bin(n.sum(1))), pa.array((weighed(n, idf) @ centres.T).max(1).astype(float) if len(names) else np.zeros(len(n)))], ["bin", "cosine"])

    floor = np.full(BINS, np.nan)
    for r in grams.mapInArrow(cosines, "bin long, cosine double").groupBy("bin").agg(F.percentile_approx("cosine", 0.05).alias("low"), F.count("*").alias("n")).collect():  # BINS rows
        if r.bin >= SHORT and r.n >= ENOUGH:
            floor[r.bin] = 0.25 * r.low
    floor = np.where(np.isnan(floor), np.nanmin(floor) if not np.isnan(floor).all() else 0, floor)
    floor[:SHORT] = 0
    return Model(idf, names, centres, floor)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score, rejected, and text as it was; further columns pass through."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for b in batches:
            best, score, size = m.predict(b.column("text"))
            names = np.array([*m.names, "und"], object)
            yield pa.record_batch([b.column("row"), pa.array(names[best], pa.string()), pa.array(score, pa.float64()), pa.array((best < 0) | (score <= m.floor[size]))], ["row", "lang_pred", "score", "rejected"])

    held = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), text_col(docs).alias("text"))
    return held.mapInArrow(run, StructType([held.schema["row"], *StructType.fromDDL("lang_pred string, score double, rejected boolean").fields]))


def held_out(name: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(name).cast("string")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """Learns from the rows that aren't held out; doc_id, held_out, lang_pred, score, rejected of every row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    model = learn(rows.where(~held_out()), per_language)
    out = predict(rows.select("doc_id", "text"), model)
    return out.select("row.doc_id", held_out("row.doc_id").alias("held_out"), "lang_pred", "score", "rejected")
