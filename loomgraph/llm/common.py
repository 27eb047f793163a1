"""Shared helpers of the training-data operators: tables, the shared folder, Arrow text chunks, fingerprints."""

from __future__ import annotations

import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one numpy pass works on; temporaries take some 100 bytes for each.
CHUNK_BYTES = 1 << 20
#: Bytes of text in a bucket of documents, which one task holds at once.
BUCKET_BYTES = 4 << 20
#: What a row takes beside its text.
ROW_BYTES = 100


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir; where that is unset, a temporary folder, in one process only (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="loomgraph-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base}/loomgraph-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written once as Parquet in the shared folder and read again: cuts lineage and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def width(spark: SparkSession) -> int:
    """The number of shuffle partitions the session asks for; buckets are multiples of it."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def text_col(df: DataFrame, name: str = "text"):
    """The column as a string, null as the empty text."""
    return F.coalesce(df[name].cast("string"), F.lit(""))


def raw(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary array without nulls; offsets has one entry more than rows."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
        if isinstance(arr, pa.ChunkedArray):
            arr = pa.concat_arrays(arr.chunks) if arr.num_chunks else pa.array([], pa.binary())
    if arr.null_count:
        arr = pc.fill_null(arr, "" if pa.types.is_string(arr.type) or pa.types.is_large_string(arr.type) else b"")
    big = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
    _, off, data = arr.buffers()
    if not len(arr) or off is None:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(off, np.int64 if big else np.int32)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, off - off[0]


def spans(offsets: np.ndarray, limit: int = CHUNK_BYTES, rows: int = 50_000):
    """(first row, last row + 1) of consecutive chunks of at most so many bytes and rows; a longer row is a chunk of its own."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        hi = min(hi, n, lo + rows)
        yield lo, hi
        lo = hi


def ragged(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Indices starts[0], starts[0]+1, ... (lens[0] of them), then those of the next, and so on."""
    total = int(lens.sum())
    before = np.cumsum(lens) - lens
    return np.repeat(starts - before, lens) + np.arange(total, dtype=np.int64)


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values; a bijection."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h


class Fingerprints:
    """Polynomial fingerprints (mod 2^64, random byte values) of any byte ranges of a buffer, by prefix sums."""

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        self.values = rng.integers(0, 1 << 64, 256, np.uint64)
        self.base = int(rng.integers(1 << 61, 1 << 62)) * 8 + 5
        self.inverse = pow(self.base, -1, 1 << 64)
        self.power = self.back = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.power) < n:
            n = max(n, 1 << 16)
            for name, base in (("power", self.base), ("back", self.inverse)):
                out = np.ones(n, np.uint64)
                done = 1
                while done < n:  # doubling: out[done + i] = out[i] * base ** done
                    more = min(done, n - done)
                    out[done : done + more] = out[:more] * np.uint64(pow(base, done, 1 << 64))
                    done += more
                setattr(self, name, out)

    def prefix(self, data: np.ndarray) -> np.ndarray:
        self._grow(len(data) + 1)
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.values[data] * self.power[: len(data)], out=out[1:])
        return out

    def of(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((prefix[end] - prefix[start]) * self.back[start])

    def grams(self, prefix: np.ndarray, k: int) -> np.ndarray:
        """Those of all ranges of k bytes."""
        n = len(prefix) - k
        return mix((prefix[k:] - prefix[:n]) * self.back[:n]) if n > 0 else np.zeros(0, np.uint64)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """The least of each w neighbours."""
    size = 1
    while 2 * size <= w:
        x, size = np.minimum(x[:-size], x[size:]), 2 * size
    return np.minimum(x[: len(x) - (w - size)], x[w - size :]) if size < w else x


def bucket_of(ids: np.ndarray, buckets: int) -> np.ndarray:
    """bucket_col() in numpy."""
    return (ids ^ (ids >> 17)) % buckets


def bucket_col(name: str, buckets: int):
    """A bucket for an integer id; null counts as 0."""
    c = F.coalesce(F.col(name).cast("long"), F.lit(0))
    return F.pmod(c.bitwiseXOR(F.shiftright(c, 17)), F.lit(buckets)).cast("int")


def buckets_for(docs: DataFrame, size: int = BUCKET_BYTES, rest=()) -> int:
    """Buckets of some `size` bytes each, at least one for each partition that the session asks for; odd.

    A row counts as its text, ROW_BYTES, and its strings among the columns rest, which go along with it.
    """
    strings = [F.coalesce(F.octet_length(F.col(c)), F.lit(0)) for c in rest]
    total = docs.agg(F.sum(sum(strings, F.octet_length("text") + ROW_BYTES).cast("long"))).first()[0] or 0
    return max(width(docs.sparkSession), -(-total // size)) | 1


def pack_columns(*cols: np.ndarray, widths: tuple[int, ...]) -> bytes:
    """Integers as so many bytes each, byte planes apart, compressed."""
    import zstandard

    out = [np.int64(len(cols[0])).tobytes()]
    for c, w in zip(cols, widths, strict=True):
        out.append(np.ascontiguousarray(c.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :w].T).tobytes())
    return zstandard.ZstdCompressor(level=1).compress(b"".join(out))


def unpack_columns(blob: bytes, widths: tuple[int, ...]) -> list[np.ndarray]:
    """What pack_columns() was given, as unsigned integers."""
    import zstandard

    text = zstandard.ZstdDecompressor().decompress(blob)
    n, at, out = int(np.frombuffer(text, np.int64, 1)[0]), 8, []
    for w in widths:
        wide = np.zeros((n, 8), np.uint8)
        wide[:, :w] = np.frombuffer(text, np.uint8, n * w, at).reshape(w, n).T
        out.append(wide.view("<u8").ravel())
        at += n * w
    return out
