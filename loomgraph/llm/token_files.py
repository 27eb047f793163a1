"""Operator 13: token ids in binary files, with Elias-Fano coded document boundaries.

Documents are dealt out by ranges of doc_id and sorted, so that the files in order hold all ids in ascending doc_id
order. A task tokenizes its range in a stream and writes a file whenever `file_bytes` of ids have come together, so it
holds one file at most. A file is

    magic, bytes for each id, number of ids, documents, documents without an id, least doc_id
    boundaries: the place of each document's first id and of the end, Elias-Fano
    doc_ids: each less the least, Elias-Fano
    the ids, little-endian, one after the other

so a loader finds document i by two select operations, without a table of offsets (TokenFile.document). Files are
named anew by each attempt of a task, and a manifest, which Spark commits, lists those that count: a task that is
lost and run again leaves nothing that is read. Files go to a folder by pyarrow's file systems (local or shared
paths, HDFS, object stores).

Null and empty texts have the end id alone. Documents of equal doc_id stand in the order of a hash and then of their
texts; those without one come last, in that order too. Long texts are one row; a file holds whole documents. An empty
table gives no file and no rows. Other columns of any name are not read.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import raw, shared_dir, spans, text_col, width, written
from .elias_fano import EliasFano
from .packing import tokenizer_path, tokens
from .pretoken import word_starts

MAGIC = b"LGTOKEN1"
HEAD = struct.Struct("<8sBQQQq")
FILE_BYTES, FILE_DOCS = 32 << 20, 1 << 20
MANIFEST = "part int, before long, file string, docs long, ids long"
ROWS = "doc_id long, start long, n_tokens long, ids_crc32 long"


def encode_file(doc_ids: list, sizes: np.ndarray, ids: np.ndarray) -> bytes:
    """doc_ids not falling, those that are null last; sizes: ids of each document; ids: of all."""
    known = np.array([d for d in doc_ids if d is not None], np.int64)
    least = int(known[0]) if len(known) else 0
    bounds = EliasFano.of(np.append(0, np.cumsum(sizes)))
    gaps = EliasFano.of(known.astype(np.uint64) - np.uint64(least & 0xFFFFFFFFFFFFFFFF))
    head = HEAD.pack(MAGIC, ids.dtype.itemsize, len(ids), len(doc_ids), len(doc_ids) - len(known), least)
    return head + bounds.dump() + gaps.dump() + ids.tobytes()


class TokenFile:
    """A file's content, read in place."""

    def __init__(self, data: bytes):
        magic, size, n, self.docs, self.nulls, self.least = HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("this is no token file")
        self.bounds, at = EliasFano.load(data, HEAD.size)
        self.gaps, at = EliasFano.load(data, at)
        self.ids = np.frombuffer(data, f"<u{size}", n, at)

    def doc_ids(self) -> list:
        known = self.gaps.get(np.arange(self.docs - self.nulls)) + np.uint64(self.least & 0xFFFFFFFFFFFFFFFF)
        return known.view(np.int64).tolist() + [None] * self.nulls

    def starts(self) -> np.ndarray:
        """The place of each document's first id, and the end."""
        return self.bounds.get(np.arange(self.docs + 1)).astype(np.int64)

    def document(self, i: int) -> np.ndarray:
        a, b = self.bounds.get(np.array([i, i + 1])).tolist()
        return self.ids[a:b]


def opened(uri: str):
    """(file system, path) of a folder or file."""
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def write(docs: DataFrame, folder: str, path: str, end_id: int = 2, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes docs to token files below a folder; returns the manifest: part, ids before the file in it, file, docs, ids."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_col(docs).alias("text")).withColumn("tie", F.xxhash64("text"))
    order = [F.col("doc_id").asc_nulls_last(), F.col("tie").asc()]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order, "text").select("doc_id", "text")

    def run(batches):
        own, part, before, fs, base = tokens(path, word_starts), TaskContext.get().partitionId(), 0, *opened(folder)
        fs.create_dir(base, recursive=True)
        held, size = ([], [], []), 0

        def flush():
            sizes, name = np.array(held[1], np.int64), f"{uuid.uuid4().hex}.tokens"
            with fs.open_output_stream(f"{base}/{name}") as f:
                f.write(encode_file(held[0], sizes, np.concatenate(held[2])))
            return pa.record_batch([pa.array([part], pa.int32()), pa.array([before]), pa.array([name]), pa.array([len(sizes)]), pa.array([int(sizes.sum())])], ["part", "before", "file", "docs", "ids"])

        for b in batches:
            data, off = raw(b.column("text"))
            names = b.column("doc_id").to_pylist()
            for lo, hi in spans(off):
                base_at = off[lo]
                for name, x in zip(names[lo:hi], own.ids(data[base_at : off[hi]], off[lo : hi + 1] - base_at), strict=True):
                    x = np.append(x, np.uint32(end_id)).astype(own.dtype)
                    if held[0] and (size + x.nbytes > file_bytes or len(held[0]) == FILE_DOCS):
                        yield flush()
                        before += sum(held[1])
                        held, size = ([], [], []), 0
                    held[0].append(name)
                    held[1].append(len(x))
                    held[2].append(x)
                    size += x.nbytes
        if held[0]:
            yield flush()

    return written(rows.mapInArrow(run, MANIFEST), "manifest")


def read(manifest: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document of the files, as they are in them."""
    spark = manifest.sparkSession
    totals = manifest.groupBy("part").agg(F.sum("ids").alias("ids")).orderBy("part").collect()  # a row for each partition that wrote
    base = np.zeros(1 + max([r.part for r in totals], default=0), np.int64)
    done = 0
    for r in totals:
        base[r.part], done = done, done + r.ids
    shared = spark.sparkContext.broadcast(base)

    def run(batches):
        fs, at = opened(folder)
        for b in batches:
            for part, before, name in zip(*(b.column(c).to_pylist() for c in ("part", "before", "file")), strict=True):
                with fs.open_input_stream(f"{at}/{name}") as f:
                    own = TokenFile(f.read())
                starts, ids = own.starts(), own.ids.astype("<u4")
                crc = [zlib.crc32(ids[a:z]) for a, z in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)]
                yield pa.record_batch([pa.array(own.doc_ids(), pa.int64()), pa.array(shared.value[part] + before + starts[:-1]), pa.array(np.diff(starts)), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return manifest.select("part", "before", "file").repartition(width(spark), "file").mapInArrow(run, ROWS)


def write_and_read(docs: DataFrame, folder: str | None = None, path: str | None = None, end_id: int = 2, file_bytes: int = FILE_BYTES) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 from files written to a folder (a new one in the shared folder unless named)."""
    folder = folder or f"{shared_dir(docs.sparkSession)}/files"
    return read(write(docs, folder, path or tokenizer_path("word_bpe_49k.json"), end_id, file_bytes), folder)
