"""Operator 10: packing by concatenate and cut.

Pass 1 tokenizes each partition in order and writes, for each row, its ids (two bytes each where the vocabulary
allows) with the number of ids that come before it in its partition. The partitions' totals, one row for each
partition, are summed to a prefix, so that every row has its offset in the concatenation of all rows; no row moves.
Pass 2 cuts at the multiples of `length`: one record for each piece. Only the last sequence is not full.

Ids are those of the `tokenizers` library. As it splits texts by the byte-level pattern first, each distinct piece is
given to it once for each worker; texts that hold a special token's string go to it whole.

Null and empty texts give the end id alone; repeated rows are packed each; rows of an empty table give none.
"""

from __future__ import annotations

import os
import zlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import raw, spans, text_col, written
from .pretoken import Pieces, starts

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Tokens:
    """Ids of the `tokenizers` library. split: where texts may be cut so that the ids of the parts are those of the whole."""

    def __init__(self, path: str, split=starts):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values() if t.content]
        self.dtype = "<u2" if self.tokenizer.get_vocab_size(True) <= 1 << 16 else "<u4"
        self.pieces = Pieces(self.encode, split=split)

    def encode(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        got = [e.ids for e in self.tokenizer.encode_batch([p.decode("utf-8", "replace") for p in pieces], add_special_tokens=False)]
        sizes = np.array([len(x) for x in got], np.int64)
        return np.fromiter((i for x in got for i in x), np.uint32, int(sizes.sum())), sizes

    def ids(self, data: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
        ids, ends = self.pieces.ids(data, off)
        out = [ids[ends[i] : ends[i + 1]] for i in range(len(off) - 1)]
        text = data.tobytes()
        if any(s in text for s in self.special):
            for i in range(len(out)):
                if any(s in (own := text[off[i] : off[i + 1]]) for s in self.special):
                    out[i] = np.array(self.tokenizer.encode(own.decode("utf-8", "replace"), add_special_tokens=False).ids, np.uint32)
        return out


@cache
def tokens(path: str, split=starts) -> Tokens:
    return Tokens(path, split)


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def tokenized(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """Pass 1: partition, ids before the row in it, doc_id, n_tokens with the end id, ids."""

    def run(batches):
        own, pid, before = tokens(path), TaskContext.get().partitionId(), 0
        for b in batches:
            data, off = raw(b.column("text"))
            for lo, hi in spans(off):
                base = off[lo]
                ids = [np.append(x, np.uint32(end_id)).astype(own.dtype) for x in own.ids(data[base : off[hi]], off[lo : hi + 1] - base)]
                n = np.array([len(x) for x in ids], np.int64)
                at = before + np.cumsum(n) - n
                before += int(n.sum())
                yield pa.record_batch([pa.array(np.full(hi - lo, pid, np.int32)), pa.array(at), b.column("doc_id").slice(lo, hi - lo), pa.array(n), pa.array([x.tobytes() for x in ids], pa.binary())], ["part", "before", "doc_id", "n_tokens", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_col(docs).alias("text")).mapInArrow(run, "part int, before long, doc_id long, n_tokens long, ids binary")


def pack(docs: DataFrame, path: str | None = None, length: int = 2048, end_id: int = 1, keep_ids: bool = False) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset; with keep_ids its ids as well."""
    path, spark = path or tokenizer_path(), docs.sparkSession
    rows = written(tokenized(docs, path, end_id), "tokens")
    totals = rows.groupBy("part").agg(F.max(F.col("before") + F.col("n_tokens")).alias("total")).orderBy("part").collect()  # a row for each partition
    base = np.zeros(1 + max([r.part for r in totals], default=0), np.int64)
    done = 0
    for r in totals:
        base[r.part], done = done, done + r.total
    shared = spark.sparkContext.broadcast(base)
    dtype = "<u2" if tokens(path).dtype == "<u2" else "<u4"

    def cut(batches):
        base = shared.value
        for b in batches:
            n = b.column("n_tokens").to_numpy()
            at = base[b.column("part").to_numpy()] + b.column("before").to_numpy()
            first, pieces = at // length, (at + n - 1) // length - at // length + 1
            row = np.repeat(np.arange(len(n)), pieces)
            seq = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            start = np.maximum(0, seq * length - at[row])
            end = np.minimum(n[row], (seq + 1) * length - at[row])
            ids, off = raw(b.column("ids"))
            ids, off = ids.view(dtype).astype("<u4"), off // int(dtype[-1])
            lo, hi = (off[row] + start).tolist(), (off[row] + end).tolist()
            crc = [zlib.crc32(ids[a:z]) for a, z in zip(lo, hi, strict=True)]
            out = [b.column("doc_id").take(pa.array(row)), pa.array(start), pa.array(end - start), pa.array(crc, pa.int64()), pa.array(n[row]), pa.array(seq), pa.array((at[row] + start) % length)]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            if keep_ids:
                out, names = [*out, pa.array([ids[a:z].astype(np.int32) for a, z in zip(lo, hi, strict=True)], pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.record_batch(out, names)

    return rows.mapInArrow(cut, PIECE + (", ids array<int>" if keep_ids else ""))
