"""Operator 7: byte-level BPE encoding and decoding by length-bucketed padded numpy matrices.

Texts are split by the tokenizer's pattern (pretoken.py); distinct pieces are encoded once for each worker. Pieces
of like length share a padded matrix of ids, whatever their length. In each round every row looks up the ranks of its
adjacent pairs in an open-addressing hash table, merges its leftmost pair of the least rank, and closes the gap; rows
without a pair that merges leave the matrix. The rounds that would merge the same pair further right in the row are
taken along in one, unless a merge makes a pair of lower rank, which then comes first: that row merges its leftmost
place alone. So a piece takes as many rounds as it merges distinct pairs, not as it has bytes.

Null and empty texts give no ids; a null doc_id stays null; repeated rows give equal values; empty tables give no rows;
other columns of any name are not read. Texts are read whole, some CHUNK_BYTES or one text at a time.
"""

from __future__ import annotations

import base64
import hashlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ragged, raw, spans, text_col
from .pretoken import Pieces

NONE = np.int32(2**31 - 1)
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


class PairTable:
    """Rank by (left id, right id): linear probing in numpy, at most `probes` looks."""

    def __init__(self, ranks: dict[bytes, int]):
        keys, values = [], []
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                if (a := ranks.get(token[:i])) is not None and (b := ranks.get(token[i:])) is not None:
                    keys.append(a << 32 | b)
                    values.append(rank)
        self.bits = max(4, (4 * len(keys)).bit_length())
        self.key, self.rank = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, NONE, np.int32)
        left, rank, self.probes = np.array(keys, np.int64), np.array(values, np.int32), 0
        where = self.slot(left)
        while len(left):  # each round puts in the first of those that want the same free slot
            free = np.flatnonzero(self.key[where] < 0)
            _, one = np.unique(where[free], return_index=True)
            put = free[one]
            self.key[where[put]], self.rank[where[put]] = left[put], rank[put]
            rest = np.ones(len(left), bool)
            rest[put] = False
            left, rank, where = left[rest], rank[rest], (where[rest] + 1) & ((1 << self.bits) - 1)
            self.probes += 1

    def slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) << 32 | right.astype(np.int64)
        out = np.full(key.shape, NONE, np.int32)
        todo = np.flatnonzero((left.ravel() >= 0) & (right.ravel() >= 0))
        flat, key = out.ravel(), key.ravel()
        where = self.slot(key[todo])
        for _ in range(self.probes):
            if not len(todo):
                break
            found = self.key[where]
            hit = found == key[todo]
            flat[todo[hit]] = self.rank[where[hit]]
            go = ~hit & (found >= 0)
            todo, where = todo[go], (where[go] + 1) & ((1 << self.bits) - 1)
        return flat.reshape(out.shape)


class BPE:
    def __init__(self, ranks: dict[bytes, int]):
        self.pairs = PairTable(ranks)
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        size = max(ranks.values()) + 1
        words = [b""] * size
        for token, rank in ranks.items():
            words[rank] = token
        self.length = np.array([len(w) for w in words], np.int64)
        self.start, self.bytes = np.cumsum(self.length) - self.length, np.frombuffer(b"".join(words), np.uint8)

    def matrix(self, rows: np.ndarray, out: list, index: np.ndarray) -> None:
        """Encodes padded rows of byte ids (-1 behind the end) into out[index[i]]."""
        rank = self.pairs.ranks(rows[:, :-1], rows[:, 1:])
        while len(rows):
            best = rank.min(1) if rank.shape[1] else np.full(len(rows), NONE)
            done = best == NONE
            if done.any():
                for i, row in zip(index[done].tolist(), rows[done], strict=True):
                    out[i] = row[row >= 0]
                keep = ~done
                rows, rank, index, best = rows[keep], rank[keep], index[keep], best[keep]
                if not len(rows):
                    return
            i, j = self.places(rows, rank, best)
            rows[i, j] = best[i]
            left = rows >= 0
            left[i, j + 1] = False
            to = np.cumsum(left, 1, dtype=np.int32) - 1  # close the gaps
            used = int(to[:, -1].max()) + 1
            r, c = np.nonzero(left)
            moved, ranks = np.full((len(rows), used), -1, np.int32), np.full((len(rows), used), NONE, np.int32)
            moved[r, to[r, c]] = rows[r, c]
            inner = c < rank.shape[1]
            ranks[r[inner], to[r[inner], c[inner]]] = rank[r[inner], c[inner]]
            rows, rank, at = moved, ranks[:, : used - 1], to[i, j]
            for side in (at - 1, at):  # only the pairs beside a merge change
                ok = (side >= 0) & (side < used - 1)
                rank[i[ok], side[ok]] = self.pairs.ranks(rows[i[ok], side[ok]], rows[i[ok], side[ok] + 1])

    def places(self, rows: np.ndarray, rank: np.ndarray, best: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, place) of the least pairs that merge now: of overlapping ones every other, and one alone where it makes a lower pair."""
        i, j = np.nonzero(rank == best[:, None])
        if len(i) == len(best):
            return i, j  # one in each row
        begin = np.append(True, (i[1:] != i[:-1]) | (j[1:] != j[:-1] + 1))
        run = np.flatnonzero(begin)[np.cumsum(begin) - 1]
        pick = (np.arange(len(i)) - run) % 2 == 0
        i, j = i[pick], j[pick]
        first = np.append(True, i[1:] != i[:-1])
        made = best[i]
        beside = np.append(False, (i[1:] == i[:-1]) & (j[1:] == j[:-1] + 2))
        before = np.where(beside, made, rows[i, np.maximum(j - 1, 0)])
        after = rows[i, np.minimum(j + 2, rows.shape[1] - 1)]
        low = np.where(j > 0, self.pairs.ranks(before, made), NONE)
        low = np.minimum(low, np.where(j + 2 < rows.shape[1], self.pairs.ranks(made, after), NONE))
        alone = np.zeros(len(best), bool)
        alone[i[low < made]] = True
        pick = first | ~alone[i]
        return i[pick], j[pick]

    def encode(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces in order, number of ids of each)."""
        out: list = [None] * len(pieces)
        size = np.array([len(p) for p in pieces], np.int64)
        flat, begin = self.byte[np.frombuffer(b"".join(pieces), np.uint8)], np.cumsum(size) - size
        order, lo = np.argsort(size, kind="stable"), 0
        while lo < len(order):  # buckets: lengths that differ by an eighth at most, up to 2^20 cells
            top = max(int(size[order[lo]] * 1.125), int(size[order[lo]]))
            hi = int(np.searchsorted(size[order], top, "right"))
            hi = min(hi, lo + max(1, (1 << 20) // max(top, 1)))
            index = order[lo:hi]
            cols = np.arange(max(1, int(size[index].max())))
            rows = np.where(cols < size[index, None], flat[np.minimum(begin[index, None] + cols, max(len(flat) - 1, 0))] if len(flat) else -1, -1).astype(np.int32)
            self.matrix(rows, out, index)
            lo = hi
        sizes = np.array([len(x) for x in out], np.int64)
        return (np.concatenate(out) if out else np.zeros(0, np.int32)), sizes

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of ids, one after the other."""
        return self.bytes[ragged(self.start[ids], self.length[ids])]


@cache
def load(path: str) -> BPE:
    with open(path, "rb") as f:
        return BPE({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})


@cache
def pieces(path: str) -> Pieces:
    return Pieces(load(path).encode)


def ranks_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def digests(batch: pa.RecordBatch, path: str):
    bpe, cut = load(path), pieces(path)
    data, off = raw(batch.column("text"))
    counts, ids_hash, text_hash = [], [], []
    for lo, hi in spans(off):
        base = off[lo]
        ids, ends = cut.ids(data[base : off[hi]], off[lo : hi + 1] - base)
        ids32, decoded = ids.astype("<u4"), bpe.decode(ids.astype(np.int64))
        at = np.append(0, np.cumsum(bpe.length[ids.astype(np.int64)]))[ends]
        for i in range(hi - lo):
            counts.append(int(ends[i + 1] - ends[i]))
            ids_hash.append(hashlib.sha256(ids32[ends[i] : ends[i + 1]]).hexdigest())
            text_hash.append(hashlib.sha256(decoded[at[i] : at[i + 1]]).hexdigest())
    return counts, ids_hash, text_hash


def encode_decode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row."""
    path = path or ranks_path()

    def run(batches):
        for b in batches:
            n, i, t = digests(b, path)
            yield pa.record_batch([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(i, pa.string()), pa.array(t, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_col(docs).alias("text")).mapInArrow(run, SCHEMA)


def token_ids(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids array<int> of every row: the operator's plain output."""
    path = path or ranks_path()

    def run(batches):
        for b in batches:
            data, off = raw(b.column("text"))
            for lo, hi in spans(off):
                base = off[lo]
                ids, ends = pieces(path).ids(data[base : off[hi]], off[lo : hi + 1] - base)
                yield pa.record_batch([b.column("doc_id").slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids.astype(np.int32)))], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_col(docs).alias("text")).mapInArrow(run, "doc_id long, ids array<int>")
