"""Operator 5: repeated passages by a depth-limited radix sort of suffixes, most significant digit first.

A suffix matters only up to `window` bytes, and only while its group has several documents. One suffix stands for a run
of neighbouring windows that have the same anchor, the `anchor`-byte range in them whose fingerprint is least (the
leftmost of equals); equal windows have equal anchors in equal places.

Pass 1 orders the runs by their most significant digit, the anchor. Runs whose anchor no other document has drop out;
that is most of the text. Only this digit is a fingerprint: equal anchors never part, so no repeat is lost by it.
Pass 2 works on bytes. The runs that are left are dealt out by anchor with all their bytes. Runs of equal bytes need no
further digit: those in later documents are covered. Where an anchor has several ranges of bytes, their windows are
sorted by bytes 0-3, then 4-7, and so on to the last; after each digit the groups of one document drop out. The groups
after the last digit are exactly the repeated windows; the smallest doc_id of a group keeps its copy.
Last, each document removes the bytes of its covered windows.

Every task settles what it can see by itself first: of equal digits or ranges in its rows only that of the smallest
doc_id is dealt out, so a passage that a third of all documents hold costs one record for each task. An anchor with many
runs all the same (more than 256 and 1 / 2^22 of all runs, so there are 2^22 such anchors at most, a broadcast of 32 MB)
is split: its windows are dealt out one by one by their content. Documents move once, to meet what was found about
them, in buckets of BUCKET_BYTES of text, so that a task's memory doesn't grow with the table; longer texts are read in
pieces. Records are packed arrays by bucket.

Null texts count as empty. A null doc_id takes no part: nothing is removed from it or for it. Rows with one doc_id are
one document: they never cover each other. Empty tables give no rows; other columns pass through.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import CHUNK_BYTES, Fingerprints, bucket_col, bucket_of, buckets_for, mix, pack_columns, ragged, raw, sliding_min, spans, text_col, unpack_columns, written

WINDOW, ANCHOR, DIGIT = 50, 24, 4
LOW32, TOP48 = np.uint64(0xFFFFFFFF), np.uint64(16)
HELD, WINDOWS = 500_000, 500_000  # records that a task gathers before it deals them out, and windows that it sorts at once
MANY, HOT_PARTS = 256, 22
# kinds of rows: what documents are told, what is dealt out, and what the driver sums up
COVERED, OPEN, SAME, DEAL, HOT, COUNT = range(6)
# bytes of the columns of each kind; the document comes last
ANCHORS = (6, 4, 1, 8)  # anchor, runs, whether of several documents
WIDTHS = {COVERED: (4, 5, 5, 8), OPEN: (6, 8), SAME: (4, 5, 4, 5, 5, 8), HOT: (6, 8)}
SPANS = (6, 4, 5, 1, 8)  # anchor, row of the document, place, windows
NO_ID = np.iinfo(np.int64).min
ONE = Fingerprints(1)
ROW = "kind int, bucket int, blob binary"


def chunks(data: np.ndarray, off: np.ndarray, window: int):
    """(bytes, offsets, rows, their first bytes' places) of consecutive rows; rows too long for a chunk come in pieces that share window - 1 bytes."""
    for lo, hi in spans(off):
        if off[hi] - off[lo] <= CHUNK_BYTES:
            yield data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], np.arange(lo, hi), np.zeros(hi - lo, np.int64)
        else:
            for at in range(0, int(off[hi] - off[lo]) - window + 1, CHUNK_BYTES):
                text = data[off[lo] + at : min(off[lo] + at + CHUNK_BYTES + window - 1, off[hi])]
                yield text, np.array([0, len(text)]), np.array([lo]), np.array([at])


def runs(data: np.ndarray, off: np.ndarray, window: int, anchor: int):
    """(row, first window, last window, anchor digit) of each run of windows with one anchor, and the prefix sums of the bytes."""
    size = np.diff(off)
    long = np.flatnonzero(size >= window)
    none = np.zeros(0, np.int64)
    if not len(long):
        return none, none, none, none.astype(np.uint64), None
    prefix = ONE.prefix(data)
    gram = ONE.grams(prefix, anchor)
    key = (gram & ~LOW32) | np.arange(len(gram), dtype=np.uint64)
    least = sliding_min(key, window - anchor + 1)
    at = ragged(off[long], size[long] - window + 1)
    place = (least[at] & LOW32).astype(np.int64)
    first = np.flatnonzero(np.append(True, (place[1:] != place[:-1]) | (at[1:] != at[:-1] + 1)))
    start, end = at[first], at[np.append(first[1:], len(at)) - 1]
    return np.searchsorted(off, start, "right") - 1, start, end, gram[place[first]] >> TOP48, prefix


def rows_of(kind: int, to: np.ndarray, cols, widths: tuple[int, ...], extra=None):
    """Rows (kind, bucket, blob); the last column, the document, is stored as differences. extra = (bytes, starts, sizes) goes along."""
    import zstandard

    if not len(to):
        return
    order = np.lexsort((cols[-1], to))
    to, cols = to[order], [np.asarray(c)[order].astype(np.uint64) for c in cols]
    cuts = np.append(np.flatnonzero(np.append(True, to[1:] != to[:-1])), len(to))
    for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        own = [c[lo:hi] for c in cols]
        own[-1] = np.diff(own[-1], prepend=np.uint64(0))
        blob = pack_columns(*own, widths=widths)
        if extra is not None:
            data, start, size = extra
            text = data[ragged(start[order[lo:hi]], size[order[lo:hi]])].tobytes()
            blob = np.int64(len(blob)).tobytes() + blob + zstandard.ZstdCompressor(level=1).compress(text)
        yield kind, int(to[lo]), blob


def opened(blobs, widths: tuple[int, ...]) -> list[np.ndarray]:
    """The columns of all blobs."""
    parts, n = [unpack_columns(x, widths) for x in blobs], len(widths)
    for p in parts:
        p[-1] = np.cumsum(p[-1], dtype=np.uint64)
    cols = [np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, np.uint64) for i in range(n)]
    return [c if k == 0 and widths[0] == 6 else c.astype(np.int64) for k, c in enumerate(cols)]


def as_batch(rows) -> pa.RecordBatch:
    rows = list(rows)
    return pa.record_batch([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], ["kind", "bucket", "blob"])


def own_ids(column) -> np.ndarray:
    return pc.fill_null(column, NO_ID).to_numpy(zero_copy_only=False) if not isinstance(column, pa.ChunkedArray) else pc.fill_null(column, NO_ID).to_numpy()


def ordinals(ids: np.ndarray, data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Numbers the rows of one doc_id in the order of their texts, the same in each task that meets them."""
    out = np.zeros(len(ids), np.int64)
    some, back, count = np.unique(ids, return_inverse=True, return_counts=True)
    if len(some) < len(ids):
        again = np.flatnonzero((count[back] > 1) & (ids != NO_ID)).tolist()
        seen: dict[int, int] = {}
        for i in sorted(again, key=lambda i: data[off[i] : off[i + 1]].tobytes()):
            out[i] = seen.get(int(ids[i]), 0)
            seen[int(ids[i])] = int(out[i]) + 1
    return out


def deal(key: np.ndarray, buckets: int) -> np.ndarray:
    """A bucket by a digit, mixed again: anchors are the least of several fingerprints, so most of them are small."""
    return ((mix(key) >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def first_pass(docs: DataFrame, buckets: int, doc_buckets: int, window: int, anchor: int) -> DataFrame:
    """What documents are told about their anchors (OPEN), anchors of many runs (HOT) and the number of all runs (COUNT)."""

    def flush(parts):
        if not parts:
            return []
        a, doc = (np.concatenate([p[i] for p in parts]) for i in range(2))
        order = np.lexsort((doc, a))
        a, doc = a[order], doc[order]
        head = np.append(True, a[1:] != a[:-1])[: len(a)]
        group, size = np.cumsum(head) - 1, np.diff(np.append(np.flatnonzero(head), len(a)))
        new = head | np.append(True, doc[1:] != doc[:-1])[: len(a)]  # one for each anchor and document
        many = np.bincount(group[new], minlength=len(size)) > 1
        tell = new & many[group]
        return [*rows_of(DEAL, deal(a[head], buckets), [a[head], size, many, doc[head]], ANCHORS), *rows_of(OPEN, bucket_of(doc[tell], doc_buckets), [a[tell], doc[tell]], WIDTHS[OPEN])]

    def emit(batches):
        parts, held = [], 0
        for b in batches:
            data, off = raw(b.column("text"))
            ids = own_ids(b.column("doc_id"))
            for text, o, at, _ in chunks(data, off, window):
                row, _, _, gram, _ = runs(text, o, window, anchor)
                doc = ids[at[row]]
                ok = doc != NO_ID
                parts.append((gram[ok], doc[ok]))
                held += int(ok.sum())
                if held >= HELD:
                    yield as_batch(flush(parts))
                    parts, held = [], 0
        yield as_batch(flush(parts))

    def settle(key, t):
        if key[0].as_py() != DEAL:
            return t.select(["kind", "bucket", "blob"])
        a, n, many, doc = opened(t["blob"].to_pylist(), ANCHORS)
        order = np.lexsort((doc, a))
        a, n, many, doc = a[order], n[order], many[order], doc[order]
        first = np.flatnonzero(np.append(True, a[1:] != a[:-1])[: len(a)])
        group = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(a))))
        last = np.append(first[1:], len(a)) - 1
        several = (np.bincount(group, many, len(first)) > 0) | (doc[first] < doc[last])
        total = np.bincount(group, n, len(first)).astype(np.int64)
        tell, hot = several[group] & (many == 0), several & (total > MANY)
        rows = [*rows_of(OPEN, bucket_of(doc[tell], doc_buckets), [a[tell], doc[tell]], WIDTHS[OPEN]), *rows_of(HOT, np.zeros(int(hot.sum()), np.int64), [a[first][hot], total[hot]], WIDTHS[HOT])]
        return pa.Table.from_batches([as_batch([*rows, (COUNT, 0, str(int(n.sum())).encode())])])

    rows = docs.select("doc_id", "text").mapInArrow(emit, ROW)
    return rows.groupBy("kind", "bucket").applyInArrow(settle, ROW)


def hot_anchors(found: DataFrame) -> np.ndarray:
    """The sorted anchors whose windows are dealt out one by one: 2^HOT_PARTS of them at most."""

    def read(batches):
        for b in batches:
            a, n = opened(b.column("blob").to_pylist(), WIDTHS[HOT])
            yield pa.record_batch([pa.array(a.astype(np.int64)), pa.array(n)], ["anchor", "n"])

    total = found.where(F.col("kind") == COUNT).agg(F.sum(F.col("blob").cast("string").cast("long"))).first()[0] or 0
    rows = found.where(F.col("kind") == HOT).select("blob").mapInArrow(read, "anchor long, n long").where(F.col("n") > max(MANY, total >> HOT_PARTS))
    return np.sort(rows.select("anchor").toArrow()["anchor"].to_numpy().astype(np.uint64))


def lookup(ids: np.ndarray, found: list[np.ndarray]):
    """Tests (row, 48-bit digit) against findings (digit, doc) about the documents ids[row]."""
    known = np.unique(ids)
    digit, doc = found
    at = np.searchsorted(known, doc)
    ok = (at < len(known)) & (known[np.minimum(at, len(known) - 1)] == doc) if len(known) else np.zeros(len(doc), bool)
    table = np.unique(at[ok].astype(np.uint64) << np.uint64(48) | digit[ok])
    slot = np.searchsorted(known, ids).astype(np.uint64) << np.uint64(48)

    def test(row, digit):
        key = slot[row] | digit
        at = np.minimum(np.searchsorted(table, key), max(len(table) - 1, 0))
        return table[at] == key if len(table) else np.zeros(len(key), bool)

    return test


def differ(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the bytes of ranges of equal sizes differ."""
    out = np.zeros(len(a), bool)
    for lo in range(0, len(a), 1 << 14):
        own = slice(lo, lo + (1 << 14))
        unlike = data[ragged(a[own], size[own])] != data[ragged(b[own], size[own])]
        out[own] = np.logical_or.reduceat(unlike, np.cumsum(size[own]) - size[own]) if len(unlike) else False
    return out


class Spans:
    """Byte ranges data[start:start + size] of documents: each of n windows, dealt out by key."""

    def __init__(self, key, print_, doc, ordinal, place, n, data, start, size):
        self.key, self.print, self.doc, self.ordinal, self.place, self.n, self.data, self.start, self.size = key, print_, doc, ordinal, place, n, data, start, size

    def take(self, i) -> Spans:
        return Spans(self.key[i], self.print[i], self.doc[i], self.ordinal[i], self.place[i], self.n[i], self.data, self.start[i], self.size[i])

    def compact(self) -> Spans:
        """With a copy of its own bytes only."""
        data = self.data[ragged(self.start, self.size)]
        return Spans(self.key, self.print, self.doc, self.ordinal, self.place, self.n, data, np.cumsum(self.size) - self.size, self.size)

    def settle(self):
        """(spans without those equal to another of the same or a smaller document, which of all come later, which repeat their own document's, their heads)."""
        order = np.lexsort((self.place, self.ordinal, self.doc, self.print, self.key))
        s = self.take(order)
        head = np.append(True, (s.key[1:] != s.key[:-1]) | (s.print[1:] != s.print[:-1]) | (s.size[1:] != s.size[:-1]))[: len(order)]
        again = np.flatnonzero(~head)
        head[again] = differ(s.data, s.start[again], s.start[again - 1], s.size[again])
        lead = np.flatnonzero(head)[np.cumsum(head) - 1] if len(head) else np.zeros(0, np.int64)
        later = s.doc > s.doc[lead]
        own = ~head & ~later
        return s.take(head), s.take(later), s.take(own), s.take(lead[own])

    @staticmethod
    def joined(parts: list[Spans]) -> Spans:
        shift = np.cumsum([0, *(len(p.data) for p in parts)])
        cols = [np.concatenate([getattr(p, n) for p in parts]) for n in ("key", "print", "doc", "ordinal", "place", "n")]
        return Spans(*cols, np.concatenate([p.data for p in parts]), np.concatenate([p.start + k for p, k in zip(parts, shift, strict=False)]), np.concatenate([p.size for p in parts]))


def told(later: Spans, doc_buckets: int):
    """COVERED rows of spans."""
    return rows_of(COVERED, bucket_of(later.doc, doc_buckets), [later.ordinal, later.place, later.n, later.doc], WIDTHS[COVERED])


def told_same(own: Spans, lead: Spans, doc_buckets: int):
    return rows_of(SAME, bucket_of(own.doc, doc_buckets), [lead.ordinal, lead.place, own.ordinal, own.place, own.n, own.doc], WIDTHS[SAME])


def open_spans(text, o, ids, ordinal, base, known, hot, window, anchor) -> Spans:
    """The open runs of a chunk; those of hot anchors as single windows."""
    row, start, end, key, prefix = runs(text, o, window, anchor)
    pick = lookup(ids, known)(row, key)
    row, start, end, key = row[pick], start[pick], end[pick], key[pick]
    if len(hot):
        split = hot[np.minimum(np.searchsorted(hot, key), len(hot) - 1)] == key
        n = (end - start + 1)[split]
        at = ragged(start[split], n)
        row, start, end, key = np.append(row[~split], np.repeat(row[split], n)), np.append(start[~split], at), np.append(end[~split], at), np.append(key[~split], ONE.of(prefix, at, at + window) >> TOP48 if len(at) else key[:0])
    prints = ONE.of(prefix, start, end + window) if len(row) else key
    return Spans(key, prints, ids[row], ordinal[row], base[row] + start - o[row], end - start + 1, text, start, end - start + window)


def repeated_windows(s: Spans, window: int):
    """(span, window in it) of all windows that a smaller document has too; spans differ from each other and are in the order of their keys."""
    first = np.flatnonzero(np.append(True, s.key[1:] != s.key[:-1])[: len(s.key)])
    size = np.diff(np.append(first, len(s.key)))
    group = np.repeat(np.arange(len(first)), size)
    several = np.flatnonzero((size > 1)[group])  # an anchor of one range has no other windows
    ends = np.append(0, np.cumsum(s.n[several]))
    out, lo = [(np.zeros(0, np.int64),) * 2], 0
    while lo < len(several):  # whole anchors, of some WINDOWS windows at once
        hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + WINDOWS, "right")) - 1)
        hi = int(np.searchsorted(group[several], group[several[hi - 1]], "right"))
        out.append(_repeated(s, several[lo:hi], group[several[lo:hi]], window))
        lo = hi
    return tuple(np.concatenate([o[i] for o in out]) for i in range(2))


def _repeated(s: Spans, span: np.ndarray, group: np.ndarray, window: int):
    """One radix pass for each DIGIT bytes."""
    n = s.n[span]
    group, at, span = np.repeat(group - group[0], n), ragged(s.start[span], n), np.repeat(span, n)
    for depth in range(0, window, DIGIT):
        if not len(at):
            break
        digit = np.zeros(len(at), np.uint64)
        for k in range(depth, min(depth + DIGIT, window)):
            digit = digit << np.uint64(8) | s.data[at + k]
        key = group.astype(np.uint64) << np.uint64(32) | digit
        order = np.argsort(key, kind="stable")
        key, at, span = key[order], at[order], span[order]
        first = np.append(True, key[1:] != key[:-1])
        group, doc, begin = np.cumsum(first) - 1, s.doc[span], np.flatnonzero(first)
        keep = (np.minimum.reduceat(doc, begin) < np.maximum.reduceat(doc, begin))[group]
        group, at, span = group[keep], at[keep], span[keep]
        group = np.cumsum(np.append(True, np.diff(group) != 0)[: len(group)]) - 1
    if len(at):
        doc = s.doc[span]
        later = doc > np.minimum.reduceat(doc, np.flatnonzero(np.append(True, np.diff(group) != 0)))[group]
        at, span = at[later], span[later]
    return span, at - s.start[span]


def second_pass(docs: DataFrame, found: DataFrame, hot: np.ndarray, buckets: int, doc_buckets: int, window: int, anchor: int) -> DataFrame:
    """What documents are told about their windows (COVERED, SAME)."""
    import zstandard

    shared = docs.sparkSession.sparkContext.broadcast(hot.tobytes())

    def emit(left, right):
        known, rows, parts = opened(right["blob"].to_pylist(), WIDTHS[OPEN]), [], []
        if not len(known[0]) or not left.num_rows:
            return pa.Table.from_batches([as_batch([])])
        hot = np.frombuffer(shared.value, np.uint64)
        data, off = raw(left["text"])
        ids = own_ids(left["doc_id"])
        ordinal = ordinals(ids, data, off)
        for text, o, at, base in chunks(data, off, window):
            s, later, own, lead = open_spans(text, o, ids[at], ordinal[at], base, known, hot, window, anchor).settle()
            rows += [*told(later, doc_buckets), *told_same(own, lead, doc_buckets)]
            parts.append(s.compact())
        s, later, own, lead = Spans.joined(parts).settle()
        rows += [*told(later, doc_buckets), *told_same(own, lead, doc_buckets)]
        rows += rows_of(DEAL, deal(s.key, buckets), [s.key, s.ordinal, s.place, s.n, s.doc], SPANS, (s.data, s.start, s.size))
        return pa.Table.from_batches([as_batch(rows)])

    def settle(key, t):
        if key[0].as_py() != DEAL:
            return t.select(["kind", "bucket", "blob"])
        parts = []
        for blob in t["blob"].to_pylist():
            head = int(np.frombuffer(blob, np.int64, 1)[0])
            key, ordinal, place, n, doc = opened([blob[8 : 8 + head]], SPANS)
            data, size = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[8 + head :]), np.uint8), n + window - 1
            start = np.cumsum(size) - size
            prints = np.zeros(len(size), np.uint64)
            for lo, hi in spans(np.append(start, len(data))):
                own = data[start[lo] : start[hi - 1] + size[hi - 1]]
                prints[lo:hi] = ONE.of(ONE.prefix(own), start[lo:hi] - start[lo], start[lo:hi] + size[lo:hi] - start[lo])
            parts.append(Spans(key, prints, doc, ordinal, place, n, data, start, size))
        s, later, _, _ = Spans.joined(parts).settle()
        span, k = repeated_windows(s, window)
        order = np.lexsort((k, span))
        span, k = span[order], k[order]
        first = np.flatnonzero(np.append(True, (span[1:] != span[:-1]) | (k[1:] != k[:-1] + 1))[: len(span)])  # neighbours are told as one
        some = s.take(span[first])
        some.place, some.n = some.place + k[first], np.diff(np.append(first, len(span)))
        return pa.Table.from_batches([as_batch([*told(later, doc_buckets), *told(some, doc_buckets)])])

    rows = docs.groupBy("bucket").cogroup(found.groupBy("bucket")).applyInArrow(emit, ROW)
    return rows.groupBy("kind", "bucket").applyInArrow(settle, ROW)


def covered(ids, ordinal, off, known, same, window) -> np.ndarray:
    """Which bytes of a chunk's rows go."""
    where = np.lexsort((ordinal, ids))
    begin = np.flatnonzero(np.append(True, np.diff(ids[where]) != 0))
    first = ids[where][begin]

    def place(doc, number, at):
        """(positions, which are of documents here)"""
        slot = np.minimum(np.searchsorted(first, doc), len(first) - 1)
        ok = first[slot] == doc
        row = np.minimum(begin[slot] + number - ordinal[where][begin[slot]], len(where) - 1)
        ok &= (row >= begin[slot]) & (ids[where][row] == doc) & (ordinal[where][row] == number)
        return off[where[row]] + at, ok

    window_gone = np.zeros(off[-1] + 1, bool)
    number, at, n, doc = known
    at, ok = place(doc, number, at)
    window_gone[ragged(at[ok], n[ok])] = True
    lead, lead_at, number, at, n, doc = same
    (a, ok_a), (b, ok_b) = place(doc, lead, lead_at), place(doc, number, at)
    ok = ok_a & ok_b
    if ok.any():
        a, b = ragged(a[ok], n[ok]), ragged(b[ok], n[ok])
        for _ in range(2):  # a head of a chunk may itself repeat an earlier chunk's
            window_gone[b[window_gone[a]]] = True
    delta = np.zeros(len(window_gone) + window, np.int8)
    delta[: len(window_gone)] = window_gone
    delta[window:] -= window_gone
    return np.cumsum(delta, dtype=np.int32)[: off[-1]] > 0


def remove_repeats(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, rest=None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (of the remaining bytes); with rest, names of columns, also kept and a struct rest.

    kept is the remaining text without the characters that a cut has split.
    """
    held = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_col(docs).alias("text"), *([F.struct(F.lit(None).cast("int").alias("_"), *[docs[c] for c in rest]).alias("rest")] if rest is not None else []))
    unnamed, held = held.where("doc_id is null"), held.where("doc_id is not null")
    doc_buckets = buckets_for(held, rest=[f"rest.`{c}`" for c in rest or () if docs.schema[c].dataType.simpleString() == "string"])
    buckets = 2 * doc_buckets + 1
    held = held.withColumn("bucket", bucket_col("doc_id", doc_buckets))
    found = written(first_pass(held, buckets, doc_buckets, window, anchor), "anchors")
    windows = second_pass(held, found.where(F.col("kind") == OPEN), hot_anchors(found), buckets, doc_buckets, window, anchor)

    def finish(left, right):
        kinds, blobs = right["kind"].to_pylist(), right["blob"].to_pylist()
        known, same = (opened([x for i, x in zip(kinds, blobs, strict=True) if i == k], WIDTHS[k]) for k in (COVERED, SAME))
        data, off = raw(left["text"])
        ids, kept, counts, hashes = own_ids(left["doc_id"]), [], [], []
        gone = covered(ids, ordinals(ids, data, off), off, known, same, window) if len(ids) else np.zeros(0, bool)
        for i in range(len(ids)):
            mask = gone[off[i] : off[i + 1]]
            out = data[off[i] : off[i + 1]][~mask].tobytes()
            counts.append((len(mask), int(mask.sum()), int(mask[:1].sum() + (mask[1:] & ~mask[:-1]).sum())))
            hashes.append(hashlib.sha256(out).hexdigest())
            if rest is not None:
                kept.append(out.decode("utf-8", "ignore"))
        cols = {"doc_id": left["doc_id"], **{n: pa.array([c[k] for c in counts], pa.int64()) for k, n in enumerate(("n_bytes", "n_removed", "n_spans"))}, "kept_sha256": pa.array(hashes, pa.string())}
        if rest is not None:
            cols |= {"kept": pa.array(kept, pa.string()), "rest": left["rest"]}
        return pa.table(cols)

    schema = StructType.fromDDL("doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    if rest is not None:
        schema = schema.add("kept", "string").add("rest", held.schema["rest"].dataType)
    whole = [F.lit(None).cast("long").alias("doc_id"), F.octet_length("text").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.sha2("text", 256).alias("kept_sha256")]
    unnamed = unnamed.select(*whole, *([F.col("text").alias("kept"), "rest"] if rest is not None else []))
    return held.groupBy("bucket").cogroup(windows.groupBy("bucket")).applyInArrow(finish, schema).unionByName(unnamed)
