"""Operator 9: Jaccard join of documents on word n-grams by prefixes with token combinations.

Tokens are fingerprints of n-word shingles. A fixed table of counters over all data says how frequent a token is (at
least; a shared counter only changes the order). Each document orders its tokens rare to frequent and takes a prefix.
A document of s tokens can have at most e = s - ceil(s * share) that a partner lacks. Rare tokens index alone. Tokens
well above the mean count form classes and index in pairs within a class, and the prefix grows until no e tokens can be
taken from it without a rare token or a pair of one class being left; so partners share a signature. That takes more
than `classes` sure tokens (s - e), so documents use classes by bands of size: 4, 16, 64, ..., so that a class holds few
tokens and pairs grow with the text, not its square; the smallest use none, and all their tokens index alone. Bands
overlap so far that partners always have one in common.

Signatures meet by bucket; one whose tokens' count is large is dealt out over several buckets first, whose least
documents then meet. The documents of one signature, cut where sizes are too far apart, form a star around the smallest
doc_id. Documents keep a sketch, the counts of their tokens in BINS bins; two differ in as many tokens at least as their
sketches do. Round 1 looks at pairs of centre and member only, first by sketch, then in full: the centre's tokens go to
each bucket that holds members. Components of these links settle most stars. Round 2 takes the stars whose members are
in several components, and compares those outside the largest one with all. Members that differ in component and that
sketches can't tell apart form a smaller star around their smallest doc_id. Its members answer with what differs from
the centre, D. Two members x and y differ in |Dx| + |Dy| - 2 |Dx & Dy| tokens, so those that the centre doesn't link are
compared with all members from the D alone. Round 2 works in blocks of BLOCK members on either side and gives a spanning
forest rather than pairs. No link is lost, none is capped. Exact copies in a task's rows enter once, as links to the
first. Documents move in buckets of BUCKET_BYTES of text, so a task's memory doesn't grow with the table.

Null or empty texts, or those without words, have no tokens and no links. Rows with one doc_id are one document: it has
the links of each of its texts. A null doc_id has a null component. Empty tables give no rows; other columns of any name
are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucket_col, bucket_of, buckets_for, mix, pack_columns, raw, spans, text_col, unpack_columns, written
from .components import components
from .repeats import NO_ID, own_ids
from .shingles import shingles

COUNTERS, SLICES = 1 << 22, 64  # 2^22 counters: 8 MB broadcast, whatever the input
CLASSES = (0, *(4**k for k in range(16)))  # by size: more sure tokens than classes, so that prefixes reach errors + 1
BLOCK, BINS = 512, 64
HELD, SALT_ROWS = 500_000, 1 << 17  # records that a task gathers; documents of a signature in one bucket, if counts are right
SIGNATURE, STAR, SALTED = (6, 1, 3, 8), (8, 8), (6, 8, 8)  # bytes of: signature, whether salted, size, document; member, centre; signature, member, centre
ROW = "kind int, bucket int, blob binary"
DEAL, LINK, MORE = 0, 1, 2


def counter(tokens: np.ndarray) -> np.ndarray:
    return (tokens & np.uint64(COUNTERS - 1)).astype(np.int64)


def level(counts: np.ndarray) -> np.ndarray:
    """A count's place in the order of tokens, in steps of a twelfth of a doubling."""
    return (12 * np.log2(1.0 + counts)).astype(np.uint16)


def _batch(rows) -> pa.RecordBatch:
    rows = list(rows)
    return pa.record_batch([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], ["kind", "bucket", "blob"])


def _rows(kind, to, cols, widths):
    """Rows (kind, bucket, blob); the last column is stored as differences in its order."""
    order = np.lexsort((cols[-1], to))
    to, cols = to[order], [c[order] for c in cols]
    cuts = np.append(np.flatnonzero(np.append(True, to[1:] != to[:-1])) if len(to) else np.zeros(0, np.int64), len(to))
    for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        own = [c[lo:hi].astype(np.uint64) for c in cols]
        own[-1] = np.diff(own[-1], prepend=np.uint64(0))
        yield kind, int(to[lo]), pack_columns(*own, widths=widths)


def _open(blobs, widths):
    parts = [unpack_columns(x, widths) for x in blobs]
    for p in parts:
        p[-1] = np.cumsum(p[-1], dtype=np.uint64)
    return [np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, np.uint64) for i in range(len(widths))]


def sizes_and_counts(docs: DataFrame, n: int) -> DataFrame:
    """Rows (doc_id, size, sketch in blob) of all documents (slice null), and counters by slice (size null)."""

    def run(batches):
        counts, held = np.zeros(COUNTERS, np.uint32), []

        def add():
            nonlocal counts, held
            if held:
                counts += np.bincount(np.concatenate(held), minlength=COUNTERS).astype(np.uint32)
            held = []

        for b in batches:
            data, off = raw(b.column("text"))
            for lo, hi in spans(off):
                tokens, o = shingles(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], n)
                held.append(counter(tokens))
                if sum(map(len, held)) > 1 << 21:
                    add()
                row = np.repeat(np.arange(hi - lo), np.diff(o))
                sketch = np.bincount(row * BINS + (tokens >> np.uint64(58)).astype(np.int64), minlength=(hi - lo) * BINS).astype("<u4").reshape(-1, BINS)
                yield pa.record_batch([b.column("doc_id").slice(lo, hi - lo), pa.array(np.diff(o)), pa.nulls(hi - lo, pa.int32()), pa.array([x.tobytes() for x in sketch], pa.binary())], ["doc_id", "size", "slice", "blob"])
        add()
        if counts.any():
            blobs = [pack_columns(x, widths=(4,)) for x in np.split(counts, SLICES)]
            yield pa.record_batch([pa.nulls(SLICES, pa.int64()), pa.nulls(SLICES, pa.int64()), pa.array(range(SLICES), pa.int32()), pa.array(blobs, pa.binary())], ["doc_id", "size", "slice", "blob"])

    return written(docs.select("doc_id", "text").mapInArrow(run, "doc_id long, size long, slice int, blob binary"), "sizes")


def token_levels(first: DataFrame) -> tuple[np.ndarray, int]:
    """The level of every counter, and the level above which tokens are frequent: eight times the mean count."""

    def add(key, t):
        total = np.zeros(COUNTERS // SLICES, np.uint64)
        for blob in t["blob"]:
            total += unpack_columns(blob.as_py(), (4,))[0]
        return pa.table({"slice": t["slice"].slice(0, 1), "total": pa.array([int(total.sum())], pa.int64()), "levels": pa.array([level(total).tobytes()], pa.binary())})

    parts = first.where("slice is not null").select("slice", "blob").groupBy("slice").applyInArrow(add, "slice int, total long, levels binary").collect()  # SLICES rows
    levels = np.zeros((SLICES, COUNTERS // SLICES), np.uint16)
    for p in parts:
        levels[p.slice] = np.frombuffer(p.levels, np.uint16)
    return levels.ravel(), int(level(np.array([64 + 8 * sum(p.total for p in parts) / COUNTERS]))[0])


def bands(tenths: int) -> list[tuple[int, int, int]]:
    """(classes, least size, greatest size); partners have a band in common, where each has more sure tokens than classes."""
    low = [max(1, 100 * c // tenths + 1) for c in CLASSES]
    return list(zip(CLASSES, low, [100 * (m - 1) // tenths for m in low[1:]] + [np.iinfo(np.int64).max], strict=True))


def signatures(tokens: np.ndarray, o: np.ndarray, levels: np.ndarray, frequent: int, tenths: int):
    """(row, signature, level of its rarest token) of all documents in a chunk."""
    size = np.diff(o)
    row = np.repeat(np.arange(len(size)), size)
    lev = levels[counter(tokens)]
    order = np.lexsort((tokens, lev, row))
    tok, lev = tokens[order], lev[order]
    rows, sigs, at = [], [], []
    for classes, low, high in bands(tenths):
        docs = np.flatnonzero((size >= low) & (size <= high))
        if len(docs):
            own = ((size >= low) & (size <= high))[row]
            r, s, v = _prefixes(tok[own], lev[own], frequent, size[docs], classes, tenths)
            rows.append(docs[r])
            sigs.append(s)
            at.append(v)
    return np.concatenate(rows), np.concatenate(sigs), np.concatenate(at)


def _prefixes(tok: np.ndarray, lev: np.ndarray, frequent: int, size: np.ndarray, classes: int, tenths: int):
    """(row, signature, level) of documents in one band, their tokens in order; without classes all tokens index alone."""
    row = np.repeat(np.arange(len(size)), size)
    o = np.append(0, np.cumsum(size))
    errors = size - (size * tenths + 99) // 100
    # what a token adds: nothing if it is the first of its class in the document, else one
    klass = np.where(lev > frequent, 1 + (tok >> np.uint64(24)) % np.uint64(max(classes, 1)), 0).astype(np.int64) * (classes > 0)
    often = np.flatnonzero(klass)
    adds = np.ones(len(tok), np.int64)
    if len(often):
        key = row[often] * (classes + 1) + klass[often]
        adds[often[np.unique(key, return_index=True)[1]]] = 0
    total = np.cumsum(adds)
    before = np.append(0, total)[o[:-1]]
    inside = (total - before[row] - adds) <= errors[row]  # until errors + 1 are reached
    alone = inside & (klass == 0)
    rows, sigs, levels = [row[alone]], [mix(tok[alone])], [lev[alone]]
    pick = np.flatnonzero(inside & (klass > 0))
    if len(pick):
        key = row[pick] * (classes + 1) + klass[pick]
        pick = pick[np.argsort(key, kind="stable")]
        key = np.sort(key)
        new = np.append(True, key[1:] != key[:-1])
        place = np.arange(len(key)) - np.flatnonzero(new)[np.cumsum(new) - 1]
        for back in range(1, int(place.max()) + 1):  # pairs within a class: each token with the one `back` places before
            i = np.flatnonzero(place >= back)
            x, y = tok[pick[i]], tok[pick[i - back]]
            rows.append(row[pick[i]])
            sigs.append(mix(np.maximum(x, y) * np.uint64(0x9FB21C651E98DF25) + mix(np.minimum(x, y))))
            levels.append(np.minimum(lev[pick[i]], lev[pick[i - back]]))
    return np.concatenate(rows), np.concatenate(sigs), np.concatenate(levels)


def star_pairs(docs: DataFrame, levels, frequent: int, buckets: int, n: int, tenths: int, salt_rows: int) -> DataFrame:
    """Rows (kind, bucket, blob): STAR records (DEAL), those of salted signatures (MORE), and links between exact copies (LINK)."""
    shared = docs.sparkSession.sparkContext.broadcast(levels.tobytes())

    def emit(batches):
        levels = np.frombuffer(shared.value, np.uint16)
        parts, links, held = [], [], 0

        def flush():
            if parts:
                sig, lev, size, doc = (np.concatenate([p[i] for p in parts]) for i in range(4))
                salts = (2.0 ** (lev / 12.0) / salt_rows).astype(np.uint64) + np.uint64(1)  # no token is more frequent than its counter
                deal = mix(sig + mix(doc.astype(np.uint64)) % salts * np.uint64(0x9E3779B97F4A7C15))
                to = ((deal >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
                yield from _rows(DEAL, to, [sig >> np.uint64(16), salts > 1, size, doc], SIGNATURE)
            if links:
                copy, one = (np.concatenate([p[i] for p in links]) for i in range(2))
                yield from _rows(LINK, bucket_of(one, buckets), [copy, one], STAR)

        for b in batches:
            data, off = raw(b.column("text"))
            ids = own_ids(b.column("doc_id"))
            for lo, hi in spans(off):
                own = ids[lo:hi]
                tokens, o = shingles(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], n)
                size = np.diff(o)
                some = np.flatnonzero((size > 0) & (own != NO_ID))
                if not len(some):
                    continue
                whole = mix(np.add.reduceat(mix(tokens), o[some]) + size[some].astype(np.uint64))
                order = np.lexsort((own[some], whole))
                head = np.append(True, np.diff(whole[order]) != 0)
                lead = some[order][head]
                same = some[order][np.flatnonzero(head)[np.cumsum(head) - 1]]
                sure = np.array([i != j and own[i] != own[j] and np.array_equal(tokens[o[i] : o[i + 1]], tokens[o[j] : o[j + 1]]) for i, j in zip(some[order].tolist(), same.tolist(), strict=True)], bool)
                links.append((own[some[order][sure]], own[same[sure]]))
                keep = np.zeros(hi - lo, bool)
                keep[some] = True
                keep[some[order][~head & (sure | (own[some[order]] == own[same]))]] = False
                keep[lead] = True
                pick = np.repeat(keep, size)
                left = np.flatnonzero(keep)
                row, sig, lev = signatures(tokens[pick], np.append(0, np.cumsum(size[left])), levels, frequent, tenths)
                row = left[row]
                parts.append((sig, lev, size[row], own[row]))
                held += len(sig)
                if held >= HELD:
                    yield _batch(flush())
                    parts, links, held = [], [], 0
        yield _batch(flush())

    def meet(key, t):
        if key[0].as_py() != DEAL:
            return t.select(["kind", "bucket", "blob"])
        sig, salted, size, doc = _open(t["blob"].to_pylist(), SIGNATURE)
        doc, size, salted = doc.astype(np.int64), size.astype(np.int64), salted > 0
        order = np.lexsort((doc, size, sig))
        sig, size, doc, salted = sig[order], size[order], doc[order], salted[order]
        cut = np.append(True, (sig[1:] != sig[:-1]) | (size[1:] * tenths > 100 * size[:-1]) & ~salted[1:])[: len(sig)]
        group = np.cumsum(cut) - 1
        least = np.full(int(cut.sum()), np.iinfo(np.int64).max)
        np.minimum.at(least, group, doc)
        centre = least[group]
        pick = (doc != centre) & ~salted
        both = np.unique(np.stack([centre[pick], doc[pick]]), axis=1)
        rows = [*_rows(DEAL, np.zeros(both.shape[1], np.int64), [both[1], both[0]], STAR)]
        return pa.Table.from_batches([_batch([*rows, *_rows(MORE, np.zeros(int(salted.sum()), np.int64), [sig[salted], doc[salted], centre[salted]], SALTED)])])

    return docs.select("doc_id", "text").mapInArrow(emit, ROW).groupBy("kind", "bucket").applyInArrow(meet, ROW)


def _read(rows: DataFrame, kind: int, names: tuple[str, ...], widths: tuple[int, ...]) -> DataFrame:
    """Packed records as columns of longs."""

    def run(batches):
        for b in batches:
            for blob in b.column("blob"):
                yield pa.record_batch([pa.array(c.astype(np.int64)) for c in _open([blob.as_py()], widths)], list(names))

    return rows.where(F.col("kind") == kind).select("blob").mapInArrow(run, ", ".join(f"{n} long" for n in names))


def pairs_of(stars: DataFrame) -> DataFrame:
    """(centre, member) of all stars, once each."""
    more = _read(stars, MORE, ("sig", "member", "part"), SALTED)
    centres = more.groupBy("sig").agg(F.min("part").alias("centre"))
    more = more.join(centres, "sig").where("centre <> member").select("centre", "member")
    return _read(stars, DEAL, ("member", "centre"), STAR).select("centre", "member").unionByName(more).distinct()


def alike(pairs: DataFrame, sketches: DataFrame, tenths: int) -> DataFrame:
    """The pairs (centre, member) that their sketches can't tell apart."""

    def keep(batches):
        for b in batches:
            x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), "<u4").reshape(-1, BINS).astype(np.int32) for c in ("a", "b"))
            pick = linked(b.column("total").to_numpy(), np.abs(x - y).sum(1), tenths)
            yield b.select(["centre", "member"]).filter(pa.array(pick))

    a, b = (sketches.select(F.col("doc_id").alias(c), F.col("size").alias(f"size_{n}"), F.col("sketch").alias(n)) for c, n in (("centre", "a"), ("member", "b")))
    rows = pairs.join(a, "centre").join(b, "member").select("centre", "member", (F.col("size_a") + F.col("size_b")).alias("total"), "a", "b")
    return rows.mapInArrow(keep, "centre long, member long")


def in_blocks(rows: DataFrame, buckets: int) -> DataFrame:
    """Deals the rows of each group out so that every loose one meets all: by blocks of loose ones and blocks of all.

    rows have the group's counts `loose_rows` and `all_rows`; columns bucket, i, j, side (whether as a loose one) are added.
    """
    rows = rows.withColumn("wide", F.ceil(F.col("all_rows") / BLOCK).cast("int")).withColumn("high", F.ceil(F.col("loose_rows") / BLOCK).cast("int")).drop("all_rows", "loose_rows")
    own = lambda blocks: F.pmod(F.xxhash64("member"), F.col(blocks)).cast("int")
    upto = lambda blocks: F.explode(F.sequence(F.lit(0), F.col(blocks) - 1))
    one = rows.where("loose").withColumn("i", own("high")).withColumn("j", upto("wide")).withColumn("side", F.lit(True))
    other = rows.withColumn("j", own("wide")).withColumn("i", upto("high")).withColumn("side", F.lit(False))
    return one.unionByName(other).withColumn("bucket", bucket_col("centre", buckets)).drop("wide", "high")


def left_over(pairs: DataFrame, roots: DataFrame, sketches: DataFrame, buckets: int, tenths: int) -> DataFrame:
    """Smaller stars (centre, member) of what is left: members of one star in different components that their sketches can't tell apart."""
    all_ = pairs.unionByName(pairs.select("centre", F.col("centre").alias("member")).distinct())
    all_ = written(all_.join(roots, all_.member == roots.node, "left").select("centre", "member", F.coalesce("root", "member").alias("root")), "members")
    n = all_.groupBy("centre", "root").count().groupBy("centre").agg(F.max_by("root", F.struct("count", "root")).alias("largest"), F.sum("count").alias("all_rows"), (F.sum("count") - F.max("count")).alias("loose_rows"))
    n = written(n.where("loose_rows > 0"), "counts")  # on its own, so that the join can split a large star
    rows = all_.join(n, "centre").withColumn("loose", F.col("root") != F.col("largest")).drop("largest")

    def part(key, t):
        t = t.sort_by([("centre", "ascending"), ("member", "ascending"), ("side", "descending")])
        centre, member = t["centre"].to_numpy(), t["member"].to_numpy()
        t = t.filter(pa.array(np.append(True, (centre[1:] != centre[:-1]) | (member[1:] != member[:-1]))))  # one row for a member on both sides
        centre, member, root, size, side = (t[n].to_numpy() for n in ("centre", "member", "root", "size", "side"))
        counts = np.frombuffer(b"".join(t["sketch"].to_pylist()), "<u4").reshape(-1, BINS).astype(np.int32)
        pairs = []
        cut = np.append(np.flatnonzero(np.append(True, centre[1:] != centre[:-1])), len(centre))
        for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            r, x, n, loose = root[lo:hi], counts[lo:hi], size[lo:hi], np.flatnonzero(side[lo:hi])
            differ = np.zeros((len(loose), hi - lo), np.int32)
            for k in range(BINS):
                differ += np.abs(x[loose, None, k] - x[None, :, k])
            near = linked(n[loose, None] + n[None], differ, tenths) & (r[loose, None] != r[None])
            label = spread_labels(np.arange(hi - lo), loose, near)
            lead = member[lo:hi][label]
            pick = lead != member[lo:hi]
            pairs.append(np.stack([lead[pick], member[lo:hi][pick]]))
        both = np.unique(np.concatenate(pairs, axis=1), axis=1) if pairs else np.zeros((2, 0), np.int64)
        return pa.table({"centre": both[0], "member": both[1]})

    rows = in_blocks(rows, buckets).join(sketches.withColumnRenamed("doc_id", "member"), "member")
    return rows.groupBy("bucket", "i", "j").applyInArrow(part, "centre long, member long").distinct()


def spread_labels(label: np.ndarray, loose: np.ndarray, near: np.ndarray) -> np.ndarray:
    """The least label in each component of a relation between some rows and all."""
    m = len(label)
    while True:
        new = label.copy()
        if len(loose):
            np.minimum.at(new, loose, np.where(near, label[None], m).min(1))
            new = np.minimum(new, np.where(near, new[loose, None], m).min(0))
        if (new == label).all():
            return label
        label = new


def sets_of(table: pa.Table, wanted: np.ndarray, n: int):
    """(doc_id, tokens) of the rows whose doc_id is wanted."""
    ids = own_ids(table["doc_id"])
    pick = np.flatnonzero(np.isin(ids, wanted))
    if not len(pick):
        return
    data, off = raw(table["text"].take(pa.array(pick)))
    for lo, hi in spans(off):
        tokens, o = shingles(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], n)
        for i in range(hi - lo):
            if o[i + 1] > o[i]:
                yield int(ids[pick[lo + i]]), np.unique(tokens[o[i] : o[i + 1]] >> np.uint64(16))


def linked(total: np.ndarray, differ: np.ndarray, tenths: int) -> np.ndarray:
    """Whether intersection / union reaches the share, from the sum of sizes and the tokens that differ."""
    return 100 * (total - differ) >= tenths * (total + differ)


def forest(x: np.ndarray, size: np.ndarray, diffs: list[np.ndarray], fixed: np.ndarray, side: np.ndarray, tenths: int):
    """Links (member, smallest member) that span the components between the members on a side and all; fixed ones hang on the centre."""
    m = len(x)
    d = np.array([len(v) for v in diffs], np.int64)
    _, col, count = np.unique(np.concatenate(diffs), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(m), d)
    often = count > 1
    col, row = (np.cumsum(often) - 1)[col[often[col]]], row[often[col]]
    loose = np.flatnonzero(side)
    common = np.zeros((len(loose), m), np.float32)
    for lo in range(0, int(often.sum()), 2048):
        now = (col >= lo) & (col < lo + 2048)
        cells = np.zeros((m, 2048), np.float32)
        cells[row[now], col[now] - lo] = 1
        common += cells[loose] @ cells.T
    near = linked(size[loose, None] + size[None], d[loose, None] + d[None] - 2 * common.astype(np.int64), tenths)
    near[:, fixed] |= near[:, fixed].any(1, keepdims=True)  # fixed members hang together on the centre
    label = spread_labels(np.arange(m), loose, near)
    return [(int(x[i]), int(x[label[i]])) for i in range(m) if label[i] != i and not (fixed[i] and fixed[label[i]])]


def verify(docs: DataFrame, pairs: DataFrame, buckets: int, n: int, tenths: int, direct: bool = False) -> DataFrame:
    """Links (a, b) between centres and members; unless direct, also between members that their centre doesn't link."""
    note = pa.schema([("bucket", pa.int32()), ("centre", pa.int64()), ("member", pa.int64()), ("print", pa.int64()), ("tokens", pa.binary())])
    answer = pa.schema([("centre", pa.int64()), ("print", pa.int64()), ("member", pa.int64()), ("size", pa.int64()), ("loose", pa.bool_()), ("differs", pa.binary())])

    def table(rows, schema):
        return pa.Table.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema)

    def centres(left, right):
        to: dict[int, list[int]] = {}
        for c, bucket in zip(right["centre"].to_pylist(), right["to"].to_pylist(), strict=True):
            to.setdefault(c, []).append(bucket)
        out = []
        for c, tokens in sets_of(left, np.fromiter(to, np.int64, len(to)), n) if left.num_rows else ():
            key = int(mix(np.add.reduce(mix(tokens), keepdims=True)).view(np.int64)[0])
            blob = pack_columns(tokens, widths=(6,))
            out += [(bucket, c, None, key, blob) for bucket in to[c]]
        return table(out, note)

    def members(left, right):
        out = []
        if right.num_rows and left.num_rows:
            asked: dict[int, list[int]] = {}
            notes: dict[int, list[tuple[int, np.ndarray]]] = {}
            for r in right.select(note.names[1:]).to_pylist():
                if r["tokens"] is None:
                    asked.setdefault(r["member"], []).append(r["centre"])
                else:
                    notes.setdefault(r["centre"], []).append((r["print"], unpack_columns(r["tokens"], (6,))[0]))
            for x, tokens in sets_of(left, np.fromiter(asked, np.int64, len(asked)), n):
                for c in asked[x]:
                    for key, other in notes.get(c, ()):
                        differs = np.setxor1d(tokens, other, assume_unique=True)
                        near = bool(linked(np.int64(len(tokens) + len(other)), np.int64(len(differs)), tenths))
                        out.append((c, key, x, len(tokens), not near, None if direct else pack_columns(differs, widths=(6,))))
        return table(out, answer)

    def compare(key, t):
        links, stars = [], {}
        for k, (c, p) in enumerate(zip(t["centre"].to_pylist(), t["print"].to_pylist(), strict=True)):
            stars.setdefault((c, p), []).append(k)
        for rows in stars.values():
            own = t.take(pa.array(rows)).sort_by([("member", "ascending"), ("size", "ascending"), ("differs", "ascending"), ("side", "descending")])
            x, size, d = own["member"].to_numpy(), own["size"].to_numpy(), own["differs"].to_pylist()
            once = np.array([k == 0 or x[k] != x[k - 1] or d[k] != d[k - 1] for k in range(len(x))], bool)  # one row for a member on both sides
            links += forest(x[once], size[once], [unpack_columns(b, (6,))[0] for b, k in zip(d, once, strict=True) if k], ~own["loose"].to_numpy()[once], own["side"].to_numpy()[once], tenths)
        links = sorted(set(links))
        return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})

    pairs = pairs.withColumn("bucket", bucket_col("member", buckets))
    wanted = pairs.select(bucket_col("centre", buckets).alias("own"), "centre", F.col("bucket").alias("to")).distinct().withColumnRenamed("own", "bucket")
    schema = "bucket int, centre long, member long, print long, tokens binary"
    notes = docs.groupBy("bucket").cogroup(wanted.groupBy("bucket")).applyInArrow(centres, schema)
    notes = notes.unionByName(pairs.select("bucket", "centre", "member", F.lit(None).cast("long").alias("print"), F.lit(None).cast("binary").alias("tokens")))
    answers = docs.groupBy("bucket").cogroup(notes.groupBy("bucket")).applyInArrow(members, "centre long, print long, member long, size long, loose boolean, differs binary")
    if not direct:
        answers = written(answers, "answers")
    links = answers.where("not loose").select(F.col("member").alias("a"), F.col("centre").alias("b"))
    if direct:
        return links.distinct()
    n = answers.groupBy("centre", "print").agg(F.count("*").alias("all_rows"), F.count(F.when(F.col("loose"), 1)).alias("loose_rows"))
    answers = answers.join(written(n.where("loose_rows > 0"), "counts"), ["centre", "print"])
    return links.unionByName(in_blocks(answers, buckets).groupBy("bucket", "i", "j").applyInArrow(compare, "a long, b long"))


def join(docs: DataFrame, n: int = 3, tenths: int = 90, salt_rows: int = SALT_ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id of every row: documents link where 100 * intersection >= tenths * union."""
    held = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_col(docs).alias("text"))
    buckets, first = buckets_for(held), sizes_and_counts(held, n)
    held = held.where("doc_id is not null").withColumn("bucket", bucket_col("doc_id", buckets))
    levels, frequent = token_levels(first)
    stars = written(star_pairs(held, levels, frequent, 2 * buckets + 1, n, tenths, salt_rows), "stars")
    sketches = first.where("slice is null and doc_id is not null").select("doc_id", "size", F.col("blob").alias("sketch"))
    pairs = written(pairs_of(stars), "pairs")
    links = verify(held, alike(pairs, sketches, tenths), buckets, n, tenths, direct=True)
    roots = written(components(links.unionByName(_read(stars, LINK, ("a", "b"), STAR))), "roots")
    left = written(left_over(pairs, roots, sketches, buckets, tenths), "left")
    ids = written(left.select(F.explode(F.array("centre", "member")).alias("doc_id")).distinct(), "ids")
    if not ids.isEmpty():
        more = verify(held.join(ids, "doc_id", "left_semi"), left, buckets, n, tenths)
        roots = written(components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more)), "roots")
    sizes = first.where("slice is null").select("doc_id", F.col("size").alias("n_shingles"))
    return sizes.join(roots, sizes.doc_id == roots.node, "left").select("doc_id", "n_shingles", F.coalesce("root", "doc_id").alias("component_id"))
