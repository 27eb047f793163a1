"""Splits texts by public_tokenizers.PATTERN, whole chunks of documents at a time, in numpy.

The pattern's classes are letters, numbers, white space and the rest; its matches follow from where the class
changes, so that no regular expression runs over the text: a run of white space gives up its last character to
what follows (a space joins the next match), and an apostrophe that begins a match takes s, t, re, ve, m, ll, d.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import regex

from .common import Fingerprints, ragged

LETTER, NUMBER, SPACE = 1, 2, 3
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")


@cache
def classes() -> np.ndarray:
    """The class of every code point."""
    out = np.zeros(0x110000, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for kind, what in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\p{White_Space}+")):
        for m in regex.finditer(what, every):
            lo, hi = ord(m[0][0]), ord(m[0][-1])
            if hi - lo + 1 == len(m[0]):
                out[lo : hi + 1] = kind
            else:
                out[[ord(c) for c in m[0]]] = kind
    return out


def starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Byte positions where matches start, in documents data[offsets[i]:offsets[i + 1]]; each runs to the next."""
    if not len(data):
        return np.zeros(0, np.int64)
    try:
        points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
        at = np.flatnonzero((data & 0xC0) != 0x80)
    except UnicodeDecodeError:  # bytes that are no UTF-8 count as characters of the last class
        points, at = data.astype(np.uint32), np.arange(len(data))
        points[data >= 0x80] = 0xFFFD
    kind = classes()[points]
    n = len(points)
    first = np.zeros(n + 1, bool)  # of a document
    first[np.searchsorted(at, offsets[:-1][np.diff(offsets) > 0])] = True
    first[n] = True
    change = np.empty(n, bool)
    change[0] = True
    np.not_equal(kind[1:], kind[:-1], out=change[1:])
    change |= first[:n]
    space, blank = kind == SPACE, points == 32
    begin = change.copy()
    # what follows a space in the same document begins with that space
    begin[1:] &= ~(change[1:] & ~space[1:] & blank[:-1] & ~first[1:n])
    # the last white space before something else in the same document is on its own
    last = space.copy()
    last[:-1] &= ~space[1:] & ~first[1:n]
    last[-1] = False
    begin |= last
    apostrophe = np.flatnonzero((points == 39) & begin & change)
    apostrophe = apostrophe[apostrophe + 1 < n]
    apostrophe = apostrophe[(kind[apostrophe + 1] == LETTER) & ~first[apostrophe + 1]]
    for end in ENDINGS:
        i = apostrophe[apostrophe + len(end) < n]
        for k, c in enumerate(end, 1):
            i = i[(points[i + k] == ord(c)) & ~first[i + k]]
        begin[i + 1] = False
        stop = i + 1 + len(end)
        begin[stop[stop < n]] = True
    return at[begin]


def word_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Byte positions where documents and words start; a word runs to the next, with the ASCII white space behind it."""
    space = (data == 32) | ((data >= 9) & (data <= 13))
    begin = ~space
    begin[1:] &= space[:-1]
    begin[offsets[:-1][np.diff(offsets) > 0]] = True
    return np.flatnonzero(begin)


class Pieces:
    """Ids of distinct pieces of text, kept for the life of a worker up to `limit` pieces; encode(pieces) gives each one's ids.

    Pieces start where split(data, offsets) says; they are found by fingerprints and compared by their bytes.
    """

    def __init__(self, encode, limit: int = 1_000_000, split=starts):
        self.encode, self.limit, self.split, self.prints = encode, limit, split, Fingerprints(11)
        self.clear()

    def clear(self) -> None:
        self.known, self.slot = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.start, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool, self.text = np.zeros(0, np.uint32), np.zeros(0, np.uint8)
        self.place, self.length = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def ids(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all documents in order, number of ids up to each document's end, from 0)."""
        begin = self.split(data, offsets)
        stop = np.append(begin[1:], len(data))
        prefix = self.prints.prefix(data)
        got, at, back = np.unique(self.prints.of(prefix, begin, stop) ^ (stop - begin).astype(np.uint64), return_index=True, return_inverse=True)
        if len(self.known) > self.limit:
            self.clear()
        where = np.searchsorted(self.known, got)
        fresh = np.ones(len(got), bool)
        inside = where < len(self.known)
        fresh[inside] = self.known[where[inside]] != got[inside]
        if fresh.any():
            lo, hi, text = begin[at[fresh]], stop[at[fresh]], data.tobytes()
            flat, sizes = self.encode([text[a:b] for a, b in zip(lo.tolist(), hi.tolist(), strict=True)])
            slot = len(self.start) + np.arange(len(sizes))
            self.start = np.append(self.start, len(self.pool) + np.cumsum(sizes) - sizes)
            self.size, self.pool = np.append(self.size, sizes), np.append(self.pool, flat.astype(np.uint32))
            self.place, self.length = np.append(self.place, len(self.text) + np.cumsum(hi - lo) - (hi - lo)), np.append(self.length, hi - lo)
            self.text = np.append(self.text, data[ragged(lo, hi - lo)])
            merged = np.append(self.known, got[fresh])
            order = np.argsort(merged, kind="stable")
            self.known, self.slot = merged[order], np.append(self.slot, slot)[order]
            where = np.searchsorted(self.known, got)
        slot = self.slot[where][back] if len(got) else np.zeros(0, np.int64)
        length = stop - begin
        if (length != self.length[slot]).any() or not np.array_equal(data, self.text[ragged(self.place[slot], length)]):
            text = data.tobytes()  # two pieces of one fingerprint: this chunk without the table
            flat, size = self.encode([text[a:b] for a, b in zip(begin.tolist(), stop.tolist(), strict=True)])
            return flat.astype(np.uint32), np.append(0, np.cumsum(size))[np.searchsorted(begin, offsets)]
        size = self.size[slot]
        ends = np.append(0, np.cumsum(size))
        return self.pool[ragged(self.start[slot], size)], ends[np.searchsorted(begin, offsets)]
