"""Word shingles of whole chunks of documents in numpy."""

from __future__ import annotations

import numpy as np

from .common import Fingerprints, mix

WORD = Fingerprints(21)
STEP = (np.uint64(0x9FB21C651E98DF25), np.uint64(0xC2B2AE3D27D4EB4F))


def shingles(data: np.ndarray, off: np.ndarray, n: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct fingerprints of all documents' n-word shingles, offsets by document).

    A-Z count as a-z; words are runs of bytes other than 0x20 and 0x09-0x0D. A document of fewer words has its whole
    sequence as one shingle; one without words has none.
    """
    rows = len(off) - 1
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(rows + 1, np.int64)
    low = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
    space = (low == 32) | ((low >= 9) & (low <= 13))
    first = np.zeros(len(data), bool)
    first[off[:-1][np.diff(off) > 0]] = True
    word = ~space
    begin = word.copy()
    begin[1:] &= space[:-1] | first[1:]
    stop = word.copy()
    stop[:-1] &= space[1:] | first[1:]
    begin, stop = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    if not len(begin):
        return np.zeros(0, np.uint64), np.zeros(rows + 1, np.int64)
    h = mix(WORD.of(WORD.prefix(low), begin, stop) + (stop - begin).astype(np.uint64))
    at = np.searchsorted(begin, off)  # words before each document
    count = np.diff(at)
    doc = np.repeat(np.arange(rows), count)
    left = at[1:][doc] - np.arange(len(h))  # words from here to the document's end
    full = left >= n
    out = h.copy()
    for k in range(1, n):
        more = left > k
        out[:-k][more[:-k]] = mix(out[:-k][more[:-k]] * STEP[0] + h[k:][more[:-k]] * STEP[1] + np.uint64(k))
    pick = full | ((count < n)[doc] & (np.arange(len(h)) == at[:-1][doc]))
    out, doc = out[pick], doc[pick]
    out[(count < n)[doc]] ^= count[doc][(count < n)[doc]].astype(np.uint64)  # a shorter sequence never equals a shingle
    order = np.argsort(out, kind="stable")
    order = order[np.argsort(doc[order], kind="stable")]
    out, doc = out[order], doc[order]
    keep = np.append(True, (out[1:] != out[:-1]) | (doc[1:] != doc[:-1]))
    out, doc = out[keep], doc[keep]
    return out, np.append(0, np.cumsum(np.bincount(doc, minlength=rows)))
