"""Elias-Fano: a rising sequence of integers in about two bits for each plus the bits below their mean gap.

The low bits of each value stand packed one after the other. The high bits are unary: bit (value >> low) + i is set for
value i. Where the i-th set bit is, select() finds from the position of every SAMPLE-th one, kept in 32 bits, by
counting the bits of the words between; no table of offsets is made.
"""

from __future__ import annotations

import struct

import numpy as np

SAMPLE = 256
HEAD = struct.Struct("<QBQ")


class EliasFano:
    def __init__(self, n: int, low: int, lower: np.ndarray, upper: np.ndarray, samples: np.ndarray):
        self.n, self.low, self.lower, self.upper, self.samples = n, low, lower, upper, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        """values: unsigned 64-bit, not falling."""
        v = np.asarray(values, np.uint64)
        n = len(v)
        low = max(0, (int(v[-1]) // n).bit_length() - 1) if n else 0
        bits = ((v[:, None] >> np.arange(low, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8) if low else np.zeros((n, 0), np.uint8)
        at = (v >> np.uint64(low)).astype(np.int64) + np.arange(n)
        upper = np.zeros(-(-(int(at[-1]) + 1 if n else 0) // 64) * 64, np.uint8)
        upper[at] = 1
        return cls(n, low, words(bits.ravel(), 1), words(upper), at[::SAMPLE].astype(np.uint32))

    def select(self, i: np.ndarray) -> np.ndarray:
        """Positions of the i-th set bits (from 0) of the upper part."""
        i = np.asarray(i, np.int64)
        start = self.samples[i // SAMPLE].astype(np.int64)
        rest, at = i % SAMPLE, start >> 6
        word = self.upper[at] & (np.uint64(0xFFFFFFFFFFFFFFFF) << (start & 63).astype(np.uint64))
        count = np.bitwise_count(word).astype(np.int64)
        go = np.flatnonzero(rest >= count)
        while len(go):
            rest[go] -= count[go]
            at[go] += 1
            word[go] = self.upper[at[go]]
            count[go] = np.bitwise_count(word[go])
            go = go[rest[go] >= count[go]]
        inside = np.zeros(len(i), np.int64)
        for width in (32, 16, 8, 4, 2, 1):
            half = (word >> inside.astype(np.uint64)) & np.uint64((1 << width) - 1)
            count = np.bitwise_count(half).astype(np.int64)
            over = rest >= count
            rest, inside = np.where(over, rest - count, rest), np.where(over, inside + width, inside)
        return at * 64 + inside

    def get(self, i: np.ndarray) -> np.ndarray:
        """Values i, unsigned 64-bit."""
        i = np.asarray(i, np.int64)
        high = (self.select(i) - i).astype(np.uint64) << np.uint64(self.low)
        if not self.low:
            return high
        bit = i * self.low
        at, shift = bit >> 6, (bit & 63).astype(np.uint64)
        own = self.lower[at] >> shift
        over = shift > 64 - self.low
        own[over] |= self.lower[at[over] + 1] << (np.uint64(64) - shift[over])
        return high | (own & np.uint64((1 << self.low) - 1))

    def dump(self) -> bytes:
        return HEAD.pack(self.n, self.low, len(self.upper)) + self.lower.astype("<u8").tobytes() + self.upper.astype("<u8").tobytes() + self.samples.astype("<u4").tobytes()

    @classmethod
    def load(cls, data: bytes, at: int = 0) -> tuple[EliasFano, int]:
        """The sequence at a place in data, and where it ends."""
        n, low, size = HEAD.unpack_from(data, at)
        at, parts = at + HEAD.size, []
        for kind, count in (("<u8", -(-n * low // 64) + 1), ("<u8", size), ("<u4", -(-n // SAMPLE))):
            parts.append(np.frombuffer(data, kind, count, at))
            at += parts[-1].nbytes
        return cls(n, low, *parts), at


def words(bits: np.ndarray, more: int = 0) -> np.ndarray:
    """Bits as 64-bit words, lowest first, and some empty words."""
    own = np.packbits(bits, bitorder="little")
    out = np.zeros((-(-len(own) // 8) + more) * 8, np.uint8)
    out[: len(own)] = own
    return out.view(np.uint64)
