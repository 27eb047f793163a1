"""Operator 3: media columns as AVI motion-JPEG.

Writing. A payload of bytes is cut into frames of SIDE x SIDE samples. A frame is a baseline greyscale JPEG in which one
sample fills one 8 x 8 block: its DC coefficient alone, at a quantizer of 8, so that the inverse transform gives the
sample back exactly. The Huffman table gives a DC difference of category s a code of 9 - s bits, so that code and
extra bits take 9 bits together, and the end of a block takes 7: each block has two bytes, and whole frames are coded
and decoded as arrays. Frames go into a RIFF file with `avih`, `strh`, `strf`, `movi` and `idx1` parts.

Reading. The RIFF tree is walked, the index gives each frame's place (without one the `movi` list is walked), markers
are parsed, and the entropy-coded part is decoded: as arrays where the tables give all DC differences and block ends one
length, as here, and bit by bit otherwise (baseline, one component, any tables).

Shots. The grey histograms (BINS bins) of neighbouring frames differ by half their L1 distance. A cut is a local peak
above the mean plus SIGMA standard deviations of the differences up to WINDOW frames around it and above LEAST, at least
SHORTEST frames after the cut before. Clips are rows: index, start and end in seconds, frames, largest difference.

Null and empty texts become one frame of padding. Repeated texts give equal values; a null doc_id stays null. Empty
tables give no rows; other columns of any name are not read. A file has some 2.1 times its text's bytes and must fit
into 2^31: texts up to 1 GB, each held whole by one task.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import raw, spans, text_col

SIDE, RATE = 24, 25
FRAME = SIDE * SIDE
BINS, WINDOW, SIGMA, LEAST, SHORTEST = 32, 12, 2.0, 0.15, 3
# Fixed value: the zigzag order of an 8 x 8 block.
ZIGZAG = (0, 1, 8, 16, 9, 2, 3, 10, 17, 24, 32, 25, 18, 11, 4, 5, 12, 19, 26, 33, 40, 48, 41, 34, 27, 20, 13, 6, 7, 14, 21, 28, 35, 42, 49, 56, 57, 50, 43, 36, 29, 22, 15, 23, 30, 37, 44, 51, 58, 59, 52, 45, 38, 31, 39, 46, 53, 60, 61, 54, 47, 55, 62, 63)


def segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


@cache
def head() -> bytes:
    """All of a frame up to its entropy-coded part."""
    side = 8 * SIDE
    dc = bytes([1] * 9 + [0] * 7) + bytes(range(8, -1, -1))  # category 8 has 1 bit ... category 0 has 9
    ac = bytes([0] * 6 + [1] + [0] * 9) + b"\0"  # the end of a block has 7
    return b"\xff\xd8" + segment(0xDB, b"\0" + bytes([8] * 64)) + segment(0xC0, struct.pack(">BHHB", 8, side, side, 1) + b"\x01\x11\0") + segment(0xC4, b"\0" + dc) + segment(0xC4, b"\x10" + ac) + segment(0xDA, b"\x01\x01\0\0\x3f\0")


@cache
def codes() -> np.ndarray:
    """The two bytes of a block by its DC difference + 255."""
    out = np.zeros(511, np.uint16)
    for diff in range(-255, 256):
        size = abs(diff).bit_length()
        code = (1 << (9 - size)) - 2 if size < 9 else 0  # canonical codes: 0, 10, 110, ...
        extra = diff if diff > 0 else diff + (1 << size) - 1
        out[diff + 255] = (code << size | extra) << 7
    return out


def frames(samples: np.ndarray) -> list[bytes]:
    """JPEG files of samples (n, FRAME)."""
    dc = samples.astype(np.int16) - 128
    coded = codes()[np.diff(dc, axis=1, prepend=0) + 255].astype(">u2").view(np.uint8).reshape(len(dc), -1)
    start, end = head(), b"\xff\xd9"
    stuffed = (coded == 255).any(1)
    return [start + (x.tobytes().replace(b"\xff", b"\xff\0") if s else x.tobytes()) + end for x, s in zip(coded, stuffed.tolist(), strict=True)]


def chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)


def avi(jpegs: list[bytes]) -> bytes:
    side, n, largest = 8 * SIDE, len(jpegs), max(map(len, jpegs), default=0)
    avih = struct.pack("<14I", 1_000_000 // RATE, largest * RATE, 0, 0x10, n, 0, 1, largest, side, side, 0, 0, 0, 0)
    strh = b"vidsMJPG" + struct.pack("<IHHIIIIIIIIHHHH", 0, 0, 0, 0, 1, RATE, 0, n, largest, 0xFFFFFFFF, 0, 0, 0, side, side)
    strf = struct.pack("<IiiHH4sIiiII", 40, side, side, 1, 24, b"MJPG", 3 * side * side, 0, 0, 0, 0)
    hdrl = chunk(b"LIST", b"hdrl" + chunk(b"avih", avih) + chunk(b"LIST", b"strl" + chunk(b"strh", strh) + chunk(b"strf", strf)))
    size = np.array([len(j) for j in jpegs], np.int64)
    at = 4 + np.cumsum(8 + size + (size & 1)) - (8 + size + (size & 1))
    index = np.zeros((n, 4), "<u4")
    index[:, 0], index[:, 1], index[:, 2], index[:, 3] = int.from_bytes(b"00dc", "little"), 0x10, at, size
    movi = b"movi" + b"".join([chunk(b"00dc", j) for j in jpegs])
    return chunk(b"RIFF", b"AVI " + hdrl + chunk(b"LIST", movi) + chunk(b"idx1", index.tobytes()))


def write(payload: bytes) -> bytes:
    """The AVI file of a payload of whole frames."""
    return avi(frames(np.frombuffer(payload, np.uint8).reshape(-1, FRAME)))


def parts(data: bytes, at: int, end: int):
    while at + 8 <= end:
        size = int.from_bytes(data[at + 4 : at + 8], "little")
        yield data[at : at + 4], at + 8, min(at + 8 + size, end)
        at += 8 + size + (size & 1)


def index(data: bytes) -> tuple[list[tuple[int, int]], float]:
    """((start, end) of every frame, frames a second) of an AVI file."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("no AVI file")
    rate, movi, table = 0.0, None, None
    todo = [(12, len(data))]
    while todo:
        for name, lo, hi in parts(data, *todo.pop()):
            if name == b"LIST" and data[lo : lo + 4] == b"movi":
                movi = (lo, hi)
            elif name == b"LIST":
                todo.append((lo + 4, hi))
            elif name == b"strh" and data[lo : lo + 4] == b"vids":
                scale, ticks = struct.unpack_from("<II", data, lo + 20)
                rate = ticks / max(scale, 1)
            elif name == b"idx1":
                table = np.frombuffer(data, "<u4", (hi - lo) // 16 * 4, lo).reshape(-1, 4)
    if movi is None:
        raise ValueError("no frames")
    if table is None:
        return [(lo, hi) for name, lo, hi in parts(data, movi[0] + 4, movi[1]) if name[2:] in (b"dc", b"db")], rate
    table = table[(table[:, 0] >> 16) == int.from_bytes(b"dc", "little")]
    base = movi[0] if len(table) and data[movi[0] + int(table[0, 2]) : movi[0] + int(table[0, 2]) + 4] == b"00dc" else 0  # offsets from `movi` or from the file's start
    lo = base + table[:, 2].astype(np.int64) + 8
    return list(zip(lo.tolist(), (lo + table[:, 3]).tolist(), strict=True)), rate


class Tables:
    """What a frame's markers say; `pairs`: DC difference by the two bytes of a block, where all blocks have that length."""

    def __init__(self, data: bytes):
        self.quant, self.huff, self.restart, at = {}, {}, 0, 2
        while True:
            marker, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
            body = data[at + 4 : at + 2 + size]
            if marker == 0xDB:
                while body:
                    wide = body[0] >> 4
                    self.quant[body[0] & 15] = np.frombuffer(body, ">u2" if wide else np.uint8, 64, 1).astype(np.int64)
                    body = body[1 + 64 * (1 + wide) :]
            elif marker == 0xC0:
                self.height, self.width, n = struct.unpack_from(">HHB", body, 1)
                if n != 1:
                    raise ValueError("one component only")
                self.table = body[8]
            elif marker == 0xC4:
                while body:
                    n = sum(body[1:17])
                    code, found, k = 0, {}, 17
                    for bits in range(1, 17):
                        for _ in range(body[bits]):
                            found[bits, code] = body[k]
                            code, k = code + 1, k + 1
                        code <<= 1
                    self.huff[body[0]] = found
                    body = body[17 + n :]
            elif marker == 0xDD:
                self.restart = int.from_bytes(body, "big")
            elif marker == 0xDA:
                self.dc, self.ac = self.huff[body[2] >> 4], self.huff[16 | body[2] & 15]
                self.start = at + 2 + size
                break
            elif 0xC1 <= marker <= 0xCF:
                raise ValueError("baseline frames only")
            at += 2 + size
        ends = [bits for (bits, _), symbol in self.ac.items() if symbol == 0]
        lengths = {bits + size for (bits, _), size in self.dc.items()}
        self.pairs = None
        if len(self.ac) == 1 and ends and len(lengths) == 1 and lengths.pop() + ends[0] == 16 and not self.restart:
            self.pairs = np.full(1 << 16, -(1 << 15), np.int32)
            tail, end = next(code for (_, code), symbol in self.ac.items() if symbol == 0), ends[0]
            for (_, code), size in self.dc.items():
                for extra in range(1 << size):
                    diff = extra if not size or extra >> (size - 1) else extra - (1 << size) + 1
                    self.pairs[((code << size | extra) << end) | tail] = diff


@cache
def tables(text: bytes) -> Tables:
    return Tables(text)


def blocks(data: bytes, t: Tables) -> np.ndarray:
    """Coefficients (blocks, 64) in natural order of a frame, bit by bit."""
    body = data[t.start : data.rindex(b"\xff\xd9")]
    n = -(-t.height // 8) * -(-t.width // 8)
    out, k = np.zeros((n, 64), np.int64), 0
    import re

    for run in re.split(rb"\xff[\xd0-\xd7]", body):
        text = run.replace(b"\xff\0", b"\xff")
        value, left, before = int.from_bytes(text, "big"), 8 * len(text), 0

        def take(bits):
            nonlocal left
            left -= bits
            return value >> left & ((1 << bits) - 1) if bits else 0

        def symbol(table):
            code = 0
            for bits in range(1, 17):
                code = code << 1 | take(1)
                if (bits, code) in table:
                    return table[bits, code]
            raise ValueError("broken code")

        def extended(size):
            v = take(size)
            return v if not size or v >> (size - 1) else v - (1 << size) + 1

        for _ in range(min(t.restart or n, n - k)):
            before += extended(symbol(t.dc))
            out[k, 0], place = before, 1
            while place < 64:
                s = symbol(t.ac)
                if not s:
                    break
                place += s >> 4
                if s & 15:
                    out[k, ZIGZAG[place]] = extended(s & 15)
                place += 1
            k += 1
    quant = np.zeros(64, np.int64)
    quant[list(ZIGZAG)] = t.quant[t.table]
    return out * quant


@cache
def cosines() -> np.ndarray:
    x, u = np.arange(8), np.arange(8)
    c = np.cos((2 * x[:, None] + 1) * u[None] * np.pi / 16) / 2
    c[:, 0] /= np.sqrt(2)
    return c


def picture(data: bytes) -> np.ndarray:
    """The samples of a frame, height x width."""
    t = Tables(data)
    c = blocks(data, t).reshape(-1, 8, 8).astype(float)
    cells = np.clip(np.rint(cosines() @ c @ cosines().T) + 128, 0, 255).astype(np.uint8)
    rows, cols = -(-t.height // 8), -(-t.width // 8)
    return cells.reshape(rows, cols, 8, 8).swapaxes(1, 2).reshape(8 * rows, 8 * cols)[: t.height, : t.width]


def samples(data: bytes, places) -> np.ndarray:
    """One sample for each block, (frames, blocks), of an AVI file's frames."""
    out = []
    start = head()
    known = tables(start)
    for lo, hi in places:
        if data.startswith(start, lo):
            t, at = known, lo + len(start)
        else:
            t = tables(data[lo : data.index(b"\xff\xda", lo) + 10])
            at = lo + t.start
        if t.pairs is None:
            c = blocks(data[lo:hi], t)
            out.append(np.clip(np.rint(c[:, 0] / 8) + 128, 0, 255).astype(np.uint8))
            continue
        body = data[at : hi - 2]
        diff = t.pairs[np.frombuffer(body.replace(b"\xff\0", b"\xff"), ">u2")]
        out.append((np.cumsum(diff) * int(t.quant[t.table][0]) // 8 + 128).astype(np.uint8))
    return np.stack(out) if out else np.zeros((0, FRAME), np.uint8)


def cuts(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first frames of all shots but the first, differences of neighbouring frames)."""
    n = len(x)
    hist = np.bincount((np.arange(n)[:, None] * BINS + (x >> 3)).ravel(), minlength=n * BINS).reshape(n, BINS) / max(x.shape[1], 1)
    d = np.abs(np.diff(hist, axis=0)).sum(1) / 2
    if not len(d):
        return np.zeros(0, np.int64), d
    i = np.arange(len(d))
    lo, hi = np.maximum(i - WINDOW, 0), np.minimum(i + WINDOW + 1, len(d))
    one, two = np.append(0, np.cumsum(d)), np.append(0, np.cumsum(d * d))
    mean = (one[hi] - one[lo]) / (hi - lo)
    spread = np.sqrt(np.maximum((two[hi] - two[lo]) / (hi - lo) - mean * mean, 0))
    peak = (d >= np.append(-1, d[:-1])) & (d > np.append(d[1:], -1))
    found, last = [], 0
    for k in (np.flatnonzero(peak & (d > mean + SIGMA * spread) & (d > LEAST)) + 1).tolist():
        if k - last >= SHORTEST:
            found.append(k)
            last = k
    return np.array(found, np.int64), d


CLIP_NAMES, CLIP_KINDS = ("clip", "start_s", "end_s", "frames", "largest"), (pa.int32(), pa.float64(), pa.float64(), pa.int64(), pa.float64())


def timed(first: np.ndarray, d: np.ndarray, n: int, rate: float) -> list[tuple[int, float, float, int, float]]:
    """(clip, start and end in seconds, frames, largest difference inside) of n frames."""
    edges = [0, *first.tolist(), n]
    return [(k, a / rate, b / rate, b - a, float(d[a : b - 1].max(initial=0.0))) for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False))]


def clips(data: bytes) -> list[tuple[int, float, float, int, float]]:
    """The timed clips of an AVI file."""
    places, rate = index(data)
    x = samples(data, places)
    return timed(*cuts(x), len(x), rate)


def padded(text: bytes) -> bytes:
    return text + b"\xff" * (-len(text) % FRAME if text else FRAME)


def to_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: every text as an AVI file."""

    def run(batches):
        for b in batches:
            data, off = raw(b.column("text"))
            for lo, hi in spans(off):
                text = data[off[lo] : off[hi]].tobytes()
                o = (off[lo : hi + 1] - off[lo]).tolist()
                payloads = [padded(text[a:z]) for a, z in zip(o, o[1:], strict=False)]
                jpegs = frames(np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, FRAME))
                at, media = 0, []
                for p in payloads:
                    n = len(p) // FRAME
                    media.append(avi(jpegs[at : at + n]))
                    at += n
                yield pa.record_batch([b.column("doc_id").slice(lo, hi - lo), pa.array([z - a for a, z in zip(o, o[1:], strict=False)], pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_col(docs).alias("text")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def features(media: DataFrame) -> DataFrame:
    """What the stored files hold: digests of payload and file; frames, shots, mean and cut places as a string; and the timed clips."""

    def run(batches):
        for b in batches:
            cols, shots = [[] for _ in range(6)], []
            for m in b.column("media"):
                file = m.as_py()
                places, rate = index(file)
                x = samples(file, places)
                payload = x.tobytes()
                first, d = cuts(x)
                shots.append([dict(zip(CLIP_NAMES, c, strict=True)) for c in timed(first, d, len(x), rate)])
                feature = f"frames={len(x)};shots={len(first) + 1};mean={int(x.sum(dtype=np.int64)) * 1000 // max(x.size, 1)};cuts={','.join(map(str, first.tolist()))}"
                for c, v in zip(cols, (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(file), hashlib.sha256(file).hexdigest(), feature), strict=True):
                    c.append(v)
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.record_batch([b.column("doc_id"), b.column("n_bytes"), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], pa.array(shots, pa.list_(pa.struct(list(zip(CLIP_NAMES, CLIP_KINDS, strict=True)))))], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "clips"])

    return media.mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, clips array<struct<clip: int, start_s: double, end_s: double, frames: long, largest: double>>")


def clip_rows(features: DataFrame) -> DataFrame:
    """doc_id, clip, start_s, end_s, frames, largest: the timed clips of every file, a row each."""
    return features.select("doc_id", F.explode("clips").alias("c")).select("doc_id", "c.*")
