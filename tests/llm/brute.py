"""Plain versions of the operators, for small tables."""

import hashlib
import re


def repeats(docs, window=50):
    first = {}
    for i, t in docs:
        b = (t or "").encode()
        for k in range(len(b) - window + 1):
            w = b[k : k + window]
            first[w] = min(i, first.get(w, i))
    out = {}
    for i, t in docs:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - window + 1):
            if first[b[k : k + window]] < i:
                gone[k : k + window] = b"\1" * window
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out[i] = (len(b), sum(gone), sum(1 for k in range(len(b)) if gone[k] and not (k and gone[k - 1])), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore"))
    return out


def shingles(text, n=3):
    words = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or "")) if x]
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1)) if len(words) >= n else frozenset([tuple(words)])


def components(docs, n=3, tenths=90):
    sets = {i: shingles(t, n) for i, t in docs}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if b < a and sets[a] and sets[b] and 100 * (both := len(sets[a] & sets[b])) >= tenths * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def top_k(rows, every=50, k=5):
    """The answers of each query's row, as a sorted list: rows of one id are apart."""
    from math import floor, isfinite

    v = [(i, [floor(256 * x) for x in e]) for i, e in rows if i is not None and e is not None and all(x is not None and isfinite(x) for x in e)]
    out = []
    for at, (q, a) in enumerate(v):
        if q % every == 0:
            scored = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), i) for other, (i, b) in enumerate(v) if other != at and len(b) == len(a))[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored)]
    return sorted(out)


def jpeg_dc(data):
    """(height, width, DC coefficients before quantization) of a baseline greyscale JPEG, from the standard's text: bits one by one."""
    at, huff, quant = 2, {}, {}
    while True:
        assert data[at] == 0xFF
        marker, size = data[at + 1], data[at + 2] * 256 + data[at + 3]
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xDB:
            assert body[0] >> 4 == 0
            quant[body[0] & 15] = body[1]
        elif marker == 0xC0:
            height, width = body[1] * 256 + body[2], body[3] * 256 + body[4]
            assert body[0] == 8 and body[5] == 1
        elif marker == 0xC4:
            symbols, table, code = list(body[17:]), {}, 0
            for length in range(1, 17):
                for _ in range(body[length]):
                    table[format(code, f"0{length}b")] = symbols.pop(0)
                    code += 1
                code *= 2
            huff[body[0]] = table
        elif marker == 0xDA:
            break
    scan = data[at : data.rindex(b"\xff\xd9")].replace(b"\xff\x00", b"\xff")
    bits = iter("".join(format(b, "08b") for b in scan))

    def symbol(table):
        code = ""
        while code not in table:
            code += next(bits)
        return table[code]

    out, before = [], 0
    for _ in range((height // 8) * (width // 8)):
        size = symbol(huff[0])
        text = "".join(next(bits) for _ in range(size))
        before += (int(text, 2) if text[0] == "1" else int(text, 2) - 2**size + 1) if size else 0
        assert symbol(huff[16]) == 0  # no other coefficient
        out.append(before * quant[0])
    return height, width, out


def avi_frames(data):
    """The frames of an AVI file by its index, from the format's text."""
    at = data.index(b"idx1")
    size = int.from_bytes(data[at + 4 : at + 8], "little")
    movi = data.index(b"movi")
    out = []
    for k in range(at + 8, at + 8 + size, 16):
        place, length = int.from_bytes(data[k + 8 : k + 12], "little"), int.from_bytes(data[k + 12 : k + 16], "little")
        assert data[movi + place : movi + place + 4] == b"00dc"
        out.append(data[movi + place + 8 : movi + place + 8 + length])
    return out


def shot_cuts(frames, bins=32, window=12, sigma=2.0, least=0.15, shortest=3):
    """First frames of all shots but the first."""
    hist = []
    for f in frames:
        h = [0] * bins
        for x in f:
            h[x * bins // 256] += 1
        hist.append([x / len(f) for x in h])
    d = [sum(abs(x - y) for x, y in zip(a, b, strict=True)) / 2 for a, b in zip(hist, hist[1:], strict=False)]
    found, last = [], 0
    for i, x in enumerate(d):
        near = d[max(i - window, 0) : i + window + 1]
        mean = sum(near) / len(near)
        spread = (sum((y - mean) ** 2 for y in near) / len(near)) ** 0.5
        peak = (i == 0 or x >= d[i - 1]) and (i + 1 == len(d) or x > d[i + 1])
        if peak and x > mean + sigma * spread and x > least and i + 1 - last >= shortest:
            found.append(i + 1)
            last = i + 1
    return found


def grams(text, dims):
    """Counts of a text's hashed 1- to 3-grams of lower-case letters."""
    import regex

    out, mask = {}, 2**64 - 1
    for word in regex.findall(r"\p{L}+", text or ""):
        c = [ord(x.lower()) if len(x.lower()) == 1 else ord(x) for x in word] + [0, 0]
        for i in range(len(c) - 2):
            one, two, three = c[i], c[i + 1], c[i + 2] if c[i + 1] else 0
            own = [one, one << 21 | two | 1 << 62, one << 42 | two << 21 | three | 1 << 63]
            if i == 0:
                own.append((one << 21 | two) ^ 0x5DEECE66D)
            for g in own:
                place = ((g & mask) * 0x9E3779B97F4A7C15 & mask) >> 64 - 13
                out[place] = out.get(place, 0) + 1
    assert dims == 1 << 13
    return out


def languages(learned, texts, k, steps, dims):
    """(language, cosine) of texts by the nearest of k centroids of TF-IDF vectors for each language; learned: (doc_id, text, lang)."""
    from math import log, sqrt

    counts = {i: grams(t, dims) for i, t, _ in learned}
    df = {}
    for c in counts.values():
        for p in c:
            df[p] = df.get(p, 0) + 1
    idf = lambda p: log((1 + len(counts)) / (1 + df.get(p, 0))) + 0.1

    def unit(v):
        n = sqrt(sum(x * x for x in v.values()))
        return {p: x / n for p, x in v.items()} if n else {}

    def dot(a, b):
        return sum(x * b.get(p, 0.0) for p, x in a.items())

    def mean(vs):
        out = {}
        for v in vs:
            for p, x in v.items():
                out[p] = out.get(p, 0.0) + x / len(vs)
        return out

    vector = lambda c: unit({p: (1 + log(n)) * idf(p) for p, n in c.items()})
    centroids = []
    for lang in sorted({r[2] for r in learned}):
        x = [v for v in (vector(counts[i]) for i, _, own in sorted(learned, key=lambda r: r[0]) if own == lang) if v]
        centre = [mean(x)]
        near = [dot(v, centre[0]) for v in x]
        for _ in range(min(k, len(x)) - 1):
            centre.append(x[min(range(len(x)), key=near.__getitem__)])
            near = [max(n, dot(v, centre[-1])) for n, v in zip(near, x, strict=True)]
        for _ in range(steps):
            c = [unit(v) for v in centre]
            own = [max(range(len(c)), key=lambda j: dot(v, c[j])) for v in x]
            centre = [mean([v for v, o in zip(x, own, strict=True) if o == j]) if j in own else c[j] for j in range(len(c))]
        centroids += [(lang, unit(c)) for c in centre]
    out = []
    for t in texts:
        v = vector(grams(t, dims))
        out.append(max(((dot(v, c), -n, lang) for n, (lang, c) in enumerate(centroids)), default=(0.0, 0, "und")) if v else (0.0, 0, "und"))
    return [(lang, score) for score, _, lang in out]


def token_rows(docs, path, end_id=2):
    """doc_id, start, n_tokens, ids_crc32 of (doc_id, text) in ascending doc_id, by the library alone."""
    import zlib

    import numpy as np
    from tokenizers import Tokenizer

    own, start, out = Tokenizer.from_file(path), 0, []
    for doc_id, text in sorted(docs):
        ids = np.array([*own.encode(text or "", add_special_tokens=False).ids, end_id], "<u4")
        out.append((doc_id, start, len(ids), zlib.crc32(ids)))
        start += len(ids)
    return out
