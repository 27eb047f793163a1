"""Leading right singular vectors of a small square matrix: Householder bidiagonalisation, dqds, twisted factorisations."""

from __future__ import annotations

import numpy as np

EPS = np.finfo(float).eps
TOL2 = (100 * EPS) ** 2
#: Eigenvalues nearer than this, relatively, have their vectors made orthogonal to each other.
NEAR = 1e-3


def bidiagonalise(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(diagonal, superdiagonal, right reflectors) of r = U B V'; V is the product of the reflectors, the first leftmost."""
    r, n, right = np.array(r, float), len(r), []
    for k in range(n):
        if (v := reflector(r[k:, k])) is not None:
            r[k:, k:] -= np.outer(2 * v, v @ r[k:, k:])
        if k + 2 < n:
            if (v := reflector(r[k, k + 1 :])) is not None:
                r[k:, k + 1 :] -= np.outer(r[k:, k + 1 :] @ v, 2 * v)
            right.append(v)
    return np.diag(r).copy(), np.diag(r, 1).copy(), right


def reflector(x: np.ndarray) -> np.ndarray | None:
    """The unit vector v for which x - 2 v (v x) has no component beyond the first; None if it has none."""
    most = np.abs(x).max(initial=0.0)
    if not most or not x[1:].any():
        return None
    v = x / most
    v[0] += np.copysign(np.sqrt(v @ v), v[0])
    return v / np.sqrt(v @ v)


def reflected(z: np.ndarray, right: list[np.ndarray]) -> np.ndarray:
    """V z."""
    for k in range(len(right) - 1, -1, -1):
        if (v := right[k]) is not None:
            z[k + 1 :] -= 2 * v * (v @ z[k + 1 :])
    return z


def dqds(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float], list[float]]:
    """One transform of the squared diagonal and superdiagonal, less a shift; and its d."""
    d, ds, qs, es = q[0] - shift, [], [], []
    for k, off in enumerate(e):
        ds.append(d)
        now = d + off
        qs.append(now)
        if now == 0:
            es.append(0.0)
            d = q[k + 1] - shift
        else:
            t = q[k + 1] / now
            es.append(off * t)
            d = d * t - shift
    ds.append(d)
    return [*qs, d], es, ds


def squares(q: list[float], e: list[float]) -> list[float]:
    """The squared singular values, each to nearly full relative accuracy.

    A shift is at most 1 / (sum of the reciprocals of d without a shift), which is 1 / trace of the inverse and so never
    above the least of them.
    """
    out, work = [], [(q, e, 0.0)]
    while work:
        q, e, sigma = work.pop()
        while len(q) > 1:
            cut = next((k for k in range(len(e) - 1, -1, -1) if e[k] <= TOL2 * (sigma + q[k + 1]) or e[k] <= TOL2 * TOL2 * q[k]), None)
            if cut == len(e) - 1:
                out.append(sigma + q[-1])
                q, e = q[:-1], e[:-1]
                continue
            if cut is not None:
                work.append((q[: cut + 1], e[:cut], sigma))
                q, e = q[cut + 1 :], e[cut + 1 :]
                continue
            if 1.5 * q[0] < q[-1]:
                q, e = q[::-1], e[::-1]
            plain = dqds(q, e, 0.0)
            tau = (1 - 1e-10) / sum(1 / d for d in plain[2]) if min(plain[2]) > 0 else 0.0
            if sigma + tau > sigma:
                shifted = dqds(q, e, tau)
                if min(shifted[0]) >= 0 and min(shifted[1]) >= 0:
                    q, e, sigma = shifted[0], shifted[1], sigma + tau
                    continue
            q, e = plain[0], plain[1]
        out += [sigma + x for x in q]
    return sorted(out, reverse=True)


def twisted(a: np.ndarray, b: np.ndarray, value: float, others: list[np.ndarray]) -> np.ndarray:
    """The unit eigenvector of B'B near an eigenvalue, orthogonal to others (of values nearby).

    B'B - value = N G N' with ones on the diagonal of N, from the stationary qd transform above the twist and the
    progressive one below; the twist stands where the entry of G is least, so that its row solves for the vector.
    """
    n = len(a)
    tiny = EPS * EPS * max(float((a * a).max()), np.finfo(float).tiny / EPS**2)
    d = np.where(np.abs(a) < EPS * np.abs(a).max(), EPS * np.abs(a).max(), np.abs(a)) ** 2
    low = b * a[: n - 1] / d[: n - 1]
    for _ in range(3):
        down, up, s, p = np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n)  # factors below and above the twist
        s[0], p[-1] = -value, d[-1] - value
        for i in range(n - 1):
            pivot = s[i] + d[i]
            down[i] = d[i] * low[i] / (pivot if abs(pivot) > tiny else tiny)
            s[i + 1] = down[i] * low[i] * s[i] - value
        for i in range(n - 2, -1, -1):
            pivot = d[i] * low[i] ** 2 + p[i + 1]
            t = d[i] / (pivot if abs(pivot) > tiny else tiny)
            up[i], p[i] = low[i] * t, p[i + 1] * t - value
        gamma = s + p + value
        gamma = np.where(np.isfinite(gamma), gamma, np.inf)
        best = None
        for twist in np.argsort(np.abs(gamma), kind="stable")[: len(others) + 1].tolist():
            z = np.zeros(n)
            z[twist] = 1.0
            for i in range(twist - 1, -1, -1):
                z[i] = -down[i] * z[i + 1]
            for i in range(twist, n - 1):
                z[i + 1] = -up[i] * z[i]
            square = z @ z
            z, step = z / np.sqrt(square), gamma[twist] / square
            for other in [*others, *others]:
                z = z - other * (other @ z)
            left = np.sqrt(z @ z)
            if best is None or left > 2 * best[0]:
                best = left, z / max(left, np.finfo(float).tiny), step
        if others or not abs(best[2]) > EPS * value:
            break
        value += best[2]  # Rayleigh's quotient
    return best[1]


def leading(r: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(all squared singular values, falling; the k first right singular vectors as columns)."""
    a, b, right = bidiagonalise(r)
    n, scale = len(a), max(np.abs(a).max(initial=0.0), np.abs(b).max(initial=0.0))
    if not scale:
        return np.zeros(n), np.eye(n)[:, :k]
    a, b = a / scale, b / scale
    edges = [0, *(np.flatnonzero(np.abs(b) <= EPS * 0.5 * (np.abs(a[:-1]) + np.abs(a[1:]))) + 1).tolist(), n]
    found = []
    for lo, hi in zip(edges[:-1], edges[1:], strict=True):
        found += [(value, lo, hi) for value in squares((a[lo:hi] ** 2).tolist(), (b[lo : hi - 1] ** 2).tolist())]
    found.sort(key=lambda f: (-f[0], f[1]))
    out: list[tuple[float, int, np.ndarray]] = []
    for value, lo, hi in found[:k]:
        if value <= 0:
            near = [z for _, _, z in out]  # what is left of the space, in any order
            z = max((np.eye(n)[i] - sum((u * u[i] for u in near), np.zeros(n)) for i in range(n)), key=lambda z: z @ z)
            z /= np.sqrt(z @ z)
        else:
            near = [z[lo:hi] for v, at, z in out if at == lo and v - value <= NEAR * v]
            z = np.zeros(n)
            z[lo:hi] = twisted(a[lo:hi], b[lo : hi - 1], value, near) if hi - lo > 1 else 1.0
        out.append((value, lo, z))
    vectors = np.stack([reflected(z.copy(), right) for _, _, z in out], 1)
    return np.array([f[0] for f in found]) * scale**2, vectors
