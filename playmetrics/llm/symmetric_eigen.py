"""Leading eigenpairs of a symmetric matrix whose side is the vectors' length.

Householder reflections make it tridiagonal, Sturm counts bisect for the largest eigenvalues,
inverse iteration gives vectors; those of eigenvalues that lie close are kept orthogonal.
"""

from __future__ import annotations

import numpy as np

EPS = float(np.finfo(np.float64).eps)
#: Eigenvalues closer than this share of the norm are one cluster.
CLUSTER = 1e-3


def tridiagonal(a: np.ndarray):
    """(diagonal, off-diagonal, reflectors): reflector k leaves the first k + 1 entries alone."""
    a = np.array(a, np.float64)
    n = len(a)
    reflectors = []
    for k in range(n - 2):
        v = a[k + 1:, k].copy()
        scale = np.abs(v[1:]).max(initial=0.0)
        if scale == 0.0:
            reflectors.append(None)
            continue
        v /= max(scale, abs(v[0]))
        v[0] += np.copysign(np.linalg.norm(v), v[0])
        v /= np.linalg.norm(v)
        rest = a[k + 1:, k + 1:]
        p = rest @ v
        w = 2 * (p - (v @ p) * v)
        rest -= np.outer(v, w) + np.outer(w, v)
        column = a[k + 1:, k]
        column -= 2 * v * (v @ column)
        a[k, k + 1:] = column
        reflectors.append(v)
    return np.diag(a).copy(), np.diag(a, -1).copy(), reflectors


def back(reflectors, z: np.ndarray) -> np.ndarray:
    """A vector of the tridiagonal matrix, for the matrix before."""
    z = z.copy()
    for k in range(len(reflectors) - 1, -1, -1):
        v = reflectors[k]
        if v is not None:
            z[k + 1:] -= 2 * v * (v @ z[k + 1:])
    return z


def counts_below(d: np.ndarray, e: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many eigenvalues lie below each of ``at``: the negative pivots of T - at."""
    tiny = max(float((e ** 2).max(initial=0.0)), 1.0) * np.finfo(np.float64).tiny
    found, square = np.zeros(len(at), np.int64), np.concatenate([[0.0], e ** 2])
    q = np.ones(len(at))
    for i in range(len(d)):
        q = d[i] - at - square[i] / q
        q = np.where(np.abs(q) < tiny, -tiny, q)
        found += q < 0
    return found


def largest_values(d: np.ndarray, e: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` largest eigenvalues of the tridiagonal matrix, falling."""
    radius = np.abs(np.concatenate([e, [0.0]])) + np.abs(np.concatenate([[0.0], e]))
    low, high = (d - radius).min(), (d + radius).max()
    pad = 2 * EPS * max(abs(low), abs(high)) + np.finfo(np.float64).tiny
    lo, hi = np.full(k, low - pad), np.full(k, high + pad)
    rank = len(d) - np.arange(k)  # so many eigenvalues are at most the wanted one
    for _ in range(200):
        middle = (lo + hi) / 2
        if ((middle <= lo) | (middle >= hi)).all():
            break
        below = counts_below(d, e, middle) >= rank
        hi, lo = np.where(below, middle, hi), np.where(below, lo, middle)
    return (lo + hi) / 2


class Shifted:
    """T - shift, factored with row exchanges."""

    def __init__(self, d: np.ndarray, e: np.ndarray, shift: float, least: float):
        n = len(d)
        main, upper, second = (d - shift).tolist(), [*e.tolist(), 0.0], [0.0] * n
        lower = e.tolist()
        self.steps = []
        for i in range(n - 1):
            if abs(main[i]) >= abs(lower[i]):
                if main[i] == 0.0:
                    main[i] = least
                factor = lower[i] / main[i]
                main[i + 1] -= factor * upper[i]
                self.steps.append((False, factor))
            else:
                factor = main[i] / lower[i]
                main[i], upper[i], below = lower[i], main[i + 1], upper[i]
                main[i + 1] = below - factor * upper[i]
                second[i], after = upper[i + 1], upper[i + 1]
                upper[i + 1] = -factor * after
                self.steps.append((True, factor))
        self.main = [x if abs(x) >= least else (least if x >= 0 else -least) for x in main]
        self.upper, self.second = upper, second

    def solve(self, b: np.ndarray) -> np.ndarray:
        x = b.tolist()
        n = len(x)
        for i, (swap, factor) in enumerate(self.steps):
            if swap:
                x[i], x[i + 1] = x[i + 1], x[i]
            x[i + 1] -= factor * x[i]
        for i in range(n - 1, -1, -1):
            got = x[i]
            if i + 1 < n:
                got -= self.upper[i] * x[i + 1]
            if i + 2 < n:
                got -= self.second[i] * x[i + 2]
            x[i] = got / self.main[i]
        return np.array(x)


def vectors(d: np.ndarray, e: np.ndarray, values: np.ndarray, seed: int = 42) -> np.ndarray:
    """Unit vectors for ``values`` (falling), as rows."""
    n = len(d)
    norm = max(np.abs(d).max(), np.abs(e).max(initial=0.0), np.finfo(np.float64).tiny)
    rng = np.random.default_rng(seed)
    out, first, last = np.empty((len(values), n)), 0, None
    for k, value in enumerate(values):
        if k and values[k - 1] - value > CLUSTER * norm:
            first, last = k, None
        shift = value if last is None else min(value, last - 10 * EPS * norm)
        last = shift
        solver = Shifted(d, e, shift, EPS * norm)
        z = rng.normal(size=n)
        for _ in range(8):
            z = solver.solve(z / np.abs(z).max())
            z /= np.abs(z).max()
            for _ in range(2):  # twice is enough
                z -= out[first:k].T @ (out[first:k] @ z)
            z /= np.linalg.norm(z)
            r = (d - value) * z
            r[:-1] += e * z[1:]
            r[1:] += e * z[:-1]
            if np.abs(r).max() <= 16 * EPS * norm:
                z = solver.solve(z)  # once more, which costs little
                z /= np.abs(z).max()
                for _ in range(2):
                    z -= out[first:k].T @ (out[first:k] @ z)
                z /= np.linalg.norm(z)
                break
        out[k] = z
    return out


def leading(a: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues, falling, and their unit vectors as rows.

    Each vector's entry of the largest size is positive.
    """
    k = min(k, len(a))
    scale = np.abs(a).max(initial=0.0)
    if not k or scale == 0.0:
        return np.zeros(k), np.eye(k, len(a))
    d, e, reflectors = tridiagonal(a / scale)
    values = largest_values(d, e, k)
    found = np.array([back(reflectors, z) for z in vectors(d, e, values)])
    sign = np.sign(found[np.arange(k), np.abs(found).argmax(1)])
    return values * scale, found * sign[:, None]
