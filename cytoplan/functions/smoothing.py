"""Cubic smoothing splines: penalised least squares with banded matrices (Reinsch 1967), for code inside tasks."""

from __future__ import annotations

import numpy as np


def _bands(x: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonals 0 to 2 of R and of Q' W^-1 Q, and the three entries of each column of Q."""
    h = np.diff(x)
    q = np.stack([1 / h[:-1], -1 / h[:-1] - 1 / h[1:], 1 / h[1:]], 1)
    m = len(x) - 2
    r = np.zeros((3, m))
    r[0], r[1, : m - 1] = (h[:-1] + h[1:]) / 3, h[1:-1] / 6
    v = 1 / w
    s = np.zeros((3, m))
    s[0] = (q**2 * np.stack([v[:-2], v[1:-1], v[2:]], 1)).sum(1)
    s[1, : m - 1] = q[:-1, 1] * q[1:, 0] * v[1:-2] + q[:-1, 2] * q[1:, 1] * v[2:-1]
    if m > 2:
        s[2, : m - 2] = q[:-2, 2] * q[2:, 0] * v[2:-2]
    return r, s, q


def _factor(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """L D L' of a symmetric matrix given by its diagonals 0 to 2: D and the two lower diagonals of L."""
    m = a.shape[1]
    d, one, two = np.zeros(m), np.zeros(m), np.zeros(m)
    for i in range(m):
        back1 = one[i - 1] if i > 0 else 0.0
        back2 = two[i - 2] if i > 1 else 0.0
        d[i] = a[0, i] - (back1**2 * d[i - 1] if i > 0 else 0.0) - (back2**2 * d[i - 2] if i > 1 else 0.0)
        if i + 1 < m:
            one[i] = (a[1, i] - (back1 * two[i - 1] * d[i - 1] if i > 0 else 0.0)) / d[i]
        if i + 2 < m:
            two[i] = a[2, i] / d[i]
    return d, one, two


def _solve(d: np.ndarray, one: np.ndarray, two: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = b.astype(float).copy()
    m = len(d)
    for i in range(m):
        x[i] -= (one[i - 1] * x[i - 1] if i > 0 else 0.0) + (two[i - 2] * x[i - 2] if i > 1 else 0.0)
    x /= d
    for i in range(m - 2, -1, -1):
        x[i] -= one[i] * x[i + 1] + (two[i] * x[i + 2] if i + 2 < m else 0.0)
    return x


def _inverse_bands(d: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Diagonals 0 to 2 of the inverse (Hutchinson and de Hoog 1985)."""
    m = len(d)
    out = np.zeros((3, m + 2))
    for i in range(m - 1, -1, -1):
        l1, l2 = (one[i] if i + 1 < m else 0.0), (two[i] if i + 2 < m else 0.0)
        out[1, i] = -l1 * out[0, i + 1] - l2 * out[1, i + 1]
        out[2, i] = -l1 * out[1, i + 1] - l2 * out[0, i + 2]
        out[0, i] = 1 / d[i] - l1 * out[1, i] - l2 * out[2, i]
    return out[:, :m]


def fit(x: np.ndarray, y: np.ndarray, w: np.ndarray, penalty: float) -> tuple[np.ndarray, np.ndarray, float]:
    """Heights and second derivatives at x (ascending, different, three or more), and the trace of the smoother.

    Minimises the weighted squares plus penalty times the integral of the squared second derivative.
    """
    r, s, q = _bands(x, w)
    d, one, two = _factor(r + penalty * s)
    qy = q[:, 0] * y[:-2] + q[:, 1] * y[1:-1] + q[:, 2] * y[2:]
    g = _solve(d, one, two, qy)
    back = np.zeros(len(x))
    for k in range(3):
        back[k : k + len(g)] += q[:, k] * g
    inverse = _inverse_bands(d, one, two)
    trace = len(x) - penalty * float((s[0] * inverse[0]).sum() + 2 * (s[1] * inverse[1]).sum() + 2 * (s[2] * inverse[2]).sum())
    return y - penalty * back / w, np.concatenate(([0.0], g, [0.0])), trace


def penalty_of(x: np.ndarray, w: np.ndarray, spar: float) -> float:
    """The penalty of a smoothing parameter on the scale that statistics packages use: 256^(3 spar - 1) times the ratio of the traces of
    the weighted squares and of the squared second derivatives of the cubic B-splines over x (without the three at either end)."""
    knots = np.concatenate((np.repeat(x[0], 3), x, np.repeat(x[-1], 3)))

    def splines(at: np.ndarray, degree: int) -> np.ndarray:
        last = np.searchsorted(x, at, "right") - 1
        b = np.zeros((len(at), len(knots) - 1))
        b[np.arange(len(at)), np.minimum(last, len(x) - 2) + 3] = 1.0
        for d in range(1, degree + 1):
            left, right = knots[d:-1] - knots[: -d - 1], knots[d + 1 :] - knots[1:-d]
            with np.errstate(divide="ignore", invalid="ignore"):
                first = np.where(left > 0, (at[:, None] - knots[: -d - 1]) / left, 0.0)
                second = np.where(right > 0, (knots[d + 1 :] - at[:, None]) / right, 0.0)
            b = first * b[:, :-1] + second * b[:, 1:]
        return b

    def bends(at: np.ndarray) -> np.ndarray:
        b = splines(at, 1)
        for d in (2, 3):
            width = knots[d:-1] - knots[: -d - 1], knots[d + 1 :] - knots[1:-d]
            with np.errstate(divide="ignore", invalid="ignore"):
                b = d * (np.where(width[0] > 0, b[:, :-1] / width[0], 0.0) - np.where(width[1] > 0, b[:, 1:] / width[1], 0.0))
        return b

    size = len(x) + 2
    own = slice(2, size - 3)
    squares = (w[:, None] * splines(x, 3)[:, :size] ** 2).sum(0)
    h = np.diff(x)
    # Second derivatives are straight between knots: Simpson's rule is exact.
    ends = [bends(x[:-1] + f * h)[:, :size] for f in (1e-12, 0.5, 1 - 1e-12)]
    bent = (h[:, None] / 6 * (ends[0] ** 2 + 4 * ends[1] ** 2 + ends[2] ** 2)).sum(0)
    return float(squares[own].sum() / bent[own].sum()) * 256.0 ** (3 * spar - 1)


def smoothing_spline(x: np.ndarray, y: np.ndarray, w: np.ndarray | None = None, n: np.ndarray | None = None, at: np.ndarray | None = None, spar: float | None = None) -> np.ndarray:
    """Heights of the natural cubic smoothing spline at places `at` (x itself if None), straight beyond the ends.

    y: means of n values of total weight w at each x (ascending, different). spar: the penalty on its scale; without, that of least generalised
    cross-validation. Fewer than three places are joined by a line, and so are three with spar.
    """
    at = x if at is None else at
    if len(x) < 3 or len(x) < 4 and spar is not None:
        return np.interp(at, x, y)
    w = np.ones(len(x)) if w is None else np.maximum(w, 1e-12 * w.max())
    total = len(x) if n is None else n.sum()
    width = x[-1] - x[0]
    t, w = (x - x[0]) / width, w / w.mean()
    best = (np.inf, fit(t, y, w, 1e-12 if spar is None else penalty_of(t, w, spar))[:2])
    for power in np.linspace(-12, 3, 61) if spar is None else ():
        heights, bends, trace = fit(t, y, w, 10.0**power)
        score = (w * (y - heights) ** 2).sum() / (1 - trace / total) ** 2 if total - trace > 1e-6 else np.inf
        if score < best[0] * (1 - 1e-9):
            best = (score, (heights, bends))
    return evaluate(t, *best[1], (at - x[0]) / width)


def evaluate(x: np.ndarray, heights: np.ndarray, bends: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The natural cubic spline with these heights and second derivatives."""
    h = np.diff(x)
    i = np.clip(np.searchsorted(x, at, "right") - 1, 0, len(x) - 2)
    u = (at - x[i]) / h[i]
    inside = heights[i] * (1 - u) + heights[i + 1] * u + h[i] ** 2 / 6 * (((1 - u) ** 3 - (1 - u)) * bends[i] + (u**3 - u) * bends[i + 1])
    first = (heights[1] - heights[0]) / h[0] - h[0] / 6 * bends[1]
    last = (heights[-1] - heights[-2]) / h[-1] + h[-1] / 6 * bends[-2]
    return np.where(at < x[0], heights[0] + first * (at - x[0]), np.where(at > x[-1], heights[-1] + last * (at - x[-1]), inside))
