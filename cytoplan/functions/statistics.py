"""Special functions and spline bases on arrays, for code inside tasks."""

from __future__ import annotations

import numpy as np


def log_gamma(x: np.ndarray) -> np.ndarray:
    """ln of the gamma function for x > 0: Stirling's series behind eight steps of the recurrence."""
    x = np.asarray(x, float)
    z = x + 8
    series = (z - 0.5) * np.log(z) - z + 0.5 * np.log(2 * np.pi) + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5)
    return series - sum(np.log(x + k) for k in range(8))


def digamma(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, float)
    z = x + 8
    return np.log(z) - 1 / (2 * z) - 1 / (12 * z**2) + 1 / (120 * z**4) - 1 / (252 * z**6) - sum(1 / (x + k) for k in range(8))


def trigamma(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, float)
    z = x + 8
    return 1 / z + 1 / (2 * z**2) + 1 / (6 * z**3) - 1 / (30 * z**5) + 1 / (42 * z**7) + sum(1 / (x + k) ** 2 for k in range(8))


def inverse_trigamma(y: float) -> float:
    """x with trigamma(x) = y, by bisection: the function falls."""
    low, high = 1e-8, 1e8
    for _ in range(200):
        mid = np.sqrt(low * high)
        low, high = (mid, high) if trigamma(mid) > y else (low, mid)
    return float(np.sqrt(low * high))


def incomplete_beta(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The regularised incomplete beta function by its continued fraction."""
    a, b, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(b, float), np.clip(np.asarray(x, float), 0, 1))
    swap = x > (a + 1) / (a + b + 2)
    p, q, t = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)
    tiny = 1e-300
    away = lambda v: np.where(np.abs(v) < tiny, tiny, v)
    with np.errstate(all="ignore"):
        d = 1 / away(1 - (p + q) * t / (p + 1))
        c, f = np.ones_like(t), d
        for m in range(1, 400):
            even = m * (q - m) * t / ((p + 2 * m - 1) * (p + 2 * m))
            odd = -(p + m) * (p + q + m) * t / ((p + 2 * m) * (p + 2 * m + 1))
            for term in (even, odd):
                d, c = 1 / away(1 + term * d), away(1 + term / c)
                f = f * c * d
            if np.all(np.abs(c * d - 1) < 1e-14):
                break
        front = np.exp(log_gamma(p + q) - log_gamma(p) - log_gamma(q) + p * np.log(np.maximum(t, tiny)) + q * np.log(np.maximum(1 - t, tiny))) / p
    got = np.where(t <= 0, 0.0, front * f)
    return np.where(swap, 1 - got, got)


def f_tail(f: np.ndarray, d1: float, d2: np.ndarray) -> np.ndarray:
    """P(F > f) of the F distribution; d2 may be infinite."""
    d2 = np.minimum(np.asarray(d2, float), 1e7)
    return incomplete_beta(d2 / 2, d1 / 2, d2 / (d2 + d1 * np.maximum(np.asarray(f, float), 0)))


def natural_basis(x: np.ndarray, knots: np.ndarray) -> np.ndarray:
    """Columns that, with a constant, span the cubic splines with straight ends over these knots (len(knots) - 1 columns)."""
    x, knots = np.asarray(x, float), np.asarray(knots, float)
    width = knots[-1] - knots[0]
    bend = lambda k: (np.maximum(x - knots[k], 0) ** 3 - np.maximum(x - knots[-1], 0) ** 3) / (knots[-1] - knots[k])
    last = bend(len(knots) - 2)
    return np.stack([(x - knots[0]) / width, *((bend(k) - last) / width**2 for k in range(len(knots) - 2))], 1)


def spline_knots(x: np.ndarray, df: int) -> np.ndarray:
    """Ends and df - 1 inner knots at equally spaced quantiles."""
    return np.quantile(np.asarray(x, float), np.linspace(0, 1, df + 1))
