"""Dispersions along abundance and for each gene, and the prior of the genes' variances.

Each gene has its adjusted profile likelihood on a grid of log dispersions. Genes are dealt to BINS ranges of abundance; a range's summed curves are
all that the driver sees of it, whatever the number of genes (with fewer genes each is a range of its own). There a local
likelihood fit (Loader 1999) of a line in abundance, weighted by the tricube of the distance to the nearest share of the genes, gives the trend. A gene's own dispersion
maximises its curve plus the trend's, weighted by the prior's share of degrees of freedom (weighted likelihood, McCarthy et al. 2012).

The prior of the variances is a scaled inverse chi-square (Smyth 2004), its scale a constant or a spline of abundance. The robust one takes Winsorised
moments, and genes whose variance is further out than their rank explains have fewer prior degrees of freedom (Phipson et al. 2016), down to where
the largest one is at the median of its distribution.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cytoplan.functions.ranking import bounds_of, value_ranks
from cytoplan.functions.settle import settled
from cytoplan.functions.statistics import digamma, f_tail, inverse_trigamma, log_gamma, natural_basis, trigamma

#: Dispersions that curves are evaluated at, as logs.
GRID = np.log(0.1) + np.log(2) * np.linspace(-10, 6, 33)
BINS = 200
#: Genes from which the trend has a slope.
SLOPED = 50
#: Winsorised shares of the log variances.
TAILS = (0.05, 0.1)
_FINE = 8


def peak(curves: np.ndarray) -> np.ndarray:
    """The log dispersion of the maximum of each curve, by a parabola through its highest point and the two beside it."""
    curves = np.atleast_2d(curves)
    top = curves.argmax(1)
    mid = np.clip(top, 1, len(GRID) - 2)
    a, b, c = (curves[np.arange(len(curves)), mid + k] for k in (-1, 0, 1))
    bend = a - 2 * b + c
    shift = np.where((bend < 0) & (mid == top), 0.5 * (a - c) / np.where(bend < 0, bend, -1.0), top - mid)
    return GRID[0] + (mid + shift) * (GRID[1] - GRID[0])


def finer(curves: np.ndarray) -> np.ndarray:
    """Curves at _FINE times as many places, by the natural cubic spline through their values."""
    n = len(GRID)
    inner = 2 * np.eye(n - 2) * 2 + np.eye(n - 2, k=1) + np.eye(n - 2, k=-1)
    second = np.zeros_like(curves)
    second[:, 1:-1] = np.linalg.solve(inner, 6 * (curves[:, 2:] - 2 * curves[:, 1:-1] + curves[:, :-2]).T).T
    at = np.arange((n - 1) * _FINE + 1) / _FINE
    i = np.minimum(at.astype(int), n - 2)
    t = at - i
    line = curves[:, i] * (1 - t) + curves[:, i + 1] * t
    return line + ((1 - t) ** 3 - (1 - t)) / 6 * second[:, i] + (t**3 - t) / 6 * second[:, i + 1]


@dataclass
class Trend:
    """Abundances, in ascending order; the log dispersion there; and the mean curve of a gene there."""

    x: np.ndarray
    log_dispersion: np.ndarray
    curves: np.ndarray

    def at(self, x: np.ndarray) -> np.ndarray:
        return np.exp(np.interp(x, self.x, self.log_dispersion))

    def curves_at(self, x: np.ndarray) -> np.ndarray:
        place = np.interp(x, self.x, np.arange(len(self.x)))
        low = np.minimum(place.astype(int), max(0, len(self.x) - 2))
        share = (place - low)[:, None]
        return self.curves[low] * (1 - share) + self.curves[np.minimum(low + 1, len(self.x) - 1)] * share


def local_trend(x: np.ndarray, n: np.ndarray, curves: np.ndarray) -> Trend:
    """The trend over ranges of n genes at abundance x with summed curves."""
    genes = n.sum()
    span = 1.0 if genes <= 50 else 0.25 + 0.75 * np.sqrt(50 / genes)
    fine, unit = finer(curves), (GRID[1] - GRID[0]) / _FINE
    slopes = np.linspace(-2, 2, 21) if genes >= SLOPED else np.zeros(1)
    out, smooth = [], []
    for own in x:
        far = np.abs(x - own)
        order = np.argsort(far, kind="stable")
        width = max(far[order[min(len(x) - 1, int(np.searchsorted(np.cumsum(n[order]), span * genes)))]], 1e-9) * 1.0001
        w = np.maximum(1 - (far / width) ** 3, 0) ** 3
        near = np.flatnonzero(w > 0)
        away = x[near] - own

        def shifted(levels: np.ndarray, slope: float, near=near, away=away, w=w) -> np.ndarray:
            """Weighted sums of the curves along lines of these levels."""
            at = np.clip((levels[:, None] + slope * away - GRID[0]) / unit, 0, fine.shape[1] - 1.000001)
            i = at.astype(int)
            t = at - i
            return ((fine[near, i] * (1 - t) + fine[near, i + 1] * t) * w[near]).sum(1)

        levels, tried, best = GRID, slopes, (0.0, 0.0)
        gap = slopes[1] - slopes[0] if len(slopes) > 1 else 0.0
        for _ in range(5):
            heights = np.stack([shifted(levels, s) for s in tried], 1)
            top = np.unravel_index(heights.argmax(), heights.shape)
            best = (levels[top[0]], tried[top[1]])
            apart = (levels[1] - levels[0]) / 4
            levels = np.clip(best[0] + apart * np.arange(-6, 7), GRID[0], GRID[-1])
            gap /= 4
            tried = best[1] + gap * np.arange(-6, 7) if gap else slopes
        out.append(best[0])
        smooth.append(shifted(GRID, best[1]) / (w * n).sum())
    return Trend(x, np.array(out), np.array(smooth))


def fit_trend(genes: DataFrame) -> tuple[float, Trend]:
    """The common dispersion and the trend of genes: logcpm and curve (an array over GRID)."""
    bounds = np.array(bounds_of(genes, "logcpm", BINS))

    def sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            x, own = frame["logcpm"].to_numpy(float), np.stack(frame["curve"].to_numpy())
            bins, at = np.unique(np.searchsorted(bounds, x), return_inverse=True)
            rows = np.zeros((len(bins), 2 + len(GRID)))
            np.add.at(rows, at, np.column_stack((np.ones(len(x)), x, own)))
            yield pd.DataFrame({"bin": np.repeat(bins, rows.shape[1]), "k": np.tile(np.arange(rows.shape[1]), len(bins)), "s": rows.ravel()})

    # BINS times the grid's places at most reach the driver.
    got = genes.select("logcpm", "curve").mapInPandas(sums, "bin long, k long, s double").groupBy("bin", "k").agg(F.sum("s").alias("s")).toPandas()
    table = got.pivot(index="bin", columns="k", values="s").sort_index().to_numpy()
    n, x, curves = table[:, 0], table[:, 1] / table[:, 0], table[:, 2:]
    return float(np.exp(peak(curves.sum(0))[0])), local_trend(x, n, curves)


def moderated(curves: np.ndarray, x: np.ndarray, trend: Trend, weight: float) -> np.ndarray:
    """Dispersions of genes between their own curves and the trend; weight: how many genes the trend counts as."""
    if np.isinf(weight):
        return trend.at(x)
    return np.exp(peak(curves + weight * trend.curves_at(x)))


def log_f_moments(d1: float, d2: float, tails: tuple[float, float] = TAILS) -> tuple[float, float]:
    """Mean and variance of the log of an F variable whose tails are drawn in to the quantiles there."""
    d2 = min(d2, 1e7)
    spread = np.sqrt(trigamma(d1 / 2) + trigamma(d2 / 2))
    t = digamma(d1 / 2) - np.log(d1 / 2) - digamma(d2 / 2) + np.log(d2 / 2) + spread * np.linspace(-30, 30, 20_001)
    log_density = d1 / 2 * (np.log(d1 / d2) + t) - (d1 + d2) / 2 * np.log1p(d1 / d2 * np.exp(np.minimum(t, 600))) + log_gamma((d1 + d2) / 2) - log_gamma(d1 / 2) - log_gamma(d2 / 2)
    p = np.exp(log_density)
    p /= p.sum()
    below = np.cumsum(p) - p / 2
    drawn = np.clip(t, np.interp(tails[0], below, t), np.interp(1 - tails[1], below, t))
    mean = float((p * drawn).sum())
    return mean, float((p * (drawn - mean) ** 2).sum())


@dataclass
class Prior:
    """Degrees of freedom of most genes, and of the furthest outlier; the scale's coefficients on a basis of abundance."""

    df: float
    outlier_df: float
    coefficients: np.ndarray
    knots: np.ndarray

    def variance(self, x: np.ndarray) -> np.ndarray:
        return np.exp(basis(x, self.knots) @ self.coefficients)


def basis(x: np.ndarray, knots: np.ndarray) -> np.ndarray:
    one = np.ones((len(x), 1))
    return one if len(knots) < 3 else np.concatenate((one, natural_basis(x, knots)), 1)


def _sums(genes: DataFrame, of: Callable[[pd.DataFrame], np.ndarray]) -> np.ndarray:
    """Sums over all genes of what a frame of genes gives, an array of fixed length."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            s = of(frame)
            yield pd.DataFrame({"k": np.arange(len(s)), "s": s})

    got = dict(genes.mapInPandas(run, "k long, s double").groupBy("k").agg(F.sum("s")).collect())
    return np.array([got[k] for k in sorted(got)])


def fit_prior(genes: DataFrame, free: float, robust: bool = True, abundance_trend: bool = False) -> Prior:
    """The prior of the variances of genes: logcpm and variance, on `free` degrees of freedom each."""
    own = genes.select("logcpm", F.log("variance").alias("z"))
    n = own.count()
    pieces = 1 + (n >= 3) + (n >= 6) + (n >= 30) if abundance_trend else 1
    knots = np.unique(np.array(own.agg(F.percentile("logcpm", F.array(*(F.lit(k / (pieces - 1)) for k in range(pieces))))).first()[0], float)) if pieces > 2 else np.zeros(0)

    def regression(low: float, high: float, centre: np.ndarray | None) -> np.ndarray:
        """Coefficients of the log variances, with residuals from `centre` drawn in to low and high."""

        def of(frame: pd.DataFrame) -> np.ndarray:
            b, z = basis(frame["logcpm"].to_numpy(float), knots), frame["z"].to_numpy(float)
            z = z if centre is None else b @ centre + np.clip(z - b @ centre, low, high)
            return np.concatenate(((b.T @ b).ravel(), b.T @ z))

        s = _sums(own, of)
        p = len(knots) if len(knots) >= 3 else 1
        return np.linalg.lstsq(s[: p * p].reshape(p, p), s[p * p :], rcond=None)[0]

    def residuals(centre: np.ndarray) -> DataFrame:
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                yield pd.DataFrame({"r": frame["z"] - basis(frame["logcpm"].to_numpy(float), knots) @ centre})

        return own.mapInPandas(run, "r double")

    def tails(centre: np.ndarray) -> tuple[float, float]:
        return tuple(residuals(centre).agg(F.percentile("r", F.lit(TAILS[0])), F.percentile("r", F.lit(1 - TAILS[1]))).first())

    centre = regression(-np.inf, np.inf, None)
    low, high = -np.inf, np.inf
    if robust:
        centre = regression(*tails(centre), centre)
        low, high = tails(centre)
    drawn = F.least(F.greatest(F.col("r"), F.lit(float(low))), F.lit(float(high)))
    mean, spread = residuals(centre).agg(F.avg(drawn), F.var_pop(drawn)).first()
    spread *= n / max(1, n - len(centre))
    ends = TAILS if robust else (0.0, 0.0)
    if robust:
        few, many = -6.0, np.log(1e7)
        if spread <= log_f_moments(free, 1e7, ends)[1]:
            df = np.inf
        else:
            for _ in range(60):
                mid = (few + many) / 2
                few, many = (mid, many) if log_f_moments(free, np.exp(mid), ends)[1] > spread else (few, mid)
            df = float(np.exp(few))
        centre[0] += mean - log_f_moments(free, df, ends)[0]
    else:
        beyond = spread - float(trigamma(free / 2))
        df = 2 * inverse_trigamma(beyond) if beyond > 0 else np.inf
        centre[0] += mean - float(digamma(free / 2) - np.log(free / 2)) + (float(digamma(df / 2) - np.log(df / 2)) if np.isfinite(df) else 0.0)
    return Prior(df, df, centre, knots)


def with_prior(genes: DataFrame, free: float, robust: bool = True, abundance_trend: bool = False) -> tuple[DataFrame, Prior]:
    """genes with prior_df and prior_variance, and what they share. genes: gene_id, logcpm, variance and others."""
    prior = fit_prior(genes, free, robust, abundance_trend)
    n = genes.count()
    most = n * free  # no more than all genes have together

    def scaled(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            s0 = prior.variance(frame["logcpm"].to_numpy(float))
            f = frame["variance"].to_numpy(float) / s0
            yield pd.DataFrame({"gene_id": frame["gene_id"], "prior_variance": s0, "f": f, "tail": f_tail(f, free, min(prior.df, most))})

    kind = dict(genes.dtypes)["gene_id"]
    own = settled(genes.select("gene_id", "logcpm", "variance").mapInPandas(scaled, f"gene_id {kind}, prior_variance double, f double, tail double"))
    if robust:
        ranks = value_ranks(own, "f")
        expected = (F.lit(n) - F.col("below") - (F.col("n") + 1) / 2 + 0.5) / n
        own = settled(own.join(ranks, own.f == ranks.value).select("gene_id", "prior_variance", "f", F.least(F.lit(1.0), F.col("tail") / expected).alias("usual")))
        furthest = own.agg(F.max("f"), F.min("usual")).first()
        if furthest[1] < 1:
            few, many = -12.0, float(np.log(min(prior.df, most)))
            for _ in range(60):
                mid = (few + many) / 2
                few, many = (mid, many) if f_tail(np.array([furthest[0]]), free, np.exp(mid))[0] > 0.5 else (few, mid)
            prior.outlier_df = float(np.exp(few))
        df = F.col("usual") * float(min(prior.df, most)) + (1 - F.col("usual")) * float(min(prior.outlier_df, most))
        own = own.withColumn("prior_df", F.when(F.col("usual") >= 1, F.lit(float(prior.df))).otherwise(df))
    else:
        own = own.withColumn("prior_df", F.lit(float(prior.df)))
    return genes.join(own.select("gene_id", "prior_df", "prior_variance"), "gene_id"), prior
