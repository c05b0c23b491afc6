"""Differential expression of pseudobulk samples: negative-binomial fits of each gene with moderated quasi-likelihood F tests.

samples: pb_sample_id and columns for groups and covariates, a row for each sample (at most MAX_SAMPLES); values: pb_sample_id, gene_id, value.
The design is a small array of the driver; genes are rows of one count for each sample, fitted in batches by tasks. Only sums over
genes return to the driver: likelihoods on a grid of dispersions, and the moments of the genes' log variances.

Dispersions follow a trend along abundance (maxima of adjusted profile likelihoods, Cox and Reid 1987, McCarthy et al. 2012; see dispersion); what genes
vary beyond it is their quasi-likelihood variance, moderated by empirical Bayes (Smyth 2004, Lund et al. 2012).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cytoplan.functions.settle import settled
from cytoplan.functions.statistics import f_tail, log_gamma, natural_basis, spline_knots
from cytoplan.operators import dispersion
from cytoplan.operators.differential import contrast_pairs, interpolated_curves, norm_factors
from cytoplan.operators.pseudobulk import benjamini_hochberg

MAX_SAMPLES = 5000


@dataclass
class Design:
    samples: list[str]
    x: np.ndarray
    columns: list[str]
    meta: pd.DataFrame
    levels: list[str] = field(default_factory=list)
    group: list[str] = field(default_factory=list)


def complete_samples(samples: DataFrame, needed: list[str]) -> pd.DataFrame:
    """The samples without a missing value in the needed columns, sorted by name; at most MAX_SAMPLES."""
    absent = [c for c in needed if c not in samples.columns]
    if absent:
        raise ValueError(f"the samples lack {', '.join(absent)}")
    rows = samples.dropna(subset=needed).select("pb_sample_id", *needed).limit(MAX_SAMPLES + 1).toPandas()
    if len(rows) > MAX_SAMPLES:
        raise ValueError(f"more than {MAX_SAMPLES} samples")
    if rows.empty:
        raise ValueError("no sample has values in all of " + ", ".join(needed))
    return rows.sort_values("pb_sample_id").reset_index(drop=True)


def level_order(values: pd.Series) -> list[str]:
    """Distinct labels: by number where all are numbers, else by name."""
    labels = sorted({str(v) for v in values})
    try:
        return sorted(labels, key=lambda s: (float(int(s, 16)) if s.lower().startswith("0x") else float(s), s))
    except ValueError:
        return labels


def _covariates(meta: pd.DataFrame, covariates: list[str]) -> tuple[list[np.ndarray], list[str]]:
    columns, names = [], []
    for c in covariates:
        if pd.api.types.is_numeric_dtype(meta[c]):
            columns.append(meta[c].to_numpy(float))
            names.append(c)
        else:
            for level in level_order(meta[c])[1:]:
                columns.append((meta[c].astype(str) == level).to_numpy(float))
                names.append(f"{c}{level}")
    return columns, names


def pairwise_design(samples: DataFrame, group: list[str], covariates: list[str] | None = None) -> Design:
    """One column for each group (of several columns: their labels joined by __), and covariates against their first level."""
    meta = complete_samples(samples, [*group, *(covariates or [])])
    if len(group) == 1:
        label, levels = meta[group[0]].map(str), level_order(meta[group[0]])
    else:
        label = meta[group].astype(str).agg("__".join, axis=1)
        levels = sorted(set(label))
    if len(levels) < 2:
        raise ValueError("at least two groups are compared")
    extra, names = _covariates(meta, covariates or [])
    x = np.stack([*((label == level).to_numpy(float) for level in levels), *extra], 1)
    if np.linalg.matrix_rank(x) < x.shape[1]:
        raise ValueError("the covariates can't be told apart from the groups")
    return Design(meta.pb_sample_id.tolist(), x, [*(f"group__{level}" for level in levels), *names], meta, levels, label.tolist())


def spline_design(meta: pd.DataFrame, time: str, covariates: list[str], df: int) -> tuple[Design, np.ndarray]:
    """An intercept, a natural spline of time with at most df columns, and covariates; and the knots."""
    t = meta[time].to_numpy(float)
    distinct = len(np.unique(t))
    if distinct < 3:
        raise ValueError("a spline needs three times or more")
    knots = np.unique(spline_knots(t, min(df, distinct - 1)))
    basis = natural_basis(t, knots)
    extra, names = _covariates(meta, covariates)
    x = np.stack([np.ones(len(t)), *basis.T, *extra], 1)
    return Design(meta.pb_sample_id.tolist(), x, ["intercept", *(f"spline{k + 1}" for k in range(basis.shape[1])), *names], meta), knots


def gene_rows(values: DataFrame, samples: list[str]) -> DataFrame:
    """(gene_id, y): the counts of a gene in these samples, in their order."""
    number = values.sparkSession.createDataFrame([(s, i) for i, s in enumerate(samples)], "pb_sample_id string, k int")
    own = values.select(F.col("pb_sample_id").cast("string").alias("pb_sample_id"), "gene_id", F.col("value").cast("double").alias("value")).join(F.broadcast(number), "pb_sample_id")  # MAX_SAMPLES rows
    cells = F.map_from_entries(F.collect_list(F.struct("k", "value")))  # one entry a sample
    rows = own.groupBy("gene_id", "k").agg(F.sum("value").alias("value")).groupBy("gene_id").agg(cells.alias("m"))
    return rows.select("gene_id", F.transform(F.sequence(F.lit(0), F.lit(len(samples) - 1)), lambda k: F.coalesce(F.try_element_at("m", k), F.lit(0.0))).alias("y"))


def expressed(rows: DataFrame, sizes: np.ndarray, group: list[str] | None = None, x: np.ndarray | None = None, min_count: float = 10, min_total: float = 15, large: float = 10, share: float = 0.7) -> DataFrame:
    """Genes with enough counts in as many samples as the smallest group has (Chen et al. 2016)."""
    if group:
        least = float(min(pd.Series(group).value_counts()))
    else:
        q = np.linalg.qr(x)[0]
        least = 1 / float((q**2).sum(1).max())
    if least > large:
        least = large + (least - large) * share
    bound = min_count / float(np.median(sizes))
    per = F.zip_with("y", F.array(*(F.lit(float(s)) for s in sizes)), lambda y, s: y / s)
    enough = F.size(F.filter(per, lambda c: c >= bound)) >= least - 1e-14
    return rows.where(enough & (F.aggregate("y", F.lit(0.0), lambda s, y: s + y) >= min_total - 1e-14))


def deviance(y: np.ndarray, mu: np.ndarray, phi: float | np.ndarray) -> np.ndarray:
    """Negative-binomial deviance of each gene; phi is of all genes, or of each."""
    phi = np.broadcast_to(np.asarray(phi, float), len(y))[:, None]
    some = np.maximum(phi, 1e-10)
    first = np.where(y > 0, y * np.log(np.maximum(y, 1e-300) / mu), 0.0)
    spread = np.where(phi < 1e-10, y - mu, (y + 1 / some) * np.log((1 + some * y) / (1 + some * mu)))
    return 2 * (first - spread).sum(1)


def fit_means(y: np.ndarray, x: np.ndarray, offset: np.ndarray, phi: float | np.ndarray, rounds: int = 500, start: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Coefficients, means and deviances of log-linear models, gene by gene, by scoring with step halving.

    A gene that has settled is left alone, so no gene's result depends on the others in its batch. Raises if one does not settle.
    """
    phi = np.broadcast_to(np.asarray(phi, float), len(y))
    ridge = 1e-9 * np.eye(x.shape[1])
    if start is None:
        rate = (y.sum(1) + 1e-3) / np.exp(offset).sum()
        start = np.linalg.lstsq(x, (np.log((y + 0.25) / np.exp(offset) + rate[:, None] * 0.1)).T, rcond=None)[0].T
    means = lambda b: np.exp(np.clip(b @ x.T + offset, -40, 40))
    beta = start.copy()
    mu = means(beta)
    dev = deviance(y, mu, phi)
    live = np.arange(len(y))
    for _ in range(rounds):
        if not len(live):
            break
        own, f, m, d = y[live], phi[live], mu[live], dev[live]
        w = m / (1 + f[:, None] * m)
        a = np.einsum("gn,np,nq->gpq", w, x, x, optimize=True) + ridge
        step = np.clip(np.linalg.solve(a, np.einsum("gn,np->gp", w * (own - m) / m, x)[..., None])[..., 0], -5, 5)
        moved = beta[live] + step
        new_mu = means(moved)
        new = deviance(own, new_mu, f)
        for _ in range(8):
            worse = new > d + 1e-10
            if not worse.any():
                break
            step[worse] /= 2
            moved[worse] = beta[live][worse] + step[worse]
            new_mu[worse] = means(moved[worse])
            new[worse] = deviance(own[worse], new_mu[worse], f[worse])
        better = new <= d + 1e-10
        beta[live[better]], mu[live[better]], dev[live[better]] = moved[better], new_mu[better], new[better]
        live = live[better & (np.abs(d - new) >= 1e-9 * (np.abs(d) + 0.1))]
    if len(live):
        raise RuntimeError(f"the means of {len(live)} genes did not settle in {rounds} rounds")
    return beta, mu, np.maximum(dev, 0)


def profile_likelihood(y: np.ndarray, x: np.ndarray, offset: np.ndarray, grid: np.ndarray) -> np.ndarray:
    """For every gene and log dispersion of the grid: log likelihood at the fitted means, less half of the log determinant of the information."""
    out, beta = [], None
    constant = log_gamma(y + 1)
    for phi in np.exp(grid).tolist():
        beta, mu, _ = fit_means(y, x, offset, phi, start=beta)
        r = 1 / phi
        own = log_gamma(y + r) - log_gamma(np.array(r)) - constant + y * np.log(mu / (mu + r)) + r * np.log(r / (mu + r))
        w = mu / (1 + phi * mu)
        info = np.einsum("gn,np,nq->gpq", w, x, x, optimize=True) + 1e-9 * np.eye(x.shape[1])
        out.append(own.sum(1) - 0.5 * np.linalg.slogdet(info)[1])
    return np.stack(out, 1)


@dataclass
class Fit:
    """What all genes share, and genes: gene_id, y (counts), logcpm, dispersion (the trend's), gene_dispersion, variance, prior_df, prior_variance."""

    design: Design
    genes: DataFrame
    offset: np.ndarray
    sizes: pd.DataFrame
    dispersion: float
    trend: dispersion.Trend
    prior: dispersion.Prior


def _stacked(frame: pd.DataFrame) -> np.ndarray:
    return np.stack([np.asarray(v, float) for v in frame["y"]])


def fit_genes(values: DataFrame, design: Design, normalization: str = "tmm", filter_by_expr: bool = True, robust: bool = True, abundance_trend: bool = False) -> Fit:
    """Library sizes, dispersions, and every gene's variance around the fit and its prior.

    robust: genes of extreme variance neither shape the prior nor are drawn to it; abundance_trend: the prior's scale follows abundance.
    """
    spark = values.sparkSession
    chosen = spark.createDataFrame([(s,) for s in design.samples], "pb_sample_id string")
    own = values.join(F.broadcast(chosen), "pb_sample_id", "left_semi")  # MAX_SAMPLES names
    found = {r.pb_sample_id: (r.lib_size, r.norm_factor) for r in norm_factors(own, normalization).collect()}
    lib, factor = (np.array([found.get(s, (0.0, 1.0))[k] for s in design.samples], float) for k in (0, 1))
    if (lib <= 0).any():
        raise ValueError("a sample has no counts")
    rows = gene_rows(own, design.samples)
    if filter_by_expr:
        rows = settled(expressed(rows, lib * factor, design.group, design.x))
        sums = rows.select(F.posexplode("y").alias("k", "v")).groupBy("k").agg(F.sum("v").alias("s")).collect()  # a row for each sample
        lib = np.array([r.s for r in sorted(sums, key=lambda r: r.k)], float) if sums else lib
    else:
        rows = settled(rows)
    if rows.isEmpty():
        raise ValueError("no gene has enough counts")
    x, offset = design.x, np.log(lib * factor)
    free = x.shape[0] - x.shape[1]
    if free < 1:
        raise ValueError("there must be more samples than columns of the design")

    share = np.exp(offset)
    prior = 2 * share / share.mean()
    kind = dict(rows.dtypes)["gene_id"]

    def likelihoods(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            y = _stacked(frame)
            mean = np.log2(((y + prior) / (share + 2 * prior) * 1e6).mean(1))
            yield pd.DataFrame({"gene_id": frame["gene_id"], "y": frame["y"], "logcpm": mean, "curve": list(profile_likelihood(y, x, offset, dispersion.GRID))})

    genes = settled(rows.mapInPandas(likelihoods, f"gene_id {kind}, y array<double>, logcpm double, curve array<double>"))
    common, trend = dispersion.fit_trend(genes)

    def variances(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            phi = trend.at(frame["logcpm"].to_numpy(float))
            _, _, dev = fit_means(_stacked(frame), x, offset, phi)
            yield frame.assign(dispersion=phi, variance=np.maximum(dev / free, 1e-8))

    genes = settled(genes.mapInPandas(variances, f"gene_id {kind}, y array<double>, logcpm double, curve array<double>, dispersion double, variance double"))
    genes, moments = dispersion.with_prior(genes, free, robust, abundance_trend)

    def own_dispersion(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            phi = dispersion.moderated(np.stack(frame["curve"].to_numpy()), frame["logcpm"].to_numpy(float), trend, moments.df / free)
            yield frame.drop(columns="curve").assign(gene_dispersion=phi)

    genes = settled(genes.mapInPandas(own_dispersion, f"gene_id {kind}, y array<double>, logcpm double, dispersion double, variance double, prior_df double, prior_variance double, gene_dispersion double"))
    sizes = pd.DataFrame({"pb_sample_id": design.samples, "lib_size": lib, "norm_factor": factor})
    return Fit(design, genes, offset, sizes, common, trend, moments)


def test_contrasts(fit: Fit, contrasts: dict[str, np.ndarray], prior_count: float = 0.125) -> DataFrame:
    """(gene_id, contrast, logfc, logcpm, f, p): F tests of combinations of coefficients; each is a column, or a matrix tested jointly.

    logfc, in base 2, is of the first column, from a fit with prior_count added in proportion to library size.
    """
    x, offset = fit.design.x, fit.offset
    free = x.shape[0] - x.shape[1]
    share = np.exp(offset)
    add = prior_count * share / share.mean()
    tests = []
    for name, c in contrasts.items():
        c = np.atleast_2d(np.asarray(c, float).T).T
        q, r = np.linalg.qr(np.concatenate((c, np.eye(len(c))), 1))
        rest = q[:, np.linalg.matrix_rank(c) :]
        tests.append((name, c, x @ rest, int(np.linalg.matrix_rank(c))))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            y, phi = _stacked(frame), frame["dispersion"].to_numpy(float)
            _, _, full = fit_means(y, x, offset, phi)
            beta, _, _ = fit_means(y + add, x, np.log(share + 2 * add), phi)
            variance = frame["variance"].to_numpy()
            d0, s0 = frame["prior_df"].to_numpy(float), frame["prior_variance"].to_numpy(float)
            weight = np.where(np.isinf(d0), 1.0, np.where(np.isinf(d0), 0.0, d0) / (np.where(np.isinf(d0), 0.0, d0) + free))
            moderate = weight * s0 + (1 - weight) * variance
            for name, c, smaller, df in tests:
                reduced = fit_means(y, smaller, offset, phi)[2] if smaller.shape[1] else deviance(y, np.broadcast_to(share, y.shape), phi)
                f = np.maximum(reduced - full, 0) / df / moderate
                yield pd.DataFrame({"gene_id": frame["gene_id"], "contrast": name, "logfc": beta @ c[:, 0] / np.log(2), "logcpm": frame["logcpm"], "f": f, "p": f_tail(f, df, d0 + free)})

    kind = dict(fit.genes.dtypes)["gene_id"]
    return fit.genes.mapInPandas(run, f"gene_id {kind}, contrast string, logfc double, logcpm double, f double, p double")


test_contrasts.__test__ = False  # no test of pytest's


def pairwise_de(
    samples: DataFrame, values: DataFrame, group: str | list[str], covariates: list[str] | None = None, contrasts: str = "reference", reference: str | None = None,
    manual: list[tuple[str, str]] | None = None, normalization: str = "tmm", filter_by_expr: bool = True, robust: bool = True, abundance_trend: bool = False, fdr_cutoff: float = 0.05,
) -> tuple[DataFrame, Fit]:
    """Table of gene_id, contrast, group1, group2, logfc, logcpm, f, p, fdr and significant; and the fit.

    Of several group columns the labels are joined. A missing reference is the first level in order.
    """
    spark = samples.sparkSession
    design = pairwise_design(samples, [group] if isinstance(group, str) else group, covariates)
    levels = spark.createDataFrame(list(enumerate(design.levels)), "position int, level string")
    if contrasts == "manual" and any(g not in design.levels for pair in manual or [] for g in pair):
        raise ValueError("a manual contrast names a group that is not there")
    pairs = contrast_pairs(levels, contrasts, reference, manual).collect()  # pairs of groups of samples
    fit = fit_genes(values, design, normalization, filter_by_expr, robust, abundance_trend)
    vectors = {}
    for p in pairs:
        c = np.zeros(design.x.shape[1])
        c[design.levels.index(p.group1)], c[design.levels.index(p.group2)] = 1, -1
        vectors[p.contrast] = c
    names = spark.createDataFrame([(p.contrast, p.group1, p.group2) for p in pairs], "contrast string, group1 string, group2 string")
    tested = settled(test_contrasts(fit, vectors))
    table = benjamini_hochberg(tested, "p", "gene_id", ["contrast"]).join(F.broadcast(names), "contrast")
    return table.select("gene_id", "contrast", "group1", "group2", "logfc", "logcpm", "f", "p", "fdr", (F.col("fdr") <= fdr_cutoff).alias("significant")), fit


def _most_frequent(meta: pd.DataFrame, covariates: list[str]) -> dict[str, object]:
    """The mean of a number, the most frequent label of others."""
    return {c: meta[c].mean() if pd.api.types.is_numeric_dtype(meta[c]) else sorted(meta[c].astype(str).value_counts().items(), key=lambda kv: (-kv[1], kv[0]))[0][0] for c in covariates}


def fitted_curves(fit: Fit, knots: np.ndarray, time: str, covariates: list[str], grid: int = 200) -> DataFrame:
    """(gene_id, time, value): log2 counts per million along the spline, at the covariates' middle."""
    t = fit.design.meta[time].to_numpy(float)
    at = np.linspace(t.min(), t.max(), grid)
    middle = _most_frequent(fit.design.meta, covariates)
    cols = [np.ones(grid), *natural_basis(at, knots).T]
    for name in fit.design.columns[len(cols) :]:
        of = next(c for c in sorted(covariates, key=len, reverse=True) if name.startswith(c))
        value = float(middle[of]) if name == of and not isinstance(middle[of], str) else float(name == f"{of}{middle[of]}")
        cols.append(np.full(grid, value))
    there, x, offset = np.stack(cols, 1), fit.design.x, fit.offset

    def along(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            beta, _, _ = fit_means(_stacked(frame), x, offset, frame["dispersion"].to_numpy(float))
            value = (beta @ there.T + np.log(1e6)) / np.log(2)
            yield pd.DataFrame({"gene_id": np.repeat(frame["gene_id"].to_numpy(), grid), "time": np.tile(at, len(frame)), "value": value.ravel()})

    return fit.genes.mapInPandas(along, f"gene_id {dict(fit.genes.dtypes)['gene_id']}, time double, value double")


def spline_de(
    samples: DataFrame, values: DataFrame, time: str, condition: str | None = None, covariates: list[str] | None = None, df: int = 3, normalization: str = "tmm",
    filter_by_expr: bool = True, robust: bool = True, abundance_trend: bool = False, fdr_cutoff: float = 0.05, grid: int = 200,
) -> tuple[DataFrame, DataFrame]:
    """(table, curves) of the genes that change along time, condition by condition.

    table: condition, gene_id, logcpm, f, p, fdr, significant; curves: condition, gene_id, time, value, significant. Conditions of fewer than
    max(df + 1, 4) samples or three times are left out; none left is an error.
    """
    covariates = covariates or []
    meta = complete_samples(samples, [time, *([condition] if condition else []), *covariates])
    parts = [(str(k), m.reset_index(drop=True)) for k, m in meta.groupby(condition)] if condition else [("all", meta)]
    tables, curves = [], []
    for name, own in parts:  # conditions of samples
        if len(own) < max(df + 1, 4) or own[time].nunique() < 3:
            continue
        design, knots = spline_design(own, time, covariates, df)
        fit = fit_genes(values, design, normalization, filter_by_expr, robust, abundance_trend)
        c = np.zeros((design.x.shape[1], len(knots) - 1))
        c[np.arange(1, len(knots)), np.arange(len(knots) - 1)] = 1
        tested = settled(test_contrasts(fit, {name: c}).drop("logfc"))
        table = benjamini_hochberg(tested, "p", "gene_id", ["contrast"]).withColumn("significant", F.col("fdr") <= fdr_cutoff).withColumnRenamed("contrast", "condition")
        tables.append(table)
        curve = fitted_curves(fit, knots, time, covariates, grid).withColumn("condition", F.lit(name))
        curves.append(curve.join(table.select("gene_id", "significant"), "gene_id").select("condition", "gene_id", "time", "value", "significant"))
    if not tables:
        raise ValueError("no condition has enough samples and times")
    union = lambda frames: frames[0] if len(frames) == 1 else frames[0].unionByName(union(frames[1:]))
    return union(tables), union(curves)


def curves_with_fallback(fitted: DataFrame, values: DataFrame, grid: int = 200) -> DataFrame:
    """Fitted curves, and interpolated means for the genes and conditions that have none. values: condition, gene_id, time, value."""
    missing = values.join(fitted.select("condition", "gene_id").distinct(), ["condition", "gene_id"], "left_anti")
    return fitted.unionByName(interpolated_curves(missing, grid).withColumn("significant", F.lit(False)))
