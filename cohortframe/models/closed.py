"""Estimators with a closed form: one aggregate, no iteration."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F


def _both(x: str, y: str) -> Column:
    return F.col(x).isNotNull() & F.col(y).isNotNull()


def ols_origin(df: DataFrame, x: str, y: str, keys: Sequence[str] = ()) -> DataFrame:
    """``y ~ 0 + x``: slope, its standard error, uncentred R-squared."""
    sums = (
        df.filter(_both(x, y))
        .groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(F.col(x) * F.col(x)).alias("sxx"),
            F.sum(F.col(x) * F.col(y)).alias("sxy"),
            F.sum(F.col(y) * F.col(y)).alias("syy"),
        )
    )
    slope = F.col("sxy") / F.col("sxx")
    rss = F.col("syy") - F.col("sxy") * slope
    return sums.select(
        *keys,
        "n",
        slope.alias("slope"),
        F.sqrt(rss / (F.col("n") - 1) / F.col("sxx")).alias("std_error"),
        (F.lit(1.0) - rss / F.col("syy")).alias("r_squared"),
    )


def ols_simple(df: DataFrame, x: Column, y: Column, keys: Sequence[str] = ()) -> DataFrame:
    """``y ~ x`` with intercept, per group; per group it equals the full interaction model."""
    return (
        df.select(*keys, x.alias("__x"), y.alias("__y"))
        .groupBy(*keys)
        .agg(
            F.regr_count("__y", "__x").alias("n"),
            F.regr_slope("__y", "__x").alias("slope"),
            F.regr_intercept("__y", "__x").alias("intercept"),
            F.regr_r2("__y", "__x").alias("r_squared"),
        )
    )


def correlation_test(df: DataFrame, x: str, y: str) -> DataFrame:
    """Pearson correlation with its t statistic and degrees of freedom."""
    known = df.filter(_both(x, y)).agg(F.corr(x, y).alias("r"), F.count(F.lit(1)).alias("n"))
    t = F.col("r") * F.sqrt((F.col("n") - 2) / (F.lit(1.0) - F.col("r") * F.col("r")))
    return known.select("r", "n", t.alias("t"), (F.col("n") - 2).alias("dof"))


def logit_by_group(df: DataFrame, outcome: str, group: str) -> DataFrame:
    """Binomial logit on one factor: its fit is the log-odds of each group's proportion."""
    counted = (
        df.filter(F.col(outcome).isNotNull())
        .groupBy(group)
        .agg(F.count(F.lit(1)).alias("n"), F.sum(outcome).alias("events"))
    )
    p = F.col("events") / F.col("n")
    odds = F.try_divide(F.col("events"), F.col("n") - F.col("events"))
    return counted.select(
        group,
        "n",
        "events",
        p.alias("proportion"),
        F.when(odds > 0, F.log(odds)).alias("log_odds"),
        F.when(odds > 0, F.sqrt(F.lit(1.0) / (F.col("n") * p * (1 - p)))).alias("std_error"),
    )


def lognormal_by_group(df: DataFrame, value: str, keys: Sequence[str]) -> DataFrame:
    """Mean and variance of log size per group by maximum likelihood, with the log-likelihood."""
    fitted = (
        df.filter(F.col(value) > 0)
        .groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.avg(F.log(value)).alias("mu"),
            F.stddev_pop(F.log(value)).alias("sigma"),
        )
    )
    loglik = -F.col("n") * (F.lit(0.5 * math.log(2 * math.pi) + 0.5) + F.log(F.nullif("sigma", F.lit(0.0))))
    return fitted.withColumn("loglik", loglik)


def aic_of_groups(fitted: DataFrame, parameters_per_group: int = 2) -> DataFrame:
    return fitted.agg(
        F.sum("loglik").alias("loglik"),
        (F.count(F.lit(1)) * parameters_per_group).alias("k"),
        (F.lit(-2.0) * F.sum("loglik") + 2.0 * parameters_per_group * F.count(F.lit(1))).alias("AIC"),
    )


def skewnormal_start(df: DataFrame, value: str, keys: Sequence[str], nu: Column | float = -2.0) -> DataFrame:
    """Starting values of a skew-normal fit of log size per group."""
    nu0 = F.lit(float(nu)) if isinstance(nu, (int, float)) else nu
    base = df.filter(F.col(value) > 0).groupBy(*keys).agg(
        F.avg(F.log(value)).alias("m"), F.stddev_samp(F.log(value)).alias("s")
    )
    delta = F.col("nu0") / F.sqrt(F.lit(1.0) + F.col("nu0") * F.col("nu0"))
    sig0 = F.col("s") / F.sqrt(F.lit(1.0) - F.lit(2.0 / math.pi) * F.col("delta") * F.col("delta"))
    return (
        base.withColumn("nu0", nu0)
        .withColumn("delta", delta)
        .withColumn("sig0", sig0)
        .withColumn("mu0", F.col("m") - F.col("sig0") * F.col("delta") * F.lit(math.sqrt(2.0 / math.pi)))
    )


# Largest skewness a skew-normal law can reach is about 0.9953.
MAX_SKEW = 0.99


def skewnormal_moments(df: DataFrame, value: str, keys: Sequence[str]) -> DataFrame:
    """Skew-normal location, scale and shape of log size per group by the method of moments.

    ``clamped`` marks groups whose skewness no skew-normal law reaches; the bound ``MAX_SKEW`` stands in for it there.
    """
    logs = df.filter(F.col(value) > 0).select(*keys, F.log(value).alias("__l"))
    sums = logs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("__l").alias("m1"),
        F.avg(F.col("__l") * F.col("__l")).alias("m2"),
        F.avg(F.col("__l") * F.col("__l") * F.col("__l")).alias("m3"),
    )
    var = F.col("m2") - F.col("m1") * F.col("m1")
    third = F.col("m3") - 3 * F.col("m1") * F.col("m2") + 2 * F.col("m1") * F.col("m1") * F.col("m1")
    skew = F.try_divide(third, F.pow(F.greatest(var, F.lit(0.0)), 1.5))
    root = F.pow(F.abs(F.col("g")), 2.0 / 3.0)
    bound = ((4.0 - math.pi) / 2.0) ** (2.0 / 3.0)
    delta = F.signum("g") * F.sqrt(F.lit(math.pi / 2) * root / (root + F.lit(bound)))
    return (
        sums.withColumn("sd", F.sqrt(F.greatest(var, F.lit(0.0))))
        .withColumn("skew", skew)
        .withColumn("g", F.greatest(F.least("skew", F.lit(MAX_SKEW)), F.lit(-MAX_SKEW)))
        .withColumn("delta", delta)
        .withColumn("omega", F.col("sd") / F.sqrt(F.lit(1.0) - F.lit(2.0 / math.pi) * F.col("delta") ** 2))
        .withColumn("xi", F.col("m1") - F.col("omega") * F.col("delta") * F.lit(math.sqrt(2.0 / math.pi)))
        .withColumn("nu", F.col("delta") / F.sqrt(F.lit(1.0) - F.col("delta") ** 2))
        .select(*keys, "n", F.col("m1").alias("mean"), "sd", "skew", "xi", "omega", "nu", (F.abs("skew") > MAX_SKEW).alias("clamped"))
    )


def smearing_factor(df: DataFrame, observed_log: Column, predicted_log: Column) -> DataFrame:
    """Mean of the exponentiated residuals, which corrects predictions made on the log scale."""
    return df.agg(F.avg(F.exp(observed_log - predicted_log)).alias("smear"))


def back_transform(df: DataFrame, predicted_log: Column, smear: DataFrame, out: str) -> DataFrame:
    return (
        df.crossJoin(F.broadcast(smear)).withColumn(out, F.exp(predicted_log) * F.col("smear")).drop("smear")
    )


# --- one-pass Gram matrix ---------------------------------------------------------------


def gram(df: DataFrame, columns: Sequence[Column], keys: Sequence[str] = ()) -> DataFrame:
    """Sums of all pairwise products of ``columns`` (the response last), upper triangle in order."""
    named = df.select(*keys, *[c.cast("double").alias(f"__x{i}") for i, c in enumerate(columns)])
    complete = named.dropna(subset=[f"__x{i}" for i in range(len(columns))])
    p = len(columns)
    sums = [
        F.sum(F.col(f"__x{i}") * F.col(f"__x{j}")).alias(f"g{i}_{j}") for i in range(p) for j in range(i, p)
    ]
    return complete.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *sums)


def gram_matrix(row, p: int) -> np.ndarray:
    out = np.zeros((p, p))
    for i in range(p):
        for j in range(i, p):
            out[i, j] = out[j, i] = row[f"g{i}_{j}"]
    return out


def solve_gram(g: np.ndarray) -> tuple[np.ndarray, float]:
    """Coefficients and residual sum of squares from a Gram matrix whose last column is y."""
    xtx, xty, yty = g[:-1, :-1], g[:-1, -1], g[-1, -1]
    scale = np.sqrt(np.diag(xtx))
    beta = np.linalg.lstsq(xtx / np.outer(scale, scale), xty / scale, rcond=None)[0] / scale
    return beta, float(max(yty - xty @ beta, 0.0))


def sequential_anova(df: DataFrame, design, response: Column, term_sizes: Sequence[int] | None = None) -> DataFrame:
    """Sequential sums of squares and F ratios of a multi-term OLS, from one aggregate.

    The driver receives one p x p matrix and sweeps its leading blocks term by term.
    """
    names_cols = design.columns({c: F.col(c) for c in df.columns})
    columns = [c for _, c in names_cols]
    row = gram(df, [F.lit(1.0) * c if not isinstance(c, Column) else c for c in columns] + [response]).first()
    g, n = gram_matrix(row, len(columns) + 1), row["n"]
    sizes = list(term_sizes or [1] * len(columns))
    names, rss, used, rows = [n_ for n_, _ in names_cols], [g[-1, -1]], 0, []
    for size in sizes:
        used += size
        pick = [*range(used), len(columns)]
        rss.append(solve_gram(g[np.ix_(pick, pick)])[1])
    dof = n - used
    start = 0
    for i, size in enumerate(sizes):
        ss = rss[i] - rss[i + 1]
        rows.append((i + 1, ":".join(names[start : start + size]), size, float(ss), float(ss / size / (rss[-1] / dof))))
        start += size
    rows.append((len(sizes) + 1, "Residuals", int(dof), float(rss[-1]), None))
    return df.sparkSession.createDataFrame(rows, "position int, term string, df long, sum_sq double, f_value double")


def size_pca(df: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Principal components of scaled columns: component table and per-row scores.

    One aggregate gives means, deviations and correlations; the driver decomposes a matrix of
    order ``len(columns)``. Loadings are signed so that the largest one of a component is positive.
    """
    p = len(columns)
    known = df.dropna(subset=list(columns))
    aggs = [F.count(F.lit(1)).alias("n")]
    aggs += [F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)]
    aggs += [F.stddev_samp(c).alias(f"s{i}") for i, c in enumerate(columns)]
    aggs += [F.corr(columns[i], columns[j]).alias(f"r{i}_{j}") for i in range(p) for j in range(i + 1, p)]
    row = known.agg(*aggs).first()
    r = np.eye(p)
    for i in range(p):
        for j in range(i + 1, p):
            r[i, j] = r[j, i] = row[f"r{i}_{j}"]
    values, vectors = np.linalg.eigh(r)
    order = np.argsort(values)[::-1]
    values, vectors = values[order], vectors[:, order]
    vectors *= np.sign(vectors[np.abs(vectors).argmax(axis=0), range(p)])
    table = [
        (f"PC{k + 1}", float(np.sqrt(values[k])), float(100 * values[k] / p), *[float(v) for v in vectors[:, k]])
        for k in range(p)
    ]
    schema = "component string, sdev double, variance_pct double, " + ", ".join(f"{c} double" for c in columns)
    scaled = [(F.col(c) - F.lit(row[f"m{i}"])) / F.lit(row[f"s{i}"]) for i, c in enumerate(columns)]
    scores = known.withColumns(
        {f"PC{k + 1}": sum((scaled[i] * F.lit(float(vectors[i, k])) for i in range(p)), F.lit(0.0)) for k in range(p)}
    )
    return df.sparkSession.createDataFrame(table, schema), scores
