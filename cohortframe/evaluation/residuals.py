"""Residual shape without simulation: quantile curves, non-parametric shape, uniformity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..session import cut_lineage
from ..operators.distribution import cumulative_counts, exact_quantiles, quantile_bins, quantile_columns

TAUS = {"q05": 0.05, "q10": 0.10, "q25": 0.25, "q50": 0.50, "q75": 0.75, "q90": 0.90, "q95": 0.95}

# Standard normal quantiles at 0.95 and 0.75.
Z95, Z75 = 1.6448536269514722, 0.6744897501960817
GAUSSIAN_NP_KURTOSIS = Z95 / Z75


def scaled_residual(observed: Column, fitted: Column, scale: Column) -> Column:
    return (observed - fitted) / scale


def quantile_curves(df: DataFrame, fitted: str, residual: str, bins: int = 20) -> DataFrame:
    """Residual quantiles at seven levels along equal-count bins of the fitted value.

    The two columns are read by five passes, so they are materialised once, on shared storage.
    """
    df = cut_lineage(df.select(fitted, residual))
    binned, _ = quantile_bins(df, fitted, bins)
    centre = binned.groupBy("bin").agg(F.avg(fitted).alias("fitted_mean"), F.count(F.lit(1)).alias("n"))
    return quantile_columns(binned, ["bin"], residual, TAUS).join(centre, "bin")


def nonparametric_shape(curves: DataFrame) -> DataFrame:
    """Skewness, kurtosis and excess kurtosis from quantile ratios."""
    spread = F.col("q90") - F.col("q10")
    return curves.withColumns(
        {
            "NP_skewness": F.try_divide(F.col("q10") + F.col("q90") - 2 * F.col("q50"), spread),
            "NP_kurtosis": F.try_divide(F.col("q95") - F.col("q05"), F.col("q75") - F.col("q25")),
        }
    ).withColumn("NP_excess_kurtosis", F.col("NP_kurtosis") / F.lit(GAUSSIAN_NP_KURTOSIS) - 1)


def mid_pit_binary(obs: Column, p: Column) -> Column:
    """Mid-point of the jump of the Bernoulli distribution function at the observation."""
    return F.when(obs == 1, F.lit(1.0) - p / 2).otherwise((F.lit(1.0) - p) / 2)


def uniformity(df: DataFrame, pit: str, keys: Sequence[str] = (), edge: float = 0.01) -> DataFrame:
    """Kolmogorov-Smirnov distance to the uniform law and the share of edge values.

    The empirical distribution comes from bucketed counts, so no task sorts a whole group.
    """
    keys = list(keys)
    ecdf = cumulative_counts(df, keys, pit)
    u, n = F.col(pit), F.col("n")
    upper = (F.col("cum_before") + F.col("cnt")) / n - u
    lower = u - F.col("cum_before") / n
    return ecdf.groupBy(*keys).agg(
        F.sum("cnt").alias("n"),
        F.max(F.greatest(upper, lower)).alias("ks_distance"),
        (F.sum(F.when((u < edge) | (u > 1 - edge), F.col("cnt")).otherwise(0)) / F.sum("cnt")).alias("outlier_share"),
        F.lit(2 * edge).alias("outlier_expected"),
    )


def pearson_dispersion(df: DataFrame, obs: Column, fitted: Column, variance: Column, parameters: int) -> DataFrame:
    """Pearson chi-square over residual degrees of freedom."""
    return df.agg(
        (F.sum(F.pow(obs - fitted, 2) / variance) / (F.count(F.lit(1)) - parameters)).alias("dispersion_ratio")
    )


def qq_pairs(df: DataFrame, value: str, reference: Sequence[tuple[float, float]], keys: Sequence[str] = ()) -> DataFrame:
    """Sample quantiles against ``(probability, theoretical quantile)`` pairs."""
    lookup = F.create_map(*[F.lit(float(x)) for pair in reference for x in pair])
    sample = exact_quantiles(df, keys, value, [p for p, _ in reference])
    return sample.withColumn("theoretical", F.element_at(lookup, F.col("prob")))
