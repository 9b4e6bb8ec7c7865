"""Prediction scores as aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.columns import average_rank

# Fixed value: predictions are kept this far from 0 and 1 in the log loss.
LOGLOSS_EPSILON = 1e-15


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def brier(pred, obs) -> Column:
    return F.avg(F.pow(_c(obs) - _c(pred), 2))


def log_loss(pred, obs, eps: float = LOGLOSS_EPSILON) -> Column:
    p, y = F.least(F.greatest(_c(pred), F.lit(eps)), F.lit(1.0 - eps)), _c(obs)
    return -F.avg(y * F.log(p) + (F.lit(1.0) - y) * F.log1p(-p))


def mse(pred, obs) -> Column:
    return F.avg(F.pow(_c(obs) - _c(pred), 2))


def mae(pred, obs) -> Column:
    return F.avg(F.abs(_c(obs) - _c(pred)))


def pseudo_r_squared(pred, obs) -> Column:
    """One minus MSE over the sample variance."""
    return F.lit(1.0) - mse(pred, obs) / F.var_samp(_c(obs))


def mean_over_folds(metrics: DataFrame, keys: Sequence[str] = ("model", "scheme", "metric")) -> DataFrame:
    return metrics.groupBy(*keys).agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"))


def to_wide(metrics: DataFrame, columns: Sequence[tuple[str, int, str]]) -> DataFrame:
    """One row per model, one column ``{scheme}{fold}_{metric}`` per listed triple."""
    return metrics.groupBy("model").agg(
        *[
            F.max(
                F.when((F.col("scheme") == s) & (F.col("fold") == f) & (F.col("metric") == m), F.col("value"))
            ).alias(f"{s}{f}_{m}")
            for s, f, m in columns
        ]
    )


def rank_sum(scores: DataFrame, criteria: Sequence[str], top: int | None = None) -> DataFrame:
    """Average-tie rank per criterion, their sum, best first; ``top`` keeps the chosen models.

    The table has one row per candidate model, so the unpartitioned ranking is a tiny sort.
    """
    ranked = scores.withColumns({f"rank_{c}": average_rank(c) for c in criteria})
    ranked = ranked.withColumn("rank_sum", sum((F.col(f"rank_{c}") for c in criteria), F.lit(0.0)))
    ordered = ranked.orderBy("rank_sum", "model")
    return ordered if top is None else ordered.limit(top)


def best(scores: DataFrame, criterion: str) -> DataFrame:
    return scores.agg(F.min_by("model", criterion).alias("model"), F.min(criterion).alias(criterion))
