"""Fit, cross-validate and rank the candidate models of one vital rate.

Folds with the same effective training rows share one fit. Every scoring iteration is one pass
over the panel for all (model, training set) pairs, and all test scores come from one more pass.

Without random intercepts the pairs are merged over individuals at once: folds, knots and fits read the distinct rows
with their number, so that all work after the panel follows the distinct rows.

With ``random`` the candidates have intercepts of plot and individual, as they will be used: the
variances of all models are searched together on all rows first, and those of the training sets together after that,
each from its model's solution.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..evaluation.folds import Fold, plan, present_censuses
from ..evaluation.metrics import mean_over_folds, rank_sum
from ..functions.terms import GROWTH_MODELS, SURVIVAL_MODELS
from ..models.engine import MASK_BITS, Effects, Fit, Rows, fit_fixed, merge_rows, score_sets
from ..models.mixed import score_conditional, search_variances
from ..models.vital import (
    coefficient_table,
    fit_table,
    growth_rows,
    knots_by_set,
    new_fit,
    start_growth,
    survival_design,
    survival_rows,
)


KEYS = ("SITEAREA", "AREA", "CENSUS_NUM", "HT", "TimeSinceFire", "CensusInterval")


@dataclass(frozen=True)
class Selection:
    """Long metric table, fit table, coefficients, and the ranking of the models."""

    metrics: DataFrame
    fits: DataFrame
    coefficients: DataFrame
    ranking: DataFrame


def _seen(pairs: DataFrame, response: str, random: bool) -> tuple[DataFrame, str | None]:
    """What folds and fits see of the pairs, and the column of their number where they are merged over individuals."""
    if random:
        return pairs.select("IND_ID", "PLOTCODE", *KEYS, response).persist(), None
    return merge_rows(pairs, [*KEYS, response], "__n").persist(), "__n"


def training_sets(folds: Sequence[Fold], present: Sequence[int]) -> tuple[list[Fold], list[int]]:
    """Distinct training sets and, for every fold, the one it uses."""
    seen: dict[tuple, int] = {}
    sets, use = [], []
    for f in folds:
        key = f.fingerprint(present)
        if key not in seen:
            seen[key] = len(sets)
            sets.append(f)
        use.append(seen[key])
    return sets, use


def _label(fold: Fold) -> str:
    return f"{fold.scheme}{fold.fold}"


def _chunks(folds: Sequence[Fold], present: Sequence[int]):
    """Groups of folds whose training and test sets fit one bit mask; usually a single group."""
    block: list[Fold] = []
    for f in folds:
        if len(block) == MASK_BITS:
            yield block
            block = []
        block.append(f)
    if block:
        yield block


def _warm_fits(rows, fits: Sequence[Fit], **kw) -> list[Fit]:
    """Fit the widest training set first; the other sets start from its solution.

    A spline's columns depend on the training set's knots, so those designs start cold.
    """
    first = [f for f in fits if f.train == 0]
    done = {f.model: (f, f.design) for f in fit_fixed(rows, first, **kw)}
    rest = []
    for f in fits:
        if f.train == 0:
            continue
        base, design = done[f.model]
        if design is f.design and base.error is None:
            f = replace(f, beta=base.beta, aux=base.aux)
        rest.append(f)
    return [b for b, _ in done.values()] + (fit_fixed(rows, rest, **kw) if rest else [])


# Grids this narrow in log sd place a variance well within its own uncertainty.
SEARCH_WIDTH = 0.3
# A search that does not end within the rounds is reported as not converged.
SEARCH_STEPS = {"rounds": 6, "steps": 4, "final_steps": 8, "smallest": SEARCH_WIDTH, "tol": 1e-2}


def _random_fits(rows: Rows, fits: Sequence[Fit], first: float) -> tuple[list[Fit], list[Effects]]:
    """The fits with intercepts of plot and individual; training sets start from their model's fit on all rows."""
    wide = [i for i, f in enumerate(fits) if f.train == 0]
    out: list[Fit] = list(fits)
    effects: list[Effects] = [{} for _ in fits]
    found, first_effects = search_variances(rows, [fits[i] for i in wide], True, first, 1.0, **SEARCH_STEPS)
    of_model = {}
    for i, fit, plots in zip(wide, found, first_effects):
        out[i], effects[i] = fit, plots
        of_model[fit.model] = (fit, plots)
    rest = [i for i, f in enumerate(fits) if f.train != 0]
    if rest:
        starts = [of_model[fits[i].model] for i in rest]
        usable = all(f.error is None for f, _ in starts)
        centres = [np.log([f.sd_plot, f.sd_ind]) for f, _ in starts] if usable else first
        found, more = search_variances(
            rows, [fits[i] for i in rest], True, centres, SEARCH_WIDTH if usable else 1.0, **SEARCH_STEPS,
            begin=[plots for _, plots in starts], afresh=first,
        )
        for i, fit, plots in zip(rest, found, more):
            out[i], effects[i] = fit, plots
    return out, effects


def _metric_rows(tasks, scores):
    return [
        (fit.model, fold.scheme, fold.fold, name, float(value))
        for (fit, fold), found in zip(tasks, scores)
        for name, value in found.items()
    ]


def _summarise(spark: SparkSession, metric_rows, fits: Sequence[Fit], criterion: str, top: int) -> Selection:
    metrics = spark.createDataFrame(
        metric_rows, "model string, scheme string, fold int, metric string, value double"
    )
    fit_rows = fit_table(spark, fits)
    full = fit_rows.filter(F.col("fold") == "full0").select("model", F.col("aic").alias("AIC"))
    means = mean_over_folds(metrics.filter(F.col("metric") == criterion))
    wide = means.groupBy("model").agg(
        F.max(F.when(F.col("scheme") == "expanding", F.col("mean"))).alias(f"mean_TSV_{criterion}"),
        F.max(F.when(F.col("scheme") == "site", F.col("mean"))).alias(f"mean_SP_{criterion}"),
    )
    ranking = rank_sum(
        full.join(wide, "model"), ["AIC", f"mean_TSV_{criterion}", f"mean_SP_{criterion}"], top
    )
    return Selection(metrics, fit_rows, coefficient_table(spark, fits), ranking)


def select_survival(
    pairs: DataFrame,
    levels: Sequence[str],
    models: Sequence[str] = tuple(SURVIVAL_MODELS),
    folds: Sequence[Fold] | None = None,
    top: int = 4,
    random: bool = False,
) -> Selection:
    """Hazard models ranked by AIC, time-series and left-out-site Brier scores of population-level predictions."""
    pairs, weight = _seen(pairs, "Dead_next", random)
    present = present_censuses(pairs)
    folds = list(folds) if folds is not None else plan(pairs)
    metric_rows, all_fits = [], []
    for block in _chunks(folds, present):
        sets, use = training_sets(block, present)
        conditions = [f.train() for f in sets]
        rows = survival_rows(
            pairs, levels, random, train_sets=conditions, test_sets=[f.test() for f in block], weight=weight
        )
        splines = any("ns(" in str(SURVIVAL_MODELS[m]) for m in models)
        knots = knots_by_set(pairs, conditions, weight=weight) if splines else [None] * len(sets)
        mean = rows.means("__y")[0]
        shared = {m: survival_design(m, levels) for m in models if "ns(" not in str(SURVIVAL_MODELS[m])}
        fits = [
            new_fit(
                m,
                shared.get(m) or survival_design(m, levels, knots[t]),
                "cloglog",
                mean,
                train=t,
                fold=_label(f),
            )
            for m in models
            for t, f in enumerate(sets)
        ]
        fits = _warm_fits(rows, fits)
        if random:
            fits, _ = _random_fits(rows, fits, 0.3)
        by_key = {(f.model, f.train): f for f in fits}
        tasks = [(by_key[m, use[k]], k) for m in models for k in range(len(block))]
        scores = score_sets(rows, tasks, "binary")
        metric_rows += _metric_rows([(f, block[k]) for f, k in tasks], scores)
        all_fits += fits
        rows.release()
    pairs.unpersist()
    return _summarise(pairs.sparkSession, metric_rows, all_fits, "Brier", top)


def select_growth(
    pairs: DataFrame,
    levels: Sequence[str],
    models: Sequence[str] = tuple(GROWTH_MODELS),
    folds: Sequence[Fold] | None = None,
    top: int = 4,
    min_train: int = 5,
    random: bool = False,
) -> Selection:
    """Growth models with t errors ranked by AIC, time-series and left-out-site MSE of log size.

    Time folds are predicted with the effects of plot and individual, where these were seen in training; left-out sites
    and the fit on all rows at population level.
    """
    pairs, weight = _seen(pairs, "HT_next", random)
    present = present_censuses(pairs)
    if folds is None:
        if len(present) <= min_train:
            raise ValueError(f"{len(present)} censuses leave no fold after {min_train} training censuses")
        folds = plan(pairs, min_train=min_train, test_size=1, unit="level")
    metric_rows, all_fits = [], []
    for block in _chunks(folds, present):
        sets, use = training_sets(block, present)
        rows = growth_rows(
            pairs, levels, random, train_sets=[f.train() for f in sets], test_sets=[f.test() for f in block], weight=weight
        )
        starts = start_growth(rows, models, levels, [(t, _label(f)) for t, f in enumerate(sets)])
        fits = _warm_fits(rows, starts, max_iter=30, tol=1e-3)
        effects: list[Effects] = [{} for _ in fits]
        if random:
            fits, effects = _random_fits(rows, fits, 0.1)
        by_key = {(f.model, f.train): i for i, f in enumerate(fits)}
        tasks = [(by_key[m, use[k]], k) for m in models for k in range(len(block))]
        timed = [t for t in tasks if random and block[t[1]].scheme in ("holdout", "expanding")]
        plain = [t for t in tasks if t not in timed]
        scores = score_sets(rows, [(fits[i], k) for i, k in plain], "size")
        if timed:
            scores += score_conditional(rows, [(i, fits[i], k) for i, k in timed], effects, "size")
        metric_rows += _metric_rows([(fits[i], block[k]) for i, k in plain + timed], scores)
        all_fits += fits
        rows.release()
    pairs.unpersist()
    return _summarise(pairs.sparkSession, metric_rows, all_fits, "MSE", top)
