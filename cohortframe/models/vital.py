"""Vital-rate models on top of the scoring engine."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import replace

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.terms import AREA, GROWTH_MODELS, SURVIVAL_MODELS, TIME, Design, Term
from ..operators.distribution import exact_quantiles
from . import engine
from .engine import Fit, Rows, effects_table, fit_effects, fit_fixed, prepare, set_mask
from .families import SHAPE
from .mixed import SINGULAR_SD, search_variances

Z95 = 1.959963984540054
SPLINE_PROBS = (0.0, 1 / 3, 2 / 3, 1.0)


def spline_knots(df: DataFrame, value: str = "HT", weight: str | None = None) -> list[float]:
    """Boundary knots at the range, inner knots at the thirds, of the rows given."""
    rows = exact_quantiles(df, [], value, SPLINE_PROBS, weight=weight).orderBy("prob").collect()
    return [float(r["quantile"]) for r in rows]


def knots_by_set(
    df: DataFrame, train_sets: Sequence[Column], value: str = "HT", weight: str | None = None
) -> list[tuple[float, ...]]:
    """Spline knots of every training set in one job.

    Values are counted per set membership first, so the copies made per set are of distinct
    values, not of rows.
    """
    times = F.lit(1).cast("long") if weight is None else F.col(weight)
    marked = df.select(value, set_mask(train_sets).alias("__m"), times.alias("__w"))
    counted = marked.groupBy(value, "__m").agg(F.sum("__w").alias("__w"))
    member = F.array(*[F.when(F.col("__m").bitwiseAND(F.lit(1 << i)) != 0, i) for i in range(len(train_sets))])
    per_set = counted.select(value, "__w", F.explode(F.array_compact(member)).alias("__set"))
    knots: dict[int, dict[float, float]] = {}
    for r in exact_quantiles(per_set, ["__set"], value, SPLINE_PROBS, weight="__w").collect():
        knots.setdefault(r["__set"], {})[r["prob"]] = r["quantile"]
    empty = tuple(knots[next(iter(knots))][p] for p in SPLINE_PROBS)
    return [
        tuple(knots[i][p] for p in SPLINE_PROBS) if i in knots else empty for i in range(len(train_sets))
    ]


def start(design: Design, family: str, y_mean: float, aux: dict | None = None) -> np.ndarray:
    """Zero slopes and, where the design has an intercept, the link of the mean response."""
    names = design.names()
    beta = np.zeros(len(names))
    if "(Intercept)" in names:
        m = min(max(y_mean, 1e-6), 1 - 1e-6) if family in ("cloglog", "logit") else max(y_mean, 1e-6)
        link = {
            "cloglog": lambda p: math.log(-math.log1p(-p)),
            "logit": lambda p: math.log(p / (1 - p)),
            "gaussian": lambda p: y_mean,
            "student": lambda p: y_mean,
            "nbinom_identity": lambda p: p,
        }.get(family, math.log)
        beta[names.index("(Intercept)")] = link(m)
    elif family == "nbinom_identity":
        beta[:] = max(y_mean, 1e-3) / 10
    return beta


DEFAULT_AUX = {
    "nbinom": {"theta": 1.0},
    "nbinom_identity": {"theta": 1.0},
    "truncated_nbinom": {"theta": 1.0},
    "student": {"nu": 5.0, "gamma": (-1.0, 0.0)},
    "gaussian": {"sigma": 1.0},
}


def new_fit(model: str, design: Design, family: str, y_mean: float = 0.5, **kw) -> Fit:
    return Fit(
        model,
        design,
        family,
        beta=start(design, family, y_mean),
        aux=dict(DEFAULT_AUX.get(family, {})),
        **kw,
    )


# --- tables of results ------------------------------------------------------------------


def coefficient_table(spark: SparkSession, fits: Sequence[Fit]) -> DataFrame:
    """``model, fold, term, estimate, std_error, conf_low, conf_high``."""
    rows = []
    for f in fits:
        if f.error is not None:
            continue
        se = np.sqrt(np.maximum(np.diag(f.covariance), 0.0))
        rows += [
            (f.model, f.fold, t, float(b), float(s), float(b - Z95 * s), float(b + Z95 * s))
            for t, b, s in zip(f.design.names(), f.beta, se)
        ]
    return spark.createDataFrame(
        rows,
        "model string, fold string, term string, estimate double, std_error double, conf_low double, conf_high double",
    )


def _at_bound(f: Fit) -> bool:
    """Whether the shape parameter ended at a bound: the law's limit (Poisson, normal), not an estimate."""
    if f.family not in SHAPE:
        return False
    name, bounds = SHAPE[f.family]
    return name in f.aux and min(abs(math.log(f.aux[name]) - b) for b in bounds) < 1e-6


def fit_table(spark: SparkSession, fits: Sequence[Fit]) -> DataFrame:
    """One row per fit: likelihood, AIC, variance components, convergence, error text."""
    rows = [
        (
            f.model,
            f.fold,
            int(f.n),
            float(f.loglik) if f.error is None else None,
            float(f.aic) if f.error is None else None,
            float(f.sd_plot),
            float(f.sd_ind),
            bool((0 < f.sd_plot < SINGULAR_SD) or (0 < f.sd_ind < SINGULAR_SD)),
            float(f.aux["theta"]) if "theta" in f.aux else None,
            float(f.aux["nu"]) if "nu" in f.aux else None,
            bool(f.converged),
            int(f.iterations),
            _at_bound(f),
            f.error,
        )
        for f in fits
    ]
    return spark.createDataFrame(
        rows,
        "model string, fold string, n long, loglik double, aic double, sd_plot double, sd_ind double, singular boolean, "
        "theta double, nu double, converged boolean, iterations int, at_bound boolean, error string",
    )


# --- random intercepts ------------------------------------------------------------------


def fit_random(
    rows: Rows,
    fixed: Fit,
    individual: bool,
    first: float = 0.3,
    half: float = 1.0,
    rounds: int = 20,
    steps: int = 8,
    final_steps: int = 12,
    smallest: float = 0.12,
) -> tuple[Fit, DataFrame]:
    """Random intercepts of one fit, see ``mixed.search_variances``; the table ``plot, v`` of its plot effects."""
    spark = rows.df.sparkSession
    (fit,), (effects,) = search_variances(
        rows, [fixed], individual, first, half, rounds, steps, final_steps, smallest
    )
    if not effects and fit.error is None and rows.n_plots > engine.BROADCAST_CELLS:  # they stay a table
        _, table = fit_effects(rows, [fit], final_steps)
        return fit, table.select("plot", "v")
    return fit, effects_table(spark, [effects]).select("plot", "v")


# --- survival ---------------------------------------------------------------------------


def survival_rows(
    pairs: DataFrame,
    levels: Sequence[str],
    random: bool = False,
    train_sets=(),
    test_sets=(),
    individual: bool = True,
    weight: str | None = None,
) -> Rows:
    return prepare(
        pairs,
        F.col("Dead_next"),
        ["HT", TIME],
        {AREA: levels},
        offset=F.log("CensusInterval"),
        train_sets=train_sets,
        test_sets=test_sets,
        plot="PLOTCODE" if random else None,
        ind="IND_ID" if random and individual else None,
        merge=True,
        weight=weight,
    )


def survival_design(name: str, levels: Sequence[str], knots: Sequence[float] | None = None) -> Design:
    return Design(SURVIVAL_MODELS[name], {AREA: tuple(levels)}, {"HT": tuple(knots)} if knots else None)


def fit_survival(
    pairs: DataFrame, levels: Sequence[str], model: str = "ht_area_time", individual: bool = True
) -> tuple[Fit, DataFrame]:
    """One hazard model with random intercepts of plot and individual."""
    knots = spline_knots(pairs) if "ns(" in str(SURVIVAL_MODELS[model]) else None
    rows = survival_rows(pairs, levels, random=True, individual=individual)
    mean = rows.means("__y")[0]
    fixed = fit_fixed(rows, [new_fit(model, survival_design(model, levels, knots), "cloglog", mean)])[0]
    out = fit_random(rows, fixed, individual)
    rows.release()
    return out


def height_bin_hazard(pairs: DataFrame, levels: Sequence[str], steps: int = 20) -> tuple[Fit, DataFrame]:
    """Mortality by height bin: hazard of each bin relative to the first, at the bin's midpoint.

    Returns the fit and the table ``bin, midpoint, estimate, conf_low, conf_high``.
    """
    from ..functions.columns import break_midpoints
    from ..operators.distribution import quantile_bins

    pairs = pairs.select("PLOTCODE", AREA, "HT", TIME, "CensusInterval", "Dead_next").persist()
    binned, breaks = quantile_bins(pairs, "HT", steps)
    bins = tuple(range(1, steps + 1))
    coded = binned.withColumn("HT_bin", F.col("bin").cast("string"))
    rows = prepare(
        coded,
        F.col("Dead_next"),
        [TIME],
        {"HT_bin": [str(b) for b in bins], AREA: levels},
        offset=F.log("CensusInterval"),
        plot="PLOTCODE",
    )
    terms: tuple[Term, ...] = ((), ("HT_bin",), (AREA,), (TIME,))
    design = Design(terms, {"HT_bin": tuple(str(b) for b in bins), AREA: tuple(levels)})
    pairs.unpersist()
    mean = rows.means("__y")[0]
    fixed = fit_fixed(rows, [new_fit("height_bin", design, "cloglog", mean)])[0]
    fit, _ = fit_random(rows, fixed, individual=False)
    rows.release()
    spark = pairs.sparkSession
    table = coefficient_table(spark, [fit]).filter(F.col("term").startswith("HT_bin"))
    middles = spark.createDataFrame(
        [(f"HT_bin[{b}]", b, float(m)) for b, m in zip(bins, break_midpoints(breaks))],
        "term string, bin int, midpoint double",
    )
    reference = middles.filter(F.col("bin") == 1)
    rest = middles.filter(F.col("bin") > 1).join(F.broadcast(table), "term")
    out = reference.select("bin", "midpoint", F.lit(0.0).alias("estimate"), F.lit(None).cast("double").alias("conf_low"),
                           F.lit(None).cast("double").alias("conf_high"))
    return fit, out.unionByName(rest.select("bin", "midpoint", "estimate", "conf_low", "conf_high"))


# --- growth -----------------------------------------------------------------------------


def growth_rows(
    pairs: DataFrame,
    levels: Sequence[str],
    random: bool = False,
    train_sets=(),
    test_sets=(),
    individual: bool = True,
    weight: str | None = None,
) -> Rows:
    log, times = F.log("HT"), F.lit(1) if weight is None else F.col(weight)
    mean = F.sum(log * times) / F.sum(F.when(log.isNotNull(), times))
    middle = pairs.agg(mean).first()[0]  # centring keeps the two scale terms apart
    return prepare(
        pairs,
        F.log("HT_next"),
        ["HT", TIME, "CensusInterval"],
        {AREA: levels},
        z=F.log("HT") - F.lit(middle),
        train_sets=train_sets,
        test_sets=test_sets,
        plot="PLOTCODE" if random else None,
        ind="IND_ID" if random and individual else None,
        merge=True,
        weight=weight,
    )


def growth_design(name: str, levels: Sequence[str]) -> Design:
    return Design(GROWTH_MODELS[name], {AREA: tuple(levels)})


def start_growth(rows: Rows, models: Sequence[str], levels: Sequence[str], trains: Sequence[tuple[int, str]]) -> list[Fit]:
    """Least-squares start for t-error fits: coefficients and residual scale of a Gaussian fit to the first training set."""
    mean = rows.means("__y")[0]
    designs = {m: growth_design(m, levels) for m in models}
    first = trains[0][0]
    ols = fit_fixed(rows, [new_fit(m, designs[m], "gaussian", mean, train=first) for m in models], max_iter=4)
    return [
        replace(
            f,
            train=t,
            fold=fold,
            family="student",
            aux={"nu": 5.0, "gamma": (math.log(max(0.8 * f.aux["sigma"], 1e-6)), 0.0)},
            flat_scale=f.model == "baseline",
            converged=False,
            error=f.error,
        )
        for f in ols
        for t, fold in trains
    ]


def fit_growth(
    pairs: DataFrame, levels: Sequence[str], model: str = "ht_area_time", individual: bool = True
) -> tuple[Fit, DataFrame]:
    """One growth model: t errors, log-linear scale, random intercepts of plot and individual."""
    pairs = pairs.select("IND_ID", "PLOTCODE", AREA, "HT", "HT_next", TIME, "CensusInterval").persist()
    rows = growth_rows(pairs, levels, random=True, individual=individual)
    pairs.unpersist()
    fixed = fit_fixed(rows, start_growth(rows, [model], levels, [(0, "full")]), max_iter=30, tol=1e-3)[0]
    out = fit_random(rows, fixed, individual, first=0.1)
    rows.release()
    return out


# --- counts and first-year survival -----------------------------------------------------


def fit_poisson(df: DataFrame, y: str, design: Design, numeric: Sequence[str], factors=None, tol: float = 1e-12) -> Fit:
    rows = prepare(df, F.col(y), numeric, factors)
    mean = rows.means("__y")[0]
    fit = fit_fixed(rows, [new_fit(y, design, "poisson", mean)], tol=tol)[0]
    rows.release()
    return fit


def fit_hurdle(cones: DataFrame, levels: Sequence[str], random: bool = True) -> tuple[Fit, Fit]:
    """Zero part (logit of having none) and positive part (truncated NB2), both on log height by area."""
    terms = ((), ("log(HT)",), (AREA,), ("log(HT)", AREA))
    design = Design(terms, {AREA: tuple(levels)})
    zero_rows = prepare(cones, (F.col("CONE_Mature") == 0).cast("int"), ["HT"], {AREA: levels})
    share = zero_rows.means("__y")[0]
    zero = fit_fixed(zero_rows, [new_fit("zero", design, "logit", share)])[0]
    zero_rows.release()
    positive = cones.filter(F.col("CONE_Mature") > 0)
    rows = prepare(
        positive,
        F.col("CONE_Mature"),
        ["HT"],
        {AREA: levels},
        plot="PLOTCODE" if random else None,
    )
    mean = rows.means("__y")[0]
    count = fit_fixed(rows, [new_fit("count", design, "truncated_nbinom", mean)], max_iter=40)[0]
    if random:
        count, _ = fit_random(rows, count, individual=False)
    rows.release()
    return zero, count


RECRUIT_MODELS: Mapping[str, tuple[Term, ...]] = {
    "none": (("SDLAREA",), ("SDLAREA", "CONES1")),
    "area": (("SDLAREA",), ("SDLAREA", "CONES1", AREA)),
    "small_plot": (("SDLAREA",), ("SDLAREA", "SmallPlot"), ("SDLAREA", "CONES1")),
}


def fit_recruits(recruits: DataFrame, levels: Sequence[str]) -> list[Fit]:
    """First-year recruits: NB2 with identity link, no intercept, terms scaled by plot area."""
    rows = prepare(recruits, F.col("NumRecruits"), ["SDLAREA", "CONES1", "SmallPlot"], {AREA: levels})
    mean, area, cones = rows.means("__y", "SDLAREA", "CONES1")
    fits = []
    for name, terms in RECRUIT_MODELS.items():
        design = Design(terms, {AREA: tuple(levels)}, full=(AREA,))
        fit = new_fit(name, design, "nbinom_identity", mean)
        first = np.array([0.0 if "SmallPlot" in n else 0.5 * mean / area for n in design.names()])
        scale = np.array([max(cones, 1.0) if "CONES1" in n else 1.0 for n in design.names()])
        fits.append(replace(fit, beta=first / scale))
    out = fit_fixed(rows, fits, max_iter=40)
    rows.release()
    return out


def fit_later_recruits(seasons: DataFrame, levels: Sequence[str], random: bool = True) -> Fit:
    """Later recruits per plot and season: NB2, log link, offsets of area and seasons, plot intercept."""
    rows = prepare(
        seasons,
        F.col("NumRecruits"),
        [TIME],
        {AREA: levels},
        offset=F.log("SDLAREA") + F.log("Interval"),
        plot="PLOTCODE" if random else None,
    )
    rate = rows.df.agg(F.sum(F.col("__y") * F.col("__w")) / F.sum(F.exp("__o") * F.col("__w"))).first()[0]
    design = Design(((), (AREA,), (TIME,)), {AREA: tuple(levels)})
    fit = fit_fixed(rows, [new_fit("later_recruits", design, "nbinom", rate)], max_iter=40)[0]
    if random:
        fit, _ = fit_random(rows, fit, individual=False)
    rows.release()
    return fit


def fit_first_year(cohort: DataFrame, levels: Sequence[str], weight: str | None = None) -> tuple[Fit, DataFrame]:
    """First-year survival: logit on area with a plot intercept."""
    rows = prepare(cohort, F.col("alive3"), [], {AREA: levels}, plot="PLOTCODE", weight=weight)
    mean = rows.means("__y")[0]
    design = Design(((), (AREA,)), {AREA: tuple(levels)})
    fixed = fit_fixed(rows, [new_fit("first_year", design, "logit", mean)])[0]
    out = fit_random(rows, fixed, individual=False)
    rows.release()
    return out


# --- scoring ----------------------------------------------------------------------------


def predictor(fit: Fit, offset: Column | None = None) -> Column:
    """Population-level linear predictor as a Spark column."""
    eta = fit.design.linear(fit.beta)
    return eta if offset is None else eta + offset


def conditional_predictor(df: DataFrame, fit: Fit, effects: DataFrame, offset: Column | None = None) -> DataFrame:
    """Add ``eta`` including plot effects; a plot without an effect gets 0."""
    joined = df.join(effects.withColumnsRenamed({"plot": "PLOTCODE", "v": "__effect"}), "PLOTCODE", "left")
    return joined.withColumn("eta", predictor(fit, offset) + F.coalesce("__effect", F.lit(0.0))).drop("__effect")
