"""Closed-form models, folds, metrics and diagnostics, with literal coefficients where scored."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..evaluation import folds as V, metrics as M, residuals as S
from ..functions import columns as X
from ..functions.terms import Design, crossed, main_effects
from ..models import closed as K
from ..operators import cohorts, distribution as Q, summary
from ..sources import tables as D
from .panels import LEVELS, NUM_DEAD, growth, survival, trial, TRIAL, with_plots
from .registry import PAIRS, PANEL, query, r6, rounded

# Literal coefficients: (intercept, per unit) of two scored hazard models and one growth model.
HAZARD_A, HAZARD_B = (-3.2, -0.0008), (-2.4, -0.15)
GROWTH_A, GROWTH_SD = (1.0, 0.86), (0.30, -0.02)

SCORED = (
    PAIRS
    + f""", scored AS (
  SELECT *, 1 - exp(-exp({HAZARD_A[0]} + {HAZARD_A[1]} * HT + ln(CensusInterval))) AS pred_linear,
         1 - exp(-exp({HAZARD_B[0]} + {HAZARD_B[1]} * ln(HT) + ln(CensusInterval))) AS pred_log FROM surv),
resid AS (
  SELECT *, {GROWTH_A[0]} + {GROWTH_A[1]} * ln(HT) AS fitted_mean,
         (ln(HT_next) - ({GROWTH_A[0]} + {GROWTH_A[1]} * ln(HT))) / exp({GROWTH_SD[0]} + {GROWTH_SD[1]} * ln(HT))
         AS scaled_resid FROM grow)
"""
)


def scored(spark, sf):
    linear, log = Design(main_effects("HT")), Design(main_effects("log(HT)"))
    offset = F.log("CensusInterval")
    return survival(spark, sf).withColumns(
        {
            "pred_linear": X.inverse_cloglog(linear.linear(HAZARD_A) + offset),
            "pred_log": X.inverse_cloglog(log.linear(HAZARD_B) + offset),
        }
    )


def residuals(spark, sf):
    log = Design(main_effects("log(HT)"))
    fitted, scale = log.linear(GROWTH_A), F.exp(log.linear(GROWTH_SD))
    return growth(spark, sf).withColumns(
        {"fitted_mean": fitted, "scaled_resid": S.scaled_residual(F.log("HT_next"), fitted, scale)}
    )


# --- closed-form models ----------------------------------------------------------------

ORIGIN = """count(*) AS n, round(sum({x} * {y}) / sum({x} * {x}), 6) AS slope,
  round(sqrt((sum({y} * {y}) - sum({x} * {y}) * sum({x} * {y}) / sum({x} * {x})) / (count(*) - 1) / sum({x} * {x})), 6)
  AS std_error,
  round(1 - (sum({y} * {y}) - sum({x} * {y}) * sum({x} * {y}) / sum({x} * {x})) / sum({y} * {y}), 6) AS r_squared"""


@query(
    "ols_origin",
    PANEL + TRIAL + ", t AS (SELECT HT, HT + deltaHT_annual AS y FROM trial WHERE deltaHT_annual IS NOT NULL) SELECT "
    + ORIGIN.format(x="HT", y="y") + " FROM t",
)
def _(spark, sf):
    return rounded(K.ols_origin(trial(spark, sf), "HT", "HT_next_annual"))


@query(
    "ols_log",
    PANEL + TRIAL + """, t AS (SELECT ln(HT) AS x, ln(HT + deltaHT_annual) AS y FROM trial)
SELECT CAST(regr_count(y, x) AS BIGINT) AS n, round(regr_slope(y, x), 6) AS slope, round(regr_intercept(y, x), 6) AS intercept,
round(regr_r2(y, x), 6) AS r_squared FROM t""",
)
def _(spark, sf):
    return rounded(K.ols_simple(trial(spark, sf), F.log("HT"), F.log("HT_next_annual")))


@query(
    "ols_by_area",
    PANEL + """SELECT AREA, CAST(regr_count(DAH, HT) AS BIGINT) AS n, round(regr_slope(DAH, HT), 6) AS slope,
    round(regr_intercept(DAH, HT), 6) AS intercept, round(regr_r2(DAH, HT), 6) AS r_squared FROM panel GROUP BY 1""",
)
def _(spark, sf):
    return rounded(K.ols_simple(D.line_panel(spark, sf), F.col("HT"), F.col("DAH"), ["AREA"]))


@query(
    "corr_test",
    PANEL + """, c AS (SELECT corr(HT, DAH) AS r, count(*) AS n FROM panel WHERE HT IS NOT NULL AND DAH IS NOT NULL)
SELECT round(r, 6) AS r, n, round(r * sqrt((n - 2) / (1 - r * r)), 6) AS t, n - 2 AS dof FROM c""",
)
def _(spark, sf):
    return rounded(K.correlation_test(D.line_panel(spark, sf), "HT", "DAH"))


@query(
    "logit_by_group",
    PANEL + """, c AS (SELECT AREA, count(*) AS n, CAST(sum(CASE SEROTINY WHEN 'S' THEN 1 ELSE 0 END) AS BIGINT) AS events FROM panel
  WHERE SEROTINY IN ('S', 'O') AND CENSUS_NUM = 14 AND STAT = 1 GROUP BY 1)
SELECT AREA, n, events, round(events / n, 6) AS proportion,
  CASE WHEN events > 0 AND events < n THEN round(ln(events / (n - events)), 6) END AS log_odds,
  CASE WHEN events > 0 AND events < n THEN round(sqrt(1 / (n * (events / n) * (1 - events / n))), 6) END AS std_error FROM c""",
)
def _(spark, sf):
    cones = cohorts.last_census_cones(D.line_panel(spark, sf), D.LINE_CENSUSES)
    return rounded(K.logit_by_group(cones, "SEROTINY_binary", "AREA"))


def first_sizes(spark, sf):
    alive3 = cohorts.cohort_first_year(D.line_panel(spark, sf)).filter(F.col("alive3") == 1)
    return alive3.filter(F.col("HT").isNotNull())


FIRST = """, first AS (
  SELECT IND_ID, AREA, SITEAREA, HT FROM panel WHERE CENSUS_NUM = 3 AND COHORT IN (1, 2) AND STAT = 1 AND HT IS NOT NULL)
"""


@query(
    "lognormal_by_site",
    PANEL + FIRST + """SELECT SITEAREA, count(*) AS n, round(avg(ln(HT)), 6) AS mu, round(stddev_pop(ln(HT)), 6) AS sigma,
    round(-count(*) * (0.5 * ln(2 * pi()) + 0.5 + ln(stddev_pop(ln(HT)))), 6) AS loglik FROM first GROUP BY 1""",
)
def _(spark, sf):
    return rounded(K.lognormal_by_group(first_sizes(spark, sf), "HT", ["SITEAREA"]))


@query(
    "lognormal_combined_areas",
    PANEL + """, late AS (SELECT CASE WHEN AREA = 'A0' THEN 'A0' ELSE 'REST' END AS AREA_combined, ln(HT) AS l FROM panel
  WHERE COHORT IN (2, 3, 5, 7, 9, 10) AND CENSUS_NUM = COHORT AND STAT = 1 AND HT IS NOT NULL)
SELECT AREA_combined, count(*) AS n, round(avg(l), 6) AS mu, round(stddev_pop(l), 6) AS sigma,
  round(-count(*) * (0.5 * ln(2 * pi()) + 0.5 + ln(stddev_pop(l))), 6) AS loglik FROM late GROUP BY 1""",
)
def _(spark, sf):
    late = cohorts.later_cohort_sizes(D.line_panel(spark, sf), (2, 3, 5, 7, 9, 10), "A0", "REST")
    return rounded(K.lognormal_by_group(late, "HT", ["AREA_combined"]))


@query(
    "lognormal_aic",
    PANEL + FIRST + """, f AS (SELECT SITEAREA, -count(*) * (0.5 * ln(2 * pi()) + 0.5 + ln(stddev_pop(ln(HT)))) AS ll
  FROM first GROUP BY 1)
SELECT round(sum(ll), 6) AS loglik, count(*) * 2 AS k, round(-2 * sum(ll) + 4 * count(*), 6) AS AIC FROM f""",
)
def _(spark, sf):
    return rounded(K.aic_of_groups(K.lognormal_by_group(first_sizes(spark, sf), "HT", ["SITEAREA"])))


@query(
    "skewnormal_start",
    PANEL + FIRST + """, b AS (SELECT SITEAREA, avg(ln(HT)) AS m, stddev_samp(ln(HT)) AS s, -2.0::DOUBLE AS nu0,
  -2 / sqrt(5) AS delta FROM first GROUP BY 1),
c AS (SELECT *, s / sqrt(1 - 2 * delta * delta / pi()) AS sig0 FROM b)
SELECT SITEAREA, round(m, 6) AS m, round(s, 6) AS s, nu0, round(delta, 6) AS delta, round(sig0, 6) AS sig0,
       round(m - sig0 * delta * sqrt(2 / pi()), 6) AS mu0 FROM c""",
)
def _(spark, sf):
    return rounded(K.skewnormal_start(first_sizes(spark, sf), "HT", ["SITEAREA"]))


@query(
    "skewnormal_moments",
    PANEL + FIRST + """, s AS (SELECT SITEAREA, count(*) AS n, avg(ln(HT)) AS m1, avg(ln(HT) * ln(HT)) AS m2,
  avg(ln(HT) * ln(HT) * ln(HT)) AS m3 FROM first GROUP BY 1),
a AS (SELECT *, sqrt(m2 - m1 * m1) AS sd, (m3 - 3 * m1 * m2 + 2 * m1 * m1 * m1) / pow(m2 - m1 * m1, 1.5) AS skew FROM s),
b AS (SELECT *, greatest(least(skew, 0.99), -0.99) AS g FROM a),
c AS (SELECT *, sign(g) * sqrt(pi() / 2 * pow(abs(g), 2.0 / 3) / (pow(abs(g), 2.0 / 3) + pow((4 - pi()) / 2, 2.0 / 3))) AS delta FROM b),
d AS (SELECT *, sd / sqrt(1 - 2 / pi() * delta * delta) AS omega FROM c)
SELECT SITEAREA, n, round(m1, 6) AS mean, round(sd, 6) AS sd, round(skew, 6) AS skew,
  round(m1 - omega * delta * sqrt(2 / pi()), 6) AS xi, round(omega, 6) AS omega, round(delta / sqrt(1 - delta * delta), 6) AS nu,
  abs(skew) > 0.99 AS clamped
FROM d""",
)
def _(spark, sf):
    return rounded(K.skewnormal_moments(first_sizes(spark, sf), "HT", ["SITEAREA"]))


@query(
    "smearing",
    SCORED + """, s AS (SELECT avg(exp(ln(HT_next) - fitted_mean)) AS smear FROM resid)
SELECT IND_ID, CENSUS_NUM, round(exp(fitted_mean) * smear, 6) AS corrected FROM resid, s""",
)
def _(spark, sf):
    rows = residuals(spark, sf)
    smear = K.smearing_factor(rows, F.log("HT_next"), F.col("fitted_mean"))
    return rounded(
        K.back_transform(rows, F.col("fitted_mean"), smear, "corrected").select("IND_ID", "CENSUS_NUM", "corrected")
    )


@query(
    "score_population",
    SCORED + "SELECT IND_ID, CENSUS_NUM, round(pred_linear, 6) AS pred_linear, round(pred_log, 6) AS pred_log FROM scored",
)
def _(spark, sf):
    return rounded(scored(spark, sf).select("IND_ID", "CENSUS_NUM", "pred_linear", "pred_log"))


@query(
    "hurdle_mean",
    PANEL + """SELECT IND_ID, round((1 - 1 / (1 + exp(-(0.5 - 0.2 * ln(HT))))) * exp(-0.4 + 0.2 * ln(HT))
  / (1 - pow(1 + exp(-0.4 + 0.2 * ln(HT)) / 1.5, -1.5)), 6) AS pred_cone
FROM panel WHERE STAT = 1 AND HT IS NOT NULL AND CENSUS_NUM = 14""",
)
def _(spark, sf):
    cones = cohorts.last_census_cones(D.line_panel(spark, sf), D.LINE_CENSUSES)
    log = Design(main_effects("log(HT)"))
    zero, mu = X.inverse_logit(log.linear((0.5, -0.2))), F.exp(log.linear((-0.4, 0.2)))
    return cones.select("IND_ID", r6(X.hurdle_mean(zero, mu, F.lit(1.5)), "pred_cone"))


@query(
    "basis_terms",
    PAIRS + """, k AS (SELECT min(HT) AS lo, quantile_cont(HT, 1.0 / 3) AS k1, quantile_cont(HT, 2.0 / 3) AS k2, max(HT) AS hi
  FROM surv),
u AS (SELECT IND_ID, CENSUS_NUM, AREA, HT, (HT - lo) / (hi - lo) AS t, (k1 - lo) / (hi - lo) AS a1, (k2 - lo) / (hi - lo) AS a2 FROM surv, k),
d AS (SELECT *, pow(greatest(t, 0), 3) - pow(greatest(t - 1, 0), 3) AS d0,
  (pow(greatest(t - a1, 0), 3) - pow(greatest(t - 1, 0), 3)) / (1 - a1) AS d1,
  (pow(greatest(t - a2, 0), 3) - pow(greatest(t - 1, 0), 3)) / (1 - a2) AS d2 FROM u)
SELECT IND_ID, CENSUS_NUM, round(t, 6) AS ns1, round(d0 - d2, 6) AS ns2, round(d1 - d2, 6) AS ns3,
  round(ln(HT), 6) AS log_ht, HT * HT AS ht2, CASE WHEN AREA = 'A1' THEN HT ELSE 0.0 END AS ht_a1 FROM d""",
)
def _(spark, sf):
    pairs = survival(spark, sf)
    knots = [r["quantile"] for r in Q.exact_quantiles(pairs, [], "HT", [0, 1 / 3, 2 / 3, 1]).orderBy("prob").collect()]
    design = Design((("ns(HT)",), ("log(HT)",), ("HT^2",), ("HT", "AREA")), {"AREA": LEVELS}, {"HT": knots})
    cols = dict(design.columns({"HT": F.col("HT"), "AREA": F.col("AREA")}))
    names = {"ns(HT)1": "ns1", "ns(HT)2": "ns2", "ns(HT)3": "ns3", "log(HT)": "log_ht", "HT^2": "ht2", "HT:AREA[A1]": "ht_a1"}
    return rounded(pairs.select("IND_ID", "CENSUS_NUM", *[cols[k].alias(v) for k, v in names.items()]))


# --- distributions ---------------------------------------------------------------------


@query(
    "height_bins",
    PAIRS + """, br AS (SELECT quantile_cont(HT, [0.0, 0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.45, 0.5, 0.55, 0.6, 0.65, 0.7, 0.75,
  0.8, 0.85, 0.9, 0.95, 1.0]) AS q FROM surv),
z AS (SELECT HT, Dead_next, greatest(len([x for x in q if HT > x]), 1) AS bin, q FROM surv, br)
SELECT CAST(bin AS INTEGER) AS bin, count(*) AS n, CAST(sum(Dead_next) AS BIGINT) AS deaths,
  round((any_value(q[bin]) + any_value(q[bin + 1])) / 2, 6) AS midpoint FROM z GROUP BY 1""",
)
def _(spark, sf):
    pairs = survival(spark, sf)
    binned = Q.bin_by_breaks(pairs, "HT", Q.break_table(pairs, "HT", 20), "bin")
    mid = (F.get("breaks", F.col("bin") - 1) + F.get("breaks", F.col("bin"))) / 2
    return rounded(
        binned.groupBy("bin").agg(
            F.count(F.lit(1)).alias("n"), F.sum("Dead_next").alias("deaths"), F.first(mid).alias("midpoint")
        )
    )


@query(
    "height_histogram",
    PANEL + """, h AS (SELECT AREA, HT FROM panel WHERE COHORT = 1 AND HT IS NOT NULL),
lim AS (SELECT min(HT) AS lo, (max(HT) - min(HT)) / 30 AS w FROM h),
c AS (SELECT AREA, CAST(least(floor((HT - lo) / w), 29) AS INTEGER) AS bin, count(*) AS count, any_value(lo) AS lo,
  any_value(w) AS w FROM h, lim GROUP BY 1, 2)
SELECT AREA, bin, round(lo + bin * w, 6) AS lower, count, round(count / (sum(count) OVER (PARTITION BY AREA) * w), 6) AS density
FROM c""",
)
def _(spark, sf):
    return rounded(Q.histogram(D.line_panel(spark, sf).filter(F.col("COHORT") == 1), "HT", ["AREA"]))


@query(
    "height_boxplot",
    PANEL + """, h AS (SELECT CENSUS_NUM, AREA, HT FROM panel WHERE COHORT = 1 AND HT IS NOT NULL),
q AS (SELECT CENSUS_NUM, AREA, count(*) AS n, quantile_cont(HT, 0.25) AS q1, quantile_cont(HT, 0.5) AS median,
  quantile_cont(HT, 0.75) AS q3 FROM h GROUP BY 1, 2)
SELECT CENSUS_NUM, AREA, any_value(n) AS n, round(any_value(q1), 6) AS q1, round(any_value(median), 6) AS median,
  round(any_value(q3), 6) AS q3,
  min(HT) FILTER (WHERE HT BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS whisker_low,
  max(HT) FILTER (WHERE HT BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS whisker_high,
  count(*) FILTER (WHERE NOT HT BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS n_outliers
FROM h JOIN q USING (CENSUS_NUM, AREA) GROUP BY 1, 2""",
)
def _(spark, sf):
    first = D.line_panel(spark, sf).filter(F.col("COHORT") == 1)
    return rounded(Q.boxplot(first, "HT", ["CENSUS_NUM", "AREA"]))


# Range of a measure that its box plot shows; values outside are cut before the quartiles are taken.
_CANOPY = "pi() * (WD1 / 2) * (WD2 / 2)"
BOX_LIMITS = {_CANOPY: 20000, "CONE_New": 30}


def _box_sql(value: str, source: str) -> str:
    return PANEL + f""", h AS (SELECT CENSUS_NUM, AREA, v FROM (SELECT CENSUS_NUM, AREA, {value} AS v FROM panel WHERE {source})
  WHERE v BETWEEN 0 AND {BOX_LIMITS[value]}),
q AS (SELECT CENSUS_NUM, AREA, count(*) AS n, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS median,
  quantile_cont(v, 0.75) AS q3 FROM h GROUP BY 1, 2)
SELECT CENSUS_NUM, AREA, any_value(n) AS n, round(any_value(q1), 6) AS q1, round(any_value(median), 6) AS median,
  round(any_value(q3), 6) AS q3,
  round(min(v) FILTER (WHERE v BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)), 6) AS whisker_low,
  round(max(v) FILTER (WHERE v BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)), 6) AS whisker_high,
  count(*) FILTER (WHERE NOT v BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS n_outliers
FROM h JOIN q USING (CENSUS_NUM, AREA) GROUP BY 1, 2"""


@query("canopy_boxplot", _box_sql(_CANOPY, "COHORT = 1"))
def _(spark, sf):
    first = D.line_panel(spark, sf).filter(F.col("COHORT") == 1)
    sized = first.withColumn("CANOPY_AREA", X.canopy_area("WD1", "WD2"))
    return rounded(Q.boxplot(sized, "CANOPY_AREA", ["CENSUS_NUM", "AREA"], (0.0, float(BOX_LIMITS[_CANOPY]))))


@query("cone_boxplot", _box_sql("CONE_New", "true"))
def _(spark, sf):
    return rounded(Q.boxplot(D.line_panel(spark, sf), "CONE_New", ["CENSUS_NUM", "AREA"], (0.0, float(BOX_LIMITS["CONE_New"]))))


# --- folds and metrics -----------------------------------------------------------------


def _fold_query(spark, sf, **kw):
    pairs = survival(spark, sf)
    return V.fold_table(pairs, V.plan(pairs, **kw))


@query(
    "fold_plan_holdout",
    PAIRS + """SELECT 'holdout' AS scheme, 1 AS fold, CAST(NULL AS VARCHAR) AS held_site,
  count(*) FILTER (WHERE CENSUS_NUM <= 9) AS n_train, count(*) FILTER (WHERE CENSUS_NUM > 9) AS n_test FROM surv""",
)
def _(spark, sf):
    return _fold_query(spark, sf, schemes=("holdout",))


@query(
    "fold_plan_expanding",
    PAIRS + """, f AS (SELECT CAST(range AS INTEGER) AS fold FROM range(1, 4))
SELECT 'expanding' AS scheme, fold, CAST(NULL AS VARCHAR) AS held_site,
  count(*) FILTER (WHERE CENSUS_NUM <= 7 + fold) AS n_train,
  count(*) FILTER (WHERE CENSUS_NUM BETWEEN 8 + fold AND 11 + fold) AS n_test FROM surv, f GROUP BY fold""",
)
def _(spark, sf):
    return _fold_query(spark, sf, schemes=("expanding",))


@query(
    "fold_plan_levels",
    PAIRS + """, lv AS (SELECT CENSUS_NUM, row_number() OVER (ORDER BY CENSUS_NUM) AS pos FROM (SELECT DISTINCT CENSUS_NUM FROM grow)),
f AS (SELECT CAST(range AS INTEGER) AS fold FROM range(1, 4))
SELECT 'expanding' AS scheme, fold, CAST(NULL AS VARCHAR) AS held_site, count(*) FILTER (WHERE pos <= 3 + fold) AS n_train,
  count(*) FILTER (WHERE pos = 4 + fold) AS n_test FROM grow JOIN lv USING (CENSUS_NUM), f GROUP BY fold""",
)
def _(spark, sf):
    pairs = growth(spark, sf)
    return V.fold_table(pairs, V.plan(pairs, min_train=4, test_size=1, unit="level", schemes=("expanding",)))


@query(
    "fold_plan_site",
    PAIRS + """, pr AS (SELECT DISTINCT SITEAREA, AREA FROM surv),
ok AS (SELECT SITEAREA, CAST(row_number() OVER (ORDER BY SITEAREA) AS INTEGER) AS fold FROM pr
  WHERE AREA IN (SELECT AREA FROM pr GROUP BY 1 HAVING count(*) > 1))
SELECT 'site' AS scheme, fold, ok.SITEAREA AS held_site, count(*) FILTER (WHERE s.SITEAREA <> ok.SITEAREA) AS n_train,
  count(*) FILTER (WHERE s.SITEAREA = ok.SITEAREA) AS n_test FROM surv s, ok GROUP BY 1, 2, 3""",
)
def _(spark, sf):
    return _fold_query(spark, sf, schemes=("site",))


@query(
    "brier_logloss",
    SCORED + """, l AS (SELECT SITEAREA, Dead_next, m.model, CASE m.model WHEN 'linear' THEN pred_linear ELSE pred_log END AS p
  FROM scored, (VALUES ('linear'), ('log')) m(model))
SELECT model, SITEAREA, round(avg(pow(Dead_next - p, 2)), 6) AS Brier,
  round(-avg(Dead_next * ln(greatest(least(p, 1 - 1e-15), 1e-15)) + (1 - Dead_next) * ln(1 - greatest(least(p, 1 - 1e-15), 1e-15))), 6)
  AS LogLoss FROM l GROUP BY 1, 2""",
)
def _(spark, sf):
    both = scored(spark, sf).select(
        "SITEAREA",
        "Dead_next",
        F.explode(
            F.array(
                F.struct(F.lit("linear").alias("model"), F.col("pred_linear").alias("p")),
                F.struct(F.lit("log").alias("model"), F.col("pred_log").alias("p")),
            )
        ).alias("m"),
    )
    return rounded(
        both.groupBy(F.col("m.model").alias("model"), "SITEAREA").agg(
            M.brier("m.p", "Dead_next").alias("Brier"), M.log_loss("m.p", "Dead_next").alias("LogLoss")
        )
    )


@query(
    "mse_mae",
    SCORED + """SELECT CENSUS_NUM, round(avg(pow(ln(HT_next) - fitted_mean, 2)), 6) AS MSE,
  round(avg(abs(ln(HT_next) - fitted_mean)), 6) AS MAE,
  round(1 - avg(pow(ln(HT_next) - fitted_mean, 2)) / var_samp(ln(HT_next)), 6) AS Pseudo_R2 FROM resid GROUP BY 1""",
)
def _(spark, sf):
    y = F.log("HT_next")
    return rounded(
        residuals(spark, sf)
        .groupBy("CENSUS_NUM")
        .agg(
            M.mse("fitted_mean", y).alias("MSE"),
            M.mae("fitted_mean", y).alias("MAE"),
            M.pseudo_r_squared("fitted_mean", y).alias("Pseudo_R2"),
        )
    )


@query(
    "metrics_wide",
    SCORED + """SELECT 'linear' AS model, """
    + ", ".join(
        f"round(avg(pow(Dead_next - pred_linear, 2)) FILTER (WHERE CENSUS_NUM BETWEEN {8 + f} AND {11 + f}), 6) AS \"expanding{f}_Brier\""
        for f in (1, 2, 3)
    )
    + " FROM scored",
)
def _(spark, sf):
    folds = V.expanding([3, 5, 7, 9, 11, 12, 13, 14])
    rows = scored(spark, sf)
    per_fold = rows.select(
        "CENSUS_NUM",
        "Dead_next",
        "pred_linear",
        F.explode(F.array(*[F.when(f.test(), f.fold) for f in folds])).alias("fold"),
    ).filter(F.col("fold").isNotNull())
    long = per_fold.groupBy("fold").agg(M.brier("pred_linear", "Dead_next").alias("value")).select(
        F.lit("linear").alias("model"), F.lit("expanding").alias("scheme"), "fold", F.lit("Brier").alias("metric"), "value"
    )
    return rounded(M.to_wide(long, [("expanding", f.fold, "Brier") for f in folds]))


FOLD_BRIER = (
    SCORED
    + """, f AS (SELECT CAST(range AS INTEGER) AS fold FROM range(1, 4)),
long AS (SELECT 'linear' AS model, fold, avg(pow(Dead_next - pred_linear, 2)) AS value FROM scored, f
  WHERE CENSUS_NUM BETWEEN 8 + fold AND 11 + fold GROUP BY 2
  UNION ALL SELECT 'log', fold, avg(pow(Dead_next - pred_log, 2)) FROM scored, f
  WHERE CENSUS_NUM BETWEEN 8 + fold AND 11 + fold GROUP BY 2)
"""
)


def fold_brier(spark, sf):
    """Long metric table of two scored models over the expanding folds, in one pass."""
    folds = V.expanding([3, 5, 7, 9, 11, 12, 13, 14])
    aggs = [
        M.brier(F.when(f.test(), F.col(f"pred_{m}")), F.when(f.test(), F.col("Dead_next"))).alias(f"{m}_{f.fold}")
        for f in folds
        for m in ("linear", "log")
    ]
    cells = F.array(
        *[
            F.struct(
                F.lit(m).alias("model"),
                F.lit(f.scheme).alias("scheme"),
                F.lit(f.fold).alias("fold"),
                F.lit("Brier").alias("metric"),
                F.col(f"{m}_{f.fold}").alias("value"),
            )
            for f in folds
            for m in ("linear", "log")
        ]
    )
    return scored(spark, sf).agg(*aggs).select(F.explode(cells).alias("c")).select("c.*")


@query(
    "metric_means",
    FOLD_BRIER + "SELECT model, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd FROM long GROUP BY 1",
)
def _(spark, sf):
    return rounded(M.mean_over_folds(fold_brier(spark, sf), ["model"]))


@query(
    "best_model",
    FOLD_BRIER
    + """, m AS (SELECT model, avg(value) AS Brier FROM long GROUP BY 1)
SELECT arg_min(model, Brier) AS model, round(min(Brier), 6) AS Brier FROM m""",
)
def _(spark, sf):
    means = M.mean_over_folds(fold_brier(spark, sf), ["model"]).withColumnRenamed("mean", "Brier")
    return rounded(M.best(means, "Brier"))


@query(
    "rank_sum",
    SCORED + """, m AS (SELECT CAST(CENSUS_NUM AS VARCHAR) AS model, round(avg(pow(Dead_next - pred_linear, 2)), 3) AS a,
  round(avg(pow(Dead_next - pred_log, 2)), 3) AS b FROM scored GROUP BY 1),
r AS (SELECT *, rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2 AS rank_a,
  rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2 AS rank_b FROM m)
SELECT *, rank_a + rank_b AS rank_sum FROM r ORDER BY rank_sum, model LIMIT 4""",
)
def _(spark, sf):
    table = scored(spark, sf).groupBy(F.col("CENSUS_NUM").cast("string").alias("model")).agg(
        F.round(M.brier("pred_linear", "Dead_next"), 3).alias("a"),
        F.round(M.brier("pred_log", "Dead_next"), 3).alias("b"),
    )
    return M.rank_sum(table, ["a", "b"], top=4)


# --- diagnostics -----------------------------------------------------------------------


@query(
    "scaled_residuals",
    SCORED + "SELECT IND_ID, CENSUS_NUM, round(fitted_mean, 6) AS fitted_mean, round(scaled_resid, 6) AS scaled_resid FROM resid",
)
def _(spark, sf):
    return rounded(residuals(spark, sf).select("IND_ID", "CENSUS_NUM", "fitted_mean", "scaled_resid"))


# Fitted values are rounded before binning: at a break, the last bit must not decide the bin.
CURVES = (
    SCORED
    + """, rr AS (SELECT round(fitted_mean, 8) AS f, scaled_resid AS s FROM resid),
br AS (SELECT quantile_cont(f, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]) AS q FROM rr),
bb AS (SELECT f, s, CAST(greatest(len([x for x in q if f > x]), 1) AS INTEGER) AS bin FROM rr, br),
curves AS (SELECT bin, avg(f) AS fitted_mean, count(*) AS n, """
    + ", ".join(f"quantile_cont(s, {p}) AS {n}" for n, p in S.TAUS.items())
    + " FROM bb GROUP BY 1)\n"
)


def curves(spark, sf):
    rows = residuals(spark, sf).select(F.round("fitted_mean", 8).alias("f"), F.col("scaled_resid").alias("s"))
    return S.quantile_curves(rows, "f", "s", bins=10)


@query(
    "residual_quantiles",
    CURVES + "SELECT bin, n, round(fitted_mean, 6) AS fitted_mean, "
    + ", ".join(f"round({n}, 6) AS {n}" for n in S.TAUS) + " FROM curves",
)
def _(spark, sf):
    return rounded(curves(spark, sf))


@query(
    "np_shape",
    CURVES + f"""SELECT bin, round((q10 + q90 - 2 * q50) / (q90 - q10), 6) AS "NP_skewness",
  round((q95 - q05) / (q75 - q25), 6) AS "NP_kurtosis",
  round((q95 - q05) / (q75 - q25) / {S.GAUSSIAN_NP_KURTOSIS!r} - 1, 6) AS "NP_excess_kurtosis" FROM curves""",
)
def _(spark, sf):
    shape = S.nonparametric_shape(curves(spark, sf))
    return rounded(shape.select("bin", "NP_skewness", "NP_kurtosis", "NP_excess_kurtosis"))


@query(
    "pit_uniformity",
    SCORED + """, u AS (SELECT round(CASE WHEN Dead_next = 1 THEN 1 - pred_linear / 2 ELSE (1 - pred_linear) / 2 END, 9) AS u FROM scored),
e AS (SELECT u, count(*) AS cnt FROM u GROUP BY 1),
c AS (SELECT u, cnt, sum(cnt) OVER (ORDER BY u) AS upto, sum(cnt) OVER () AS n FROM e)
SELECT CAST(max(n) AS BIGINT) AS n, round(max(greatest(upto / n - u, u - (upto - cnt) / n)), 6) AS ks_distance,
  round(sum(CASE WHEN u < 0.01 OR u > 0.99 THEN cnt ELSE 0 END) / max(n), 6) AS outlier_share, 0.02::DOUBLE AS outlier_expected FROM c""",
)
def _(spark, sf):
    pit = S.mid_pit_binary(F.col("Dead_next"), F.col("pred_linear"))
    return rounded(S.uniformity(scored(spark, sf).select(F.round(pit, 9).alias("u")), "u"))


@query(
    "dispersion_ratio",
    SCORED + """SELECT round(sum(pow(Dead_next - pred_linear, 2) / (pred_linear * (1 - pred_linear))) / (count(*) - 2), 6)
  AS dispersion_ratio FROM scored""",
)
def _(spark, sf):
    p = F.col("pred_linear")
    return rounded(S.pearson_dispersion(scored(spark, sf), F.col("Dead_next"), p, p * (1 - p), 2))


# Standard normal quantiles.
NORMAL_GRID = (
    (0.05, -1.6448536269514729), (0.1, -1.2815515655446004), (0.25, -0.6744897501960817), (0.5, 0.0),
    (0.75, 0.6744897501960817), (0.9, 1.2815515655446004), (0.95, 1.6448536269514722),
)


@query(
    "qq_pairs",
    SCORED + """, g(prob, theoretical) AS (VALUES """
    + ", ".join(f"({p}::DOUBLE, {z!r}::DOUBLE)" for p, z in NORMAL_GRID)
    + """), k AS (SELECT AREA, scaled_resid AS r FROM resid)
SELECT AREA, prob, round(quantile, 6) AS quantile, round(theoretical, 6) AS theoretical FROM (
"""
    + " UNION ALL ".join(f"SELECT AREA, {p}::DOUBLE AS prob, quantile_cont(r, {p}) AS quantile FROM k GROUP BY 1" for p, _ in NORMAL_GRID)
    + ") JOIN g USING (prob)",
)
def _(spark, sf):
    return rounded(S.qq_pairs(residuals(spark, sf), "scaled_resid", NORMAL_GRID, ["AREA"]))


@query(
    "observed_predicted",
    SCORED + """SELECT AREA, PLOTCODE, count(*) AS n, CAST(sum(Dead_next) AS DOUBLE) AS Observed,
  round(avg(pred_linear), 6) AS PredictedProp, round(sum(Dead_next) / count(*), 6) AS ObservedProp FROM scored GROUP BY 1, 2""",
)
def _(spark, sf):
    return rounded(
        summary.observed_predicted(scored(spark, sf), ["AREA", "PLOTCODE"], "Dead_next", "pred_linear")
    )
