"""Iterative fits. Those with few coefficients have recursive SQL twins; tests check the others against dense solutions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..evaluation.folds import full_fit
from ..functions.terms import Design, crossed
from ..models import closed as K, vital as Y
from ..models.engine import merge_rows
from ..operators import cohorts
from ..plans.selection import select_growth, select_survival
from ..sources import tables as D
from . import fit_sql
from .panels import LEVELS, growth, survival, with_plots
from .registry import query, rounded


@query("glm_cloglog")
def _(spark, sf):
    """Fixed part of every candidate hazard model, all fitted in the same passes."""
    seen = ["AREA", "HT", "TimeSinceFire", "CensusInterval", "Dead_next"]
    pairs = merge_rows(survival(spark, sf), seen, "__n").persist()
    rows = Y.survival_rows(pairs, LEVELS, weight="__n")
    knots, mean = Y.spline_knots(pairs, weight="__n"), rows.means("__y")[0]
    pairs.unpersist()
    fits = Y.fit_fixed(
        rows, [Y.new_fit(m, Y.survival_design(m, LEVELS, knots), "cloglog", mean) for m in Y.SURVIVAL_MODELS]
    )
    rows.release()
    return rounded(Y.coefficient_table(spark, fits))


@query("glm_cloglog_ht", fit_sql.GLM_CLOGLOG_HT)
def _(spark, sf):
    """Hazard on height alone."""
    rows = Y.survival_rows(survival(spark, sf), LEVELS)
    mean = rows.means("__y")[0]
    fit = Y.fit_fixed(rows, [Y.new_fit("ht", Y.survival_design("ht", LEVELS), "cloglog", mean)], tol=1e-12)[0]
    rows.release()
    return rounded(Y.coefficient_table(spark, [fit]))


@query("glm_poisson", fit_sql.GLM_POISSON)
def _(spark, sf):
    panel = D.line_panel(spark, sf).filter(F.col("HT").isNotNull())
    design = Design(crossed("HT", by="AREA"), {"AREA": tuple(LEVELS)})
    fits = [Y.fit_poisson(panel, y, design, ["HT"], {"AREA": LEVELS}) for y in ("CONE_New", "CONE_Mature")]
    return rounded(Y.coefficient_table(spark, fits))


@query("glm_poisson_recruits", fit_sql.GLM_POISSON_RECRUITS)
def _(spark, sf):
    """Recruits of the first census on cones through the origin, and on live tops."""
    recruits = cohorts.recruits_by_plot(D.line_panel(spark, sf)).filter(F.col("CENSUS_NUM") == 1)
    plots = D.plot_information(spark, sf).select(F.col("OLDCODE").alias("PLOTCODE"), "CONES1", "TOPALIV1")
    joined = recruits.join(plots, "PLOTCODE", "left")
    origin = Y.fit_poisson(joined, "NumRecruits", Design((("CONES1",),)), ["CONES1"])
    tops = Y.fit_poisson(joined, "NumRecruits", Design(((), ("TOPALIV1",))), ["TOPALIV1"])
    return rounded(Y.coefficient_table(spark, [origin, tops]))


@query("ols_gram_anova", fit_sql.OLS_GRAM_ANOVA)
def _(spark, sf):
    panel = D.line_panel(spark, sf).filter(F.col("HT").isNotNull() & F.col("DAH").isNotNull())
    dated = panel.withColumn("DAYS", F.datediff("START_DATE", F.to_date(F.lit("1995-01-01"))).cast("double") / 365.25)
    return rounded(K.sequential_anova(dated, Design((("HT",), ("DAYS",), ("HT", "DAYS"))), F.col("DAH")))


@query("glmm_nested")
def _(spark, sf):
    fit, _ = Y.fit_survival(survival(spark, sf), LEVELS, "ht_area_time")
    return rounded(Y.coefficient_table(spark, [fit]))


@query("glmm_plot")
def _(spark, sf):
    fit, _ = Y.fit_first_year(cohorts.cohort_first_year(D.line_panel(spark, sf)), LEVELS)
    return rounded(Y.coefficient_table(spark, [fit]))


@query("conditional_scores")
def _(spark, sf):
    """Observed against conditional prediction per plot for first-year survival."""
    from ..functions.columns import inverse_logit
    from ..operators.summary import observed_predicted

    # The fit and the scores see area, plot and response only: a few rows a plot, for which the panel is read once.
    seen = ["AREA", "PLOTCODE", "alive3"]
    cohort = merge_rows(cohorts.cohort_first_year(D.line_panel(spark, sf)), seen, "__n").persist()
    fit, effects = Y.fit_first_year(cohort, LEVELS, weight="__n")
    scored = Y.conditional_predictor(cohort, fit, effects).withColumn("p_hat", inverse_logit("eta"))
    return rounded(observed_predicted(scored, ["AREA", "PLOTCODE"], "alive3", "p_hat", weight="__n"))


@query("nb_identity")
def _(spark, sf):
    recruits = cohorts.first_year_recruits(with_plots(spark, sf), D.plot_information(spark, sf))
    return rounded(Y.coefficient_table(spark, Y.fit_recruits(recruits, LEVELS)))


@query("nb_recruits")
def _(spark, sf):
    return rounded(
        Y.coefficient_table(spark, [Y.fit_later_recruits(cohorts.season_recruits(with_plots(spark, sf)), LEVELS)])
    )


@query("hurdle_nb")
def _(spark, sf):
    cones = cohorts.last_census_cones(D.line_panel(spark, sf), D.LINE_CENSUSES)
    return rounded(Y.coefficient_table(spark, list(Y.fit_hurdle(cones, LEVELS))))


@query("t_growth")
def _(spark, sf):
    fit, _ = Y.fit_growth(growth(spark, sf), LEVELS, "ht_area_time")
    return rounded(Y.coefficient_table(spark, [fit]))


@query("height_bin_hazard")
def _(spark, sf):
    return rounded(Y.height_bin_hazard(survival(spark, sf), LEVELS)[1])


@query("size_pca", fit_sql.SIZE_PCA)
def _(spark, sf):
    table, _ = K.size_pca(cohorts.size_complete_cases(D.line_panel(spark, sf)), ["HT", "DAH", "WD1", "WD2"])
    return rounded(table)


@query("size_pca_scores", fit_sql.SIZE_PCA_SCORES)
def _(spark, sf):
    _, scores = K.size_pca(cohorts.size_complete_cases(D.line_panel(spark, sf)), ["HT", "DAH", "WD1", "WD2"])
    return rounded(scores.select("IND_ID", "CENSUS_NUM", "PC1", "PC2"))


@query("model_selection")
def _(spark, sf):
    """Fourteen hazard models, hold-out, expanding and left-out-site folds, the best four."""
    return rounded(select_survival(survival(spark, sf), LEVELS).ranking)


@query("in_sample_scores")
def _(spark, sf):
    """AIC, Brier score and log loss of the hazard models on the rows they were fitted to."""
    done = select_survival(survival(spark, sf), LEVELS, folds=[full_fit()])
    scores = done.metrics.groupBy("model").agg(
        *[F.max(F.when(F.col("metric") == m, F.col("value"))).alias(m) for m in ("Brier", "LogLoss")]
    )
    return rounded(done.fits.select("model", F.col("aic").alias("AIC")).join(scores, "model"))


@query("mixed_model_selection")
def _(spark, sf):
    """The same with intercepts of plot and individual, variances searched for each model and training set."""
    return rounded(select_survival(survival(spark, sf), LEVELS, random=True).ranking)


@query("fit_status")
def _(spark, sf):
    """Likelihood, variances, convergence and error of every (model, training set) pair of the hazard models."""
    fits = select_survival(survival(spark, sf), LEVELS, random=True).fits
    return rounded(fits.select("model", "fold", "n", "loglik", "aic", "sd_plot", "sd_ind", "singular", "converged", "error"))


@query("growth_selection")
def _(spark, sf):
    """Nine growth models with the same three fold schemes, the best four."""
    return rounded(select_growth(growth(spark, sf), LEVELS).ranking)
