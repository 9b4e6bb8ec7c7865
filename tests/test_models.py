"""Estimators against Spark ML, dense NumPy solutions and known coefficients."""

import math
from dataclasses import replace

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.sql import functions as F

from cohortframe.functions.terms import Design, NumpyOps, crossed, main_effects, natural_spline
from cohortframe.models import closed as K, families, vital as Y
from cohortframe.models.engine import fit_effects, fit_fixed, merge_rows, prepare

RNG = np.random.default_rng(7)


@pytest.fixture(scope="module")
def panel(spark):
    """600 individuals in 12 plots of 2 areas, four rows each, with known effects."""
    n_ind, per = 600, 4
    ind = np.repeat(np.arange(n_ind), per)
    plot = ind % 12
    area = np.where(plot < 6, "A", "B")
    x = RNG.normal(0, 1, len(ind))
    v, u = RNG.normal(0, 0.7, 12), RNG.normal(0, 0.8, n_ind)
    gap = RNG.uniform(0.8, 2.0, len(ind))
    eta = -1.0 + 0.6 * x + 0.4 * (area == "B") + v[plot] + u[ind] + np.log(gap)
    dead = (RNG.random(len(ind)) < 1 - np.exp(-np.exp(eta))).astype(int)
    count = RNG.poisson(np.exp(0.3 + 0.5 * x))
    nb = RNG.negative_binomial(2.0, 2.0 / (2.0 + np.exp(0.8 + 0.4 * x)))
    size = 1.0 + 0.5 * x + 0.3 * RNG.standard_t(4, len(ind))
    rows = [
        (int(i), f"P{p}", a, float(xx), float(g), int(d), int(c), int(k), float(s))
        for i, p, a, xx, g, d, c, k, s in zip(ind, plot, area, x, gap, dead, count, nb, size)
    ]
    schema = "IND_ID long, PLOTCODE string, AREA string, x double, gap double, dead int, cnt int, nb int, size double"
    return spark.createDataFrame(rows, schema).cache()


def glr(df, label, family, link, offset=None):
    data = VectorAssembler(inputCols=["x"], outputCol="features").transform(df)
    extra = {"offsetCol": offset} if offset else {}
    return GeneralizedLinearRegression(family=family, link=link, labelCol=label, tol=1e-10, maxIter=50, **extra).fit(data)


def test_cloglog_with_offset_matches_spark_ml(panel):
    rows = prepare(panel, F.col("dead"), ["x"], offset=F.log("gap"))
    fit = fit_fixed(rows, [Y.new_fit("m", Design(main_effects("x")), "cloglog", 0.3)])[0]
    ml = glr(panel.withColumn("o", F.log("gap")), "dead", "binomial", "cloglog", "o")
    np.testing.assert_allclose(fit.beta, [ml.intercept, ml.coefficients[0]], rtol=1e-4)
    assert fit.converged and math.isclose(fit.loglik, -ml.summary.deviance / 2, rel_tol=1e-7)


def test_poisson_matches_spark_ml(panel):
    fit = Y.fit_poisson(panel, "cnt", Design(main_effects("x")), ["x"])
    ml = glr(panel, "cnt", "poisson", "log")
    np.testing.assert_allclose(fit.beta, [ml.intercept, ml.coefficients[0]], rtol=1e-4)
    np.testing.assert_allclose(np.sqrt(np.diag(fit.covariance)), [ml.summary.coefficientStandardErrors[1],
                                                                 ml.summary.coefficientStandardErrors[0]], rtol=1e-3)


def test_training_masks_equal_filtered_fits(panel):
    masks = [F.col("AREA") == "A", F.col("AREA") == "B"]
    rows = prepare(panel, F.col("dead"), ["x"], train_sets=masks)
    design = Design(main_effects("x"))
    both = fit_fixed(rows, [Y.new_fit("m", design, "logit", 0.3, train=i) for i in range(2)])
    for fit, mask in zip(both, masks):
        alone = fit_fixed(
            prepare(panel.filter(mask), F.col("dead"), ["x"]), [Y.new_fit("m", design, "logit", 0.3)]
        )[0]
        np.testing.assert_allclose(fit.beta, alone.beta, rtol=1e-6)
        assert fit.n == alone.n


def test_empty_training_set_is_reported_not_raised(panel):
    rows = prepare(panel, F.col("dead"), ["x"], train_sets=[F.lit(True), F.lit(False)])
    design = Design(main_effects("x"))
    good, bad = fit_fixed(rows, [Y.new_fit("m", design, "logit", 0.3, train=i) for i in range(2)])
    assert good.error is None and bad.error == "empty training set"


def test_negative_binomial_recovers(panel):
    rows = prepare(panel, F.col("nb"), ["x"])
    fit = fit_fixed(rows, [Y.new_fit("m", Design(main_effects("x")), "nbinom", 2.0)], max_iter=40)[0]
    np.testing.assert_allclose(fit.beta, [0.8, 0.4], atol=0.12)
    assert 1.5 < fit.aux["theta"] < 2.7 and fit.converged


def test_student_recovers_heavy_tails(panel):
    rows = prepare(panel, F.col("size"), ["x"], z=F.col("x"))
    design = Design(main_effects("x"))
    begin = replace(Y.new_fit("m", design, "student", 1.0), aux={"nu": 8.0, "gamma": (-1.0, 0.0)})
    fit = fit_fixed(rows, [begin], max_iter=40)[0]
    np.testing.assert_allclose(fit.beta, [1.0, 0.5], atol=0.03)
    assert 2.5 < fit.aux["nu"] < 7 and abs(math.exp(fit.aux["gamma"][0]) - 0.3) < 0.04
    assert abs(fit.aux["gamma"][1]) < 0.08


def dense_laplace(pdf, sd_plot, sd_ind):
    """Joint mode and Laplace likelihood with explicit random-effect columns."""
    x = np.column_stack([np.ones(len(pdf)), pdf["x"], pdf["AREA"] == "B"]).astype(float)
    z1 = (pdf["PLOTCODE"].to_numpy()[:, None] == np.unique(pdf["PLOTCODE"])).astype(float)
    z2 = (pdf["IND_ID"].to_numpy()[:, None] == np.unique(pdf["IND_ID"])).astype(float)
    a = np.hstack([x, z1, z2])
    prec = np.r_[np.zeros(3), np.full(z1.shape[1], sd_plot**-2), np.full(z2.shape[1], sd_ind**-2)]
    theta, y, o = np.zeros(a.shape[1]), pdf["dead"].to_numpy(float), np.log(pdf["gap"].to_numpy())
    theta[0] = -1.0
    for _ in range(25):
        _, g, w = families.cloglog(y, a @ theta + o, {}, None)
        theta += np.linalg.solve(a.T @ (a * w[:, None]) + np.diag(prec), a.T @ g - prec * theta)
    ll, g, w = families.cloglog(y, a @ theta + o, {}, None)
    r = a[:, 3:]
    logdet = np.linalg.slogdet(r.T @ (r * w[:, None]) + np.diag(prec[3:]))[1] - np.log(prec[3:]).sum()
    return theta[:3], theta[3 : 3 + z1.shape[1]], ll.sum() - 0.5 * (prec * theta**2).sum() - 0.5 * logdet


def test_nested_intercepts_match_a_dense_solution(panel):
    rows = prepare(
        panel, F.col("dead"), ["x"], {"AREA": ["A", "B"]}, offset=F.log("gap"), plot="PLOTCODE", ind="IND_ID",
        rows_per_task=50,
    )
    design = Design(main_effects("x", "AREA"), {"AREA": ("A", "B")})
    begin = replace(Y.new_fit("m", design, "cloglog", 0.3), sd_plot=0.6, sd_ind=0.9)
    (fit,), effects = fit_effects(rows, [begin], max_iter=25, tol=1e-10)
    beta, plots, loglik = dense_laplace(panel.toPandas(), 0.6, 0.9)
    np.testing.assert_allclose(fit.beta, beta, atol=2e-4)
    assert abs(fit.loglik - loglik) < 1e-3
    got = {r["plot"]: r["v"] for r in effects.collect()}
    np.testing.assert_allclose([got[p] for p in sorted(got)], plots, atol=1e-3)


def test_variance_search_finds_the_likelihood_peak(panel):
    rows = prepare(
        panel, F.col("dead"), ["x"], {"AREA": ["A", "B"]}, offset=F.log("gap"), plot="PLOTCODE", ind="IND_ID"
    )
    design = Design(main_effects("x", "AREA"), {"AREA": ("A", "B")})
    fixed = fit_fixed(rows, [Y.new_fit("m", design, "cloglog", 0.3)])[0]
    fit, _ = Y.fit_random(rows, fixed, individual=True)
    pdf = panel.toPandas()
    best = dense_laplace(pdf, fit.sd_plot, fit.sd_ind)[2]
    for dp, di in ((1.25, 1), (0.8, 1), (1, 1.25), (1, 0.8)):
        assert dense_laplace(pdf, fit.sd_plot * dp, fit.sd_ind * di)[2] <= best + 0.05
    assert 0.3 < fit.sd_plot < 1.3
    assert fit.loglik > fixed.loglik + 10


def test_truncated_score_is_the_derivative():
    y, eta, aux, h = np.array([1.0, 2, 5, 9]), np.array([-1.0, 0.2, 1.0, 2.0]), {"theta": 1.7}, 1e-5
    up, down = (families.truncated_nbinom(y, eta + s, aux, None)[0] for s in (h, -h))
    np.testing.assert_allclose(families.truncated_nbinom(y, eta, aux, None)[1], (up - down) / (2 * h), rtol=1e-5)


@pytest.mark.parametrize("name,y", [("cloglog", [0, 1, 1.0]), ("logit", [0, 1, 1.0]), ("poisson", [0, 3, 1.0]),
                                    ("nbinom", [0, 3, 1.0]), ("student", [0.1, -2, 1.0]), ("nbinom_identity", [0, 3, 1.0])])
def test_scores_are_derivatives(name, y):
    aux = {"theta": 1.3, "nu": 4.0, "gamma": (-0.2, 0.1)}
    y, eta, z, h = np.array(y, float), np.array([0.4, 0.9, 1.6]), np.array([0.5, 1.0, -1.0]), 1e-6
    f = families.FAMILIES[name]
    slope = (f(y, eta + h, aux, z)[0] - f(y, eta - h, aux, z)[0]) / (2 * h)
    np.testing.assert_allclose(f(y, eta, aux, z)[1], slope, rtol=1e-5)


def test_identity_link_counts_keep_means_positive(spark):
    rng = np.random.default_rng(3)
    area, cones = rng.choice([4.0, 10.0], 150), rng.uniform(0, 200, 150).round()
    mu = area * (0.4 + 0.05 * cones + 1.0 * (area == 4))
    y = rng.negative_binomial(3.0, 3.0 / (3.0 + mu))
    rows = [("A" if i % 2 else "B", float(a), float(c), float(a == 4), int(k)) for i, (a, c, k) in enumerate(zip(area, cones, y))]
    df = spark.createDataFrame(rows, "AREA string, SDLAREA double, CONES1 double, SmallPlot double, NumRecruits long")
    fits = {f.model: f for f in Y.fit_recruits(df, ["A", "B"])}
    assert all(f.converged for f in fits.values())
    truth = families.nbinom_identity(y.astype(float), mu, {"theta": 3.0}, None)[0].sum()
    assert fits["small_plot"].loglik > truth
    np.testing.assert_allclose(fits["small_plot"].beta[2], 0.05, atol=0.015)
    assert min(fits.values(), key=lambda f: f.aic).model == "small_plot"


def test_natural_spline_is_linear_outside_and_spans_three(spark):
    knots, x = [0.0, 1.0, 2.0, 5.0], np.linspace(-2, 7, 400)
    basis = np.column_stack(natural_spline(x, knots, NumpyOps))
    assert np.linalg.matrix_rank(np.column_stack([np.ones(len(x)), basis])) == 4
    for tail in (x < 0, x > 5):
        assert np.abs(np.diff(basis[tail], 2, axis=0)).max() < 1e-9
    df = spark.createDataFrame([(float(v),) for v in x], "HT double")
    cols = Design((("ns(HT)",),), knots={"HT": knots}).columns({"HT": F.col("HT")})
    got = np.array(df.select(*[c for _, c in cols]).collect())
    np.testing.assert_allclose(got, basis, atol=1e-9)


def test_anova_matches_least_squares(panel):
    pdf = panel.toPandas()
    x, y = pdf["x"].to_numpy(), pdf["size"].to_numpy()
    design = Design(((), ("x",), ("x^2",)))
    got = {r["term"]: r["sum_sq"] for r in K.sequential_anova(panel, design, F.col("size")).collect()}
    rss = [y @ y]
    for k in range(1, 4):
        a = np.column_stack([np.ones_like(x), x, x * x])[:, :k]
        rss.append(np.sum((y - a @ np.linalg.lstsq(a, y, rcond=None)[0]) ** 2))
    np.testing.assert_allclose([got["(Intercept)"], got["x"], got["x^2"], got["Residuals"]],
                               [rss[0] - rss[1], rss[1] - rss[2], rss[2] - rss[3], rss[3]], rtol=1e-6)


def test_pca_matches_numpy(panel):
    table, scores = K.size_pca(panel, ["x", "size", "gap"])
    pdf = panel.toPandas()[["x", "size", "gap"]]
    values = np.linalg.eigvalsh(np.corrcoef(pdf.to_numpy().T))[::-1]
    rows = table.orderBy("component").collect()
    np.testing.assert_allclose([r["sdev"] ** 2 for r in rows], values, rtol=1e-9)
    spread = scores.agg(F.var_samp("PC1"), F.var_samp("PC2"), F.corr("PC1", "PC2")).first()
    np.testing.assert_allclose([spread[0], spread[1], spread[2]], [values[0], values[1], 0.0], atol=1e-9)


def test_design_names_follow_terms():
    design = Design(crossed("HT", by="AREA"), {"AREA": ("A", "B", "C")})
    assert design.names() == ["(Intercept)", "HT", "AREA[B]", "AREA[C]", "HT:AREA[B]", "HT:AREA[C]"]


def nested_rows(panel, **kw):
    return prepare(
        panel, F.col("dead"), ["x"], {"AREA": ["A", "B"]}, offset=F.log("gap"), plot="PLOTCODE", ind="IND_ID", **kw
    )


def test_plot_effects_as_a_table_give_the_same_fit(panel, monkeypatch):
    from cohortframe.models import engine

    rows = nested_rows(panel)
    design = Design(main_effects("x", "AREA"), {"AREA": ("A", "B")})
    begin = replace(Y.new_fit("m", design, "cloglog", 0.3), sd_plot=0.6, sd_ind=0.9)
    (small,), one = fit_effects(rows, [begin], max_iter=25, tol=1e-10)
    monkeypatch.setattr(engine, "BROADCAST_CELLS", 0)
    (large,), two = fit_effects(rows, [begin], max_iter=25, tol=1e-10)
    np.testing.assert_allclose(small.beta, large.beta, atol=1e-5)
    assert abs(small.loglik - large.loglik) < 1e-6
    a, b = ({r["plot"]: r["v"] for r in t.collect()} for t in (one, two))
    np.testing.assert_allclose([a[p] for p in sorted(a)], [b[p] for p in sorted(b)], atol=1e-4)


def test_many_variance_searches_share_passes_and_stay_apart(panel):
    from cohortframe.models import mixed

    masks = [F.lit(True), F.col("PLOTCODE") < "P5", F.lit(False)]
    rows = nested_rows(panel, train_sets=masks, test_sets=masks)
    small = Design(main_effects("x"))
    design = Design(main_effects("x", "AREA"), {"AREA": ("A", "B")})
    fixed = fit_fixed(rows, [Y.new_fit(n, d, "cloglog", 0.3, train=t) for n, d in (("x", small), ("xa", design)) for t in range(3)])
    fits, effects = mixed.search_variances(rows, fixed, True)
    assert [f.error for f in fits] == [None, None, "empty training set"] * 2
    for k in (0, 1, 3, 4):
        part = panel.filter(masks[fits[k].train])
        alone, _ = Y.fit_random(nested_rows(part), fit_fixed(nested_rows(part), [fixed[k].__class__(**{**fixed[k].__dict__, "train": 0})])[0], True)
        assert fits[k].converged and abs(fits[k].loglik - alone.loglik) < 0.02
        np.testing.assert_allclose([fits[k].sd_plot, fits[k].sd_ind], [alone.sd_plot, alone.sd_ind], rtol=0.1)
    pdf = panel.toPandas()
    assert len(effects[1]) == pdf[pdf.PLOTCODE < "P5"].PLOTCODE.nunique()


def dense_modes(pdf, fit, effects, x):
    """Individual modes by a dense Newton iteration, fixed and plot effects given."""
    z = (pdf["IND_ID"].to_numpy()[:, None] == np.unique(pdf["IND_ID"])).astype(float)
    base = x @ fit.beta + np.log(pdf["gap"].to_numpy()) + np.array([effects.get(p, 0.0) for p in pdf["PLOTCODE"]])
    u = np.zeros(z.shape[1])
    for _ in range(60):
        _, g, w = families.cloglog(pdf["dead"].to_numpy(float), base + z @ u, {}, None)
        u += (z.T @ g - u / fit.sd_ind**2) / (z.T @ w + 1 / fit.sd_ind**2)
    return dict(zip(np.unique(pdf["IND_ID"]).tolist(), u))


def test_individual_effects_and_conditional_scores_match_dense_modes(panel):
    from cohortframe.models import mixed

    train, test = F.col("x") < 0.4, F.col("x") >= 0.4
    rows = nested_rows(panel, train_sets=[train], test_sets=[test])
    design = Design(main_effects("x"))
    begin = replace(Y.new_fit("m", design, "cloglog", 0.3), sd_plot=0.6, sd_ind=0.9)
    (fit,), effects = mixed.fit_effects_together(rows, [begin], None, 25, 1e-10)
    pdf = panel.toPandas()
    first, second = pdf[pdf.x < 0.4], pdf[pdf.x >= 0.4]

    def design_of(p):
        return np.column_stack([np.ones(len(p)), p["x"]])

    want = dense_modes(first, fit, effects[0], design_of(first))
    got = {r["ind"]: r["u"] for r in mixed.individual_effects(rows, [fit], effects).collect()}
    assert got.keys() == want.keys()
    np.testing.assert_allclose([got[i] for i in want], list(want.values()), atol=1e-6)
    eta = design_of(second) @ fit.beta + np.log(second["gap"]) + [effects[0].get(p, 0.0) for p in second["PLOTCODE"]]
    pred = 1 - np.exp(-np.exp(eta + [want.get(i, 0.0) for i in second["IND_ID"]]))  # unseen individuals: 0
    (score,) = mixed.score_conditional(rows, [(0, fit, 0)], effects, "binary")
    np.testing.assert_allclose(score["Brier"], np.mean((second["dead"] - pred) ** 2), rtol=1e-7)


def test_mixed_fit_without_training_rows_is_reported(panel):
    rows = nested_rows(panel, train_sets=[F.lit(True), F.lit(False)])
    design = Design(main_effects("x"))
    both = [replace(Y.new_fit("m", design, "cloglog", 0.3, train=t), sd_plot=0.5, sd_ind=0.5) for t in range(2)]
    good, bad = fit_effects(rows, both)[0]
    assert good.error is None and bad.error == "empty training set"


def test_zero_variance_is_found_by_its_slope(spark, panel):
    from cohortframe.models import mixed

    design = Design(main_effects("x", "AREA"), {"AREA": ("A", "B")})
    rows = nested_rows(panel)
    fixed = fit_fixed(rows, [Y.new_fit("m", design, "cloglog", 0.3)], tol=1e-12)[0]
    pdf = panel.toPandas()
    slopes = mixed.boundary_slopes(rows, [fixed])[0]
    tiny = 1e-3
    for k, sds in enumerate(((0.02, tiny), (tiny, 0.02))):
        rise = (dense_laplace(pdf, *sds)[2] - dense_laplace(pdf, tiny, tiny)[2]) / (0.02**2 - tiny**2)
        assert slopes[k] > 0 and abs(rise - slopes[k]) < 0.05 * abs(slopes[k])
    rng = np.random.default_rng(11)
    flat = pdf.assign(dead=(rng.random(len(pdf)) < 1 - np.exp(-np.exp(-1 + 0.5 * pdf.x + np.log(pdf.gap)))).astype(int))
    # Individuals without excess variance: every one has the same number of deaths at most by chance.
    rows = nested_rows(spark.createDataFrame(flat))
    fixed = fit_fixed(rows, [Y.new_fit("m", design, "cloglog", 0.3)], tol=1e-12)[0]
    slopes = mixed.boundary_slopes(rows, [fixed])[0]
    fit, effects = Y.fit_random(rows, fixed, individual=True)
    if max(slopes) <= 0:
        assert fit.loglik == fixed.loglik and fit.sd_plot < mixed.SINGULAR_SD and fit.sd_ind < mixed.SINGULAR_SD
        assert fit.converged and effects.count() == 0
    best = dense_laplace(flat, fit.sd_plot, fit.sd_ind)[2]
    assert all(dense_laplace(flat, p, i)[2] <= best + 0.05 for p, i in ((0.01, 0.01), (0.3, 0.01), (0.01, 0.3), (0.1, 0.1)))


def test_equal_rows_and_histories_are_merged_without_changing_a_fit(panel):
    from cohortframe.models import mixed

    copies = panel.crossJoin(panel.sparkSession.range(5).withColumnRenamed("id", "__copy"))
    copies = copies.withColumn("IND_ID", F.col("IND_ID") + 1000 * F.col("__copy")).drop("__copy")
    kw = dict(offset=F.log("gap"), train_sets=[F.lit(True), F.col("x") < 0.4], test_sets=[F.col("x") >= 0.4])
    plain, merged = (
        prepare(copies, F.col("dead"), ["x"], {"AREA": ["A", "B"]}, plot="PLOTCODE", ind="IND_ID", merge=m, **kw)
        for m in (False, True)
    )
    assert (plain.df.count(), merged.df.count(), plain.flat.df.count()) == (12000, 2400, 2400)
    flat = prepare(copies, F.col("dead"), ["x"], {"AREA": ["A", "B"]}, **kw)
    assert flat.df.count() == 2400 and flat.df.agg(F.sum("__w")).first()[0] == 12000
    design = Design(main_effects("x", "AREA"), {"AREA": ("A", "B")})
    fits = [replace(Y.new_fit("m", design, "cloglog", 0.3, train=t), sd_plot=0.6, sd_ind=s) for t in range(2) for s in (0.0, 0.9)]
    (one, first), (two, second) = (mixed.fit_effects_together(r, fits, None, 25, 1e-10) for r in (plain, merged))
    pdf = copies.toPandas()
    np.testing.assert_allclose(one[1].loglik, dense_laplace(pdf, 0.6, 0.9)[2], atol=1e-2)
    for a, b, u, v in zip(one, two, first, second):
        assert a.n == b.n and abs(a.loglik - b.loglik) < 1e-6 * abs(a.loglik)
        np.testing.assert_allclose(a.beta, b.beta, atol=1e-6)
        np.testing.assert_allclose([u[p] for p in sorted(u)], [v[p] for p in sorted(v)], atol=1e-6)
    np.testing.assert_allclose(*(mixed.boundary_slopes(r, fits)[0] for r in (plain, merged)), rtol=1e-9)
    scores = [mixed.score_conditional(r, [(1, one[1], 0)], first, "binary")[0] for r in (plain, merged)]
    np.testing.assert_allclose(scores[0]["Brier"], scores[1]["Brier"], rtol=1e-8)


def test_t_law_derivatives_in_nu():
    y = np.linspace(-2.0, 3.0, 7)
    for nu in (1.2, 5.0, 80.0):
        def ll(move):
            return families.student(y, np.zeros(7), {"nu": nu * math.exp(move), "gamma": (-0.3, 0.0)}, np.zeros(7))[0].sum()

        from cohortframe.models.engine import Fit, _scalar_terms

        fit = Fit("m", None, "student", aux={"nu": nu, "gamma": (-0.3, 0.0)})
        slope, bend = (v.sum() for v in _scalar_terms(fit, families.student, y, np.zeros(7), np.zeros(7), None)[:2])
        assert abs(slope - (ll(1e-4) - ll(-1e-4)) / 2e-4) < 1e-5 * (1 + abs(slope))
        assert abs(bend - (ll(1e-3) + ll(-1e-3) - 2 * ll(0.0)) / 1e-6) < 1e-4 * (1 + abs(bend))


def test_rows_merged_before_folds_and_knots_change_no_fit(spark, panel):
    copies = panel.select(F.round("x", 1).alias("HT"), "AREA", "dead", F.explode(F.array(*[F.lit(k) for k in range(3)])))
    masks = [F.lit(True), F.col("HT") > 0]
    merged = merge_rows(copies, ["HT", "AREA", "dead"], "n")
    assert merged.count() == merge_rows(copies.filter("col = 0"), ["HT", "AREA", "dead"], "n").count()
    assert Y.knots_by_set(merged, masks, weight="n") == Y.knots_by_set(copies, masks)
    assert Y.spline_knots(merged, weight="n") == Y.spline_knots(copies)
    design = Design(main_effects("HT"))
    fits = []
    for df, weight in ((copies, None), (merged, "n")):
        rows = prepare(df, F.col("dead"), ["HT"], {"AREA": ["A", "B"]}, train_sets=masks, weight=weight)
        fits.append(fit_fixed(rows, [Y.new_fit("m", design, "cloglog", 0.3, train=t) for t in (0, 1)]))
    for a, b in zip(*fits):
        assert a.n == b.n and math.isclose(a.loglik, b.loglik, rel_tol=1e-12)
        np.testing.assert_allclose(a.beta, b.beta, rtol=1e-9)
    with pytest.raises(ValueError, match="individuals"):
        prepare(merged.withColumn("IND_ID", F.lit(1)), F.col("dead"), ["HT"], plot="AREA", ind="IND_ID", weight="n")


def test_fixed_selection_keeps_distinct_pairs_only(spark):
    from cohortframe.plans.selection import KEYS, _seen

    row = ("S1", "A0", 3, 10.0, 1.5, 1.0, 0)
    pairs = spark.createDataFrame(
        [(i, "P1", *row) for i in range(5)] + [(9, "P2", *row[:-1], 1)], ["IND_ID", "PLOTCODE", *KEYS, "Dead_next"]
    )
    seen, weight = _seen(pairs, "Dead_next", False)
    assert sorted((r["Dead_next"], r[weight]) for r in seen.collect()) == [(0, 5), (1, 1)]
    everyone, weight = _seen(pairs, "Dead_next", True)
    assert weight is None and everyone.count() == 6


def test_conditional_scores_read_the_panel_once(spark, small):
    import __spark_entry__ as entry
    from cohortframe.entrypoints.panels import LEVELS
    from cohortframe.functions.columns import inverse_logit
    from cohortframe.operators import cohorts, summary
    from cohortframe.sources import tables as D

    found = entry.queries()["conditional_scores"](spark, small)
    assert "InMemoryRelation" in found._jdf.queryExecution().optimizedPlan().toString()
    cohort = cohorts.cohort_first_year(D.line_panel(spark, small))
    fit, effects = Y.fit_first_year(cohort, LEVELS)
    scored = Y.conditional_predictor(cohort, fit, effects).withColumn("p_hat", inverse_logit("eta"))
    single = summary.observed_predicted(scored, ["AREA", "PLOTCODE"], "alive3", "p_hat")
    want = {(r["AREA"], r["PLOTCODE"]): r for r in single.collect()}
    rows = found.collect()
    assert len(rows) == len(want)
    for r in rows:
        one = want[r["AREA"], r["PLOTCODE"]]
        assert (r["n"], r["Observed"]) == (one["n"], one["Observed"])
        assert abs(r["PredictedProp"] - one["PredictedProp"]) < 2e-6
