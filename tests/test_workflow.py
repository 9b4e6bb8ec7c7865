"""Files, cleaning of a literal census, folds, selection and plan shape."""

import pytest
from pyspark.sql import functions as F

from cohortframe.evaluation import folds as V, metrics as M
from cohortframe.operators import clean as C, cohorts, summary, transitions as T
from cohortframe.operators.reshape import census_dates_long, wide_to_long
from cohortframe.plans.clean_panel import CensusLayout, clean_panel
from cohortframe.plans.selection import select_survival, training_sets
from cohortframe.sources import files, repairs, tables as D

SURVIVAL_CENSUSES = [3, 5, 7, 9, 11, 12, 13, 14]


def test_census_file_to_panel(spark, tmp_path):
    columns = [
        "PLOTCODE", "COHORT", "TAG", "STAT14", "STAT15", "HTB14", "HTB15", "15W/subs", "DAH15", "CONE14_GOLD",
        "CONE14_GRAY", "CONE15_2YR", "CONE15_>2YR", "CONE15_NEW", "SEROTINY14", "NOTES15", "HTN9",
    ]
    lines = [
        "DW2A-3,1,a,0,0,120,>450,130,1.36/ 1.72,1,-,2,3,4,ns,tall,-",
        "DW2A-3,1,b,0,?,80,85,85,0,5,1,7,1,2,s,-,-",
        "RP1-1,2,c,1,-,60,-,-,-,2,2,-,-,-,6,-,-",
        "-,1,d,0,0,10,12,12,1,-,-,-,-,-,-,-,-",
        "RP1-9,1,e,0,0,10,12,12,1,-,-,-,-,-,-,-,-",
    ]
    path = tmp_path / "census.csv"
    path.write_text(",".join(columns) + "\n" + "\n".join(lines) + "\n")
    raw = files.read_census(spark, str(path), columns)
    plots = spark.createDataFrame(
        [("DW2A-3", 20.0, 10.0, "NONE"), ("RP1-1", 30.0, 4.0, "NONE"), ("RP1-9", 30.0, 4.0, "BURN")],
        "OLDCODE string, PLTAREA double, SDLAREA double, TMT string",
    )
    dates = spark.createDataFrame([(14, "2007-06-01"), (15, "2009-06-01")], "CENSUS_NUM int, d string").select(
        "CENSUS_NUM", F.to_date("d").alias("START_DATE")
    )
    panel = clean_panel(raw, plots, dates, CensusLayout())
    got = {(r["TAG"], r["CENSUS_NUM"]): r for r in panel.collect()}
    assert set(got) == {(t, c) for t in "abc" for c in (14, 15)}
    a15, b15, c14 = got["a", 15], got["b", 15], got["c", 14]
    assert (a15["STAT"], a15["HT"], a15["DAH"], a15["CONE_Mature"], a15["CONE_New"]) == (1, None, 0.79, 5.0, 4.0)
    assert (b15["STAT"], b15["HT"], b15["DAH"], b15["CONE_Mature"]) == (0, None, None, None)
    assert (c14["STAT"], c14["HT"], c14["CONE_Mature"], c14["AREA"], c14["SITEAREA"]) == (0, None, None, "RP", "RP1")
    assert got["a", 14]["SEROTINY"] == "O" and got["b", 14]["SEROTINY"] == "S" and got["c", 14]["SEROTINY"] == "6"
    assert sorted(r["IND_ID"] for r in panel.select("IND_ID").distinct().collect())[0] >= 1
    counts = C.null_key_counts(raw, ("PLOTCODE", "COHORT")).first()
    assert (counts["rows_in"], counts["removed_PLOTCODE"], counts["rows_kept"]) == (5, 1, 4)
    left = repairs.quarantine(raw, ["HTB15", "DAH15"]).collect()
    assert [(r["column"], r["raw"], r["n"]) for r in left] == [("HTB15", ">450", 1)]


def test_dates_and_gps_files(spark, tmp_path):
    sheet = tmp_path / "dates.csv"
    sheet.write_text(",,\n,,\nCensus,1,2\nStart on,1996-06-01,1996-09-15\nEnd on,1996-06-20,1996-10-01\n")
    dates = census_dates_long(files.read_census_dates(spark, str(sheet), 2), "...1").orderBy("CENSUS_NUM").collect()
    assert [(r["CENSUS_NUM"], str(r["START_DATE"]), r["CENSUS_MONTH"], r["CENSUS_YEAR"]) for r in dates] == [
        (1, "1996-06-01", 6, 1996), (2, "1996-09-15", 9, 1996)]
    assert files.read_census_dates(spark, str(sheet), 2, drop_unlabelled=False).count() == 5
    gps = tmp_path / "gps.csv"
    gps.write_text("SITE,PLOTCODE,LATDEG,LATMIN,LONGDEG,LONGMIN\nX,X1-1,40,30.0,72,45.0\n")
    from cohortframe.functions.columns import decimal_degrees

    row = files.read_gps(spark, str(gps)).select(
        decimal_degrees("LATDEG", "LATMIN"), decimal_degrees("LONGDEG", "LONGMIN", negative=True)
    ).first()
    assert tuple(row) == (40.5, -72.75)


def test_plots_file(spark, tmp_path):
    sheet = tmp_path / "plots.csv"
    sheet.write_text(
        "OLDCODE,SUBPLOT,AREA,PLTAREA,SDLAREA,TMT,CONES1,TOPALIV1\nDW2A-3,a,DW,20,10.5,NONE,3,\nRP1-1,,RP,30,4,BURN,,7\n"
    )
    assert [tuple(r) for r in files.read_plots(spark, str(sheet)).orderBy("OLDCODE").collect()] == [
        ("DW2A-3", "a", "DW", 20.0, 10.5, "NONE", 3.0, None), ("RP1-1", None, "RP", 30.0, 4.0, "BURN", None, 7.0)]


def test_model_tables_round_trip(spark, tmp_path):
    fits = spark.createDataFrame([("ht", -5.0, True), ("ht_area", -4.5, False)], "model string, loglik double, converged boolean")
    coefficients = spark.createDataFrame(
        [("ht", "HT", 0.5), ("ht_area", "HT", 0.4), ("ht_area", "AREA", None)], "model string, term string, estimate double"
    )
    files.write_models(fits, coefficients, str(tmp_path / "all"))
    for wrote, read in zip((fits, coefficients), files.read_models(spark, str(tmp_path / "all"))):
        assert sorted(map(str, wrote.collect())) == sorted(map(str, read.collect()))
    chosen = spark.createDataFrame([("ht_area",), ("ht_area",), ("absent",)], "model string")
    files.write_models(fits, coefficients, str(tmp_path / "some"), chosen)
    kept, terms = files.read_models(spark, str(tmp_path / "some"))
    assert [r["model"] for r in kept.collect()] == ["ht_area"] and terms.count() == 2


def test_round_trips(spark, small, tmp_path):
    panel = D.line_panel(spark, small).select("IND_ID", "CENSUS_NUM", "STAT", "HT").cache()
    files.write_panel(panel, str(tmp_path / "long"))
    back = files.read_panel(spark, str(tmp_path / "long"))
    assert back.select(panel.columns).exceptAll(panel).count() == 0 and back.count() == panel.count()
    pruned = back.filter(F.col("CENSUS_NUM") == 3)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(CENSUS_NUM" in pruned
    files.write_wide(panel, str(tmp_path / "wide"), fmt="csv")
    assert spark.read.csv(str(tmp_path / "wide"), header=True).filter("HT IS NULL").count() == panel.filter("HT IS NULL").count()


def test_wide_to_long_keeps_counts_and_types(spark):
    wide = spark.createDataFrame([(1, 1, 0, 2.5)], "id int, STAT__1 int, STAT__2 int, HT__2 double")
    rows = [tuple(r) for r in wide_to_long(wide, ["id"], ["STAT", "HT"]).orderBy("CENSUS_NUM").collect()]
    assert rows == [(1, 1, 1, None), (1, 2, 0, 2.5)]


def test_next_means_next_kept_census(spark):
    panel = spark.createDataFrame(
        [(1, 3, 1, 10.0), (1, 4, 1, 99.0), (1, 5, 1, 12.0), (1, 6, 0, None)],
        "IND_ID long, CENSUS_NUM int, STAT int, HT double",
    ).withColumn("START_DATE", F.make_date(F.lit(1990) + F.col("CENSUS_NUM"), F.lit(1), F.lit(1)))
    row = T.growth_transitions(panel, (3, 5)).first()
    assert (row["HT_next"], row["CENSUS_next"], row["deltaHT"]) == (12.0, 5, 2.0)


def test_extinct_site_is_kept_on_request(spark):
    panel = spark.createDataFrame(
        [(1, 1, 1, "a"), (1, 2, 0, "a"), (2, 1, 1, "b"), (2, 2, 1, "b")],
        "IND_ID long, CENSUS_NUM int, STAT int, SITEAREA string",
    ).withColumn("AREA", F.lit("A")).withColumn("START_DATE", F.lit("2000-01-01"))
    assert {r["SITEAREA"] for r in summary.prop_dead(panel).collect()} == {"b"}
    kept = {r["SITEAREA"]: r["PropDead"] for r in summary.prop_dead(panel, keep_extinct=True).collect()}
    assert kept == {"a": 1.0, "b": 0.0}


def test_strict_sum_is_null_with_a_null_member(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("b", 2.0)], "SEROTINY string, CONE_Mature double")
    df = df.withColumn("AREA", F.lit("A")).withColumn("CENSUS_NUM", F.lit(15))
    assert {r["SEROTINY"]: r["NumCones"] for r in summary.serotiny_counts(df).collect()} == {"a": None, "b": 2.0}


# --- folds -------------------------------------------------------------------------------


def test_time_folds_share_one_training_set():
    folds = [V.holdout(SURVIVAL_CENSUSES), *V.expanding(SURVIVAL_CENSUSES)]
    sets, use = training_sets(folds, SURVIVAL_CENSUSES)
    assert use[0] == use[2] == use[3] and len(sets) == 2
    assert folds[1].train_censuses == (3, 5, 7) and folds[2].train_censuses == (3, 5, 7, 9)
    assert folds[1].test_censuses == (9, 11, 12) and folds[3].test_censuses == (11, 12, 13, 14)


def test_level_folds_count_distinct_censuses():
    folds = V.expanding(SURVIVAL_CENSUSES, min_train=5, test_size=1, unit="level")
    assert [f.train_censuses[-1] for f in folds] == [11, 12, 13]
    assert [f.test_censuses for f in folds] == [(12,), (13,), (14,)]


def test_site_folds_cover_the_eligible_rows_once(spark, small):
    pairs = T.survival_transitions(D.line_panel(spark, small)).cache()
    folds = V.plan(pairs, schemes=("site",))
    table = V.fold_table(pairs, folds)
    eligible = pairs.join(summary.sites_for_holdout(pairs), ["SITEAREA", "AREA"], "left_semi").count()
    assert table.agg(F.sum("n_test")).first()[0] == eligible
    assert table.filter(F.col("n_train") + F.col("n_test") != pairs.count()).count() == 0


def test_metrics_do_not_depend_on_partitioning(spark):
    df = spark.range(1000).select((F.col("id") % 2).alias("y"), ((F.col("id") % 97) / 97).alias("p"))
    one, many = (d.agg(M.brier("p", "y"), M.log_loss("p", "y")).first() for d in (df.coalesce(1), df.repartition(13)))
    assert one[0] == pytest.approx(many[0]) and one[1] == pytest.approx(many[1])


def test_selection_ranks_and_scores_every_fold(spark, small):
    pairs = T.survival_transitions(D.line_panel(spark, small), origin_date="1994-09-01").cache()
    folds = V.plan(pairs)[:8]
    out = select_survival(pairs, ["A0", "A1", "A2", "A3"], ("baseline", "ht", "htS_area_time"), folds, top=2)
    assert out.ranking.count() == 2
    counted = {r["metric"]: r["n"] for r in out.metrics.groupBy("metric").agg(F.count("*").alias("n")).collect()}
    assert counted == {"Brier": 24, "LogLoss": 24}
    full = out.metrics.filter("model = 'baseline' AND scheme = 'full' AND metric = 'Brier'").first()["value"]
    rate = pairs.agg(F.avg("Dead_next")).first()[0]
    assert full == pytest.approx(rate * (1 - rate), rel=0.05)


# --- plan shape --------------------------------------------------------------------------


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_panel_to_transitions_needs_no_exchange_of_its_own(spark, small):
    spark.catalog.clearCache()
    base = plan_of(D.line_panel(spark, small)).count("Exchange hashpartitioning")
    pairs = plan_of(T.survival_transitions(D.line_panel(spark, small))).count("Exchange hashpartitioning")
    assert pairs == base == 2


def test_scan_reads_only_needed_columns(spark, small):
    plan = plan_of(summary.num_alive(D.line_panel(spark, small)))
    schema = [line for line in plan.splitlines() if "lineitem.parquet" in line][0]
    assert "l_comment" not in schema and "l_extendedprice" not in schema and "l_tax" not in schema


def test_no_python_in_panel_plans(spark, small):
    assert "Python" not in plan_of(T.growth_transitions(D.line_panel(spark, small)))


def test_first_year_cohort_needs_detection_alive(spark):
    rows = [(1, 1, 1, 1, None), (1, 1, 2, 1, None), (1, 1, 3, 1, 30.0), (2, 2, 1, None, None), (2, 2, 2, 0, None), (2, 2, 3, 0, None)]
    panel = spark.createDataFrame(rows, "IND_ID long, COHORT int, CENSUS_NUM int, STAT int, HT double")
    panel = panel.withColumns({"AREA": F.lit("A"), "SITEAREA": F.lit("A1"), "PLOTCODE": F.lit("A1-1"), "SDLAREA": F.lit(4.0)})
    out = cohorts.cohort_first_year(panel).collect()
    assert [(r["IND_ID"], r["alive3"], r["HT"], r["stat_det"]) for r in out] == [(1, 1, 30.0, 1)]
