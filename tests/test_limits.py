"""What lies outside a panel's range, fold rules that can't hold, and searches that must not depend on their start."""

import pytest
from pyspark.sql import functions as F

from cohortframe.models import vital
from cohortframe.models.engine import fit_fixed, prepare
from cohortframe.functions.terms import AREA, Design
from cohortframe.operators import cohorts
from cohortframe.plans import selection
from cohortframe.sources import tables


def test_censuses_beyond_the_range_are_left_out_and_counted(spark):
    seen = spark.createDataFrame([(1, 3, 5), (1, 16, 7), (2, 15, 1), (3, 0, 1), (3, -2, 1), (4, None, 1)], "IND_ID long, CENSUS_NUM int, n long")
    grid = tables.fill_censuses(seen, 15, ["n"])
    assert grid.groupBy("IND_ID", "CENSUS_NUM").count().where("count > 1").isEmpty()
    assert {(r.IND_ID, r.n_rows) for r in grid.groupBy("IND_ID").agg(F.count("*").alias("n_rows")).collect()} == {(1, 15), (2, 15)}
    audit = tables.outside_censuses(seen, 15).first()
    assert (audit.n_inside, audit.n_outside, audit.first_census, audit.last_census) == (2, 4, -2, 16)


def test_event_censuses_do_not_fold_months(spark, tmp_path, small):
    for name in ("customer", "nation", "region"):
        spark.read.parquet(f"{small}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    rows = [(1, "2024-01-01 10:00:00"), (1, "2024-01-31 10:00:00"), (1, "2024-02-01 10:00:00"), (2, "2024-02-03 00:00:00")]
    events = spark.createDataFrame(rows, "user_id long, at string").select(
        "user_id", F.to_timestamp_ntz("at").alias("ts"), F.lit("view").alias("event_type"), F.lit(1.0).alias("value")
    )
    events.write.parquet(f"{tmp_path}/events.parquet")
    panel = tables.event_panel(spark, str(tmp_path))
    got = {(r.IND_ID, r.CENSUS_NUM) for r in panel.collect()}
    assert got == {(1, k) for k in range(1, 16)} and panel.count() == 15


def test_growth_folds_need_enough_censuses(spark, small):
    from cohortframe.operators import transitions

    pairs = transitions.growth_transitions(tables.line_panel(spark, small), origin_date="1994-09-01")
    with pytest.raises(ValueError):
        selection.select_growth(pairs, ["A0", "A1", "A2", "A3"], min_train=50)


def test_variance_search_does_not_depend_on_its_start(spark, small):
    levels = ["A0", "A1", "A2", "A3"]
    cohort = cohorts.cohort_first_year(tables.line_panel(spark, small)).persist()
    rows = prepare(cohort, F.col("alive3"), [], {AREA: levels}, plot="PLOTCODE", ind="IND_ID")
    design = Design(((), (AREA,)), {AREA: tuple(levels)})
    mean = rows.df.agg(F.avg("__y")).first()[0]
    fixed = fit_fixed(rows, [vital.new_fit("first_year", design, "logit", mean)])[0]
    found = [vital.fit_random(rows, fixed, individual=False, first=s)[0] for s in (0.05, 1.5)]
    assert abs(found[0].loglik - found[1].loglik) < 1e-2
    assert abs(found[0].sd_plot - found[1].sd_plot) <= 0.02 * max(found[0].sd_plot, 0.5)
    rows.release()
