"""Seasons told from census dates."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from cohortframe.operators import cohorts, reshape, seasons

# Two censuses a year from spring 1996 on, then one in every second year.
DATES = [(1, "1995-10-10"), (2, "1996-05-20"), (3, "1996-10-05")]
DATES += [(0, f"{y}-{day}") for y in (1997, 1998, 1999, 2000) for day in ("05-15", "10-01")]
DATES = [(i + 1, d) for i, (_, d) in enumerate(DATES)] + [(12, "2001-05-01"), (13, "2003-06-01"), (14, "2005-06-01"), (15, "2007-06-01")]


def table(spark, rows):
    return spark.createDataFrame([(c, dt.date.fromisoformat(d) if d else None) for c, d in rows], "CENSUS_NUM int, START_DATE date")


def test_midpoints_and_numbers_of_seasons(spark):
    got = {r["COHORT"]: (r["Year"], r["Interval"]) for r in seasons.census_seasons(table(spark, DATES)).collect()}
    assert got[1] == (1995.0, 1)
    assert got[2] == got[3] == (1996.0, 1)
    assert got[4] == got[5] == (1997.0, 1) and got[10] == got[11] == (2000.0, 1)
    assert got[12] == (2001.0, 1)
    assert [got[c] for c in (13, 14, 15)] == [(2002.5, 2), (2004.5, 2), (2006.5, 2)]


def test_census_without_a_date_and_no_census(spark):
    dates = table(spark, [(3, "1997-05-01"), (4, None), (5, "1999-03-31")])
    got = {r["COHORT"]: (r["Year"], r["Interval"]) for r in seasons.census_seasons(dates).collect()}
    assert got == {3: (1997.0, 1), 5: (1998.0, 1)}
    assert seasons.census_seasons(dates.where("false")).count() == 0


def test_surveyed_seasons_only_and_report_of_the_rest(spark):
    rows = [(i, "P1", "S", "A", 4.0, cohort, census) for i, cohort in enumerate((3, 3, 4, 16)) for census in (3, 4)]
    rows += [(9, "P2", "S", "A", 4.0, 4, 4), (9, "P2", "S", "A", 4.0, 4, 4)]
    panel = spark.createDataFrame(
        rows, "IND_ID int, PLOTCODE string, SITEAREA string, AREA string, SDLAREA double, COHORT int, CENSUS_NUM int"
    )
    panel = panel.withColumn("START_DATE", F.make_date(F.col("CENSUS_NUM") + 1994, F.lit(6), F.lit(1)))
    got = {(r["PLOTCODE"], r["Year"]): r["NumRecruits"] for r in cohorts.season_recruits(panel).collect()}
    assert got == {("P1", 1997.0): 2, ("P1", 1998.0): 1, ("P2", 1997.0): 0, ("P2", 1998.0): 1}
    axis = seasons.census_seasons(seasons.census_dates(panel))
    assert [tuple(r) for r in seasons.without_season(panel, axis).collect()] == [(16, 1)]
    later = axis.unionByName(axis.where("COHORT = 4").withColumn("COHORT", F.lit(16)).withColumn("Year", F.lit(2010.5)))
    got = {(r["PLOTCODE"], r["Year"]): r["NumRecruits"] for r in cohorts.season_recruits(panel, seasons=later).collect()}
    assert got["P1", 2010.5] == 1 and got["P2", 2010.5] == 0
    assert seasons.without_season(panel, later).count() == 0


def test_long_axis_is_refused(spark, monkeypatch):
    monkeypatch.setattr(reshape, "MAX_AXIS", 3)
    units = spark.createDataFrame([("a",)], "u string")
    counts = spark.createDataFrame([], "u string, k long, n long")
    assert reshape.zero_filled_grid(units, spark.range(3).toDF("k"), counts, ["u", "k"], "n").count() == 3
    with pytest.raises(Exception, match="axis of a grid"):
        reshape.zero_filled_grid(units, spark.range(4).toDF("k"), counts, ["u", "k"], "n").collect()
