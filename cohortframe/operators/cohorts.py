"""Recruit and cohort panels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from .reshape import long_to_wide, zero_filled_grid
from .seasons import census_dates, census_seasons

# Cohorts with a height at first detection.
MEASURED_LATE_COHORTS = (3, 5, 7, 9, 10)


def recruits_by_plot(panel: DataFrame, extra_keys: Sequence[str] = ()) -> DataFrame:
    """New individuals per plot and census: those whose cohort is that census."""
    keys = ["PLOTCODE", "AREA", "SITEAREA", "CENSUS_NUM", "START_DATE", *extra_keys]
    return panel.groupBy(*keys).agg(F.count_if(F.col("COHORT") == F.col("CENSUS_NUM")).alias("NumRecruits"))


def first_year_recruits(
    panel: DataFrame, plots: DataFrame, censuses: Sequence[int] = (1, 2), small_plot: float = 4.0
) -> DataFrame:
    """Recruits of the first year per plot with the cones left after the fire."""
    keys = ["PLOTCODE", "AREA", "SITEAREA", "SDLAREA"]
    return (
        panel.filter(F.col("CENSUS_NUM").isin(list(censuses)))
        .groupBy(*keys)
        .agg(F.count_if(F.col("COHORT") == F.col("CENSUS_NUM")).alias("NumRecruits"))
        .join(
            plots.select(F.col("OLDCODE").alias("PLOTCODE"), "CONES1", "PLTAREA"), "PLOTCODE", "left"
        )
        .withColumn("SmallPlot", (F.col("SDLAREA") == small_plot).cast("double"))
    )


def cohort_first_year(panel: DataFrame) -> DataFrame:
    """First two cohorts alive at detection, with status and height at census 3."""
    keys = ["IND_ID", "AREA", "SITEAREA", "PLOTCODE", "SDLAREA", "COHORT"]
    keys = [k for k in keys if k in panel.columns]
    early = panel.filter(F.col("COHORT").isin(1, 2))
    wide = long_to_wide(early, keys, ["STAT", "HT"], [1, 2, 3])
    return (
        wide.withColumn("stat_det", F.when(F.col("COHORT") == 1, F.col("STAT_1")).otherwise(F.col("STAT_2")))
        .filter(F.col("stat_det") == 1)
        .drop("HT_1", "HT_2")
        .withColumnRenamed("STAT_3", "alive3")
        .withColumnRenamed("HT_3", "HT")
    )


def season_recruits(
    panel: DataFrame, origin_year: int = 1995, first_cohort: int = 3, seasons: DataFrame | None = None
) -> DataFrame:
    """Recruits per plot and growing season, zeros included.

    ``seasons`` maps cohorts to seasons (see ``seasons.census_seasons``); by default the panel's own census dates
    do. Only surveyed seasons have rows. ``seasons.without_season`` lists cohorts that none takes in.
    """
    keys = ["PLOTCODE", "SITEAREA", "AREA", "SDLAREA"]
    seasons = census_seasons(census_dates(panel)) if seasons is None else seasons
    plots = panel.groupBy(*keys).agg(F.lit(1).alias("__one")).drop("__one")
    counts = (
        panel.filter(F.col("COHORT") >= first_cohort)
        .groupBy("IND_ID", "PLOTCODE", "COHORT")
        .agg(F.lit(1).alias("__one"))
        .groupBy("PLOTCODE", "COHORT")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    axis = seasons.where(F.col("COHORT") >= first_cohort).select("COHORT", "Year", "Interval")
    grid = zero_filled_grid(plots, axis, counts, ["PLOTCODE", "COHORT"], "n")
    return (
        grid.groupBy(*keys, "Year", "Interval")
        .agg(F.sum("n").alias("NumRecruits"))
        .withColumn("TimeSinceFire", F.col("Year") - origin_year)
    )


def later_cohort_sizes(
    panel: DataFrame, cohorts: Sequence[int] = MEASURED_LATE_COHORTS, separate_area: str = "RP", pooled: str = "DW_SCC"
) -> DataFrame:
    """Height at first detection of later cohorts; one area stays apart, the others are pooled."""
    return panel.filter(
        F.col("COHORT").isin(list(cohorts))
        & (F.col("CENSUS_NUM") == F.col("COHORT"))
        & (F.col("STAT") == 1)
        & F.col("HT").isNotNull()
    ).withColumn("AREA_combined", F.when(F.col("AREA") == separate_area, F.col("AREA")).otherwise(F.lit(pooled)))


def last_census_cones(panel: DataFrame, census: int = 15) -> DataFrame:
    """Living, measured individuals of the last census with a 0/1 serotiny flag."""
    return panel.filter(
        (F.col("STAT") == 1)
        & F.col("CONE_Mature").isNotNull()
        & F.col("HT").isNotNull()
        & (F.col("CENSUS_NUM") == census)
    ).withColumn("SEROTINY", F.nullif(F.col("SEROTINY"), F.lit(""))).withColumn(
        "SEROTINY_binary", F.when(F.col("SEROTINY") == "O", 0).when(F.col("SEROTINY") == "S", 1).cast("int")
    )


def size_complete_cases(panel: DataFrame, sizes: Sequence[str] = ("HT", "DAH", "WD1", "WD2"), cohort: int = 1) -> DataFrame:
    return (
        panel.filter(F.col("COHORT") == cohort)
        .select("IND_ID", "CENSUS_NUM", F.concat_ws("_", "IND_ID", "CENSUS_NUM").alias("ID_CENSUS"), *sizes)
        .dropna(subset=list(sizes))
    )
