"""Growing seasons of censuses, told from the census dates.

A season opens once a year, when seedlings appear. A census covers the seasons that opened after the
census before it and not after its own date. A second census within one season covers no new one: it
belongs to the season that was last open, as the recruits it finds germinated in that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

SEASON_OPENS = (4, 1)  # month and day


def last_season(date: Column, opens: tuple[int, int] = SEASON_OPENS) -> Column:
    """The year of the season that was last opened at a date."""
    year = F.year(date)
    return F.when(date >= F.make_date(year, F.lit(opens[0]), F.lit(opens[1])), year).otherwise(year - 1)


def census_dates(panel: DataFrame) -> DataFrame:
    """(CENSUS_NUM, START_DATE) of every census of a panel, one row each; a census without any date has none."""
    return panel.groupBy("CENSUS_NUM").agg(F.min("START_DATE").alias("START_DATE"))


def census_seasons(dates: DataFrame, opens: tuple[int, int] = SEASON_OPENS) -> DataFrame:
    """(COHORT, first_season, last_season, Year, Interval) of every dated census.

    ``dates`` holds one row per census, so the window over all of them is as small as their number. Interval is
    the number of seasons that the census covers and Year their midpoint. The first census covers one season.
    """
    before = F.lag("last_season").over(Window.partitionBy(F.lit(0)).orderBy("START_DATE", "CENSUS_NUM"))
    own = dates.where("START_DATE is not null").withColumn("last_season", last_season(F.col("START_DATE"), opens))
    first = F.when(before < F.col("last_season"), before + 1).otherwise(F.col("last_season"))
    return own.withColumn("first_season", first).select(
        F.col("CENSUS_NUM").alias("COHORT"),
        "first_season",
        "last_season",
        ((F.col("first_season") + F.col("last_season")) / 2).alias("Year"),
        (F.col("last_season") - F.col("first_season") + 1).alias("Interval"),
    )


def cohort_seasons(panel: DataFrame, seasons: DataFrame, first_cohort: int = 3) -> DataFrame:
    """(COHORT, n_individuals, Year, Interval) of every later cohort; Year is null for one without a season."""
    cohorts = (
        panel.where(F.col("COHORT") >= first_cohort)
        .groupBy("IND_ID", "COHORT").agg(F.lit(1).alias("__one"))
        .groupBy("COHORT").agg(F.count(F.lit(1)).alias("n_individuals"))
    )
    return cohorts.join(seasons.select("COHORT", "Year", "Interval"), "COHORT", "left")


def without_season(panel: DataFrame, seasons: DataFrame, first_cohort: int = 3) -> DataFrame:
    """(COHORT, n_individuals) of later cohorts that no season takes in; ``season_recruits`` leaves them out."""
    return cohort_seasons(panel, seasons, first_cohort).where("Year is null").select("COHORT", "n_individuals")
