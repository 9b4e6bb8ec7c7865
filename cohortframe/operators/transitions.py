"""Census-to-next-census transitions derived with one window over the individual."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.columns import calendar_years_between, dead_flag, years_between

# Censuses with a height survey.
SURVIVAL_CENSUSES = (3, 5, 7, 9, 11, 12, 13, 14, 15)
TRIAL_GROWTH_CENSUSES = (3, 5, 7, 9, 11, 12, 13, 14)

# Date of the fire in the models and in the exploration.
MODEL_ORIGIN = "1995-09-01"
EXPLORATION_ORIGIN = "1995-06-01"


def by_individual(id_col: str = "IND_ID", order_col: str = "CENSUS_NUM") -> Window:
    return Window.partitionBy(id_col).orderBy(order_col)


def with_next(panel: DataFrame, censuses: Sequence[int] | None, **columns: str) -> DataFrame:
    """Add the value of each named column at the next *kept* census: ``with_next(p, c, HT_next="HT")``.

    The census filter comes first, so "next" skips the censuses left out.
    """
    kept = panel if censuses is None else panel.filter(F.col("CENSUS_NUM").isin(list(censuses)))
    order = by_individual()
    return kept.withColumns({out: F.lead(src).over(order) for out, src in columns.items()})


def survival_transitions(
    panel: DataFrame,
    censuses: Sequence[int] | None = SURVIVAL_CENSUSES,
    origin_date: str = MODEL_ORIGIN,
    interval_digits: int | None = None,
) -> DataFrame:
    """Alive and measured now, status known next: mortality, interval, time since origin.

    ``censuses=None`` with ``interval_digits=1`` gives the exploratory variant.
    """
    paired = with_next(
        panel,
        censuses,
        STAT_next="STAT",
        CENSUS_next="CENSUS_NUM",
        Date_next="START_DATE",
    )
    return (
        paired.filter((F.col("STAT") == 1) & F.col("STAT_next").isNotNull() & F.col("HT").isNotNull())
        .withColumn("Dead", dead_flag("STAT"))
        .withColumn("Dead_next", dead_flag("STAT_next"))
        .withColumn("TimeSinceFire", years_between("START_DATE", F.to_date(F.lit(origin_date))))
        .withColumn("CensusInterval", years_between("Date_next", "START_DATE", interval_digits))
    )


def growth_transitions(
    panel: DataFrame,
    censuses: Sequence[int] = SURVIVAL_CENSUSES,
    origin_date: str = MODEL_ORIGIN,
    interval_mode: str = "years",
) -> DataFrame:
    """Alive and measured at both ends: increment, annual increment, annual next size.

    ``interval_mode`` is ``"years"`` (days over 365.25) or ``"calendar"`` (difference of years).
    """
    interval = {"years": years_between, "calendar": calendar_years_between}[interval_mode]
    paired = with_next(
        panel,
        censuses,
        STAT_next="STAT",
        HT_next="HT",
        CENSUS_next="CENSUS_NUM",
        Date_next="START_DATE",
    )
    return (
        paired.filter(
            (F.col("STAT") == 1)
            & (F.col("STAT_next") == 1)
            & F.col("HT").isNotNull()
            & F.col("HT_next").isNotNull()
        )
        .withColumn("TimeSinceFire", years_between("START_DATE", F.to_date(F.lit(origin_date))))
        .withColumn("CensusInterval", interval("Date_next", "START_DATE"))
        .withColumn("deltaHT", F.col("HT_next") - F.col("HT"))
        .withColumn("deltaHT_annual", F.try_divide("deltaHT", "CensusInterval"))
        .withColumn("HT_next_annual", F.col("HT") + F.col("deltaHT_annual"))
    )


def relative_growth(growth: DataFrame) -> DataFrame:
    return growth.withColumn("RGR_annual", F.try_divide("deltaHT_annual", "HT"))


def cone_transitions(panel: DataFrame, new_cones: str = "CONE_New", cohort: int = 1, after: int = 10) -> DataFrame:
    """Cones now against mature cones at the next census."""
    kept = panel.filter((F.col("COHORT") == cohort) & (F.col("CENSUS_NUM") > after))
    return with_next(kept, None, CONE_Mature_next="CONE_Mature").select(
        "IND_ID", "CENSUS_NUM", new_cones, "CONE_Mature_next"
    )
