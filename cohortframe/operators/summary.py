"""Availability, survival and recruitment summaries.

The panel holds one row per individual and census, so within a census the number of rows *is*
the number of individuals; counting rows lets every summary combine on the map side.
``unique_key=False`` counts distinct individuals instead, for panels that may repeat a key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.columns import strict_sum
from .transitions import by_individual

SITE_CENSUS = ("CENSUS_NUM", "START_DATE", "AREA", "SITEAREA")


def _individuals(unique_key: bool) -> Column:
    return F.count(F.lit(1)) if unique_key else F.count_distinct("IND_ID")


def num_alive(
    panel: DataFrame, cohort: int | None = None, keys: Sequence[str] = SITE_CENSUS, unique_key: bool = True
) -> DataFrame:
    alive = panel.filter(F.col("STAT") == 1)
    if cohort is not None:
        alive = alive.filter(F.col("COHORT") == cohort)
    return alive.groupBy(*keys).agg(_individuals(unique_key).alias("NumAlive"), F.count(F.lit(1)).alias("n"))


def availability(
    panel: DataFrame,
    measure_names: Sequence[str],
    prefix: str = "",
    cohort: int | None = None,
    keys: Sequence[str] = SITE_CENSUS,
    digits: int = 2,
    unique_key: bool = True,
) -> DataFrame:
    """Measured individuals per measure and their rounded share of the living."""
    alive = panel.filter(F.col("STAT") == 1)
    if cohort is not None:
        alive = alive.filter(F.col("COHORT") == cohort)
    counted = alive.groupBy(*keys).agg(
        _individuals(unique_key).alias("NumAlive"),
        *[F.count(m).alias(f"Num{prefix}{m}") for m in measure_names],
    )
    return counted.withColumns(
        {
            f"Frac{prefix}{m}": F.round(F.col(f"Num{prefix}{m}") / F.col("NumAlive"), digits)
            for m in measure_names
        }
    )


def mean_availability(available: DataFrame, keys: Sequence[str] = ("CENSUS_NUM", "START_DATE")) -> DataFrame:
    """Unweighted mean of the site fractions."""
    fractions = [c for c in available.columns if c.startswith("Frac")]
    return available.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in fractions])


def num_dead(panel: DataFrame, keys: Sequence[str] = SITE_CENSUS, unique_key: bool = True) -> DataFrame:
    """Individuals alive at the previous census and dead now."""
    previous = F.lag("STAT").over(by_individual())
    return (
        panel.withColumn("STAT_prev", previous)
        .filter((F.col("CENSUS_NUM") > 1) & (F.col("STAT_prev") == 1) & (F.col("STAT") == 0))
        .groupBy(*keys)
        .agg(_individuals(unique_key).alias("NumDead"))
    )


def prop_dead(panel: DataFrame, keys: Sequence[str] = SITE_CENSUS, keep_extinct: bool = False) -> DataFrame:
    """Share of the previous census's living that died, 0 where nobody did.

    Deaths and survivors are counted in one aggregate. A site-census whose last members died
    has no living row; it is left out unless ``keep_extinct``.
    """
    site = [k for k in keys if k not in ("CENSUS_NUM", "START_DATE")]
    previous = F.lag("STAT").over(by_individual())
    counted = (
        panel.withColumn("STAT_prev", previous)
        .groupBy(*keys)
        .agg(
            F.count_if(
                (F.col("CENSUS_NUM") > 1) & (F.col("STAT_prev") == 1) & (F.col("STAT") == 0)
            ).alias("__dead"),
            F.count_if(F.col("STAT") == 1).alias("NumAlive"),
        )
        .withColumn("NumDead", F.nullif(F.col("__dead"), F.lit(0)))
        .drop("__dead")
    )
    present = F.col("NumAlive") > 0
    counted = counted.filter(present | F.col("NumDead").isNotNull()) if keep_extinct else counted.filter(present)
    order = Window.partitionBy(*site).orderBy("CENSUS_NUM")
    return (
        counted.withColumn("NumAlive_prev", F.lag("NumAlive").over(order))
        .filter(F.col("CENSUS_NUM") > 1)
        .withColumn("PropDead", F.coalesce(F.try_divide("NumDead", "NumAlive_prev"), F.lit(0.0)))
    )


def survivorship(alive: DataFrame, keys: Sequence[str] = ("AREA", "SITEAREA")) -> DataFrame:
    """Living relative to the first census of the site."""
    order = Window.partitionBy(*keys).orderBy("CENSUS_NUM")
    return alive.withColumn("PropSurv", F.col("NumAlive") / F.first("NumAlive").over(order))


def height_moments(panel: DataFrame, keys: Sequence[str], value: str = "HT") -> DataFrame:
    return panel.groupBy(*keys).agg(F.avg(value).alias("MeanHt"), F.stddev_samp(value).alias("SDHt"))


def serotiny_counts(panel: DataFrame) -> DataFrame:
    """Individuals and mature cones per serotiny class; an unknown cone count makes the sum unknown."""
    return (
        panel.filter(F.col("SEROTINY").isNotNull() & (F.col("SEROTINY") != ""))
        .groupBy("AREA", "CENSUS_NUM", "SEROTINY")
        .agg(F.count(F.lit(1)).alias("NumInds"), strict_sum("CONE_Mature").alias("NumCones"))
    )


def pair_summary(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("CENSUS_NUM", "CENSUS_next").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("CensusInterval").alias("MinInterval"),
        F.max("CensusInterval").alias("MaxInterval"),
        F.avg("Dead_next").alias("MortRate"),
    )


def contingency(df: DataFrame, row: str, col: str, col_values: Sequence) -> DataFrame:
    """Two-way table with explicit columns ``{col}_{value}``."""
    return df.groupBy(row).agg(*[F.count_if(F.col(col) == v).alias(f"{col}_{v}") for v in col_values])


def site_coverage(df: DataFrame, keys: Sequence[str] = ("AREA", "SITEAREA"), value: str = "HT") -> DataFrame:
    return (
        df.groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("NumAlive"),
            F.count(value).alias("NumMeasured"),
            F.avg(value).alias("MeanHeight"),
            F.stddev_samp(value).alias("SDHeight"),
        )
        .withColumn("FracMeasured", F.col("NumMeasured") / F.col("NumAlive"))
    )


def observed_predicted(
    df: DataFrame, keys: Sequence[str], observed: str, predicted: str, weight: str | None = None
) -> DataFrame:
    """Observed proportion against the mean prediction per group; with ``weight`` a row stands for that many equal ones."""
    known = df.filter(F.col(observed).isNotNull())
    if weight is None:
        n, total, mean = F.count(F.lit(1)), F.sum(observed), F.avg(predicted)
    else:
        times, pred = F.col(weight), F.col(predicted)
        n, total = F.sum(times), F.sum(F.col(observed) * times)
        mean = F.try_divide(F.sum(pred * times), F.sum(F.when(pred.isNotNull(), times)))
    return known.groupBy(*keys).agg(
        n.alias("n"),
        total.cast("double").alias("Observed"),
        mean.alias("PredictedProp"),
    ).withColumn("ObservedProp", F.col("Observed") / F.col("n"))


def bounding_box(df: DataFrame, lat: str = "LAT", long: str = "LONG") -> DataFrame:
    return df.agg(
        F.min(long).alias("lng1"), F.min(lat).alias("lat1"), F.max(long).alias("lng2"), F.max(lat).alias("lat2")
    )


def sites_for_holdout(panel: DataFrame, site: str = "SITEAREA", area: str = "AREA") -> DataFrame:
    """Sites that can be held out without losing their area: the area has another site."""
    pairs = panel.select(site, area).distinct()
    shared = pairs.groupBy(area).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > 1)
    return pairs.join(shared.select(area), area, "left_semi")
