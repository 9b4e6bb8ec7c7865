"""Readers and writers: explicit schemas in, Parquet (or CSV on request) out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

GPS_SCHEMA = "SITE string, PLOTCODE string, LATDEG int, LATMIN double, LONGDEG int, LONGMIN double"
PLOT_SCHEMA = (
    "OLDCODE string, SUBPLOT string, AREA string, PLTAREA double, SDLAREA double, TMT string, "
    "CONES1 double, TOPALIV1 double"
)
PANEL_SCHEMA = (
    "IND_ID long, PLOTCODE string, COHORT int, TAG string, SITEAREA string, AREA string, PLTAREA double, "
    "SDLAREA double, TMT string, CENSUS_NUM int, STAT int, HT double, DAH double, DBH double, WD1 double, "
    "WD2 double, CONE_New double, CONE_1Yr double, CONE_Mature double, SEROTINY string, START_DATE date, "
    "CENSUS_MONTH int, CENSUS_YEAR int"
)


def text_schema(columns: Sequence[str], integers: Sequence[str] = ("COHORT",)) -> T.StructType:
    """Every measurement lands as text; only declared columns are typed."""
    return T.StructType(
        [T.StructField(c, T.IntegerType() if c in integers else T.StringType()) for c in columns]
    )


def read_census(
    spark: SparkSession, path: str, columns: Sequence[str], null: str = "-", integers: Sequence[str] = ("COHORT",)
) -> DataFrame:
    """Landed census sheet as CSV; ``null`` is the survey's token for a missing value."""
    return spark.read.csv(path, schema=text_schema(columns, integers), header=True, nullValue=null)


def read_census_dates(spark: SparkSession, path: str, censuses: int, drop_unlabelled: bool = True) -> DataFrame:
    """Landed date sheet; rows without a label, such as those above the header, are dropped unless told otherwise."""
    names = ["...1", *[f"Census {i + 1}" for i in range(censuses)]]
    sheet = spark.read.csv(path, schema=text_schema(names, ()), header=False)
    return sheet.filter(F.col("`...1`").isNotNull()) if drop_unlabelled else sheet


def read_plots(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, schema=PLOT_SCHEMA, header=True)


def read_gps(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, schema=GPS_SCHEMA, header=True)


def read_panel(spark: SparkSession, path: str) -> DataFrame:
    """Cleaned long panel; partition pruning applies to ``CENSUS_NUM`` filters."""
    return spark.read.parquet(path)


def write_wide(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Wide cleaned table; CSV writes NULL as an empty field."""
    if fmt == "csv":
        df.write.mode("overwrite").csv(path, header=True, emptyValue="", nullValue="")
    else:
        df.write.mode("overwrite").format(fmt).save(path)


def write_panel(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Long panel, one directory per census."""
    if fmt == "csv":
        df.write.mode("overwrite").csv(path, header=True, emptyValue="", nullValue="")
    else:
        df.write.mode("overwrite").partitionBy("CENSUS_NUM").format(fmt).save(path)


def write_models(fits: DataFrame, coefficients: DataFrame, path: str, chosen: DataFrame | None = None) -> None:
    """Fit and coefficient tables; ``chosen`` (with ``model``) keeps the selected models only."""
    if chosen is not None:
        names = F.broadcast(chosen.select("model").distinct())
        fits, coefficients = fits.join(names, "model", "left_semi"), coefficients.join(names, "model", "left_semi")
    fits.write.mode("overwrite").parquet(f"{path}/fits")
    coefficients.write.mode("overwrite").parquet(f"{path}/coefficients")


def read_models(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/fits"), spark.read.parquet(f"{path}/coefficients")
