"""Raw wide census to the cleaned long panel.

Text repair, units and renaming are narrow projections on the wide rows; rows are then exploded
to the long form so that status resolution, masking and any later lead or lag share a single
exchange on the individual. The treatment filter runs before the explode.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

from ..functions import columns as X
from ..operators import clean as C
from ..operators.reshape import surrogate_id, wide_to_long
from ..operators.status import resolve_status
from ..sources.repairs import CENSORED_HEIGHTS, KNOWN_REPAIRS, MISSING_STATUS_TEXT, SEROTINY_CODES, repair_numbers


@dataclass(frozen=True)
class CensusLayout:
    """What one survey's columns need; the defaults describe the fifteen-census survey."""

    last: int = 15
    key_cols: Sequence[str] = ("PLOTCODE", "COHORT", "TAG")
    repairs: Sequence[tuple[str, str, float]] = KNOWN_REPAIRS
    millimetre_pattern: str = r"DIAM[0-9]+|WD[12]_12"
    mature_sums: tuple = (
        ("CONE_Mature__14", ("CONE14_GOLD", "CONE14_GRAY")),
        ("CONE_Mature__15", ("CONE15_2YR", "CONE15_>2YR")),
    )
    mature_mask: Sequence[int] = (13, 14, 15)
    mature_fill: Sequence[int] = (12, 13, 14, 15)
    duplicate_measures: Sequence[str] = ("HTN9",)
    corrected_height: str | None = "15W/subs"
    treatment: str | None = "NONE"
    serotiny: Mapping[str, Mapping] = field(default_factory=lambda: SEROTINY_CODES)


RENAMES = (
    (r"STAT([0-9]+)", r"STAT__\1"),
    (r"SEROTINY([0-9]+)", r"SEROTINY__\1"),
    (r"CONE([0-9]+)_>1YR", r"CONE_Mature__\1"),
    (r"CONE([0-9]+)(?:_BABY|_NEW)?", r"CONE_New__\1"),
    (r"CONE([0-9]+)(?:_1YR|_GREEN)", r"CONE_1Yr__\1"),
    (r"(?:DIAM|DAH)([0-9]+)", r"DAH__\1"),
    (r"DBH([0-9]+)", r"DBH__\1"),
    (r"WD([12])_([0-9]+)", r"WD\1__\2"),
    (r"HTB?([0-9]+)", r"HT__\1"),
)

SIZES = ("HT", "DAH", "DBH", "WD1", "WD2")
CONES = ("CONE_New", "CONE_1Yr", "CONE_Mature")


def standardise(raw: DataFrame, layout: CensusLayout = CensusLayout()) -> DataFrame:
    """Readable numbers, one unit, ``MEASURE__census`` names; still one row per individual."""
    df = C.drop_matching(raw, "Cohort_|NOTES|REC|MEAS|DATE")
    if layout.corrected_height:
        df = C.replace_censored(
            df, f"HTB{layout.last}", layout.corrected_height, CENSORED_HEIGHTS, f"HTB{layout.last}"
        ).drop(f"HTB{layout.last}_censored")
    df = df.drop(*layout.duplicate_measures)
    df = df.withColumns(
        {c: X.recode(c, MISSING_STATUS_TEXT).try_cast("int") for c in C.columns_matching(df, "STAT[0-9]+")}
    )
    df = df.withColumns({c: X.recode(c, codes) for c, codes in layout.serotiny.items() if c in df.columns})
    numeric = C.columns_matching(df, r"(HTB?|DIAM|DAH|DBH)[0-9]+|WD[12]_[0-9]+|CONE[0-9]+.*")
    df = repair_numbers(df, numeric, layout.repairs)
    df = C.scale_columns(df, C.columns_matching(df, layout.millimetre_pattern), 10)
    for out, parts in layout.mature_sums:
        df = df.withColumn(out, X.null_as_zero_sum(*[F.col(f"`{p}`") for p in parts])).drop(*parts)
    return C.rename_by_rules(df, RENAMES)


def identify(raw: DataFrame, plots: DataFrame, layout: CensusLayout = CensusLayout()) -> DataFrame:
    """Complete keys, site and area codes, plot attributes, dense individual id."""
    df = C.drop_null_keys(raw, ("PLOTCODE", "COHORT"))
    df = df.withColumn("SITEAREA", X.site_code("PLOTCODE")).withColumn("AREA", X.area_code("SITEAREA"))
    wanted = plots.select("OLDCODE", "PLTAREA", "SDLAREA", "TMT")
    df = df.join(wanted, df["PLOTCODE"] == wanted["OLDCODE"], "left").drop("OLDCODE")
    return surrogate_id(df, layout.key_cols)


def clean_panel(
    raw: DataFrame, plots: DataFrame, dates: DataFrame, layout: CensusLayout = CensusLayout()
) -> DataFrame:
    """The cleaned long panel, one row per individual and census."""
    wide = standardise(identify(raw, plots, layout), layout)
    if layout.treatment is not None:
        wide = wide.filter(F.col("TMT") == layout.treatment)
    ids = ["IND_ID", "PLOTCODE", "COHORT", "TAG", "SITEAREA", "AREA", "PLTAREA", "SDLAREA", "TMT"]
    long = wide_to_long(wide, ids, ("STAT", *SIZES, *CONES, "SEROTINY"))
    long = resolve_status(long.withColumnRenamed("STAT", "STAT_RAW")).drop("STAT_RAW")
    sizes = {m: F.nullif(X.mask_size(m, "STAT"), F.lit(0.0)) for m in SIZES if m in long.columns}
    census, cones = F.col("CENSUS_NUM"), {}
    if "CONE_Mature" in long.columns:
        masked = F.when(census.isin(list(layout.mature_mask)), X.mask_count("CONE_Mature", "STAT")).otherwise(
            F.col("CONE_Mature")
        )
        cones["CONE_Mature"] = F.when(
            census.isin(list(layout.mature_fill)), X.fill_alive_zero(masked, "STAT")
        ).otherwise(masked)
    return long.withColumns(sizes | cones).join(dates, "CENSUS_NUM", "left")
