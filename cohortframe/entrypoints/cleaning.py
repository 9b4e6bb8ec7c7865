"""Cleaning and audit queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as X
from ..operators import clean as C, distribution as Q, reshape, summary
from ..plans.clean_panel import CensusLayout, clean_panel, identify, standardise
from ..sources import repairs as R, tables as D
from .registry import PANEL, query, r6, rounded

# Repairs of the planted misspellings of the derived wide census.
PANEL_REPAIRS = (("HTB12", "28..4", 28.4), ("DAH14", "1.36/ 1.72", 0.79))

SEROTINY = R.SEROTINY_SPELLINGS | R.SEROTINY_INVALID

LAYOUT = CensusLayout(
    last=D.LINE_CENSUSES,
    repairs=PANEL_REPAIRS,
    mature_sums=(("CONE_Mature__14", ("CONE14_GOLD", "CONE14_GRAY")),),
    mature_mask=(13, 14),
    mature_fill=(12, 13, 14),
    corrected_height="14W/subs",
    serotiny={"SEROTINY13": SEROTINY, "SEROTINY14": SEROTINY},
)

# The raw wide census in long form: one row per individual and census, text repaired by rule.
DIRTY = (
    PANEL
    + """, dirty AS (
  SELECT *, 'T' || IND_ID AS TAG,
         CASE WHEN IND_ID % 211 <> 0 THEN PLOTCODE END AS PLOT_D,
         CASE WHEN IND_ID % 223 <> 0 THEN COHORT END AS COHORT_D,
         CASE WHEN HT_RAW IS NULL THEN NULL
              WHEN CENSUS_NUM = 12 AND IND_ID % 97 = 0 THEN 28.4
              WHEN CENSUS_NUM = 14 AND IND_ID % 89 IN (0, 1) THEN NULL
              WHEN CENSUS_NUM = 14 THEN HT_RAW + 1 ELSE HT_RAW END AS HT_D,
         CASE WHEN CENSUS_NUM = 14 AND IND_ID % 83 = 0 AND DAH_RAW IS NOT NULL THEN 0.79 ELSE DAH_RAW END AS DAH_D,
         CASE WHEN CENSUS_NUM >= 11 THEN WD1_RAW END AS WD1_D, CASE WHEN CENSUS_NUM >= 11 THEN WD2_RAW END AS WD2_D,
         CASE WHEN CENSUS_NUM >= 12 THEN CAST(nr AS DOUBLE) END AS NEW_D,
         CASE WHEN CENSUS_NUM IN (12, 13) THEN CAST(na AS DOUBLE)
              WHEN CENSUS_NUM = 14 THEN CAST(coalesce(na, 0) + coalesce(nr, 0) AS DOUBLE) END AS MATURE_D,
         CASE WHEN CENSUS_NUM >= 13 THEN CASE n % 7 WHEN 0 THEN 'S' WHEN 1 THEN 'O' WHEN 2 THEN 'O' WHEN 3 THEN 'O'
              WHEN 4 THEN 'S' WHEN 5 THEN 'O' END END AS SER_D
  FROM st)
"""
)


@query(
    "key_filter_audit",
    DIRTY
    + """, w AS (SELECT DISTINCT IND_ID, PLOT_D, COHORT_D FROM dirty)
SELECT count(*) AS rows_in, count(*) FILTER (WHERE PLOT_D IS NULL) AS "removed_PLOTCODE",
       count(*) FILTER (WHERE PLOT_D IS NOT NULL AND COHORT_D IS NULL) AS "removed_COHORT",
       count(*) FILTER (WHERE PLOT_D IS NOT NULL AND COHORT_D IS NOT NULL) AS rows_kept FROM w""",
)
def _(spark, sf):
    return C.null_key_counts(D.dirty_wide(spark, sf), ("PLOTCODE", "COHORT"))


@query(
    "individual_id",
    DIRTY
    + """, w AS (SELECT DISTINCT PLOT_D, COHORT_D, TAG FROM dirty WHERE PLOT_D IS NOT NULL AND COHORT_D IS NOT NULL)
SELECT PLOT_D AS PLOTCODE, COHORT_D AS COHORT, TAG,
       row_number() OVER (ORDER BY substr(md5(PLOT_D || '|' || COHORT_D || '|' || TAG), 1, 3), PLOT_D, COHORT_D, TAG)
       AS IND_ID FROM w""",
)
def _(spark, sf):
    keyed = C.drop_null_keys(D.dirty_wide(spark, sf), ("PLOTCODE", "COHORT")).select("PLOTCODE", "COHORT", "TAG")
    return reshape.surrogate_id(keyed, ("PLOTCODE", "COHORT", "TAG"))


@query(
    "code_derive",
    PANEL
    + """SELECT DISTINCT PLOTCODE, split_part(PLOTCODE, '-', 1) AS SITE,
    regexp_replace(split_part(PLOTCODE, '-', 1), '[0-9].*', '') AS FAMILY FROM panel""",
)
def _(spark, sf):
    plots = D.line_panel(spark, sf).select("PLOTCODE").distinct()
    return plots.withColumn("SITE", X.site_code("PLOTCODE")).withColumn("FAMILY", X.area_code("SITE"))


@query(
    "level_enforce",
    PANEL
    + """SELECT CASE WHEN AREA IN ('A3', 'A1', 'A0') THEN AREA END AS AREA,
    CASE AREA WHEN 'A3' THEN 1 WHEN 'A1' THEN 2 WHEN 'A0' THEN 3 END AS AREA_ORD, count(*) AS n
    FROM panel GROUP BY 1, 2""",
)
def _(spark, sf):
    levels = ["A3", "A1", "A0"]
    coded = D.line_panel(spark, sf).select(
        X.enforce_levels("AREA", levels).alias("AREA"), X.level_ordinal("AREA", levels).alias("AREA_ORD")
    )
    return coded.groupBy("AREA", "AREA_ORD").agg(F.count(F.lit(1)).alias("n"))


@query(
    "recode_status",
    DIRTY + "SELECT TAG, CAST(STAT_RAW AS INTEGER) AS STAT14 FROM dirty WHERE CENSUS_NUM = 14",
)
def _(spark, sf):
    raw = D.dirty_wide(spark, sf)
    return raw.select("TAG", X.recode("STAT14", R.MISSING_STATUS_TEXT).try_cast("int").alias("STAT14"))


@query("recode_serotiny", DIRTY + "SELECT TAG, SER_D AS SEROTINY14 FROM dirty WHERE CENSUS_NUM = 14")
def _(spark, sf):
    return D.dirty_wide(spark, sf).select("TAG", X.recode("SEROTINY14", SEROTINY).alias("SEROTINY14"))


@query(
    "dirty_numeric_repair",
    DIRTY
    + """SELECT TAG, max(HT_D) FILTER (WHERE CENSUS_NUM = 12) AS HTB12,
    round(max(DAH_D) FILTER (WHERE CENSUS_NUM = 14), 9) AS DAH14 FROM dirty GROUP BY 1""",
)
def _(spark, sf):
    fixed = R.repair_numbers(D.dirty_wide(spark, sf), ["HTB12", "DAH14"], PANEL_REPAIRS)
    return rounded(fixed.select("TAG", "HTB12", "DAH14"))


@query(
    "repair_quarantine",
    DIRTY
    + """SELECT 'HTB14' AS "column", CASE IND_ID % 89 WHEN 0 THEN '>450' ELSE '>490' END AS raw, count(*) AS n FROM dirty
    WHERE CENSUS_NUM = 14 AND HT_RAW IS NOT NULL AND IND_ID % 89 IN (0, 1) GROUP BY 2""",
)
def _(spark, sf):
    raw = D.dirty_wide(spark, sf)
    return R.quarantine(raw, [*C.columns_matching(raw, "HTB[0-9]+"), "DAH14", "CONE12_BABY"], PANEL_REPAIRS)


@query(
    "unit_convert",
    DIRTY
    + """SELECT TAG, round(max(DAH_RAW) FILTER (WHERE CENSUS_NUM = 3), 9) AS DAH__3,
    round(max(WD1_RAW) FILTER (WHERE CENSUS_NUM = 12), 6) AS WD1__12 FROM dirty GROUP BY 1""",
)
def _(spark, sf):
    scaled = C.scale_columns(D.dirty_wide(spark, sf), ["DIAM3", "WD1_12"], 10)
    named = C.rename_by_rules(scaled, ((r"DIAM([0-9]+)", r"DAH__\1"), (r"WD([12])_([0-9]+)", r"WD\1__\2")))
    return rounded(named.select("TAG", "DAH__3", "WD1__12"))


@query(
    "bulk_rename",
    DIRTY
    + "SELECT TAG, "
    + ", ".join(f"max(HT_D) FILTER (WHERE CENSUS_NUM = {k}) AS HT__{k}" for k in range(1, 15))
    + " FROM dirty WHERE PLOT_D IS NOT NULL AND COHORT_D IS NOT NULL GROUP BY 1",
)
def _(spark, sf):
    wide = standardise(C.drop_null_keys(D.dirty_wide(spark, sf), ("PLOTCODE", "COHORT")), LAYOUT)
    return wide.select("TAG", *C.measures(wide, "HT").values())


@query(
    "column_range",
    DIRTY
    + """SELECT TAG, max(STAT_RAW) FILTER (WHERE CENSUS_NUM = 1) AS STAT1, max(STAT_RAW) FILTER (WHERE CENSUS_NUM = 2) AS STAT2,
    max(STAT_RAW) FILTER (WHERE CENSUS_NUM = 3) AS STAT3 FROM dirty GROUP BY 1""",
)
def _(spark, sf):
    """Columns by position, without the bookkeeping columns dropped by name."""
    named = C.drop_matching(D.dirty_wide(spark, sf), "Cohort_|NOTES|REC|MEAS|DATE")
    kept = C.keep_range(named, "STAT1", "STAT3", ["TAG"])
    return kept.withColumns({f"STAT{k}": F.col(f"STAT{k}").try_cast("int") for k in (1, 2, 3)})


@query(
    "alive_mask",
    PANEL
    + """SELECT IND_ID, CENSUS_NUM, CASE WHEN STAT = 1 THEN HT_RAW END AS HT,
    round(CASE WHEN STAT = 1 THEN DAH_RAW END, 9) AS DAH FROM st""",
)
def _(spark, sf):
    from ..operators.status import resolve_status

    lived = resolve_status(D.line_censuses(spark, sf))
    return rounded(
        lived.select(
            "IND_ID",
            "CENSUS_NUM",
            X.mask_size("HT_RAW", "STAT").alias("HT"),
            X.mask_size("DAH_RAW", "STAT").alias("DAH"),
        )
    )


@query(
    "cone_mask",
    PANEL
    + """SELECT IND_ID, CENSUS_NUM, CASE WHEN STAT = 1 AND na IS NULL THEN 0.0
    WHEN STAT IS NULL OR STAT = 1 THEN CAST(na AS DOUBLE) END AS CONE_Mature FROM st""",
)
def _(spark, sf):
    from ..operators.status import resolve_status

    lived = resolve_status(D.line_censuses(spark, sf)).withColumn("x", F.col("N_A").cast("double"))
    masked = lived.withColumn("x", X.mask_count("x", "STAT"))
    return masked.select("IND_ID", "CENSUS_NUM", X.fill_alive_zero("x", "STAT").alias("CONE_Mature"))


@query(
    "cone_combine",
    DIRTY + 'SELECT TAG, MATURE_D AS "CONE_Mature__14" FROM dirty WHERE CENSUS_NUM = 14',
)
def _(spark, sf):
    raw = D.dirty_wide(spark, sf)
    return raw.select("TAG", X.null_as_zero_sum("CONE14_GOLD", "CONE14_GRAY").alias("CONE_Mature__14"))


@query(
    "zero_to_null",
    DIRTY
    + """SELECT TAG, round(nullif(max(WD2_D) FILTER (WHERE CENSUS_NUM = 13), 0), 6) AS WD2__13,
    round(nullif(max(WD2_D) FILTER (WHERE CENSUS_NUM = 14), 0), 6) AS WD2__14 FROM dirty GROUP BY 1""",
)
def _(spark, sf):
    wide = D.dirty_wide(spark, sf).select("TAG", F.col("WD2_13").alias("WD2__13"), F.col("WD2_14").alias("WD2__14"))
    return rounded(C.zero_to_null(wide, ("WD2",)))


@query(
    "censored_to_null",
    DIRTY
    + """SELECT TAG, CASE WHEN HT_RAW IS NOT NULL AND IND_ID % 89 IN (0, 1) THEN NULL ELSE HT_RAW + 1 END AS HTB14,
    CASE WHEN HT_RAW IS NOT NULL AND IND_ID % 89 IN (0, 1) THEN 1 ELSE 0 END AS "HTB14_censored"
    FROM dirty WHERE CENSUS_NUM = 14""",
)
def _(spark, sf):
    out = C.replace_censored(D.dirty_wide(spark, sf), "HTB14", "14W/subs", R.CENSORED_HEIGHTS, "HTB14")
    return out.select("TAG", "HTB14", "HTB14_censored")


@query(
    "canopy_metrics",
    PANEL
    + """SELECT IND_ID, CENSUS_NUM, round(pi() * (WD1 / 2) * (WD2 / 2), 6) AS CANOPY_AREA,
    round(sqrt(WD1 * WD2), 6) AS CANOPY_DIAM, 1 - STAT AS Dead FROM panel""",
)
def _(spark, sf):
    panel = D.line_panel(spark, sf)
    return rounded(
        panel.select(
            "IND_ID",
            "CENSUS_NUM",
            X.canopy_area("WD1", "WD2").alias("CANOPY_AREA"),
            X.canopy_diameter("WD1", "WD2").alias("CANOPY_DIAM"),
            X.dead_flag("STAT").alias("Dead"),
        )
    )


@query(
    "shrink_flag",
    PANEL
    + """, d AS (SELECT IND_ID, DAH - lag(DAH) OVER (PARTITION BY IND_ID ORDER BY CENSUS_NUM) AS diff FROM panel
  WHERE CENSUS_NUM IN (3, 5, 7, 9, 11, 12, 13, 14))
SELECT IND_ID, coalesce(max(CASE WHEN diff < -5 THEN 1 ELSE 0 END), 0) AS shrunk FROM d GROUP BY 1""",
)
def _(spark, sf):
    return C.shrink_flag(D.line_panel(spark, sf), "DAH", 5.0, (3, 5, 7, 9, 11, 12, 13, 14))


@query(
    "median_units",
    PANEL
    + """SELECT CENSUS_NUM, measure, round(quantile_cont(value, 0.5), 6) AS median FROM
    (SELECT CENSUS_NUM, HT, DAH, WD1, WD2 FROM panel) UNPIVOT (value FOR measure IN (HT, DAH, WD1, WD2))
    GROUP BY 1, 2""",
)
def _(spark, sf):
    return rounded(Q.medians(D.line_panel(spark, sf), ["HT", "DAH", "WD1", "WD2"]))


@query(
    "audit_rules",
    PANEL
    + """, a AS (SELECT
  count(*) FILTER (WHERE STAT = 0 AND HT IS NOT NULL) AS "dead_with_HT",
  count(*) FILTER (WHERE STAT = 0 AND DAH IS NOT NULL) AS "dead_with_DAH",
  count(*) FILTER (WHERE STAT = 0 AND WD2 IS NOT NULL) AS "dead_with_WD2",
  count(*) FILTER (WHERE STAT = 0 AND CONE_Mature IS NOT NULL) AS "dead_with_CONE_Mature",
  count(*) FILTER (WHERE HT = 0) AS "zero_HT", count(*) FILTER (WHERE DAH = 0) AS "zero_DAH",
  count(*) FILTER (WHERE WD2 = 0) AS "zero_WD2",
  count(*) FILTER (WHERE STAT = 1 AND CONE_Mature IS NULL) AS "alive_without_CONE_Mature",
  count(*) FILTER (WHERE SEROTINY IS NOT NULL) AS "not_numeric_SEROTINY" FROM panel)
SELECT rule, violations FROM a UNPIVOT (violations FOR rule IN ("dead_with_HT", "dead_with_DAH", "dead_with_WD2",
  "dead_with_CONE_Mature", "zero_HT", "zero_DAH", "zero_WD2", "alive_without_CONE_Mature", "not_numeric_SEROTINY"))""",
)
def _(spark, sf):
    rules = C.standard_rules(("HT", "DAH", "WD2"), ("CONE_Mature",), ("SEROTINY",))
    return C.audit_rules(D.line_panel(spark, sf), rules)


def gps(spark, sf):
    """Degrees and decimal minutes of every supplier as a plot position."""
    key = F.col("s_suppkey")
    return D.table(spark, sf, "supplier").select(
        F.concat(F.lit("N"), F.col("s_nationkey").cast("string")).alias("SITE"),
        F.col("s_name").alias("PLOTCODE"),
        (F.lit(40) + F.col("s_nationkey") % 3).alias("LATDEG"),
        (F.pmod(key * 7, F.lit(60000)) / 1000).alias("LATMIN"),
        (F.lit(70) + F.col("s_nationkey") % 5).alias("LONGDEG"),
        (F.pmod(key * 13, F.lit(60000)) / 1000).alias("LONGMIN"),
    ).withColumns(
        {
            "LAT": X.decimal_degrees("LATDEG", "LATMIN"),
            "LONG": X.decimal_degrees("LONGDEG", "LONGMIN", negative=True),
        }
    )


GEO = """WITH geo AS (
  SELECT 'N' || s_nationkey AS SITE, s_name AS PLOTCODE,
         40 + s_nationkey % 3 + ((s_suppkey * 7) % 60000) / 1000 / 60 AS LAT,
         -(70 + s_nationkey % 5 + ((s_suppkey * 13) % 60000) / 1000 / 60) AS LONG FROM supplier)
"""


@query(
    "geo_decimal",
    GEO
    + """SELECT SITE, PLOTCODE, round(LAT, 6) AS LAT, round(LONG, 6) AS LONG FROM geo""",
)
def _(spark, sf):
    return gps(spark, sf).select("SITE", "PLOTCODE", r6("LAT"), r6("LONG"))


@query(
    "geo_bounds",
    GEO
    + """SELECT round(min(LONG), 6) AS lng1, round(min(LAT), 6) AS lat1, round(max(LONG), 6) AS lng2,
    round(max(LAT), 6) AS lat2 FROM geo""",
)
def _(spark, sf):
    return rounded(summary.bounding_box(gps(spark, sf)))


@query(
    "wide_to_long",
    DIRTY
    + """SELECT TAG, CENSUS_NUM, CAST(STAT_RAW AS INTEGER) AS STAT, HT_D AS HT, round(DAH_D, 9) AS DAH,
    NEW_D AS CONE_New FROM dirty WHERE PLOT_D IS NOT NULL AND COHORT_D IS NOT NULL""",
)
def _(spark, sf):
    wide = standardise(C.drop_null_keys(D.dirty_wide(spark, sf), ("PLOTCODE", "COHORT")), LAYOUT)
    return rounded(reshape.wide_to_long(wide, ["TAG"], ["STAT", "HT", "DAH", "CONE_New"]))


@query(
    "clean_long_panel",
    DIRTY
    + """SELECT d.PLOT_D AS PLOTCODE, COHORT_D AS COHORT, TAG, SITEAREA, regexp_replace(SITEAREA, '[0-9].*', '') AS AREA,
    round(PLTAREA, 6) AS PLTAREA, SDLAREA, TMT, CENSUS_NUM, STAT,
    CASE WHEN STAT = 1 THEN HT_D END AS HT, round(CASE WHEN STAT = 1 THEN nullif(DAH_D, 0) END, 9) AS DAH,
    round(CASE WHEN STAT = 1 THEN nullif(WD1_D, 0) END, 6) AS WD1,
    round(CASE WHEN STAT = 1 THEN nullif(WD2_D, 0) END, 6) AS WD2, NEW_D AS CONE_New,
    CASE WHEN CENSUS_NUM >= 12 AND STAT = 1 THEN coalesce(MATURE_D, 0)
         WHEN CENSUS_NUM >= 13 AND STAT = 0 THEN NULL ELSE MATURE_D END AS CONE_Mature,
    SER_D AS SEROTINY, strftime(make_date(1995 + (CENSUS_NUM - 1) // 2, 1 + 6 * ((CENSUS_NUM - 1) % 2), 1), '%Y-%m-%d')
    AS START_DATE
    FROM dirty d JOIN plots p ON p.OLDCODE = d.PLOT_D
    WHERE COHORT_D IS NOT NULL AND TMT = 'NONE'""",
)
def _(spark, sf):
    """The whole raw-to-panel workflow; the surrogate id is checked by its own query."""
    dates = (
        D.table(spark, sf, "lineitem")
        .select(D.half_year_census("l_shipdate").alias("CENSUS_NUM"))
        .distinct()
        .withColumn("START_DATE", D.half_year_start())
    )
    panel = clean_panel(D.dirty_wide(spark, sf), D.plot_information(spark, sf), dates, LAYOUT)
    return rounded(panel.drop("IND_ID"))
