"""Query registry and the SQL text shared by the twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}

# Long panel over ``lineitem`` and ``part``; ends in the common tables ``raw`` and ``panel``.
PANEL = """
WITH per AS (
  SELECT l_partkey AS ind, CAST(1 + floor(((year(l_shipdate) - 1995) * 12 + month(l_shipdate) - 1) / 6) AS INTEGER) AS c,
         count(*) AS n,
         count(*) FILTER (WHERE l_returnflag = 'R') AS nr,
         count(*) FILTER (WHERE l_returnflag = 'A') AS na,
         sum(l_quantity) AS q, sum(CAST(round(l_extendedprice * 100) AS BIGINT)) / count(*) / 100000 AS dah,
         avg(l_discount) * 1000 AS wd1, avg(l_tax) * 1000 AS wd2
  FROM lineitem GROUP BY 1, 2),
site AS (
  SELECT p_partkey AS ind, p_brand AS sitearea, p_size % 5 AS sub,
         CAST(regexp_replace(p_brand, '[^0-9]', '', 'g') AS INTEGER) AS brand
  FROM part),
grid AS (
  SELECT ind, c FROM (SELECT DISTINCT ind FROM per), (SELECT CAST(range AS INTEGER) AS c FROM range(1, 15))),
raw AS (
  SELECT g.ind AS IND_ID, g.c AS CENSUS_NUM, s.sitearea AS SITEAREA,
         CASE WHEN s.brand = 25 THEN 'A3' ELSE 'A' || (s.brand % 3) END AS AREA,
         s.sitearea || '-' || s.sub AS PLOTCODE, s.sub AS sub, s.brand AS brand,
         p.n AS n, p.nr AS nr, p.na AS na,
         min(p.c) OVER (PARTITION BY g.ind) AS COHORT,
         CASE WHEN p.n IS NOT NULL THEN 10 + sum(p.q) OVER (PARTITION BY g.ind ORDER BY g.c) END AS HT_RAW,
         p.dah AS DAH_RAW, p.wd1 AS WD1_RAW, p.wd2 AS WD2_RAW
  FROM grid g JOIN site s ON s.ind = g.ind LEFT JOIN per p ON p.ind = g.ind AND p.c = g.c),
coded AS (
  SELECT *, CASE WHEN CENSUS_NUM < COHORT THEN NULL WHEN n IS NULL THEN 2
                 WHEN n >= 3 AND nr = n THEN 1 WHEN n = 2 AND nr = n THEN 2 ELSE 0 END AS STAT_RAW
  FROM raw),
s1 AS (SELECT *, min(CASE WHEN STAT_RAW = 1 THEN CENSUS_NUM END) OVER (PARTITION BY IND_ID) AS d0 FROM coded),
s2 AS (SELECT *, max(CASE WHEN STAT_RAW = 0 AND (d0 IS NULL OR CENSUS_NUM < d0) THEN CENSUS_NUM END)
                 OVER (PARTITION BY IND_ID) AS l0 FROM s1),
s3 AS (SELECT *, min(CASE WHEN STAT_RAW IN (1, 2) AND CENSUS_NUM > coalesce(l0, 0) THEN CENSUS_NUM END)
                 OVER (PARTITION BY IND_ID) AS death FROM s2),
st AS (SELECT *, CASE WHEN CENSUS_NUM >= death THEN 0 WHEN STAT_RAW IN (0, 2) THEN 1 END AS STAT FROM s3),
panel AS (
  SELECT IND_ID, PLOTCODE, SITEAREA, AREA, sub, brand, COHORT, CENSUS_NUM,
         make_date(1995 + (CENSUS_NUM - 1) // 2, 1 + 6 * ((CENSUS_NUM - 1) % 2), 1) AS START_DATE,
         STAT, CASE WHEN STAT = 1 THEN HT_RAW END AS HT, CASE WHEN STAT = 1 THEN DAH_RAW END AS DAH,
         CASE WHEN STAT = 1 THEN nullif(WD1_RAW, 0) END AS WD1, CASE WHEN STAT = 1 THEN nullif(WD2_RAW, 0) END AS WD2,
         CASE WHEN STAT = 1 THEN CAST(nr AS DOUBLE) END AS CONE_New,
         CASE WHEN STAT = 1 THEN CAST(coalesce(na, 0) AS DOUBLE) END AS CONE_Mature,
         CASE WHEN STAT = 1 AND CENSUS_NUM >= 13 AND na IS NOT NULL THEN
           CASE na % 4 WHEN 0 THEN '' WHEN 1 THEN 'S' WHEN 2 THEN 'O' ELSE 'SO' END END AS SEROTINY
  FROM st),
plots AS (
  SELECT p_brand || '-' || (p_size % 5) AS OLDCODE,
         CAST(CASE WHEN p_size % 5 = 0 THEN 4 ELSE 10 END AS DOUBLE) AS SDLAREA,
         CASE WHEN p_size % 5 = 4 AND CAST(regexp_replace(p_brand, '[^0-9]', '', 'g') AS INTEGER) % 5 = 0
              THEN 'BURN' ELSE 'NONE' END AS TMT,
         avg(p_size) * 4 AS PLTAREA,
         CAST(count(*) FILTER (WHERE p_size > 25) AS DOUBLE) AS CONES1,
         CAST(count(*) FILTER (WHERE p_size > 40) AS DOUBLE) AS TOPALIV1
  FROM part GROUP BY 1, 2, 3)
"""

# Survival and growth pairs on top of ``panel``.
PAIRS = (
    PANEL
    + """,
led AS (
  SELECT *, lead(STAT) OVER w AS STAT_next, lead(CENSUS_NUM) OVER w AS CENSUS_next,
         lead(START_DATE) OVER w AS Date_next, lead(HT) OVER w AS HT_next
  FROM panel WHERE CENSUS_NUM IN (3, 5, 7, 9, 11, 12, 13, 14, 15)
  WINDOW w AS (PARTITION BY IND_ID ORDER BY CENSUS_NUM)),
surv AS (
  SELECT *, 1 - STAT_next AS Dead_next,
         date_diff('day', DATE '1994-09-01', START_DATE) / 365.25 AS TimeSinceFire,
         date_diff('day', START_DATE, Date_next) / 365.25 AS CensusInterval
  FROM led WHERE STAT = 1 AND STAT_next IS NOT NULL AND HT IS NOT NULL),
grow AS (
  SELECT *, HT_next - HT AS deltaHT, (HT_next - HT) / CensusInterval AS deltaHT_annual,
         HT + (HT_next - HT) / CensusInterval AS HT_next_annual
  FROM surv WHERE STAT_next = 1 AND HT_next IS NOT NULL)
"""
)

PANEL_ORIGIN = "1994-09-01"


def query(name: str, sql: str | None = None):
    """Register a query under ``name`` with its SQL twin."""

    def keep(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return keep


def r6(value, name: str | None = None) -> Column:
    """Doubles are rounded to six decimals at the edge, where results are compared."""
    col = F.col(value) if isinstance(value, str) else value
    out = F.round(col.cast("double"), 6)
    label = name or (value if isinstance(value, str) else None)
    return out.alias(label) if label else out


def iso(value: str, name: str | None = None) -> Column:
    return F.date_format(value, "yyyy-MM-dd").alias(name or value)


def rounded(df: DataFrame) -> DataFrame:
    """Round every double column and print every date column.

    DAH is an exact decimal that often ends in a 5 at the seventh place: it keeps nine digits.
    """
    kinds = dict(df.dtypes)
    return df.select(
        *[
            F.round(c, 9).alias(c)
            if c.startswith("DAH")
            else r6(c)
            if kinds[c] == "double" else iso(c) if kinds[c] == "date" else F.col(c)
            for c in df.columns
        ]
    )
