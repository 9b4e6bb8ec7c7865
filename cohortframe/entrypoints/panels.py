"""Panels, status, transitions and cohort queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cohorts, reshape, seasons, summary, transitions as T
from ..functions import columns as X
from ..sources import tables as D
from .registry import PAIRS, PANEL, PANEL_ORIGIN, iso, query, r6, rounded

LEVELS = ["A0", "A1", "A2", "A3"]


def with_plots(spark, sf):
    """Panel with the plot attributes, as the cleaning workflow leaves it."""
    info = D.plot_information(spark, sf).select(F.col("OLDCODE").alias("PLOTCODE"), "SDLAREA", "TMT")
    return D.line_panel(spark, sf).join(info, "PLOTCODE", "left")


def survival(spark, sf, **kw):
    return T.survival_transitions(D.line_panel(spark, sf), origin_date=PANEL_ORIGIN, **kw)


def growth(spark, sf, **kw):
    return T.growth_transitions(D.line_panel(spark, sf), origin_date=PANEL_ORIGIN, **kw)


@query("status_resolve", PANEL + "SELECT IND_ID, CENSUS_NUM, COHORT, STAT_RAW, STAT FROM st")
def _(spark, sf):
    from ..operators.status import resolve_status

    return resolve_status(D.line_censuses(spark, sf)).select("IND_ID", "CENSUS_NUM", "COHORT", "STAT_RAW", "STAT")


@query(
    "long_panel",
    PANEL
    + """SELECT IND_ID, PLOTCODE, SITEAREA, AREA, COHORT, CENSUS_NUM, strftime(START_DATE, '%Y-%m-%d') AS START_DATE,
    STAT, round(HT, 6) AS HT, round(DAH, 9) AS DAH, round(WD1, 6) AS WD1, round(WD2, 6) AS WD2, CONE_New, CONE_Mature,
    SEROTINY FROM panel""",
)
def _(spark, sf):
    return rounded(D.line_panel(spark, sf))


EVENT_SQL = """
WITH per AS (
  SELECT user_id AS ind, CAST(1 + floor((day(ts) - 1) / 2) AS INTEGER) AS c, count(*) AS n,
         count(*) FILTER (WHERE event_type = 'error') AS ne, sum(value) AS v
  FROM events GROUP BY 1, 2),
grid AS (SELECT ind, c FROM (SELECT DISTINCT ind FROM per), (SELECT CAST(range AS INTEGER) AS c FROM range(1, 16))),
coded AS (
  SELECT g.ind AS IND_ID, g.c AS CENSUS_NUM, min(p.c) OVER (PARTITION BY g.ind) AS COHORT,
         CASE WHEN n IS NULL THEN 2 WHEN n >= 3 AND 4 * ne >= 3 * n THEN 1 WHEN 2 * ne > n THEN 2 ELSE 0 END AS s,
         CASE WHEN n IS NOT NULL THEN sum(v) OVER (PARTITION BY g.ind ORDER BY g.c) END AS h
  FROM grid g LEFT JOIN per p ON p.ind = g.ind AND p.c = g.c),
a1 AS (SELECT *, min(CASE WHEN s = 1 THEN CENSUS_NUM END) OVER (PARTITION BY IND_ID) AS d0 FROM coded),
a2 AS (SELECT *, max(CASE WHEN s = 0 AND (d0 IS NULL OR CENSUS_NUM < d0) THEN CENSUS_NUM END)
                 OVER (PARTITION BY IND_ID) AS l0 FROM a1),
a3 AS (SELECT *, min(CASE WHEN s IN (1, 2) AND CENSUS_NUM > coalesce(l0, 0) THEN CENSUS_NUM END)
                 OVER (PARTITION BY IND_ID) AS death FROM a2),
a4 AS (SELECT *, CASE WHEN CENSUS_NUM >= death THEN 0 ELSE 1 END AS STAT FROM a3)
SELECT a.IND_ID, n_name AS SITEAREA, r_name AS AREA, COHORT, CENSUS_NUM,
       strftime(DATE '2024-01-01' + CAST(2 * (CENSUS_NUM - 1) AS INTEGER), '%Y-%m-%d') AS START_DATE, STAT,
       round(CASE WHEN STAT = 1 THEN h END, 6) AS HT
FROM a4 a LEFT JOIN customer ON c_custkey = a.IND_ID LEFT JOIN nation ON n_nationkey = c_nationkey
LEFT JOIN region ON r_regionkey = n_regionkey
"""


@query("event_panel", EVENT_SQL)
def _(spark, sf):
    return rounded(D.event_panel(spark, sf))


@query(
    "num_alive",
    PANEL
    + """SELECT CENSUS_NUM, strftime(START_DATE, '%Y-%m-%d') AS START_DATE, AREA, SITEAREA,
    count(DISTINCT IND_ID) AS NumAlive, count(*) AS n FROM panel WHERE STAT = 1 GROUP BY 1, 2, 3, 4""",
)
def _(spark, sf):
    return rounded(summary.num_alive(D.line_panel(spark, sf)))


@query(
    "num_alive_cohort1",
    PANEL
    + """SELECT CENSUS_NUM, strftime(START_DATE, '%Y-%m-%d') AS START_DATE, AREA, SITEAREA,
    count(DISTINCT IND_ID) AS NumAlive, count(*) AS n FROM panel WHERE STAT = 1 AND COHORT = 1 GROUP BY 1, 2, 3, 4""",
)
def _(spark, sf):
    return rounded(summary.num_alive(D.line_panel(spark, sf), cohort=1))


NUM_DEAD = """, prev AS (
  SELECT *, lag(STAT) OVER (PARTITION BY IND_ID ORDER BY CENSUS_NUM) AS STAT_prev FROM panel),
alive AS (
  SELECT CENSUS_NUM, START_DATE, AREA, SITEAREA, count(DISTINCT IND_ID) AS NumAlive
  FROM panel WHERE STAT = 1 GROUP BY 1, 2, 3, 4),
dead AS (
  SELECT CENSUS_NUM, START_DATE, AREA, SITEAREA, count(DISTINCT IND_ID) AS NumDead
  FROM prev WHERE CENSUS_NUM > 1 AND STAT_prev = 1 AND STAT = 0 GROUP BY 1, 2, 3, 4)
"""


@query(
    "num_dead",
    PANEL
    + NUM_DEAD
    + "SELECT CENSUS_NUM, strftime(START_DATE, '%Y-%m-%d') AS START_DATE, AREA, SITEAREA, NumDead FROM dead",
)
def _(spark, sf):
    return rounded(summary.num_dead(D.line_panel(spark, sf)))


def prop_dead(spark, sf):
    return rounded(summary.prop_dead(D.line_panel(spark, sf)))


query(
    "prop_dead",
    PANEL
    + NUM_DEAD
    + """, joined AS (
  SELECT a.*, d.NumDead, lag(NumAlive) OVER (PARTITION BY a.AREA, a.SITEAREA ORDER BY a.CENSUS_NUM) AS NumAlive_prev
  FROM alive a LEFT JOIN dead d USING (CENSUS_NUM, START_DATE, AREA, SITEAREA))
SELECT CENSUS_NUM, strftime(START_DATE, '%Y-%m-%d') AS START_DATE, AREA, SITEAREA, NumAlive, NumDead, NumAlive_prev,
       round(coalesce(NumDead / NumAlive_prev, 0), 6) AS PropDead
FROM joined WHERE CENSUS_NUM > 1""",
)(prop_dead)


@query(
    "survivorship",
    PANEL
    + """, alive AS (SELECT CENSUS_NUM, AREA, SITEAREA, count(*) AS NumAlive FROM panel
  WHERE STAT = 1 AND COHORT = 1 GROUP BY 1, 2, 3)
SELECT *, round(NumAlive / first_value(NumAlive) OVER (PARTITION BY AREA, SITEAREA ORDER BY CENSUS_NUM), 6) AS PropSurv
FROM alive""",
)
def _(spark, sf):
    alive = summary.num_alive(D.line_panel(spark, sf), cohort=1, keys=("CENSUS_NUM", "AREA", "SITEAREA")).drop("n")
    return rounded(summary.survivorship(alive))


# --- transitions -----------------------------------------------------------------------

KEYS = ["IND_ID", "PLOTCODE", "SITEAREA", "AREA", "CENSUS_NUM"]


@query(
    "survival_pairs",
    PAIRS
    + """SELECT IND_ID, PLOTCODE, SITEAREA, AREA, CENSUS_NUM, HT, Dead_next, CENSUS_next,
    round(CensusInterval, 6) AS CensusInterval, round(TimeSinceFire, 6) AS TimeSinceFire FROM surv""",
)
def _(spark, sf):
    return rounded(
        survival(spark, sf).select(*KEYS, "HT", "Dead_next", "CENSUS_next", "CensusInterval", "TimeSinceFire")
    )


@query(
    "survival_pairs_exploratory",
    PANEL
    + """, led AS (SELECT *, lead(STAT) OVER w AS STAT_next, lead(START_DATE) OVER w AS Date_next FROM panel
  WINDOW w AS (PARTITION BY IND_ID ORDER BY CENSUS_NUM))
SELECT IND_ID, PLOTCODE, SITEAREA, AREA, CENSUS_NUM, HT, 1 - STAT_next AS Dead_next,
       round(date_diff('day', START_DATE, Date_next) / 365.25, 1) AS CensusInterval,
       round(date_diff('day', DATE '1994-06-01', START_DATE) / 365.25, 6) AS TimeSinceFire
FROM led WHERE STAT = 1 AND STAT_next IS NOT NULL AND HT IS NOT NULL""",
)
def _(spark, sf):
    pairs = T.survival_transitions(
        D.line_panel(spark, sf), censuses=None, origin_date="1994-06-01", interval_digits=1
    )
    return rounded(pairs.select(*KEYS, "HT", "Dead_next", "CensusInterval", "TimeSinceFire"))


@query(
    "growth_pairs",
    PAIRS
    + """SELECT IND_ID, PLOTCODE, SITEAREA, AREA, CENSUS_NUM, HT, HT_next, CENSUS_next, deltaHT,
    round(deltaHT_annual, 6) AS deltaHT_annual, round(HT_next_annual, 6) AS HT_next_annual FROM grow""",
)
def _(spark, sf):
    return rounded(
        growth(spark, sf).select(
            *KEYS, "HT", "HT_next", "CENSUS_next", "deltaHT", "deltaHT_annual", "HT_next_annual"
        )
    )


TRIAL = """, led AS (
  SELECT *, lead(STAT) OVER w AS STAT_next, lead(START_DATE) OVER w AS Date_next, lead(HT) OVER w AS HT_next
  FROM panel WHERE CENSUS_NUM IN (3, 5, 7, 9, 11, 12, 13, 14) WINDOW w AS (PARTITION BY IND_ID ORDER BY CENSUS_NUM)),
trial AS (
  SELECT *, HT_next - HT AS deltaHT, CAST(year(Date_next) - year(START_DATE) AS DOUBLE) AS CensusInterval,
         (HT_next - HT) / nullif(year(Date_next) - year(START_DATE), 0) AS deltaHT_annual
  FROM led WHERE STAT = 1 AND STAT_next = 1 AND HT IS NOT NULL AND HT_next IS NOT NULL)
"""


def trial(spark, sf):
    return T.growth_transitions(
        D.line_panel(spark, sf), T.TRIAL_GROWTH_CENSUSES, PANEL_ORIGIN, interval_mode="calendar"
    )


@query(
    "growth_trial",
    PANEL
    + TRIAL
    + """SELECT IND_ID, PLOTCODE, SITEAREA, AREA, CENSUS_NUM, HT, HT_next, deltaHT, CensusInterval,
    round(deltaHT_annual, 6) AS deltaHT_annual, round(HT + deltaHT_annual, 6) AS HT_next_annual FROM trial""",
)
def _(spark, sf):
    return rounded(
        trial(spark, sf).select(*KEYS, "HT", "HT_next", "deltaHT", "CensusInterval", "deltaHT_annual", "HT_next_annual")
    )


@query(
    "relative_growth",
    PANEL
    + TRIAL
    + """SELECT IND_ID, CENSUS_NUM, AREA, round(deltaHT_annual, 6) AS deltaHT_annual,
    round(deltaHT_annual / HT, 6) AS RGR_annual FROM trial""",
)
def _(spark, sf):
    return rounded(
        T.relative_growth(trial(spark, sf)).select("IND_ID", "CENSUS_NUM", "AREA", "deltaHT_annual", "RGR_annual")
    )


@query(
    "cone_lead",
    PANEL
    + """SELECT IND_ID, CENSUS_NUM, CONE_New, lead(CONE_Mature) OVER (PARTITION BY IND_ID ORDER BY CENSUS_NUM)
    AS CONE_Mature_next FROM panel WHERE COHORT = 1 AND CENSUS_NUM > 10""",
)
def _(spark, sf):
    return T.cone_transitions(D.line_panel(spark, sf))


@query(
    "pair_summary",
    PAIRS
    + """SELECT CENSUS_NUM, CENSUS_next, count(*) AS n, round(min(CensusInterval), 6) AS MinInterval,
    round(max(CensusInterval), 6) AS MaxInterval, round(avg(Dead_next), 6) AS MortRate FROM surv GROUP BY 1, 2""",
)
def _(spark, sf):
    return rounded(summary.pair_summary(survival(spark, sf)))


@query(
    "pair_crosstab",
    PAIRS
    + "SELECT CENSUS_NUM, "
    + ", ".join(f"count(*) FILTER (WHERE CENSUS_next = {k}) AS CENSUS_next_{k}" for k in (5, 7, 9, 11, 12, 13, 14))
    + " FROM surv GROUP BY 1",
)
def _(spark, sf):
    return summary.contingency(survival(spark, sf), "CENSUS_NUM", "CENSUS_next", (5, 7, 9, 11, 12, 13, 14))


# --- cohorts ---------------------------------------------------------------------------


@query(
    "recruits_by_plot",
    PANEL
    + """SELECT p.PLOTCODE, AREA, SITEAREA, CENSUS_NUM, strftime(START_DATE, '%Y-%m-%d') AS START_DATE,
    count(*) FILTER (WHERE COHORT = CENSUS_NUM) AS NumRecruits, CONES1, TOPALIV1
    FROM panel p LEFT JOIN plots ON OLDCODE = p.PLOTCODE GROUP BY ALL""",
)
def _(spark, sf):
    info = D.plot_information(spark, sf).select(F.col("OLDCODE").alias("PLOTCODE"), "CONES1", "TOPALIV1")
    return rounded(cohorts.recruits_by_plot(D.line_panel(spark, sf)).join(info, "PLOTCODE", "left"))


@query(
    "first_year_recruits",
    PANEL
    + """, agg AS (
  SELECT p.PLOTCODE, AREA, SITEAREA, SDLAREA, count(*) FILTER (WHERE COHORT = CENSUS_NUM) AS NumRecruits
  FROM panel p LEFT JOIN plots ON OLDCODE = p.PLOTCODE WHERE CENSUS_NUM IN (1, 2) GROUP BY ALL)
SELECT a.*, CONES1, round(PLTAREA, 6) AS PLTAREA, CAST(CASE WHEN a.SDLAREA = 4 THEN 1 ELSE 0 END AS DOUBLE) AS SmallPlot
FROM agg a LEFT JOIN plots ON OLDCODE = a.PLOTCODE""",
)
def _(spark, sf):
    return rounded(cohorts.first_year_recruits(with_plots(spark, sf), D.plot_information(spark, sf)))


@query(
    "cohort_first_year",
    PANEL
    + """, wide AS (
  SELECT IND_ID, AREA, SITEAREA, PLOTCODE, COHORT, max(STAT) FILTER (WHERE CENSUS_NUM = 1) AS STAT_1,
         max(STAT) FILTER (WHERE CENSUS_NUM = 2) AS STAT_2, max(STAT) FILTER (WHERE CENSUS_NUM = 3) AS alive3,
         max(HT) FILTER (WHERE CENSUS_NUM = 3) AS HT
  FROM panel WHERE COHORT IN (1, 2) AND CENSUS_NUM IN (1, 2, 3) GROUP BY ALL),
det AS (SELECT *, CASE WHEN COHORT = 1 THEN STAT_1 ELSE STAT_2 END AS stat_det FROM wide)
SELECT * FROM det WHERE stat_det = 1""",
)
def _(spark, sf):
    return cohorts.cohort_first_year(D.line_panel(spark, sf))


SEASONS = (
    PANEL
    + """, opened AS (
  SELECT CENSUS_NUM AS COHORT, min(START_DATE) AS d,
         year(min(START_DATE)) - CASE WHEN month(min(START_DATE)) < 4 THEN 1 ELSE 0 END AS last FROM panel GROUP BY 1),
covered AS (SELECT *, lag(last) OVER (ORDER BY d, COHORT) AS before FROM opened),
season AS (
  SELECT COHORT, last, CASE WHEN before < last THEN before + 1 ELSE last END AS first FROM covered),
years AS (SELECT COHORT, (first + last) / 2 AS Year, last - first + 1 AS Interval FROM season)
"""
)


@query(
    "season_recruits",
    SEASONS
    + """, unit AS (SELECT DISTINCT p.PLOTCODE, SITEAREA, AREA, SDLAREA FROM panel p LEFT JOIN plots ON OLDCODE = p.PLOTCODE),
cnt AS (SELECT PLOTCODE, COHORT, count(DISTINCT IND_ID) AS n FROM panel WHERE COHORT >= 3 GROUP BY 1, 2)
SELECT u.PLOTCODE, SITEAREA, AREA, SDLAREA, s.Year AS Year, s.Interval AS Interval,
       CAST(sum(coalesce(n, 0)) AS BIGINT) AS NumRecruits, s.Year - 1995 AS TimeSinceFire
FROM unit u CROSS JOIN years s LEFT JOIN cnt c ON c.PLOTCODE = u.PLOTCODE AND c.COHORT = s.COHORT
WHERE s.COHORT >= 3 GROUP BY ALL""",
)
def _(spark, sf):
    return cohorts.season_recruits(with_plots(spark, sf))


@query(
    "cohort_seasons",
    SEASONS
    + """, cnt AS (SELECT COHORT, count(DISTINCT IND_ID) AS n_individuals FROM panel WHERE COHORT >= 3 GROUP BY 1)
SELECT c.COHORT, n_individuals, Year, Interval FROM cnt c LEFT JOIN years y ON y.COHORT = c.COHORT""",
)
def _(spark, sf):
    panel = D.line_panel(spark, sf)
    return seasons.cohort_seasons(panel, seasons.census_seasons(seasons.census_dates(panel)))


@query(
    "later_cohort_sizes",
    PANEL
    + """SELECT IND_ID, PLOTCODE, SITEAREA, AREA, COHORT, HT, CASE WHEN AREA = 'A0' THEN 'A0' ELSE 'REST' END
    AS AREA_combined FROM panel WHERE COHORT IN (2, 3, 5, 7, 9, 10) AND CENSUS_NUM = COHORT AND STAT = 1
    AND HT IS NOT NULL""",
)
def _(spark, sf):
    sizes = cohorts.later_cohort_sizes(D.line_panel(spark, sf), (2, 3, 5, 7, 9, 10), "A0", "REST")
    return sizes.select("IND_ID", "PLOTCODE", "SITEAREA", "AREA", "COHORT", "HT", "AREA_combined")


@query(
    "cone_last_census",
    PANEL
    + """SELECT IND_ID, PLOTCODE, AREA, HT, CONE_Mature, nullif(SEROTINY, '') AS SEROTINY,
    CASE SEROTINY WHEN 'O' THEN 0 WHEN 'S' THEN 1 END AS SEROTINY_binary
    FROM panel WHERE STAT = 1 AND CONE_Mature IS NOT NULL AND HT IS NOT NULL AND CENSUS_NUM = 14""",
)
def _(spark, sf):
    cones = cohorts.last_census_cones(D.line_panel(spark, sf), D.LINE_CENSUSES)
    return cones.select("IND_ID", "PLOTCODE", "AREA", "HT", "CONE_Mature", "SEROTINY", "SEROTINY_binary")


@query(
    "size_complete_cases",
    PANEL
    + """SELECT IND_ID, CENSUS_NUM, IND_ID || '_' || CENSUS_NUM AS ID_CENSUS, HT, round(DAH, 9) AS DAH,
    round(WD1, 6) AS WD1, round(WD2, 6) AS WD2 FROM panel
    WHERE COHORT = 1 AND HT IS NOT NULL AND DAH IS NOT NULL AND WD1 IS NOT NULL AND WD2 IS NOT NULL""",
)
def _(spark, sf):
    return rounded(cohorts.size_complete_cases(D.line_panel(spark, sf)))


# --- reshape and joins -----------------------------------------------------------------


@query(
    "status_wide",
    PANEL
    + """SELECT IND_ID, """
    + ", ".join(
        f"max({m}) FILTER (WHERE CENSUS_NUM = {k}) AS {m}_{k}" for m in ("STAT", "HT") for k in (1, 2, 3)
    )
    + " FROM panel GROUP BY 1",
)
def _(spark, sf):
    return reshape.long_to_wide(D.line_panel(spark, sf), ["IND_ID"], ["STAT", "HT"], [1, 2, 3])


@query(
    "census_dates",
    """WITH sheet AS (SELECT c, CASE WHEN c % 2 = 1 THEN min(l_shipdate) ELSE max(l_shipdate) END AS d FROM
  (SELECT l_shipdate, CAST(1 + floor(((year(l_shipdate) - 1995) * 12 + month(l_shipdate) - 1) / 6) AS INTEGER) AS c
   FROM lineitem) GROUP BY c)
SELECT c AS CENSUS_NUM, strftime(d, '%Y-%m-%d') AS START_DATE, CAST(month(d) AS INTEGER) AS CENSUS_MONTH,
       CAST(year(d) AS INTEGER) AS CENSUS_YEAR FROM sheet""",
)
def _(spark, sf):
    """A date sheet with one column per census, as the workbook holds it, turned to rows."""
    lines = D.table(spark, sf, "lineitem").select("l_shipdate", D.half_year_census("l_shipdate").alias("c"))

    def pick(k: int):
        at = F.when(F.col("c") == k, F.col("l_shipdate"))
        return (F.min(at) if k % 2 else F.max(at)).alias(f"Census {k}")

    sheet = lines.agg(F.lit("Start on").alias("...1"), *[pick(k) for k in range(1, D.LINE_CENSUSES + 1)])
    return rounded(reshape.census_dates_long(sheet, "...1"))


@query(
    "plot_dimension_join",
    PANEL
    + """SELECT p.IND_ID, p.PLOTCODE, PLTAREA, SDLAREA, TMT FROM (SELECT DISTINCT IND_ID, PLOTCODE FROM panel) p
    LEFT JOIN (SELECT OLDCODE, round(PLTAREA, 6) AS PLTAREA, SDLAREA, TMT FROM plots) q ON q.OLDCODE = p.PLOTCODE
    WHERE TMT = 'NONE'""",
)
def _(spark, sf):
    plots = D.plot_information(spark, sf)
    individuals = D.line_panel(spark, sf).select("IND_ID", "PLOTCODE").distinct()
    joined = individuals.join(plots, individuals["PLOTCODE"] == plots["OLDCODE"], "left")
    return rounded(joined.filter(F.col("TMT") == "NONE").select("IND_ID", "PLOTCODE", "PLTAREA", "SDLAREA", "TMT"))


@query("distinct_plots", PANEL + "SELECT DISTINCT PLOTCODE, SITEAREA, AREA FROM panel")
def _(spark, sf):
    return D.line_panel(spark, sf).select("PLOTCODE", "SITEAREA", "AREA").distinct()


@query(
    "loso_sites",
    PANEL
    + """, pairs AS (SELECT DISTINCT SITEAREA, AREA FROM panel)
SELECT SITEAREA, AREA FROM pairs WHERE AREA IN (SELECT AREA FROM pairs GROUP BY 1 HAVING count(*) > 1)""",
)
def _(spark, sf):
    return summary.sites_for_holdout(D.line_panel(spark, sf))


@query(
    "zero_filled_grid",
    PANEL
    + """, unit AS (SELECT DISTINCT PLOTCODE FROM panel),
ax AS (SELECT DISTINCT CENSUS_NUM AS COHORT FROM panel),
cnt AS (SELECT PLOTCODE, COHORT, count(DISTINCT IND_ID) AS n FROM panel GROUP BY 1, 2)
SELECT u.PLOTCODE, ax.COHORT, coalesce(n, 0) AS n
FROM unit u CROSS JOIN ax LEFT JOIN cnt c ON c.PLOTCODE = u.PLOTCODE AND c.COHORT = ax.COHORT""",
)
def _(spark, sf):
    panel = D.line_panel(spark, sf)
    axis = panel.select(F.col("CENSUS_NUM").alias("COHORT")).distinct()
    first = panel.filter(F.col("CENSUS_NUM") == F.col("COHORT"))
    counts = first.groupBy("PLOTCODE", "COHORT").agg(F.count(F.lit(1)).alias("n"))
    return reshape.zero_filled_grid(panel.select("PLOTCODE").distinct(), axis, counts, ["PLOTCODE", "COHORT"], "n")


@query(
    "prediction_grid",
    PAIRS
    + """, lim AS (SELECT min(HT) AS lo, max(HT) AS hi, avg(TimeSinceFire) AS t FROM surv)
SELECT round(lo + (hi - lo) * i / 999, 6) AS HT, AREA, round(t, 6) AS TimeSinceFire
FROM lim, (SELECT DISTINCT AREA FROM surv), (SELECT range AS i FROM range(0, 1000))""",
)
def _(spark, sf):
    pairs = survival(spark, sf)
    return rounded(
        reshape.prediction_grid(pairs, "HT", "AREA", 1000, [F.avg("TimeSinceFire").alias("TimeSinceFire")])
    )


# --- summaries -------------------------------------------------------------------------

SIZES = ("HT", "DAH", "WD1", "WD2")
CONES = ("CONE_New", "CONE_Mature")


def _availability_sql(measures, where="STAT = 1"):
    num = ", ".join(f"count({m}) AS Num{m}" for m in measures)
    frac = ", ".join(f"round(Num{m} / NumAlive, 2) AS Frac{m}" for m in measures)
    return f""", counted AS (
  SELECT CENSUS_NUM, strftime(START_DATE, '%Y-%m-%d') AS START_DATE, AREA, SITEAREA,
         count(DISTINCT IND_ID) AS NumAlive, {num} FROM panel WHERE {where} GROUP BY 1, 2, 3, 4),
avail AS (SELECT *, {frac} FROM counted)
"""


@query("data_availability", PANEL + _availability_sql(SIZES) + "SELECT * FROM avail")
def _(spark, sf):
    return rounded(summary.availability(D.line_panel(spark, sf), SIZES))


@query("cone_availability", PANEL + _availability_sql(CONES) + "SELECT * FROM avail")
def _(spark, sf):
    return rounded(summary.availability(D.line_panel(spark, sf), CONES))


@query(
    "availability_mean",
    PANEL
    + _availability_sql(SIZES, "STAT = 1 AND COHORT = 1")
    + """, m AS (SELECT CENSUS_NUM, AREA, avg(FracHT) AS FracHT, avg(FracDAH) AS FracDAH, avg(FracWD1) AS FracWD1,
    avg(FracWD2) AS FracWD2 FROM avail GROUP BY 1, 2)
SELECT CENSUS_NUM, AREA, name, round(value, 6) AS value FROM m UNPIVOT (value FOR name IN (FracHT, FracDAH, FracWD1, FracWD2))""",
)
def _(spark, sf):
    available = summary.availability(D.line_panel(spark, sf), SIZES, cohort=1)
    means = summary.mean_availability(available, ("CENSUS_NUM", "AREA"))
    names = [c for c in means.columns if c.startswith("Frac")]
    return rounded(reshape.to_display(means, ["CENSUS_NUM", "AREA"], names))


@query(
    "height_moments",
    PANEL
    + """SELECT CENSUS_NUM, AREA, round(avg(HT), 6) AS MeanHt, round(stddev_samp(HT), 6) AS SDHt FROM panel
    WHERE COHORT = 1 GROUP BY 1, 2""",
)
def _(spark, sf):
    first = D.line_panel(spark, sf).filter(F.col("COHORT") == 1)
    return rounded(summary.height_moments(first, ("CENSUS_NUM", "AREA")))


@query(
    "serotiny_counts",
    PANEL
    + """SELECT AREA, CENSUS_NUM, SEROTINY, count(*) AS NumInds,
    CASE WHEN count(CONE_Mature) = count(*) THEN sum(CONE_Mature) END AS NumCones
    FROM panel WHERE SEROTINY <> '' GROUP BY 1, 2, 3""",
)
def _(spark, sf):
    return rounded(summary.serotiny_counts(D.line_panel(spark, sf)))


@query(
    "site_coverage",
    PANEL
    + """SELECT AREA, SITEAREA, count(*) AS NumAlive, count(HT) AS NumMeasured, round(avg(HT), 6) AS MeanHeight,
    round(stddev_samp(HT), 6) AS SDHeight, round(count(HT) / count(*), 6) AS FracMeasured FROM panel
    WHERE CENSUS_NUM = 3 AND COHORT IN (1, 2) AND STAT = 1 GROUP BY 1, 2""",
)
def _(spark, sf):
    alive3 = cohorts.cohort_first_year(D.line_panel(spark, sf)).filter(F.col("alive3") == 1)
    return rounded(summary.site_coverage(alive3))
