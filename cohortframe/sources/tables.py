"""Census panels derived from star-schema tables (``lineitem``, ``part``, ``events``, ...).

A fact table is first reduced to one row per (individual, census), which map-side combining
makes safe for hot keys: no task ever sees more than one row per key and census from each
input split, and an individual never exceeds the number of censuses afterwards. Only then is
the data partitioned by individual.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.columns import mask_size
from ..operators.status import resolve_status

LINE_CENSUSES = 14
EVENT_CENSUSES = 15
EVENT_START = "2024-01-01"
SINGLE_SITE_BRAND = 25


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fill_censuses(observed: DataFrame, last: int, value_cols: list[str]) -> DataFrame:
    """One row per individual and census 1..``last`` from one row per observed census.

    Every observed row also emits the unobserved censuses up to the next observed one (and the
    first one those before it), so the grid needs no cross join and no extra shuffle: the
    window that finds the neighbours already sits on the individual's partitioning.

    Rows whose census is null or outside 1..``last`` belong to no census of the panel and are left out;
    ``outside_censuses`` counts them.
    """
    observed = observed.filter(F.col("CENSUS_NUM").between(1, last))
    order = Window.partitionBy("IND_ID").orderBy("CENSUS_NUM")
    spell = (
        observed.withColumn("COHORT", F.first("CENSUS_NUM").over(order))
        .withColumn("__next", F.lead("CENSUS_NUM").over(order))
        .withColumn("__from", F.when(F.col("COHORT") == F.col("CENSUS_NUM"), 1).otherwise(F.col("CENSUS_NUM")))
        .withColumn("__to", F.coalesce(F.col("__next") - 1, F.lit(last)))
    )
    keep = [c for c in observed.columns if c not in ("CENSUS_NUM", *value_cols)]
    seen = F.col("__k") == F.col("CENSUS_NUM")
    return spell.withColumn("__k", F.explode(F.sequence("__from", "__to"))).select(
        *keep,
        F.col("COHORT").cast("int").alias("COHORT"),
        F.col("__k").cast("int").alias("CENSUS_NUM"),
        *[F.when(seen, F.col(c)).alias(c) for c in value_cols],
    )


def outside_censuses(observed: DataFrame, last: int) -> DataFrame:
    """``n_inside, n_outside, first_census, last_census``: what a panel of ``last`` censuses takes and leaves."""
    inside = F.coalesce(F.col("CENSUS_NUM").between(1, last), F.lit(False))
    return observed.agg(
        F.count_if(inside).alias("n_inside"),
        F.count_if(~inside).alias("n_outside"),
        F.min("CENSUS_NUM").alias("first_census"),
        F.max("CENSUS_NUM").alias("last_census"),
    )


def half_year_census(date: str) -> Column:
    months = (F.year(date) - 1995) * 12 + F.month(date) - 1
    return (F.lit(1) + F.floor(months / 6)).cast("int")


def half_year_start(census: str = "CENSUS_NUM") -> Column:
    c = F.col(census) - 1
    return F.make_date(
        (F.lit(1995) + F.floor(c / 2)).cast("int"), (F.lit(1) + 6 * (c % 2)).cast("int"), F.lit(1)
    )


def part_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Individual attributes: site, area and plot of every part."""
    brand = F.regexp_replace("p_brand", "[^0-9]", "").cast("int")
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("IND_ID"),
        F.col("p_brand").alias("SITEAREA"),
        F.when(brand == SINGLE_SITE_BRAND, "A3")
        .otherwise(F.concat(F.lit("A"), (brand % 3).cast("string")))
        .alias("AREA"),
        F.concat(F.col("p_brand"), F.lit("-"), (F.col("p_size") % 5).cast("string")).alias("PLOTCODE"),
    )


def plot_information(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plot dimension: areas, treatment and counts of cones and live tops after the fire."""
    sub = F.col("p_size") % 5
    brand = F.regexp_replace("p_brand", "[^0-9]", "").cast("int")
    return (
        table(spark, sf_dir, "part")
        .groupBy(
            F.concat(F.col("p_brand"), F.lit("-"), sub.cast("string")).alias("OLDCODE"),
            F.when(sub == 0, 4.0).otherwise(10.0).alias("SDLAREA"),
            F.when((sub == 4) & (brand % 5 == 0), "BURN").otherwise("NONE").alias("TMT"),
        )
        .agg(
            (F.avg("p_size") * 4).alias("PLTAREA"),
            F.sum((F.col("p_size") > 25).cast("int")).cast("double").alias("CONES1"),
            F.sum((F.col("p_size") > 40).cast("int")).cast("double").alias("TOPALIV1"),
        )
    )


def line_censuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw census rows of every part with at least one line, gaps included."""
    per_census = (
        table(spark, sf_dir, "lineitem")
        .select(
            F.col("l_partkey").alias("IND_ID"),
            half_year_census("l_shipdate").alias("CENSUS_NUM"),
            "l_quantity",
            "l_extendedprice",
            "l_discount",
            "l_tax",
            "l_returnflag",
        )
        .groupBy("IND_ID", "CENSUS_NUM")
        .agg(
            F.count(F.lit(1)).alias("N_OBS"),
            F.sum((F.col("l_returnflag") == "R").cast("int")).alias("N_R"),
            F.sum((F.col("l_returnflag") == "A").cast("int")).alias("N_A"),
            F.sum("l_quantity").alias("__size"),
            (F.sum(F.round(F.col("l_extendedprice") * 100).cast("bigint")) / F.count(F.lit(1)) / 100_000).alias(
                "DAH_RAW"
            ),
            (F.avg("l_discount") * 1000).alias("WD1_RAW"),
            (F.avg("l_tax") * 1000).alias("WD2_RAW"),
        )
        .join(part_sites(spark, sf_dir), "IND_ID")
    )
    to_date = Window.partitionBy("IND_ID").orderBy("CENSUS_NUM").rowsBetween(Window.unboundedPreceding, 0)
    observed = per_census.withColumn("HT_RAW", F.lit(10.0) + F.sum("__size").over(to_date)).drop("__size")
    values = ["N_OBS", "N_R", "N_A", "HT_RAW", "DAH_RAW", "WD1_RAW", "WD2_RAW"]
    filled = fill_censuses(observed, LINE_CENSUSES, values)
    n, all_r = F.col("N_OBS"), F.col("N_R") == F.col("N_OBS")
    return filled.withColumn(
        "STAT_RAW",
        F.when(F.col("CENSUS_NUM") < F.col("COHORT"), F.lit(None))
        .when(n.isNull(), 2)
        .when((n >= 3) & all_r, 1)
        .when((n == 2) & all_r, 2)
        .otherwise(0)
        .cast("int"),
    )


def line_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long panel of parts over half-year censuses (the default panel of the queries)."""
    return resolve_status(line_censuses(spark, sf_dir)).select(
        "IND_ID",
        "PLOTCODE",
        "SITEAREA",
        "AREA",
        "COHORT",
        "CENSUS_NUM",
        half_year_start().alias("START_DATE"),
        "STAT",
        mask_size("HT_RAW", "STAT").alias("HT"),
        mask_size("DAH_RAW", "STAT").alias("DAH"),
        F.nullif(mask_size("WD1_RAW", "STAT"), F.lit(0.0)).alias("WD1"),
        F.nullif(mask_size("WD2_RAW", "STAT"), F.lit(0.0)).alias("WD2"),
        mask_size("N_R", "STAT").cast("double").alias("CONE_New"),
        mask_size(F.coalesce(F.col("N_A"), F.lit(0)), "STAT").cast("double").alias("CONE_Mature"),
        serotiny_class().alias("SEROTINY"),
    )


def serotiny_class() -> Column:
    """Cone-opening class of the last two censuses, from the counts of the census."""
    seen = F.col("N_A") % 4
    return F.when(
        (F.col("CENSUS_NUM") >= LINE_CENSUSES - 1) & (F.col("STAT") == 1) & F.col("N_A").isNotNull(),
        F.when(seen == 0, "").when(seen == 1, "S").when(seen == 2, "O").otherwise("SO"),
    )


def dirty_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw census as a field workbook would hold it: one row per part, text readings.

    Known spelling errors, censored heights, odd status codes and millimetre columns are planted
    by fixed rules on the key. The pivot lists its censuses, and the rows of a part already
    share a partition, so it adds no exchange.
    """
    census, key = F.col("CENSUS_NUM"), F.col("IND_ID")

    def at(k: int, value) -> Column:
        return F.max(F.when(census == k, value))

    def text(name: str) -> Column:
        return F.col(name).cast("bigint").cast("string")

    last = LINE_CENSUSES
    out = [at(k, F.col("STAT_RAW").cast("string")).alias(f"STAT{k}") for k in range(1, last)]
    odd = F.when(key % 3 == 0, "?").when(key % 3 == 1, "3").otherwise("2")
    last_code = F.when(F.col("STAT_RAW") == 2, odd).otherwise(F.col("STAT_RAW").cast("string"))
    out.append(at(last, last_code).alias(f"STAT{last}"))
    for k in range(1, last + 1):
        height = text("HT_RAW")
        if k == 12:
            height = F.when(key % 97 == 0, "28..4").otherwise(height)
        if k == last:
            height = F.when(key % 89 == 0, ">450").when(key % 89 == 1, ">490").otherwise(height)
        out.append(at(k, F.when(F.col("HT_RAW").isNotNull(), height)).alias(f"HTB{k}"))
    out.append(at(last, F.col("HT_RAW") + 1).alias(f"{last}W/subs"))
    out.append(at(9, F.col("HT_RAW") - 2).alias("HTN9"))
    out += [at(k, F.col("DAH_RAW") * 10).alias(f"DIAM{k}") for k in range(1, 8)]
    out += [at(k, F.col("DAH_RAW")).alias(f"DAH{k}") for k in range(8, last)]
    slashed = F.when(key % 83 == 0, "1.36/ 1.72").otherwise(F.col("DAH_RAW").cast("string"))
    out.append(at(last, F.when(F.col("DAH_RAW").isNotNull(), slashed)).alias(f"DAH{last}"))
    for axis in ("WD1", "WD2"):
        out += [
            at(k, F.col(f"{axis}_RAW") * (10 if k == 12 else 1)).alias(f"{axis}_{k}") for k in range(11, last + 1)
        ]
    out += [at(k, F.col("N_A").cast("double")).alias(f"CONE{k}_>1YR") for k in (12, 13)]
    out.append(at(last, F.nullif(F.col("N_A"), F.lit(0)).cast("double")).alias(f"CONE{last}_GOLD"))
    out.append(at(last, F.nullif(F.col("N_R"), F.lit(0)).cast("double")).alias(f"CONE{last}_GRAY"))
    out += [
        at(12, F.col("N_R").cast("string")).alias("CONE12_BABY"),
        at(13, F.col("N_R").cast("double")).alias("CONE13_NEW"),
        at(last, F.col("N_R").cast("double")).alias(f"CONE{last}"),
    ]
    spelled = F.element_at(
        F.array(*[F.lit(x) for x in ("s", "n", "ns", "non-serot", "S", "O", "6")]), (F.col("N_OBS") % 7 + 1).cast("int")
    )
    out += [at(k, spelled).alias(f"SEROTINY{k}") for k in (last - 1, last)]
    return (
        line_censuses(spark, sf_dir)
        .groupBy("IND_ID", "PLOTCODE", "COHORT")
        .agg(*out)
        .withColumn("PLOTCODE", F.when(key % 211 != 0, F.col("PLOTCODE")))
        .withColumn("COHORT", F.when(key % 223 != 0, F.col("COHORT")))
        .withColumn("TAG", F.concat(F.lit("T"), key.cast("string")))
        .withColumn("Cohort_1", (F.col("COHORT") == 1).cast("int"))
        .withColumn("NOTES1", F.lit(None).cast("string"))
        .drop("IND_ID")
    )


def event_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long panel of users over two-day censuses; area and site are region and nation."""
    per_census = (
        table(spark, sf_dir, "events")
        .select(
            F.col("user_id").alias("IND_ID"),
            (F.lit(1) + F.floor(F.datediff("ts", F.lit(EVENT_START).cast("date")) / 2)).cast("int").alias("CENSUS_NUM"),
            "event_type",
            "value",
        )
        .groupBy("IND_ID", "CENSUS_NUM")
        .agg(
            F.count(F.lit(1)).alias("N_OBS"),
            F.sum((F.col("event_type") == "error").cast("int")).alias("N_E"),
            F.sum("value").alias("__size"),
        )
    )
    nation = table(spark, sf_dir, "nation").join(
        table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    )
    place = (
        table(spark, sf_dir, "customer")
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left")
        .select(F.col("c_custkey").alias("IND_ID"), F.col("r_name").alias("AREA"), F.col("n_name").alias("SITEAREA"))
    )
    to_date = Window.partitionBy("IND_ID").orderBy("CENSUS_NUM").rowsBetween(Window.unboundedPreceding, 0)
    observed = (
        per_census.join(place, "IND_ID", "left")
        .withColumn("HT_RAW", F.sum("__size").over(to_date))
        .drop("__size")
    )
    n, e = F.col("N_OBS"), F.col("N_E")
    coded = fill_censuses(observed, EVENT_CENSUSES, ["N_OBS", "N_E", "HT_RAW"]).withColumn(
        "STAT_RAW",
        F.when(n.isNull(), 2).when((n >= 3) & (4 * e >= 3 * n), 1).when(2 * e > n, 2).otherwise(0).cast("int"),
    )
    return resolve_status(coded).select(
        "IND_ID",
        "SITEAREA",
        "AREA",
        "COHORT",
        "CENSUS_NUM",
        F.date_add(F.lit(EVENT_START).cast("date"), 2 * (F.col("CENSUS_NUM") - 1)).alias("START_DATE"),
        "STAT",
        mask_size("HT_RAW", "STAT").alias("HT"),
    )
