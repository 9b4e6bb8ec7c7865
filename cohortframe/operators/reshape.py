"""Wide to long and back, grids, and surrogate keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from .clean import measures

#: Rows of an axis that a grid attaches to every unit as one array.
MAX_AXIS = 100_000


def wide_to_long(df: DataFrame, id_cols: Sequence[str], measure_names: Sequence[str]) -> DataFrame:
    """One row per individual and census from ``MEASURE__census`` families; no shuffle.

    A measure without a column for some census is a typed NULL there.
    """
    families = {m: measures(df, m) for m in measure_names}
    families = {m: f for m, f in families.items() if f}
    types = {m: df.schema[next(iter(f.values()))].dataType for m, f in families.items()}
    censuses = sorted({c for f in families.values() for c in f})
    cells = F.array(
        *[
            F.struct(
                F.lit(census).alias("CENSUS_NUM"),
                *[
                    (F.col(f[census]) if census in f else F.lit(None)).cast(types[m]).alias(m)
                    for m, f in families.items()
                ],
            )
            for census in censuses
        ]
    )
    return df.select(*id_cols, F.explode(cells).alias("__cell")).select(*id_cols, "__cell.*")


def long_to_wide(
    panel: DataFrame, id_cols: Sequence[str], measure_names: Sequence[str], censuses: Sequence[int]
) -> DataFrame:
    """Per-individual columns ``MEASURE_census`` with explicit pivot values."""
    picked = [
        F.first(F.when(F.col("CENSUS_NUM") == c, F.col(m)), ignorenulls=True).alias(f"{m}_{c}")
        for m in measure_names
        for c in censuses
    ]
    return panel.filter(F.col("CENSUS_NUM").isin(list(censuses))).groupBy(*id_cols).agg(*picked)


def to_display(df: DataFrame, id_cols: Sequence[str], value_cols: Sequence[str]) -> DataFrame:
    return df.unpivot(list(id_cols), list(value_cols), "name", "value")


def census_dates_long(sheet: DataFrame, label_col: str, label: str = "Start on") -> DataFrame:
    """One row per census column of the labelled sheet row, numbered by column order."""
    dates = [c for c in sheet.columns if c != label_col]
    cells = F.array(
        *[
            F.struct(F.lit(i + 1).alias("CENSUS_NUM"), F.to_date(F.col(f"`{c}`")).alias("START_DATE"))
            for i, c in enumerate(dates)
        ]
    )
    return (
        sheet.filter(F.col(f"`{label_col}`") == label)
        .select(F.explode(cells).alias("d"))
        .select("d.*", F.month("d.START_DATE").alias("CENSUS_MONTH"), F.year("d.START_DATE").alias("CENSUS_YEAR"))
    )


def zero_filled_grid(units: DataFrame, axis: DataFrame, counts: DataFrame, on: Sequence[str], value: str) -> DataFrame:
    """Every unit x axis combination, with 0 where nothing was counted.

    ``axis`` is attached as an array of its few rows, so that the grid is a narrow explode of
    the units instead of a product of two tables. An axis of more than ``MAX_AXIS`` rows fails the query, and
    no more than one row above that is ever collected.
    """
    packed = axis.limit(MAX_AXIS + 1).agg(F.collect_list(F.struct(*axis.columns)).alias("__axis"))
    too_long = F.raise_error(F.lit(f"the axis of a grid has more than {MAX_AXIS} rows")).cast("boolean")
    packed = packed.where(F.when(F.size("__axis") <= MAX_AXIS, F.lit(True)).otherwise(too_long))
    return (
        units.join(F.broadcast(packed))
        .withColumn("__a", F.explode("__axis"))
        .select(*units.columns, "__a.*")
        .join(counts, list(on), "left")
        .withColumn(value, F.coalesce(F.col(value), F.lit(0)))
    )


def prediction_grid(
    panel: DataFrame,
    value: str,
    levels: str,
    points: int = 1000,
    held: Sequence = (),
) -> DataFrame:
    """``points`` equally spaced values over the observed range, for every level.

    ``held`` are aggregates of the panel carried along as constants. One aggregate by level
    gives levels, range and constants; the grid itself is a narrow explode.
    """
    held = list(held)
    stats = panel.agg(
        F.min(value).alias("__lo"),
        F.max(value).alias("__hi"),
        F.collect_set(levels).alias("__levels"),
        *held,
    )
    kept = [c for c in stats.columns if not c.startswith("__")]
    return stats.select(
        *kept, "__lo", "__hi", F.explode("__levels").alias(levels)
    ).select(
        *kept, levels, "__lo", "__hi", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("__i")
    ).select(
        (F.col("__lo") + (F.col("__hi") - F.col("__lo")) * F.col("__i") / (points - 1)).alias(value),
        levels,
        *kept,
    )


def surrogate_id(df: DataFrame, keys: Sequence[str], out: str = "IND_ID", hex_digits: int = 3) -> DataFrame:
    """Dense 1-based id that depends on the key values only, without a global sort.

    Rows fall into ``16**hex_digits`` hash buckets of near-equal size; a row's id is its rank in
    the bucket plus the size of all earlier buckets. The table of bucket sizes has a fixed
    number of rows, which is what makes it safe to broadcast and to window in one task.
    """
    key_text = F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys])
    bucketed = df.withColumn("__b", F.substring(F.md5(key_text), 1, hex_digits))
    before = Window.partitionBy(F.lit(0)).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        bucketed.groupBy("__b")
        .agg(F.count(F.lit(1)).alias("__n"))
        .select("__b", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"))
    )
    inside = Window.partitionBy("__b").orderBy(*keys)
    return (
        bucketed.withColumn("__r", F.row_number().over(inside))
        .join(F.broadcast(offsets), "__b")
        .withColumn(out, F.col("__offset") + F.col("__r"))
        .drop("__b", "__r", "__offset")
    )
