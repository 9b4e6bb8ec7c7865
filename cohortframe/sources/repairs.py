"""Repair of known bad strings, followed by a tolerant cast with a quarantine of the rest."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

# Fixed values: (column, raw text, value) of readings known to be mistyped.
KNOWN_REPAIRS = (
    ("DAH15", "1.36/ 1.72", 0.79),
    ("DBH15", "6.2, 2.9, 2.1", 6.2),
    ("HTB12", "28..4", 28.4),
)

# Height readings beyond the measuring pole.
CENSORED_HEIGHTS = (">450", ">490")

# Status codes read as missing.
MISSING_STATUS_TEXT = {"3": "2", "?": "2"}

# Serotiny spellings and their standard code, per column; None removes the reading.
SEROTINY_SPELLINGS = {"non-serot": "O", "ns": "O", "n": "O", "s": "S"}
SEROTINY_INVALID = {"6": None}
SEROTINY_CODES = {"SEROTINY14": SEROTINY_SPELLINGS, "SEROTINY15": SEROTINY_INVALID}


def repaired_number(column: str, repairs: Sequence[tuple[str, str, float]] = KNOWN_REPAIRS) -> Column:
    """The repaired value where the text is listed for this column, else a tolerant cast."""
    text = F.col(f"`{column}`")
    out = None
    for name, raw, value in repairs:
        if name == column:
            condition, target = text == raw, F.lit(float(value))
            out = F.when(condition, target) if out is None else out.when(condition, target)
    cast = text.try_cast("double")
    return cast if out is None else out.otherwise(cast)


def repair_numbers(
    df: DataFrame, columns: Sequence[str], repairs: Sequence[tuple[str, str, float]] = KNOWN_REPAIRS
) -> DataFrame:
    return df.withColumns({c: repaired_number(c, repairs) for c in columns})


def quarantine(
    df: DataFrame,
    columns: Sequence[str],
    repairs: Sequence[tuple[str, str, float]] = KNOWN_REPAIRS,
) -> DataFrame:
    """Values that stay unreadable after repair, with how often each occurs."""
    cells = F.array(
        *[
            F.struct(
                F.lit(c).alias("column"),
                F.col(f"`{c}`").cast("string").alias("raw"),
                repaired_number(c, repairs).alias("value"),
            )
            for c in columns
        ]
    )
    return (
        df.select(F.explode(cells).alias("cell"))
        .filter(F.col("cell.raw").isNotNull() & F.col("cell.value").isNull())
        .groupBy(F.col("cell.column").alias("column"), F.col("cell.raw").alias("raw"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
