"""Cleaning of the wide census table: names, codes, units, masks, audits.

Every step is a narrow projection over whole column families, so the cleaned table costs one
scan; audits are a single aggregate.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import columns as X

SEPARATOR = "__"


def drop_null_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.filter(_all_present(keys))


def null_key_counts(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows in, rows lost to each key in turn, rows kept: one pass, one row."""
    aggs, earlier = [F.count(F.lit(1)).alias("rows_in")], F.lit(True)
    for key in keys:
        aggs.append(F.count_if(earlier & F.col(key).isNull()).alias(f"removed_{key}"))
        earlier = earlier & F.col(key).isNotNull()
    return df.agg(*aggs, F.count_if(earlier).alias("rows_kept"))


def _all_present(keys: Iterable[str]) -> Column:
    condition = F.lit(True)
    for key in keys:
        condition = condition & F.col(key).isNotNull()
    return condition


def columns_matching(df: DataFrame, pattern: str) -> list[str]:
    """Names matching an anchored, case-sensitive pattern."""
    return [c for c in df.columns if re.fullmatch(pattern, c)]


def drop_matching(df: DataFrame, pattern: str) -> DataFrame:
    """Drop columns whose name contains a match of ``pattern`` anywhere."""
    return df.drop(*[c for c in df.columns if re.search(pattern, c)])


def keep_range(df: DataFrame, first: str, last: str, extra: Sequence[str] = ()) -> DataFrame:
    """Columns ``first`` .. ``last`` in table order, followed by ``extra``."""
    names = df.columns
    span = names[names.index(first) : names.index(last) + 1]
    return df.select(*[F.col(f"`{c}`") for c in [*span, *[e for e in extra if e not in span]]])


def rename_by_rules(df: DataFrame, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """Rename by the first rule whose anchored pattern matches: ``("HTB([0-9]+)", r"HT__\\1")``."""
    mapping = {}
    for name in df.columns:
        for pattern, target in rules:
            match = re.fullmatch(pattern, name)
            if match:
                mapping[name] = match.expand(target)
                break
    return df.withColumnsRenamed(mapping)


def measures(df: DataFrame, measure: str) -> dict[int, str]:
    """Census number -> column of one ``MEASURE__census`` family, in census order."""
    found = {}
    for name in df.columns:
        match = re.fullmatch(re.escape(measure) + SEPARATOR + r"([0-9]+)", name)
        if match:
            found[int(match.group(1))] = name
    return dict(sorted(found.items()))


def scale_columns(df: DataFrame, columns: Sequence[str], divisor: float) -> DataFrame:
    return df.withColumns({c: F.col(f"`{c}`") / F.lit(divisor) for c in columns})


def mask_sizes(df: DataFrame, measure_names: Sequence[str]) -> DataFrame:
    """Sizes survive only where the status of the same census is known alive."""
    return df.withColumns(
        {
            col: X.mask_size(col, f"STAT{SEPARATOR}{census}")
            for m in measure_names
            for census, col in measures(df, m).items()
            if f"STAT{SEPARATOR}{census}" in df.columns
        }
    )


def clean_counts(
    df: DataFrame, measure: str, mask_censuses: Sequence[int], fill_censuses: Sequence[int]
) -> DataFrame:
    """Blank counts of dead individuals, then write 0 for alive ones without a record."""
    out = {}
    for census, col in measures(df, measure).items():
        stat, value = f"STAT{SEPARATOR}{census}", F.col(col)
        if census in mask_censuses:
            value = X.mask_count(value, stat)
        if census in fill_censuses:
            value = X.fill_alive_zero(value, stat)
        out[col] = value
    return df.withColumns(out)


def zero_to_null(df: DataFrame, measure_names: Sequence[str]) -> DataFrame:
    return df.withColumns(
        {col: F.nullif(F.col(col), F.lit(0.0)) for m in measure_names for col in measures(df, m).values()}
    )


def replace_censored(df: DataFrame, raw: str, corrected: str, censored: Sequence[str], out: str) -> DataFrame:
    """Use the corrected column, blanked where the raw reading was censored; flag those rows."""
    hit = F.coalesce(F.col(f"`{raw}`").isin(list(censored)), F.lit(False))
    value, flag = F.when(~hit, F.col(f"`{corrected}`")), hit.cast("int")
    return (
        df.withColumns({"__value": value, f"{out}_censored": flag})
        .drop(raw, corrected)
        .withColumnRenamed("__value", out)
    )


def shrink_flag(
    panel: DataFrame,
    measure: str,
    tolerance: float,
    censuses: Sequence[int],
    id_col: str = "IND_ID",
    order_col: str = "CENSUS_NUM",
) -> DataFrame:
    """Individuals whose measure falls by more than ``tolerance`` between neighbouring censuses.

    Neighbours are neighbours in the measure's own census list; a missing value is not bridged.
    """
    order = Window.partitionBy(id_col).orderBy(order_col)
    fall = F.col(measure) - F.lag(measure).over(order) < -tolerance
    return (
        panel.filter(F.col(order_col).isin(list(censuses)))
        .select(id_col, fall.alias("__fall"))
        .groupBy(id_col)
        .agg(F.coalesce(F.max(F.col("__fall").cast("int")), F.lit(0)).alias("shrunk"))
    )


def audit_rules(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """Count the rows breaking each rule, all rules in one pass: ``rule, violations``."""
    names = list(rules)
    counted = df.agg(*[F.count_if(rules[n]).alias(n) for n in names])
    return counted.unpivot([], names, "rule", "violations")


def standard_rules(size_cols: Sequence[str], count_cols: Sequence[str], numeric_text: Sequence[str] = ()) -> dict:
    """The inline checks of a cleaned panel as countable rules."""
    dead = F.col("STAT") == 0
    rules = {f"dead_with_{c}": dead & F.col(c).isNotNull() for c in (*size_cols, *count_cols)}
    rules |= {f"zero_{c}": F.col(c) == 0 for c in size_cols}
    rules |= {f"alive_without_{c}": (F.col("STAT") == 1) & F.col(c).isNull() for c in count_cols}
    rules |= {
        f"not_numeric_{c}": F.col(c).isNotNull() & F.col(c).try_cast("double").isNull() for c in numeric_text
    }
    return rules
