"""Exact order statistics, bins, histograms and box plots at any group size.

Spark's ``percentile`` keeps every distinct value of a group in the memory of one task. Here a
group is first reduced to (value, count) pairs, which absorbs ties on the map side, then cut at
sketch quantiles into buckets of bounded size. Bucket totals give each bucket the number of
values below it; only inside a bucket are values sorted. The sketch decides where buckets
start, never what is returned, so the result is exact however rough the sketch is.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

SPLIT_BITS = 10
SALTS = 16


def _bisect(value: Column, splits: str, out: str, df: DataFrame) -> DataFrame:
    """Number of split points strictly below ``value``, by unrolled binary search."""
    pos = F.lit(0)
    df = df.withColumn(out, pos)
    for bit in reversed(range(SPLIT_BITS)):
        step = 1 << bit
        probe = F.get(F.col(splits), F.col(out) + (step - 1))
        df = df.withColumn(out, F.col(out) + F.when(probe < value, step).otherwise(0))
    return df


def _same_group(keys: Sequence[str]) -> list[str]:
    return [f"__g{i}" for i in range(len(keys))]


def bucketed_counts(
    df: DataFrame, keys: Sequence[str], value: str, weight: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """Distinct values with count and bucket, and the table of buckets.

    The first frame is ``keys, value, __cnt, __bucket``; the second, with at most
    ``2**SPLIT_BITS`` rows per group, ``keys, __bucket, __total, __before, __n`` where
    ``__before`` counts the group's values in earlier buckets. NULL values are skipped. With
    ``weight`` a row stands for that many equal values.
    """
    keys = list(keys)
    n_splits = (1 << SPLIT_BITS) - 1
    probs = ", ".join(f"{(i + 1) / (n_splits + 1)!r}D" for i in range(n_splits))
    counted = (
        df.filter(F.col(value).isNotNull())
        .select(*keys, F.col(value).cast("double").alias(value), *([weight] if weight else []))
        .groupBy(*keys, value)
        .agg((F.sum(weight) if weight else F.count(F.lit(1))).alias("__cnt"))
    )
    splits = counted.groupBy(*keys).agg(
        F.expr(f"percentile_approx(`{value}`, array({probs}), 5000)").alias("__splits")
    )
    located = _bisect(
        F.col(value), "__splits", "__bucket", _join_groups(counted, splits, keys, spread=value)
    ).drop("__splits")
    group = Window.partitionBy(*keys)
    earlier = group.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = (
        located.groupBy(*keys, "__bucket")
        .agg(F.sum("__cnt").alias("__total"))
        .withColumn("__before", F.coalesce(F.sum("__total").over(earlier), F.lit(0)))
        .withColumn("__n", F.sum("__total").over(group))
    )
    return located, buckets


def _join_groups(
    left: DataFrame, right: DataFrame, keys: Sequence[str], spread: str | None = None
) -> DataFrame:
    """Join per-group facts (``right``, one row per group) back to the rows of the groups.

    The strategy is left to the planner and AQE, which broadcast ``right`` when its measured size
    allows. Otherwise a group holding a large share of the rows would land in one task: ``spread``
    names a column whose hash (a power of two of salts, never NULL) splits every group over ``SALTS`` tasks.
    """
    if not keys:
        return left.crossJoin(F.broadcast(right))  # right is one row: an aggregate without keys
    names = _same_group(keys)
    renamed = right.withColumnsRenamed(dict(zip(keys, names)))
    condition = F.lit(True)
    if spread is not None:
        left = left.withColumn("__salt", F.xxhash64(spread).bitwiseAND(F.lit(SALTS - 1)).cast("int"))
        renamed = renamed.withColumn("__rsalt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        condition = F.col("__salt") == F.col("__rsalt")
    for key, name in zip(keys, names):
        condition = condition & left[key].eqNullSafe(renamed[name])
    return left.join(renamed, condition).drop(*names, "__salt", "__rsalt")


def _running_count(keys: Sequence[str], value: str) -> Column:
    """Values of the group strictly below this one, from the bucket's offset on."""
    inside = Window.partitionBy(*keys, "__bucket").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    return F.col("__before") + F.coalesce(F.sum("__cnt").over(inside), F.lit(0))


def cumulative_counts(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Distinct values with ``cnt``, ``cum_before`` (values strictly below) and group size ``n``."""
    located, buckets = bucketed_counts(df, keys, value)
    return _join_groups(located, buckets, [*keys, "__bucket"]).select(
        *keys,
        value,
        F.col("__cnt").alias("cnt"),
        _running_count(keys, value).alias("cum_before"),
        F.col("__n").alias("n"),
    )


def _halves(x: Column) -> tuple[Column, Column]:
    """A double as the sum of two of 26 bits, whose products are exact."""
    big = x * F.lit(134217729.0)
    high = big - (big - x)
    return high, x - high


def _fused(a: Column, b: Column, c: Column) -> Column:
    """``a * b + c`` rounded once, as a fused multiply-add does; what the roundings of product and sum lose is added back.

    SQL engines interpolate this way, and on values that lie on a lattice the last bit of a quartile decides whether a
    value on a fence is an outlier.
    """
    (ah, al), (bh, bl) = _halves(a), _halves(b)
    product = a * b
    total = product + c
    lost = ((ah * bh - product) + ah * bl + al * bh) + al * bl
    back = total - product
    lost = lost + ((product - (total - back)) + (c - back))
    return F.when(F.isnan(lost), total).otherwise(total + lost)  # infinite or beyond splitting


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float], weight: str | None = None
) -> DataFrame:
    """Type-7 (linear interpolation) quantiles: ``keys, prob, quantile``, one row per prob.

    Only the buckets that contain a wanted rank are sorted.
    """
    keys = list(keys)
    located, buckets = bucketed_counts(df, keys, value, weight)
    n = F.col("__n")
    lows = [F.floor((n - 1) * F.lit(float(p))) for p in probs]
    wanted = F.array(*[x for lo in lows for x in (lo, F.least(lo + 1, n - 1))])
    first, last = F.col("__before"), F.col("__before") + F.col("__total")
    hit = buckets.filter(F.exists(wanted, lambda k: (k >= first) & (k < last)))
    ranked = _join_groups(located, hit, [*keys, "__bucket"]).withColumn("__start", _running_count(keys, value))
    end = F.col("__start") + F.col("__cnt")

    def at(k: Column) -> Column:
        return F.max(F.when((F.col("__start") <= k) & (k < end), F.col(value)))

    picked = ranked.groupBy(*keys).agg(
        F.first("__n").alias("__n"),
        *[at(lo).alias(f"__lo{i}") for i, lo in enumerate(lows)],
        *[at(F.least(lo + 1, n - 1)).alias(f"__hi{i}") for i, lo in enumerate(lows)],
    )
    cells = []
    for i, p in enumerate(probs):
        h = (F.col("__n") - 1) * F.lit(float(p))
        lo, hi = F.col(f"__lo{i}"), F.col(f"__hi{i}")
        share = h - F.floor(h)
        between = F.when(share == 0, lo).otherwise(_fused(lo, 1 - share, hi * share))
        cells.append(F.struct(F.lit(float(p)).alias("prob"), between.alias("quantile")))
    return picked.select(*keys, F.explode(F.array(*cells)).alias("__q")).select(*keys, "__q.*")


def quantile_columns(
    df: DataFrame, keys: Sequence[str], value: str, named_probs: dict[str, float]
) -> DataFrame:
    """Quantiles as named columns."""
    long = exact_quantiles(df, keys, value, list(named_probs.values()))
    return long.groupBy(*keys).agg(
        *[F.max(F.when(F.col("prob") == float(p), F.col("quantile"))).alias(name) for name, p in named_probs.items()]
    )


def medians(df: DataFrame, measure_names: Sequence[str], keys: Sequence[str] = ("CENSUS_NUM",)) -> DataFrame:
    """Median of several measures per group, as ``keys, measure, median``."""
    long = df.unpivot(list(keys), list(measure_names), "measure", "value")
    return exact_quantiles(long, [*keys, "measure"], "value", [0.5]).select(
        *keys, "measure", F.col("quantile").alias("median")
    )


def quantile_bins(df: DataFrame, value: str, steps: int = 20, out: str = "bin") -> tuple[DataFrame, list[float]]:
    """Equal-count bins ``(b[i], b[i+1]]`` with breaks at every ``1/steps`` quantile.

    The ``steps + 1`` breaks are read by the driver; they then are constants of the plan.
    """
    from ..functions.columns import cut_index

    probs = [i / steps for i in range(steps + 1)]
    rows = exact_quantiles(df, [], value, probs).orderBy("prob").collect()
    breaks = [r["quantile"] for r in rows]
    return df.withColumn(out, cut_index(value, breaks)), breaks


def bin_by_breaks(df: DataFrame, value: str, breaks: DataFrame, out: str = "bin") -> DataFrame:
    """Bin by a one-row table holding the ascending array ``breaks``; fully lazy."""
    v = F.col(value)
    joined = df.crossJoin(F.broadcast(breaks))
    below = F.aggregate("breaks", F.lit(0), lambda acc, b: acc + F.when(v > b, 1).otherwise(0))
    inside = (v >= F.get("breaks", F.lit(0))) & (v <= F.element_at("breaks", -1))
    return joined.withColumn(out, F.when(inside, F.greatest(below, F.lit(1))).cast("int"))


def break_table(df: DataFrame, value: str, steps: int) -> DataFrame:
    """One row, one array: the breaks of ``steps`` equal-count bins."""
    probs = [i / steps for i in range(steps + 1)]
    return exact_quantiles(df, [], value, probs).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("prob", "quantile"))), lambda s: s["quantile"]).alias("breaks")
    )


def histogram(df: DataFrame, value: str, keys: Sequence[str] = (), bins: int = 30) -> DataFrame:
    """Counts and density per group over ``bins`` equal-width bins of the whole range."""
    keys = list(keys)
    known = df.filter(F.col(value).isNotNull())
    limits = known.agg(F.min(value).alias("__lo"), F.max(value).alias("__hi"))
    width = (F.col("__hi") - F.col("__lo")) / bins
    index = F.least(F.floor((F.col(value) - F.col("__lo")) / width), F.lit(bins - 1)).cast("int")
    counted = (
        known.crossJoin(F.broadcast(limits))
        .groupBy(*keys, F.coalesce(index, F.lit(0)).alias("bin"))
        .agg(F.count(F.lit(1)).alias("count"), F.first(width).alias("__width"), F.first("__lo").alias("__lo"))
    )
    group = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    return counted.select(
        *keys,
        "bin",
        (F.col("__lo") + F.col("bin") * F.col("__width")).alias("lower"),
        "count",
        F.try_divide(F.col("count"), F.sum("count").over(group) * F.col("__width")).alias("density"),
    )


def boxplot(
    df: DataFrame,
    value: str,
    keys: Sequence[str],
    clip_range: tuple[float, float] | None = None,
    whisker: float = 1.5,
) -> DataFrame:
    """Quartiles, whisker ends and number of outliers per group.

    ``clip_range`` removes values outside it before the quartiles are taken.
    """
    keys = list(keys)
    if clip_range is not None:
        df = df.filter(F.col(value).between(*clip_range))
    known = df.filter(F.col(value).isNotNull())
    quartiles = quantile_columns(known, keys, value, {"q1": 0.25, "median": 0.5, "q3": 0.75})
    reach = whisker * (F.col("q3") - F.col("q1"))
    v = F.col(value)
    inside = (v >= F.col("q1") - reach) & (v <= F.col("q3") + reach)
    return (
        _join_groups(known.select(*keys, value), quartiles, keys, spread=value)
        .groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.first("q1").alias("q1"),
            F.first("median").alias("median"),
            F.first("q3").alias("q3"),
            F.min(F.when(inside, v)).alias("whisker_low"),
            F.max(F.when(inside, v)).alias("whisker_high"),
            F.count_if(~inside).alias("n_outliers"),
        )
    )
