import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohortframe.functions import columns as X
from cohortframe.operators import distribution as Q
from cohortframe.operators.reshape import surrogate_id

PROBS = [0.0, 0.05, 0.25, 1 / 3, 0.5, 0.9, 0.999, 1.0]


@pytest.fixture(scope="module")
def values(spark):
    rng = np.random.default_rng(1)
    n = 6000
    group = np.where(rng.random(n) < 0.6, "hot", rng.choice(["a", "b", "c"], n))
    value = np.where(rng.random(n) < 0.33, 7.0, np.exp(rng.normal(0, 2, n)))
    frame = pd.DataFrame({"g": group, "v": value})
    frame.loc[::97, "v"] = np.nan
    data = [(g, None if np.isnan(v) else float(v)) for g, v in frame.itertuples(index=False)]
    return frame, spark.createDataFrame(data, "g string, v double").cache()


def test_quantiles_are_exact_with_a_hot_group_and_a_hot_value(values):
    frame, df = values
    got = {(r["g"], r["prob"]): r["quantile"] for r in Q.exact_quantiles(df, ["g"], "v", PROBS).collect()}
    for g, part in frame.dropna().groupby("g"):
        np.testing.assert_allclose([got[g, p] for p in PROBS], np.quantile(part["v"], PROBS), rtol=1e-12)


def test_quantiles_without_group_and_with_null_group(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 2.0), ("x", 5.0)], "g string, v double")
    whole = {r["prob"]: r["quantile"] for r in Q.exact_quantiles(df, [], "v", [0.5, 1.0]).collect()}
    assert whole == {0.5: 2.0, 1.0: 5.0}
    grouped = {r["g"]: r["quantile"] for r in Q.exact_quantiles(df, ["g"], "v", [0.5]).collect()}
    assert grouped == {None: 1.5, "x": 5.0}


def test_weighted_quantiles_equal_repeated_rows(spark):
    df = spark.createDataFrame([(1.0, 3), (4.0, 1), (9.0, 2)], "v double, w long")
    got = [r["quantile"] for r in Q.exact_quantiles(df, [], "v", [0.25, 0.5, 0.8], weight="w").orderBy("prob").collect()]
    np.testing.assert_allclose(got, np.quantile([1, 1, 1, 4, 9, 9], [0.25, 0.5, 0.8]))


def test_cumulative_counts(values):
    frame, df = values
    got = Q.cumulative_counts(df, ["g"], "v").toPandas()
    for g, part in frame.dropna().groupby("g"):
        mine = got[got.g == g].sort_values("v")
        uniq, counts = np.unique(part["v"], return_counts=True)
        assert list(mine["cnt"]) == list(counts)
        assert list(mine["cum_before"]) == list(np.cumsum(counts) - counts)
        assert set(mine["n"]) == {len(part)}


def test_cut_index_is_right_closed_with_closed_first(spark):
    df = spark.createDataFrame([(0.9,), (1.0,), (2.0,), (2.1,), (8.0,), (8.1,), (None,)], "v double")
    got = [r[0] for r in df.select(X.cut_index("v", [1, 2, 8])).collect()]
    assert got == [None, 1, 1, 2, 2, None, None]


def test_average_rank_shares_ties(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 1.0), ("c", 2.0), ("d", 3.0), ("e", 3.0), ("f", 3.0)], "m string, v double")
    got = [r[0] for r in df.select(X.average_rank("v").alias("r"), "m").orderBy("m").select("r").collect()]
    assert got == [1.5, 1.5, 3.0, 5.0, 5.0, 5.0]


def test_boxplot_clips_before_the_quartiles(spark):
    df = spark.createDataFrame([("a", float(v)) for v in [*range(1, 12), 1000]], "g string, v double")
    row = Q.boxplot(df, "v", ["g"], clip_range=(0, 100)).first()
    assert (row["q1"], row["median"], row["q3"], row["n_outliers"]) == (3.5, 6.0, 8.5, 0)
    assert Q.boxplot(df, "v", ["g"]).first()["n_outliers"] == 1


def test_surrogate_id_is_dense_and_stable(spark):
    df = spark.range(5000).select(F.concat(F.lit("P-"), (F.col("id") % 7).cast("string")).alias("p"), F.col("id").alias("t"))
    first = surrogate_id(df, ["p", "t"])
    again = surrogate_id(df.repartition(13), ["p", "t"])
    assert sorted(r["IND_ID"] for r in first.collect()) == list(range(1, 5001))
    assert first.exceptAll(again).count() == 0


def test_interpolation_rounds_once(spark):
    rng = np.random.default_rng(3)
    rows = [(g, math.pi * k * (1 + j * 2.0**-52)) for g, k in enumerate(rng.integers(1, 8000, 200).tolist()) for j in range(4)]
    df = spark.createDataFrame(rows, "g int, v double")
    got = {(r.g, r.prob): r.quantile for r in Q.exact_quantiles(df, ["g"], "v", [0.25, 0.5, 0.7]).collect()}
    for (g, prob), quantile in got.items():
        values = sorted(v for k, v in rows if k == g)
        at = 3 * prob
        share = at - math.floor(at)
        assert quantile == math.fma(values[math.floor(at)], 1 - share, values[math.ceil(at)] * share)
