"""Importance resampling towards a target, ranked by a distributed radix sort.

Features are all runs of one and two words, hashed into ``BUCKETS`` buckets. A bucket's gain is a thousand times
the logarithm of its smoothed rate in the target over its rate in the documents; the gains are one array of fixed
size, and a document's weight is the floored mean of the gains that its features point at. Gumbel noise from
a seeded hash of doc_id is added, so the highest scores are a draw without replacement.

The order comes from a least-significant-digit radix sort: each pass is a stable counting sort on one digit of the
composite key. Rows stand in blocks of consecutive places; a pass counts (digit, block), turns the counts into global
prefix offsets, and a row's new place is its offset plus its number among the rows of its digit and block. Digits that
are the same in all rows are left out. A digit that most rows share is split by block like any other, the
number of blocks is bounded by ``BLOCKS``, and a pass shuffles three numbers a row. After the last pass places are ranks.

Null and empty texts have no features: weight 0, and never drawn. Rows that repeat a doc_id are scored and
ranked each, in the order in which they are read; rows without one hash as the empty id and come last among
equal scores. An empty table gives no rows; an empty target has the rate of its smoothing. Other columns
are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from .ascii_words import word_array
from .shared import stored

BUCKETS = 10_000
SEED = 7
MIN_WORDS = 20
PER_CENT = 25
DIGIT_BITS = 11
BLOCKS = 4_096
LEAST_BLOCK = 4_096
_TOP = -(2**63)


def features(docs: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """row, doc_id, n_words and the bucket of every feature of each row."""
    words = docs.select(F.col("doc_id").cast("long").alias("doc_id"), word_array("text").alias("words"))
    less = F.greatest(F.size("words") - 1, F.lit(0))
    pairs = F.zip_with(F.slice("words", 1, less), F.slice("words", 2, less), lambda a, b: F.concat(a, F.lit(" "), b))
    bucket = F.transform(F.concat("words", pairs), lambda w: (F.crc32(w.cast("binary")) % buckets).cast("int"))
    return words.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", F.size("words").cast("long").alias("n_words"),
        bucket.alias("buckets"),
    )


def bucket_counts(featured: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """Features in each bucket; the driver reads one number for each bucket."""
    out = [0] * buckets
    for r in featured.select(F.explode("buckets").alias("b")).groupBy("b").count().collect():
        out[r[0]] = r[1]
    return out


def gains(corpus: list[int], target: list[int]) -> list[int]:
    s_all, t_all = float(sum(corpus) + len(corpus)), float(sum(target) + len(target))
    return [math.floor(1000 * math.log((t + 1.0) * s_all / ((s + 1.0) * t_all))) for s, t in zip(corpus, target)]


def weighted(featured: DataFrame, gain: list[int]) -> DataFrame:
    """``featured`` with n_features and the floored mean gain as weight, without the buckets."""
    table = F.split(F.lit(",".join(map(str, gain))), ",").cast("array<bigint>")
    total = F.aggregate("buckets", F.lit(0).cast("long"), lambda acc, b: acc + F.get(table, b))
    n = F.size("buckets").cast("long")
    some = F.greatest(n, F.lit(1))
    return featured.select(
        "row", "doc_id", "n_words", n.alias("n_features"), total.alias("t"), some.alias("m")
    ).select("row", "doc_id", "n_words", "n_features", F.expr("(t - pmod(t, m)) div m").alias("weight"))


def gumbel(doc_id: Column, seed: int = SEED) -> Column:
    """Floored noise, a thousand times a standard Gumbel draw, from the hash of an id."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def radix_ranks(rows: DataFrame, keys: list[str], bits: int = DIGIT_BITS) -> DataFrame:
    """row and rank (1, 2, 3, ...) by ascending long keys, the first the most significant; ties by row.

    ``row`` is a number whose upper bits, from 33 on, are a partition of bounded size, as
    ``monotonically_increasing_id`` gives it.
    """
    unsigned = [F.col(k).bitwiseXOR(F.lit(_TOP)).alias(f"k{i}") for i, k in enumerate(keys)]
    state = stored(
        rows.select("row", F.col("row").alias("place"), F.shiftright("row", 33).alias("block"), *unsigned), "radix-keys"
    )
    names = [f"k{i}" for i in range(len(keys))]
    facts = state.agg(
        F.count("*").alias("n"),
        *[f(k).alias(f"{k}{f.__name__}") for k in names for f in (F.bit_or, F.bit_and)],
    ).first()
    in_block = max(LEAST_BLOCK, -(-facts["n"] // BLOCKS))
    mask = (1 << bits) - 1
    passed = False
    for k in reversed(names):
        if not facts["n"]:
            break
        varying = (facts[f"{k}bit_or"] ^ facts[f"{k}bit_and"]) & (2**64 - 1)
        for shift in range(0, 64, bits):
            if not (varying >> shift) & mask:
                continue
            digit = F.shiftrightunsigned(k, shift).bitwiseAND(F.lit(mask))
            state = stored(_counting_pass(state.withColumn("digit", digit), in_block, names), "radix-pass")
            passed = True
    if not passed:  # all keys equal: the order of the rows
        state = _counting_pass(state.withColumn("digit", F.lit(0).cast("long")), in_block, names)
    return state.select("row", (F.col("place") + 1).alias("rank"))


def _counting_pass(state: DataFrame, in_block: int, names: list[str]) -> DataFrame:
    """One stable counting sort on ``digit``: new places from 0, and the blocks that they fall into."""
    counts = stored(state.groupBy("digit", "block").agg(F.count("*").alias("n")), "radix-counts")
    digits = counts.groupBy("digit").agg(F.sum("n").alias("total"))
    before = Window.orderBy("digit").rowsBetween(Window.unboundedPreceding, -1)  # at most one row for each digit
    below = digits.select("digit", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("below"))
    earlier = Window.partitionBy("digit").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("earlier", F.coalesce(F.sum("n").over(earlier), F.lit(0))).join(below, "digit")
    offsets = offsets.select("digit", "block", (F.col("below") + F.col("earlier")).alias("offset"))
    number = F.row_number().over(Window.partitionBy("block", "digit").orderBy("place"))
    placed = state.withColumn("number", number.cast("long")).join(offsets, ["block", "digit"])
    placed = placed.select("row", (F.col("offset") + F.col("number") - 1).alias("place"), *names)
    return placed.select("row", "place", F.expr(f"place div {in_block}").alias("block"), *names)


def resample(
    docs: DataFrame, target: DataFrame, per_cent: int = PER_CENT, min_words: int = MIN_WORDS, seed: int = SEED
) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank (null: not drawn) for every row of ``docs``."""
    featured = stored(features(docs), "features")
    goal = features(target.select(F.lit(None).cast("long").alias("doc_id"), "text"))
    gain = gains(bucket_counts(featured), bucket_counts(goal))
    scored = weighted(featured, gain).withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed))
    scored = stored(scored, "scores")
    able = scored.where(F.col("n_words") >= min_words)
    drawn = per_cent * able.count() // 100
    down = F.bitwise_not(F.col("score"))
    last = F.coalesce("doc_id", F.lit(2**63 - 1))
    ranks = radix_ranks(able.select("row", down.alias("down"), last.alias("id")), ["down", "id"])
    ranks = ranks.where(F.col("rank") <= drawn)
    return scored.join(ranks, "row", "left").select("doc_id", "n_words", "n_features", "weight", "score", "rank")
