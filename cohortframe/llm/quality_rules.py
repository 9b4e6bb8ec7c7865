"""Quality rules: fixed base rules and a decision list learned from labelled statistics.

Everything is DataFrame functions. ``measures`` counts, for each text, words, characters in words, symbols,
repeated lines and words in repeated five-word windows. Windows are compared by 64-bit hashes inside the
row: a text without equal hashes is done at once, else the sorted (hash, place) list gives the places of
repeated windows and one pass over them the number of covered words.

``learn`` grows rules by sequential covering. Thresholds are quantiles of five ratios. A rule starts
empty; the condition with the best FOIL gain on the growing part (two thirds of the labelled ids by
hash) is added while it helps, conditions are dropped from the end as the pruning part asks, and the
rule is kept if on both parts at least ``PRECISION`` of what it covers is of low quality. Its rows are
then covered and the next rule starts. Each step is one aggregate over the labelled measures; the driver
sees histograms of fixed size. The list becomes one chain of Spark conditions, in order.

Null and empty texts have no words and fail the base rule. Without labels the list is empty and only the base
rule rejects. Rows that repeat an id are judged each. Columns of ``documents`` stay as they are.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .shared import stored

SPACES = "[\\x20\\t-\\r]+"
BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 5
MIN_WORDS = 10
MAX_REPEATED = 20  # per cent of the words

QUANTILES = 32
MAX_RULES, MAX_TERMS = 6, 3
PRECISION = 0.9
MIN_COVER = 5
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
# Whole numbers, so that thresholds mean the same wherever they are compared.
RATIOS = {
    "words": "n_words",
    "word_length": "100 * word_chars div greatest(n_words, 1)",
    "symbols": "1000 * n_symbols div greatest(n_words, 1)",
    "dup_lines": "1000 * n_dup_lines div greatest(n_words, 1)",
    "repeats": "1000 * n_repeat_words div greatest(n_words, 1)",
}


def measures(docs: DataFrame) -> DataFrame:
    """doc_id with the five counts (long) for every row."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.translate(x, BLANKS, "") != "")
    one = docs.select(
        "doc_id",
        F.array_remove(F.split(text, SPACES), "").alias("w"),
        F.char_length(F.translate(text, BLANKS, "")).cast("long").alias("word_chars"),
        (F.char_length(text) - F.char_length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        lines.alias("lines"),
    )
    two = one.select(
        "doc_id",
        F.size("w").cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.transform("w", lambda x: F.xxhash64(x)).alias("w"),
    )
    n = F.greatest(F.size("w") - F.lit(WINDOW - 1), F.lit(0))
    parts = F.arrays_zip(*[F.slice("w", k + 1, n).alias(f"w{k}") for k in range(WINDOW)])
    three = two.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines",
        F.transform(parts, lambda s: F.xxhash64(*[s[f"w{k}"] for k in range(WINDOW)])).alias("h"),
    )
    pairs = F.array_sort(F.transform("h", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    four = three.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines",
        F.when(F.size(F.array_distinct("h")) < F.size("h"), pairs).alias("s"),
    )
    less = F.size("s") - 1
    same = F.zip_with(F.slice("s", 1, less), F.slice("s", 2, less), lambda a, b: a["x"] == b["x"])
    five = four.withColumn("e", same)
    no = F.array(F.lit(False))
    marked = F.zip_with(
        F.zip_with("s", F.concat(no, F.col("e")), lambda s, e: F.when(e, s["i"])),
        F.zip_with("s", F.concat(F.col("e"), no), lambda s, e: F.when(e, s["i"])),
        lambda a, b: F.coalesce(a, b),
    )
    start = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("long").alias("total"))
    covered = F.aggregate(
        F.array_sort(F.array_compact(marked)),
        start,
        lambda acc, p: F.struct(
            p.alias("last"), (acc["total"] + F.least(F.lit(WINDOW), p - acc["last"]).cast("long")).alias("total")
        ),
        lambda acc: acc["total"],
    )
    return five.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines",
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))


@dataclass(frozen=True)
class Term:
    ratio: str
    above: bool
    threshold: int

    def column(self) -> Column:
        value = F.expr(RATIOS[self.ratio])
        return value > self.threshold if self.above else value <= self.threshold


@dataclass(frozen=True)
class DecisionList:
    rules: tuple[tuple[Term, ...], ...] = ()

    def rejects(self) -> Column:
        """The number of the first rule that covers the row, counted from 1; null if none does."""
        chain = F.lit(None).cast("int")
        for k in range(len(self.rules), 0, -1):
            chain = F.when(_all(self.rules[k - 1]), F.lit(k)).otherwise(chain)
        return chain

    def describe(self) -> list[str]:
        return [" and ".join(f"{t.ratio} {'>' if t.above else '<='} {t.threshold}" for t in rule) for rule in self.rules]


def _all(terms) -> Column:
    out = F.lit(True)
    for t in terms:
        out = out & t.column()
    return out


def _bin(ratio: str, cuts: list) -> Column:
    """The number of thresholds below the value."""
    value = F.expr(RATIOS[ratio])
    return F.size(F.filter(F.array(*[F.lit(int(c)).cast("long") for c in cuts]), lambda c: value > c))


def _gain(bad: int, good: int, bad0: int, good0: int) -> float:
    """FOIL's gain of a condition that keeps ``bad`` and ``good`` of what was there."""
    if not bad:
        return 0.0
    return bad * (math.log2(bad / (bad + good)) - math.log2(bad0 / (bad0 + good0)))


def learn(counts: DataFrame, labels: DataFrame) -> DecisionList:
    """A decision list for low quality from ``counts`` (see ``measures``) and ``labels`` (doc_id, quality)."""
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    data = stored(
        counts.where(~base_failed()).join(known, "doc_id").select(
            *COUNTS, (F.col("quality") == 0).alias("bad"), (F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0).alias("prune")
        ),
        "labelled-measures",
    )
    steps = [k / QUANTILES for k in range(1, QUANTILES)]
    quantiles = data.agg(*[F.percentile_approx(F.expr(e), steps, 10_000).alias(r) for r, e in RATIOS.items()]).first()
    cuts = {r: sorted(set(quantiles[r] or ())) for r in RATIOS}
    # Rare junk sits beyond the last quantile of all rows: add those of the rows of low quality.
    low = data.where("bad").agg(*[F.percentile_approx(F.expr(e), steps, 10_000).alias(r) for r, e in RATIOS.items()]).first()
    cuts = {r: sorted(set(cuts[r]) | set(low[r] or ())) for r in RATIOS}
    rules: list[tuple[Term, ...]] = []
    left = data
    while len(rules) < MAX_RULES:
        terms: list[Term] = []
        grow = left.where(~F.col("prune"))
        while len(terms) < MAX_TERMS:
            bins = [F.struct(F.lit(r).alias("ratio"), _bin(r, cuts[r]).alias("bin")) for r in RATIOS if cuts[r]]
            if not bins:
                break
            seen = (
                grow.where(_all(terms)).select("bad", F.explode(F.array(*bins)).alias("b"))
                .groupBy("b.ratio", "b.bin", "bad").count().collect()
            )
            best, chosen = 0.0, None
            for r in RATIOS:
                hist = {(x["bin"], x["bad"]): x["count"] for x in seen if x["ratio"] == r}
                bad0 = sum(v for (_, b), v in hist.items() if b)
                good0 = sum(v for (_, b), v in hist.items() if not b)
                bad = good = 0
                for k, threshold in enumerate(cuts[r]):
                    bad += hist.get((k, True), 0)
                    good += hist.get((k, False), 0)
                    for above, b, g in ((False, bad, good), (True, bad0 - bad, good0 - good)):
                        gain = _gain(b, g, bad0, good0)
                        if b >= MIN_COVER and gain > best + 1e-9:
                            best, chosen = gain, Term(r, above, int(threshold))
                if bad0 and not good0:
                    best, chosen = 0.0, None
                    break
            if chosen is None or chosen in terms:
                break
            terms.append(chosen)
        if not terms:
            break
        tests = left.agg(
            *[
                F.count_if(_all(terms[:k]) & (F.col("prune") == part) & (F.col("bad") == bad)).alias(f"n{k}{int(part)}{int(bad)}")
                for k in range(1, len(terms) + 1)
                for part in (False, True)
                for bad in (False, True)
            ]
        ).first()
        score = {}
        for k in range(1, len(terms) + 1):
            bad, good = tests[f"n{k}11"], tests[f"n{k}10"]
            score[k] = (bad - good) / (bad + good) if bad + good else -1.0
        keep = max(score, key=lambda k: (score[k], -k))
        enough = all(
            tests[f"n{keep}{p}1"] >= PRECISION * (tests[f"n{keep}{p}0"] + tests[f"n{keep}{p}1"]) for p in (0, 1)
        )
        if not enough or tests[f"n{keep}01"] < MIN_COVER or not tests[f"n{keep}11"]:
            break
        rules.append(tuple(terms[:keep]))
        left = left.where(~_all(rules[-1]))
    return DecisionList(tuple(rules))


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, the five counts, base_failed, rule (first rule that rejects, or null) and kept of every row."""
    counts = stored(measures(docs), "measures")
    chosen = learn(counts, labels)
    rule = chosen.rejects()
    return counts.select("doc_id", *COUNTS, base_failed().alias("base_failed"), rule.alias("rule")).withColumn(
        "kept", ~F.col("base_failed") & F.col("rule").isNull()
    )


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns."""
    verdicts = judge(docs, labels).groupBy("doc_id").agg(F.bool_or("kept").alias("__kept"))
    good = verdicts.where("__kept").select(F.col("doc_id").alias("__id"))
    return docs.join(good, docs["doc_id"].eqNullSafe(F.col("__id")), "left_semi")
