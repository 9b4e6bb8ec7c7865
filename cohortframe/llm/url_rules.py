"""URL rules indexed by their rarest literal token.

A rule is a regular expression on host and path with the literal tokens that every matching url must hold
as whole tokens (runs of a-z and 0-9). Token counts over the urls at hand choose each rule's rarest one;
urls fetch rules by joining on their tokens, and only fetched rules run their expression. The longest
matching rule wins, ties by name. Only DataFrame functions are used, and equal urls are judged once.

A url is split at its first ``://``: the host goes up to ``/``, ``?``, ``#`` or the end, with A-Z in lower case; the
path follows up to ``?``, ``#`` or the end. Null urls and urls without ``://`` have an empty host and path
and match no rule. Without a rule a url is blocked if a spam pattern matches, else allowed. Repeated rows
are judged alike; an empty table gives no rows. The rule list is a parameter and may be broadcast
while it has at most ``BROADCAST_RULES`` rules.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

BROADCAST_RULES = 10_000


@dataclass(frozen=True)
class Rule:
    name: str
    verdict: str
    pattern: str
    tokens: tuple[str, ...]
    named: bool  # whether the rule's name is reported


def prefix_rule(verdict: str, rule: str) -> Rule:
    """``host/path``: fits the host and its subdomains where the url's path starts with the rule's."""
    host, _, path = rule.partition("/")
    known = re.findall("[a-z0-9]+", host)
    known += [t for t in re.findall("[a-z0-9]+(?=[^a-z0-9])", path)]
    return Rule(rule, verdict, rf"^(?:[^/]*\.)?\Q{host}\E\Q/{path}\E", tuple(known), True)


def word_rule(word: str) -> Rule:
    return Rule(f"*{word}*", "block", rf"(?i)(?:^|[^a-z0-9])\Q{word}\E(?:[^a-z0-9]|$)", (word,), False)


PREFIX_RULES = (
    prefix_rule("allow", "org/"),
    prefix_rule("block", "example.org/es/"),
    prefix_rule("block", "example.org/en/1"),
    prefix_rule("allow", "com/fr/"),
    prefix_rule("block", "com/de/"),
)
SPAM_WORDS = ("bet", "bets", "betting", "casino", "jackpot", "pharmacy", "pills", "poker", "porn", "viagra", "xxx")
DEFAULT_RULES = (*PREFIX_RULES, *map(word_rule, SPAM_WORDS))


def host_of(url: str = "url") -> Column:
    raw = F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: str = "url") -> Column:
    return F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _rules_frame(spark: SparkSession, rules: tuple[Rule, ...]) -> DataFrame:
    rows = [(r.name, r.verdict, r.pattern, list(r.tokens), r.named, len(r.name)) for r in rules]
    kind = "name string, rule_verdict string, pattern string, tokens array<string>, named boolean, size int"
    frame = spark.createDataFrame(rows, kind)
    return F.broadcast(frame) if len(rules) <= BROADCAST_RULES else frame


def judge(pages: DataFrame, rules: tuple[Rule, ...] = DEFAULT_RULES) -> DataFrame:
    """page_id, host, path, rule (null without one) and verdict of every row."""
    spark = pages.sparkSession
    own = pages.select("page_id", F.col("url").cast("string").alias("url"))
    own = own.withColumns({"host": host_of(), "path": path_of()})
    urls = own.select("host", "path").distinct()
    tokens = urls.select("host", "path", F.explode(F.array_distinct(F.split(F.lower(F.concat("host", "path")), "[^a-z0-9]+"))).alias("token"))
    table = _rules_frame(spark, rules)
    of_rules = table.select("name", F.explode("tokens").alias("token"))
    used = of_rules.select("token").distinct()
    counts = tokens.join(F.broadcast(used) if len(rules) <= BROADCAST_RULES else used, "token").groupBy("token").agg(F.count("*").alias("n"))
    # Tokens that no url holds count as none: their rules can't match and stay out of the index.
    rarest = of_rules.join(counts, "token", "left").groupBy("name").agg(
        F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token")).alias("key")
    )
    index = table.join(rarest.where("key.n > 0"), "name").select(
        F.col("key.token").alias("token"), "name", "rule_verdict", "pattern", "named", "size"
    )
    index = F.broadcast(index) if len(rules) <= BROADCAST_RULES else index
    target = F.concat("host", "path")
    hits = tokens.join(index, "token").where(F.regexp_like(target, F.col("pattern")))
    best = hits.groupBy("host", "path").agg(
        F.max(F.struct("named", "size", F.col("name").alias("rule"), "rule_verdict")).alias("best")
    )
    return own.join(best, ["host", "path"], "left").select(
        "page_id",
        "host",
        "path",
        F.when(F.col("best.named"), F.col("best.rule")).alias("rule"),
        F.coalesce("best.rule_verdict", F.lit("allow")).alias("verdict"),
    )
