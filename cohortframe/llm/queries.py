"""The queries over these operators, one for each, and their SQL where SQL can express them.

``queries`` and ``oracle_sql`` are read by the entry module. Tokenizer files come from the installed
``public_tokenizers`` package; a path may be given instead.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import (
    byte_bpe, clusters, decontaminate, html_text, line_dedup, near_dedup, oracles, packing, quality_rules, resample, token_files,
    toxicity, url_rules, vector_dedup,
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text without repeated lines, and how many lines it had and lost."""
    return line_dedup.dedup_lines(_table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_removed")


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's main text and its length in code points."""
    return html_text.extract(_table(spark, sf_dir, "pages"))


def op3_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's number of links and its component among vectors of its label."""
    return vector_dedup.vector_groups(_table(spark, sf_dir, "embeddings"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in a sequence of at most 1024 tokens."""
    return packing.pack(_table(spark, sf_dir, "documents"), _vocabulary("byte_bpe_50k.json"))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place, length and checksum, read back from the token files."""
    return token_files.write_and_read(_table(spark, sf_dir, "documents"), _vocabulary("word_bpe_49k.json"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's counts and the verdict of base rules and learned rules."""
    judged = quality_rules.judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return judged.select("doc_id", *quality_rules.COUNTS, "base_failed", "rule", "kept")


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's group by weighted shingles; kept marks the one that stands for it."""
    return near_dedup.classes(_table(spark, sf_dir, "documents"), weigh=near_dedup.weigh_by_length)


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's number of ids and digests of its ids and of the decoded bytes."""
    import public_tokenizers

    ranks = byte_bpe.read_ranks(_vocabulary("byte_bpe_50k.tiktoken"))
    return byte_bpe.encode_decode(_table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity score; documents of the held-out fifth are never learned from."""
    docs = _table(spark, sf_dir, "documents")
    lexicon = toxicity.learn(docs, _table(spark, sf_dir, "labels"))
    return toxicity.score(docs.select("doc_id", "text"), lexicon).select(
        "doc_id",
        toxicity.held_out().alias("held_out"),
        F.col("toxicity_score").alias("score"),
        (F.col("toxicity_score") >= 0.5).cast("int").alias("predicted"),
    )


def op10_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's host, path, rule and verdict."""
    return url_rules.judge(_table(spark, sf_dir, "pages"))


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of every document stand in a benchmark passage, and which items they are of."""
    found = decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's weight towards the benchmark's distribution, its score and its rank in the draw."""
    drawn = resample.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def op13_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's cluster after ten rounds, with exact distances and sums."""
    return clusters.cluster(_table(spark, sf_dir, "embeddings"))


_OP10 = """
WITH parts AS (
  SELECT page_id,
         translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path
  FROM pages),
ruled AS (
  SELECT *, CASE
      WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/en/1') THEN 'example.org/en/1'
      WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/es/') THEN 'example.org/es/'
      WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/fr/') THEN 'com/fr/'
      WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/de/') THEN 'com/de/'
      WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/') THEN 'org/'
    END AS rule
  FROM parts)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
            WHEN regexp_matches(lower(host || path), '(^|[^a-z0-9])(SPAM)([^a-z0-9]|$)') THEN 'block'
            ELSE 'allow' END AS verdict
FROM ruled
""".replace("SPAM", "|".join(url_rules.SPAM_WORDS))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    each = (
        op1_line_dedup, op2_html_text, op3_vector_dedup, op4_packing, op5_token_files,
        op6_quality_rules, op7_near_dedup, op8_byte_bpe, op9_toxicity, op10_url_rules, op11_decontamination,
        op12_resampling, op13_clusters, pipeline,
    )
    return {q.__name__: q for q in each}


def oracle_sql() -> dict[str, str]:
    return {
        "op10_url_rules": _OP10,
        "op11_decontamination": oracles.decontamination(),
        "op12_resampling": oracles.resampling(),
        "op13_clusters": oracles.clustering(),
    }
