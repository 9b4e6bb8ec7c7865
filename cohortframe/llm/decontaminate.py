"""Benchmark passages in documents, by a prefix-filtered set join.

An item's windows are its runs of ``WINDOW`` words; an item of fewer words is one window. A window occurs in
a document where its words stand one after the other. Every window is a set of shingles of ``SHINGLE`` words (a shorter
window is one shingle), and it occurs only where all of them occur, so one of them is prefix enough:

1. all documents are read once to count the shingles that the items hold; the rarest of a window is its prefix, and a
   window with a shingle that no document has is out;
2. shingles of documents are joined with the prefixes. Such a match fixes the place of the whole window:
   it has to begin and end inside the document (position and length bounds);
3. the words at that place are compared with the window's one by one, so hashes decide nothing.

Documents are cut into overlapping chunks of ``CHUNK`` words before shingles become rows, so a long text is
neither copied whole for a match nor compared in one row. Prefixes are broadcast in blocks of at most ``MAX_KEYS``
rows; a benchmark with more of them takes one pass over the documents for each block. Everything is DataFrame
functions.

Null and empty texts have no words; null and empty items have no windows. A null item_id counts as the empty
string. Rows that repeat a doc_id are judged each; items that repeat an item_id are one item. Without items
nothing is hit; without documents there are no rows. Columns other than doc_id, item_id and text are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from .ascii_words import word_array
from .shared import stored

WINDOW = 10
SHINGLE = 5
CHUNK = 256
MAX_KEYS = 400_000
_EACH = -(2**63) + 1  # key of the row that every document gives, hit or not


def _shingles(words: str, size: int) -> Column:
    """(p, key) of the runs of ``size`` words of an array column."""
    hashes = F.transform(F.col(words), lambda w: F.xxhash64(w))
    n = F.greatest(F.size(words) - F.lit(size - 1), F.lit(0))
    parts = F.arrays_zip(*[F.slice(hashes, k + 1, n).alias(f"h{k}") for k in range(size)])
    return F.transform(
        parts, lambda s, i: F.struct(i.alias("p"), F.xxhash64(*[s[f"h{k}"] for k in range(size)], F.lit(size)).alias("key"))
    )


def item_windows(items: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """Different windows (words, items: number of the set of items that hold it), and those sets (items, item)."""
    words = items.select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), word_array("text").alias("words")
    ).where(F.size("words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - F.lit(window - 1), F.lit(1)))
    each = words.select("item", F.explode(F.transform(starts, lambda i: F.slice("words", i, window))).alias("words"))
    held = stored(each.groupBy("words").agg(F.array_sort(F.collect_set("item")).alias("held")), "item-windows")
    sets = stored(held.select("held").distinct().withColumn("items", F.monotonically_increasing_id()), "item-sets")
    return held.join(sets, "held").select("words", "items"), sets.select("items", F.explode("held").alias("item"))


def _chunks(docs: DataFrame, window: int, sizes: list[int]) -> DataFrame:
    """A row for each shingle of each chunk, and one with p = -1 for each document; ``docs``: row, doc_id, words."""
    starts = F.sequence(F.lit(0), F.greatest(F.size("words") - 1, F.lit(0)), F.lit(CHUNK))
    cut = docs.select(
        "row", "doc_id", F.size("words").cast("long").alias("n_words"),
        F.posexplode(F.transform(starts, lambda k: F.slice("words", k + 1, CHUNK + window - 1))).alias("chunk", "part"),
    )
    first = F.when(F.col("chunk") == 0, F.array(F.struct(F.lit(-1).alias("p"), F.lit(_EACH).alias("key"))))
    none = F.array().cast("array<struct<p:int,key:bigint>>")
    keys = F.concat(F.coalesce(first, none), *[_shingles("part", s) for s in sizes])
    return cut.select("row", "doc_id", "n_words", "chunk", "part", F.inline(keys))


def _counted(docs: DataFrame, wanted: DataFrame, window: int, sizes: list[int], blocks: int) -> DataFrame:
    """How often each wanted shingle occurs in the documents."""
    rows = _chunks(docs, window, sizes).where(F.col("p").between(0, CHUNK - 1)).select("key")
    parts = [
        rows.join(F.broadcast(wanted.where(F.pmod("key", F.lit(blocks)) == b)), "key").groupBy("key").agg(F.count("*").alias("n"))
        for b in range(blocks)
    ]
    return reduce(DataFrame.union, parts)


def occurrences(docs: DataFrame, windows: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """Where windows occur: row, doc_id, n_words, s, e (words s to e - 1) and items; s is null once for each document.

    ``docs`` has doc_id and text, ``windows`` words and items; a row of ``docs`` is known by its number ``row``.
    """
    if window > 2 * CHUNK or shingle > window:
        raise ValueError("a shingle must fit a window, and a window two chunks")
    table = docs.select("doc_id", word_array("text").alias("words"))
    sized = windows.withColumn("size", F.least(F.size("words"), F.lit(shingle)))
    sizes = sorted(r[0] for r in sized.select("size").distinct().collect())  # 1 to ``shingle`` at most
    each = stored(
        reduce(
            DataFrame.union,
            [sized.where(F.col("size") == s).select("words", "items", F.inline(_shingles("words", s))) for s in sizes],
        )
        if sizes
        else sized.select("words", "items", F.lit(0).alias("p"), F.lit(0).cast("long").alias("key")).where("false"),
        "window-shingles",
    )
    n_keys = each.count()
    blocks = max(-(-n_keys // MAX_KEYS), 1)
    wanted = stored(each.select("key").distinct(), "wanted-shingles")
    numbered = table.withColumn("row", F.monotonically_increasing_id())
    if blocks > 1:  # every block has to see the same numbers
        numbered = stored(numbered, "numbered-words")
    seen = stored(_counted(numbered, wanted, window, sizes, blocks), "shingle-counts") if sizes else wanted.withColumn("n", F.lit(1))
    order = F.struct(F.coalesce("n", F.lit(0).cast("long")).alias("n"), "key", "p")
    rarest = each.join(seen, "key", "left").groupBy("words", "items").agg(F.min(order).alias("first"))
    prefix = rarest.where("first.n > 0").select(
        F.col("first.key").alias("key"), F.col("first.p").alias("at"), F.col("words").alias("window"), "items"
    )
    none = docs.sparkSession.range(1).select(
        F.lit(_EACH).alias("key"), F.lit(None).cast("int").alias("at"), F.lit(None).cast("array<string>").alias("window"),
        F.lit(None).cast("long").alias("items"),
    )
    prefix = stored(prefix, "window-prefixes")
    begin, size = F.col("p") - F.col("at"), F.size("window")
    inside = begin.between(0, CHUNK - 1) & (begin + size <= F.size("part"))
    same = F.slice("part", F.when(inside, begin + 1).otherwise(1), size) == F.col("window")
    start = (F.col("chunk").cast("long") * CHUNK) + begin
    rows = _chunks(numbered, window, sizes)
    parts = []
    for b in range(blocks):
        block = prefix.where(F.pmod("key", F.lit(blocks)) == b)
        if b == 0:
            block = block.union(none)
        met = rows.join(F.broadcast(block), "key")
        met = met.where(((F.col("p") < 0) & F.col("window").isNull()) | ((F.col("p") >= 0) & inside & same))
        parts.append(met.select("row", "doc_id", "n_words", start.alias("s"), (start + size).alias("e"), "items"))
    return reduce(DataFrame.union, parts)


def _covered(spans: Column) -> Column:
    """Words inside the union of sorted (s, e) spans."""
    start = F.struct(F.lit(0).cast("long").alias("last"), F.lit(0).cast("long").alias("total"))
    return F.aggregate(
        spans,
        start,
        lambda acc, x: F.struct(
            F.greatest(acc["last"], x["e"]).alias("last"),
            (acc["total"] + F.greatest(x["e"] - F.greatest(acc["last"], x["s"]), F.lit(0))).alias("total"),
        ),
        lambda acc: acc["total"],
    )


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated and spans (s, e) for every row of ``docs``."""
    windows, sets = item_windows(items, window)
    found = occurrences(docs, windows, window, shingle)
    span = F.when(F.col("s").isNotNull(), F.struct("s", "e"))
    per_doc = stored(
        found.groupBy("row").agg(
            F.max("doc_id").alias("doc_id"),
            F.max("n_words").alias("n_words"),
            F.array_sort(F.collect_set(span)).alias("spans"),
            F.array_sort(F.collect_set("items")).alias("held"),
        ),
        "contamination",
    )
    clean = per_doc.where(F.size("held") == 0)
    hit = per_doc.where(F.size("held") > 0)
    # Copies share their sets of items, so names are joined and hashed once for each different combination.
    kinds = stored(hit.select("held").distinct().withColumn("kind", F.monotonically_increasing_id()), "item-combinations")
    named = (
        kinds.select("kind", F.explode("held").alias("items")).join(sets, "items")
        .groupBy("kind").agg(F.array_sort(F.collect_set("item")).alias("names"))
        .select("kind", F.size("names").cast("long").alias("n_items"), F.sha2(F.array_join("names", ","), 256).alias("items_sha256"))
    )
    named = kinds.join(named, "kind").select("held", "n_items", "items_sha256")
    columns = ["doc_id", "n_words", "spans", "n_items", "items_sha256"]
    empty = F.sha2(F.lit("").cast("binary"), 256)
    out = hit.join(named, "held").select(*columns).union(
        clean.select("doc_id", "n_words", "spans", F.lit(0).cast("long").alias("n_items"), empty.alias("items_sha256"))
    )
    return out.withColumn("n_hit", _covered(F.col("spans"))).select(
        "doc_id", "n_words", "n_hit", "n_items", "items_sha256", (F.col("n_hit") > 0).alias("contaminated"), "spans"
    )
