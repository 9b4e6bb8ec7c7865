"""Byte-level BPE: distinct words are encoded by Spark higher-order functions, texts by looking them up.

1. Each partition lists its distinct words: pieces of white space and what follows up to white space,
   cut where no match of the split pattern can span (see ``buffers.chunks``). The split is Python over
   Arrow; a block is a partition of ``docs``.
2. Distinct words of all blocks are encoded in Spark. The pattern's matches become strings with one
   character a byte; a fold over each joins the neighbours whose concatenation has the lowest rank
   (the leftmost of equals) until none has one. The rank map is a literal, an array of small maps chosen by
   checksum, because Spark searches a map from its start.
   Words are shuffled once, with the block that lists them; the first row of a word is encoded and a window
   hands its ids to the others.
3. The ids are stored by block in the shared folder, so a task over the texts loads only those of its own
   block, finds the word of each by concatenating the bytes of its ids, and assembles and decodes the ids
   of each text. A word that its block lacks is an error, never skipped.

``docs`` must be a plan whose partitions are the same whenever it runs, as a scan or a stored table is.
The fold over a word takes time in the square of its bytes; words are short where texts have spaces.

Null and empty texts have no ids. Rows with equal or null ids are encoded each. An empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .buffers import byte_slices, chunks, span_hashes
from .shared import file_system, shared_folder

#: Words that a task keeps to list each once; past it a word may be listed again, which costs space only.
SEEN_WORDS = 1_000_000
BUCKETS = 16_384  # a power of two


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a .tiktoken file: base64 of the bytes and the rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(word): int(rank) for word, rank in (x.split() for x in lines if x.strip())}


def _unicode(pattern: str) -> str:
    """The split pattern for Java: white space is Unicode's there only if asked for."""
    return "(?U)" + pattern


def rank_literal(ranks: dict[bytes, int]) -> Column:
    """Array of maps from byte strings (a character a byte) to ranks, a bucket for each crc32 modulo BUCKETS."""
    buckets: list[dict[str, int]] = [{} for _ in range(BUCKETS)]
    for word, rank in ranks.items():
        text = word.decode("latin-1")
        buckets[zlib.crc32(text.encode()) % BUCKETS][text] = rank
    return F.from_json(F.lit(json.dumps(buckets)), "array<map<string,int>>")


def _rank(table: Column, word: Column) -> Column:
    return F.try_element_at(F.get(table, F.crc32(word.cast("binary")).bitwiseAND(BUCKETS - 1).cast("int")), word)


def _let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


_NONE = 2**31 - 1  # the rank of a pair that is no token


def fold_merges(table: Column, word: Column) -> Column:
    """The parts (byte strings) of a word after all merges; ranks of neighbours are kept and mended where a merge was.

    The state holds where parts begin, the end of the word last, and the rank of each part with its right neighbour:
    numbers, which are cheaper to copy than strings. A place is looked for by ``transform``, as ``array_position``
    leaves its loop by an exception, which took two fifths of a profile's samples in the fold.
    """
    size = F.char_length(word)

    def pair_rank(begin: Column, end: Column) -> Column:
        return F.coalesce(_rank(table, F.substring(word, begin + 1, end - begin)), F.lit(_NONE))

    def step(acc: Column, _: Column) -> Column:
        def at_rank(now: Column, low: Column) -> Column:
            place = F.array_min(F.transform(now["ranks"], lambda r, i: F.when(r == low, i)))
            return F.when(low == _NONE, now).otherwise(F.aggregate(F.array(place), now, at_place))

        return F.aggregate(F.array(F.array_min(acc["ranks"])), acc, at_rank)

    def at_place(acc: Column, at: Column) -> Column:  # from 0; joins parts at and at + 1
        begins = acc["begins"]
        left = pair_rank(F.get(begins, at - 1), F.get(begins, at + 2))
        right = pair_rank(F.get(begins, at), F.get(begins, at + 3))
        mended = F.transform(acc["ranks"], lambda r, i: F.when(i == at, right).when(i == at - 1, left).otherwise(r))
        return state(*(F.filter(x, lambda _, i: i != at + 1) for x in (begins, mended)))

    def state(begins: Column, ranks: Column) -> Column:
        return F.struct(begins.alias("begins"), ranks.alias("ranks"))

    def parts(acc: Column) -> Column:
        begins = F.slice(acc["begins"], F.lit(1), F.size(acc["ranks"]))
        return F.transform(begins, lambda b, i: F.substring(word, b + 1, F.get(acc["begins"], i + 1) - b))

    last = size - 1
    ranks = F.transform(F.sequence(F.lit(0), last), lambda i: F.when(i < last, pair_rank(i, i + 2)).otherwise(_NONE))
    start = state(F.sequence(F.lit(0), size), ranks)
    merged = F.aggregate(F.sequence(F.lit(2), size), start, step, parts)
    return F.when((size < 2) | _rank(table, word).isNotNull(), F.array(word)).otherwise(merged)


def word_ids(ranks: dict[bytes, int], pattern: str, word: Column) -> Column:
    """The ids of a word."""
    pieces = F.regexp_extract_all(word, F.lit(_unicode(pattern)), F.lit(0))
    as_bytes = F.transform(pieces, lambda p: F.decode(p.cast("binary"), "ISO-8859-1"))
    # One reference to the literal, however often the fold looks into it.
    return _let(
        rank_literal(ranks),
        lambda t: F.flatten(F.transform(as_bytes, lambda p: F.transform(fold_merges(t, p), lambda x: _rank(t, x)))),
    )


def encode_words(listed: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """(block, ids as text) for every (block, word); a word is encoded once however many blocks list it."""
    of_word = Window.partitionBy("word").orderBy("block")
    ids = F.array_join(word_ids(ranks, pattern, F.col("word")), " ")
    once = listed.withColumn("nth", F.row_number().over(of_word)).withColumn("ids", F.when(F.col("nth") == 1, ids))
    return once.select("block", F.first("ids").over(of_word).alias("ids"))


def _distinct_in(data: np.ndarray, offsets: np.ndarray):
    """(code of each word, row of each word, distinct hashes, bytes of each distinct word)."""
    starts, ends, row = chunks(data, offsets)
    code, distinct = pd.factorize(span_hashes(data, starts, ends))
    first = np.zeros(len(distinct), np.int64)
    first[code] = np.arange(len(code))
    raw = data.tobytes()
    return code, row, distinct, [raw[b:e] for b, e in zip(starts[first].tolist(), ends[first].tolist())]


def block_words(narrow: DataFrame) -> DataFrame:
    """(block, word): the distinct words of each block of (block, doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for first, data, offsets in byte_slices(batch.column(1)):
                if not len(data):
                    continue
                _, _, distinct, found = _distinct_in(data, offsets)
                if len(seen) > SEEN_WORDS:
                    seen.clear()
                new = [w for h, w in zip(distinct.tolist(), found) if h not in seen]
                seen.update(distinct.tolist())
                block = np.full(len(new), batch.column(0)[first].as_py(), np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(block), pa.array(new, pa.binary()).cast(pa.string())], names=["block", "word"]
                )

    return narrow.select("block", "text").mapInArrow(run, "block int, word string")


def _block_table(folder: str, block: int, piece: dict[str, bytes]) -> dict[bytes, str]:
    """The words of a block: bytes that the ids decode to -> ids as text."""
    import pyarrow.parquet as pq
    from pyarrow import fs

    store, base = file_system(folder)
    out: dict[bytes, str] = {}
    for info in store.get_file_info(fs.FileSelector(f"{base}/block={block}", allow_not_found=True)):
        if info.path.endswith(".parquet"):
            with store.open_input_file(info.path) as source:
                listed = pq.read_table(source, columns=["ids"]).column("ids").to_pylist()
            out.update((b"".join([piece[i] for i in ids.split(" ")]), ids) for ids in listed)
    return out


def encode_decode(docs: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row, in the partitions of ``docs``."""
    spark = docs.sparkSession
    narrow = docs.select(F.spark_partition_id().alias("block"), "doc_id", F.col("text").cast("string").alias("text"))
    folder = shared_folder(spark, "words-by-block")
    encoded = encode_words(block_words(narrow), ranks, pattern).repartition("block")
    encoded.write.partitionBy("block").option("compression", "zstd").parquet(folder)
    vocabulary = spark.sparkContext.broadcast({str(rank): word for word, rank in ranks.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = None
        piece = vocabulary.value
        for batch in batches:
            if table is None and len(batch):
                table = _block_table(folder, batch.column(0)[0].as_py(), piece)
            for first, data, offsets in byte_slices(batch.column(2)):
                n = len(offsets) - 1
                counts = np.zeros(n, np.int64)
                edge = np.zeros(n + 1, np.int64)
                texts, raw = [], []
                if len(data):
                    code, row, _, found = _distinct_in(data, offsets)
                    of = [table[w] for w in found]
                    size = np.array([x.count(" ") + 1 for x in of], np.int64)
                    counts = np.bincount(row, size[code], n).astype(np.int64)
                    edge = np.searchsorted(row, np.arange(n + 1))
                    # The table's keys are decoded from the ids, so a word found there is its own decoding.
                    listed_codes = code.tolist()
                    texts, raw = [of[k] for k in listed_codes], [found[k] for k in listed_codes]
                spans = list(zip(edge[:-1].tolist(), edge[1:].tolist()))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(1).slice(first, n),
                        pa.array(counts),
                        pa.array([hashlib.sha256(" ".join(texts[b:e]).encode()).hexdigest() for b, e in spans]),
                        pa.array([hashlib.sha256(b"".join(raw[b:e])).hexdigest() for b, e in spans]),
                    ],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    kind = dict(narrow.dtypes)["doc_id"]
    return narrow.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
