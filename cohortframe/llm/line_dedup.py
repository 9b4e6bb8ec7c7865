"""Removal of lines that an earlier document already has, exactly or within one edited word.

A line is what stands between newlines; it is compared as its lower-cased words. Lines without a word
are kept. A line goes if

* the same document has an equal line before it, or
* a document with a smaller doc_id has an equal line, or
* it has at least ``MIN_WORDS`` words and a document with a smaller doc_id has a line at edit distance
  one in words (a word replaced, added or left out). Near lines within one document (table rows,
  list items) are not compared with each other.

Method: equal lines are first counted into distinct ones. Deletion neighbourhood: every distinct line
gives its own hash and the hash of each variant that lacks one word, with the place of that word; two
lines that share (place, variant) differ in that word alone, and a line whose own hash is a variant of
another is one word shorter. For each variant the earliest line is found by an aggregate, so the work
is linear in the variants however many lines share one. The link to the earliest line is verified on the
words before it counts.

Lines of ``MIN_WORDS`` - 1 words stay themselves, but count as the shorter, earlier partner: they give their own
hash and no variants.

Only lines that can have a partner emit variants: of two lines at distance one, the first half or the
second half of the shorter is common to both, so lines that share neither half with any other
distinct line are out. That test is exact.

Null texts stay null, empty texts empty. Rows that share a doc_id keep the same lines and never drop each
other's; rows without a doc_id count as one last document. An empty table gives no rows. Columns that
are called like the operator's own are replaced by them. A line may be as long as a document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .buffers import byte_slices, mix, powers, ranges, span_hashes, words
from .shared import stored

MIN_WORDS = 10
FILTER_BITS = 1 << 24
_LAST = 2**63 - 1
_TAG = np.uint64(0x632BE59BD9B4E019)


class _Lines:
    """Lines with a word in a byte slice; ``word`` are the word hashes, line k has words begin[k] to end[k]."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        starts, ends, row = words(data, offsets)
        self.word = span_hashes(data, starts, ends)
        newline = np.zeros(len(data) + 1, np.int64)
        np.cumsum(data == 10, out=newline[1:])
        number = newline[starts] - newline[offsets[row]]
        new = np.ones(len(starts), bool)
        new[1:] = (row[1:] != row[:-1]) | (number[1:] != number[:-1])
        self.begin = np.flatnonzero(new)
        self.end = np.append(self.begin[1:], len(starts)).astype(np.int64)
        self.row, self.number = row[self.begin], number[self.begin]
        self.size = self.end - self.begin
        self.sums(self.word)
        self.one = self.key(self.begin, self.end)
        other = mix(self.word ^ _TAG)
        self.two = _finish(_poly(_running(other), self.begin, self.end), self.size)

    def sums(self, word: np.ndarray) -> None:
        self.running = _running(word)

    def key(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _finish(_poly(self.running, begin, end), end - begin)

    def first_in_row(self) -> np.ndarray:
        code, distinct = pd.factorize(mix(self.one ^ mix(self.row.astype(np.uint64) + _TAG)))
        first = np.zeros(len(code), bool)
        at = np.zeros(len(distinct), np.int64)
        at[code[::-1]] = np.arange(len(code) - 1, -1, -1)
        first[at] = True
        return first


def _running(word: np.ndarray) -> np.ndarray:
    power, _ = powers(len(word) + 2)
    out = np.zeros(len(word) + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(word * power[: len(word)], out=out[1:])
    return out


def _poly(running: np.ndarray, begin: np.ndarray, end: np.ndarray, shift: int = 0) -> np.ndarray:
    _, inverse = powers(len(running) + 2)
    with np.errstate(over="ignore"):
        return (running[end] - running[begin]) * inverse[begin + shift]


def _finish(sums: np.ndarray, size: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(sums + size.astype(np.uint64) * _TAG)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _half_keys(lines: _Lines, at: np.ndarray) -> list[np.ndarray]:
    """For lines of n words, both halves of n - 1 and of n words, tagged with that number and the side."""
    out = []
    begin, end, size = lines.begin[at], lines.end[at], lines.size[at]
    with np.errstate(over="ignore"):
        for q in (size - 1, size):
            half = q // 2
            for side, b, e in ((1, begin, begin + half), (2, end - (q - half), end)):
                out.append(mix(lines.key(b, e) + (q * 4 + side).astype(np.uint64) * _TAG))
    return out


def _line_table(docs: DataFrame, min_words: int) -> DataFrame:
    """Distinct lines of each document: doc, h1, h2 and the four keys of its halves.

    Lines of one word less than ``min_words`` have the last two keys only, those of a longer partner; shorter ones none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.asarray(batch.column(0))
            for first, data, offsets in byte_slices(batch.column(1)):
                lines = _Lines(data, offsets)
                at = np.flatnonzero(lines.first_in_row())
                least = (min_words, min_words, min_words - 1, min_words - 1)
                keys = [pa.array(k.view(np.int64), mask=lines.size[at] < n) for k, n in zip(_half_keys(lines, at), least)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[first + lines.row[at]]), _signed(lines.one[at]), _signed(lines.two[at]), *keys],
                    names=["doc", "h1", "h2", "k1", "k2", "k3", "k4"],
                )

    return docs.mapInArrow(run, "doc long, h1 long, h2 long, k1 long, k2 long, k3 long, k4 long")


def _line_filter(wanted: DataFrame) -> np.ndarray:
    """A bit for each hash bucket that holds a wanted line; FILTER_BITS bits, whatever the size of the table."""
    slot = F.pmod("h1", F.lit(FILTER_BITS))
    words_of = wanted.select(F.shiftright(slot, 6).cast("int").alias("w"), (slot % 64).cast("int").alias("b"))
    rows = words_of.groupBy("w").agg(F.bit_or(F.expr("shiftleft(1L, b)")).alias("bits")).collect()
    out = np.zeros(FILTER_BITS // 64, np.int64)
    if rows:
        out[[r[0] for r in rows]] = [r[1] for r in rows]
    return out.view(np.uint64)


def _near_lines(docs: DataFrame, bits: np.ndarray, min_words: int) -> DataFrame:
    """Lines of enough words, or one less, that pass the filter, with their word hashes."""
    shared_bits = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.asarray(batch.column(0))
            for first, data, offsets in byte_slices(batch.column(1)):
                lines = _Lines(data, offsets)
                slot = np.mod(lines.one.view(np.int64), FILTER_BITS).astype(np.uint64)
                hit = (shared_bits.value[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1)
                at = np.flatnonzero((hit > 0) & (lines.size >= min_words - 1) & lines.first_in_row())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids[first + lines.row[at]]),
                        _signed(lines.one[at]),
                        _signed(lines.two[at]),
                        pa.array([lines.word[b:e].tobytes() for b, e in zip(lines.begin[at], lines.end[at])], pa.binary()),
                    ],
                    names=["doc", "h1", "h2", "words"],
                )

    return docs.mapInArrow(run, "doc long, h1 long, h2 long, words binary")


def _variants(near: DataFrame, min_words: int) -> DataFrame:
    """(v, place, doc, h1): the line itself at place -1, and each variant that lacks the word at place >= 0.

    Lines of fewer than ``min_words`` words give themselves only.
    """

    def emit(part: pa.RecordBatch) -> pa.RecordBatch:
        raw = part.column(3)
        word = np.frombuffer(b"".join(raw.to_pylist()), np.uint64)
        size = np.asarray(pa.compute.binary_length(raw)).astype(np.int64) // 8
        end = np.cumsum(size)
        begin = end - size
        running = _running(word)
        line = np.repeat(np.arange(len(size)), size)
        place = np.flatnonzero(size[line] >= min_words)
        line = line[place]
        with np.errstate(over="ignore"):
            sums = _poly(running, begin[line], place) + _poly_shifted(running, place + 1, end[line], begin[line])
        lacking = _finish(sums, size[line] - 1)
        whole = _finish(_poly(running, begin, end), size)
        which = np.concatenate([np.arange(len(size)), line])
        return pa.RecordBatch.from_arrays(
            [
                _signed(np.concatenate([whole, lacking])),
                pa.array(np.concatenate([np.full(len(size), -1), place - begin[line]])),
                *[part.column(k).take(pa.array(which)) for k in range(2)],
            ],
            names=["v", "place", "doc", "h1"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                yield emit(batch.slice(k, 500))

    return near.mapInArrow(run, "v long, place long, doc long, h1 long")


def _poly_shifted(running: np.ndarray, begin: np.ndarray, end: np.ndarray, origin: np.ndarray) -> np.ndarray:
    """The words from begin to end as they count once a word before them is left out of the line at ``origin``."""
    _, inverse = powers(len(running) + 2)
    with np.errstate(over="ignore"):
        return (running[end] - running[begin]) * inverse[origin + 1]


def within_one(a: np.ndarray, b: np.ndarray) -> bool:
    """Edit distance of at most one between two word sequences."""
    if abs(len(a) - len(b)) > 1:
        return False
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[:n] != b[:n])
    if not len(differ):
        return True
    p = int(differ[0])
    if len(a) == len(b):
        return bool((a[p + 1 :] == b[p + 1 :]).all())
    longer, shorter = (a, b) if len(a) > len(b) else (b, a)
    return bool((longer[p + 1 :] == shorter[p:]).all())


def _verified(links: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            ok = [within_one(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in zip(a, b)]
            yield batch.select(["h1", "h2"]).filter(pa.array(ok, pa.bool_()))

    return links.mapInArrow(run, "h1 long, h2 long")


def near_dropped(docs: DataFrame, first: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(h1, h2) of distinct lines that an earlier document has with one word edited.

    ``docs``: doc, low (lower-cased text); ``first``: distinct lines with the document that has them first.
    """
    keyed = first.where("k3 is not null").select(
        "first", "h1", "h2", F.col("k1").isNotNull().alias("enough"), F.explode(F.array("k1", "k2", "k3", "k4")).alias("key")
    )
    keyed = keyed.where("key is not null")
    sides = keyed.groupBy("key").agg(F.min("h1").alias("x"), F.max("h1").alias("y"), F.max("enough").alias("enough"))
    shared = stored(sides.where("x <> y and enough").select("key"), "halves")
    wanted = stored(keyed.join(shared, "key").select("first", "h1", "h2").distinct(), "wanted-lines")
    # A filter of fixed size keeps most other lines out of the join; the join decides.
    passed = _near_lines(docs, _line_filter(wanted), min_words)
    own = wanted.withColumnRenamed("first", "doc")
    near = stored(passed.join(own, ["doc", "h1", "h2"]).dropDuplicates(["h1", "h2"]), "near-lines")
    variants = _variants(near, min_words)
    line = F.struct("doc", "h1")
    # The earliest line of each (variant, place); then, for each variant, the earliest as itself and by leaving a word out.
    by_place = stored(
        variants.groupBy("v", "place").agg(F.min(line).alias("best"), F.max(line).alias("worst")), "variants"
    )
    crossing = stored(
        by_place.groupBy("v")
        .agg(
            F.min(F.when(F.col("place") < 0, F.col("best"))).alias("itself"),
            F.min(F.when(F.col("place") >= 0, F.col("best"))).alias("lacking"),
        )
        .where("itself is not null and lacking is not null"),
        "crossings",
    )
    rows = _variants(near.where(F.octet_length("words") >= 8 * min_words), min_words)
    same = (
        rows.join(by_place.where("place >= 0 and best < worst").select("v", "place", "best"), ["v", "place"])
        .select("doc", "h1", "best")
    )
    cross = rows.join(crossing, "v").select(
        "doc", "h1", F.when(F.col("place") < 0, F.col("lacking")).otherwise(F.col("itself")).alias("best")
    )
    links = (
        same.union(cross).where("best.doc < doc").groupBy("h1").agg(F.min("best").alias("best"))
        .select("h1", F.col("best.h1").alias("p1"))
    )
    left = near.select("h1", "h2", F.col("words").alias("a"))
    right = near.select(F.col("h1").alias("p1"), F.col("words").alias("b"))
    return _verified(stored(links, "line-links").join(left, "h1").join(right, "p1").select("h1", "h2", "a", "b"))


def _rebuild(joined: DataFrame, columns: list[str], schema) -> DataFrame:
    """Text without its dropped lines; the last two columns are the lower-cased text and the hashes to drop."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.select(columns)
            text = own.column(columns.index("text"))
            low, drop = batch.column("__low"), batch.column("__drop")
            texts: list = [None] * batch.num_rows
            had, gone = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for first, data, offsets in byte_slices(low):
                n = len(offsets) - 1
                lines = _Lines(data, offsets)
                wanted = drop.slice(first, n)
                flat = np.asarray(wanted.flatten()).view(np.uint64)
                sizes = np.asarray(wanted.value_lengths().fill_null(0))
                pairs = mix(flat ^ mix(np.repeat(np.arange(n), sizes).astype(np.uint64) + _TAG))
                mine = mix(lines.one ^ mix(lines.row.astype(np.uint64) + _TAG))
                out = ~lines.first_in_row() | np.isin(mine, pairs)
                had[first : first + n] = np.bincount(lines.row, minlength=n)
                gone[first : first + n] = np.bincount(lines.row[out], minlength=n)
                dropped: dict[int, set[int]] = {}
                for r, k in zip(lines.row[out].tolist(), lines.number[out].tolist()):
                    dropped.setdefault(r, set()).add(k)
                for r, numbers in dropped.items():
                    kept = [x for k, x in enumerate(text[first + r].as_py().split("\n")) if k not in numbers]
                    texts[first + r] = "\n".join(kept)
            new = pa.array(texts, pa.string())
            text = pa.compute.if_else(pa.array(gone > 0), new, text.cast(pa.string()))
            arrays = [text if c == "text" else own.column(k) for k, c in enumerate(columns)]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(had), pa.array(gone)], names=[*columns, "n_lines", "n_removed"])

    return joined.mapInArrow(run, schema)


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with repeated lines removed from text, and n_lines (lines with a word) and n_removed."""
    docs = docs.drop("n_lines", "n_removed").withColumn("text", F.col("text").cast("string"))
    place = F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST))
    narrow = docs.select(place.alias("doc"), F.lower("text").alias("low"))
    lines = stored(_line_table(narrow, min_words), "lines")
    first = stored(
        lines.groupBy("h1", "h2").agg(
            F.min("doc").alias("first"), F.max("doc").alias("last"), *[F.max(k).alias(k) for k in ("k1", "k2", "k3", "k4")]
        ),
        "distinct-lines",
    )
    near = stored(near_dropped(narrow, first, min_words).distinct(), "near-dropped")
    gone = stored(
        first.select("h1", "h2", "first", "last").join(near.withColumn("near", F.lit(True)), ["h1", "h2"], "left")
        .where("near or first < last").select("h1", "h2", "first", F.coalesce("near", F.lit(False)).alias("near")),
        "dropped-lines",
    )
    per_doc = (
        lines.select("doc", "h1", "h2").join(gone, ["h1", "h2"]).where("near or doc > first")
        .groupBy("doc").agg(F.collect_set("h1").alias("__drop"))
    )
    columns = docs.columns
    joined = docs.withColumn("__place", place).join(per_doc, F.col("__place") == F.col("doc"), "left")
    joined = joined.select(*[docs[c] for c in columns], F.lower(docs["text"]).alias("__low"), "__drop")
    schema = docs.withColumns({"n_lines": F.lit(0).cast("long"), "n_removed": F.lit(0).cast("long")}).schema
    return _rebuild(joined, columns, schema)
