"""Near-duplicate documents by ProbMinHash signatures, banding and verification on the weighted shingle sets.

A document is the set of its five-word shingles (lower-cased words between ASCII white space; with
fewer than five words, all of them are one shingle). Each has a weight that its words alone decide, however often it
occurs: ``weigh_by_length`` takes the number of binary digits of its bytes, ``weigh_equal`` takes one. Each shingle
is a Poisson process whose rate is its weight: its arrivals come at seeded exponential gaps, each falls
into one of 256 registers, and a register keeps the shingle that arrived first. Rounds go on only
with shingles that can still arrive before the latest register; that is the early termination. Two
registers agree with the probability Jaccard similarity of the documents. As a shingle weighs the same in every
document, that is exactly the weight of the common shingles over the weight of all shingles of both, so candidates,
``CUT`` and links are on one measure, a repeated line changes nothing, and the distance obeys the triangle inequality.

Documents are linked if this similarity is at least ``SIMILARITY``. Equal
word sequences are joined first, by hash. The others get forty bands of eight registers. In a band's
bucket

1. the pivot is the member with the least hashed id, so neighbouring buckets tend to have the same one; each
   document is verified against the pivot it shares most buckets with, and verified links are turned into components;
2. then all members in different components are compared by signature, in blocks; members of a pair that the
   signature does not exclude (``CUT``, four standard errors below) are sent once more with their shingle
   sets, and pairs are verified inside the block. A block yields a link for every component that it joins to
   another, at most its size; no table of pairs is made.

Pairs inside a component need no comparison, so a bucket of close copies costs its size, not its square,
and no link between different components is lost. Buckets above ``BLOCK`` members are first split by further
registers; links found there merge components and decide nothing else. Then every bucket that still holds several
components is compared whole, the large ones in pairs of blocks over several tasks. Members of a large bucket's
largest component are not blocked against each other, so one stranger in it costs its size, not its square.

Null, empty and wordless texts are compared with nothing: each is its own group. Rows that share a doc_id
are one document and stay or go together; rows without one are groups of their own (component null, kept).
An empty table gives no rows. Ties go to the smallest doc_id.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .buffers import byte_slices, mix, powers, ranges, span_hashes, words
from .components import components
from .shared import stored

WORDS = 5
SIMILARITY = 0.8
REGISTERS = 256
BANDS, ROWS = 40, 8
CUT = 0.70
BLOCK = 1_500
SET_SIZE = 2_000  # shingles that count as one member of a block
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_ONE = np.uint64(1)


def weigh_equal(n_bytes: np.ndarray) -> np.ndarray:
    """One for every shingle: links are on the plain Jaccard similarity of the sets."""
    return np.ones(len(n_bytes), np.int64)


def weigh_by_length(n_bytes: np.ndarray) -> np.ndarray:
    """Number of binary digits of the bytes in a shingle's words: long words say more than short ones, and none dominates."""
    return np.frexp(n_bytes.astype(np.float64))[1].astype(np.int64)


Weigh = Callable[[np.ndarray], np.ndarray]


def shingles(data: np.ndarray, offsets: np.ndarray, weigh: Weigh = weigh_equal) -> tuple[np.ndarray, ...]:
    """(row, hash, weight) of every shingle in a byte slice, and two hashes of each row's word sequence."""
    n = len(offsets) - 1
    starts, ends, row = words(data, offsets)
    word = span_hashes(data, starts, ends)
    per_row = np.bincount(row, minlength=n) if len(row) else np.zeros(n, np.int64)
    end = np.cumsum(per_row)
    begin = end - per_row
    power, inverse = powers(len(word) + 2)
    n_bytes = np.append(0, np.cumsum(ends - starts))  # of all words before a place
    with np.errstate(over="ignore"):
        whole = []
        for tag in (np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)):
            running = np.zeros(len(word) + 1, np.uint64)
            np.cumsum(mix(word ^ tag) * power[: len(word)], out=running[1:])
            whole.append(mix((running[end] - running[begin]) * inverse[begin] + per_row.astype(np.uint64) * _GOLD))
        count = np.maximum(per_row - WORDS + 1, 0)
        if len(word) >= WORDS:
            at = np.arange(len(word) - WORDS + 1)
            at = at[row[at] == row[at + WORDS - 1]]
            gram = np.zeros(len(at), np.uint64)
            for k in range(WORDS):
                gram = mix(gram * _GOLD + word[at + k])
            of = row[at]
        else:
            gram, of, at = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        short = np.flatnonzero((per_row > 0) & (count == 0))
        gram = np.concatenate([gram, whole[0][short]])
        of = np.concatenate([of, short])
    size = np.concatenate([n_bytes[at + WORDS] - n_bytes[at], n_bytes[end[short]] - n_bytes[begin[short]]])
    return of, gram, weigh(size), whole[0], whole[1]


def distinct_shingles(of: np.ndarray, gram: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash, weight) of the different shingles of each row."""
    code, distinct = pd.factorize(mix(gram ^ mix(of.astype(np.uint64) + _GOLD)))
    at = np.zeros(len(distinct), np.int64)
    at[code] = np.arange(len(code))
    return of[at], gram[at], weight[at]


def prob_min_hash(of: np.ndarray, gram: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """Signatures (n x REGISTERS bytes) of rows of weighted elements; rows without one stay zero."""
    when = np.full(n * REGISTERS, np.inf)
    who = np.zeros(n * REGISTERS, np.uint64)
    latest = np.full(n, np.inf)
    live = np.arange(len(gram))
    clock = np.zeros(len(gram))
    step = 0
    with np.errstate(over="ignore"):
        while len(live):
            several = int(min(max(40_000 // len(live), 1), 64))
            tick = (np.arange(step, step + several, dtype=np.uint64) * np.uint64(2) + _ONE) * _GOLD
            seed = gram[live][:, None]
            gap = -np.log(((mix(seed + tick) >> np.uint64(11)) + _ONE) * 2.0**-53) / weight[live][:, None]
            time = clock[live][:, None] + np.cumsum(gap, 1)
            clock[live] = time[:, -1]
            slot = of[live][:, None] * REGISTERS + (mix(seed + tick + _GOLD) >> np.uint64(56)).astype(np.int64)
            time, slot, source = time.ravel(), slot.ravel(), np.repeat(gram[live], several)
            early = time < latest[slot // REGISTERS]
            time, slot, source = time[early], slot[early], source[early]
            np.minimum.at(when, slot, time)
            won = time == when[slot]
            who[slot[won]] = source[won]
            rows = np.unique(of[live])
            latest[rows] = when.reshape(n, REGISTERS)[rows].max(1)
            live = live[clock[live] < latest[of[live]]]
            step += several
    return (mix(who) & np.uint64(255)).astype(np.uint8).reshape(n, REGISTERS)


def signatures(docs: DataFrame, weigh: Weigh = weigh_equal) -> DataFrame:
    """Of the documents with a word: h1, h2 (the word sequence), signature, number and total weight of shingles; ``docs``: doc, low."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.asarray(batch.column(0))
            for first, data, offsets in byte_slices(batch.column(1), 1_000_000):
                n = len(offsets) - 1
                of, gram, weight, one, two = shingles(data, offsets, weigh)
                of, gram, weight = distinct_shingles(of, gram, weight)
                size = np.bincount(of, minlength=n)
                total = np.bincount(of, weight, n).astype(np.int64)
                some = size > 0
                signature = prob_min_hash(of, gram, weight, n)[some]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids[first : first + n][some]),
                        pa.array(one[some].view(np.int64)),
                        pa.array(two[some].view(np.int64)),
                        pa.array([s.tobytes() for s in signature], pa.binary()),
                        pa.array(size[some]),
                        pa.array(total[some]),
                    ],
                    names=["doc", "h1", "h2", "sig", "size", "total"],
                )

    return docs.mapInArrow(run, "doc long, h1 long, h2 long, sig binary, size long, total long")


def _orders() -> np.ndarray:
    """Registers of every band: two passes over shuffled registers."""
    seeds = np.arange(2 * REGISTERS, dtype=np.uint64) * _GOLD
    with np.errstate(over="ignore"):
        first, second = np.argsort(mix(seeds[:REGISTERS])), np.argsort(mix(seeds[REGISTERS:]))
    return np.concatenate([first, second])[: BANDS * ROWS]


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, REGISTERS)


def bands(reps: DataFrame) -> DataFrame:
    """(key, id) of each band of each signature; ``reps``: id, sig."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = _orders()
        band = (np.arange(BANDS, dtype=np.uint64) + _ONE) * _GOLD
        for batch in batches:
            if batch.num_rows:
                parts = np.ascontiguousarray(_matrix(batch.column(1))[:, order]).view(np.uint64)
                with np.errstate(over="ignore"):
                    key = mix(mix(parts) + band)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key.ravel().view(np.int64)), pa.array(np.repeat(np.asarray(batch.column(0)), BANDS))],
                    names=["key", "id"],
                )

    return reps.mapInArrow(run, "key long, id long")


def shingle_sets(docs: DataFrame, weigh: Weigh = weigh_equal) -> DataFrame:
    """(doc, grams, weights): the sorted 64-bit hashes of each document's different shingles, and their 32-bit weights."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for first, data, offsets in byte_slices(batch.column(1), 1_000_000):
                of, gram, weight = distinct_shingles(*shingles(data, offsets, weigh)[:3])
                order = np.lexsort((gram, of))
                edge = np.searchsorted(of[order], np.arange(len(offsets)))
                spans = list(zip(edge[:-1], edge[1:]))
                gram, weight = gram[order], weight[order].astype(np.uint32)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(first, len(offsets) - 1),
                        pa.array([gram[b:e].tobytes() for b, e in spans], pa.binary()),
                        pa.array([weight[b:e].tobytes() for b, e in spans], pa.binary()),
                    ],
                    names=["doc", "grams", "weights"],
                )

    return docs.mapInArrow(run, "doc long, grams binary, weights binary")


def similar(common: np.ndarray, a: np.ndarray, b: np.ndarray, similarity: float) -> np.ndarray:
    """Whether sets of total weights a and b with the weight ``common`` in both reach the similarity."""
    return common >= similarity * (a + b - common) - 1e-9


def verified(pairs: DataFrame, sets: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The pairs (a, b) whose shingle sets are similar enough."""

    def reaches(a: bytes, a_weights: bytes, b: bytes, b_weights: bytes) -> bool:
        x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
        v, w = np.frombuffer(a_weights, np.uint32), np.frombuffer(b_weights, np.uint32)
        at = np.minimum(np.searchsorted(y, x), len(y) - 1)
        common = v[y[at] == x].sum(dtype=np.int64)
        return bool(similar(common, v.sum(dtype=np.int64), w.sum(dtype=np.int64), similarity))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = zip(*(batch.column(k).to_pylist() for k in (2, 3, 4, 5)))
            yield batch.select(["a", "b"]).filter(pa.array([reaches(*row) for row in found], pa.bool_()))

    left = sets.select(F.col("doc").alias("a"), F.col("grams").alias("x"), F.col("weights").alias("v"))
    right = sets.select(F.col("doc").alias("b"), F.col("grams").alias("y"), F.col("weights").alias("w"))
    joined = pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "x", "v", "y", "w")
    return joined.mapInArrow(run, "a long, b long")


def _deeper(members: DataFrame, depth: int) -> DataFrame:
    """Members of large buckets, six times each, keyed by eight more registers; ``bucket`` stays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            order = np.argsort(mix(np.arange(REGISTERS, dtype=np.uint64) + np.uint64(977 * depth)))[: 6 * ROWS]
        tag = (np.arange(6, dtype=np.uint64) + np.uint64(100 * depth + 1)) * _GOLD
        for batch in batches:
            if batch.num_rows:
                parts = np.ascontiguousarray(_matrix(batch.column(4))[:, order]).view(np.uint64)
                with np.errstate(over="ignore"):
                    key = mix(mix(parts) + tag + np.asarray(batch.column(0)).view(np.uint64)[:, None])
                take = pa.array(np.repeat(np.arange(batch.num_rows), 6))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key.ravel().view(np.int64)), *[batch.column(k).take(take) for k in range(1, 7)]],
                    names=["key", "bucket", "id", "c", "sig", "total", "load"],
                )

    own = members.select("key", "bucket", "id", "c", "sig", "total", "load")
    return own.mapInArrow(run, "key long, bucket long, id long, c long, sig binary, total long, load long")


def _sized(members: DataFrame) -> DataFrame:
    """Members of buckets that hold more than one component, with the bucket's load as n."""
    groups = members.groupBy("key").agg(F.sum("load").alias("n"), F.min("c").alias("x"), F.max("c").alias("y"))
    return members.join(stored(groups.where("x <> y").select("key", "n"), "buckets"), "key")


_GROUPED = "key long, bucket long, side long, id long, c long, sig binary, total long"


def _by_group(rows: DataFrame, work: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """``work`` on the rows of each key, which meet in one task; only whole groups and one batch are held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: pa.Table | None = None

        def groups(table: pa.Table) -> Iterator[pa.RecordBatch]:
            key = np.asarray(table.column(0).combine_chunks())
            edge = np.append(np.flatnonzero(np.append(True, key[1:] != key[:-1])), len(key))
            done = [work(table.slice(b, e - b).combine_chunks()) for b, e in zip(edge[:-1].tolist(), edge[1:].tolist())]
            yield from pa.concat_tables(done).combine_chunks().to_batches()

        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            waiting = table if waiting is None else pa.concat_tables([waiting, table])
            key = np.asarray(waiting.column(0).combine_chunks())
            last = int(np.searchsorted(key, key[-1]))
            if last:
                yield from groups(waiting.slice(0, last))
                waiting = waiting.slice(last)
        if waiting is not None:
            yield from groups(waiting)

    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(run, schema)


def _column(table: pa.Table, name: str) -> np.ndarray:
    return np.asarray(table.column(name).combine_chunks())


def _candidates(table: pa.Table, similarity: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (p, q) in a group of members with different components that nothing excludes.

    Side 2 marks a group compared within itself; otherwise side 0 is compared with side 1. ``bucket`` is the
    band's bucket that the group is a part of; a pair is left to the bucket of the first band in which its
    members meet. Total weights exclude pairs exactly, signatures by ``CUT``.
    """
    order = _orders()
    band = (np.arange(BANDS, dtype=np.uint64) + _ONE) * _GOLD
    bucket, side, ids, comp, total = (_column(table, k) for k in ("bucket", "side", "id", "c", "total"))
    sig = _matrix(table.column("sig").combine_chunks())

    def here(p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Whether the first band in which the signatures agree is the one of this bucket."""
        x = np.ascontiguousarray(sig[p][:, order]).view(np.uint64)
        y = np.ascontiguousarray(sig[q][:, order]).view(np.uint64)
        first = (x == y).argmax(1)
        with np.errstate(over="ignore"):
            own = mix(mix(x[np.arange(len(x)), first]) + band[first])
        return own.view(np.int64) == bucket[p]

    left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
    for k in range(0, len(left), 64):
        some = left[k : k + 64]
        a, b = np.nonzero(comp[some][:, None] != comp[right][None, :])
        a, b = some[a], right[b]
        keep = ids[a] < ids[b] if len(left) == len(table) else ids[a] != ids[b]
        keep &= np.minimum(total[a], total[b]) >= similarity * np.maximum(total[a], total[b]) - 1e-9
        a, b = a[keep], b[keep]
        for j in range(0, len(a), 20_000):
            p, q = a[j : j + 20_000], b[j : j + 20_000]
            near = (sig[p] == sig[q]).mean(1) >= CUT
            p, q = p[near], q[near]
            first = here(p, q)
            yield p[first], q[first]


def _found_links(table: pa.Table, similarity: float) -> pa.Table:
    """The links that join components of a group: one for each component that is joined to another, never all pairs.

    A pair is verified on its sets unless its members have met already, or their distances to one member (the
    one in most pairs) differ by more than a link allows: the distance obeys the triangle inequality.
    """
    found = [*_candidates(table, similarity), (np.zeros(0, np.int64),) * 2]
    p, q = (np.concatenate(side) for side in zip(*found))
    ids, total = _column(table, "id"), _column(table, "total")
    label = np.unique(_column(table, "c"), return_inverse=True)[1]
    links: list[tuple[int, int]] = []
    if len(p):
        grams = table.column("grams").to_pylist()
        size = np.array([len(g) // 8 for g in grams], np.int64)
        code = np.unique(np.frombuffer(b"".join(grams), np.uint64), return_inverse=True)[1]
        weight = np.frombuffer(b"".join(table.column("weights").to_pylist()), np.uint32)
        start = np.cumsum(size) - size
        inside = np.zeros(int(code.max()) + 1, np.int64)

        def common(one: int, others: np.ndarray) -> np.ndarray:
            own = slice(start[one], start[one] + size[one])
            inside[code[own]] = weight[own]
            out = np.zeros(len(others), np.int64)
            for k in range(0, len(others), 256):
                part = others[k : k + 256]
                ends = np.cumsum(size[part])
                out[k : k + 256] = np.add.reduceat(inside[code[ranges(start[part], size[part])]], ends - size[part])
            inside[code[own]] = 0
            return out

        if len(p) > len(ids):
            pivot = int(np.bincount(np.concatenate([p, q])).argmax())
            shared = common(pivot, np.arange(len(ids)))
            far = 1 - shared / (total[pivot] + total - shared)
            keep = np.abs(far[p] - far[q]) <= 1 - similarity + 1e-9
            p, q = p[keep], q[keep]
        order = np.argsort(p, kind="stable")
        p, q = p[order], q[order]
        edge = np.flatnonzero(np.append(True, p[1:] != p[:-1])) if len(p) else np.zeros(0, np.int64)
        for b, e in zip(edge.tolist(), [*edge[1:].tolist(), len(p)]):
            one, others = int(p[b]), q[b:e]
            others = others[label[others] != label[one]]
            if not len(others):
                continue
            near = others[similar(common(one, others), total[one], total[others], similarity)]
            joined, at = np.unique(label[near], return_index=True)
            links += [(int(ids[one]), int(ids[near[k]])) for k in at]
            label[np.isin(label, joined)] = label[one]
    a, b = (np.array(links, np.int64).reshape(-1, 2)).T
    return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})


def _cross_links(members: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Links between members of a group with different components; rows are those of ``_GROUPED``.

    First the members of any pair that the signatures leave open are marked, then only they are sent again with
    their shingle sets. Neither pass writes a pair but the links that it found.
    """

    def mark(table: pa.Table) -> pa.Table:
        open_ = np.zeros(len(table), bool)
        for p, q in _candidates(table, similarity):
            open_[p] = open_[q] = True
        return table.filter(pa.array(open_))

    columns = ["key", "bucket", "side", "id", "c", "sig", "total"]
    marked = stored(_by_group(members.select(*columns), mark, _GROUPED), "open-members")
    whole = marked.join(sets.withColumnRenamed("doc", "id"), "id").select(*columns, "grams", "weights")
    return _by_group(whole, lambda table: _found_links(table, similarity), "a long, b long")


def _whole(members: DataFrame) -> DataFrame:
    return members.select("key", "bucket", F.lit(2).cast("long").alias("side"), "id", "c", "sig", "total")


def _blocks(large: DataFrame) -> DataFrame:
    """Large buckets as groups for all pairs of their blocks, except pairs within the bucket's largest component.

    A member goes once to each block that its own is compared with; blocks are cut by load.
    """
    parts = large.groupBy("key", "c").agg(F.sum("load").alias("m")).groupBy("key").agg(F.max(F.struct("m", "c")).alias("top"))
    parts = stored(parts.select("key", F.col("top.m").alias("n_top"), F.col("top.c").alias("c_top")), "largest-components")
    top, rest = F.ceil(F.col("n_top") / BLOCK), F.ceil((F.col("n") - F.col("n_top")) / BLOCK)
    at, is_top = F.xxhash64("id"), F.col("c") == F.col("c_top")
    own = F.when(is_top, F.pmod(at, top)).otherwise(top + F.pmod(at, rest))
    others = F.sequence(F.when(is_top, top).otherwise(F.lit(0).cast("long")), top + rest - 1)
    spread = large.join(parts, "key").withColumn("own", own).withColumn("other", F.explode(others))
    return spread.select(
        F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("key"),
        "bucket",
        F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1).cast("long").alias("side"),
        "id", "c", "sig", "total",
    )


def near_groups(docs: DataFrame, similarity: float = SIMILARITY, weigh: Weigh = weigh_equal) -> DataFrame:
    """(doc_id, component_id, kept) for every distinct doc_id that has words; the kept one is the smallest of its group."""
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc"), F.lower(F.col("text").cast("string")).alias("low"))
    narrow = narrow.where("doc is not null")
    seen = stored(signatures(narrow, weigh), "signatures")
    same = [F.first(k).alias(k) for k in ("sig", "size", "total")]
    reps = stored(seen.groupBy("h1", "h2").agg(F.min("doc").alias("id"), *same), "representatives")
    keyed = bands(reps.select("id", "sig"))
    first = F.min(F.struct(F.xxhash64("id").alias("h"), "id"))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n"), first.alias("first")).where("n > 1")
    sizes = stored(sizes.select("key", F.col("first.id").alias("pivot")), "buckets")
    members = stored(keyed.join(sizes, "key"), "members")
    load = F.greatest(F.lit(1), F.ceil(F.col("size") / SET_SIZE)).cast("long")
    sigs = reps.select("id", "sig", "total", load.alias("load"))

    # First, a star in each bucket.
    shared = members.where("id <> pivot").groupBy("id", "pivot").agg(F.count("*").alias("n"))
    best = (
        shared.groupBy(F.col("id").alias("a")).agg(F.max(F.struct("n", F.negative("pivot").alias("m"))).alias("top"))
        .select("a", F.negative("top.m").alias("b"))
    )
    involved = stored(members.select("id").distinct(), "involved")
    chosen = narrow.join(involved.withColumnRenamed("id", "doc"), "doc").select("doc", "low")
    sets = stored(shingle_sets(chosen, weigh).dropDuplicates(["doc"]), "shingle-sets")
    links = stored(verified(best, sets, similarity), "star-links")

    # Then whatever meets in a bucket from different components.
    def mixed_members(comp: DataFrame) -> DataFrame:
        known = involved.join(comp, "id", "left").select("id", F.coalesce("component", "id").alias("c"))
        known = stored(known.join(sigs, "id"), "known-members")
        return stored(_sized(members.select("key", F.col("key").alias("bucket"), "id").join(known, "id")), "mixed-members")

    level = mixed_members(components(links))
    large = level.where(F.col("n") > BLOCK)
    some_large = not large.isEmpty()
    if some_large:
        # Parts of large buckets only merge components here; the pass below compares all that is left.
        found = None
        for depth in (1, 2):
            deeper = stored(_sized(_deeper(large, depth)), "deeper-members")
            part = _cross_links(_whole(deeper.where(F.col("n") <= BLOCK)), sets, similarity)
            found = part if found is None else found.union(part)
            large = deeper.where(F.col("n") > BLOCK)
            if large.isEmpty():
                break
        links = stored(links.union(found), "merged-links")
        level = mixed_members(components(links))
    groups = _whole(level.where(F.col("n") <= BLOCK))
    if some_large:
        groups = groups.union(_blocks(level.where(F.col("n") > BLOCK)))
    group = stored(components(links.union(_cross_links(groups, sets, similarity))), "groups")
    rep_of = reps.select("h1", "h2", "id").join(group, "id", "left").select("h1", "h2", F.coalesce("component", "id").alias("c"))
    out = seen.select("doc", "h1", "h2").join(rep_of, ["h1", "h2"]).groupBy("doc").agg(F.min("c").alias("component_id"))
    return out.select(F.col("doc").alias("doc_id"), "component_id", (F.col("doc") == F.col("component_id")).alias("kept"))


def classes(docs: DataFrame, similarity: float = SIMILARITY, weigh: Weigh = weigh_equal) -> DataFrame:
    """One row per row of ``docs``: doc_id, component_id, kept."""
    found = near_groups(docs, similarity, weigh).select(F.col("doc_id").alias("id"), "component_id", "kept")
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    return ids.join(found, F.col("doc_id") == F.col("id"), "left").select(
        "doc_id", F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("kept", F.lit(True)).alias("kept")
    )


def keep_one_of_each(docs: DataFrame, similarity: float = SIMILARITY, weigh: Weigh = weigh_equal) -> DataFrame:
    """``docs`` without the documents that another one of their group stands for; all columns as they are."""
    gone = near_groups(docs, similarity, weigh).where("not kept").select(F.col("doc_id").alias("__gone"))
    return docs.join(gone, F.col("doc_id").cast("long") == F.col("__gone"), "left_anti")
