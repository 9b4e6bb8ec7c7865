"""Packing of tokenised documents into windows by an order-preserving dynamic programme.

Documents stay in the order in which their partition holds them, so nothing is shuffled and each
partition packs on its own. Possible cuts are the ends of documents and sentences; stretches
without one get further places every ``FREE_STEP`` tokens at a higher price. With candidate places
``p`` the cheapest way to end a window at ``p_j`` is

    f(j) = price(j) + WINDOW + min over i of f(i) + padding(p_j - p_i),   p_j - p_i <= 1024

where padding is 1024 - length, or nothing when the length is a power of two. The first form is
``1024 - p_j + min(f(i) + p_i)`` over a sliding range, kept by a monotone queue; the second looks
at one place for each power.

Nulls and empty texts are documents of the end id alone. Rows with equal or null ids are packed as
separate documents. Texts longer than a window are split over several. An empty table gives no rows.
Token ids need four bytes each for about ``SEGMENT`` tokens at a time.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .buffers import byte_slices
from .tokens import SLICE, PieceEncoder

LIMIT = 1024
SEGMENT = 300_000
FREE_STEP = 32
# Prices in tokens of padding.
WINDOW = 24.0
SENTENCE_CUT = 4.0
FREE_CUT = 8.0

SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
)
_STOPS = np.isin(np.arange(256), np.frombuffer(b".!?", np.uint8))


def places(total: int, doc_ends: np.ndarray, sentence_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Candidate cuts 0 < p <= total in ascending order with their prices."""
    flag = np.zeros(total + 1, bool)
    flag[0] = flag[total] = True
    for ends in (sentence_ends, doc_ends):
        flag[ends[(ends >= 0) & (ends <= total)]] = True
    firm = np.flatnonzero(flag)
    gaps = np.diff(firm)
    for i in np.flatnonzero(gaps > 2 * FREE_STEP):
        flag[firm[i] + FREE_STEP : firm[i + 1] : FREE_STEP] = True
    flag[0] = False
    at = np.flatnonzero(flag)
    all_prices = np.full(total + 1, FREE_CUT)
    all_prices[sentence_ends[(sentence_ends >= 0) & (sentence_ends <= total)]] = SENTENCE_CUT
    all_prices[doc_ends[(doc_ends >= 0) & (doc_ends <= total)]] = 0.0
    price = all_prices[at]
    return at, price


def best_cuts(total: int, at: np.ndarray, price: np.ndarray, last: bool = True) -> list[int]:
    """Ends of the windows of the cheapest packing of ``total`` tokens."""
    where = [-1] * (total + 1)
    where[0] = 0
    points = [0, *at.tolist()]
    for j, p in enumerate(points):
        where[p] = j
    cost, back = [0.0] * len(points), [0] * len(points)
    queue: deque[tuple[float, int]] = deque([(0.0, 0)])
    powers = [1 << k for k in range(10)] if last else [512, 256, 128]  # 1024 has no padding anyway
    prices = [0.0, *price.tolist()]
    for j in range(1, len(points)):
        p = points[j]
        while queue and points[queue[0][1]] < p - LIMIT:
            queue.popleft()
        value, i = queue[0]
        value += LIMIT - p
        for width in powers:
            if width > p:
                continue
            k = where[p - width]
            if k >= 0 and cost[k] < value:
                value, i = cost[k], k
        value += WINDOW + prices[j]
        cost[j], back[j] = value, i
        value += p
        while queue and queue[-1][0] >= value:
            queue.pop()
        queue.append((value, j))
    cuts, j = [], len(points) - 1
    while j:
        cuts.append(points[j])
        j = back[j]
    return cuts[::-1]


class _Packer:
    """Documents waiting to be packed, as one run of ids."""

    def __init__(self, first_sequence: int):
        self.sequence = first_sequence
        self.ids: list[np.ndarray] = []
        self.docs: list[np.ndarray] = []  # rows (index into keys, start, end) relative to the run
        self.keys: list = []
        self.marks: list[np.ndarray] = []
        self.total = 0

    def add(self, keys: list, ids: np.ndarray, bounds: np.ndarray, marks: np.ndarray) -> None:
        base = len(self.keys)
        self.keys += keys
        self.docs.append(
            np.stack([np.arange(base, base + len(keys)), bounds[:-1] + self.total, bounds[1:] + self.total], 1)
        )
        self.ids.append(ids)
        self.marks.append(marks + self.total)
        self.total += int(bounds[-1])

    def flush(self, last: bool) -> pa.RecordBatch | None:
        if not self.total:
            return None
        ids, docs, marks = np.concatenate(self.ids), np.concatenate(self.docs), np.concatenate(self.marks)
        at, price = places(self.total, docs[:, 2], marks)
        cuts = np.array(best_cuts(self.total, at, price, last))
        if not last:
            cuts = cuts[cuts <= self.total - 2 * LIMIT]
        if not len(cuts):
            self.ids, self.docs, self.marks = [ids], [docs], [marks]
            return None
        done = int(cuts[-1])
        ends = docs[:, 2]
        flag = np.zeros(done + 1, bool)
        flag[0] = flag[cuts] = flag[ends[ends <= done]] = True
        edges = np.flatnonzero(flag)
        begin, end = edges[:-1], edges[1:]
        doc = np.searchsorted(ends, begin, "right")
        window = np.searchsorted(cuts, begin, "right")
        from_window = begin - np.concatenate([[0], cuts])[window]
        raw = memoryview(ids.astype("<u4").tobytes())
        crc = [zlib.crc32(raw[4 * b : 4 * e]) for b, e in zip(begin.tolist(), end.tolist())]
        out = pa.RecordBatch.from_arrays(
            [
                pa.array([self.keys[k] for k in docs[doc, 0].tolist()], pa.int64()),
                pa.array(begin - docs[doc, 1]),
                pa.array(end - begin),
                pa.array(crc, pa.int64()),
                pa.array(docs[doc, 2] - docs[doc, 1]),
                pa.array(window + self.sequence),
                pa.array(from_window),
            ],
            names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
        )
        self.sequence += len(cuts)
        rest = docs[ends > done]
        self.keys = [self.keys[k] for k in rest[:, 0].tolist()]
        rest = rest - done
        rest[:, 0] = np.arange(len(rest))
        self.ids, self.docs, self.marks = [ids[done:]], [rest], [marks[marks > done] - done]
        self.total -= done
        return out


def pack(docs: DataFrame, vocabulary: str, end_id: int = 0) -> DataFrame:
    """One row per piece: where it stands in its document and in its sequence.

    Order is kept within a partition; a partition's last window is the only one that the packing of
    a larger partition would have filled further.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = PieceEncoder(vocabulary)
        packer = _Packer(TaskContext.get().partitionId() << 40)
        for batch in batches:
            for first, data, offsets in byte_slices(batch.column(1), SLICE):
                n = len(offsets) - 1
                ids, row, starts, ends, sizes = encoder.encode(data, offsets)
                per_row = np.bincount(row, sizes, n).astype(np.int64) if len(row) else np.zeros(n, np.int64)
                bounds = np.concatenate([[0], np.cumsum(per_row + 1)])
                with_end = np.full(int(bounds[-1]), end_id, np.uint32)
                token_end = np.cumsum(sizes) + row  # place after each piece, one end id for each earlier row
                hold = np.ones(len(with_end), bool)
                hold[bounds[1:] - 1] = False
                with_end[hold] = ids
                stop = _STOPS[data[ends - 1]] if len(ends) else np.zeros(0, bool)
                line = data[starts] == 10 if len(starts) else stop
                marks = np.concatenate([token_end[stop], (token_end - sizes)[line]]).astype(np.int64)
                packer.add(batch.column(0).slice(first, n).to_pylist(), with_end, bounds, marks)
                if packer.total >= SEGMENT and (out := packer.flush(False)) is not None:
                    yield out
        if (out := packer.flush(True)) is not None:
            yield out

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, SCHEMA
    )
