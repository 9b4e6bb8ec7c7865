"""Splitting and hashing of UTF-8 text columns as flat byte buffers.

A batch of texts is one byte array plus row offsets. Words get 64-bit hashes from running sums
over the bytes, so no Python object is made per word. Memory is about forty times ``limit`` bytes
for every slice, whatever the size of the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1_000_000

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
# ASCII signs other than the apostrophe: no pattern joins one to a letter before it.
_SIGN = np.zeros(256, bool)
_SIGN[np.frombuffer(b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~", np.uint8)] = True
_LETTER = np.zeros(256, bool)
_LETTER[ord("A") : ord("Z") + 1] = _LETTER[ord("a") : ord("z") + 1] = True
_GOLD = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD1342543DE82EF95  # odd, so it has an inverse modulo 2**64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _GOLD)
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """``BASE**i`` and its inverse for i < n, kept per process and grown on demand."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, SLICE_BYTES + 1)
        out = []
        for base in (_BASE, pow(_BASE, -1, 2**64)):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            with np.errstate(over="ignore"):
                np.multiply.accumulate(table, out=table)
            out.append(table)
        _powers[:] = out
    return _powers[0], _powers[1]


def byte_slices(texts: pa.Array | pa.ChunkedArray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of consecutive row ranges of at most ``limit`` bytes or one row; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        end = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
        end = min(max(end, at + 1), len(texts))
        yield at, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def _row_of(offsets: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.searchsorted(offsets, starts, "right") - 1


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, row) of the runs of bytes other than ASCII white space."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    inside = ~_SPACE[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    full = offsets[:-1] < offsets[1:]
    head, tail = offsets[:-1][full], offsets[1:][full] - 1
    first[head], last[tail] = inside[head], inside[tail]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, _row_of(offsets, starts)


def chunks(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, row) of pieces that cover the text: white space, then what follows up to white space.

    Texts are cut only before ASCII white space whose predecessor is no white space of any kind, and
    between a letter (ASCII, or of the Latin-1 block) and an ASCII sign other than the apostrophe. No
    pre-token of the public patterns spans such a place, and none looks back over it, so encoding the
    pieces one by one gives the ids of the whole text.
    """
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    space = _SPACE[data]
    cut = space.copy()
    cut[1:] &= ~space[:-1]
    cut[0] = True
    at = np.flatnonzero(cut)
    at = at[at > 2]
    high = at[data[at - 1] >= 0x80]
    one, two, three = data[high - 1], data[high - 2], data[high - 3]
    odd = (two == 0xC2) & ((one == 0x85) | (one == 0xA0))
    odd |= (three == 0xE2) & ((two == 0x80) | (two == 0x81))
    odd |= ((three == 0xE1) & (two == 0x9A)) | ((three == 0xE3) & (two == 0x80))
    cut[high[odd]] = False
    sign = np.flatnonzero(_SIGN[data])
    sign = sign[sign > 2]
    one, two = data[sign - 1], data[sign - 2]
    cut[sign[_LETTER[one] | ((two == 0xC3) & (one >= 0x80) & (one != 0x97) & (one != 0xB7))]] = True
    cut[1:3] = False  # too near the start to look back
    cut[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
    starts = np.flatnonzero(cut)
    return starts, np.append(starts[1:], len(data)), _row_of(offsets, starts)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte range; equal bytes give equal hashes wherever they stand."""
    power, inverse = powers(len(data) + 1)
    with np.errstate(over="ignore"):
        running = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE[data] * power[: len(data)], out=running[1:])
        sums = (running[ends] - running[starts]) * inverse[starts]
        return mix(sums + (ends - starts).astype(np.uint64) * _GOLD)


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The concatenation of ``arange(start, start + size)``."""
    total = int(sizes.sum())
    before = np.cumsum(sizes) - sizes
    return np.repeat(starts - before, sizes) + np.arange(total)
