"""Token ids of whole texts with the tokenizers library, a distinct white-space piece at a time."""

from __future__ import annotations

import os
import re

import numpy as np
import pandas as pd

from .buffers import chunks, ranges, span_hashes

#: Pieces kept per Python worker, in about 5 bytes of ids and 20 of tables each; past it the cache starts anew,
#: which costs time and never changes ids.
CACHE_PIECES = 400_000
#: Bytes of text worked on at a time.
SLICE = 1_000_000
# A space and letters that no normaliser changes the number of: two such pieces in a row split at the space.
_PLAIN = re.compile("[ ][A-Za-zÀ-ÖØ-öø-ÿ]+")
_TOGETHER = 100


class PieceEncoder:
    """Encodes each distinct piece once per worker and looks its ids up afterwards."""

    def __init__(self, vocabulary: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.tokenizer.encode_special_tokens = True
        names = self.tokenizer.get_vocab()
        self.opens, self.closes = (np.zeros(max(names.values()) + 1, bool) for _ in range(2))
        self.opens[[i for name, i in names.items() if name.startswith("Ġ")]] = True
        self.closes[[i for name, i in names.items() if name.endswith("</w>")]] = True
        self.clear()

    def clear(self) -> None:
        self.hashes, self.slots = np.zeros(0, np.uint64), np.zeros(0, np.int64)  # by hash
        self.flat = np.zeros(1 << 16, np.uint32)
        self.offset = np.zeros((1 << 14) + 1, np.int64)
        self.have = 0

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _parts(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """An order of the pieces, their ids in that order, and how many each has.

        Plain pieces are encoded many at a time, as one text, and cut apart where a token begins with the
        space or ends a word; a run that does not come apart into as many parts is encoded piece by piece.
        """
        plain = [i for i, p in enumerate(pieces) if _PLAIN.fullmatch(p)]
        groups = [plain[k : k + _TOGETHER] for k in range(0, len(plain), _TOGETHER)]
        single = sorted(set(range(len(pieces))).difference(plain))
        order, parts, sizes = [], [], []
        for group, ids in zip(groups, self._ids(["".join([pieces[i] for i in g]) for g in groups])):
            run = np.array(ids, np.uint32)
            starts = np.flatnonzero(self.opens[run])
            if len(starts) != len(group):
                starts = np.append(0, np.flatnonzero(self.closes[run]) + 1)[:-1]
            if len(starts) == len(group) and starts[0] == 0:
                order += group
                parts.append(run)
                sizes.append(np.diff(starts, append=len(run)))
            else:
                single += group
        for i, ids in zip(single, self._ids([pieces[i] for i in single])):
            order.append(i)
            parts.append(np.array(ids, np.uint32))
            sizes.append([len(ids)])
        return np.array(order, np.int64), np.concatenate(parts), np.concatenate(sizes).astype(np.int64)

    def _add(self, hashes: np.ndarray, pieces: list[str]) -> np.ndarray:
        """Slots of new pieces."""
        order, ids, sizes = self._parts(pieces)
        have, n = self.have, len(pieces)
        while have + n >= len(self.offset):
            self.offset = np.concatenate([self.offset, np.zeros_like(self.offset)])
        begin = self.offset[have]
        self.offset[have + 1 : have + 1 + n] = begin + np.cumsum(sizes)
        end = int(self.offset[have + n])
        while end > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[begin:end] = ids
        slots = np.empty(n, np.int64)
        slots[order] = np.arange(have, have + n)
        hashes, slots_all = np.concatenate([self.hashes, hashes]), np.concatenate([self.slots, slots])
        by_hash = np.argsort(hashes, kind="stable")
        self.hashes, self.slots, self.have = hashes[by_hash], slots_all[by_hash], have + n
        return slots

    def encode(self, data: np.ndarray, offsets: np.ndarray):
        """(ids, row of each piece, start, end and ids of each piece) of the texts in a byte slice."""
        starts, ends, row = chunks(data, offsets)
        if not len(starts):
            return np.zeros(0, np.uint32), row, starts, ends, np.zeros(0, np.int64)
        code, distinct = pd.factorize(span_hashes(data, starts, ends))
        first = np.zeros(len(distinct), np.int64)
        first[code[::-1]] = np.arange(len(code) - 1, -1, -1)
        if self.have > CACHE_PIECES:
            self.clear()
        at = np.searchsorted(self.hashes, distinct)
        slots = np.full(len(distinct), -1)
        inside = np.flatnonzero(at < len(self.hashes))
        met = inside[self.hashes[at[inside]] == distinct[inside]]
        slots[met] = self.slots[at[met]]
        new = np.flatnonzero(slots < 0)
        if len(new):
            raw = data.tobytes()
            spans = zip(starts[first[new]].tolist(), ends[first[new]].tolist())
            slots[new] = self._add(distinct[new], [raw[s:e].decode("utf-8", "replace") for s, e in spans])
        begin, size = self.offset[slots], self.offset[slots + 1] - self.offset[slots]
        sizes = size[code]
        return self.flat[ranges(begin[code], sizes)], row, starts, ends, sizes
