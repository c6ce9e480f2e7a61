"""Ids of words, known by a hash of their bytes and looked up for whole groups of texts at once."""

from __future__ import annotations

import numpy as np

from ._hashing import BASE, EXACT, INVERSE, U64, mix, powers

#: Words that a process keeps before it starts anew, and slots of their table.
CACHE = 1_500_000
SLOTS = 1 << 22
#: As in hashes of words, but white space other than the space is part of a word.
_WEIGHTS = np.where(EXACT == 0, mix(np.arange(1000, 1256, dtype=U64)), EXACT)
_WEIGHTS[0x20] = 0


class WordTable:
    """Texts are cut before every space; subclasses say by ``_learn`` what ids new words have."""

    def __init__(self):
        self._clear()

    def _clear(self) -> None:
        self.keys, self.slots = np.zeros(SLOTS, U64), np.zeros(SLOTS, np.int32)
        self.words = self.used = 0
        self.size, self.start = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)
        self.flat = np.zeros(1 << 14, np.uint32)

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """Places of known words, else -1: open addressing, all words a probe at a time."""
        slot = hashes & U64(SLOTS - 1)
        key = self.keys[slot]
        out = np.where(key == hashes, self.slots[slot], np.int32(-1))
        left = np.flatnonzero((key != hashes) & (key != 0))
        while left.size:
            slot = (slot[left] + U64(1)) & U64(SLOTS - 1)
            want, key = hashes[left], self.keys[slot]
            hit = key == want
            out[left[hit]] = self.slots[slot[hit]]
            more = ~hit & (key != 0)
            slot_of = np.zeros(len(hashes), U64)
            slot_of[left] = slot
            left, slot = left[more], slot_of
        return out

    def _learn(self, words: list[str], hashes: np.ndarray) -> None:
        """Registers the ids of new words, which begin with the space before them."""
        raise NotImplementedError

    def _register(self, hashes: np.ndarray, sizes: np.ndarray, every: np.ndarray) -> None:
        k, n = self.words, len(hashes)
        while k + n > len(self.size):
            self.size, self.start = np.resize(self.size, 2 * len(self.size)), np.resize(self.start, 2 * len(self.start))
        while self.used + len(every) > len(self.flat):
            self.flat = np.resize(self.flat, 2 * len(self.flat))
        self.flat[self.used : self.used + len(every)] = every
        self.size[k : k + n] = sizes
        self.start[k : k + n] = self.used + np.cumsum(sizes) - sizes
        self.used += len(every)
        self.words += n
        place, slot = np.arange(k, k + n, dtype=np.int32), hashes & U64(SLOTS - 1)
        while len(place):
            free = self.keys[slot] == 0
            self.keys[slot[free]] = hashes[free]  # of those that meet in a slot the last stays
            mine = self.keys[slot] == hashes
            self.slots[slot[mine]] = place[mine]
            hashes, place, slot = hashes[~mine], place[~mine], (slot[~mine] + U64(1)) & U64(SLOTS - 1)

    def together(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids of each of some texts, none of them empty."""
        data = b"".join(texts)
        b = np.frombuffer(data, np.uint8)
        first = np.cumsum([0, *map(len, texts[:-1])])
        mark = b == 0x20
        mark[first] = True
        starts = np.flatnonzero(mark)
        # a word's hash takes in whether a space leads it: its letters then weigh one power more
        sums = np.add.reduceat(_WEIGHTS[b] * powers(BASE, len(b)), starts) * powers(INVERSE, len(b))[starts]
        ends = np.append(starts[1:], len(b))
        hashes = mix(sums + (ends - starts).astype(U64)) | U64(1)
        if self.words + len(hashes) > CACHE:
            self._clear()
        at = self._find(hashes)
        if (new := np.flatnonzero(at < 0)).size:
            fresh, one = np.unique(hashes[new], return_index=True)
            where = new[one]
            self._learn([data[i:j].decode("utf-8") for i, j in zip(starts[where].tolist(), ends[where].tolist(), strict=True)], fresh)
            at[new] = self._find(hashes[new])
        size = self.size[at]
        ends = np.cumsum(size)
        ids = self.flat[np.repeat(self.start[at] - (ends - size), size) + np.arange(ends[-1])]
        return np.split(ids, (ends - size)[np.searchsorted(starts, first[1:])])
