"""Minimal perfect hashing of 64-bit keys with level-by-level bit sets, in array operations.

At each level the remaining keys are hashed into a bit set somewhat larger than their number;
keys alone on their bit are settled there, the others go on to the next level. The index of a
key is the rank of its bit over all levels, so n keys take the indexes 0..n-1. A key that was
not in the build set gets an arbitrary index or -1: callers compare a stored fingerprint.
"""

from __future__ import annotations

import io

import numpy as np

from mercato.llm.shingles import mix64

_LEVELS = 24
_GAMMA = 1.7


def _slots(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        seed = np.uint64((0x9E3779B97F4A7C15 * (level + 1)) & ((1 << 64) - 1))
        return mix64(keys ^ seed) % np.uint64(size)


class PerfectHash:
    def __init__(self, words: list[np.ndarray], sizes: list[int], rest: np.ndarray):
        self.words, self.sizes, self.rest = words, sizes, rest
        ones = [np.bitwise_count(w).astype(np.int64) for w in words]
        self.before, total = [], 0
        for o in ones:
            self.before.append(total + np.cumsum(o) - o)
            total += int(o.sum())
        self.settled = total

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        """``keys``: distinct uint64 values."""
        words, sizes = [], []
        for level in range(_LEVELS):
            if len(keys) == 0:
                break
            size = max(64, int(_GAMMA * len(keys)) + 63 & ~63)
            slots = _slots(keys, level, size)
            alone = np.bincount(slots.astype(np.int64), minlength=size) == 1
            words.append(np.packbits(alone, bitorder="little").view("<u8"))
            sizes.append(size)
            keys = keys[~alone[slots.astype(np.int64)]]
        return cls(words, sizes, np.sort(keys))

    def index(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), -1, dtype=np.int64)
        todo = np.arange(len(keys))
        for level, (words, size) in enumerate(zip(self.words, self.sizes)):
            slots = _slots(keys[todo], level, size).astype(np.int64)
            word, bit = slots >> 6, (slots & 63).astype(np.uint64)
            found = (words[word] >> bit) & np.uint64(1) == 1
            w, b = word[found], bit[found]
            below = words[w] & ((np.uint64(1) << b) - np.uint64(1))
            out[todo[found]] = self.before[level][w] + np.bitwise_count(below)
            todo = todo[~found]
        if len(todo) and len(self.rest):
            at = np.minimum(np.searchsorted(self.rest, keys[todo]), len(self.rest) - 1)
            same = self.rest[at] == keys[todo]
            out[todo[same]] = self.settled + at[same]
        return out

    def arrays(self) -> dict[str, np.ndarray]:
        return {"sizes": np.array(self.sizes, np.int64), "rest": self.rest,
                "words": np.concatenate([*self.words, np.empty(0, "<u8")])}

    @classmethod
    def from_arrays(cls, arrays) -> PerfectHash:
        sizes = arrays["sizes"].tolist()
        cuts = np.cumsum([s // 64 for s in sizes])[:-1] if sizes else []
        words = np.split(arrays["words"], cuts) if sizes else []
        return cls(words, sizes, arrays["rest"])


class Shard:
    """The fingerprints, counts and last documents of a shard's keys, by perfect-hash index."""

    def __init__(self, mph: PerfectHash, fingerprint, count, last):
        self.mph, self.fingerprint, self.count, self.last = mph, fingerprint, count, last

    @classmethod
    def build(cls, keys, fingerprint, count, last) -> Shard:
        keys = np.asarray(keys).astype(np.int64).view(np.uint64)
        # two lines may share the first half of their hash: the second half then breaks the tie
        order = np.lexsort((fingerprint, keys))
        first = np.ones(len(keys), dtype=bool)
        first[1:] = keys[order][1:] != keys[order][:-1]
        twins = order[~first]
        order = order[first]
        mph = PerfectHash.build(keys[order])
        at = mph.index(keys[order])
        out = cls(mph, *(np.empty(len(order), dtype=np.int64) for _ in range(3)))
        for mine, given in ((out.fingerprint, fingerprint), (out.count, count), (out.last, last)):
            mine[at] = np.asarray(given)[order]
        out.twins = np.stack([keys[twins].view(np.int64),
                              *(np.asarray(x)[twins].astype(np.int64)
                                for x in (fingerprint, count, last))])
        return out

    def find(self, keys, fingerprint) -> tuple[np.ndarray, np.ndarray]:
        """(count, last document) of each key; count 0 for keys the shard does not hold."""
        keys = np.asarray(keys, dtype=np.int64)
        count = np.zeros(len(keys), dtype=np.int64)
        last = np.zeros(len(keys), dtype=np.int64)
        if len(self.count):
            at = self.mph.index(keys.view(np.uint64))
            mine = (at >= 0) & (self.fingerprint[at] == fingerprint)
            count[mine], last[mine] = self.count[at[mine]], self.last[at[mine]]
        for key, print_, n, doc in self.twins.T.tolist():
            same = (keys == key) & (fingerprint == print_)
            count[same], last[same] = n, doc
        return count, last

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, fingerprint=self.fingerprint, count=self.count, last=self.last,
                 twins=self.twins, **self.mph.arrays())
        return out.getvalue()

    @classmethod
    def from_bytes(cls, data: bytes) -> Shard:
        with np.load(io.BytesIO(data)) as a:
            out = cls(PerfectHash.from_arrays(a), a["fingerprint"], a["count"], a["last"])
            out.twins = a["twins"]
        return out
