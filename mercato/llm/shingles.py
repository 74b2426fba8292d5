"""Word shingles and MinHash signatures of whole texts, vectorised over a batch of documents.

Words are maximal runs of bytes other than space and 0x09-0x0D, with A-Z lower-cased. They are
hashed with a polynomial over their bytes, so a batch costs a few array passes whatever the
number of words. Hashes depend on the fixed tables below only: the same text has the same
shingles in every task.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_MASK = (1 << 64) - 1


def _splitmix(n: int, seed: int) -> np.ndarray:
    """n well-mixed 64-bit values drawn from a seed."""
    with np.errstate(over="ignore"):
        z = (np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
             + np.uint64(seed))
        return mix64(z)


def mix64(z: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit over the word."""
    z = z ^ (z >> np.uint64(30))
    z = z * np.uint64(0xBF58476D1CE4E5B9)
    z ^= z >> np.uint64(27)
    z *= np.uint64(0x94D049BB133111EB)
    z ^= z >> np.uint64(31)
    return z


_BYTE_VALUE = _splitmix(256, 11)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BASE = 0x5851F42D4C957F2D          # odd, so it has an inverse modulo 2**64
_BASE_INV = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


_POWERS: dict[str, np.ndarray] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS["up"]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        _POWERS["up"], _POWERS["down"] = _powers(_BASE, size), _powers(_BASE_INV, size)
    return _POWERS["up"], _POWERS["down"]


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word in order, number of words of each text)."""
    joined = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    lengths = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
    space = _SPACE[joined]
    word = ~space
    start = word.copy()
    start[1:] &= space[:-1]
    first = np.flatnonzero(start)
    end = space.copy()
    end[1:] &= word[:-1]
    end[0] = False
    last = np.flatnonzero(end)
    up, down = _power_tables(len(joined) + 1)
    total = np.empty(len(joined) + 1, dtype=np.uint64)
    total[0] = 0
    with np.errstate(over="ignore"):
        values = _BYTE_VALUE[_LOWER[joined]]
        values *= up[:len(joined)]
        np.cumsum(values, out=total[1:])
        hashes = mix64((total[last] - total[first]) * down[first] + (last - first).astype(np.uint64))
    counts = np.searchsorted(first, np.cumsum(lengths), side="left")
    return hashes, np.diff(counts, prepend=0)


@dataclass
class ShingleSets:
    """Distinct shingle hashes of a batch, document after document, ascending within each."""

    values: np.ndarray   # uint64
    sizes: np.ndarray    # number of distinct shingles of each document

    @property
    def starts(self) -> np.ndarray:
        return np.cumsum(self.sizes) - self.sizes

    def of(self, i: int) -> np.ndarray:
        s = self.starts[i]
        return self.values[s:s + self.sizes[i]]


def shingle_sets(texts: list[bytes], width: int) -> ShingleSets:
    """Distinct ``width``-word shingles of each text; a text with fewer words (but some) has its
    whole word sequence as the only shingle, and a text without words has none."""
    n = len(texts)
    if n == 0:
        return ShingleSets(np.empty(0, np.uint64), np.empty(0, np.int64))
    words, counts = word_hashes(texts)
    ends = np.cumsum(counts)
    per_doc = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    doc = np.repeat(np.arange(n), per_doc)
    offset = np.arange(len(doc)) - np.repeat(np.cumsum(per_doc) - per_doc, per_doc)
    first = (ends - counts)[doc] + offset
    short = np.minimum(counts, width)[doc]
    value = np.zeros(len(doc), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for j in range(width):
            inside = np.minimum(first + j, max(len(words) - 1, 0))
            step = value * np.uint64(_BASE) + words[inside] if len(words) else value
            step ^= step >> np.uint64(29)
            value = np.where(j < short, step, value)
        value = mix64(value + short.astype(np.uint64))
    order = np.lexsort((value, doc))
    value, doc = value[order], doc[order]
    keep = np.ones(len(value), dtype=bool)
    keep[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
    value, doc = value[keep], doc[keep]
    return ShingleSets(value, np.bincount(doc, minlength=n).astype(np.int64))


def fingerprints(sets: ShingleSets) -> np.ndarray:
    """Two 64-bit fingerprints of each whole set (zeros for an empty one), as (n, 2) int64."""
    out = np.zeros((len(sets.sizes), 2), dtype=np.uint64)
    full = np.flatnonzero(sets.sizes)
    if len(full):
        at = sets.starts[full]
        with np.errstate(over="ignore"):
            out[full, 0] = np.add.reduceat(mix64(sets.values + np.uint64(0x1234567)), at)
            out[full, 1] = np.add.reduceat(mix64(sets.values ^ np.uint64(0xABCDEF9876543)), at)
    return out.view(np.int64)


def signatures(sets: ShingleSets, k: int) -> np.ndarray:
    """MinHash signatures: coordinate c is the least value of the c-th random affine permutation
    of the 32-bit shingle values. Rows of empty sets hold the largest value."""
    out = np.full((len(sets.sizes), k), 0xFFFFFFFF, dtype=np.uint32)
    full = np.flatnonzero(sets.sizes)
    if len(full) == 0:
        return out
    at = sets.starts[full]
    x = (sets.values >> np.uint64(32)).astype(np.uint32)
    a = (_splitmix(k, 101) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    b = (_splitmix(k, 202) >> np.uint64(32)).astype(np.uint32)
    with np.errstate(over="ignore"):
        y = np.empty_like(x)
        for c in range(k):
            np.multiply(x, a[c], out=y)
            y += b[c]
            y ^= y >> np.uint32(15)
            y *= np.uint32(0x2C1B3C6D)
            out[full, c] = np.minimum.reduceat(y, at)
    return out
