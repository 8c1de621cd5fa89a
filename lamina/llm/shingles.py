"""Sets of word shingles, and SuperMinHash signatures of them, for many texts at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from lamina.llm.arrowtext import coded, hashes, mix, words

#: Items whose permutations are held at once.
BLOCK_ITEMS = 60_000
_GOLD = 0x9E3779B97F4A7C15


def shingle_sets(array: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text, flat, and offsets. A text with fewer words has its whole sequence as one; one without words has none."""
    flat, offsets = words(array)
    if not len(flat):
        return np.zeros(0, np.uint64), np.zeros(len(array) + 1, np.int64)
    codes, distinct = coded(flat)
    h = hashes(distinct)[codes]
    n = np.diff(offsets)
    count = np.where(n >= size, n - size + 1, (n > 0).astype(np.int64))
    ends = np.concatenate(([0], np.cumsum(count)))
    at = np.repeat(offsets[:-1] - ends[:-1], count) + np.arange(ends[-1])
    last = np.repeat(offsets[1:], count)
    acc = mix(np.minimum(last - at, size).astype(np.uint64))
    for j in range(size):
        on = at + j < last
        acc = np.where(on, mix(acc * np.uint64(3) + h[np.where(on, at + j, 0)]), acc)
    cut = ends.tolist()
    for a, b in zip(cut, cut[1:], strict=False):
        acc[a:b].sort()
    doc = np.repeat(np.arange(len(n)), count)
    fresh = np.ones(len(acc), bool)
    fresh[1:] = (acc[1:] != acc[:-1]) | (doc[1:] != doc[:-1])
    return acc[fresh], np.concatenate(([0], np.cumsum(np.bincount(doc[fresh], minlength=len(n)))))


def superminhash(items: np.ndarray, offsets: np.ndarray, m: int) -> np.ndarray:
    """Signatures (sets, m). Level by level each item takes the next place of its own random permutation of
    the m places, with a value of the level plus a random fraction, and each place keeps its least value.
    A set whose places are all taken is done: later levels only have larger values."""
    n = len(offsets) - 1
    full = np.iinfo(np.uint64).max
    signature = np.full(n * m, full, np.uint64)
    owner = np.repeat(np.arange(n), np.diff(offsets))
    for a in range(0, len(items), BLOCK_ITEMS):
        item, doc = items[a : a + BLOCK_ITEMS], owner[a : a + BLOCK_ITEMS]
        first, last = int(doc[0]), int(doc[-1]) + 1
        own = np.full((last - first) * m, full, np.uint64)
        doc = doc - first
        rows = np.arange(len(item))
        place = np.tile(np.arange(m, dtype=np.uint8 if m <= 256 else np.uint16), (len(item), 1))
        for level in range(m):
            draw = mix(item[rows] + np.uint64(_GOLD * (level + 1) % 2**64))
            pick = level + (((draw & np.uint64(0xFFFFFFFF)) * np.uint64(m - level)) >> np.uint64(32)).astype(np.int64)
            taken = place[rows, pick]
            place[rows, pick] = place[rows, level]
            np.minimum.at(own, doc[rows] * m + taken, (draw >> np.uint64(32)) | np.uint64(level << 32))
            going = (own.reshape(-1, m) == full).any(1)
            rows = rows[going[doc[rows]]]
            if not len(rows):
                break
        part = signature[first * m : last * m]
        np.minimum(part, own, out=part)
    return signature.reshape(n, m)
