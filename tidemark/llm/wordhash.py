"""Words of a byte buffer and their 64-bit hashes, for a whole block at once."""

from __future__ import annotations

import numpy as np

from tidemark.llm.blocks import M1, M3, mix

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_KEEP = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [2**64 - 1], np.uint64)


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z; all other bytes unchanged."""
    return _LOWER[data]


def find_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and the number of its document. A word ends at white
    space or at the end of its document."""
    word = np.append(~_SPACE[data], False)
    begins = word.copy()
    begins[1:] &= ~word[:-1]
    edge = offsets[:-1][offsets[:-1] < offsets[1:]]
    begins[edge] = word[edge]
    starts = np.flatnonzero(begins)
    doc = np.searchsorted(offsets, starts, side="right") - 1
    stops = np.flatnonzero(word[:-1] & ~word[1:]) + 1  # where a run of word bytes ends
    ends = stops[np.searchsorted(stops, starts, side="right")] if len(starts) else starts
    return starts, np.minimum(ends, offsets[doc + 1]), doc


def hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hash per word: eight bytes at a time, all words side by side. Another ``seed`` gives
    another hash."""
    padded = np.append(data, np.zeros(8, np.uint8))
    eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    left = ends - starts
    h = left.astype(np.uint64) * M1 ^ np.uint64(seed)
    live, at = np.arange(len(starts)), starts
    while len(live):
        h[live] = mix((h[live] ^ (eight[at] & _KEEP[np.minimum(left[live], 8)])) * M3)
        left[live] -= 8
        more = left[live] > 0
        live, at = live[more], at[more] + 8
    return h


def join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of a sequence from the hashes of its two parts."""
    return mix(a * M1 + b)


def rolling(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each ``n`` consecutive values: runs of 1, 2, 4, ... are doubled, and the last two
    runs overlap where needed (equal hashes then still mean equal runs)."""
    size = 1
    while size < n:
        step = min(size, n - size)
        h = join(h[:-step], h[step:]) if len(h) > step else h[:0]
        size += step
    return h
