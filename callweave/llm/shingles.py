"""Word shingles of many texts as 64-bit hashes, computed on arrays of bytes."""

from __future__ import annotations

import numpy as np

WORDS = 5

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_MIX = _rng.integers(1, 1 << 63, WORDS + 1, dtype=np.uint64) | np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_GAP = np.zeros(256, bool)
_GAP[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads 64 bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _STEP, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, A-Z lower-cased, and the bounds of each text's words."""
    raw = b"".join(t + b" " for t in texts)
    ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
    data = _LOWER[np.frombuffer(raw, np.uint8)]
    word = ~_GAP[data]
    change = np.flatnonzero(word[1:] != word[:-1]) + 1
    if len(word) and word[0]:
        change = np.concatenate([[0], change])
    starts, stops = change[0::2], change[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    size = stops - starts
    powers = _powers(int(size.max()))
    at = np.flatnonzero(word)
    place = at - np.repeat(starts, size)
    first = np.cumsum(size) - size
    sums = np.add.reduceat(_BYTE[data[at]] * powers[place], first)
    return mix(sums + size.astype(np.uint64)), np.searchsorted(starts, np.concatenate([[0], ends]))


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """The sorted distinct 5-word shingles of each text; fewer words are one shingle, no word none."""
    words, bounds = word_hashes(texts)
    n = len(words)
    rolled = np.zeros(n, np.uint64)
    for k in range(min(WORDS, n)):
        rolled[: n - k] += words[k:] * _MIX[k]
    rolled = mix(rolled)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if b - a >= WORDS:
            own = np.sort(rolled[a : b - WORDS + 1])
            out.append(own[np.concatenate([[True], own[1:] != own[:-1]])])
        elif b > a:
            out.append(mix((words[a:b] * _MIX[: b - a]).sum(dtype=np.uint64, keepdims=True) + np.uint64(b - a) * _MIX[WORDS]))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
