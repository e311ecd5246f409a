"""Distinct word shingles of whole texts as sorted 64-bit hashes, in flat numpy arrays."""

from __future__ import annotations

import numpy as np
import xxhash

WIDTH = 5
# Odd multipliers of the words of a shingle, and of the final mix.
_C = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(h: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective mix of 64-bit values; seeds give unrelated orders."""
    h = h + np.uint64(0x9E3779B97F4A7C15 * (seed + 1) % 2**64)
    h = (h ^ (h >> np.uint64(30))) * _M1
    h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


class _WordHashes(dict):
    LIMIT = 100_000

    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


_hashes = _WordHashes()


def shingle_sets(texts: list[str]) -> list[np.ndarray]:
    """Per text its distinct shingle hashes, ascending; empty without words.

    A-Z are lower-cased and words are runs of anything but ASCII white space (what
    bytes.lower and bytes.split do). With fewer than five words the whole
    sequence is one shingle.
    """
    if len(_hashes) > _hashes.LIMIT:
        _hashes.clear()
    words = [t.encode().lower().split() for t in texts]
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes)
    w = np.fromiter((h for s in words for h in map(_hashes.__getitem__, s)), np.uint64, int(ends[-1]) if len(ends) else 0)
    h = np.empty(0, np.uint64)
    if len(w) >= WIDTH:
        n = len(w) - WIDTH + 1
        h = mixed(sum((w[k : n + k] * _C[k] for k in range(1, WIDTH)), w[:n] * _C[0]))
    out = []
    for s, n, e in zip(words, sizes.tolist(), ends.tolist()):
        if n >= WIDTH:
            u = np.sort(h[e - n : e - WIDTH + 1])
            out.append(u[np.concatenate([[True], u[1:] != u[:-1]])])
        else:
            out.append(np.array([xxhash.xxh64_intdigest(b" ".join(s), seed=1)] if n else [], np.uint64))
    return out
