"""Hashed word shingles of many texts at once.

Words are runs of ``[^\\x20\\x09-\\x0D]`` of the UTF-8 bytes with A-Z lower-cased. Hashes have 64 bits; two different
shingles of one comparison meet with a chance of about 2 to the power -64.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

#: Bytes of text hashed in one go.
CHUNK_BYTES = 1 << 18
#: Odd multipliers of the rolling hash and of the places in a shingle (any odd numbers do).
BASE = 0x9E3779B97F4A7C15
PLACES = [0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB]

_FOLD = np.arange(256, dtype=np.uint64)
_FOLD[65:91] += 32
_FOLD += 1
_WORD = np.ones(256, dtype=bool)
_WORD[[9, 10, 11, 12, 13, 32]] = False


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


class Powers:
    """Powers of the base and of its inverse modulo 2 to the power 64, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def reach(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, CHUNK_BYTES + (1 << 16))
            inverse = pow(BASE, -1, 1 << 64)
            for name, base in (("up", BASE), ("down", inverse)):
                powers = np.full(n, base, dtype=np.uint64)
                powers[0] = 1
                setattr(self, name, np.multiply.accumulate(powers))


def word_hashes(texts: Iterable[bytes], powers: Powers) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For chunks of the texts: the hashes of all words in order, and each text's first word (one bound more than texts)."""
    chunk: list[bytes] = []
    size = 0
    for text in texts:
        if chunk and size + len(text) > CHUNK_BYTES:
            yield _hashed(chunk, powers)
            chunk, size = [], 0
        chunk.append(text)
        size += len(text) + 1
    if chunk:
        yield _hashed(chunk, powers)


def _hashed(chunk: list[bytes], powers: Powers) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(b"\n".join(chunk) + b"\n", dtype=np.uint8)
    powers.reach(len(data) + 1)
    inside = _WORD[data]
    edges = np.flatnonzero(np.diff(inside, prepend=False))
    starts, ends = edges[::2], edges[1::2]
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_FOLD[data] * powers.up[: len(data)], out=sums[1:])
    words = mix((sums[ends] - sums[starts]) * powers.down[starts])
    bounds = np.cumsum([0] + [len(t) + 1 for t in chunk])
    return words, np.searchsorted(starts, bounds)


def joined(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of ``width`` words; empty if there are fewer words."""
    n = len(words) - width + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    total = np.full(n, width, dtype=np.uint64)
    for i in range(width):
        total += words[i : i + n] * np.uint64(PLACES[i])
    return mix(total)


def shingle_sets(texts: Iterable[bytes], width: int, powers: Powers | None = None) -> Iterator[np.ndarray]:
    """Each text's distinct shingle hashes, sorted. Fewer words than ``width``: all words as one shingle; none: empty."""
    powers = powers or Powers()
    for words, firsts in word_hashes(texts, powers):
        runs = joined(words, width)
        for start, end in zip(firsts[:-1], firsts[1:]):
            n = end - start
            if n >= width:
                yield np.unique(runs[start : end - width + 1])
            else:
                yield joined(words[start:end], n) if n else np.empty(0, dtype=np.uint64)
