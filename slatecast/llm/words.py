"""Vectorised hashes of words and of windows of consecutive words (numpy, inside tasks).

Two windows get equal hashes when their word sequences are equal; different sequences collide with the
chance of 64-bit hashes. Byte tables are drawn from fixed seeds, so every task agrees.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

U64 = np.uint64
_SEGMENT = 1 << 20
_BYTE = np.random.default_rng(20240501).integers(1, 1 << 63, 256, dtype=np.uint64) | U64(1)
_BASE = 0x9E3779B97F4A7C15
WINDOW_A, WINDOW_B = 0xD1342543DE82EF95, 0xAF251AF3B0F025B5
_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit values that spreads every input bit."""
    h = h ^ (h >> U64(30))
    h *= U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, dtype=np.uint64)
    size = 1
    while size < n:
        step = min(size, n - size)
        out[size : size + step] = out[:step] * U64(pow(base, size, 1 << 64))
        size += step
    return out


def _table(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2**64, and of its inverse."""
    have = _tables.get(base)
    if have is None or len(have[0]) < n:
        n = max(n, 1 << 16)
        have = _tables[base] = (_powers(base, n), _powers(pow(base, -1, 1 << 64), n))
    return have


def word_hashes(joined: bytes) -> np.ndarray:
    """A hash of each word of ``joined``, whose words are separated by single spaces."""
    out, pos, n = [], 0, len(joined)
    while pos < n:
        end = n
        if n - pos > _SEGMENT:
            end = joined.rfind(b" ", pos, pos + _SEGMENT)
            if end < 0:
                end = joined.find(b" ", pos + _SEGMENT)
                end = n if end < 0 else end
        seg = np.frombuffer(joined, np.uint8, end - pos, pos)
        up, down = _table(_BASE, len(seg) + 1)
        sums = np.zeros(len(seg) + 1, dtype=np.uint64)
        np.cumsum(_BYTE[seg] * up[: len(seg)], out=sums[1:])
        gaps = np.flatnonzero(seg == 32)
        starts = np.concatenate(([0], gaps + 1))
        ends = np.concatenate((gaps, [len(seg)]))
        out.append(mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64)))
        pos = end + 1
    return np.concatenate(out) if out else np.zeros(0, dtype=np.uint64)


def window_hashes(words: np.ndarray, k: int, base: int = WINDOW_A) -> np.ndarray:
    """A hash of each run of ``k`` consecutive words."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    up, down = _table(base, len(words) + 1)
    sums = np.zeros(len(words) + 1, dtype=np.uint64)
    np.cumsum(words * up[: len(words)], out=sums[1:])
    return mix((sums[k:] - sums[:n]) * down[:n] + U64(k))


@dataclass
class Words:
    """The words of a batch of texts, as one sequence of hashes with the bounds of each text."""

    normal: list[bytes]
    count: np.ndarray
    first: np.ndarray
    hashes: np.ndarray

    @property
    def owner(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.count)), self.count)

    def windows(self, k: int, base: int = WINDOW_A) -> tuple[np.ndarray, np.ndarray]:
        """Hash and first word of each window that lies in one text."""
        h = window_hashes(self.hashes, k, base)
        if not len(h):
            return h, np.zeros(0, dtype=np.int64)
        owner = self.owner
        at = np.flatnonzero(owner[: len(h)] == owner[k - 1 :])
        return h[at], at


def split(texts: list[bytes], lower: bool = False) -> Words:
    normal, count = [], np.zeros(len(texts), dtype=np.int64)
    for i, t in enumerate(texts):
        ws = (t.lower() if lower else t).split()
        count[i] = len(ws)
        normal.append(b" ".join(ws))
    first = np.concatenate(([0], np.cumsum(count)))[: len(texts)] if len(texts) else np.zeros(0, np.int64)
    return Words(normal, count, first.astype(np.int64), word_hashes(b" ".join(x for x in normal if x)))
