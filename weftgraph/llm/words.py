"""Vectorised word and window hashes over many texts at once."""

from __future__ import annotations

import numpy as np

from weftgraph.llm.common import SPACES

U64 = np.uint64
_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(0, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
_BASE = U64(0x9E3779B97F4A7C15)
_BASE_INVERSE = U64(pow(int(_BASE), -1, 2**64))
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACES)] = True
_powers = {"up": np.ones(1, U64), "down": np.ones(1, U64)}


def _power(name: str, base: np.uint64, n: int) -> np.ndarray:
    have = _powers[name]
    if len(have) < n:
        grown = np.full(max(n, 2 * len(have)), base, U64)
        grown[0] = 1
        _powers[name] = have = np.multiply.accumulate(grown)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


class WordTable:
    """Words of several texts: `hash`, byte `start` and `end` in `data`, and `first` word of each text (one more at the end)."""

    def __init__(self, texts: list[bytes]):
        self.data = b"\n".join(texts)
        raw = np.frombuffer(self.data, np.uint8)
        word = np.zeros(len(raw) + 2, bool)
        word[1:-1] = ~_IS_SPACE[raw]
        edge = np.flatnonzero(word[1:] != word[:-1])
        self.start, self.end = edge[0::2], edge[1::2]
        total = np.zeros(len(raw) + 1, U64)
        np.cumsum(_BYTE[raw] * _power("up", _BASE, len(raw)), out=total[1:])
        value = (total[self.end] - total[self.start]) * _power("down", _BASE_INVERSE, len(raw) + 1)[self.start]
        self.hash = mix(value + (self.end - self.start).astype(U64))
        begins = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))
        self.first = np.searchsorted(self.start, begins[: len(texts) + 1])

    def grams(self, k: int) -> np.ndarray:
        """Hash of the k words from each word on, also across texts; the last k - 1 have none."""
        n = len(self.hash) - k + 1
        if n <= 0:
            return np.empty(0, U64)
        out = self.hash[:n].copy()
        for j in range(1, k):
            out = mix(out * U64(0xD6E8FEB86659FD93) + self.hash[j : j + n])
        return out

    def shingles(self, k: int) -> list[np.ndarray]:
        """Sorted distinct k-word shingles of each text; with fewer words, the whole sequence as one."""
        grams = self.grams(k)
        out = []
        for s, e in zip(self.first[:-1].tolist(), self.first[1:].tolist(), strict=True):
            if e - s >= k:
                out.append(np.unique(grams[s : e - k + 1]))
            elif e > s:
                whole = np.array([e - s], U64)
                for i in range(s, e):
                    whole = mix(whole * U64(0xA24BAED4963EE407) + self.hash[i : i + 1])
                out.append(whole)
            else:
                out.append(np.empty(0, U64))
        return out
