"""Hashed character n-grams and words of a batch of texts, in numpy."""

from __future__ import annotations

import numpy as np

#: Fixed odd multipliers of the hashes.
MIX, SPREAD = np.uint32(0x01000193), np.uint32(0x9E3779B1)
BREAK = 32


class Batch:
    """Texts end to end as code points, a break between them."""

    def __init__(self, texts: list[str]):
        self.size = len(texts)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        joined = " ".join(texts) + " "
        self.points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        self.starts = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]]).astype(np.int64) if texts else np.zeros(0, np.int64)
        self.ends = self.starts + lengths

    def grams(self, n: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """(bucket of the n-gram that begins at each place, 1 where it lies in one text)."""
        points, size = self.points, len(self.points)
        value = np.full(size, np.uint32(n), np.uint32)
        for k in range(n):
            rest = max(size - k, 0)
            value[:rest] = (value[:rest] ^ points[k:]) * MIX
        value = value * SPREAD >> np.uint32(32 - bits)
        inside = np.ones(size, bool)
        for k in range(n):
            inside[np.maximum(self.ends - k, self.starts)] = False
        return value, inside

    def words(self, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """(bucket, start place) of each run without white space of up to 0x20."""
        points = self.points
        solid = points > BREAK
        edge = np.flatnonzero(np.diff(np.concatenate([[False], solid, [False]]).astype(np.int8)))
        begins, stops = edge[::2], edge[1::2]
        if not len(begins):
            return np.zeros(0, np.uint32), begins
        mixed = (points + np.uint32(0x7F4A7C15)) * SPREAD
        mixed ^= mixed >> np.uint32(15)
        # A polynomial of the word read forward: sums of scaled places, the scale taken out by the word's start.
        base, inverse = powers(len(points) + 1)
        total = np.zeros(len(points) + 1, np.uint32)
        np.cumsum(mixed * base[: len(points)], out=total[1:], dtype=np.uint32)
        value = (total[stops] - total[begins]) * inverse[begins]
        value = (value ^ (value >> np.uint32(13))) * SPREAD
        return value >> np.uint32(32 - bits), begins

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Sum of the values over each text's places; each text is summed alone, so equal texts give equal sums."""
        out = np.zeros(self.size)
        full = np.flatnonzero(self.ends > self.starts)
        if len(full):
            # Breaks hold zeros, so a segment may run on to the next text's start.
            out[full] = np.add.reduceat(values, self.starts[full])
        return out

    def owner(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, places, side="right") - 1


_powers: list[tuple[np.ndarray, np.ndarray]] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0][0]) < n:
        odd = 0x2C1B3C6D
        pair = []
        for factor in (odd, pow(odd, -1, 1 << 32)):
            run = np.full(max(n, 1 << 20), factor, np.uint32)
            run[0] = 1
            pair.append(np.cumprod(run, dtype=np.uint32))
        _powers[:] = [tuple(pair)]
    return _powers[0]
