"""Alignment of pairs of waveforms within a band, all pairs of a batch at once."""

from __future__ import annotations

import numpy as np


def aligned_pairs(a: np.ndarray, b: np.ndarray, band: int) -> tuple[np.ndarray, np.ndarray]:
    """(agreement, displacement): exp of minus the cost of aligning pairs of waveforms within a band, and the mean offset of what meets the centre of ``a``.

    Of equally dear ways the diagonal step is taken first, then that along ``a``. All pairs are solved together, an antidiagonal at a time.
    """
    pairs, n = a.shape
    cost = np.full((pairs, n + 1, n + 1), np.inf)
    cost[:, 0, 0] = 0
    way = np.zeros((pairs, n + 1, n + 1), np.int8)
    for s in range(2, 2 * n + 1):
        i = np.arange(max(1, s - n), min(n, s - 1) + 1)
        i = i[np.abs(2 * i - s) <= band]
        j = s - i
        before = np.stack([cost[:, i - 1, j - 1], cost[:, i - 1, j], cost[:, i, j - 1]])
        way[:, i, j] = before.argmin(axis=0)
        cost[:, i, j] = (a[:, i - 1] - b[:, j - 1]) ** 2 + before.min(axis=0)
    i, j = np.full(pairs, n), np.full(pairs, n)
    total, count = np.zeros(pairs), np.zeros(pairs)
    which = np.arange(pairs)
    while (i > 0).any():
        here = (i == n // 2 + 1) & (j > 0)
        total += np.where(here, j - 1 - n // 2, 0)
        count += here
        step = way[which, np.maximum(i, 0), np.maximum(j, 0)]
        go = (i > 0) & (j > 0)
        i, j = np.where(go, i - (step != 2), 0), np.where(go, j - (step != 1), 0)
    return np.exp(-cost[:, n, n]), total / np.maximum(count, 1)


def reciprocal(a: np.ndarray, b: np.ndarray, band: int) -> tuple[np.ndarray, np.ndarray]:
    """The worse agreement and the larger displacement of both ways, aligned independently."""
    (p, x), (q, y) = aligned_pairs(a, b, band), aligned_pairs(b, a, band)
    return np.minimum(p, q), np.maximum(np.abs(x), np.abs(y))
