"""Transforms of a grid of traces by samples that look at neighbouring traces, in numpy for a block of traces.

``over_blocks`` deals a road's traces to blocks with overlapping margins, so that a block's own traces come out as over the whole road.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .solvers import matrix


def over_blocks(df: DataFrame, keys: list[str], row: str, samples: str, fn: Callable[[np.ndarray], np.ndarray], size: int, margin: int, out: str) -> DataFrame:
    """(keys, row, out): ``fn`` of each block of ``size`` rows of a key, numbered by ``row``, with ``margin`` rows of its neighbours.

    Each row is copied to the blocks that need it, three at most for margins below the size; no task holds a road. A road's last rows are also
    dealt to the block after them, which has none of its own then and is left out.
    """
    if margin > size:
        raise ValueError("margin above the block size")
    kinds = dict(df.dtypes)
    own = F.floor(F.col(row) / size)
    blocks = F.array_distinct(F.array(own, F.floor((F.col(row) - margin) / size), F.floor((F.col(row) + margin) / size)))
    spread = df.select(*keys, row, F.col(samples).cast("array<double>").alias("_s"), F.explode(blocks).alias("_b")).filter("_b >= 0")

    def run(block: pa.Table) -> pa.Table:
        block = block.sort_by(row)
        place = block[row].to_numpy()
        mine = np.flatnonzero(place // size == block["_b"].to_numpy())
        if not len(mine):
            return target.empty_table()
        made = np.ascontiguousarray(fn(matrix(block["_s"])), np.float64)
        part = block.take(pa.array(mine))
        offsets = np.arange(len(mine) + 1, dtype=np.int32) * made.shape[1]
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(made[mine].ravel()))
        return part.select([*keys, row]).append_column(out, lists)

    schema = ", ".join([f"{k} {kinds[k]}" for k in keys] + [f"{row} {kinds[row]}", f"{out} array<double>"])
    target = to_arrow_schema(StructType.fromDDL(schema))
    return spread.groupBy(*keys, "_b").applyInArrow(run, schema)


def _shifted(x: np.ndarray, rows: int, samples: int) -> np.ndarray:
    """The value ``rows`` further and ``samples`` deeper, the edges repeated."""
    i = np.clip(np.arange(x.shape[0]) + rows, 0, x.shape[0] - 1)
    j = np.clip(np.arange(x.shape[1]) + samples, 0, x.shape[1] - 1)
    return x[np.ix_(i, j)]


def oriented_coherence(x: np.ndarray, slopes: tuple[float, ...] = (-1.5, -1, -0.5, 0, 0.5, 1, 1.5), reach: int = 3) -> np.ndarray:
    """Largest semblance over slopes: energy of the slanted sum of 2 * reach + 1 traces against the sum of energies."""
    best = np.zeros_like(x)
    for slope in slopes:
        parts = np.stack([_shifted(x, k, int(round(slope * k))) for k in range(-reach, reach + 1)])
        best = np.maximum(best, parts.sum(axis=0) ** 2 / np.maximum(len(parts) * (parts**2).sum(axis=0), 1e-12))
    return best


def structure_slope(x: np.ndarray, smooth: int = 2) -> np.ndarray:
    """Samples a trace along which the image changes least, from the smoothed structure tensor."""
    # A single trace, or sample, has no change along that axis.
    gy, gx = (np.gradient(x, axis=k) if x.shape[k] > 1 else np.zeros_like(x) for k in (0, 1))

    def mean(a: np.ndarray) -> np.ndarray:
        return np.mean([_shifted(a, i, j) for i in range(-smooth, smooth + 1) for j in range(-smooth, smooth + 1)], axis=0)

    xx, xy = mean(gx * gx), mean(gx * gy)
    return -xy / np.maximum(xx, 1e-12)


def lateral_phase_coherence(x: np.ndarray, reach: int = 4) -> np.ndarray:
    """|mean of the analytic signal| over the mean of its modulus across 2 * reach + 1 traces."""
    from .signal import analytic

    z = analytic(x)
    parts = [_shifted(z, k, 0) for k in range(-reach, reach + 1)]
    return np.abs(np.mean(parts, axis=0)) / np.maximum(np.mean(np.abs(parts), axis=0), 1e-12)


def deconvolved(x: np.ndarray, wavelet: np.ndarray, ridge: float = 0.05) -> np.ndarray:
    """Inverse filter of a wavelet in the frequency domain with a floor under its power."""
    n = x.shape[1]
    w = np.fft.rfft(wavelet, n)
    power = np.abs(w) ** 2
    return np.fft.irfft(np.fft.rfft(x, axis=1) * np.conj(w) / (power + ridge * power.max()), n, axis=1)


def packet_correlation(x: np.ndarray, template: np.ndarray) -> np.ndarray:
    """Normalised correlation of a demeaned template with every window of each trace; 0 where the window leaves the trace."""
    size = len(template)
    t = template - template.mean()
    t = t / max(np.linalg.norm(t), 1e-12)
    windows = np.lib.stride_tricks.sliding_window_view(x, size, axis=1)
    centred = windows - windows.mean(axis=2, keepdims=True)
    score = (centred @ t) / np.maximum(np.linalg.norm(centred, axis=2), 1e-12)
    out = np.zeros_like(x)
    out[:, size // 2 : size // 2 + score.shape[1]] = score
    return out
