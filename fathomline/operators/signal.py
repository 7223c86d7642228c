"""Trace transforms that need a whole trace at once, as numpy over Arrow batches of rows; nothing is shuffled."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Traces that ``per_trace`` hands to a transform at once; some hold tens of copies of them.
AT_ONCE = 512


def per_trace(df: DataFrame, id_col: str, samples: str, fn: Callable[[np.ndarray], np.ndarray], out: str = "samples") -> DataFrame:
    """(id, out) with ``fn`` applied to the matrix of a piece of a batch's traces of one length, AT_ONCE at most; null traces stay null."""
    data = df.select(F.col(id_col).cast("long").alias(id_col), F.col(samples).cast("array<double>").alias("_s"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(k, AT_ONCE) for whole in batches for k in range(0, whole.num_rows, AT_ONCE)):
            rows = batch.column(1).to_pylist()
            made: list = [None] * len(rows)
            for n in {len(r) for r in rows if r is not None}:
                at = [i for i, r in enumerate(rows) if r is not None and len(r) == n]
                if n:
                    values = fn(np.array([rows[i] for i in at], np.float64))
                    for i, v in zip(at, values, strict=True):
                        made[i] = v.tolist()
                else:
                    for i in at:
                        made[i] = []
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.list_(pa.float64()))], names=[id_col, out])

    return data.mapInArrow(run, f"{id_col} long, {out} array<double>")


def analytic(x: np.ndarray) -> np.ndarray:
    """The analytic signal along the last axis."""
    n = x.shape[-1]
    spectrum = np.fft.fft(x, axis=-1)
    gain = np.zeros(n)
    gain[0] = 1
    gain[1 : (n + 1) // 2] = 2
    if n % 2 == 0:
        gain[n // 2] = 1
    return np.fft.ifft(spectrum * gain, axis=-1)


def envelope(x: np.ndarray) -> np.ndarray:
    return np.abs(analytic(x))


def cosine_phase(x: np.ndarray) -> np.ndarray:
    return np.cos(np.angle(analytic(x)))


def band_pass(x: np.ndarray, low: float, high: float, order: int = 4) -> np.ndarray:
    """Zero-phase band between ``low`` and ``high`` cycles a sample, with Butterworth magnitudes of a forward and a backward pass."""
    n = x.shape[-1]
    padded = np.concatenate([x[..., ::-1], x, x[..., ::-1]], axis=-1)
    f = np.fft.rfftfreq(3 * n)
    with np.errstate(divide="ignore"):
        gain = 1 / (1 + (f / high) ** (2 * order)) * (1 / (1 + (low / np.where(f == 0, 1e-12, f)) ** (2 * order)))
    return np.fft.irfft(np.fft.rfft(padded, axis=-1) * gain, 3 * n, axis=-1)[..., n : 2 * n]


def ricker_ridges(x: np.ndarray, widths: tuple[float, ...] = (2.0, 3.0, 4.5)) -> np.ndarray:
    """The largest Mexican-hat response over some widths, scaled by each trace's maximum."""
    n = x.shape[-1]
    best = np.zeros_like(x)
    for w in widths:
        reach = int(np.ceil(5 * w))
        t = np.arange(-reach, reach + 1) / w
        hat = (1 - t**2) * np.exp(-(t**2) / 2)
        size = n + 2 * reach
        response = np.fft.irfft(np.fft.rfft(x, size) * np.fft.rfft(hat, size), size)[..., reach : reach + n]
        best = np.maximum(best, np.abs(response))
    return best / np.maximum(best.max(axis=-1, keepdims=True), 1e-12)


def minimum_phase(wavelet: np.ndarray, size: int = 256) -> np.ndarray:
    """The minimum-phase wavelet of the same amplitude spectrum, through the folded cepstrum."""
    spectrum = np.abs(np.fft.fft(wavelet, size))
    cepstrum = np.fft.ifft(np.log(np.maximum(spectrum, 1e-6 * spectrum.max()))).real
    fold = np.zeros(size)
    fold[0] = 1
    fold[1 : size // 2] = 2
    fold[size // 2] = 1
    return np.fft.ifft(np.exp(np.fft.fft(cepstrum * fold))).real[: len(wavelet)]


def sparsest_rotation(x: np.ndarray, angles: int = 36) -> tuple[np.ndarray, np.ndarray]:
    """Each trace turned by the phase at which its 99th percentile is largest against its median: (angle, soft-thresholded trace)."""
    z = analytic(x)
    turns = np.linspace(-np.pi, np.pi, angles, endpoint=False)
    turned = np.stack([(z * np.exp(1j * a)).real for a in turns])
    size = np.abs(turned)
    ratio = np.percentile(size, 99, axis=2) / np.maximum(np.median(size, axis=2), 1e-12)
    best = ratio.argmax(axis=0)
    chosen = turned[best, np.arange(len(x))]
    floor = np.median(np.abs(chosen), axis=1, keepdims=True)
    return turns[best], np.sign(chosen) * np.maximum(np.abs(chosen) - floor, 0)


def soft_denoise(x: np.ndarray, levels: int = 2) -> np.ndarray:
    """Undecimated B3-spline wavelet denoising: details under the universal threshold of their robust noise level are dropped."""
    kernel = np.array([1, 4, 6, 4, 1]) / 16
    smooth, details = x, []
    for level in range(levels):
        step = 2**level
        reach = 2 * step
        padded = np.pad(smooth, ((0, 0), (reach, reach)), mode="reflect")
        following = sum(k * padded[:, i * step : i * step + x.shape[1]] for i, k in enumerate(kernel))
        detail = smooth - following
        limit = np.median(np.abs(detail), axis=1, keepdims=True) / 0.6745 * np.sqrt(2 * np.log(max(x.shape[1], 2)))
        details.append(np.sign(detail) * np.maximum(np.abs(detail) - limit, 0))
        smooth = following
    return smooth + sum(details)


def aligned(x: np.ndarray, target: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """(shift, trace moved by it) that brings each trace closest to the target by correlation; zeros move in."""
    n = x.shape[1]
    best, score = np.zeros(len(x), int), np.full(len(x), -np.inf)
    moved = np.zeros_like(x)
    for shift in sorted(range(-reach, reach + 1), key=lambda s: (abs(s), s)):
        rolled = np.zeros_like(x)
        rolled[:, max(0, shift) : n + min(0, shift)] = x[:, max(0, -shift) : n - max(0, shift)]
        value = rolled @ target
        better = value > score + 1e-12
        best[better], score[better], moved[better] = shift, value[better], rolled[better]
    return best, moved
