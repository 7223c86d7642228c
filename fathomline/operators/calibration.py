"""Calibration of a road: its surface made flat, the plate's waveform taken away."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..workspace import held
from .quantiles import exact_median
from .solvers import matrix

#: Samples to either side of the median trace's strongest one in which a trace's surface is looked for.
REACH = 24


def box(x: np.ndarray, size: int, axis: int, zeros: bool = False) -> np.ndarray:
    """Moving mean over an odd ``size``; beyond the edges they repeat, or zeros count."""
    half = size // 2
    pad = [(0, 0)] * x.ndim
    pad[axis] = (half, half)
    padded = np.pad(x, pad, mode="constant") if zeros else np.pad(x, pad, mode="edge")
    total = np.cumsum(padded, axis=axis, dtype=np.result_type(x, float))
    first = np.zeros_like(np.take(total, [0], axis=axis))
    total = np.concatenate([first, total], axis=axis)
    n = x.shape[axis]
    return (np.take(total, range(size, size + n), axis=axis) - np.take(total, range(n), axis=axis)) / size


def dewowed(x: np.ndarray, size: int = 41) -> np.ndarray:
    return x - box(x, size, 1)


def moved(x: np.ndarray, by: np.ndarray) -> np.ndarray:
    """Each trace ``by`` samples deeper; zeros come in."""
    n = x.shape[1]
    at = np.arange(n)[None, :] - np.asarray(by)[:, None]
    return np.where((at >= 0) & (at < n), np.take_along_axis(x, np.clip(at, 0, n - 1), axis=1), 0)


def surfaces(x: np.ndarray, start: int, stop: int, reach: int = REACH) -> np.ndarray:
    """The strongest sample of each trace, of the polarity of the median trace's strongest one, near that one."""
    middle = np.median(x, axis=0)
    peak = start + int(np.abs(middle[start:stop]).argmax())
    low, high = max(start, peak - reach), min(stop, peak + reach + 1)
    return low + (x[:, low:high] * (-1.0 if middle[peak] < 0 else 1.0)).argmax(axis=1)


def flattened(clean: np.ndarray, top: np.ndarray, reference: int, wave: np.ndarray | None, start: int, stop: int, comparable: bool) -> tuple[np.ndarray, np.ndarray, bool]:
    """(corrected, plate, subtracted) of traces with surfaces at ``top``: moved to ``reference``; where ``comparable``, less ``wave``, the plate's median trace, at the surface's strength below it."""
    flat = moved(clean, reference - top)
    if wave is None or len(wave) != clean.shape[1]:
        return flat, np.zeros(clean.shape[1]), False
    peak = start + int(np.abs(wave[start:stop]).argmax())
    plate = moved(wave[None], np.array([reference - peak]))[0]
    strength = plate[reference]
    if not comparable or abs(strength) <= 1e-9:
        return flat, plate, False
    less = flat.copy()
    less[:, reference:] -= (flat[:, reference] / strength)[:, None] * plate[None, reference:]
    padded = np.pad(less, ((0, 0), (1, 1)), mode="edge")
    return np.median(np.lib.stride_tricks.sliding_window_view(padded, 3, axis=1), axis=2), plate, True


def calibrated(road: np.ndarray, plate: np.ndarray | None, start: int, stop: int, same_setup: bool = True, clipped: float | None = None) -> dict:
    """A road with its surface made flat and, where the plate was recorded alike, the plate's waveform at the surface's strength taken away below it.

    Traces of another gain, antenna or range, or a plate that is clipped (the share of samples at ``clipped``), cannot be compared:
    then only the surface is made flat, as a scaled plate would rewrite deep events.
    """
    clean = dewowed(road)
    top = surfaces(clean, start, stop)
    reference = int(np.median(top))
    usable = plate is not None and plate.shape[1] == road.shape[1]
    clipping = float((np.abs(plate) >= clipped).mean()) if usable and clipped is not None else 0.0
    corrected, at, subtracted = flattened(clean, top, reference, np.median(dewowed(plate), axis=0) if usable else None, start, stop, same_setup and clipping < 1e-5)
    return {"corrected": corrected, "surface": top, "reference": reference, "amplitude": clean[np.arange(len(clean)), top], "subtracted": subtracted, "plate": at, "clipping": clipping}


def _by_road(fn: Callable[[pa.RecordBatch], dict]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``fn`` on what each road has in a batch: it gives the columns beside road and row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            roads = np.asarray(batch["road"].dictionary_encode().indices)
            for k in np.unique(roads):
                part = batch.take(pa.array(np.flatnonzero(roads == k)))
                yield pa.RecordBatch.from_pydict({"road": part["road"], "row": part["row"]} | fn(part))

    return run


def _lists(x: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(np.ascontiguousarray(x).ravel()))


def calibrated_traces(rows: DataFrame, plate: str, same_setup: Column, start: int, stop: int) -> DataFrame:
    """``calibrated`` of every road of ``rows`` (road, row, samples) with the road ``plate`` as the plate, a batch of traces at a time: (road, row, surface, reference, subtracted, corrected).

    What a trace needs of its road is a polarity, a range and a reference, and of the plate its median trace: exact medians by road and sample, by samples' numbers
    from ``start`` to ``stop`` and for the plate by all, so no task holds a road or the plate. Without a plate only the surfaces are made flat.
    """
    kind = dict(rows.dtypes)["row"]
    cleaned = rows.mapInArrow(_by_road(lambda part: {"clean": _lists(dewowed(matrix(pa.chunked_array([part["samples"]]))))}), f"road string, row {kind}, clean array<double>")
    cleaned = held(cleaned, "calibrated-clean")
    is_plate = F.col("road") == plate
    # The plate's samples all count; of other roads those among which the surface is.
    few = F.when(is_plate, F.col("clean")).otherwise(F.slice("clean", start + 1, stop - start))
    samples = cleaned.select("road", F.posexplode(few).alias("k", "v")).withColumn("k", F.when(is_plate, F.col("k")).otherwise(F.col("k") + start))
    medians = held(exact_median(samples, ["road", "k"], "v", "m"), "calibrated-medians")
    strongest = F.min(F.struct((-F.abs("m")).alias("o"), "k", (F.col("m") < 0).alias("negative")))
    peaks = medians.filter(F.col("k").between(start, stop - 1)).groupBy("road").agg(strongest.alias("p"))
    low, high = F.greatest(F.lit(start), F.col("p.k") - REACH), F.least(F.lit(stop), F.col("p.k") + REACH + 1)
    bounds = peaks.select("road", low.alias("low"), high.alias("high"), F.col("p.negative").alias("negative"))
    near = F.slice("clean", F.col("low") + 1, F.col("high") - F.col("low"))
    near = F.when(F.col("negative"), F.transform(near, lambda v: -v)).otherwise(near)
    topped = cleaned.join(bounds, "road").withColumn("near", near).withColumn("surface", (F.col("low") + F.array_position("near", F.array_max("near")) - 1).cast("int")).select("road", "row", "clean", "surface")
    wave = medians.filter(is_plate).agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "m"))), lambda p: p["m"]).alias("wave"))
    # One row, the plate's median trace, beside one row a road.
    model = exact_median(topped.select("road", "surface"), ["road"], "surface", "m").select("road", F.col("m").cast("int").alias("reference")).join(F.broadcast(wave))
    model = held(model.withColumn("comparable", same_setup), "calibrated-model")

    def finish(part: pa.RecordBatch) -> dict:
        reference, wave = part["reference"][0].as_py(), np.array(part["wave"][0].as_py())
        corrected, _, subtracted = flattened(matrix(pa.chunked_array([part["clean"]])), part["surface"].to_numpy(), reference, wave if len(wave) else None, start, stop, part["comparable"][0].as_py())
        return {"surface": part["surface"], "reference": part["reference"], "subtracted": pa.array([subtracted] * len(part)), "corrected": _lists(corrected)}

    return topped.join(model, "road").mapInArrow(_by_road(finish), f"road string, row {kind}, surface int, reference int, subtracted boolean, corrected array<double>")
