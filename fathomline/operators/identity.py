"""Rules on candidate picks of a road: scores of features, emissions, costs of steps, conflicts with seeds. Column expressions only.

Constants are fixed values that results depend on.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Feature numbers and their weights, fixed values: what shows that something reflects, and that it is the seeded interface.
DETECTION = {4: 0.27, 5: 0.16, 6: 0.16, 7: 0.08, 8: 0.15, 9: 0.08, 10: 0.10}
IDENTITY = {0: 0.48, 2: 0.22, 3: 0.10, 11: 0.09, 14: 0.06, 13: 0.05}
#: One weight a feature, of the first seeded layer and without seeds; the last feature is the design's and has none.
SEEDED = [0.25, 0.0, 0.15, 0.05, 0.06, 0.05, 0.04, 0.03, 0.02, 0.03, 0.07, 0.08, 0.04, 0.03, 0.05, 0.05]
UNSEEDED = [0.0, 0.0, 0.0, 0.0, 0.20, 0.16, 0.14, 0.10, 0.14, 0.04, 0.12, 0.0, 0.0, 0.0, 0.0, 0.10]
#: Costs a unit of slope, of curvature, of unlike waveforms, of phase, of polarity, and of a step into or out of no pick: ordinary and at a structural break.
STEP = {"slope": (0.030, 0.008), "curve": (0.008, 0.002), "waveform": (0.12, 0.12), "phase": (0.14, 0.035), "polarity": (0.10, 0.025), "null": (1.10, 0.22)}


def clip01(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))


def _weighted(features: Column, weights: dict[int, float]) -> Column:
    out = F.lit(0.0)
    for k, w in weights.items():
        if w:
            out = out + F.lit(w) * F.get(features, F.lit(k))
    return out


def radar_score(features: Column, layer: Column, seeded: Column) -> Column:
    """Of a seeded deeper layer the geometric mean of detection and identity, else a weighted sum."""
    deep = F.sqrt(clip01(_weighted(features, DETECTION)) * clip01(_weighted(features, IDENTITY)))
    plain = F.when(seeded, _weighted(features, dict(enumerate(SEEDED)))).otherwise(_weighted(features, dict(enumerate(UNSEEDED))))
    return F.when(seeded & (layer >= 2), deep).otherwise(clip01(plain))


def lobe_code(value: Column) -> Column:
    """1 for a trough, 2 for a peak, 3 for neither."""
    return F.when(value < 0, 1).when(value > 0, 2).otherwise(3)


def lobe_supported(samples: Column, at: Column, pulse: float) -> Column:
    """Whether the amplitude at a sample is a quarter of the largest within a third of a pulse."""
    radius = max(2, round(pulse / 3))
    start = F.greatest(at - radius, F.lit(0))
    peak = F.array_max(F.transform(F.slice(samples, (start + 1).cast("int"), (at + radius - start + 1).cast("int")), lambda v: F.abs(v)))
    return (peak > 0) & (F.abs(F.get(samples, at)) >= 0.25 * peak)


def emission(score: Column, design: Column, tracklet: Column, reachable: Column, guide: Column, layer: Column, weight: float = 0.05) -> Column:
    """The value of choosing a candidate: its score blended with the design's, helped by a tracklet, less guidance and missing lineage of deeper layers."""
    w = min(max(weight, 0.0), 0.10)
    value = 1.55 * ((1 - w) * score + w * design) - 0.75 + 0.25 * tracklet
    return value + F.when(layer >= 2, guide).otherwise(0.0) - F.when((layer >= 2) & ~reachable, 0.18).otherwise(0.0)


def step_cost(old: Column, prior: Column, chosen: Column, waveform: Column, phase_a: Column, phase_b: Column, pole_a: Column, pole_b: Column, broken: Column, dx: float) -> Column:
    """What a step from ``prior`` to ``chosen`` costs, after ``old``: samples below 0 are no pick."""
    rate = lambda name: F.when(broken, STEP[name][1]).otherwise(STEP[name][0])
    step = max(dx, 1e-3)
    slope, before = (chosen - prior) / step, (prior - old) / step
    curve = F.when(old >= 0, rate("curve") * F.abs((slope - before) / step)).otherwise(0.0)
    off = F.abs(phase_a - phase_b)
    phase = F.when((phase_a >= 0) & (phase_b >= 0), rate("phase") * F.least(off, 8 - off) / 4).otherwise(0.0)
    pole = F.when((pole_a != 0) & (pole_b != 0) & (pole_a != pole_b), rate("polarity")).otherwise(0.0)
    none, also = prior < 0, chosen < 0
    return F.when(none & also, 0.0).when(none != also, rate("null")).otherwise(rate("slope") * F.abs(slope) + curve + rate("waveform") * (1 - waveform) + phase + pole)


def envelope_penalty(sample: Column, left: Column, right: Column, pulse: float) -> Column:
    """A ramp over a pulse, 0.35 at most, outside the samples of both seeds by more than two pulses."""
    width = max(1.0, pulse)
    outside = F.greatest(F.least(left, right) - 2 * width - sample, sample - F.greatest(left, right) - 2 * width)
    return F.when(sample < 0, 0.0).otherwise(0.35 * clip01(outside / width))


def seeds_needed(layer: Column, samples: Column) -> Column:
    """Three observations of a deeper layer, or where two disagree by more than a fifth of their median and 14 samples; else two."""
    first, second = F.get(samples, F.lit(0)), F.get(samples, F.lit(1))
    apart = (F.size(samples) == 2) & (F.abs(second - first) > F.greatest(F.lit(14.0), 0.20 * (first + second) / 2))
    return F.when((layer >= 2) | apart, 3).otherwise(2)


def stack_of(requested: Column, spacing: Column) -> Column:
    """The traces to stack: as asked, else what spans 0.4 m, one at least."""
    return F.when(requested > 0, requested).when(spacing > 0, F.greatest(F.lit(1), F.ceil(F.lit(0.4) / spacing))).otherwise(1).cast("long")
