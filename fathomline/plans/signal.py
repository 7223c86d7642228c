"""Signal queries on traces."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from ..operators import signal
from .registry import register
from .tables import read
from .windows import SQL_CELLS


@register(
    "cosine_shift_similarity",
    """WITH t AS (SELECT a.vec_id, a.embedding AS x, b.embedding AS y FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1), s AS (SELECT *, unnest(range(-2, 3)) AS shift FROM t),
    c AS (SELECT vec_id, shift, sum(CAST(x[k] AS DOUBLE) * CASE WHEN k + shift BETWEEN 1 AND 64 THEN CAST(y[k + shift] AS DOUBLE) ELSE 0 END) AS dot, sum(CAST(x[k] AS DOUBLE) ** 2) AS xx, sum(CASE WHEN k + shift BETWEEN 1 AND 64 THEN CAST(y[k + shift] AS DOUBLE) ** 2 ELSE 0 END) AS yy FROM s, (SELECT unnest(range(1, 65)) AS k) GROUP BY 1, 2)
    SELECT vec_id, round(max(dot / sqrt(xx * yy)), 6) AS similarity FROM c GROUP BY 1""",
)
def cosine_shift_similarity(spark, d):
    """Best cosine of neighbouring traces over shifts of up to two samples, zeros beyond the ends; column expressions over two arrays."""
    emb = read(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    pairs = emb.join(emb.select((F.col("vec_id") - 1).alias("vec_id"), F.col("x").alias("y")), "vec_id")
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
    square = lambda a: total(F.transform(a, lambda v: v * v))

    def cosine(shift: int):
        n = 64 - abs(shift)
        x, y = F.slice("x", max(1, 1 - shift), n), F.slice("y", max(1, 1 + shift), n)
        return total(F.zip_with(x, y, lambda a, b: a * b)) / F.sqrt(square(F.col("x")) * square(y))

    return pairs.select("vec_id", F.round(F.greatest(*[cosine(s) for s in range(-2, 3)]), 6).alias("similarity"))


@register(
    "waveform_normalised",
    """WITH c AS (SELECT vec_id, CAST(k - 1 AS INTEGER) AS k, CAST(embedding[k] AS DOUBLE) AS v FROM embeddings, (SELECT unnest(range(1, 65)) AS k)), m AS (SELECT *, v - avg(v) OVER (PARTITION BY vec_id) AS u FROM c), n AS (SELECT *, sqrt(sum(u * u) OVER (PARTITION BY vec_id)) AS size FROM m) SELECT vec_id, k, round(CASE WHEN size > 1e-9 THEN u / size END, 6) AS value FROM n""",
)
def waveform_normalised(spark, d):
    arr = read(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
    centred = arr.select("vec_id", F.transform("x", lambda v: v - total(F.col("x")) / F.size("x")).alias("u"))
    sized = centred.withColumn("size", F.sqrt(total(F.transform("u", lambda v: v * v))))
    return sized.select("vec_id", "size", F.posexplode("u").alias("k", "u")).select("vec_id", "k", F.round(F.when(F.col("size") > 1e-9, F.col("u") / F.col("size")), 6).alias("value"))


@register("shifted_template", "SELECT vec_id, CAST(k - 1 AS INTEGER) AS k, CASE WHEN k - (vec_id % 7 - 3) BETWEEN 1 AND 64 THEN round(CAST(embedding[k - (vec_id % 7 - 3)] AS DOUBLE), 6) ELSE 0 END AS value FROM embeddings, (SELECT unnest(range(1, 65)) AS k)")
def shifted_template(spark, d):
    """Zero-filled shifts by a whole number of samples that differs by trace."""
    rows = read(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"), (F.col("vec_id") % 7 - 3).cast("int").alias("s"))
    moved = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.coalesce(F.when(i - F.col("s") >= 0, F.get("x", i - F.col("s"))), F.lit(0.0)))
    return rows.select("vec_id", F.posexplode(moved).alias("k", "v")).select("vec_id", "k", F.round("v", 6).alias("value"))


def _traces(spark, d):
    return read(spark, d, "embeddings").select("vec_id", "embedding")


def _samples(df, column, name):
    """(vec_id, k, name) of arrays, rounded."""
    return df.select("vec_id", F.posexplode(column).alias("k", "v")).select("vec_id", "k", F.round("v", 6).alias(name))


#: The analytic signal of 64 samples as a sum over every second sample.
SQL_ANALYTIC = f"{SQL_CELLS}, z AS (SELECT a.vec_id, a.label, a.k, any_value(a.v) AS re, sum(CASE WHEN (a.k - b.k) % 2 <> 0 THEN b.v / 32 / tan({math.pi} * (a.k - b.k) / 64) ELSE 0 END) AS im FROM cell a JOIN cell b ON b.vec_id = a.vec_id GROUP BY 1, 2, 3)"


@register("analytic_envelope", f"WITH {SQL_ANALYTIC} SELECT vec_id, k, round(sqrt(re * re + im * im), 6) AS envelope FROM z")
def analytic_envelope(spark, d):
    """Envelopes of all traces."""
    return _samples(signal.per_trace(_traces(spark, d), "vec_id", "embedding", signal.envelope, "x"), "x", "envelope")


@register("cosine_phase", f"WITH {SQL_ANALYTIC} SELECT vec_id, k, round(re / sqrt(re * re + im * im), 6) AS phase FROM z")
def cosine_phase(spark, d):
    return _samples(signal.per_trace(_traces(spark, d), "vec_id", "embedding", signal.cosine_phase, "x"), "x", "phase")


def _list(values) -> str:
    return "[" + ", ".join(repr(float(v)) for v in values) + "]::DOUBLE[]"


def _band_kernel(low: float, high: float, n: int = 64) -> np.ndarray:
    """What the band-pass does to one sample of a mirrored trace of 3 * n."""
    f = np.fft.rfftfreq(3 * n)
    gain = 1 / (1 + (f / high) ** 8) / (1 + (low / np.where(f == 0, 1e-12, f)) ** 8)
    return np.fft.irfft(gain, 3 * n)


@register(
    "band_pass",
    f"WITH {SQL_CELLS}, g AS (SELECT {_list(_band_kernel(0.05, 0.3))} AS g), m AS (SELECT vec_id, v, unnest([63 - k, 64 + k, 191 - k]) AS at FROM cell) SELECT a.vec_id, a.k, round(sum(m.v * g.g[(a.k + 64 - m.at + 192) % 192 + 1]), 6) AS filtered FROM cell a JOIN m ON m.vec_id = a.vec_id, g GROUP BY 1, 2",
)
def band_pass(spark, d):
    """A zero-phase band of mirrored traces."""
    return _samples(signal.per_trace(_traces(spark, d), "vec_id", "embedding", lambda x: signal.band_pass(x, 0.05, 0.3), "x"), "x", "filtered")


def _hat(width: float) -> np.ndarray:
    reach = int(np.ceil(5 * width))
    t = np.arange(-reach, reach + 1) / width
    return (1 - t**2) * np.exp(-(t**2) / 2)


_HATS = ", ".join(f"({w}, {int(np.ceil(5 * w))}, {_list(_hat(w))})" for w in (2.0, 3.0, 4.5))


@register(
    "wavelet_ridges",
    f"WITH {SQL_CELLS}, h(w, reach, g) AS (VALUES {_HATS}), r AS (SELECT a.vec_id, a.k, w, abs(sum(b.v * g[a.k - b.k + reach + 1])) AS r FROM cell a JOIN h ON true JOIN cell b ON b.vec_id = a.vec_id AND abs(a.k - b.k) <= reach GROUP BY 1, 2, 3), m AS (SELECT vec_id, k, max(r) AS r FROM r GROUP BY 1, 2) SELECT vec_id, k, round(r / greatest(max(r) OVER (PARTITION BY vec_id), 1e-12), 6) AS ridge FROM m",
)
def wavelet_ridges(spark, d):
    """The largest response of a few Mexican hats, by trace."""
    return _samples(signal.per_trace(_traces(spark, d), "vec_id", "embedding", signal.ricker_ridges, "x"), "x", "ridge")


@register("soft_denoise")
def soft_denoise(spark, d):
    return signal.per_trace(_traces(spark, d), "vec_id", "embedding", signal.soft_denoise, "denoised")


@register("mixed_phase_reflectivity")
def mixed_phase_reflectivity(spark, d):
    return signal.per_trace(_traces(spark, d), "vec_id", "embedding", lambda x: signal.sparsest_rotation(x)[1], "reflectivity")


@register(
    "plate_alignment",
    f"WITH {SQL_CELLS}, t AS (SELECT k, median(v) AS m FROM cell GROUP BY 1), s AS (SELECT unnest(range(-4, 5)) AS shift), d AS (SELECT c.vec_id, shift, sum(c.v * t.m) AS dot FROM s JOIN cell c ON true JOIN t ON t.k = c.k + shift GROUP BY 1, 2), b AS (SELECT vec_id, arg_min(shift, (-round(dot, 10), abs(shift), shift)) AS shift FROM d GROUP BY 1) SELECT a.vec_id, a.k, b.shift, round(coalesce(c.v, 0), 6) AS value FROM cell a JOIN b ON b.vec_id = a.vec_id LEFT JOIN cell c ON c.vec_id = a.vec_id AND c.k = a.k - b.shift",
)
def plate_alignment(spark, d):
    """Every trace moved to fit the median trace, one row of 64 values."""
    x = read(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    medians = x.select(F.posexplode("x").alias("k", "v")).groupBy("k").agg(F.median("v").alias("m"))
    target = medians.agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "m"))), lambda p: p["m"]).alias("t"))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
    moved = lambda s: F.transform("x", lambda v, k: F.coalesce(F.when(k - s >= 0, F.get("x", k - s)), F.lit(0.0)))
    fits = F.array(*[F.struct((-F.round(total(F.zip_with(moved(F.lit(s)), F.col("t"), lambda a, b: a * b)), 10)).alias("o"), F.lit(abs(s)).alias("far"), F.lit(s).alias("shift")) for s in range(-4, 5)])
    best = x.join(F.broadcast(target)).withColumn("shift", F.array_min(fits)["shift"])
    return best.select("vec_id", "shift", F.posexplode(moved(F.col("shift"))).alias("k", "v")).select("vec_id", "k", "shift", F.round("v", 6).alias("value"))
