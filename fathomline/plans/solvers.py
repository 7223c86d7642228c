"""Queries that run a sequential solver or a grid transform for each road or block. Solvers have no SQL; tests compare them with enumeration."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..operators import grids, selection, solvers
from .registry import register
from .signal import SQL_ANALYTIC
from .tables import read
from .windows import SQL_CELLS


def _roads(spark, d):
    """(label, vec_id, s): whole traces. A road is solved in one run."""
    return read(spark, d, "embeddings").select("label", "vec_id", F.col("embedding").cast("array<double>").alias("s"))


@register("second_order_paths")
def second_order_paths(spark, d):
    def solve(scores):
        path, value = solvers.second_order_path(scores, 0.03, 0.008)
        return [{"path": path.tolist(), "score": value}]

    return solvers.grouped(_roads(spark, d), ["label"], "vec_id", "s", solve, "label int, path array<int>, score double")


@register("k_best_paths")
def k_best_paths(spark, d):
    def solve(scores):
        return [{"rank": k + 1, "path": p, "score": v} for k, (p, v) in enumerate(solvers.best_paths(scores, 0.05, 3, 1))]

    return solvers.grouped(_roads(spark, d), ["label"], "vec_id", "s", solve, "label int, rank int, path array<int>, score double")


@register("layered_beam_paths")
def layered_beam_paths(spark, d):
    def solve(scores):
        path, value = solvers.layered_beam([scores, scores[:, ::-1]], 0.05, 1, 64)
        return [{"upper": path[:, 0].tolist(), "lower": path[:, 1].tolist(), "score": value}]

    return solvers.grouped(_roads(spark, d), ["label"], "vec_id", "s", solve, "label int, upper array<int>, lower array<int>, score double")


def _grid(spark, d, fn, margin, out):
    emb = read(spark, d, "embeddings").select("label", "vec_id", "embedding")
    numbered = selection.numbered(emb, ["label"], "vec_id", "row")
    made = grids.over_blocks(numbered, ["label"], "row", "embedding", fn, 64, margin, out)
    return made.select("label", "row", F.posexplode(out).alias("k", "v")).select("label", "row", "k", F.round("v", 6).alias(out))


#: The samples of numbered traces, and their last number.
SQL_GRID = f"{SQL_CELLS}, t AS (SELECT vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS row, count(*) OVER (PARTITION BY label) - 1 AS last FROM embeddings), g AS (SELECT c.label, t.row, t.last, c.k, c.v FROM cell c JOIN t ON t.vec_id = c.vec_id)"
WAVELET = (1 - (np.arange(-6, 7) / 2.5) ** 2) * np.exp(-((np.arange(-6, 7) / 2.5) ** 2) / 2)
_SLOPES = "[" + ", ".join(f"{{'s': {s}, 'd': {[int(round(s * k)) for k in range(-3, 4)]}}}" for s in (-1.5, -1, -0.5, 0, 0.5, 1, 1.5)) + "]"


@register(
    "oriented_coherence",
    f"WITH {SQL_GRID}, s AS (SELECT unnest({_SLOPES}) AS s), o AS (SELECT s.s.s AS slope, unnest(range(-3, 4)) AS off, s.s.d AS d FROM s), p AS (SELECT a.label, a.row, a.k, slope, sum(b.v) AS total, sum(b.v * b.v) AS power FROM g a JOIN o ON true JOIN g b ON b.label = a.label AND b.row = least(greatest(a.row + off, 0), a.last) AND b.k = least(greatest(a.k + d[off + 4], 0), 63) GROUP BY 1, 2, 3, 4) SELECT label, row, k, round(max(total * total / greatest(7 * power, 1e-12)), 6) AS coherence FROM p GROUP BY 1, 2, 3",
)
def oriented_coherence(spark, d):
    """Semblance along the best of seven slopes."""
    return _grid(spark, d, grids.oriented_coherence, 3, "coherence")


@register(
    "structure_slope",
    f"WITH {SQL_GRID}, e AS (SELECT a.label, a.row, a.last, a.k, (CASE WHEN a.row IN (0, a.last) THEN 1 ELSE 0.5 END) * (d.v - u.v) AS gy, (CASE WHEN a.k IN (0, 63) THEN 1 ELSE 0.5 END) * (r.v - l.v) AS gx FROM g a JOIN g u ON u.label = a.label AND u.k = a.k AND u.row = greatest(a.row - 1, 0) JOIN g d ON d.label = a.label AND d.k = a.k AND d.row = least(a.row + 1, a.last) JOIN g l ON l.label = a.label AND l.row = a.row AND l.k = greatest(a.k - 1, 0) JOIN g r ON r.label = a.label AND r.row = a.row AND r.k = least(a.k + 1, 63)), o AS (SELECT unnest(range(-2, 3)) AS i), q AS (SELECT unnest(range(-2, 3)) AS j), m AS (SELECT a.label, a.row, a.k, sum(b.gx * b.gx) / 25 AS xx, sum(b.gx * b.gy) / 25 AS xy FROM e a, o, q JOIN e b ON b.label = a.label AND b.row = least(greatest(a.row + i, 0), a.last) AND b.k = least(greatest(a.k + j, 0), 63) GROUP BY 1, 2, 3) SELECT label, row, k, round(-xy / greatest(xx, 1e-12), 6) AS slope FROM m",
)
def structure_slope(spark, d):
    """Samples a trace along which the image changes least."""
    return _grid(spark, d, grids.structure_slope, 3, "slope")


@register(
    "lateral_phase_coherence",
    f"WITH {SQL_ANALYTIC}, t AS (SELECT vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS row, count(*) OVER (PARTITION BY label) - 1 AS last FROM embeddings), g AS (SELECT z.label, t.row, t.last, z.k, re, im FROM z JOIN t ON t.vec_id = z.vec_id), o AS (SELECT unnest(range(-4, 5)) AS i), m AS (SELECT a.label, a.row, a.k, avg(b.re) AS re, avg(b.im) AS im, avg(sqrt(b.re * b.re + b.im * b.im)) AS size FROM g a, o JOIN g b ON b.label = a.label AND b.k = a.k AND b.row = least(greatest(a.row + i, 0), a.last) GROUP BY 1, 2, 3) SELECT label, row, k, round(sqrt(re * re + im * im) / greatest(size, 1e-12), 6) AS coherence FROM m",
)
def lateral_phase_coherence(spark, d):
    """How far nine neighbouring traces agree in phase."""
    return _grid(spark, d, grids.lateral_phase_coherence, 4, "coherence")


def _inverse_kernel(wavelet: np.ndarray, n: int = 64, ridge: float = 0.05) -> np.ndarray:
    w = np.fft.rfft(wavelet, n)
    power = np.abs(w) ** 2
    return np.fft.irfft(np.conj(w) / (power + ridge * power.max()), n)


@register(
    "deconvolution",
    f"WITH {SQL_GRID}, h AS (SELECT {[float(v) for v in _inverse_kernel(WAVELET)]}::DOUBLE[] AS h) SELECT a.label, a.row, a.k, round(sum(b.v * h.h[(a.k - b.k + 64) % 64 + 1]), 6) AS reflectivity FROM g a JOIN g b ON b.label = a.label AND b.row = a.row, h GROUP BY 1, 2, 3",
)
def deconvolution(spark, d):
    """Traces through the inverse of a wavelet."""
    return _grid(spark, d, lambda x: grids.deconvolved(x, WAVELET), 0, "reflectivity")


@register(
    "packet_correlation",
    f"WITH {SQL_GRID}, h AS (SELECT {[float(v) for v in (WAVELET - WAVELET.mean()) / np.linalg.norm(WAVELET - WAVELET.mean())]}::DOUBLE[] AS h), w AS (SELECT a.label, a.row, a.k, count(*) AS n, sum(b.v * h.h[b.k - a.k + 7]) AS dot, sum(b.v * b.v) - sum(b.v) * sum(b.v) / 13 AS size FROM g a JOIN g b ON b.label = a.label AND b.row = a.row AND abs(b.k - a.k) <= 6, h GROUP BY 1, 2, 3) SELECT label, row, k, round(CASE WHEN n = 13 THEN dot / greatest(sqrt(greatest(size, 0)), 1e-12) ELSE 0 END, 6) AS correlation FROM w",
)
def packet_correlation(spark, d):
    """Normalised correlation of a wavelet with every window."""
    return _grid(spark, d, lambda x: grids.packet_correlation(x, WAVELET), 0, "correlation")


@register("pair_logistic_scores")
def pair_logistic_scores(spark, d):
    """Ridge logistic regression of labelled quality on document statistics, fitted on 2,000 labelled rows at most, the first by hash, and scored on all."""
    docs = read(spark, d, "documents").select("doc_id", F.log1p(F.col("n_chars").cast("double")).alias("a"), (F.length(F.regexp_replace("text", "[^A-Z]", "")) / F.greatest("n_chars", F.lit(1))).alias("b"), (F.length(F.regexp_replace("text", r"[^!*$%&#|]", "")) / F.greatest("n_chars", F.lit(1))).alias("c"))
    chosen = read(spark, d, "labels").select("doc_id", "quality").orderBy(F.xxhash64("doc_id"), "doc_id").limit(2000)
    rows = docs.join(F.broadcast(chosen), "doc_id").toPandas().sort_values("doc_id")
    x = rows[["a", "b", "c"]].to_numpy(float)
    mean, std = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-9)
    y = rows["quality"].to_numpy(float)
    weight = np.where(y == 1, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9))
    beta, intercept = solvers.logistic((x - mean) / std, y, weight, 1.0)
    z = F.lit(float(intercept))
    for name, b, m, s in zip("abc", beta, mean, std, strict=True):
        z = z + F.lit(float(b)) * (F.col(name) - F.lit(float(m))) / F.lit(float(s))
    return docs.select("doc_id", F.round(1 / (1 + F.exp(-z)), 6).alias("score"))
