"""Scoring of selective predictions: cohorts, curves, gates, intervals, blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The normal quantile of a 95 % interval.
Z95 = 1.959963984540054
#: Right edges in m of the distance bins between a prediction and its nearest seed; the last is open.
DISTANCE_EDGES = (5.0, 25.0, 100.0, 250.0)


def rate(part: Column, whole: Column) -> Column:
    """part / whole, null where the whole is 0: a share of nothing is undefined, not zero."""
    return F.try_divide(part.cast("double"), whole.cast("double"))


def cohort(accepted: Column, correct: Column, supplied: Column | None = None) -> list[Column]:
    """Counts of a fixed cohort. Supplied answers stay in the denominator and earn no credit."""
    own = accepted if supplied is None else accepted & ~supplied
    total, taken, right = F.count(F.lit(1)), F.count_if(own), F.count_if(own & correct)
    return [total.alias("total"), taken.alias("accepted"), right.alias("correct"), F.round(rate(right, taken), 6).alias("precision"), F.round(rate(taken, total), 6).alias("coverage"), F.round(rate(taken - right, total), 6).alias("wrong_rate")]


def wilson(success: Column, n: Column, z: float = Z95) -> tuple[Column, Column]:
    """Bounds of Wilson's score interval, null for n = 0."""
    size = F.when(n > 0, n.cast("double"))
    p = success / size
    middle = (p + z * z / (2 * size)) / (1 + z * z / size)
    half = z * F.sqrt(p * (1 - p) / size + z * z / (4 * size * size)) / (1 + z * z / size)
    # greatest and least skip nulls.
    return F.when(n > 0, F.greatest(middle - half, F.lit(0.0))), F.when(n > 0, F.least(middle + half, F.lit(1.0)))


def distance_bin(distance: Column) -> Column:
    """The number of the half-open distance bin, by DISTANCE_EDGES."""
    out = F.lit(len(DISTANCE_EDGES))
    for k, edge in reversed(list(enumerate(DISTANCE_EDGES))):
        out = F.when(distance < edge, k).otherwise(out)
    return out


def curve(df: DataFrame, keys: list[str], score: str, correct: str, thresholds: list[float]) -> DataFrame:
    """(keys, threshold, accepted, correct, precision, coverage) at every threshold.

    Rows are first counted by the number of thresholds they pass, so only a few rows for each key meet all thresholds.
    """
    passed = F.size(F.filter(F.array(*[F.lit(t) for t in thresholds]), lambda t: F.col(score) >= t))
    counts = df.groupBy(*keys, passed.alias("_p")).agg(F.count(F.lit(1)).alias("_n"), F.count_if(correct).alias("_c"))
    at = F.explode(F.sequence(F.lit(1), F.lit(len(thresholds))))
    rows = counts.withColumn("_i", at)
    own = F.col("_p") >= F.col("_i")
    out = rows.groupBy(*keys, "_i").agg(F.sum(F.when(own, F.col("_n")).otherwise(0)).alias("accepted"), F.sum(F.when(own, F.col("_c")).otherwise(0)).alias("correct"), F.sum("_n").alias("_total"))
    threshold = F.element_at(F.array(*[F.lit(t) for t in thresholds]), F.col("_i"))
    return out.select(*keys, threshold.alias("threshold"), "accepted", "correct", rate(F.col("correct"), F.col("accepted")).alias("precision"), rate(F.col("accepted"), F.col("_total")).alias("coverage"))
