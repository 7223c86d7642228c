"""Seed guidance and search corridors along an axis."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .registry import register
from .tables import SQL_EVENTS, events


def _around(spark, d):
    """Rows of purchases with the seeds, user signups by place, before and after them: (event_id, user_id, sec, value, bx, bv, ax, av)."""
    seeds = events(spark, d, "signup").groupBy("user_id", "sec").agg(F.avg("value").alias("v"))
    both = events(spark, d, "purchase").select("event_id", "user_id", "sec", "value", F.lit(None).cast("double").alias("v")).unionByName(seeds.select(F.lit(None).cast("long").alias("event_id"), "user_id", "sec", F.lit(None).cast("double").alias("value"), "v"))
    w = Window.partitionBy("user_id").orderBy("sec")
    mark = F.when(F.col("v").isNotNull(), F.struct("sec", "v"))
    back, on = w.rangeBetween(Window.unboundedPreceding, 0), w.rangeBetween(0, Window.unboundedFollowing)
    at = both.withColumn("b", F.max(mark).over(back)).withColumn("a", F.min(mark).over(on)).filter("event_id is not null")
    return at.select("event_id", "user_id", "sec", "value", F.col("b.sec").alias("bx"), F.col("b.v").alias("bv"), F.col("a.sec").alias("ax"), F.col("a.v").alias("av"))


SQL_AROUND = f"""WITH {SQL_EVENTS}, s AS (SELECT user_id, sec, avg(value) AS v FROM ev WHERE event_type = 'signup' GROUP BY 1, 2), r AS (SELECT e.event_id, e.sec, e.value, b.sec AS bx, b.v AS bv, a.sec AS ax, a.v AS av FROM ev e
    LEFT JOIN LATERAL (SELECT * FROM s WHERE s.user_id = e.user_id AND s.sec <= e.sec ORDER BY s.sec DESC LIMIT 1) b ON true LEFT JOIN LATERAL (SELECT * FROM s WHERE s.user_id = e.user_id AND s.sec >= e.sec ORDER BY s.sec LIMIT 1) a ON true WHERE e.event_type = 'purchase'),
    g AS (SELECT *, CASE WHEN bx IS NULL THEN av WHEN ax IS NULL OR ax = bx THEN bv ELSE bv + (av - bv) * (sec - bx)::DOUBLE / (ax - bx) END AS guide, 2.0 + 0.04 * least(coalesce(sec - bx, 1e18), coalesce(ax - sec, 1e18)) / 3600.0::DOUBLE AS sigma FROM r)"""


def _guide(spark, d):
    r = _around(spark, d)
    b, a, x = F.col("bx"), F.col("ax"), F.col("sec")
    guide = F.when(b.isNull(), F.col("av")).when(a.isNull() | (a == b), F.col("bv")).otherwise(F.col("bv") + (F.col("av") - F.col("bv")) * (x - b) / F.when(a > b, a - b))
    far = F.least(F.coalesce((x - b).cast("double"), F.lit(1e18)), F.coalesce((a - x).cast("double"), F.lit(1e18)))
    return r.withColumn("guide", guide).withColumn("sigma", 2.0 + 0.04 * far / 3600.0)


@register("seed_guide", f"{SQL_AROUND} SELECT event_id, round(guide, 6) AS guide, round(CASE WHEN guide IS NOT NULL THEN sigma END, 6) AS sigma, coalesce(abs(av - bv) > 50, false) AS ambiguous FROM g")
def seed_guide(spark, d):
    """Linear guide between seeds, held outside them, its uncertainty growing with the way to the nearest seed."""
    g = _guide(spark, d)
    return g.select("event_id", F.round("guide", 6).alias("guide"), F.round(F.when(F.col("guide").isNotNull(), F.col("sigma")), 6).alias("sigma"), F.coalesce(F.abs(F.col("av") - F.col("bv")) > 50, F.lit(False)).alias("ambiguous"))


@register("guide_scores", f"{SQL_AROUND} SELECT event_id, round(-0.35 * (1 - exp(-0.5 * ((value - guide) / sigma) ** 2)), 6) AS penalty, coalesce(abs(value - guide) > greatest(8.0, 2.5 * sigma), false) AS conflict FROM g")
def guide_scores(spark, d):
    off = F.col("value") - F.col("guide")
    return _guide(spark, d).select("event_id", F.round(-0.35 * (1 - F.exp(-0.5 * F.pow(off / F.col("sigma"), F.lit(2)))), 6).alias("penalty"), F.coalesce(F.abs(off) > F.greatest(F.lit(8.0), 2.5 * F.col("sigma")), F.lit(False)).alias("conflict"))


@register(
    "search_corridors",
    f"""{SQL_AROUND}, c AS (SELECT event_id, guide, greatest(guide * 0.6, guide - 3 * sigma) AS lo, least(guide * 1.4, guide + 3 * sigma) AS hi FROM g WHERE guide IS NOT NULL) SELECT event_id, round(lo, 6) AS lower, round(guide, 6) AS centre, round(hi, 6) AS upper, round(hi - lo, 6) AS width FROM c""",
)
def search_corridors(spark, d):
    g = _guide(spark, d).filter("guide is not null")
    lo, hi = F.greatest(F.col("guide") * 0.6, F.col("guide") - 3 * F.col("sigma")), F.least(F.col("guide") * 1.4, F.col("guide") + 3 * F.col("sigma"))
    return g.select("event_id", F.round(lo, 6).alias("lower"), F.round("guide", 6).alias("centre"), F.round(hi, 6).alias("upper"), F.round(hi - lo, 6).alias("width"))


@register("seed_position_penalty", f"{SQL_AROUND} SELECT event_id, round(CASE WHEN bv IS NULL AND av IS NULL THEN NULL ELSE 0.35 * least(greatest(value - greatest(coalesce(bv, av), coalesce(av, bv)) - 4, least(coalesce(bv, av), coalesce(av, bv)) - 4 - value, 0) / 12, 1) END, 6) AS penalty FROM g")
def seed_position_penalty(spark, d):
    """A capped ramp outside the envelope of the seeds on both sides."""
    b, a = F.coalesce("bv", "av"), F.coalesce("av", "bv")
    out = F.greatest(F.col("value") - F.greatest(b, a) - 4, F.least(b, a) - 4 - F.col("value"), F.lit(0.0))
    return _guide(spark, d).select("event_id", F.round(F.when(b.isNotNull(), 0.35 * F.least(out / 12, F.lit(1.0))), 6).alias("penalty"))
