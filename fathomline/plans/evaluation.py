"""Evaluation queries: cohorts, precision and coverage, thresholds, gates, blocks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluation as ev
from ..operators import selection
from .aggregates import SQL_PICKS, picks
from .registry import register
from .tables import read

THRESHOLDS = [round(0.5 + 0.02 * k, 2) for k in range(26)]
SQL_SCORED = f"WITH {SQL_PICKS}, s AS (SELECT *, confidence AS score, abs(sample - 25) <= 15 AS correct, CAST(l_orderkey % 7 AS INTEGER) AS road, l_linenumber = 1 AS supplied FROM pick)"


def scored(spark, d):
    return picks(spark, d).select("*", F.col("confidence").alias("score"), (F.abs(F.col("sample") - 25) <= 15).alias("correct"), (F.col("l_orderkey") % 7).cast("int").alias("road"), (F.col("l_linenumber") == 1).alias("supplied"))


@register(
    "fixed_cohort_scoring",
    f"""{SQL_SCORED} SELECT road, layer, count(*) AS total, count(*) FILTER (WHERE score >= 0.7 AND NOT supplied) AS accepted, count(*) FILTER (WHERE score >= 0.7 AND NOT supplied AND correct) AS correct,
    round(count(*) FILTER (WHERE score >= 0.7 AND NOT supplied AND correct) / nullif(count(*) FILTER (WHERE score >= 0.7 AND NOT supplied), 0), 6) AS precision, round(count(*) FILTER (WHERE score >= 0.7 AND NOT supplied) / count(*), 6) AS coverage, round(count(*) FILTER (WHERE score >= 0.7 AND NOT supplied AND NOT correct) / count(*), 6) AS wrong_rate FROM s GROUP BY 1, 2""",
)
def fixed_cohort_scoring(spark, d):
    return scored(spark, d).groupBy("road", "layer").agg(*ev.cohort(F.col("score") >= 0.7, F.col("correct"), F.col("supplied")))


@register(
    "distance_bins",
    f"""{SQL_SCORED} SELECT layer, CASE WHEN x % 300 < 5 THEN 0 WHEN x % 300 < 25 THEN 1 WHEN x % 300 < 100 THEN 2 WHEN x % 300 < 250 THEN 3 ELSE 4 END AS bin, CASE WHEN x < 300 THEN 'left_tail' WHEN x > 2400 THEN 'right_tail' ELSE 'bracketed' END AS segment, count(*) AS n, count(*) FILTER (WHERE correct) AS correct, round(avg(CASE WHEN correct THEN 1.0 ELSE 0.0 END), 6) AS rate FROM s GROUP BY 1, 2, 3""",
)
def distance_bins(spark, d):
    segment = F.when(F.col("x") < 300, "left_tail").when(F.col("x") > 2400, "right_tail").otherwise("bracketed")
    return scored(spark, d).groupBy("layer", ev.distance_bin(F.col("x") % 300).alias("bin"), segment.alias("segment")).agg(F.count("*").alias("n"), F.count_if("correct").alias("correct"), F.round(F.avg(F.when(F.col("correct"), 1.0).otherwise(0.0)), 6).alias("rate"))


SQL_CURVE = f"{SQL_SCORED}, t AS (SELECT unnest({THRESHOLDS}::DOUBLE[]) AS threshold), c AS (SELECT layer, road, threshold, count(*) FILTER (WHERE score >= threshold) AS accepted, count(*) FILTER (WHERE score >= threshold AND correct) AS correct, count(*) AS total FROM s, t GROUP BY 1, 2, 3)"


@register("precision_coverage_curve", f"{SQL_CURVE} SELECT layer, threshold, CAST(sum(accepted) AS BIGINT) AS accepted, CAST(sum(correct) AS BIGINT) AS correct, round(sum(correct) / nullif(sum(accepted), 0), 6) AS precision, round(sum(accepted) / sum(total), 6) AS coverage FROM c GROUP BY 1, 2")
def precision_coverage_curve(spark, d):
    out = ev.curve(scored(spark, d), ["layer"], "score", "correct", THRESHOLDS)
    return out.select("layer", "threshold", "accepted", "correct", F.round("precision", 6).alias("precision"), F.round("coverage", 6).alias("coverage"))


@register(
    "threshold_selection",
    f"""{SQL_CURVE}, g AS (SELECT layer, threshold, avg(accepted / total) AS macro, bool_and(accepted >= 30 AND correct / nullif(accepted, 0) >= 0.55) AS passes FROM c GROUP BY 1, 2), p AS (SELECT * FROM g WHERE passes)
    SELECT layer, arg_min(threshold, (-round(macro, 9), threshold)) AS threshold, round(max(macro), 6) AS macro_coverage FROM p GROUP BY 1""",
)
def threshold_selection(spark, d):
    """The threshold of most macro coverage at which every road passes; the smallest of equal ones."""
    by_road = ev.curve(scored(spark, d), ["layer", "road"], "score", "correct", THRESHOLDS)
    good = (F.col("accepted") >= 30) & (F.coalesce("precision", F.lit(0.0)) >= 0.55)
    gated = by_road.groupBy("layer", "threshold").agg(F.avg("coverage").alias("macro"), F.bool_and(good).alias("passes")).filter("passes")
    best = gated.groupBy("layer").agg(F.min(F.struct((-F.round("macro", 9)).alias("m"), "threshold")).alias("b"), F.max("macro").alias("macro"))
    return best.select("layer", F.col("b.threshold").alias("threshold"), F.round("macro", 6).alias("macro_coverage"))


@register(
    "promotion_gate",
    f"""{SQL_SCORED}, r AS (SELECT layer, road, count(*) FILTER (WHERE score >= 0.7) AS accepted, count(*) FILTER (WHERE score >= 0.7 AND correct) AS correct, count(*) AS total, count(*) FILTER (WHERE status IN ('accepted')) AS base FROM s GROUP BY 1, 2),
    a AS (SELECT layer, count(*) FILTER (WHERE accepted >= 30) AS roads, CAST(sum(accepted) AS BIGINT) AS accepted, coalesce(sum(correct) / nullif(sum(accepted), 0), 0) AS precision, sum(accepted) / sum(total) AS coverage, sum(base) / sum(total) AS baseline FROM r GROUP BY 1)
    SELECT layer, roads, accepted, round(precision, 6) AS precision, round(coverage - baseline, 6) AS gain, concat_ws(';', CASE WHEN roads < 3 THEN 'too_few_roads' END, CASE WHEN precision < 0.6 THEN 'imprecise' END, CASE WHEN coverage - baseline < 0.1 THEN 'no_gain' END) AS reasons, roads >= 3 AND precision >= 0.6 AND coverage - baseline >= 0.1 AS promoted FROM a""",
)
def promotion_gate(spark, d):
    take = F.col("score") >= 0.7
    roads = scored(spark, d).groupBy("layer", "road").agg(F.count_if(take).alias("accepted"), F.count_if(take & F.col("correct")).alias("correct"), F.count("*").alias("total"), F.count_if(F.col("status") == "accepted").alias("base"))
    # This report counts the precision of nothing as 0, unlike the cohort's.
    a = roads.groupBy("layer").agg(F.count_if(F.col("accepted") >= 30).alias("roads"), F.coalesce(ev.rate(F.sum("correct"), F.sum("accepted")), F.lit(0.0)).alias("precision"), (F.sum("accepted") / F.sum("total")).alias("coverage"), (F.sum("base") / F.sum("total")).alias("baseline"), F.sum("accepted").alias("accepted"))
    gain = F.col("coverage") - F.col("baseline")
    reasons = F.concat_ws(";", F.when(F.col("roads") < 3, "too_few_roads"), F.when(F.col("precision") < 0.6, "imprecise"), F.when(gain < 0.1, "no_gain"))
    return a.select("layer", "roads", "accepted", F.round("precision", 6).alias("precision"), F.round(gain, 6).alias("gain"), reasons.alias("reasons"), (reasons == "").alias("promoted"))


@register(
    "macro_vs_pooled_rollup",
    f"""{SQL_SCORED}, r AS (SELECT layer, road, count(*) FILTER (WHERE score >= 0.9) AS a, count(*) FILTER (WHERE score >= 0.9 AND correct) AS c, count(*) AS n FROM s GROUP BY 1, 2)
    SELECT layer, CAST(sum(n) AS BIGINT) AS n, round(sum(c) / nullif(sum(a), 0), 6) AS pooled, round(avg(c / nullif(a, 0)), 6) AS macro, round(min(c / nullif(a, 0)), 6) AS worst_road FROM r GROUP BY 1""",
)
def macro_vs_pooled_rollup(spark, d):
    rows = scored(spark, d)
    take = F.col("score") >= 0.9
    r = rows.groupBy("layer", "road").agg(F.count_if(take).alias("a"), F.count_if(take & F.col("correct")).alias("c"), F.count("*").alias("n"))
    own = ev.rate(F.col("c"), F.col("a"))
    return r.groupBy("layer").agg(F.sum("n").alias("n"), F.round(ev.rate(F.sum("c"), F.sum("a")), 6).alias("pooled"), F.round(F.avg(own), 6).alias("macro"), F.round(F.min(own), 6).alias("worst_road"))


@register(
    "wilson_interval",
    f"""{SQL_SCORED}, r AS (SELECT layer, road, count(*) FILTER (WHERE score >= 0.99) AS n, count(*) FILTER (WHERE score >= 0.99 AND correct) AS k FROM s GROUP BY 1, 2), w AS (SELECT *, nullif(n, 0)::DOUBLE AS m, k / nullif(n, 0)::DOUBLE AS p FROM r)
    SELECT layer, road, n, k, round(greatest((p + {ev.Z95**2} / (2 * m)) / (1 + {ev.Z95**2} / m) - {ev.Z95} * sqrt(p * (1 - p) / m + {ev.Z95**2} / (4 * m * m)) / (1 + {ev.Z95**2} / m), 0), 6) AS low, round(least((p + {ev.Z95**2} / (2 * m)) / (1 + {ev.Z95**2} / m) + {ev.Z95} * sqrt(p * (1 - p) / m + {ev.Z95**2} / (4 * m * m)) / (1 + {ev.Z95**2} / m), 1), 6) AS high FROM w""",
)
def wilson_interval(spark, d):
    take = F.col("score") >= 0.99
    r = scored(spark, d).groupBy("layer", "road").agg(F.count_if(take).alias("n"), F.count_if(take & F.col("correct")).alias("k"))
    low, high = ev.wilson(F.col("k"), F.col("n"))
    return r.select("layer", "road", "n", "k", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


@register(
    "block_sums_paired",
    f"""{SQL_SCORED}, b AS (SELECT layer, CAST(floor(x / 64) AS BIGINT) AS block, count(*) AS n, count(*) FILTER (WHERE score >= 0.7 AND correct) AS a, count(*) FILTER (WHERE status = 'accepted' AND correct) AS b FROM s GROUP BY 1, 2)
    SELECT layer, block, n, a - b AS delta, round((a - b) / n, 6) AS share, block % 5 = 4 AS validation FROM b""",
)
def block_sums_paired(spark, d):
    b = scored(spark, d).groupBy("layer", F.floor(F.col("x") / 64).cast("long").alias("block")).agg(F.count("*").alias("n"), F.count_if((F.col("score") >= 0.7) & F.col("correct")).alias("a"), F.count_if((F.col("status") == "accepted") & F.col("correct")).alias("b"))
    delta = F.col("a") - F.col("b")
    return b.select("layer", "block", "n", delta.alias("delta"), F.round(delta / F.col("n"), 6).alias("share"), (F.col("block") % 5 == 4).alias("validation"))


@register(
    "block_bootstrap_interval",
    f"""{SQL_SCORED}, b AS (SELECT layer, CAST(floor(x / 64) AS BIGINT) AS block, count(*) AS n, count(*) FILTER (WHERE score >= 0.7 AND correct) - count(*) FILTER (WHERE status = 'accepted' AND correct) AS delta FROM s GROUP BY 1, 2), o AS (SELECT *, row_number() OVER (PARTITION BY layer ORDER BY block) - 1 AS i, count(*) OVER (PARTITION BY layer) AS blocks FROM b),
    d AS (SELECT o.layer, rep, CAST(('0x' || substr(md5(rep || ':' || i), 1, 8)) AS BIGINT) % blocks AS i FROM o, (SELECT unnest(range(400)) AS rep)), r AS (SELECT d.layer, rep, sum(o.delta) / sum(o.n)::DOUBLE AS share FROM d JOIN o ON o.layer = d.layer AND o.i = d.i GROUP BY 1, 2), q AS (SELECT layer, quantile_cont(share, 0.025) AS low, quantile_cont(share, 0.975) AS high FROM r GROUP BY 1), p AS (SELECT layer, count(*) AS blocks, sum(delta) / sum(n)::DOUBLE AS share FROM b GROUP BY 1) SELECT p.layer, blocks, round(share, 6) AS share, round(low, 6) AS low, round(high, 6) AS high FROM p JOIN q ON q.layer = p.layer""",
)
def block_bootstrap_interval(spark, d):
    """Percentile interval of the pooled share over resampled blocks: 400 replicates drawn by a hash of their number, from block sums, not from picks."""
    b = block_sums_paired(spark, d).select("layer", "block", "n", "delta")
    o = selection.numbered(b, ["layer"], "block", "i").select("layer", "i", "n", "delta")
    pooled = b.groupBy("layer").agg(F.count("*").alias("blocks"), (F.sum("delta") / F.sum("n")).alias("share"))
    rep = o.join(pooled, "layer").select("layer", "blocks", "i", F.explode(F.sequence(F.lit(0), F.lit(399))).alias("rep"))
    drawn = F.conv(F.substring(F.md5(F.concat_ws(":", "rep", "i")), 1, 8), 16, 10).cast("long") % F.col("blocks")
    shares = rep.select("layer", "rep", drawn.alias("i")).join(o, ["layer", "i"]).groupBy("layer", "rep").agg((F.sum("delta") / F.sum("n")).alias("s"))
    ends = shares.groupBy("layer").agg(F.percentile("s", F.lit(0.025)).alias("low"), F.percentile("s", F.lit(0.975)).alias("high"))
    return pooled.join(ends, "layer").select("layer", "blocks", F.round("share", 6).alias("share"), F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


@register(
    "selective_risk_labels",
    """SELECT d.lang, count(*) AS total, count(l.doc_id) AS labelled, count(*) FILTER (WHERE l.quality = 1) AS good, round(count(*) FILTER (WHERE l.quality = 1) / nullif(count(l.doc_id), 0), 6) AS precision, round(count(l.doc_id) / count(*), 6) AS coverage FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY 1""",
)
def selective_risk_labels(spark, d):
    """Documents without a label are unknown: they count in the denominator of coverage, never as bad."""
    rows = read(spark, d, "documents").select("doc_id", "lang").join(read(spark, d, "labels").select("doc_id", "quality", F.lit(True).alias("seen")), "doc_id", "left")
    good, seen = F.count_if(F.col("quality") == 1), F.count_if(F.col("seen"))
    return rows.groupBy("lang").agg(F.count("*").alias("total"), seen.alias("labelled"), good.alias("good"), F.round(ev.rate(good, seen), 6).alias("precision"), F.round(ev.rate(seen, F.count("*")), 6).alias("coverage"))


@register(
    "replay_transitions",
    f"""{SQL_SCORED}, k AS (SELECT l_orderkey, l_linenumber, layer, bool_or(score >= 0.7 AND correct) AS before_ok, bool_or(score >= 0.5 AND correct) AS after_ok, bool_or(score >= 0.7 AND NOT correct) AS before_bad, bool_or(score >= 0.5 AND NOT correct) AS after_bad FROM s GROUP BY 1, 2, 3)
    SELECT layer, count(*) FILTER (WHERE after_ok AND NOT before_ok) AS new_correct, count(*) FILTER (WHERE before_ok AND NOT after_ok) AS lost_correct, count(*) FILTER (WHERE after_bad AND NOT before_bad) AS new_wrong, count(*) FILTER (WHERE before_bad AND NOT after_bad) AS repaired_wrong FROM k GROUP BY 1""",
)
def replay_transitions(spark, d):
    flag = lambda limit, ok: F.bool_or((F.col("score") >= limit) & (F.col("correct") if ok else ~F.col("correct")))
    k = scored(spark, d).groupBy("l_orderkey", "l_linenumber", "layer").agg(flag(0.7, True).alias("b"), flag(0.5, True).alias("a"), flag(0.7, False).alias("bw"), flag(0.5, False).alias("aw"))
    gone = lambda x, y: F.count_if(F.col(x) & ~F.col(y))
    return k.groupBy("layer").agg(gone("a", "b").alias("new_correct"), gone("b", "a").alias("lost_correct"), gone("aw", "bw").alias("new_wrong"), gone("bw", "aw").alias("repaired_wrong"))
