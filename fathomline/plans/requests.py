"""Requests for further observations, invalidations, release gates, competitor masks, seed score blends."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import selection
from .registry import register
from .tables import SQL_EVENTS, events, read
from .windows import SQL_CELLS, cells


@register(
    "separated_requests",
    f"""WITH RECURSIVE {SQL_EVENTS}, c AS (SELECT user_id, event_id, sec, value, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS n FROM ev WHERE event_type = 'error'), m AS (SELECT user_id, max(n) AS last FROM c GROUP BY 1),
    s AS (SELECT user_id, CAST(0 AS BIGINT) AS n, CAST([] AS BIGINT[]) AS places, CAST([] AS BIGINT[]) AS taken FROM m UNION ALL SELECT s.user_id, c.n, CASE WHEN len(taken) < 3 AND len(list_filter(places, lambda p: abs(p - c.sec) < 172800)) = 0 THEN list_append(places, c.sec) ELSE places END, CASE WHEN len(taken) < 3 AND len(list_filter(places, lambda p: abs(p - c.sec) < 172800)) = 0 THEN list_append(taken, c.event_id) ELSE taken END FROM s JOIN c ON c.user_id = s.user_id AND c.n = s.n + 1)
    SELECT s.user_id, CAST(i AS INTEGER) AS rank, taken[i] AS event_id FROM (SELECT s.*, unnest(range(1, len(taken) + 1)) AS i FROM s JOIN m ON m.user_id = s.user_id AND m.last = s.n) s""",
)
def separated_requests(spark, d):
    """Up to three requests a road by priority, at least two days apart."""
    return selection.suppress_rounds(events(spark, d, "error"), ["user_id"], "sec", "value", "event_id", 172800, 3).select("user_id", F.col("rank").cast("int").alias("rank"), "event_id")


@register(
    "invalidated_below",
    """WITH u AS (SELECT l_orderkey, min(l_linenumber) AS upper FROM lineitem WHERE l_returnflag = 'R' AND l_discount > 0.08 GROUP BY 1) SELECT l.l_orderkey, l.l_linenumber, CASE WHEN u.upper <= l.l_linenumber THEN NULL ELSE l.l_quantity END AS calibrated FROM lineitem l LEFT JOIN u ON u.l_orderkey = l.l_orderkey""",
)
def invalidated_below(spark, d):
    """A contradicted layer invalidates itself and all below it."""
    lines = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_discount", "l_quantity")
    upper = lines.filter("l_returnflag = 'R' and l_discount > 0.08").groupBy("l_orderkey").agg(F.min("l_linenumber").alias("upper"))
    return lines.join(upper, "l_orderkey", "left").select("l_orderkey", "l_linenumber", F.when(F.coalesce(F.col("upper") > F.col("l_linenumber"), F.lit(True)), F.col("l_quantity")).alias("calibrated"))


@register(
    "release_gate",
    """WITH r AS (SELECT c_nationkey AS road, o_orderpriority AS layer, count(*) AS n, avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END) AS p FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2) SELECT layer, count(*) FILTER (WHERE n >= 30) AS roads, round(min(p) FILTER (WHERE n >= 30), 6) AS worst, count(*) FILTER (WHERE n >= 30) >= 3 AND coalesce(min(p) FILTER (WHERE n >= 30) >= 0.2, false) AS released FROM r GROUP BY 1""",
)
def release_gate(spark, d):
    o = read(spark, d, "orders").select("o_custkey", "o_orderpriority", "o_orderstatus")
    c = read(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("road"))
    r = o.join(c, "o_custkey").groupBy("road", F.col("o_orderpriority").alias("layer")).agg(F.count("*").alias("n"), F.avg(F.when(F.col("o_orderstatus") == "F", 1.0).otherwise(0.0)).alias("p"))
    enough = F.col("n") >= 30
    worst = F.min(F.when(enough, F.col("p")))
    return r.groupBy("layer").agg(F.count_if(enough).alias("roads"), F.round(worst, 6).alias("worst"), ((F.count_if(enough) >= 3) & F.coalesce(worst >= 0.2, F.lit(False))).alias("released"))


@register(
    "stationary_competitors",
    f"""WITH {SQL_CELLS}, b AS (SELECT label, k, avg(CASE WHEN abs(v) >= 0.05 THEN 1.0 ELSE 0.0 END) AS share, count(*) AS n FROM cell GROUP BY 1, 2) SELECT label, k, round(share, 6) AS share FROM b WHERE share >= 0.7""",
)
def stationary_competitors(spark, d):
    """Bands at one depth that are strong in most rows of a road."""
    b = cells(spark, d).groupBy("label", "k").agg(F.avg(F.when(F.abs("v") >= 0.05, 1.0).otherwise(0.0)).alias("share"))
    return b.filter("share >= 0.7").select("label", "k", F.round("share", 6).alias("share"))


@register(
    "blended_seed_scores",
    f"""WITH {SQL_CELLS}, r AS (SELECT *, row_number() OVER (PARTITION BY label, k ORDER BY vec_id) - 1 AS i, count(*) OVER (PARTITION BY label, k) AS n FROM cell), s AS (SELECT label, k, max(v) FILTER (WHERE i = 0) AS first, max(v) FILTER (WHERE i = n - 1) AS last FROM r GROUP BY 1, 2)
    SELECT r.vec_id, r.k, round(CASE WHEN first * last < 0 THEN greatest(v * first, v * last) ELSE (1 - i / greatest(n - 1, 1)) * v * first + i / greatest(n - 1, 1) * v * last END, 8) AS score FROM r JOIN s ON r.label = s.label AND r.k = s.k""",
)
def blended_seed_scores(spark, d):
    """Scores against the seeds at both ends blended by distance; the larger where the seeds' polarity differs."""
    near = cells(spark, d)
    numbered = selection.numbered(near.select("label", "vec_id").distinct(), ["label"], "vec_id", "i")
    size = numbered.groupBy("label").agg(F.count("*").alias("n"))
    rows = near.join(numbered, ["label", "vec_id"]).join(size, "label")
    seeds = rows.groupBy("label", "k").agg(F.max(F.when(F.col("i") == 0, F.col("v"))).alias("first"), F.max(F.when(F.col("i") == F.col("n") - 1, F.col("v"))).alias("last"))
    t = F.col("i") / F.greatest(F.col("n") - 1, F.lit(1))
    a, b = F.col("v") * F.col("first"), F.col("v") * F.col("last")
    return rows.join(seeds, ["label", "k"]).select("vec_id", "k", F.round(F.when(F.col("first") * F.col("last") < 0, F.greatest(a, b)).otherwise((1 - t) * a + t * b), 8).alias("score"))


@register(
    "disagreement_runs",
    f"""WITH {SQL_EVENTS}, h AS (SELECT user_id, CAST(floor(sec / 21600) AS BIGINT) AS x, avg(value) FILTER (WHERE event_id % 2 = 0) AS a, avg(value) FILTER (WHERE event_id % 2 = 1) AS b FROM ev GROUP BY 1, 2), w AS (SELECT *, abs(a - b) AS off FROM h WHERE abs(a - b) > 15), g AS (SELECT *, sum(CASE WHEN p IS NULL OR x - p > 2 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY x) AS run FROM (SELECT *, lag(x) OVER (PARTITION BY user_id ORDER BY x) AS p FROM w))
    SELECT user_id, min(x) AS first, max(x) AS last, arg_min(x, (-round(off, 9), x)) AS representative, round(max(off), 6) AS worst FROM g GROUP BY user_id, run""",
)
def disagreement_runs(spark, d):
    """Runs of places where two hypotheses differ, with the place where they differ most."""
    half = lambda k: F.avg(F.when(F.col("event_id") % 2 == k, F.col("value")))
    h = events(spark, d).groupBy("user_id", F.floor(F.col("sec") / 21600).cast("long").alias("x")).agg(F.abs(half(0) - half(1)).alias("off")).filter("off > 15")
    w = Window.partitionBy("user_id").orderBy("x")
    before = F.lag("x").over(w)
    runs = h.withColumn("n", (before.isNull() | (F.col("x") - before > 2)).cast("int")).withColumn("run", F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    g = runs.groupBy("user_id", "run").agg(F.min("x").alias("first"), F.max("x").alias("last"), F.min(F.struct((-F.round("off", 9)).alias("o"), "x")).alias("m"), F.max("off").alias("worst"))
    return g.select("user_id", "first", "last", F.col("m.x").alias("representative"), F.round("worst", 6).alias("worst"))
