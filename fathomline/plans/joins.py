"""Join queries over surveys' observations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import joins
from .registry import register
from .tables import SQL_EVENTS, events, read

SQL_SEGMENTS = "seg AS (SELECT n_regionkey AS k, n_nationkey AS ord, n_nationkey * 2.0::DOUBLE AS lo, n_nationkey * 2.0::DOUBLE + 7.0 AS hi, 900.0::DOUBLE + 15 * n_nationkey AS design FROM nation)"


def segments(spark, d):
    n = F.col("n_nationkey")
    return read(spark, d, "nation").select(F.col("n_regionkey").alias("k"), n.alias("ord"), (n * 2.0).alias("lo"), (n * 2.0 + 7.0).alias("hi"), (F.lit(900.0) + n * 15).alias("design"))


@register(
    "design_compliance_interval",
    f"""WITH {SQL_SEGMENTS}, m AS (SELECT p_partkey, CAST(p_partkey % 5 AS INTEGER) AS k, CAST(p_size AS DOUBLE) AS x, p_retailprice AS thickness FROM part),
    f AS (SELECT m.p_partkey, arg_min(ord, ord) AS ord, arg_min(design, ord) AS design FROM m JOIN seg ON m.k = seg.k AND m.x BETWEEN lo AND hi GROUP BY 1)
    SELECT m.p_partkey, ord AS segment, design, round(thickness - design, 6) AS deviation, round((thickness - design) / design * 100, 6) AS percent,
    CASE WHEN design IS NULL THEN 'not_evaluated' WHEN thickness IS NULL THEN 'unresolved' WHEN abs(thickness - design) <= 0.1 * design THEN 'compliant' ELSE 'out_of_tolerance' END AS compliance
    FROM m LEFT JOIN f ON m.p_partkey = f.p_partkey""",
)
def design_compliance_interval(spark, d):
    parts = read(spark, d, "part").select("p_partkey", (F.col("p_partkey") % 5).cast("int").alias("k"), F.col("p_size").cast("double").alias("x"), F.col("p_retailprice").alias("thickness"))
    hit = joins.interval_first_match(parts, segments(spark, d), ["k"], "p_partkey", "x", "lo", "hi", "ord", ["ord", "design"], 8.0)
    off = F.col("thickness") - F.col("design")
    state = F.when(F.col("design").isNull(), "not_evaluated").when(F.col("thickness").isNull(), "unresolved").when(F.abs(off) <= 0.1 * F.col("design"), "compliant").otherwise("out_of_tolerance")
    return hit.select("p_partkey", F.col("ord").alias("segment"), "design", F.round(off, 6).alias("deviation"), F.round(off / F.col("design") * 100, 6).alias("percent"), state.alias("compliance"))


@register(
    "design_prior_cumulative",
    f"""WITH {SQL_SEGMENTS}, rows_ AS (SELECT p_partkey, CAST(p_size AS DOUBLE) AS x FROM part), lay AS (SELECT unnest([0, 1, 2]) AS layer),
    f AS (SELECT p_partkey, layer, arg_min(design, ord) AS design FROM rows_ CROSS JOIN lay LEFT JOIN seg ON seg.k = layer AND x BETWEEN lo AND hi GROUP BY 1, 2)
    SELECT p_partkey, layer, CASE WHEN min(CASE WHEN design IS NULL THEN 0 ELSE 1 END) OVER w = 1 THEN round(sum(design) OVER w, 6) END AS prior FROM f WINDOW w AS (PARTITION BY p_partkey ORDER BY layer)""",
)
def design_prior_cumulative(spark, d):
    from ..operators.aggregates import profile

    rows = read(spark, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("x"), F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("k")).withColumn("row", F.concat_ws("/", "p_partkey", "k"))
    hit = joins.interval_first_match(rows, segments(spark, d), ["k"], "row", "x", "lo", "hi", "ord", ["design"], 8.0)
    return profile(hit, ["p_partkey"], "k", ["design"]).select("p_partkey", F.col("k").alias("layer"), F.round("design_sum", 6).alias("prior"))


@register(
    "nearest_reference_error",
    f"""WITH {SQL_EVENTS}, p AS (SELECT * FROM ev WHERE event_type = 'purchase'), r AS (SELECT * FROM ev WHERE event_type = 'view')
    SELECT p.event_id, m.sec AS matched_at, m.event_id AS matched_id, round(p.value - m.value, 6) AS error, abs(p.value - m.value) <= 10 AS on_target
    FROM p LEFT JOIN LATERAL (SELECT r.* FROM r WHERE r.user_id = p.user_id ORDER BY abs(r.sec - p.sec), r.sec, r.event_id LIMIT 1) m ON true""",
)
def nearest_reference_error(spark, d):
    hit = joins.nearest(events(spark, d, "purchase"), events(spark, d, "view").select("event_id", "user_id", "sec", F.col("value").alias("reference")), ["user_id"], "sec", "event_id", ["reference"])
    error = F.col("value") - F.col("reference")
    return hit.select("event_id", "matched_at", "matched_id", F.round(error, 6).alias("error"), (F.abs(error) <= 10).alias("on_target"))


@register(
    "asof_backward",
    f"""WITH {SQL_EVENTS}, p AS (SELECT * FROM ev WHERE event_type = 'purchase'), r AS (SELECT * FROM ev WHERE event_type = 'click')
    SELECT p.event_id, m.sec AS matched_at, m.event_id AS matched_id, m.value AS click_value
    FROM p LEFT JOIN LATERAL (SELECT r.* FROM r WHERE r.user_id = p.user_id AND r.sec <= p.sec ORDER BY r.sec DESC, r.event_id DESC LIMIT 1) m ON true""",
)
def asof_backward(spark, d):
    clicks = events(spark, d, "click").withColumnRenamed("value", "click_value")
    return joins.asof(events(spark, d, "purchase"), clicks, ["user_id"], "sec", "event_id", ["click_value"]).select("event_id", "matched_at", "matched_id", "click_value")


@register(
    "asof_nearest_tolerance",
    f"""WITH {SQL_EVENTS}, p AS (SELECT * FROM ev WHERE event_type = 'error'), r AS (SELECT * FROM ev WHERE event_type = 'signup')
    SELECT p.event_id, m.sec AS matched_at, m.event_id AS matched_id
    FROM p LEFT JOIN LATERAL (SELECT r.* FROM r WHERE r.user_id = p.user_id AND abs(r.sec - p.sec) <= 21600 ORDER BY abs(r.sec - p.sec), r.sec, r.event_id LIMIT 1) m ON true""",
)
def asof_nearest_tolerance(spark, d):
    return joins.nearest(events(spark, d, "error"), events(spark, d, "signup"), ["user_id"], "sec", "event_id", [], 21600).select("event_id", "matched_at", "matched_id")


@register(
    "band_join_tolerance",
    f"""WITH {SQL_EVENTS}, p AS (SELECT * FROM ev WHERE event_type = 'purchase'), r AS (SELECT * FROM ev WHERE event_type = 'click')
    SELECT p.event_id, m.event_id AS candidate_id, m.sec - p.sec AS offset_s, round(abs(m.value - p.value), 6) AS gap, abs(m.value - p.value) > 40 AS too_far
    FROM p JOIN LATERAL (SELECT r.* FROM r WHERE r.user_id = p.user_id AND abs(r.sec - p.sec) <= 7200 ORDER BY abs(r.sec - p.sec), abs(r.value - p.value), r.event_id LIMIT 1) m ON true""",
)
def band_join_tolerance(spark, d):
    right = events(spark, d, "click").select("user_id", F.col("event_id").alias("candidate_id"), F.col("sec").alias("rsec"), F.col("value").alias("rvalue"))
    pairs = joins.band(events(spark, d, "purchase"), right, ["user_id"], "sec", "rsec", 7200.0)
    best = pairs.groupBy("event_id").agg(F.min(F.struct(F.abs(F.col("rsec") - F.col("sec")).alias("a"), F.abs(F.col("rvalue") - F.col("value")).alias("gap"), "candidate_id", (F.col("rsec") - F.col("sec")).alias("offset_s"))).alias("m"))
    return best.select("event_id", "m.candidate_id", "m.offset_s", F.round("m.gap", 6).alias("gap"), (F.col("m.gap") > 40).alias("too_far"))


@register(
    "seed_exclusion_anti",
    f"""WITH {SQL_EVENTS} SELECT c.event_id, c.user_id, c.sec FROM ev c WHERE event_type = 'click' AND NOT EXISTS (SELECT 1 FROM ev e WHERE e.event_type = 'error' AND e.user_id = c.user_id AND abs(e.sec - c.sec) <= 10800)""",
)
def seed_exclusion_anti(spark, d):
    errors = events(spark, d, "error").select("user_id", F.col("sec").alias("esec"))
    return joins.excluded(events(spark, d, "click"), errors, ["user_id"], "sec", "esec", 10800.0).select("event_id", "user_id", "sec")


@register(
    "gps_interpolate",
    f"""WITH {SQL_EVENTS}, fix AS (SELECT user_id, sec, avg(value) AS value FROM ev WHERE event_type = 'signup' GROUP BY 1, 2)
    SELECT e.event_id, round(CASE WHEN b.sec = e.sec THEN b.value WHEN b.sec IS NOT NULL AND a.sec IS NOT NULL THEN b.value + (e.sec - b.sec)::DOUBLE / (a.sec - b.sec) * (a.value - b.value) END, 6) AS position
    FROM ev e LEFT JOIN LATERAL (SELECT * FROM fix f WHERE f.user_id = e.user_id AND f.sec <= e.sec ORDER BY f.sec DESC LIMIT 1) b ON true
    LEFT JOIN LATERAL (SELECT * FROM fix f WHERE f.user_id = e.user_id AND f.sec > e.sec ORDER BY f.sec LIMIT 1) a ON true WHERE e.event_type = 'error'""",
)
def gps_interpolate(spark, d):
    made = joins.interpolating(events(spark, d, "error"), events(spark, d, "signup"), ["user_id"], "sec", "value", "position")
    return made.select("event_id", F.round("position", 6).alias("position"))


@register(
    "bracket_weights",
    f"""WITH {SQL_EVENTS}, s AS (SELECT DISTINCT user_id, sec FROM ev WHERE event_type = 'signup')
    SELECT e.event_id, b.sec AS left_at, a.sec AS right_at, round(CASE WHEN b.sec IS NULL AND a.sec IS NULL THEN NULL WHEN a.sec IS NULL THEN 0.0 WHEN b.sec IS NULL THEN 1.0 WHEN a.sec = b.sec THEN 0.0 ELSE (e.sec - b.sec)::DOUBLE / (a.sec - b.sec) END, 6) AS right_weight
    FROM ev e LEFT JOIN LATERAL (SELECT max(sec) AS sec FROM s WHERE s.user_id = e.user_id AND s.sec <= e.sec) b ON true LEFT JOIN LATERAL (SELECT min(sec) AS sec FROM s WHERE s.user_id = e.user_id AND s.sec >= e.sec) a ON true
    WHERE e.event_type = 'purchase'""",
)
def bracket_weights(spark, d):
    from pyspark.sql import Window

    seeds = events(spark, d, "signup").select("user_id", "sec").distinct()
    both = events(spark, d, "purchase").select("event_id", "user_id", "sec", F.lit(None).cast("long").alias("seed")).union(seeds.select(F.lit(None).cast("long"), "user_id", "sec", "sec"))
    w = Window.partitionBy("user_id").orderBy("sec")
    # Range frames hold all rows of one place, so a seed at the row's own place counts on both sides.
    at = both.withColumn("left_at", F.max("seed").over(w.rangeBetween(Window.unboundedPreceding, 0))).withColumn("right_at", F.min("seed").over(w.rangeBetween(0, Window.unboundedFollowing)))
    left, right = F.col("left_at"), F.col("right_at")
    weight = F.when(left.isNull() & right.isNull(), F.lit(None).cast("double")).when(right.isNull(), 0.0).when(left.isNull(), 1.0).when(left == right, 0.0).otherwise((F.col("sec") - left) / (right - left))
    return at.filter("event_id is not null").select("event_id", "left_at", "right_at", F.round(weight, 6).alias("right_weight"))


@register(
    "catalog_pairing_score",
    """WITH tok AS (SELECT n_nationkey AS id, n_regionkey AS grp, list_distinct(list_filter(regexp_split_to_array(lower(n_name), '[^a-z0-9]+'), lambda x: x <> '')) AS t FROM nation),
    c AS (SELECT a.id AS road, b.id AS plate, greatest(least(1.0 - 0.22 * (abs(a.id - b.id) % 4) + CASE WHEN a.grp = b.grp THEN 0.12 ELSE 0 END + least(0.18, 0.04 * len(list_intersect(a.t, b.t))), 1.0), 0.0) AS score FROM tok a JOIN tok b ON a.id <> b.id),
    r AS (SELECT *, row_number() OVER w AS rank, lead(score) OVER w AS runner FROM c WINDOW w AS (PARTITION BY road ORDER BY score DESC, plate))
    SELECT road, plate, round(score, 6) AS score, coalesce(score - runner < 0.015, false) AS ambiguous FROM r WHERE rank = 1""",
)
def catalog_pairing_score(spark, d):
    """All road and plate pairs of a catalogue, a table of files, not of observations."""
    from pyspark.sql import Window

    tokens = F.array_distinct(F.filter(F.split(F.lower("n_name"), "[^a-z0-9]+"), lambda x: x != ""))
    rows = read(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_regionkey").alias("grp"), tokens.alias("t"))
    roads, plates = rows.select(F.col("id").alias("road"), F.col("grp").alias("g1"), F.col("t").alias("t1")), rows.select(F.col("id").alias("plate"), F.col("grp").alias("g2"), F.col("t").alias("t2"))
    pairs = roads.join(plates, F.col("road") != F.col("plate"))
    raw = F.lit(1.0) - 0.22 * (F.abs(F.col("road") - F.col("plate")) % 4) + F.when(F.col("g1") == F.col("g2"), 0.12).otherwise(0.0) + F.least(F.lit(0.18), 0.04 * F.size(F.array_intersect("t1", "t2")))
    scored = pairs.select("road", "plate", F.greatest(F.least(raw, F.lit(1.0)), F.lit(0.0)).alias("score"))
    w = Window.partitionBy("road").orderBy(F.desc("score"), "plate")
    ranked = scored.withColumn("rank", F.row_number().over(w)).withColumn("runner", F.lead("score").over(w)).filter("rank = 1")
    return ranked.select("road", "plate", F.round("score", 6).alias("score"), F.coalesce(F.col("score") - F.col("runner") < 0.015, F.lit(False)).alias("ambiguous"))


@register("orphan_anti_join", "SELECT c_custkey, c_name FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey)")
def orphan_anti_join(spark, d):
    return read(spark, d, "customer").select("c_custkey", "c_name").join(read(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


@register(
    "missing_checkpoint_pairs",
    """WITH need AS (SELECT DISTINCT user_id, t AS event_type FROM events CROSS JOIN (SELECT unnest(['view', 'click', 'purchase', 'signup', 'error']) AS t)),
    have AS (SELECT user_id, event_type FROM events GROUP BY 1, 2 HAVING count(*) >= 10) SELECT n.user_id, n.event_type FROM need n WHERE NOT EXISTS (SELECT 1 FROM have h WHERE h.user_id = n.user_id AND h.event_type = n.event_type)""",
)
def missing_checkpoint_pairs(spark, d):
    ev = read(spark, d, "events").select("user_id", "event_type")
    need = ev.select("user_id").distinct().withColumn("event_type", F.explode(F.array(*[F.lit(x) for x in ("view", "click", "purchase", "signup", "error")])))
    return need.join(ev.groupBy("user_id", "event_type").count().filter("count >= 10"), ["user_id", "event_type"], "left_anti")


@register(
    "native_grid_constraint",
    """SELECT l.l_orderkey, l.l_linenumber, o.o_orderkey IS NOT NULL AS on_grid, CASE WHEN o.o_orderkey IS NULL THEN 'no_such_trace' WHEN l.l_linenumber > 5 THEN 'sample_out_of_range' END AS violation
    FROM lineitem l LEFT JOIN orders o ON l.l_orderkey = o.o_orderkey AND o.o_orderstatus <> 'P'""",
)
def native_grid_constraint(spark, d):
    grid = read(spark, d, "orders").filter("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("l_orderkey"), F.lit(True).alias("g"))
    hit = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber").join(grid, "l_orderkey", "left")
    return hit.select("l_orderkey", "l_linenumber", F.col("g").isNotNull().alias("on_grid"), F.when(F.col("g").isNull(), "no_such_trace").when(F.col("l_linenumber") > 5, "sample_out_of_range").alias("violation"))


@register(
    "dropout_stability",
    f"""WITH {SQL_EVENTS}, a AS (SELECT user_id, CAST(round(sec / 3600.0) AS BIGINT) AS h, round(avg(value), 6) AS v FROM ev WHERE event_id % 3 <> 0 GROUP BY 1, 2), b AS (SELECT user_id, CAST(round(sec / 3600.0) AS BIGINT) AS h, round(avg(value), 6) AS v FROM ev WHERE event_id % 3 <> 1 GROUP BY 1, 2)
    SELECT a.user_id, count(*) AS picks, count(b.v) AS shared, round(avg(CASE WHEN b.v IS NOT NULL AND abs(a.v - b.v) <= 5 THEN 1.0 ELSE 0.0 END), 6) AS stability, round(max(abs(a.v - b.v)), 6) AS worst
    FROM a LEFT JOIN b ON a.user_id = b.user_id AND a.h = b.h GROUP BY 1""",
)
def dropout_stability(spark, d):
    ev = events(spark, d).withColumn("h", F.round(F.col("sec") / 3600.0).cast("long"))
    run = lambda rest, name: ev.filter(F.col("event_id") % 3 != rest).groupBy("user_id", "h").agg(F.round(F.avg("value"), 6).alias(name))
    both = run(0, "v").join(run(1, "w"), ["user_id", "h"], "left")
    off = F.abs(F.col("v") - F.col("w"))
    return both.groupBy("user_id").agg(F.count("*").alias("picks"), F.count("w").alias("shared"), F.round(F.avg(F.when(off <= 5, 1.0).otherwise(0.0)), 6).alias("stability"), F.round(F.max(off), 6).alias("worst"))
