"""Rules on grids and stations: extents, roles, masks, windows, segments, path costs."""

from __future__ import annotations

from pyspark.sql import functions as F

from .registry import register
from .tables import SQL_EVENTS, events, read
from .windows import SQL_CELLS, cells


@register(
    "station_roles",
    f"WITH {SQL_EVENTS} SELECT event_id, event_type = 'error' AS is_correction, event_type <> 'error' AS is_model_seed, CASE WHEN event_type IN ('view', 'signup') AND value > 0 THEN value END AS visible_sample FROM ev",
)
def station_roles(spark, d):
    role = F.col("event_type")
    return events(spark, d).select("event_id", (role == "error").alias("is_correction"), (role != "error").alias("is_model_seed"), F.when(role.isin("view", "signup") & (F.col("value") > 0), F.col("value")).alias("visible_sample"))


@register(
    "within_extent",
    f"""WITH {SQL_EVENTS}, v AS (SELECT user_id, sec, lead(sec) OVER (PARTITION BY user_id ORDER BY sec) - sec AS step FROM ev WHERE event_type = 'view'), e AS (SELECT user_id, min(sec) AS lo, max(sec) AS hi, median(step) / 2 AS half FROM v GROUP BY 1)
    SELECT p.event_id, coalesce(p.sec BETWEEN lo - half AND hi + half, false) AS inside FROM ev p LEFT JOIN e ON p.user_id = e.user_id WHERE p.event_type = 'purchase'""",
)
def within_extent(spark, d):
    """Inside the extent of the rows, widened by half their median step."""
    from pyspark.sql import Window

    v = events(spark, d, "view").withColumn("step", F.lead("sec").over(Window.partitionBy("user_id").orderBy("sec")) - F.col("sec"))
    e = v.groupBy("user_id").agg(F.min("sec").alias("lo"), F.max("sec").alias("hi"), (F.median("step") / 2).alias("half"))
    hit = events(spark, d, "purchase").join(e, "user_id", "left")
    return hit.select("event_id", F.coalesce(F.col("sec").between(F.col("lo") - F.col("half"), F.col("hi") + F.col("half")), F.lit(False)).alias("inside"))


@register(
    "boundary_mask",
    f"""WITH {SQL_CELLS}, z AS (SELECT vec_id, k, CASE WHEN abs(v) < 0.02 THEN 0 ELSE v END AS v FROM cell), b AS (SELECT vec_id, min(k) FILTER (WHERE v <> 0) AS first, max(k) FILTER (WHERE v <> 0) AS last FROM z GROUP BY 1) SELECT z.vec_id, count(*) FILTER (WHERE k BETWEEN first AND last) AS valid_samples, first, last FROM z JOIN b ON z.vec_id = b.vec_id GROUP BY z.vec_id, first, last""",
)
def boundary_mask(spark, d):
    """Leading and trailing zeros are no measurement; array functions on one row a trace."""
    arr = F.transform(F.col("embedding").cast("array<double>"), lambda v: F.when(F.abs(v) < 0.02, 0.0).otherwise(v))
    places = F.filter(F.transform(arr, lambda v, i: F.when(v != 0, i)), lambda i: i.isNotNull())
    rows = read(spark, d, "embeddings").select("vec_id", F.array_min(places).alias("first"), F.array_max(places).alias("last"))
    return rows.select("vec_id", (F.col("last") - F.col("first") + 1).cast("long").alias("valid_samples"), "first", "last")


@register("path_snapshots", f"WITH {SQL_EVENTS} SELECT user_id, event_type, to_json(list(event_id ORDER BY event_id)) AS path FROM ev GROUP BY 1, 2")
def path_snapshots(spark, d):
    return events(spark, d).groupBy("user_id", "event_type").agg(F.to_json(F.sort_array(F.collect_list("event_id"))).alias("path"))


@register(
    "quick_design_segments",
    "SELECT c_custkey, layer, round(thickness, 6) AS thickness, round(thickness * 0.9, 6) AS low, round(thickness * 1.1, 6) AS high, round(2 * sqrt(eps) / (0.299792458 * 0.05859375) / 1000, 6) AS samples_per_mm FROM (SELECT c_custkey, unnest([1, 2, 3]) AS layer, unnest([abs(c_acctbal) / 100, CASE WHEN c_nationkey % 2 = 0 THEN 150.0 END, CASE WHEN c_nationkey % 3 = 0 THEN 200.0 END]) AS thickness, unnest([6.0::DOUBLE, 7.5, 9.0]) AS eps FROM customer) WHERE thickness > 0",
)
def quick_design_segments(spark, d):
    """Up to three layers of a quick design as rows, with tolerances and samples a mm."""
    n = F.col("c_nationkey")
    layer = lambda k, t, e: F.struct(F.lit(k).alias("layer"), t.cast("double").alias("thickness"), F.lit(e).alias("eps"))
    rows = read(spark, d, "customer").select("c_custkey", F.inline(F.array(layer(1, F.abs("c_acctbal") / 100, 6.0), layer(2, F.when(n % 2 == 0, 150.0), 7.5), layer(3, F.when(n % 3 == 0, 200.0), 9.0)))).filter("thickness > 0")
    return rows.select("c_custkey", "layer", F.round("thickness", 6).alias("thickness"), F.round(F.col("thickness") * 0.9, 6).alias("low"), F.round(F.col("thickness") * 1.1, 6).alias("high"), F.round(2 * F.sqrt("eps") / (0.299792458 * 0.05859375) / 1000, 6).alias("samples_per_mm"))


@register(
    "same_lobe",
    "SELECT vec_id, len(list_filter(embedding[vec_id % 50 + 1:vec_id % 50 + 4], lambda v: sign(v) <> sign(embedding[vec_id % 50 + 1]))) = 0 AND embedding[vec_id % 50 + 1] <> 0 AS same FROM embeddings",
)
def same_lobe(spark, d):
    """Whether the sign holds over an inclusive range of samples."""
    rows = read(spark, d, "embeddings").select("vec_id", F.slice("embedding", (F.col("vec_id") % 50 + 1).cast("int"), F.lit(4)).alias("w"))
    first = F.get("w", F.lit(0))
    return rows.select("vec_id", (F.forall("w", lambda v: F.signum(v) == F.signum(first)) & (first != 0)).alias("same"))


@register(
    "window_coordinates",
    "SELECT vec_id, (vec_id - 3) // 4 AS col, (vec_id - 3) % 4 = 0 AS on_grid, 3 + ((vec_id - 3) // 4) * 4 AS back, 60 - (vec_id - 3) // 4 AS flipped FROM embeddings WHERE vec_id >= 3",
)
def window_coordinates(spark, d):
    """Crop, stride and flip of a window that begins at the fourth trace and has no end, and the way back."""
    v = F.col("vec_id")
    c = F.floor((v - 3) / 4)
    return read(spark, d, "embeddings").filter(v >= 3).select("vec_id", c.alias("col"), ((v - 3) % 4 == 0).alias("on_grid"), (c * 4 + 3).alias("back"), (F.lit(60) - c).alias("flipped"))


@register(
    "transition_costs",
    f"WITH {SQL_EVENTS}, n AS (SELECT user_id, event_id, value, lag(value) OVER w AS before, lag(sec) OVER w AS bs, sec FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY sec, event_id)) SELECT event_id, round((1 - least(value / 100, 1)) * 0.03 * abs(value - before) + CASE WHEN sec - bs > 43200 THEN 0.5 ELSE 0 END, 8) AS cost FROM n WHERE before IS NOT NULL",
)
def transition_costs(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("sec", "event_id")
    n = events(spark, d).withColumn("before", F.lag("value").over(w)).withColumn("bs", F.lag("sec").over(w)).filter("before is not null")
    cost = (1 - F.least(F.col("value") / 100, F.lit(1.0))) * 0.03 * F.abs(F.col("value") - F.col("before")) + F.when(F.col("sec") - F.col("bs") > 43200, 0.5).otherwise(0.0)
    return n.select("event_id", F.round(cost, 8).alias("cost"))


@register(
    "seed_row_proposals",
    f"""WITH {SQL_CELLS}, q AS (SELECT label, vec_id, quantile_cont(v, 0.98) - median(v) AS quality FROM cell GROUP BY 1, 2), s AS (SELECT *, vec_id // 100 AS segment FROM q) SELECT label, segment, arg_min(vec_id, (-quality, vec_id)) AS vec_id, round(max(quality), 6) AS quality FROM s GROUP BY 1, 2""",
)
def seed_row_proposals(spark, d):
    """The clearest row of each segment of a road."""
    q = cells(spark, d).groupBy("label", "vec_id").agg((F.percentile("v", F.lit(0.98)) - F.median("v")).alias("quality")).withColumn("segment", F.floor(F.col("vec_id") / 100))
    best = q.groupBy("label", "segment").agg(F.min(F.struct((-F.col("quality")).alias("n"), "vec_id")).alias("m"))
    return best.select("label", "segment", F.col("m.vec_id").alias("vec_id"), F.round(-F.col("m.n"), 6).alias("quality"))
