"""Window queries: moving means, runs, islands, filling."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import quantiles, scans, windows
from .registry import register
from .tables import SQL_EVENTS, events, read

SQL_CELLS = "cell AS (SELECT vec_id, label, CAST(k - 1 AS INTEGER) AS k, CAST(embedding[k] AS DOUBLE) AS v FROM embeddings, (SELECT unnest(range(1, 65)) AS k))"


def cells(spark, d):
    """(vec_id, label, k, v) of the sample grid."""
    return read(spark, d, "embeddings").select("vec_id", "label", F.posexplode(F.col("embedding").cast("array<double>")).alias("k", "v"))


def _moving_sql(half: int) -> str:
    return f"(sum(v) OVER (PARTITION BY vec_id ORDER BY k ROWS BETWEEN {half} PRECEDING AND {half} FOLLOWING) + greatest({half} + 1 - row_number() OVER (PARTITION BY vec_id ORDER BY k), 0) * first(v) OVER (PARTITION BY vec_id ORDER BY k) + greatest(row_number() OVER (PARTITION BY vec_id ORDER BY k) + {half} - count(*) OVER (PARTITION BY vec_id), 0) * last(v) OVER (PARTITION BY vec_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) / {2 * half + 1}"


@register("dewow_window", f"WITH {SQL_CELLS} SELECT vec_id, k, round(v - {_moving_sql(3)}, 6) AS value FROM cell")
def dewow_window(spark, d):
    return cells(spark, d).select("vec_id", "k", F.round(F.col("v") - windows.moving_mean("v", ["vec_id"], "k", 3), 6).alias("value"))


@register(
    "background_removal",
    f"""WITH {SQL_CELLS} SELECT vec_id, k, round(v - avg(v) OVER (PARTITION BY label, k), 6) AS global_removed, round(v - avg(v) OVER (PARTITION BY label, k ORDER BY vec_id ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING), 6) AS moving_removed FROM cell""",
)
def background_removal(spark, d):
    # The global mean is an aggregate of its own: combined before its shuffle, joined back on a few rows. Moving means run over blocks of traces.
    grid = cells(spark, d)
    mean = grid.groupBy("label", "k").agg(F.avg("v").alias("m"))
    return scans.moving_mean(grid, ["label", "k"], ["vec_id"], "v", 5, "near", False).join(mean, ["label", "k"]).select("vec_id", "k", F.round(F.col("v") - F.col("m"), 6).alias("global_removed"), F.round(F.col("v") - F.col("near"), 6).alias("moving_removed"))


@register(
    "time_gain_clip",
    f"""WITH {SQL_CELLS}, g AS (SELECT k, sqrt(median(v * v)) AS level FROM cell GROUP BY 1), s AS (SELECT k, avg(level) OVER (ORDER BY k ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS level, max(level) OVER () AS top FROM g)
    SELECT vec_id, cell.k, round(v * least(greatest(top / greatest(level, 1e-12), 1.0), 4.0) * CASE WHEN cell.k < 8 THEN cell.k / 8.0::DOUBLE ELSE 1.0 END, 6) AS value FROM cell JOIN s ON cell.k = s.k""",
)
def time_gain_clip(spark, d):
    grid = cells(spark, d)
    level = quantiles.exact_median(grid.select("k", (F.col("v") * F.col("v")).alias("power")), ["k"], "power", "middle").select("k", F.sqrt("middle").alias("level"))
    # One row a sample number: windows without partition see 64 rows.
    w = Window.orderBy("k")
    smooth = level.select("k", F.avg("level").over(w.rowsBetween(-2, 2)).alias("smooth"), F.max("level").over(Window.partitionBy()).alias("top"))
    gain = F.least(F.greatest(F.col("top") / F.greatest("smooth", F.lit(1e-12)), F.lit(1.0)), F.lit(4.0))
    return grid.join(smooth, "k").select("vec_id", "k", F.round(F.col("v") * gain * F.when(F.col("k") < 8, F.col("k") / 8.0).otherwise(1.0), 6).alias("value"))


@register(
    "row_normalise_percentile",
    f"""WITH {SQL_CELLS}, q AS (SELECT vec_id, quantile_cont(v, 0.2) AS lo, quantile_cont(v, 0.975) AS hi FROM cell GROUP BY 1)
    SELECT cell.vec_id, k, round(least(greatest((v - lo) / (hi - lo), 0.0), 1.0), 6) AS value FROM cell JOIN q ON cell.vec_id = q.vec_id WHERE hi > lo""",
)
def row_normalise_percentile(spark, d):
    grid = cells(spark, d)
    q = grid.groupBy("vec_id").agg(F.percentile("v", F.array(F.lit(0.2), F.lit(0.975))).alias("q")).select("vec_id", F.col("q")[0].alias("lo"), F.col("q")[1].alias("hi")).filter("hi > lo")
    return grid.join(q, "vec_id").select("vec_id", "k", F.round(F.least(F.greatest((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")), F.lit(0.0)), F.lit(1.0)), 6).alias("value"))


@register("gradient_lag_lead", f"WITH {SQL_CELLS} SELECT vec_id, k, round(CASE WHEN lag(v) OVER w IS NULL THEN lead(v) OVER w - v WHEN lead(v) OVER w IS NULL THEN v - lag(v) OVER w ELSE (lead(v) OVER w - lag(v) OVER w) / 2 END, 6) AS slope FROM cell WINDOW w AS (PARTITION BY vec_id ORDER BY k)")
def gradient_lag_lead(spark, d):
    w = Window.partitionBy("vec_id").orderBy("k")
    before, after = F.lag("v").over(w), F.lead("v").over(w)
    return cells(spark, d).select("vec_id", "k", F.round(F.when(before.isNull(), after - F.col("v")).when(after.isNull(), F.col("v") - before).otherwise((after - before) / 2), 6).alias("slope"))


@register("local_maxima", f"WITH {SQL_CELLS}, n AS (SELECT vec_id, k, v, lag(v) OVER w AS b, lead(v) OVER w AS a FROM cell WINDOW w AS (PARTITION BY vec_id ORDER BY k)) SELECT vec_id, k, round(v, 6) AS value FROM n WHERE v > b AND v >= a")
def local_maxima(spark, d):
    w = Window.partitionBy("vec_id").orderBy("k")
    return cells(spark, d).withColumn("b", F.lag("v").over(w)).withColumn("a", F.lead("v").over(w)).filter("v > b and v >= a").select("vec_id", "k", F.round("v", 6).alias("value"))


@register(
    "runs_longest",
    f"""WITH {SQL_CELLS}, f AS (SELECT *, v > 0 AS up, lag(v > 0) OVER w AS was FROM cell WINDOW w AS (PARTITION BY vec_id ORDER BY k)), r AS (SELECT *, sum(CASE WHEN was IS NULL OR was <> up THEN 1 ELSE 0 END) OVER (PARTITION BY vec_id ORDER BY k) AS run FROM f),
    n AS (SELECT vec_id, run, min(k) AS start, count(*) AS length FROM r WHERE up GROUP BY 1, 2) SELECT vec_id, max(length) AS longest, arg_min(start, (-length, start)) AS starts_at, count(*) AS runs FROM n GROUP BY 1""",
)
def runs_longest(spark, d):
    marked = windows.runs(cells(spark, d).withColumn("up", F.col("v") > 0), ["vec_id"], "k", "up").filter("up")
    each = marked.groupBy("vec_id", "run").agg(F.min("k").alias("start"), F.count("*").alias("length"))
    best = each.groupBy("vec_id").agg(F.min(F.struct((-F.col("length")).alias("n"), "start")).alias("m"), F.count("*").alias("runs"))
    return best.select("vec_id", (-F.col("m.n")).alias("longest"), F.col("m.start").alias("starts_at"), "runs")


@register(
    "anomaly_dilate_regions",
    f"""WITH {SQL_CELLS}, f AS (SELECT *, v > 0.08 AS hot, lag(v > 0.08) OVER w AS was FROM cell WINDOW w AS (PARTITION BY vec_id ORDER BY k)), r AS (SELECT *, sum(CASE WHEN was IS NULL OR was <> hot THEN 1 ELSE 0 END) OVER (PARTITION BY vec_id ORDER BY k) AS run FROM f),
    c AS (SELECT *, hot AND count(*) OVER (PARTITION BY vec_id, run) >= 2 AS keep FROM r), g AS (SELECT *, max(CASE WHEN keep THEN 1 ELSE 0 END) OVER (PARTITION BY vec_id ORDER BY k ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) = 1 AS grown FROM c),
    h AS (SELECT *, sum(CASE WHEN grown AND NOT coalesce(pg, false) THEN 1 ELSE 0 END) OVER (PARTITION BY vec_id ORDER BY k) AS region FROM (SELECT *, lag(grown) OVER (PARTITION BY vec_id ORDER BY k) AS pg FROM g))
    SELECT vec_id, CAST(region AS BIGINT) AS region, min(k) AS first, max(k) AS last, round(max(v), 6) AS peak FROM h WHERE grown GROUP BY 1, 2""",
)
def anomaly_dilate_regions(spark, d):
    """Runs of at least two hot samples, grown by one to each side; grown runs may meet."""
    w = Window.partitionBy("vec_id").orderBy("k")
    grown = windows.dilated(cells(spark, d), ["vec_id"], "k", F.col("v") > 0.08, 2, 1, "grown")
    starts = F.col("grown") & ~F.coalesce(F.lag("grown").over(w), F.lit(False))
    return windows.islands(grown, ["vec_id"], "k", starts, "region").filter("grown").groupBy("vec_id", "region").agg(F.min("k").alias("first"), F.max("k").alias("last"), F.round(F.max("v"), 6).alias("peak"))


@register(
    "short_gap_interpolation",
    f"""WITH {SQL_CELLS}, m AS (SELECT vec_id, k, CASE WHEN abs(v) > 0.05 THEN v END AS v FROM cell), b AS (SELECT vec_id, k, v, last_value(CASE WHEN v IS NOT NULL THEN k END IGNORE NULLS) OVER (PARTITION BY vec_id ORDER BY k) AS bk, first_value(CASE WHEN v IS NOT NULL THEN k END IGNORE NULLS) OVER (PARTITION BY vec_id ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ak FROM m)
    SELECT b.vec_id, b.k, round(CASE WHEN b.v IS NOT NULL THEN b.v WHEN bk IS NOT NULL AND ak IS NOT NULL AND ak - bk - 1 <= 3 AND abs(a.v - p.v) <= 0.3 THEN p.v + (a.v - p.v) * (b.k - bk) / (ak - bk) END, 6) AS value
    FROM b LEFT JOIN m p ON p.vec_id = b.vec_id AND p.k = bk LEFT JOIN m a ON a.vec_id = b.vec_id AND a.k = ak""",
)
def short_gap_interpolation(spark, d):
    known = cells(spark, d).withColumn("u", F.when(F.abs("v") > 0.05, F.col("v")))
    return windows.fill_linear(known, ["vec_id"], "k", "u", "value", most=3, jump=0.3).select("vec_id", "k", F.round("value", 6).alias("value"))


@register(
    "path_filled",
    f"""WITH {SQL_CELLS}, m AS (SELECT vec_id, k, CASE WHEN abs(v) > 0.12 THEN v END AS v FROM cell), b AS (SELECT vec_id, k, v, last_value(CASE WHEN v IS NOT NULL THEN k END IGNORE NULLS) OVER (PARTITION BY vec_id ORDER BY k) AS bk, first_value(CASE WHEN v IS NOT NULL THEN k END IGNORE NULLS) OVER (PARTITION BY vec_id ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ak FROM m)
    SELECT b.vec_id, b.k, round(CASE WHEN b.v IS NOT NULL THEN b.v WHEN bk IS NULL THEN a.v WHEN ak IS NULL THEN p.v ELSE p.v + (a.v - p.v) * (b.k - bk) / (ak - bk) END, 6) AS value
    FROM b LEFT JOIN m p ON p.vec_id = b.vec_id AND p.k = bk LEFT JOIN m a ON a.vec_id = b.vec_id AND a.k = ak""",
)
def path_filled(spark, d):
    known = cells(spark, d).withColumn("u", F.when(F.abs("v") > 0.12, F.col("v")))
    return windows.fill_linear(known, ["vec_id"], "k", "u", "value", hold_ends=True).select("vec_id", "k", F.round("value", 6).alias("value"))


@register(
    "short_run_removal",
    f"""WITH {SQL_CELLS}, f AS (SELECT *, abs(v) > 0.05 AS seen, lag(abs(v) > 0.05) OVER w AS was FROM cell WINDOW w AS (PARTITION BY vec_id ORDER BY k)), r AS (SELECT *, sum(CASE WHEN was IS NULL OR was <> seen THEN 1 ELSE 0 END) OVER (PARTITION BY vec_id ORDER BY k) AS run FROM f)
    SELECT vec_id, k, seen AND (count(*) OVER q >= 3 OR bool_or(k % 16 = 0) OVER q) AS visible FROM r WINDOW q AS (PARTITION BY vec_id, run)""",
)
def short_run_removal(spark, d):
    marked = windows.runs(cells(spark, d).withColumn("seen", F.abs("v") > 0.05), ["vec_id"], "k", "seen")
    q = Window.partitionBy("vec_id", "run")
    return marked.select("vec_id", "k", (F.col("seen") & ((F.count("*").over(q) >= 3) | F.bool_or(F.col("k") % 16 == 0).over(q))).alias("visible"))


@register(
    "review_islands",
    f"""WITH {SQL_EVENTS}, p AS (SELECT *, event_type IN ('error', 'signup') AS uncertain FROM ev), b AS (SELECT *, max(CASE WHEN uncertain THEN sec END) OVER (PARTITION BY user_id ORDER BY sec, event_id) AS bu, min(CASE WHEN uncertain THEN sec END) OVER (PARTITION BY user_id ORDER BY sec, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS au FROM p),
    u AS (SELECT * FROM b WHERE uncertain OR au - bu <= 36000), i AS (SELECT *, sum(CASE WHEN prev IS NULL OR sec - prev > 14400 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY sec, event_id) AS island FROM (SELECT *, lag(sec) OVER (PARTITION BY user_id ORDER BY sec, event_id) AS prev FROM u))
    SELECT user_id, CAST(island AS BIGINT) AS island, min(sec) AS first, max(sec) AS last, count(*) AS picks, count(*) FILTER (WHERE uncertain) AS uncertain_picks, round(max(value), 6) AS top FROM i GROUP BY 1, 2""",
)
def review_islands(spark, d):
    """Uncertain picks with the short confident gaps between them, grouped where they stand close."""
    order = ["sec", "event_id"]
    picks = events(spark, d).withColumn("uncertain", F.col("event_type").isin("error", "signup")).withColumn("mark", F.when(F.col("uncertain"), F.col("sec")))
    beside = scans.neighbours(picks, ["user_id"], order, "mark", "sec", ("before", "before_at", "after", "after_at"))
    kept = beside.filter("uncertain or after - before <= 36000").select("user_id", "sec", "event_id", "uncertain", "value")
    numbered = scans.islands(kept, ["user_id"], order, ["sec"], lambda a, b: b("sec") - a("sec") > 14400)
    return numbered.groupBy("user_id", "island").agg(F.min("sec").alias("first"), F.max("sec").alias("last"), F.count("*").alias("picks"), F.count_if("uncertain").alias("uncertain_picks"), F.round(F.max("value"), 6).alias("top"))


@register(
    "interval_merge_tiling",
    f"""WITH {SQL_EVENTS}, s AS (SELECT user_id, sec AS lo, sec + 3600 + 60 * (event_id % 7) AS hi FROM ev WHERE event_type = 'error'), n AS (SELECT *, max(hi) OVER (PARTITION BY user_id ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s),
    g AS (SELECT *, sum(CASE WHEN reach IS NULL OR lo > reach + 300 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS g FROM n), m AS (SELECT user_id, min(lo) AS lo, max(hi) AS hi, count(*) AS members FROM g GROUP BY user_id, g)
    SELECT user_id, lo, hi, members, t AS tile, lo + t * 2400 AS tile_start, least(lo + t * 2400 + 3000, hi) AS tile_end FROM (SELECT *, unnest(range(0, greatest(CAST(ceil((hi - lo - 3000) / 2400.0) AS BIGINT), 0) + 1)) AS t FROM m)""",
)
def interval_merge_tiling(spark, d):
    spans = events(spark, d, "error").select("user_id", F.col("sec").alias("lo"), (F.col("sec") + 3600 + 60 * (F.col("event_id") % 7)).alias("hi"))
    merged = scans.merge_spans(spans, ["user_id"], "lo", "hi", 300)
    tiles = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil((F.col("hi") - F.col("lo") - 3000) / 2400.0), F.lit(0)).cast("long")))
    tiled = merged.select("user_id", "lo", "hi", "members", tiles.alias("tile"))
    return tiled.withColumn("tile_start", F.col("lo") + F.col("tile") * 2400).withColumn("tile_end", F.least(F.col("tile_start") + 3000, F.col("hi")))


@register(
    "sessions_gaps_islands",
    f"""WITH {SQL_EVENTS}, s AS (SELECT *, sum(CASE WHEN prev IS NULL OR sec - prev > 21600 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY sec, event_id) AS session FROM (SELECT *, lag(sec) OVER (PARTITION BY user_id ORDER BY sec, event_id) AS prev FROM ev))
    SELECT user_id, CAST(session AS BIGINT) AS session, min(sec) AS first, max(sec) AS last, count(*) AS picks FROM s GROUP BY 1, 2""",
)
def sessions_gaps_islands(spark, d):
    marked = scans.islands(events(spark, d).select("user_id", "sec", "event_id"), ["user_id"], ["sec", "event_id"], ["sec"], lambda a, b: b("sec") - a("sec") > 21600, "session")
    return marked.groupBy("user_id", "session").agg(F.min("sec").alias("first"), F.max("sec").alias("last"), F.count("*").alias("picks"))


@register(
    "valid_runs",
    f"""WITH {SQL_CELLS}, f AS (SELECT *, v < 0.1 AS ok, lag(v < 0.1) OVER w AS was FROM cell WINDOW w AS (PARTITION BY vec_id ORDER BY k)), r AS (SELECT *, sum(CASE WHEN was IS NULL OR was <> ok THEN 1 ELSE 0 END) OVER (PARTITION BY vec_id ORDER BY k) AS run FROM f)
    SELECT vec_id, min(k) AS start, max(k) + 1 AS stop FROM r WHERE ok GROUP BY vec_id, run""",
)
def valid_runs(spark, d):
    marked = windows.runs(cells(spark, d).withColumn("ok", F.col("v") < 0.1), ["vec_id"], "k", "ok").filter("ok")
    return marked.groupBy("vec_id", "run").agg(F.min("k").alias("start"), (F.max("k") + 1).alias("stop")).drop("run")


@register(
    "regime_break_rows",
    f"""WITH {SQL_EVENTS}, s AS (SELECT user_id, sec, event_id, event_id % 3 AS regime FROM ev WHERE event_type = 'signup'), n AS (SELECT *, lead(sec) OVER w AS nsec, lead(regime) OVER w AS nregime FROM s WINDOW w AS (PARTITION BY user_id ORDER BY sec, event_id))
    SELECT user_id, event_id, (sec + nsec) / 2.0::DOUBLE AS break_at FROM n WHERE nregime <> regime""",
)
def regime_break_rows(spark, d):
    seeds = events(spark, d, "signup").select("user_id", "sec", "event_id", (F.col("event_id") % 3).alias("regime"))
    following = scans.shifted(seeds, ["user_id"], ["sec", "event_id"], {"nsec": "sec", "nregime": "regime"}, True)
    return following.filter("nregime <> regime").select("user_id", "event_id", ((F.col("sec") + F.col("nsec")) / 2.0).alias("break_at"))
