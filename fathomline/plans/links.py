"""Tiles, lobes, link graphs and review decisions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .registry import register
from .tables import SQL_EVENTS, events, read
from .windows import SQL_CELLS, cells


@register("tile_starts", "SELECT label, t * 32 AS start, least(t * 32 + 64, n) AS stop FROM (SELECT label, n, unnest(range(0, greatest(CAST(ceil((n - 64) / 32.0) AS BIGINT), 0) + 1)) AS t FROM (SELECT label, count(*) AS n FROM embeddings GROUP BY 1))")
def tile_starts(spark, d):
    """Tiles of 64 rows that overlap by half and end with the road."""
    n = read(spark, d, "embeddings").groupBy("label").agg(F.count("*").alias("n"))
    t = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil((F.col("n") - 64) / 32.0), F.lit(0)).cast("long")))
    return n.select("label", "n", t.alias("t")).select("label", (F.col("t") * 32).alias("start"), F.least(F.col("t") * 32 + 64, F.col("n")).alias("stop"))


@register(
    "lobe_width_at_peak",
    f"""WITH {SQL_CELLS}, p AS (SELECT vec_id, arg_min(k, (-v, k)) AS peak FROM cell GROUP BY 1), f AS (SELECT *, CASE WHEN v > 0 THEN 1 WHEN v < 0 THEN -1 ELSE 0 END AS s, lag(CASE WHEN v > 0 THEN 1 WHEN v < 0 THEN -1 ELSE 0 END) OVER (PARTITION BY vec_id ORDER BY k) AS was FROM cell), r AS (SELECT *, sum(CASE WHEN was IS NULL OR was <> s THEN 1 ELSE 0 END) OVER (PARTITION BY vec_id ORDER BY k) AS run FROM f),
    w AS (SELECT vec_id, run, count(*) AS width FROM r GROUP BY 1, 2) SELECT p.vec_id, p.peak, w.width, greatest(2.0::DOUBLE, w.width / 4.0) AS tolerance FROM p JOIN r ON r.vec_id = p.vec_id AND r.k = p.peak JOIN w ON w.vec_id = r.vec_id AND w.run = r.run""",
)
def lobe_width_at_peak(spark, d):
    """Width of the run of one sign around each trace's strongest sample, and the tolerance frozen from it."""
    from ..operators import windows

    marked = windows.runs(cells(spark, d).withColumn("s", F.signum("v").cast("int")), ["vec_id"], "k", "s")
    lobes = marked.groupBy("vec_id", "run").agg(F.count("*").alias("width"), F.min(F.struct((-F.col("v")).alias("n"), "k")).alias("m"))
    best = lobes.groupBy("vec_id").agg(F.min(F.struct("m", "width")).alias("b"))
    return best.select("vec_id", F.col("b.m.k").alias("peak"), F.col("b.width").alias("width"), F.greatest(F.lit(2.0), F.col("b.width") / 4.0).alias("tolerance"))


@register(
    "half_maximum_width",
    f"""WITH {SQL_CELLS}, p AS (SELECT vec_id, arg_min(k, (-v, k)) AS peak, max(v) AS top FROM cell GROUP BY 1), j AS (SELECT cell.vec_id, k, v, peak, top FROM cell JOIN p ON cell.vec_id = p.vec_id WHERE v < top / 2) SELECT p.vec_id, coalesce(min(j.k) FILTER (WHERE j.k > p.peak), 64) - coalesce(max(j.k) FILTER (WHERE j.k < p.peak), -1) - 1 AS width FROM p LEFT JOIN j ON j.vec_id = p.vec_id GROUP BY p.vec_id, p.peak""",
)
def half_maximum_width(spark, d):
    """Samples around the peak that stay at half of it or more; array functions on one row a trace."""
    rows = read(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x")).withColumn("top", F.array_max("x"))
    peak = F.array_position("x", F.col("top")).cast("int") - 1
    low = F.filter(F.transform("x", lambda v, i: F.when(v < F.col("top") / 2, i)), lambda i: i.isNotNull())
    at = rows.withColumn("peak", peak).withColumn("low", low)
    right = F.coalesce(F.array_min(F.filter("low", lambda i: i > F.col("peak"))), F.lit(64))
    left = F.coalesce(F.array_max(F.filter("low", lambda i: i < F.col("peak"))), F.lit(-1))
    return at.select("vec_id", (right - left - 1).alias("width"))


@register(
    "resampled_halves",
    "SELECT vec_id, CAST(k AS INTEGER) AS k, round(CASE WHEN k % 2 = 0 THEN CAST(embedding[k // 2 + 1] AS DOUBLE) ELSE (CAST(embedding[k // 2 + 1] AS DOUBLE) + CAST(embedding[k // 2 + 2] AS DOUBLE)) / 2 END, 6) AS value FROM embeddings, (SELECT unnest(range(0, 127)) AS k)",
)
def resampled_halves(spark, d):
    """Linear resampling to half steps."""
    x = F.col("x")
    rows = read(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    fine = F.transform(F.sequence(F.lit(0), F.lit(126)), lambda k: F.when(k % 2 == 0, F.get(x, F.floor(k / 2).cast("int"))).otherwise((F.get(x, F.floor(k / 2).cast("int")) + F.get(x, F.floor(k / 2).cast("int") + 1)) / 2))
    return rows.select("vec_id", F.posexplode(fine).alias("k", "v")).select("vec_id", "k", F.round("v", 6).alias("value"))


@register(
    "contracted_chains",
    f"""WITH {SQL_EVENTS}, n AS (SELECT user_id, event_id, sec, lag(sec) OVER w AS p, lag(event_type) OVER w AS pt, event_type FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY sec, event_id)), c AS (SELECT *, sum(CASE WHEN p IS NULL OR pt <> event_type OR sec - p > 28800 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY sec, event_id) AS chain FROM n)
    SELECT user_id, CAST(chain AS BIGINT) AS chain, min(event_id) AS head, count(*) AS length, max(sec) - min(sec) AS extent FROM c GROUP BY user_id, chain HAVING count(*) > 1""",
)
def contracted_chains(spark, d):
    """Unambiguous links, to the next pick of the same kind within eight hours, contracted to segments."""
    w = Window.partitionBy("user_id").orderBy("sec", "event_id")
    before = F.lag("sec").over(w)
    new = before.isNull() | (F.lag("event_type").over(w) != F.col("event_type")) | (F.col("sec") - before > 28800)
    chained = events(spark, d).withColumn("n", new.cast("int")).withColumn("chain", F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return chained.groupBy("user_id", "chain").agg(F.min("event_id").alias("head"), F.count("*").alias("length"), (F.max("sec") - F.min("sec")).alias("extent")).filter("length > 1")


@register(
    "two_hop_routes",
    """WITH e AS (SELECT l_suppkey AS a, l_partkey % 400 AS b, max(l_quantity) AS q FROM lineitem WHERE l_quantity >= 45 GROUP BY 1, 2), r AS (SELECT x.a, x.b, max(least(y.q, z.q)) AS route FROM e x JOIN e y ON y.a = x.a AND y.b <> x.b JOIN e w ON w.b = y.b AND w.a <> x.a JOIN e z ON z.a = w.a AND z.b = x.b GROUP BY 1, 2) SELECT e.a, e.b, e.q, coalesce(r.route, 0) AS route, coalesce(r.route, 0) >= 47 AS kept FROM e LEFT JOIN r ON e.a = r.a AND e.b = r.b""",
)
def two_hop_routes(spark, d):
    """A link is kept where another route between its ends is strong at every hop."""
    e = read(spark, d, "lineitem").filter("l_quantity >= 45").groupBy(F.col("l_suppkey").alias("a"), (F.col("l_partkey") % 400).alias("b")).agg(F.max("l_quantity").alias("q"))
    # Pairs of one a's links, 400 at most whatever the size of the table, as b is a remainder of 400; never pairs of all a that share a b. The last hop of a
    # route from b' to b goes through any a that has both: counts by its strength, from which an edge's own a is taken out.
    hop = lambda name, q: e.select("a", F.col("b").alias(name), F.col("q").alias(q))
    pairs = hop("via", "first").join(hop("b", "last"), "a").filter("via <> b")
    counts = pairs.groupBy("via", "b", "last").agg(F.count("*").alias("n"))
    ranked = counts.withColumn("r", F.row_number().over(Window.partitionBy("via", "b").orderBy(F.desc("last")))).filter("r <= 2")
    pick = lambda r, c: F.max(F.when(F.col("r") == r, F.col(c)))
    ends = ranked.groupBy("via", "b").agg(pick(1, "last").alias("best"), pick(1, "n").alias("many"), pick(2, "last").alias("next"))
    # 159,600 rows at most: ordered pairs of different remainders.
    routes = pairs.join(F.broadcast(ends), ["via", "b"])
    other = F.when((F.col("last") < F.col("best")) | (F.col("many") > 1), F.col("best")).otherwise(F.col("next"))
    best = routes.withColumn("other", other).filter("other is not null").groupBy("a", "b").agg(F.max(F.least("first", "other")).alias("route"))
    out = e.join(best, ["a", "b"], "left").withColumn("route", F.coalesce("route", F.lit(0.0)))
    return out.select("a", "b", "q", "route", (F.col("route") >= 47).alias("kept"))


@register(
    "review_resolution",
    f"""WITH {SQL_EVENTS}, decision AS (SELECT user_id, CAST(floor(sec / 86400) AS BIGINT) AS day, arg_max(CASE event_id % 4 WHEN 0 THEN 'accept' WHEN 1 THEN 'not_visible' WHEN 2 THEN 'absent' ELSE 'anomaly' END, event_id) AS action FROM ev WHERE event_type = 'signup' GROUP BY 1, 2)
    SELECT p.event_id, coalesce(action, 'none') AS action, CASE WHEN action = 'accept' THEN 'accepted' WHEN action IN ('not_visible', 'absent') THEN 'accepted_hidden' WHEN action = 'anomaly' THEN 'review' ELSE 'unchanged' END AS status, CASE WHEN action IN ('not_visible', 'absent') THEN NULL ELSE p.value END AS sample FROM ev p LEFT JOIN decision d ON d.user_id = p.user_id AND d.day = CAST(floor(p.sec / 86400) AS BIGINT) WHERE p.event_type = 'purchase'""",
)
def review_resolution(spark, d):
    """The last decision of each interval applied to its picks: hidden ones lose their sample, they are not interpolated."""
    day = F.floor(F.col("sec") / 86400)
    k = F.col("event_id") % 4
    action = F.when(k == 0, "accept").when(k == 1, "not_visible").when(k == 2, "absent").otherwise("anomaly")
    decisions = events(spark, d, "signup").groupBy("user_id", day.alias("day")).agg(F.max_by(action, "event_id").alias("action"))
    hit = events(spark, d, "purchase").withColumn("day", day).join(decisions, ["user_id", "day"], "left")
    hidden = F.coalesce(F.col("action").isin("not_visible", "absent"), F.lit(False))
    status = F.when(F.col("action") == "accept", "accepted").when(hidden, "accepted_hidden").when(F.col("action") == "anomaly", "review").otherwise("unchanged")
    return hit.select("event_id", F.coalesce("action", F.lit("none")).alias("action"), status.alias("status"), F.when(~hidden, F.col("value")).alias("sample"))


@register(
    "balanced_episodes",
    """WITH r AS (SELECT d.doc_id, d.lang, l.quality, row_number() OVER (PARTITION BY d.lang, l.quality ORDER BY sha256(CAST(d.doc_id AS VARCHAR))) AS n FROM documents d JOIN labels l ON d.doc_id = l.doc_id) SELECT doc_id, lang, quality, CAST(n AS INTEGER) AS turn FROM r WHERE n <= 5""",
)
def balanced_episodes(spark, d):
    """A sampling operator: five of each stratum in hash order, so that every draw repeats."""
    rows = read(spark, d, "documents").select("doc_id", "lang").join(read(spark, d, "labels").select("doc_id", "quality"), "doc_id")
    w = Window.partitionBy("lang", "quality").orderBy(F.sha2(F.col("doc_id").cast("string"), 256))
    return rows.withColumn("turn", F.row_number().over(w)).filter("turn <= 5").select("doc_id", "lang", "quality", "turn")
