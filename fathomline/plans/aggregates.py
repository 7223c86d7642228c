"""Aggregation queries: stacking, report bins, status lattices, profiles, gates."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import aggregates as agg
from ..operators import joins, quantiles
from .joins import SQL_SEGMENTS, segments
from .registry import register
from .tables import SQL_EVENTS, events, read

#: A line item stands for a pick: its ship day for the chainage, its flags for layer and status.
SQL_PICKS = """pick AS (SELECT l_orderkey, l_linenumber, CAST(date_diff('day', TIMESTAMP '1992-01-01', l_shipdate) AS DOUBLE) AS x, CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END AS layer,
    CASE WHEN l_discount < 0.005 THEN 'unresolved' WHEN l_tax < 0.02 THEN 'review' WHEN l_tax < 0.05 THEN 'high_confidence' ELSE 'accepted' END AS status, l_quantity AS sample, l_extendedprice / 10000 AS twtt, 1 - l_discount * 5 AS confidence FROM lineitem)"""
#: Two-way travel time in ns to mm at a dielectric constant: c in m/ns, fixed value.
LIGHT = 0.299792458


def picks(spark, d):
    status = F.when(F.col("l_discount") < 0.005, "unresolved").when(F.col("l_tax") < 0.02, "review").when(F.col("l_tax") < 0.05, "high_confidence").otherwise("accepted")
    layer = F.when(F.col("l_returnflag") == "A", 1).when(F.col("l_returnflag") == "N", 2).otherwise(3)
    x = F.datediff(F.col("l_shipdate"), F.lit("1992-01-01").cast("date")).cast("double")
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", x.alias("x"), layer.alias("layer"), status.alias("status"), F.col("l_quantity").alias("sample"), (F.col("l_extendedprice") / 10000).alias("twtt"), (1 - F.col("l_discount") * 5).alias("confidence"))


SQL_LATTICE = "CASE WHEN bool_or(status = 'unresolved') THEN 'unresolved' WHEN bool_and(status = 'accepted') THEN 'accepted' WHEN bool_and(status IN ('high_confidence', 'accepted')) THEN 'high_confidence' ELSE 'review' END"


@register(
    "thickness_bins",
    f"""WITH {SQL_PICKS}, {SQL_SEGMENTS}, e AS (SELECT max(x) AS top FROM pick), b AS (SELECT *, CAST(least(floor(x / 7), greatest(ceil(top / 7) - 1, 0)) AS BIGINT) AS bin FROM pick, e),
    g AS (SELECT bin, layer, median(sample) FILTER (WHERE status <> 'unresolved') AS sample, median(twtt) FILTER (WHERE status <> 'unresolved') AS twtt, median(confidence) FILTER (WHERE status <> 'unresolved') AS confidence, {SQL_LATTICE} AS status, count(*) AS picks FROM b GROUP BY 1, 2),
    t AS (SELECT *, twtt - coalesce(CASE WHEN layer = 1 THEN 0 END, CASE WHEN lag(layer) OVER w = layer - 1 THEN lag(twtt) OVER w END) AS gap FROM g WINDOW w AS (PARTITION BY bin ORDER BY layer)),
    u AS (SELECT *, {LIGHT} * gap / (2 * sqrt(7.0::DOUBLE)) * 1000 AS thickness FROM t),
    m AS (SELECT u.bin, u.layer, arg_min(design, ord) AS design FROM u JOIN seg ON seg.k = u.layer AND u.bin % 60 BETWEEN lo AND hi GROUP BY 1, 2)
    SELECT u.bin, u.layer, u.status, u.picks, round(u.sample, 6) AS sample, round(u.twtt, 8) AS twtt, round(u.thickness, 6) AS thickness, round(u.thickness - 1000 * {LIGHT} * 2 * (1 + 7 * (1 - u.confidence)) * 0.01 - 0.1 * u.thickness, 6) AS low, m.design,
    CASE WHEN m.design IS NULL THEN 'not_evaluated' WHEN u.thickness IS NULL OR u.status = 'unresolved' THEN 'unresolved' WHEN abs(u.thickness - m.design) <= 0.1 * m.design THEN 'compliant' ELSE 'out_of_tolerance' END AS compliance
    FROM u LEFT JOIN m ON u.bin = m.bin AND u.layer = m.layer""",
)
def thickness_bins(spark, d):
    """Report bins of picks by layer: medians of resolved picks, status lattice, thickness from the layer above, compliance with the design there."""
    rows = picks(spark, d)
    # One row: the extent's end, for the last bin's closed edge.
    binned = rows.join(F.broadcast(rows.agg(F.max("x").alias("top")))).withColumn("bin", agg.bin_of(F.col("x"), 7.0, F.col("top")))
    solved = lambda c: F.median(F.when(F.col("status") != agg.UNRESOLVED, F.col(c)))
    groups = binned.groupBy("bin", "layer").agg(solved("sample").alias("sample"), solved("twtt").alias("twtt"), solved("confidence").alias("confidence"), agg.status_lattice(F.col("status")).alias("status"), F.count("*").alias("picks"))
    w = Window.partitionBy("bin").orderBy("layer")
    above = F.when(F.col("layer") == 1, F.lit(0.0)).when(F.lag("layer").over(w) == F.col("layer") - 1, F.lag("twtt").over(w))
    thick = groups.withColumn("thickness", F.lit(LIGHT) * (F.col("twtt") - above) / (2 * F.sqrt(F.lit(7.0))) * 1000).withColumn("row", F.concat_ws("/", "bin", "layer")).withColumn("at", (F.col("bin") % 60).cast("double")).withColumn("k", F.col("layer"))
    hit = joins.interval_first_match(thick, segments(spark, d), ["k"], "row", "at", "lo", "hi", "ord", ["design"], 8.0)
    t = F.col("thickness")
    state = F.when(F.col("design").isNull(), "not_evaluated").when(t.isNull() | (F.col("status") == agg.UNRESOLVED), "unresolved").when(F.abs(t - F.col("design")) <= 0.1 * F.col("design"), "compliant").otherwise("out_of_tolerance")
    low = t - 1000 * F.lit(LIGHT) * 2 * (1 + 7 * (1 - F.col("confidence"))) * 0.01 - 0.1 * t
    return hit.select("bin", "layer", "status", "picks", F.round("sample", 6).alias("sample"), F.round("twtt", 8).alias("twtt"), F.round(t, 6).alias("thickness"), F.round(low, 6).alias("low"), "design", state.alias("compliance"))


@register(
    "stack_median",
    "SELECT CAST(floor(vec_id / 4) AS BIGINT) AS stack, CAST(k - 1 AS INTEGER) AS sample, round(median(CAST(embedding[k] AS DOUBLE)), 6) AS value, (min(vec_id) + max(vec_id)) / 2.0::DOUBLE AS centre FROM embeddings, (SELECT unnest(range(1, 65)) AS k) GROUP BY 1, 2",
)
def stack_median(spark, d):
    return agg.stacked(read(spark, d, "embeddings"), "vec_id", "embedding", 4).select("stack", "sample", F.round("value", 6).alias("value"), "centre")


@register(
    "stack_valid_support",
    "SELECT CAST(floor(vec_id / 4) AS BIGINT) AS stack, CAST(k - 1 AS INTEGER) AS sample, round(CASE WHEN count(*) FILTER (WHERE embedding[k] < 0.1) * 2 >= count(*) THEN median(CASE WHEN embedding[k] < 0.1 THEN CAST(embedding[k] AS DOUBLE) END) END, 6) AS value FROM embeddings, (SELECT unnest(range(1, 65)) AS k) GROUP BY 1, 2",
)
def stack_valid_support(spark, d):
    cells = read(spark, d, "embeddings").select(F.floor(F.col("vec_id") / 4).cast("long").alias("stack"), F.posexplode("embedding").alias("sample", "v"))
    ok = F.col("v") < F.lit(0.1).cast("float")
    return cells.groupBy("stack", "sample").agg(F.round(F.when(F.count_if(ok) * 2 >= F.count("*"), F.median(F.when(ok, F.col("v").cast("double")))), 6).alias("value"))


@register(
    "status_decision",
    f"""WITH {SQL_PICKS} SELECT l_orderkey, l_linenumber, CASE WHEN status = 'unresolved' THEN 'unresolved' WHEN confidence >= 0.7 AND twtt > 1 THEN 'accepted' WHEN confidence >= 0.45 THEN 'high_confidence' ELSE 'review' END AS decided,
    CASE WHEN status = 'unresolved' THEN NULL ELSE round(twtt, 6) END AS twtt, CASE WHEN status = 'unresolved' THEN 'no_event' WHEN confidence < 0.45 THEN 'weak_evidence' WHEN twtt <= 1 THEN 'too_shallow' END AS reason FROM pick""",
)
def status_decision(spark, d):
    open_ = F.col("status") == agg.UNRESOLVED
    decided = F.when(open_, agg.UNRESOLVED).when((F.col("confidence") >= 0.7) & (F.col("twtt") > 1), agg.ACCEPTED).when(F.col("confidence") >= 0.45, agg.HIGH).otherwise(agg.REVIEW)
    reason = agg.first_reason(("no_event", open_), ("weak_evidence", F.col("confidence") < 0.45), ("too_shallow", F.col("twtt") <= 1))
    return picks(spark, d).select("l_orderkey", "l_linenumber", decided.alias("decided"), F.when(~open_, F.round("twtt", 6)).alias("twtt"), reason.alias("reason"))


@register("accepted_measurements", f"WITH {SQL_PICKS} SELECT l_orderkey, l_linenumber, layer FROM pick WHERE status IN ('high_confidence', 'accepted') AND sample >= 0 AND NOT isnan(sample) AND twtt >= 0 AND isfinite(twtt)")
def accepted_measurements(spark, d):
    sound = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.col(c) >= 0) & (F.col(c) < float("inf"))
    return picks(spark, d).filter(F.col("status").isin(agg.HIGH, agg.ACCEPTED) & sound("sample") & sound("twtt")).select("l_orderkey", "l_linenumber", "layer")


@register(
    "profile_cumulative",
    f"""WITH {SQL_PICKS}, g AS (SELECT CAST(floor(x / 14) AS BIGINT) AS bin, layer, CASE WHEN count(*) FILTER (WHERE status <> 'unresolved') >= 5 THEN median(sample) END AS thickness, CASE WHEN count(*) FILTER (WHERE status <> 'unresolved') >= 5 THEN greatest(min(sample) - 1, 0) END AS low0 FROM pick GROUP BY 1, 2),
    h AS (SELECT bin, layer, thickness, CASE WHEN low0 = 0 THEN thickness ELSE low0 END AS low FROM g)
    SELECT bin, layer, CASE WHEN min(CASE WHEN thickness IS NULL THEN 0 ELSE 1 END) OVER w = 1 THEN round(sum(thickness) OVER w, 6) END AS depth, CASE WHEN min(CASE WHEN low IS NULL THEN 0 ELSE 1 END) OVER w = 1 THEN round(sum(low) OVER w, 6) END AS depth_low FROM h WINDOW w AS (PARTITION BY bin ORDER BY layer)""",
)
def profile_cumulative(spark, d):
    """A low of zero falls back to the thickness."""
    solved = F.count_if(F.col("status") != agg.UNRESOLVED) >= 5
    groups = picks(spark, d).groupBy(F.floor(F.col("x") / 14).cast("long").alias("bin"), "layer").agg(F.when(solved, F.median("sample")).alias("thickness"), F.when(solved, F.greatest(F.min("sample") - 1, F.lit(0.0))).alias("low"))
    rows = groups.withColumn("low", F.when(F.col("low") == 0, F.col("thickness")).otherwise(F.col("low")))
    return agg.profile(rows, ["bin"], "layer", ["thickness", "low"]).select("bin", "layer", F.round("thickness_sum", 6).alias("depth"), F.round("low_sum", 6).alias("depth_low"))


@register(
    "paired_layer_gaps",
    """WITH p AS (SELECT o_custkey AS road, l_orderkey, l_linenumber, l_quantity AS q FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
    SELECT a.road, count(*) AS pairs, round(median(b.q - a.q), 6) AS gap FROM p a JOIN p b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 AND a.road = b.road GROUP BY 1""",
)
def paired_layer_gaps(spark, d):
    """Median of differences on identical keys, by pairing the lines inside each order instead of a self join."""
    lines = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity").groupBy("l_orderkey").agg(F.collect_list(F.struct("l_linenumber", "l_quantity")).alias("l"))
    pairs = lines.select("l_orderkey", F.explode("l").alias("a"), "l").select("l_orderkey", "a", F.explode("l").alias("b")).filter(F.col("b.l_linenumber") == F.col("a.l_linenumber") + 1)
    gaps = pairs.select("l_orderkey", (F.col("b.l_quantity") - F.col("a.l_quantity")).alias("gap"))
    orders = read(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("road"))
    return gaps.join(orders, "l_orderkey").groupBy("road").agg(F.count("*").alias("pairs"), F.round(F.median("gap"), 6).alias("gap"))


@register(
    "layer_error_summary",
    f"""WITH {SQL_PICKS}, e AS (SELECT layer, status, abs(sample - 25) AS err FROM pick) SELECT layer, count(*) AS n, count(*) FILTER (WHERE err <= 5) AS correct, round(avg(CASE WHEN err <= 5 THEN 1.0 ELSE 0.0 END), 6) AS rate, round(avg(err), 6) AS mae, round(quantile_cont(err, 0.5), 6) AS p50, round(quantile_cont(err, 0.9), 6) AS p90, round(quantile_cont(err, 0.975), 6) AS p975 FROM e WHERE status <> 'unresolved' GROUP BY 1""",
)
def layer_error_summary(spark, d):
    err = picks(spark, d).filter(F.col("status") != agg.UNRESOLVED).select("layer", F.abs(F.col("sample") - 25).alias("err"))
    q = quantiles.exact_quantiles(err, ["layer"], "err", [0.5, 0.9, 0.975], "q")
    out = err.groupBy("layer").agg(F.count("*").alias("n"), F.count_if(F.col("err") <= 5).alias("correct"), F.avg(F.when(F.col("err") <= 5, 1.0).otherwise(0.0)).alias("rate"), F.avg("err").alias("mae")).join(q, "layer")
    return out.select("layer", "n", "correct", F.round("rate", 6).alias("rate"), F.round("mae", 6).alias("mae"), F.round(F.col("q")[0], 6).alias("p50"), F.round(F.col("q")[1], 6).alias("p90"), F.round(F.col("q")[2], 6).alias("p975"))


@register(
    "run_manifest_fractions",
    f"""WITH {SQL_PICKS} SELECT layer, count(*) AS picks, round(avg(CASE WHEN status IN ('accepted', 'high_confidence') THEN 1.0 ELSE 0.0 END), 6) AS accepted_fraction, round(avg(CASE WHEN status = 'review' THEN 1.0 ELSE 0.0 END), 6) AS review_fraction, round(avg(CASE WHEN status = 'unresolved' THEN 1.0 ELSE 0.0 END), 6) AS unresolved_fraction FROM pick GROUP BY 1""",
)
def run_manifest_fractions(spark, d):
    share = lambda *names: F.round(F.avg(F.when(F.col("status").isin(*names), 1.0).otherwise(0.0)), 6)
    return picks(spark, d).groupBy("layer").agg(F.count("*").alias("picks"), share(agg.ACCEPTED, agg.HIGH).alias("accepted_fraction"), share(agg.REVIEW).alias("review_fraction"), share(agg.UNRESOLVED).alias("unresolved_fraction"))


@register(
    "gap_mad_outliers",
    f"""WITH {SQL_EVENTS}, c AS (SELECT event_type, median(value) AS centre FROM ev GROUP BY 1), o AS (SELECT ev.*, centre, abs(value - centre) AS off FROM ev JOIN c ON ev.event_type = c.event_type), m AS (SELECT event_type, median(off) AS mad FROM o GROUP BY 1)
    SELECT event_id, o.event_type, round(off, 6) AS off, off > greatest(2.0, 3 * mad) AS outlier FROM o JOIN m ON o.event_type = m.event_type""",
)
def gap_mad_outliers(spark, d):
    return agg.mad_flags(events(spark, d), ["event_type"], "value", 2.0, 3.0).select("event_id", "event_type", F.round(F.abs(F.col("value") - F.col("centre")), 6).alias("off"), "outlier")


@register(
    "design_ratio_calibration",
    """WITH r AS (SELECT p_brand, p_retailprice / (900 + 10 * p_size) AS ratio FROM part), m AS (SELECT p_brand, median(ratio) AS mid, count(*) AS n FROM r GROUP BY 1), v AS (SELECT r.p_brand, max(abs(ratio - mid) / mid) AS worst FROM r JOIN m ON r.p_brand = m.p_brand GROUP BY 1)
    SELECT m.p_brand, n, round(mid, 6) AS ratio, round(worst, 6) AS worst, round((mid * 0.299792458 * 8 / 2) ** 2, 6) AS dielectric, n >= 3 AND worst <= 0.9 AND (mid * 0.299792458 * 8 / 2) ** 2 > 1 AND (mid * 0.299792458 * 8 / 2) ** 2 <= 40 AS usable FROM m JOIN v ON m.p_brand = v.p_brand""",
)
def design_ratio_calibration(spark, d):
    r = read(spark, d, "part").select("p_brand", (F.col("p_retailprice") / (900 + 10 * F.col("p_size"))).alias("ratio"))
    m = r.groupBy("p_brand").agg(F.median("ratio").alias("mid"), F.count("*").alias("n"))
    worst = r.join(m, "p_brand").groupBy("p_brand", "mid", "n").agg(F.max(F.abs(F.col("ratio") - F.col("mid")) / F.col("mid")).alias("worst"))
    eps = F.pow(F.col("mid") * LIGHT * 8 / 2, F.lit(2))
    return worst.select("p_brand", "n", F.round("mid", 6).alias("ratio"), F.round("worst", 6).alias("worst"), F.round(eps, 6).alias("dielectric"), ((F.col("n") >= 3) & (F.col("worst") <= 0.9) & (eps > 1) & (eps <= 40)).alias("usable"))


@register(
    "scan_normalisation",
    "WITH c AS (SELECT CAST(k - 1 AS INTEGER) AS k, CAST(embedding[k] AS DOUBLE) AS v FROM embeddings, (SELECT unnest(range(1, 65)) AS k)), g AS (SELECT sqrt(avg(v * v)) AS rms FROM c) SELECT k, round(greatest(sqrt(avg(v * v)), 0.01 * any_value(rms)), 6) AS level FROM c, g GROUP BY 1",
)
def scan_normalisation(spark, d):
    cells = read(spark, d, "embeddings").select(F.posexplode(F.col("embedding").cast("array<double>")).alias("k", "v"))
    per = cells.groupBy("k").agg(F.sum(F.col("v") * F.col("v")).alias("s"), F.count("*").alias("n"))
    whole = per.agg(F.sqrt(F.sum("s") / F.sum("n")).alias("rms"))
    return per.join(F.broadcast(whole)).select("k", F.round(F.greatest(F.sqrt(F.col("s") / F.col("n")), 0.01 * F.col("rms")), 6).alias("level"))


@register(
    "annotation_rejection_reason",
    """SELECT coalesce(reason, 'kept') AS reason, count(*) AS n FROM (SELECT CASE WHEN l.doc_id IS NULL THEN 'unlabelled' WHEN l.toxic = 1 THEN 'prohibited' WHEN l.quality = 0 THEN 'poor' WHEN d.n_chars < 200 THEN 'too_short' END AS reason FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id) GROUP BY 1""",
)
def annotation_rejection_reason(spark, d):
    rows = read(spark, d, "documents").select("doc_id", "n_chars").join(read(spark, d, "labels").withColumn("seen", F.lit(True)), "doc_id", "left")
    reason = agg.first_reason(("unlabelled", F.col("seen").isNull()), ("prohibited", F.col("toxic") == 1), ("poor", F.col("quality") == 0), ("too_short", F.col("n_chars") < 200))
    return rows.groupBy(F.coalesce(reason, F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


@register(
    "dedupe_by_sha256",
    "SELECT sha256(text) AS digest, min(doc_id) AS doc_id, count(*) AS copies, to_json(list_sort(list(DISTINCT source))) AS sources FROM documents GROUP BY 1",
)
def dedupe_by_sha256(spark, d):
    rows = read(spark, d, "documents").select(F.sha2("text", 256).alias("digest"), "doc_id", "source")
    return rows.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"), F.to_json(F.sort_array(F.collect_set("source"))).alias("sources"))


@register(
    "complete_seed_count",
    "SELECT count(*) AS complete FROM (SELECT user_id FROM events GROUP BY 1 HAVING count(DISTINCT event_type) = 5)",
)
def complete_seed_count(spark, d):
    return read(spark, d, "events").groupBy("user_id").agg(F.count_distinct("event_type").alias("kinds")).filter("kinds = 5").agg(F.count("*").alias("complete"))


@register(
    "accepted_order_enforced",
    f"""WITH {SQL_PICKS}, n AS (SELECT *, lag(sample) OVER w AS above, lag(status) OVER w AS above_status FROM pick WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, sample, twtt, x, layer)) SELECT l_orderkey, l_linenumber, CASE WHEN status = 'accepted' AND above_status = 'accepted' AND sample < above THEN 'review' ELSE status END AS status FROM n""",
)
def accepted_order_enforced(spark, d):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "sample", "twtt", "x", "layer")
    crossing = (F.col("status") == agg.ACCEPTED) & (F.lag("status").over(w) == agg.ACCEPTED) & (F.col("sample") < F.lag("sample").over(w))
    return picks(spark, d).select("l_orderkey", "l_linenumber", F.when(crossing, agg.REVIEW).otherwise(F.col("status")).alias("status"))
