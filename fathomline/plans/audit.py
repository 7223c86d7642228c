"""Audits of references and datasets, benchmark selection, loss stages."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .registry import register
from .tables import SQL_EVENTS, events, read


@register(
    "reference_audit",
    """WITH c AS (SELECT l_orderkey, l_linenumber, count(*) AS copies, min(l_quantity) AS q FROM lineitem GROUP BY 1, 2), o AS (SELECT *, lag(q) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS above FROM c)
    SELECT l_linenumber AS layer, count(*) AS picks, count(*) FILTER (WHERE copies > 1) AS duplicated, count(*) FILTER (WHERE q < above) AS crossing, count(*) FILTER (WHERE NOT q BETWEEN 2 AND 49) AS out_of_bounds, round(median(q - above), 6) AS median_gap FROM o GROUP BY 1""",
)
def reference_audit(spark, d):
    """Duplicate keys, picks above the layer over them, picks out of bounds, by layer."""
    c = read(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("copies"), F.min("l_quantity").alias("q"))
    o = c.withColumn("above", F.lag("q").over(Window.partitionBy("l_orderkey").orderBy("l_linenumber")))
    return o.groupBy(F.col("l_linenumber").alias("layer")).agg(F.count("*").alias("picks"), F.count_if(F.col("copies") > 1).alias("duplicated"), F.count_if(F.col("q") < F.col("above")).alias("crossing"), F.count_if(~F.col("q").between(2, 49)).alias("out_of_bounds"), F.round(F.median(F.col("q") - F.col("above")), 6).alias("median_gap"))


@register(
    "benchmark_selection",
    """WITH k AS (SELECT unnest([0.3, 0.5, 0.7, 0.9]::DOUBLE[]) AS config), m AS (SELECT config, o_orderpriority AS c, count(*) AS n, avg(CASE WHEN o_totalprice / 500000 >= config THEN 1.0 ELSE 0.0 END) AS review, avg(abs(o_totalprice / 500000 - config)) AS mae FROM orders, k GROUP BY 1, 2)
    SELECT c AS layer, arg_min(config, (round(review, 9), round(mae, 9), config)) AS config, round(min(review), 6) AS review, bool_and(n >= 30) AS gate FROM m GROUP BY 1""",
)
def benchmark_selection(spark, d):
    """Every configuration on every case, in one pass over the cases; the best by review share, then error, then name."""
    x = F.col("o_totalprice") / 500000
    configs = [0.3, 0.5, 0.7, 0.9]
    parts = [F.struct(F.lit(c).alias("config"), F.avg(F.when(x >= c, 1.0).otherwise(0.0)).alias("review"), F.avg(F.abs(x - c)).alias("mae")) for c in configs]
    m = read(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("layer")).agg(F.array(*parts).alias("m"), F.count("*").alias("n"))
    best = F.array_min(F.transform("m", lambda s: F.struct(F.round(s["review"], 9).alias("r"), F.round(s["mae"], 9).alias("e"), s["config"].alias("config"))))
    return m.select("layer", best["config"].alias("config"), F.round(F.array_min(F.transform("m", lambda s: s["review"])), 6).alias("review"), (F.col("n") >= 30).alias("gate"))


@register(
    "loss_stage_cascade",
    f"""WITH {SQL_EVENTS}, p AS (SELECT * FROM ev WHERE event_type = 'signup'), n AS (SELECT p.event_id, p.value, (SELECT min(abs(c.sec - p.sec)) FROM ev c WHERE c.event_type = 'view' AND c.user_id = p.user_id) AS row_gap, (SELECT count(*) FROM ev c WHERE c.event_type = 'click' AND c.user_id = p.user_id AND abs(c.sec - p.sec) <= 43200 AND abs(c.value - p.value) <= 20) AS candidates, (SELECT count(*) FROM ev c WHERE c.event_type = 'purchase' AND c.user_id = p.user_id AND abs(c.sec - p.sec) <= 86400 AND abs(c.value - p.value) <= 20) AS picks FROM p)
    SELECT CASE WHEN row_gap IS NULL OR row_gap > 86400 THEN 'no_row' WHEN candidates = 0 THEN 'no_candidate' WHEN picks = 0 THEN 'not_selected' ELSE 'retained' END AS stage, count(*) AS checkpoints FROM n GROUP BY 1""",
)
def loss_stage_cascade(spark, d):
    """The first stage at which each checkpoint is lost: rows, candidates, picks, by nearest and band joins."""
    from ..operators import joins

    points = events(spark, d, "signup").select("event_id", "user_id", "sec", "value")
    rows = joins.nearest(points, events(spark, d, "view"), ["user_id"], "sec", "event_id", []).withColumn("row_gap", F.abs(F.col("matched_at") - F.col("sec"))).select("event_id", "row_gap")

    def near(kind, width, name):
        right = events(spark, d, kind).select("user_id", F.col("sec").alias("rsec"), F.col("value").alias("rvalue"))
        hits = joins.band(points, right, ["user_id"], "sec", "rsec", float(width)).filter(F.abs(F.col("rvalue") - F.col("value")) <= 20)
        return hits.groupBy("event_id").agg(F.count("*").alias(name))

    both = rows.join(near("click", 43200, "candidates"), "event_id", "left").join(near("purchase", 86400, "picks"), "event_id", "left")
    stage = F.when(F.coalesce(F.col("row_gap") > 86400, F.lit(True)), "no_row").when(F.col("candidates").isNull(), "no_candidate").when(F.col("picks").isNull(), "not_selected").otherwise("retained")
    return both.groupBy(stage.alias("stage")).agg(F.count("*").alias("checkpoints"))


@register(
    "dataset_inventory",
    """WITH k AS (SELECT sha256(text) AS h, min(doc_id) AS doc_id, count(*) AS copies, min(n_chars) AS n FROM documents GROUP BY 1), r AS (SELECT k.*, l.quality, CASE WHEN l.doc_id IS NULL THEN 'no_label' WHEN n < 100 THEN 'short' END AS reason FROM k LEFT JOIN labels l ON l.doc_id = k.doc_id)
    SELECT coalesce(reason, 'eligible') AS state, count(*) AS records, CAST(sum(copies) AS BIGINT) AS files, count(*) FILTER (WHERE copies > 1) AS with_aliases FROM r GROUP BY 1""",
)
def dataset_inventory(spark, d):
    k = read(spark, d, "documents").groupBy(F.sha2("text", 256).alias("h")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"), F.min("n_chars").alias("n"))
    r = k.join(read(spark, d, "labels").select("doc_id", F.lit(True).alias("seen")), "doc_id", "left")
    state = F.when(F.col("seen").isNull(), "no_label").when(F.col("n") < 100, "short").otherwise("eligible")
    return r.groupBy(state.alias("state")).agg(F.count("*").alias("records"), F.sum("copies").alias("files"), F.count_if(F.col("copies") > 1).alias("with_aliases"))


@register(
    "header_mismatches",
    "SELECT a.p_partkey, concat_ws(',', CASE WHEN a.p_brand <> b.p_brand THEN 'brand' END, CASE WHEN a.p_type <> b.p_type THEN 'type' END, CASE WHEN abs(a.p_size - b.p_size) > 5 THEN 'size' END) AS problems FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1",
)
def header_mismatches(spark, d):
    p = read(spark, d, "part").select("p_partkey", "p_brand", "p_type", "p_size")
    q = p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_brand").alias("b"), F.col("p_type").alias("t"), F.col("p_size").alias("s"))
    problems = F.concat_ws(",", F.when(F.col("p_brand") != F.col("b"), "brand"), F.when(F.col("p_type") != F.col("t"), "type"), F.when(F.abs(F.col("p_size") - F.col("s")) > 5, "size"))
    return p.join(q, "p_partkey").select("p_partkey", problems.alias("problems"))


@register(
    "layer_sequence_check",
    "SELECT l_orderkey, max(l_linenumber) AS layers, count(DISTINCT l_linenumber) = max(l_linenumber) AND min(l_linenumber) = 1 AS complete FROM lineitem GROUP BY 1",
)
def layer_sequence_check(spark, d):
    """Enabled layers must be exactly 1 to the last."""
    s = F.sort_array(F.collect_set("l_linenumber"))
    g = read(spark, d, "lineitem").groupBy("l_orderkey").agg(s.alias("s"))
    last = F.array_max("s")
    return g.select("l_orderkey", last.alias("layers"), (F.col("s") == F.sequence(F.lit(1), last)).alias("complete"))


@register(
    "case_metrics",
    """WITH r AS (SELECT o_orderpriority AS layer, CASE WHEN o_orderkey % 3 = 0 THEN 'seed' ELSE 'blind' END AS kind, abs(o_totalprice / 1000 - 150) AS err FROM orders) SELECT layer, kind, count(*) AS n, round(avg(CASE WHEN err <= 50 THEN 1.0 ELSE 0.0 END), 6) AS pass_rate, round(avg(err), 6) AS mae, round(quantile_cont(err, 0.9), 6) AS p90, concat_ws(';', CASE WHEN count(*) < 30 THEN 'too_few' END, CASE WHEN avg(CASE WHEN err <= 50 THEN 1.0 ELSE 0.0 END) < 0.3 THEN 'low_pass_rate' END) AS reasons FROM r GROUP BY 1, 2""",
)
def case_metrics(spark, d):
    orders = read(spark, d, "orders")
    r = orders.select(F.col("o_orderpriority").alias("layer"), F.when(F.col("o_orderkey") % 3 == 0, "seed").otherwise("blind").alias("kind"), F.abs(F.col("o_totalprice") / 1000 - 150).alias("err"))
    passed = F.avg(F.when(F.col("err") <= 50, 1.0).otherwise(0.0))
    g = r.groupBy("layer", "kind").agg(F.count("*").alias("n"), passed.alias("p"), F.avg("err").alias("mae"), F.percentile("err", F.lit(0.9)).alias("p90"))
    return g.select("layer", "kind", "n", F.round("p", 6).alias("pass_rate"), F.round("mae", 6).alias("mae"), F.round("p90", 6).alias("p90"), F.concat_ws(";", F.when(F.col("n") < 30, "too_few"), F.when(F.col("p") < 0.3, "low_pass_rate")).alias("reasons"))
