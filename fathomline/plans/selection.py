"""Selection queries: stable top-k, suppression, near-best candidates, fixed splits."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import selection
from .registry import register
from .tables import SQL_EVENTS, events, read
from .windows import SQL_CELLS, cells


@register("stable_topk", "SELECT o_custkey, o_orderkey, o_totalprice, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 3")
def stable_topk(spark, d):
    return selection.stable_top(read(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], "o_totalprice", "o_orderkey", 3)


@register("top_global", "SELECT vec_id, k, round(v, 6) AS value FROM (SELECT vec_id, CAST(k - 1 AS INTEGER) AS k, CAST(embedding[k] AS DOUBLE) AS v FROM embeddings, (SELECT unnest(range(1, 65)) AS k)) ORDER BY v DESC, vec_id, k LIMIT 100")
def top_global(spark, d):
    """The limit is the feature: a report of the hundred strongest samples, by one TakeOrderedAndProject."""
    return cells(spark, d).orderBy(F.desc("v"), "vec_id", "k").limit(100).select("vec_id", "k", F.round("v", 6).alias("value"))


@register(
    "nms_topk",
    f"""WITH RECURSIVE {SQL_CELLS}, r AS (SELECT vec_id, k, v, row_number() OVER (PARTITION BY vec_id ORDER BY v DESC, k) AS n FROM cell),
    s AS (SELECT vec_id, CAST(0 AS BIGINT) AS n, CAST([] AS INTEGER[]) AS taken FROM (SELECT DISTINCT vec_id FROM r)
    UNION ALL SELECT s.vec_id, r.n, CASE WHEN len(taken) < 5 AND len(list_filter(taken, lambda t: abs(t - r.k) < 4)) = 0 THEN list_append(taken, r.k) ELSE taken END FROM s JOIN r ON r.vec_id = s.vec_id AND r.n = s.n + 1)
    SELECT vec_id, CAST(i AS INTEGER) AS rank, taken[i] AS k FROM (SELECT vec_id, taken, unnest(range(1, len(taken) + 1)) AS i FROM s WHERE n = 64)""",
)
def nms_topk(spark, d):
    """Peaks best first, none within four samples of a better one, five a trace."""
    return selection.suppress(cells(spark, d), ["vec_id"], "k", "v", "k", 4, 5).select("vec_id", F.col("rank").cast("int").alias("rank"), "k")


@register(
    "ranked_lobe_matches",
    f"""WITH {SQL_CELLS}, b AS (SELECT vec_id, k // 8 AS lobe, max(v) AS v, arg_min(k, (-v, k)) AS k FROM cell GROUP BY 1, 2), t AS (SELECT *, max(v) OVER (PARTITION BY vec_id) AS top FROM b), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY v DESC, k) AS rank FROM t WHERE v >= top - 0.15)
    SELECT vec_id, lobe, k, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 3""",
)
def ranked_lobe_matches(spark, d):
    rows = cells(spark, d).withColumn("lobe", F.floor(F.col("k") / 8).cast("int"))
    return selection.near_best(rows, ["vec_id"], "lobe", "v", "k", 0.15, 3).select("vec_id", "lobe", "k", "rank")


@register(
    "distributed_quantile_seeds",
    f"""WITH {SQL_EVENTS}, p AS (SELECT * FROM ev WHERE event_type = 'view'), e AS (SELECT user_id, min(sec) AS lo, max(sec) AS hi FROM p GROUP BY 1), a AS (SELECT *, unnest([0.1, 0.5, 0.9]::DOUBLE[]) AS share FROM e)
    SELECT a.user_id, share, m.sec, m.event_id FROM a JOIN LATERAL (SELECT sec, event_id FROM p WHERE p.user_id = a.user_id ORDER BY abs(sec - (lo + share * (hi - lo))), sec, event_id LIMIT 1) m ON true""",
)
def distributed_quantile_seeds(spark, d):
    return selection.at_shares(events(spark, d, "view"), ["user_id"], "sec", "event_id", [0.1, 0.5, 0.9])


@register(
    "retained_histories",
    """WITH t AS (SELECT l_orderkey AS pred, l_suppkey AS dest, max(l_extendedprice) AS score FROM lineitem GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY dest ORDER BY score DESC, pred) AS own, row_number() OVER (ORDER BY score DESC, pred, dest) AS over_all FROM t)
    SELECT pred, dest, score FROM r WHERE own <= 2 OR over_all <= 50""",
)
def retained_histories(spark, d):
    """The best of each destination together with the best of all, each found by a limited sort; no window sees the whole table."""
    t = read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("pred"), F.col("l_suppkey").alias("dest")).agg(F.max("l_extendedprice").alias("score"))
    own = selection.stable_top(t, ["dest"], "score", "pred", 2).drop("rank")
    return own.union(t.orderBy(F.desc("score"), "pred", "dest").limit(50)).distinct().select("pred", "dest", "score")


@register("split_blocks_mod5", "SELECT l_orderkey, l_linenumber, CAST(b AS INTEGER) AS block, CASE WHEN b < 3 THEN 'development' WHEN b = 3 THEN 'calibration' ELSE 'test' END AS split FROM (SELECT l_orderkey, l_linenumber, CAST(floor(greatest(l_extendedprice - 1000, 0) / 100) AS BIGINT) % 5 AS b FROM lineitem)")
def split_blocks_mod5(spark, d):
    b = (F.floor(F.greatest(F.col("l_extendedprice") - 1000, F.lit(0.0)) / 100) % 5).cast("int")
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", b.alias("block")).withColumn("split", F.when(F.col("block") < 3, "development").when(F.col("block") == 3, "calibration").otherwise("test"))


@register(
    "hash_split_groups",
    "WITH g AS (SELECT DISTINCT o_custkey FROM orders), r AS (SELECT *, percent_rank() OVER (ORDER BY sha256(CAST(o_custkey AS VARCHAR))) AS p FROM g) SELECT o_custkey, CASE WHEN p < 0.2 THEN 'test' WHEN p < 0.4 THEN 'validation' ELSE 'train' END AS split FROM r",
)
def hash_split_groups(spark, d):
    """Groups in the order of their hash. Ranks come from 4,096 classes of the hash: their counts are summed in order, a few rows, and groups are ranked within their class."""
    groups = read(spark, d, "orders").select("o_custkey").distinct().withColumn("h", F.sha2(F.col("o_custkey").cast("string"), 256)).withColumn("c", F.substring("h", 1, 3))
    counts = groups.groupBy("c").count()
    before = counts.select("c", (F.sum("count").over(Window.orderBy("c")) - F.col("count")).alias("before"), F.sum("count").over(Window.partitionBy()).alias("n"))
    ranked = groups.withColumn("k", F.rank().over(Window.partitionBy("c").orderBy("h"))).join(before, "c")
    p = (F.col("before") + F.col("k") - 1) / F.greatest(F.col("n") - 1, F.lit(1))
    return ranked.select("o_custkey", F.when(p < 0.2, "test").when(p < 0.4, "validation").otherwise("train").alias("split"))


@register(
    "leave_one_group_out",
    "WITH g AS (SELECT DISTINCT c_nationkey AS grp FROM customer) SELECT a.grp AS held_out, count(*) AS training_groups, to_json(list_sort(list(b.grp))) AS groups FROM g a JOIN g b ON a.grp <> b.grp GROUP BY 1 HAVING count(*) >= 3",
)
def leave_one_group_out(spark, d):
    """Each group with the others to learn from: one list of all, less the group's own; no pairs."""
    g = read(spark, d, "customer").select(F.col("c_nationkey").alias("grp")).distinct()
    # One row, of one number a group.
    every = g.agg(F.sort_array(F.collect_list("grp")).alias("every"))
    rest = g.join(F.broadcast(every)).select(F.col("grp").alias("held_out"), F.array_remove("every", F.col("grp")).alias("rest"))
    return rest.select("held_out", F.size("rest").cast("long").alias("training_groups"), F.to_json("rest").alias("groups")).filter("training_groups >= 3")


@register(
    "widest_seed_gap",
    f"""WITH {SQL_EVENTS}, n AS (SELECT user_id, sec, event_id, lead(sec) OVER (PARTITION BY user_id ORDER BY sec, event_id) - sec AS gap FROM ev WHERE event_type = 'signup') SELECT user_id, max(gap) AS gap, arg_min(sec, (-gap, sec)) AS starts_at FROM n WHERE gap IS NOT NULL GROUP BY 1""",
)
def widest_seed_gap(spark, d):
    w = Window.partitionBy("user_id").orderBy("sec", "event_id")
    gaps = events(spark, d, "signup").withColumn("gap", F.lead("sec").over(w) - F.col("sec")).filter("gap is not null")
    return gaps.groupBy("user_id").agg(F.min(F.struct((-F.col("gap")).alias("n"), "sec")).alias("m")).select("user_id", (-F.col("m.n")).alias("gap"), F.col("m.sec").alias("starts_at"))
