"""Path and graph queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import chains, paths, scans
from .registry import register
from .tables import SQL_EVENTS, events, read
from .windows import cells


def _chain_sql(step: str, states: int = 64, scores: str = "x") -> str:
    """Forward and backward scores of every row and state: f.best, the best way to it, and g.tail, the best way on from it. ``step`` is the score of i to j."""
    every = f"range(1, {states + 1})"
    return (
        f"r AS (SELECT label, vec_id, row_number() OVER w AS n, count(*) OVER (PARTITION BY label) AS last, {scores} AS s FROM (SELECT label, vec_id, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS x FROM embeddings) WINDOW w AS (PARTITION BY label ORDER BY vec_id)), "
        f"f AS (SELECT label, n, s AS best FROM r WHERE n = 1 UNION ALL SELECT r.label, r.n, list_transform({every}, lambda j: list_max(list_transform({every}, lambda i: f.best[i] + {step})) + r.s[j]) FROM f JOIN r ON r.label = f.label AND r.n = f.n + 1), "
        f"g AS (SELECT label, n, list_transform(s, lambda v: 0::DOUBLE) AS tail FROM r WHERE n = last UNION ALL SELECT r.label, r.n - 1, list_transform({every}, lambda i: list_max(list_transform({every}, lambda j: {step} + r.s[j] + g.tail[j]))) FROM g JOIN r ON r.label = g.label AND r.n = g.n AND r.n > 1), "
        f"p AS (SELECT f.label, f.n, list_position(best, list_max(best)) AS st FROM f JOIN r ON r.label = f.label AND r.n = f.n AND f.n = r.last UNION ALL SELECT label, n, list_position(w, list_max(w)) FROM (SELECT f.label, f.n, list_transform({every}, lambda i: f.best[i] + {step.replace('j', 'p.st')}) AS w FROM p JOIN f ON f.label = p.label AND f.n = p.n - 1))"
    )


SLOPE = "(-0.05 * abs(i - j))"


def chain(spark, d, step, scores=lambda s: s):
    """The chains of all roads: whole traces in order, each row with a score for every depth."""
    rows = read(spark, d, "embeddings").select("label", "vec_id", scores(F.col("embedding").cast("array<double>")).alias("s"))
    return chains.Chains(rows, ["label"], "vec_id", "s", step)


@register("viterbi_l1_score", f"WITH RECURSIVE {_chain_sql(SLOPE)} SELECT r.label, round(list_max(best), 6) AS best FROM f JOIN r ON r.label = f.label AND r.n = f.n WHERE f.n = last")
def viterbi_l1_score(spark, d):
    """The best path's score through all samples of a road's traces."""
    return chain(spark, d, chains.slope_steps(64, 0.05)).best().select("label", F.round("best", 6).alias("best"))


@register("viterbi_l1_path", f"WITH RECURSIVE {_chain_sql(SLOPE)} SELECT r.label, r.vec_id, CAST(st - 1 AS INTEGER) AS state FROM p JOIN r ON r.label = p.label AND r.n = p.n")
def viterbi_l1_path(spark, d):
    """The depths of the best path itself."""
    return chain(spark, d, chains.slope_steps(64, 0.05)).path()


@register(
    "interval_min_marginals",
    f"WITH RECURSIVE {_chain_sql('(-0.05 * least(abs(i - j), 3))')}, m AS (SELECT f.label, f.n, list_reverse_sort(list_transform(range(1, 65), lambda i: best[i] + tail[i])) AS m FROM f JOIN g ON g.label = f.label AND g.n = f.n) SELECT r.label, r.vec_id, round(m[1] - m[2], 6) AS margin FROM m JOIN r ON r.label = m.label AND r.n = m.n",
)
def interval_min_marginals(spark, d):
    """The margin of each row: how much worse the best chain through its second state is than the best of all."""
    ranked = F.sort_array("m", asc=False)
    return chain(spark, d, chains.slope_steps(64, 0.05, 3)).marginals("m").select("label", "vec_id", F.round(ranked[0] - ranked[1], 6).alias("margin"))


@register(
    "gapped_decoding",
    f"WITH RECURSIVE {_chain_sql('(CASE WHEN i = 65 AND j = 65 THEN 0.0::DOUBLE WHEN i = 65 OR j = 65 THEN -0.1::DOUBLE ELSE -0.05 * abs(i - j) END)', 65, 'list_append(x, 0.02::DOUBLE)')} SELECT r.label, r.vec_id, CAST(CASE WHEN st = 65 THEN -1 ELSE st - 1 END AS INTEGER) AS state FROM p JOIN r ON r.label = p.label AND r.n = p.n",
)
def gapped_decoding(spark, d):
    """The best path that may leave the samples for a gap, which costs to enter and to leave."""
    made = chain(spark, d, chains.gap_steps(64, 0.05, -0.1), lambda s: F.concat(s, F.array(F.lit(0.02)))).path()
    return made.select("label", "vec_id", F.when(F.col("state") == 64, -1).otherwise(F.col("state")).alias("state"))


@register(
    "bottleneck_support",
    f"""WITH {SQL_EVENTS}, p AS (SELECT *, least(value / 100, 1.0) AS w, event_type = 'signup' AS seed FROM ev), n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i, max(CASE WHEN seed THEN event_id END) OVER (PARTITION BY user_id ORDER BY event_id) AS bs, min(CASE WHEN seed THEN event_id END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS fs FROM p)
    SELECT a.user_id, a.event_id, round(greatest(CASE WHEN a.seed THEN 1.0 WHEN a.bs IS NULL THEN 0.0 ELSE (SELECT min(b.w) FROM p b WHERE b.user_id = a.user_id AND b.event_id > a.bs AND b.event_id <= a.event_id) END, CASE WHEN a.seed THEN 1.0 WHEN a.fs IS NULL THEN 0.0 ELSE (SELECT min(b.w) FROM p b WHERE b.user_id = a.user_id AND b.event_id > a.event_id AND b.event_id <= a.fs) END), 6) AS support FROM n a""",
)
def bottleneck_support(spark, d):
    rows = events(spark, d).select("user_id", "event_id", F.least(F.col("value") / 100, F.lit(1.0)).alias("w"), (F.col("event_type") == "signup").alias("seed"))
    return scans.from_marks(rows, ["user_id"], ["event_id"], "w", "seed", "support").select("user_id", "event_id", F.round("support", 6).alias("support"))


@register(
    "connected_components_roads",
    """WITH RECURSIVE e AS (SELECT DISTINCT o_custkey AS a, 1000000 + o_orderkey % 700 AS b FROM orders), n AS (SELECT a AS x, b AS y FROM e UNION SELECT b, a FROM e), r AS (SELECT x AS node, x AS root FROM n UNION SELECT n.y, r.root FROM r JOIN n ON n.x = r.node WHERE r.root < n.y)
    SELECT node, min(root) AS component FROM r GROUP BY 1""",
)
def connected_components_roads(spark, d):
    """Roads that share a file, grouped before they are split into folds."""
    return paths.components(read(spark, d, "orders").select(F.col("o_custkey").alias("a"), (F.col("o_orderkey") % 700 + 1000000).alias("b")))


#: Costs of aligning arrays s and t of 64 within a band of 2, an antidiagonal at a time.
SQL_DTW = """g AS (SELECT vec_id, 0 AS k, CAST(NULL AS DOUBLE[]) AS before, CAST(NULL AS DOUBLE[]) AS last FROM p
    UNION ALL SELECT g.vec_id, k + 1, last, list_transform(range(1, 65), lambda i: CASE WHEN k + 2 - i BETWEEN 1 AND 64 AND abs(i - (k + 2 - i)) <= 2 THEN (p.s[i] - p.t[k + 2 - i]) ** 2 + CASE WHEN k = 0 THEN 0 ELSE least(coalesce(CASE WHEN i > 1 THEN last[i - 1] END, 1e18), coalesce(last[i], 1e18), coalesce(CASE WHEN i > 1 THEN before[i - 1] END, 1e18)) END ELSE 1e18 END) FROM g JOIN p ON p.vec_id = g.vec_id WHERE k < 127)"""


@register(
    "constrained_dtw_pairs",
    f"""WITH RECURSIVE p AS (SELECT a.vec_id, list_transform(a.embedding, lambda x: CAST(x AS DOUBLE)) AS s, list_transform(b.embedding, lambda x: CAST(x AS DOUBLE)) AS t FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1), {SQL_DTW}
    SELECT vec_id, round(last[64], 6) AS cost, round(exp(-last[64] / 64), 6) AS agreement FROM g WHERE k = 127""",
)
def constrained_dtw_pairs(spark, d):
    """The cost of aligning every two neighbouring traces, whole, within a band."""
    pairs = _neighbours(spark, d)
    cost = paths.banded_dtw(F.col("s"), F.col("t"), 64, 2)
    return pairs.select("vec_id", cost.alias("c")).select("vec_id", F.round("c", 6).alias("cost"), F.round(F.exp(-F.col("c") / 64), 6).alias("agreement"))


def _neighbours(spark, d):
    emb = read(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("s"))
    return emb.join(emb.select((F.col("vec_id") - 1).alias("vec_id"), F.col("s").alias("t")), "vec_id")


@register(
    "correspondence_links",
    """WITH c AS (SELECT vec_id, label, CAST(k - 1 AS INTEGER) AS k, CAST(embedding[k] AS DOUBLE) AS v FROM embeddings, (SELECT unnest(range(1, 65)) AS k)), m AS (SELECT *, lag(v) OVER w AS b, lead(v) OVER w AS a FROM c WINDOW w AS (PARTITION BY vec_id ORDER BY k)), p AS (SELECT vec_id, k, v FROM m WHERE v > b AND v >= a AND v > 0.1),
    f AS (SELECT x.vec_id, x.k, arg_min(y.k, (abs(y.k - x.k), y.k)) AS nk FROM p x JOIN p y ON y.vec_id = x.vec_id + 1 AND abs(y.k - x.k) <= 3 GROUP BY 1, 2), r AS (SELECT y.vec_id, y.k, arg_min(x.k, (abs(y.k - x.k), x.k)) AS pk FROM p x JOIN p y ON y.vec_id = x.vec_id + 1 AND abs(y.k - x.k) <= 3 GROUP BY 1, 2)
    SELECT f.vec_id, f.k, f.nk FROM f JOIN r ON r.vec_id = f.vec_id + 1 AND r.k = f.nk AND r.pk = f.k""",
)
def correspondence_links(spark, d):
    """Peaks of neighbouring traces that are each other's nearest within three samples."""
    w = Window.partitionBy("vec_id").orderBy("k")
    peak = cells(spark, d).withColumn("b", F.lag("v").over(w)).withColumn("a", F.lead("v").over(w)).filter("v > b and v >= a and v > 0.1").select("vec_id", "k")
    following = peak.select((F.col("vec_id") - 1).alias("vec_id"), F.col("k").alias("nk"))
    pairs = peak.join(following, "vec_id").withColumn("off", F.abs(F.col("nk") - F.col("k"))).filter("off <= 3")
    forward = pairs.groupBy("vec_id", "k").agg(F.min(F.struct("off", "nk")).alias("m")).select("vec_id", "k", F.col("m.nk").alias("nk"))
    back = pairs.groupBy("vec_id", "nk").agg(F.min(F.struct("off", "k")).alias("m")).select("vec_id", "nk", F.col("m.k").alias("k"))
    return forward.join(back, ["vec_id", "k", "nk"])
