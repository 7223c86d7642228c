"""Audits and evaluations of a run's picks against references, an alternative run and checkpoints."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import reports
from ..operators.solvers import by_road, dense_path, matrix
from .candidates import SQL_CANDIDATES, beside, candidates, seeds, traces
from .evaluation import SQL_SCORED, scored
from .records import SQL_PROBABILITY, probabilities
from .registry import register
from .tables import SQL_EVENTS, events, read
from .windows import cells

PULSE, STEP = 7.0, 0.4
#: A run's pick of each row and layer, a reference for it, and an alternative run's pick (without every fifth sample).
SQL_RUN = f"{SQL_CANDIDATES}, lay AS (SELECT *, CASE WHEN k BETWEEN 6 AND 30 THEN 1 WHEN k BETWEEN 36 AND 58 THEN 2 END AS layer, round(score * (1 - 0.15 * (k % 3)), 9) AS other FROM cand), run AS (SELECT label, layer, i, n, arg_min(k, (-score, k)) AS k, arg_min(pole, (-score, k)) AS pole, max(score) AS conf, arg_min(k, (-other, k)) AS rk, arg_min(pole, (-other, k)) AS rpole, arg_min(k, (-score, k)) FILTER (WHERE k % 5 <> 0) AS ak, arg_min(pole, (-score, k)) FILTER (WHERE k % 5 <> 0) AS apole FROM lay WHERE layer IS NOT NULL GROUP BY 1, 2, 3, 4)"


def layered(spark, d):
    c = candidates(spark, d).withColumn("layer", F.when(F.col("k").between(6, 30), 1).when(F.col("k").between(36, 58), 2)).filter("layer is not null")
    return c.withColumn("other", F.round(F.col("score") * (1 - 0.15 * (F.col("k") % 3)), 9))


def run(spark, d):
    """(label, layer, i, n, k, pole, conf, rk, rpole, ak, apole)."""
    best = lambda v, use=None: F.min(F.when(use if use is not None else F.lit(True), F.struct((-F.col(v)).alias("o"), "k", "pole")))
    g = layered(spark, d).groupBy("label", "layer", "i", "n").agg(best("score").alias("a"), best("other").alias("r"), best("score", F.col("k") % 5 != 0).alias("b"))
    return g.select("label", "layer", "i", "n", F.col("a.k").alias("k"), F.col("a.pole").alias("pole"), (-F.col("a.o")).alias("conf"), F.col("r.k").alias("rk"), F.col("r.pole").alias("rpole"), F.col("b.k").alias("ak"), F.col("b.pole").alias("apole"))


@register(
    "retention_stages",
    f"""WITH {SQL_RUN}, e AS (SELECT label, layer, i, k, row_number() OVER (PARTITION BY label, layer, i ORDER BY score DESC, k) AS rank FROM lay WHERE layer IS NOT NULL AND k % 4 <> 1), m AS (SELECT r.label, r.layer, r.i, min(e.rank) AS rank, arg_min(e.k, e.rank) AS ek FROM run r JOIN e ON e.label = r.label AND e.layer = r.layer AND e.i = r.i AND abs(e.k - r.rk) <= {PULSE} GROUP BY 1, 2, 3),
    j AS (SELECT r.*, m.rank, m.ek, (r.i * r.layer) % 11 <> 0 AS expected, r.rk >= 6 + r.i % 9 AS inside, r.conf >= 0.45 AS visible, abs(r.k - r.rk) <= {PULSE} AS selected FROM run r LEFT JOIN m ON m.label = r.label AND m.layer = r.layer AND m.i = r.i)
    SELECT label, layer, i, rank, CASE WHEN expected THEN CASE WHEN NOT inside THEN 'corridor_exclusion' WHEN rank IS NULL THEN 'candidate_generation_or_pruning' WHEN NOT selected AND ek % 3 = 0 THEN 'seed_lineage_exclusion' WHEN NOT selected THEN 'graph_or_ranker_selection' WHEN NOT visible THEN 'confidence_or_visibility_gate' ELSE 'retained' END WHEN visible THEN 'false_visible_pick' ELSE 'retained_absence' END AS stage, CASE WHEN visible THEN abs(k - rk) END AS error FROM j""",
)
def retention_stages(spark, d):
    """For every checkpoint the stage at which its event was lost, the rank of the event and the pick's error."""
    w = Window.partitionBy("label", "layer", "i").orderBy(F.desc("score"), "k")
    e = layered(spark, d).filter("k % 4 <> 1").withColumn("rank", F.row_number().over(w)).select("label", "layer", "i", F.col("k").alias("ek"), "rank")
    r = run(spark, d)
    m = r.select("label", "layer", "i", "rk").join(e, ["label", "layer", "i"]).filter(F.abs(F.col("ek") - F.col("rk")) <= PULSE).groupBy("label", "layer", "i").agg(F.min(F.struct("rank", "ek")).alias("m"))
    j = r.join(m, ["label", "layer", "i"], "left")
    visible = F.col("conf") >= 0.45
    stage = reports.loss_stage((F.col("i") * F.col("layer")) % 11 != 0, F.col("rk") >= 6 + F.col("i") % 9, F.col("m").isNotNull(), F.abs(F.col("k") - F.col("rk")) <= PULSE, F.col("m.ek") % 3 != 0, visible)
    return j.select("label", "layer", "i", F.col("m.rank").alias("rank"), stage.alias("stage"), F.when(visible, F.abs(F.col("k") - F.col("rk"))).alias("error"))


@register(
    "dropout_audit",
    f"""WITH {SQL_RUN}, s AS (SELECT *, ak IS NOT NULL AND abs(k - ak) <= {PULSE} AND pole = apole AS stable FROM run) SELECT label, layer, count(*) AS checked, count(*) FILTER (WHERE NOT stable) AS unstable, count(*) FILTER (WHERE NOT stable AND conf >= 0.45) AS demoted, coalesce(bool_or(NOT stable) FILTER (WHERE i = n // 2), false) AS station_inconsistent, max(k) FILTER (WHERE i = n // 2) AS withheld, max(ak) FILTER (WHERE i = n // 2) AS independent, max(abs(k - ak)) FILTER (WHERE NOT stable) AS farthest FROM s GROUP BY 1, 2""",
)
def dropout_audit(spark, d):
    """What depends on one station: rows whose event another run without it does not find, demotions, and the station's own pick."""
    stable = reports.same_observation(F.col("k"), F.col("ak"), F.col("pole"), F.col("apole"), PULSE)
    s = run(spark, d).withColumn("stable", stable)
    here, off = F.col("i") == F.expr("n div 2"), ~F.col("stable")
    return s.groupBy("label", "layer").agg(F.count("*").alias("checked"), F.count_if(off).alias("unstable"), F.count_if(off & (F.col("conf") >= 0.45)).alias("demoted"), F.coalesce(F.bool_or(F.when(here, off)), F.lit(False)).alias("station_inconsistent"), F.max(F.when(here, F.col("k"))).alias("withheld"), F.max(F.when(here, F.col("ak"))).alias("independent"), F.max(F.when(off, F.abs(F.col("k") - F.col("ak")))).alias("farthest"))


@register(
    "regime_guides",
    f"""WITH {SQL_CANDIDATES}, u AS (SELECT * FROM seed WHERE label % 3 <> 0 OR i > 0), r AS (SELECT t.label, t.i, (SELECT max(u.i) FROM u WHERE u.label = t.label AND u.i <= t.i) AS li, (SELECT min(u.i) FROM u WHERE u.label = t.label AND u.i >= t.i) AS ri FROM trace t), j AS (SELECT r.*, a.s AS l, b.s AS h, r.i = li OR r.i = ri AS own, li IS NULL OR ri IS NULL AS beyond FROM r LEFT JOIN u a ON a.label = r.label AND a.i = li LEFT JOIN u b ON b.label = r.label AND b.i = ri),
    g AS (SELECT *, coalesce(own, false) AS at_seed, NOT beyond AND NOT coalesce(own, false) AND abs(h - l) > 7 AS unknown, (i - li)::DOUBLE / nullif(ri - li, 0) AS part FROM j), v AS (SELECT *, CASE WHEN at_seed THEN coalesce(CASE WHEN li = i THEN l END, h) WHEN beyond THEN coalesce(l, h) ELSE l + (h - l) * part END AS line FROM g)
    SELECT label, i, round(CASE WHEN NOT coalesce(unknown, false) THEN line END, 6) AS guide, round(CASE WHEN at_seed THEN 2.0 WHEN beyond THEN 2 + 0.1 * coalesce(i - li, ri - i) ELSE 2 + 0.04 * least(i - li, ri - i) + CASE WHEN unknown THEN 0 ELSE 0.5 * abs(h - l) * 4 * part * (1 - part) END END, 6) AS uncertainty, beyond AND NOT at_seed AS extrapolated, coalesce(unknown, false) AS ambiguous, round(CASE WHEN unknown THEN least(l, h) ELSE line END, 6) AS lower, round(CASE WHEN unknown THEN greatest(l, h) ELSE line END, 6) AS upper FROM v""",
)
def regime_guides(spark, d):
    """The guide of every row between seeds, unknown where they lie in different regimes."""
    u = seeds(candidates(spark, d)).filter("label % 3 <> 0 or i > 0").groupBy("label").agg(F.sort_array(F.collect_list(F.struct("i", "s"))).alias("u"))
    rows = traces(spark, d).select("label", "i").join(u, "label")
    left = F.try_element_at(F.filter("u", lambda x: x["i"] <= F.col("i")), F.lit(-1))
    right = F.get(F.filter("u", lambda x: x["i"] >= F.col("i")), F.lit(0))
    r = rows.select("label", "i", left["i"].alias("li"), left["s"].cast("double").alias("l"), right["i"].alias("ri"), right["s"].cast("double").alias("h"))
    g = reports.guide(F.col("i"), F.col("li"), F.col("l"), F.col("ri"), F.col("h"))
    return r.select("label", "i", F.round(g["guide"], 6).alias("guide"), F.round(g["uncertainty"], 6).alias("uncertainty"), g["extrapolated"].alias("extrapolated"), F.coalesce(g["ambiguous"], F.lit(False)).alias("ambiguous"), F.round(g["lower"], 6).alias("lower"), F.round(g["upper"], 6).alias("upper"))


@register(
    "active_requests",
    f"""WITH {SQL_RUN}, w AS (SELECT label, layer, 'ab' AS pair, i, n, k AS a, ak AS b, conf FROM run UNION ALL SELECT label, layer, 'ar', i, n, k, rk, conf FROM run UNION ALL SELECT label, layer, 'br', i, n, ak, rk, conf FROM run),
    f AS (SELECT *, abs(a - b) > 2 AS apart, count(*) FILTER (WHERE abs(a - b) > 2) OVER (PARTITION BY label, layer, pair) * {STEP} AS disputed, least(i, n - 1 - i, abs(i - n // 2)) AS away FROM w WHERE a IS NOT NULL AND b IS NOT NULL), s AS (SELECT label, layer, i, any_value(away) AS away, sum(CASE WHEN apart AND away > 0 THEN disputed * sqrt(conf) ELSE 0 END) AS score FROM f GROUP BY 1, 2, 3), v AS (SELECT *, round(score * least(1.0, away * {STEP}), 6) AS priority FROM s)
    SELECT label, layer, arg_min(i, (-priority, i)) AS i, max(priority) AS priority FROM v WHERE away > 0 GROUP BY 1, 2""",
)
def active_requests(spark, d):
    """The row whose answer would separate competing routes over the longest disputed stretch, tapered beside known rows."""
    r = run(spark, d)
    pair = lambda name, a, b: F.struct(F.lit(name).alias("pair"), F.col(a).alias("a"), F.col(b).alias("b"))
    w = r.select("label", "layer", "i", "n", "conf", F.inline(F.array(pair("ab", "k", "ak"), pair("ar", "k", "rk"), pair("br", "ak", "rk")))).filter("a is not null and b is not null")
    half = F.expr("n div 2")
    apart = F.abs(F.col("a") - F.col("b")) > 2
    totals = w.groupBy("label", "layer", "pair").agg((F.count_if(apart) * STEP).alias("disputed"))
    f = w.join(totals, ["label", "layer", "pair"]).withColumn("away", F.least(F.col("i"), F.col("n") - 1 - F.col("i"), F.abs(F.col("i") - half)))
    s = f.groupBy("label", "layer", "i", "away").agg(F.sum(F.when(apart & (F.col("away") > 0), F.col("disputed") * F.sqrt("conf")).otherwise(0.0)).alias("score")).filter("away > 0")
    v = s.withColumn("priority", F.round(F.col("score") * F.least(F.lit(1.0), F.col("away") * STEP), 6))
    return v.groupBy("label", "layer").agg(F.min(F.struct((-F.col("priority")).alias("o"), "i")).alias("m")).select("label", "layer", F.col("m.i").alias("i"), (-F.col("m.o")).alias("priority"))


@register(
    "candidate_events",
    f"""WITH {SQL_RUN}, r AS (SELECT *, row_number() OVER (PARTITION BY label, layer, i ORDER BY score DESC, k) AS rank FROM lay WHERE layer IS NOT NULL), e AS (SELECT *, 'L' || layer || ':R' || i || ':C' || k AS event_id, k // 8 AS family FROM r)
    SELECT e.label, e.layer, e.i, e.k, e.rank, e.event_id, CASE WHEN e.pole < 0 THEN 'negative_trough' WHEN e.pole > 0 THEN 'positive_peak' ELSE 'zero' END AS lobe, count(o.k) FILTER (WHERE abs(o.k - e.k) <= 14) AS competing, arg_min(o.event_id, o.rank) FILTER (WHERE o.family <> e.family) AS rival FROM e LEFT JOIN e o ON o.label = e.label AND o.layer = e.layer AND o.i = e.i AND o.k <> e.k GROUP BY ALL""",
)
def candidate_events(spark, d):
    """Every candidate of a row as an event: rank, identity, lobe, competitors within two pulses, and the best event of another family."""
    w = Window.partitionBy("label", "layer", "i")
    r = layered(spark, d).withColumn("rank", F.row_number().over(w.orderBy(F.desc("score"), "k")))
    e = r.withColumn("event_id", F.format_string("L%d:R%d:C%d", "layer", "i", "k")).withColumn("family", F.expr("k div 8"))
    # A row has a few candidates: they meet in an array, not in a join.
    row = e.withColumn("all", F.collect_list(F.struct("rank", "event_id", "family", "k")).over(w))
    others = F.filter("all", lambda o: o["k"] != F.col("k"))
    rival = F.array_min(F.filter(others, lambda o: o["family"] != F.col("family")))["event_id"]
    lobe = F.when(F.col("pole") < 0, "negative_trough").when(F.col("pole") > 0, "positive_peak").otherwise("zero")
    return row.select("label", "layer", "i", "k", "rank", "event_id", lobe.alias("lobe"), F.size(F.filter(others, lambda o: F.abs(o["k"] - F.col("k")) <= 14)).cast("long").alias("competing"), rival.alias("rival"))


@register(
    "training_threshold",
    f"""{SQL_SCORED}, t AS (SELECT unnest(range(0, 101)) / 100.0::DOUBLE AS threshold), c AS (SELECT layer, road, threshold, count(*)::DOUBLE AS n, count(*) FILTER (WHERE score >= threshold) AS accepted, count(*) FILTER (WHERE score >= threshold AND correct) AS correct FROM s, t WHERE road < 5 AND NOT supplied GROUP BY 1, 2, 3),
    p AS (SELECT layer, threshold, sum(accepted)::BIGINT AS accepted, sum(correct)::BIGINT AS correct, round(avg(correct / n), 9) AS macro, bool_and(accepted >= 20 AND correct >= 0.55 * accepted) AS meets FROM c GROUP BY 1, 2), b AS (SELECT layer, arg_min(threshold, (-macro, threshold)) FILTER (WHERE meets) AS threshold FROM p GROUP BY 1) SELECT b.layer, b.threshold, p.accepted, round(p.correct / p.accepted, 6) AS agreement, round(p.macro, 6) AS macro, b.threshold IS NOT NULL AS met FROM b LEFT JOIN p ON p.layer = b.layer AND p.threshold = b.threshold""",
)
def training_threshold(spark, d):
    """The threshold with the widest mean coverage at which every training road alone reaches the agreement; roads held out are never looked at."""
    inner = scored(spark, d).filter("road < 5 and not supplied").withColumn("threshold", F.explode(F.array(*[F.lit(k / 100) for k in range(101)])))
    take = F.col("score") >= F.col("threshold")
    c = inner.groupBy("layer", "road", "threshold").agg(F.count("*").alias("n"), F.count_if(take).alias("accepted"), F.count_if(take & F.col("correct")).alias("correct"))
    p = c.groupBy("layer", "threshold").agg(F.sum("accepted").alias("accepted"), F.sum("correct").alias("correct"), F.round(F.avg(F.col("correct") / F.col("n")), 9).alias("macro"), F.bool_and((F.col("accepted") >= 20) & (F.col("correct") >= 0.55 * F.col("accepted"))).alias("meets"))
    b = p.groupBy("layer").agg(F.min(F.when(F.col("meets"), F.struct((-F.col("macro")).alias("o"), "threshold", "accepted", "correct"))).alias("b"))
    return b.select("layer", F.col("b.threshold").alias("threshold"), F.col("b.accepted").alias("accepted"), F.round(F.try_divide("b.correct", "b.accepted"), 6).alias("agreement"), F.round(-F.col("b.o"), 6).alias("macro"), F.col("b").isNotNull().alias("met"))


#: Numbers of the lobes of each trace: they change with the sign.
SQL_LOBES = "lob AS (SELECT vec_id, k, sum(c) OVER (PARTITION BY vec_id ORDER BY k) AS lobe FROM (SELECT vec_id, k, CASE WHEN sign(v) IS DISTINCT FROM lag(sign(v)) OVER (PARTITION BY vec_id ORDER BY k) OR v = 0 THEN 1 ELSE 0 END AS c FROM cell))"


def lobes(spark, d):
    w = Window.partitionBy("vec_id").orderBy("k")
    sign = F.signum("v")
    new = ~sign.eqNullSafe(F.lag(sign).over(w)) | (F.col("v") == 0)
    return cells(spark, d).withColumn("c", new.cast("int")).select("vec_id", "k", F.sum("c").over(w).alias("lobe"))


SQL_OBSERVED = f"{SQL_RUN}, {SQL_LOBES}, obs AS (SELECT r.label, r.layer, r.i, r.n, r.i % 10 = 3 AS manual, r.conf >= 0.35 AND r.i % 10 <> 3 AS accepted, abs(r.k - r.rk) <= 4 AND x.lobe = y.lobe AS correct, CASE WHEN r.i < 5 THEN 'left_tail' WHEN r.i > r.n - 6 THEN 'right_tail' ELSE 'bracketed' END AS segment, least(abs(r.i - 5), abs(r.i - r.n // 2), abs(r.i - (r.n - 6))) AS away FROM run r JOIN trace t ON t.label = r.label AND t.i = r.i JOIN lob x ON x.vec_id = t.vec_id AND x.k = r.k JOIN lob y ON y.vec_id = t.vec_id AND y.k = r.rk WHERE r.i NOT IN (5, r.n // 2, r.n - 6))"


def observed(spark, d):
    """Reviewed rows without those of the three seeds: accepted, correct (within four samples and on the same lobe), manual answers."""
    half, last = F.expr("n div 2"), F.col("n") - 6
    r = run(spark, d).filter((F.col("i") != 5) & (F.col("i") != half) & (F.col("i") != last)).join(traces(spark, d).select("vec_id", "label", "i"), ["label", "i"])
    of = lobes(spark, d)
    j = r.join(of.withColumnRenamed("lobe", "x"), ["vec_id", "k"]).join(of.select("vec_id", F.col("k").alias("rk"), F.col("lobe").alias("y")), ["vec_id", "rk"])
    manual = F.col("i") % 10 == 3
    return j.select("label", "layer", F.col("i").alias("row"), manual.alias("manual"), ((F.col("conf") >= 0.35) & ~manual).alias("accepted"), ((F.abs(F.col("k") - F.col("rk")) <= 4) & (F.col("x") == F.col("y"))).alias("correct"), reports.cohort_segment(F.col("i"), F.lit(5), last).alias("segment"), F.least(F.abs(F.col("i") - 5), F.abs(F.col("i") - half), F.abs(F.col("i") - last)).alias("away"))


def _sql_summary(keys: str, where: str = "true") -> str:
    join = " AND ".join(f"g.{k} = c.{k}" for k in keys.split(", "))
    return f"w AS (SELECT {keys}, i - row_number() OVER (PARTITION BY {keys} ORDER BY i) AS grp FROM obs WHERE accepted AND NOT correct AND {where}), g AS (SELECT {keys}, max(n) * {STEP}::DOUBLE AS longest FROM (SELECT {keys}, grp, count(*) AS n FROM w GROUP BY ALL) GROUP BY ALL), c AS (SELECT {keys}, count(*) AS n, count(*) FILTER (WHERE accepted) AS accepted, count(*) FILTER (WHERE accepted AND correct) AS correct, count(*) FILTER (WHERE accepted AND NOT correct) AS wrong, count(*) FILTER (WHERE manual) AS manual FROM obs WHERE {where} GROUP BY ALL) SELECT {', '.join('c.' + k for k in keys.split(', '))}, n, accepted, correct, wrong, manual, n - accepted AS unresolved, round(correct / nullif(accepted, 0), 6) AS agreement, round(correct / n, 6) AS coverage, round(coalesce(longest, 0::DOUBLE), 6) AS longest_wrong_m FROM c LEFT JOIN g ON {join}"


def _rounded(df):
    return df.withColumn("agreement", F.round("agreement", 6)).withColumn("coverage", F.round("coverage", 6)).withColumn("longest_wrong_m", F.round("longest_wrong_m", 6))


@register("native_evaluation", f"WITH {SQL_OBSERVED}, {_sql_summary('label, layer, segment')}")
def native_evaluation(spark, d):
    """Agreement of each road and layer between the seeds and in the tails; supplied answers stay in the cohort without credit."""
    return _rounded(reports.summarised(observed(spark, d), ["label", "layer", "segment"], STEP))


@register("evaluation_by_distance", f"WITH {SQL_OBSERVED}, b AS (SELECT *, CASE WHEN away * {STEP} < 5 THEN 0 WHEN away * {STEP} < 25 THEN 1 WHEN away * {STEP} < 100 THEN 2 ELSE 3 END AS bin FROM obs) SELECT layer, bin, count(*) AS n, count(*) FILTER (WHERE accepted) AS accepted, count(*) FILTER (WHERE accepted AND correct) AS correct, round(count(*) FILTER (WHERE accepted AND correct) / count(*), 6) AS coverage FROM b GROUP BY 1, 2")
def evaluation_by_distance(spark, d):
    """The same by the way to the nearest seed."""
    far = F.col("away") * STEP
    bin_ = F.when(far < 5, 0).when(far < 25, 1).when(far < 100, 2).otherwise(3)
    right = F.count_if(F.col("accepted") & F.col("correct"))
    return observed(spark, d).groupBy("layer", bin_.alias("bin")).agg(F.count("*").alias("n"), F.count_if("accepted").alias("accepted"), right.alias("correct"), F.round(right / F.count("*"), 6).alias("coverage"))


@register("fixed_cohort_replay", f"WITH {SQL_OBSERVED}, {_sql_summary('layer, label')}")
def fixed_cohort_replay(spark, d):
    """The initial cohort of each road scored after answers: its size never shrinks, answered rows earn nothing."""
    return _rounded(reports.summarised(observed(spark, d), ["layer", "label"], STEP))


@register(
    "evidence_stages",
    f"""WITH {SQL_PROBABILITY}, trace AS{SQL_CANDIDATES.partition('trace AS')[2]}, m AS (SELECT p.vec_id, arg_min(k, (-round(p, 12), k)) AS pick, max(p) AS conf FROM p GROUP BY 1), f AS (SELECT vec_id, arg_min(k, (-score, k)) AS ref FROM cand GROUP BY 1), o AS (SELECT t.label, t.i, t.n, m.pick, m.conf, f.ref FROM trace t JOIN m ON m.vec_id = t.vec_id JOIN f ON f.vec_id = t.vec_id), s AS (SELECT label, max(ref) FILTER (WHERE i = 0) AS a, max(ref) FILTER (WHERE i = n - 1) AS b FROM o GROUP BY 1),
    x AS (SELECT o.*, a + (b - a) * i::DOUBLE / greatest(n - 1, 1) AS line FROM o JOIN s ON s.label = o.label WHERE i NOT IN (0, n - 1)), y AS (SELECT 'direct_evidence' AS stage, label, true AS accepted, abs(pick - ref) <= 3 AS correct FROM x UNION ALL SELECT 'direct_evidence_gated', label, conf >= 0.06, abs(pick - ref) <= 3 FROM x UNION ALL SELECT 'seed_interpolation', label, true, abs(line - ref) <= 3 FROM x)
    SELECT stage, label, count(*) AS n, count(*) FILTER (WHERE accepted) AS accepted, count(*) FILTER (WHERE accepted AND correct) AS correct FROM y GROUP BY 1, 2""",
)
def evidence_stages(spark, d):
    """The likeliest depth, the same above an operating threshold, and the control without radar, all on one cohort."""
    p = probabilities(spark, d).groupBy("vec_id").agg(F.min(F.struct((-F.round("p", 12)).alias("o"), "k")).alias("m"), F.max("p").alias("conf"))
    ref = candidates(spark, d).groupBy("vec_id").agg(F.min(F.struct((-F.col("score")).alias("o"), "k")).alias("r"))
    o = traces(spark, d).join(p, "vec_id").join(ref, "vec_id").select("label", "i", "n", F.col("m.k").alias("pick"), "conf", F.col("r.k").alias("ref"))
    ends = o.groupBy("label").agg(F.max(F.when(F.col("i") == 0, F.col("ref"))).alias("a"), F.max(F.when(F.col("i") == F.col("n") - 1, F.col("ref"))).alias("b"))
    x = o.filter("i > 0 and i < n - 1").join(ends, "label").withColumn("line", F.col("a") + (F.col("b") - F.col("a")) * F.col("i") / F.greatest(F.col("n") - 1, F.lit(1)))
    right, lined = F.abs(F.col("pick") - F.col("ref")) <= 3, F.abs(F.col("line") - F.col("ref")) <= 3
    stage = lambda name, accepted, correct: F.struct(F.lit(name).alias("stage"), accepted.alias("accepted"), correct.alias("correct"))
    y = x.select("label", F.inline(F.array(stage("direct_evidence", F.lit(True), right), stage("direct_evidence_gated", F.col("conf") >= 0.06, right), stage("seed_interpolation", F.lit(True), lined))))
    return y.groupBy("stage", "label").agg(F.count("*").alias("n"), F.count_if("accepted").alias("accepted"), F.count_if(F.col("accepted") & F.col("correct")).alias("correct"))


@register("dense_decoding")
def dense_decoding(spark, d):
    """Depth probabilities decoded through exact seeds with gaps. A test compares the decoder with enumeration."""
    rows = probabilities(spark, d).groupBy("vec_id", "label").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "p"))), lambda x: x["p"]).alias("p"))

    def solve(road):
        p = matrix(road["p"])
        known = {0: float(p[0].argmax()), len(p) - 1: float(p[-1].argmax())}
        path, gap = dense_path(p, known, 0.06, 0.05, 0.02, 1.0)
        return [{"row": r, "sample": float(path[r]), "gap": bool(gap[r]), "confidence": float(p[r, int(round(path[r]))]) if path[r] >= 0 else 0.0} for r in range(len(p))]

    return by_road(rows, ["label"], "vec_id", solve, "label int, row int, sample double, gap boolean, confidence double")


@register(
    "dataset_audit",
    """WITH f AS (SELECT c_custkey AS survey, sha256(CAST(c_custkey % 900 AS VARCHAR)) AS sha, c_nationkey AS road_group FROM customer), r AS (SELECT sha, arg_min(survey, survey) AS survey, arg_min(road_group, survey) AS road_group, count(*) - 1 AS aliases FROM f GROUP BY 1), s AS (SELECT *, CASE WHEN road_group % 5 = 0 THEN 'test' WHEN road_group % 5 = 1 THEN 'validation' ELSE 'train' END AS split FROM r),
    l AS (SELECT o_orderkey, CAST(o_orderkey % 3 + 1 AS INTEGER) AS layer, sha256(CAST(o_custkey % 900 AS VARCHAR)) AS sha, o_orderstatus <> 'P' AS verified, o_totalprice >= 2000 AS on_grid FROM orders), j AS (SELECT l.*, s.split, s.road_group, CASE WHEN s.sha IS NULL THEN 'unknown_source' WHEN NOT verified THEN 'unverified' WHEN NOT on_grid THEN 'off_grid' END AS reason FROM l LEFT JOIN s ON s.sha = l.sha),
    g AS (SELECT layer, count(*) FILTER (WHERE reason IS NULL AND split = 'train') AS train, count(*) FILTER (WHERE reason IS NULL AND split = 'validation') AS validation, count(*) FILTER (WHERE reason IS NULL AND split = 'test') AS test, count(*) FILTER (WHERE reason IS NOT NULL) AS excluded, count(DISTINCT road_group) FILTER (WHERE reason IS NULL AND split = 'train') AS train_groups FROM j GROUP BY 1) SELECT *, (SELECT count(*) FROM s) AS sources, (SELECT CAST(sum(aliases) AS BIGINT) FROM s) AS aliases, train_groups >= 3 AND validation > 0 AND train >= 96 AS eligible FROM g""",
)
def dataset_audit(spark, d):
    """Sources without copies, splits of their groups, labels with the reasons why some are left out, and the layers that can be trained."""
    sha = lambda c: F.sha2((F.col(c) % 900).cast("string"), 256)
    files = read(spark, d, "customer").select(F.col("c_custkey").alias("survey"), sha("c_custkey").alias("sha"), F.col("c_nationkey").alias("road_group"))
    s = files.groupBy("sha").agg(F.min(F.struct("survey", "road_group")).alias("f"), (F.count("*") - 1).alias("aliases")).select("sha", "f.road_group", "aliases")
    s = s.withColumn("split", F.when(F.col("road_group") % 5 == 0, "test").when(F.col("road_group") % 5 == 1, "validation").otherwise("train"))
    labels = read(spark, d, "orders").select((F.col("o_orderkey") % 3 + 1).cast("int").alias("layer"), sha("o_custkey").alias("sha"), (F.col("o_orderstatus") != "P").alias("verified"), (F.col("o_totalprice") >= 2000).alias("on_grid"))
    j = labels.join(s.withColumn("known", F.lit(True)), "sha", "left").withColumn("reason", F.when(F.col("known").isNull(), "unknown_source").when(~F.col("verified"), "unverified").when(~F.col("on_grid"), "off_grid"))
    fine = F.col("reason").isNull()
    of = lambda split: F.count_if(fine & (F.col("split") == split))
    g = j.groupBy("layer").agg(of("train").alias("train"), of("validation").alias("validation"), of("test").alias("test"), F.count_if(~fine).alias("excluded"), F.countDistinct(F.when(fine & (F.col("split") == "train"), F.col("road_group"))).alias("train_groups"))
    totals = s.agg(F.count("*").alias("sources"), F.sum("aliases").alias("aliases"))
    return g.join(F.broadcast(totals)).withColumn("eligible", (F.col("train_groups") >= 3) & (F.col("validation") > 0) & (F.col("train") >= 96))


@register(
    "review_decisions",
    f"""WITH {SQL_EVENTS}, p AS (SELECT event_id, user_id, sec // 21600 AS issue, value, CASE WHEN event_id % 9 = 4 THEN NULL ELSE value + 1 END AS proposal FROM ev WHERE event_type IN ('view', 'click')), a AS (SELECT user_id, sec // 21600 AS issue, arg_max(CASE event_type WHEN 'signup' THEN 'accept' WHEN 'purchase' THEN 'absent' ELSE 'anomaly' END, (sec, event_id)) AS action FROM ev WHERE event_type NOT IN ('view', 'click') GROUP BY 1, 2)
    SELECT event_id, action, round(CASE WHEN action IS NULL THEN value WHEN action = 'accept' THEN coalesce(proposal, value) ELSE -1 END, 6) AS sample, CASE WHEN action IS NULL THEN 'review' WHEN action = 'accept' AND proposal IS NULL THEN 'review' ELSE 'accepted' END AS status, CASE action WHEN 'absent' THEN 'absent' WHEN 'anomaly' THEN 'not_visible' ELSE 'visible' END AS visibility FROM p LEFT JOIN a ON a.user_id = p.user_id AND a.issue = p.issue""",
)
def review_decisions(spark, d):
    """Each issue's last decision applied to its picks: an acceptance takes the frozen proposal and leaves picks without one open, the others take the pick away."""
    e = events(spark, d).withColumn("issue", F.expr("sec div 21600"))
    picks = e.filter("event_type in ('view', 'click')").select("event_id", "user_id", "issue", "value", F.when(F.col("event_id") % 9 != 4, F.col("value") + 1).alias("proposal"))
    action = F.when(F.col("event_type") == "signup", "accept").when(F.col("event_type") == "purchase", "absent").otherwise("anomaly")
    decided = e.filter("event_type not in ('view', 'click')").groupBy("user_id", "issue").agg(F.max_by(action, F.struct("sec", "event_id")).alias("action"))
    j = picks.join(decided, ["user_id", "issue"], "left")
    a = F.col("action")
    sample = F.when(a.isNull(), F.col("value")).when(a == "accept", F.coalesce("proposal", "value")).otherwise(-1.0)
    status = F.when(a.isNull() | ((a == "accept") & F.col("proposal").isNull()), "review").otherwise("accepted")
    return j.select("event_id", "action", F.round(sample, 6).alias("sample"), status.alias("status"), F.when(a == "absent", "absent").when(a == "anomaly", "not_visible").otherwise("visible").alias("visibility"))


@register(
    "seed_span_penalties",
    f"WITH {SQL_CANDIDATES} SELECT vec_id, k, round(CASE WHEN k < least(ls, rs) THEN least(ls, rs) - k WHEN k > greatest(ls, rs) THEN k - greatest(ls, rs) ELSE 0 END / 7.0, 6) AS outside FROM near",
)
def seed_span_penalties(spark, d):
    """How many pulses a candidate lies outside the span of the seeds beside it."""
    low, high = F.least("ls", "rs"), F.greatest("ls", "rs")
    return beside(spark, d).select("vec_id", "k", F.round(F.when(F.col("k") < low, low - F.col("k")).when(F.col("k") > high, F.col("k") - high).otherwise(0) / 7.0, 6).alias("outside"))

