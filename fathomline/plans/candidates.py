"""Candidate picks of a road's traces: scores, emissions, steps, conflicts. Embeddings stand for traces, labels for roads."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import identity, selection
from .registry import register
from .tables import read
from .windows import SQL_CELLS, cells

PULSE = 7.0
#: Numbered traces of a road with the road's length, candidates (peaks of the modulus), and seeds: the strongest sample of the first, middle and last trace.
SQL_CANDIDATES = f"""{SQL_CELLS}, trace AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS i, count(*) OVER (PARTITION BY label) AS n FROM embeddings),
    side AS (SELECT c.*, lag(abs(v)) OVER w AS b, lead(abs(v)) OVER w AS a FROM cell c WINDOW w AS (PARTITION BY vec_id ORDER BY k)),
    cand AS (SELECT s.label, s.vec_id, t.i, t.n, s.k, s.v, CAST(sign(s.v) AS INTEGER) AS pole, least(abs(s.v) * 3, 1.0) AS score FROM side s JOIN trace t ON t.vec_id = s.vec_id WHERE abs(v) > b AND abs(v) >= a),
    seed AS (SELECT label, i, arg_min(k, (-score, k)) AS s, arg_min(pole, (-score, k)) AS pole FROM cand WHERE i IN (0, n // 2, n - 1) GROUP BY 1, 2),
    near AS (SELECT c.*, coalesce((SELECT arg_max(s, i) FROM seed WHERE seed.label = c.label AND seed.i <= c.i), 0) AS ls, coalesce((SELECT arg_min(s, i) FROM seed WHERE seed.label = c.label AND seed.i >= c.i), 0) AS rs, (SELECT arg_max(pole, i) FROM seed WHERE seed.label = c.label AND seed.i <= c.i) AS lp, (SELECT arg_min(pole, i) FROM seed WHERE seed.label = c.label AND seed.i >= c.i) AS rp, (SELECT count(*) FROM seed WHERE seed.label = c.label AND seed.i = c.i) > 0 AS anchored FROM cand c)"""


def traces(spark, d):
    """(vec_id, label, i, n): traces numbered along their road, and the road's length."""
    ids = read(spark, d, "embeddings").select("vec_id", "label")
    return selection.numbered(ids, ["label"], "vec_id", "i").join(ids.groupBy("label").agg(F.count("*").alias("n")), "label")


def candidates(spark, d):
    """(label, vec_id, i, n, k, v, pole, score): peaks of the modulus inside each trace."""
    w = Window.partitionBy("vec_id").orderBy("k")
    side = cells(spark, d).withColumn("b", F.lag(F.abs("v")).over(w)).withColumn("a", F.lead(F.abs("v")).over(w)).filter("abs(v) > b and abs(v) >= a").drop("a", "b", "label")
    return side.join(traces(spark, d), "vec_id").select("label", "vec_id", "i", "n", "k", "v", F.signum("v").cast("int").alias("pole"), F.least(F.abs("v") * 3, F.lit(1.0)).alias("score"))


def seeds(cand):
    """(label, i, s, pole): three seeds a road."""
    at = cand.filter("i in (0, n div 2, n - 1)")
    return at.groupBy("label", "i").agg(F.min(F.struct((-F.col("score")).alias("o"), "k", "pole")).alias("m")).select("label", "i", F.col("m.k").alias("s"), F.col("m.pole").alias("pole"))


def beside(spark, d):
    """Candidates with the seeds at or before and at or after them: ls, rs, lp, rp, anchored. Three seeds a road travel as an array."""
    cand = candidates(spark, d)
    known = seeds(cand).groupBy("label").agg(F.sort_array(F.collect_list(F.struct("i", "s", "pole"))).alias("seeds"))
    rows = cand.join(known, "label")
    left = F.try_element_at(F.filter("seeds", lambda x: x["i"] <= F.col("i")), F.lit(-1))
    right = F.get(F.filter("seeds", lambda x: x["i"] >= F.col("i")), F.lit(0))
    return rows.select(*cand.columns, left["s"].alias("ls"), right["s"].alias("rs"), left["pole"].alias("lp"), right["pole"].alias("rp"), F.exists("seeds", lambda x: x["i"] == F.col("i")).alias("anchored"))


@register("lobe_codes", f"WITH {SQL_CELLS} SELECT vec_id, k, CASE WHEN v < 0 THEN 1 WHEN v > 0 THEN 2 ELSE 3 END AS code FROM cell")
def lobe_codes(spark, d):
    return cells(spark, d).select("vec_id", "k", identity.lobe_code(F.col("v")).alias("code"))


@register(
    "seed_lobe_support",
    f"WITH {SQL_CELLS} SELECT vec_id, k, max(abs(v)) OVER w > 0 AND abs(v) >= 0.25 * max(abs(v)) OVER w AS supported FROM cell WINDOW w AS (PARTITION BY vec_id ORDER BY k ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)",
)
def seed_lobe_support(spark, d):
    """Whether a click at each sample would stand on a lobe that can be followed."""
    rows = read(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    each = rows.select("vec_id", "x", F.explode(F.sequence(F.lit(0), F.size("x") - 1)).alias("k"))
    return each.select("vec_id", "k", identity.lobe_supported(F.col("x"), F.col("k"), PULSE).alias("supported"))


_FEATURES = "list_transform(embedding[1:17], lambda x: least(abs(CAST(x AS DOUBLE)) * 4, 1.0))"
_sum = lambda weights: " + ".join(f"{w} * f[{k + 1}]" for k, w in (weights.items() if isinstance(weights, dict) else enumerate(weights)) if w)


@register(
    "radar_scores",
    f"""WITH t AS (SELECT vec_id, label % 3 + 1 AS layer, vec_id % 2 = 0 AS seeded, {_FEATURES} AS f FROM embeddings), s AS (SELECT *, {_sum(identity.DETECTION)} AS d, {_sum(identity.IDENTITY)} AS e, {_sum(identity.SEEDED)} AS p, {_sum(identity.UNSEEDED)} AS q FROM t)
    SELECT vec_id, layer, seeded, round(CASE WHEN seeded AND layer >= 2 THEN sqrt(least(greatest(d, 0), 1) * least(greatest(e, 0), 1)) WHEN seeded THEN least(greatest(p, 0), 1) ELSE least(greatest(q, 0), 1) END, 6) AS score FROM s""",
)
def radar_scores(spark, d):
    """Seventeen features of a candidate to one score."""
    f = F.transform(F.slice(F.col("embedding").cast("array<double>"), 1, 17), lambda v: F.least(F.abs(v) * 4, F.lit(1.0)))
    rows = read(spark, d, "embeddings").select("vec_id", (F.col("label") % 3 + 1).alias("layer"), (F.col("vec_id") % 2 == 0).alias("seeded"), f.alias("f"))
    return rows.select("vec_id", "layer", "seeded", F.round(identity.radar_score(F.col("f"), F.col("layer"), F.col("seeded")), 6).alias("score"))


@register(
    "event_emissions",
    f"""WITH {SQL_CANDIDATES}, e AS (SELECT *, label % 2 + 1 AS layer, 0.35 * least(greatest(greatest(least(ls, rs) - {2 * PULSE} - k, k - greatest(ls, rs) - {2 * PULSE}) / {PULSE}, 0), 1) AS penalty, lp = rp AND pole <> lp AS foreign_lobe, k % 3 <> 0 AS reachable, abs(k - ls) = min(abs(k - ls)) OVER (PARTITION BY vec_id) AS closest FROM near)
    SELECT vec_id, k, round(CASE WHEN anchored THEN CASE WHEN k = min(k) FILTER (WHERE closest) OVER (PARTITION BY vec_id) THEN 100.0 END WHEN foreign_lobe THEN NULL ELSE 1.55 * (0.95 * score + 0.05 * (1 - k / 64::DOUBLE)) - 0.75 + 0.25 * (i % 4) / 4::DOUBLE - CASE WHEN layer >= 2 THEN penalty + CASE WHEN reachable THEN 0 ELSE 0.18 END ELSE 0 END END, 6) AS emission FROM e""",
)
def event_emissions(spark, d):
    """The value of each candidate; null where it cannot be chosen: another lobe than two equal seeds', or beside a seed's own."""
    rows = beside(spark, d).withColumn("layer", F.col("label") % 2 + 1)
    value = identity.emission(F.col("score"), 1 - F.col("k") / 64, (F.col("i") % 4) / 4, F.col("k") % 3 != 0, -identity.envelope_penalty(F.col("k"), F.col("ls"), F.col("rs"), PULSE), F.col("layer"))
    own = F.min(F.struct(F.abs(F.col("k") - F.col("ls")), "k")).over(Window.partitionBy("vec_id"))["k"] == F.col("k")
    made = F.when(F.col("anchored"), F.when(own, 100.0)).when((F.col("lp") == F.col("rp")) & (F.col("pole") != F.col("lp")), None).otherwise(value)
    return rows.select("vec_id", "k", F.round(made, 6).alias("emission"))


@register(
    "candidate_step_costs",
    f"""WITH {SQL_CANDIDATES}, best AS (SELECT label, i, arg_min(k, (-score, k)) AS k, arg_min(pole, (-score, k)) AS pole, max(score) AS score FROM cand GROUP BY 1, 2), u AS (SELECT label, i, CASE WHEN score < 0.5 THEN -1 ELSE k END AS k, pole, score, CAST(k % 9 - 1 AS INTEGER) AS phase FROM best),
    s AS (SELECT label, i, k, lag(k) OVER w AS p, coalesce(lag(k, 2) OVER w, -1) AS o, pole, lag(pole) OVER w AS pp, phase, lag(phase) OVER w AS ph, i % 10 = 5 AS broken, 1 - abs(score - lag(score) OVER w) AS wave FROM u WINDOW w AS (PARTITION BY label ORDER BY i))
    SELECT label, i, round(CASE WHEN p < 0 AND k < 0 THEN 0 WHEN (p < 0) <> (k < 0) THEN CASE WHEN broken THEN 0.22 ELSE 1.1 END ELSE CASE WHEN broken THEN 0.008 ELSE 0.03 END * abs(k - p) / 0.1 + CASE WHEN o >= 0 THEN CASE WHEN broken THEN 0.002 ELSE 0.008 END * abs((k - p) / 0.1 - (p - o) / 0.1) / 0.1 ELSE 0 END + 0.12 * (1 - wave) + CASE WHEN phase >= 0 AND ph >= 0 THEN CASE WHEN broken THEN 0.035 ELSE 0.14 END * least(abs(phase - ph), 8 - abs(phase - ph)) / 4 ELSE 0 END + CASE WHEN pole <> 0 AND pp <> 0 AND pole <> pp THEN CASE WHEN broken THEN 0.025 ELSE 0.1 END ELSE 0 END END, 6) AS cost FROM s WHERE p IS NOT NULL""",
)
def candidate_step_costs(spark, d):
    """What the steps along the strongest candidates cost: slope, curvature, waveform, phase, polarity, breaks and missing picks."""
    best = candidates(spark, d).groupBy("label", "i").agg(F.min(F.struct((-F.col("score")).alias("o"), "k", "pole")).alias("m"))
    score = -F.col("m.o")
    u = best.select("label", "i", F.when(score < 0.5, -1).otherwise(F.col("m.k")).alias("k"), F.col("m.pole").alias("pole"), score.alias("score"), (F.col("m.k") % 9 - 1).cast("int").alias("phase"))
    w = Window.partitionBy("label").orderBy("i")
    back = lambda c, n=1: F.lag(c, n).over(w)
    cost = identity.step_cost(F.coalesce(back("k", 2), F.lit(-1)), back("k"), F.col("k"), 1 - F.abs(F.col("score") - back("score")), back("phase"), F.col("phase"), back("pole"), F.col("pole"), F.col("i") % 10 == 5, 0.1)
    return u.select("label", "i", F.round(F.when(back("k").isNotNull(), cost), 6).alias("cost")).filter("cost is not null")


@register(
    "joint_step_costs",
    f"""WITH {SQL_CANDIDATES}, r AS (SELECT label, i, k, pole, row_number() OVER (PARTITION BY label, i ORDER BY score DESC, k) AS rank FROM cand), p AS (SELECT label, i, least(max(k) FILTER (WHERE rank = 1), max(k) FILTER (WHERE rank = 2)) AS a, greatest(max(k) FILTER (WHERE rank = 1), max(k) FILTER (WHERE rank = 2)) AS b FROM r WHERE rank <= 2 GROUP BY 1, 2),
    s AS (SELECT label, i, a, b, lag(a) OVER w AS pa, lag(b) OVER w AS pb, i % 10 = 5 AS broken FROM p WINDOW w AS (PARTITION BY label ORDER BY i)) SELECT label, i, round(CASE WHEN broken THEN 0.008 ELSE 0.03 END * (abs(a - pa) + abs(b - pb)) / 0.1 + CASE WHEN broken THEN 0.005 ELSE 0.02 END * abs((b - a) - (pb - pa)), 6) AS cost FROM s WHERE pa IS NOT NULL AND b IS NOT NULL AND pb IS NOT NULL""",
)
def joint_step_costs(spark, d):
    """Steps of two layers together: both slopes, and the change of the gap between them."""
    top = selection.stable_top(candidates(spark, d), ["label", "i"], "score", "k", 2).groupBy("label", "i").agg(F.sort_array(F.collect_list("k")).alias("s"))
    w = Window.partitionBy("label").orderBy("i")
    u = top.select("label", "i", F.get("s", F.lit(0)).alias("a"), F.get("s", F.lit(1)).alias("b"))
    pa, pb = F.lag("a").over(w), F.lag("b").over(w)
    broken = F.col("i") % 10 == 5
    cost = F.when(broken, 0.008).otherwise(0.03) * (F.abs(F.col("a") - pa) + F.abs(F.col("b") - pb)) / 0.1 + F.when(broken, 0.005).otherwise(0.02) * F.abs(F.col("b") - F.col("a") - (pb - pa))
    return u.select("label", "i", F.round(cost, 6).alias("cost")).filter("cost is not null")


@register(
    "position_conflicts",
    f"""WITH {SQL_CANDIDATES}, c AS (SELECT *, 0.35 * least(greatest(greatest(least(ls, rs) - {2 * PULSE} - k, k - greatest(ls, rs) - {2 * PULSE}) / {PULSE}, 0), 1) AS penalty FROM near), p AS (SELECT vec_id, any_value(anchored) AS anchored, arg_min(k, (penalty - score, k)) AS chosen FROM c GROUP BY 1),
    m AS (SELECT c.vec_id, any_value(chosen) AS chosen, any_value(p.anchored) AS anchored, max(score) FILTER (WHERE k = chosen) AS own, max(score) FILTER (WHERE penalty > 0 AND abs(k - chosen) > {2 * PULSE}) AS other FROM c JOIN p ON p.vec_id = c.vec_id GROUP BY 1) SELECT vec_id, chosen, NOT anchored AND coalesce(other > greatest(own + 0.02, 1.05 * own), false) AS conflict FROM m""",
)
def position_conflicts(spark, d):
    """Where a candidate outside the seeds' envelope is clearly stronger than the chosen one inside: the position, not the radar, chose."""
    rows = beside(spark, d).withColumn("penalty", identity.envelope_penalty(F.col("k"), F.col("ls"), F.col("rs"), PULSE))
    chosen = rows.groupBy("vec_id").agg(F.min(F.struct((F.col("penalty") - F.col("score")).alias("o"), "k", "score")).alias("m")).select("vec_id", F.col("m.k").alias("chosen"), F.col("m.score").alias("own"))
    far = (F.col("penalty") > 0) & (F.abs(F.col("k") - F.col("chosen")) > 2 * PULSE)
    worst = rows.join(chosen, "vec_id").groupBy("vec_id", "chosen", "own").agg(F.first("anchored").alias("anchored"), F.max(F.when(far, F.col("score"))).alias("other"))
    return worst.select("vec_id", "chosen", (~F.col("anchored") & F.coalesce(F.col("other") > F.greatest(F.col("own") + 0.02, 1.05 * F.col("own")), F.lit(False))).alias("conflict"))


@register(
    "search_bounds",
    f"""WITH {SQL_CANDIDATES}, b AS (SELECT t.label, t.vec_id, t.i, greatest(8, s.v1 + 4) AS lo, least(63, 56) AS hi FROM trace t JOIN (SELECT label, i, min(k) AS v1 FROM cand GROUP BY 1, 2) s ON s.label = t.label AND s.i = t.i),
    a AS (SELECT b.vec_id, min(s - 2 * {PULSE} - 1.5 * abs(b.i - seed.i)) AS alo, max(s + 2 * {PULSE} + 1.5 * abs(b.i - seed.i)) AS ahi, max(CASE WHEN seed.i = b.i THEN s END) AS own FROM b JOIN seed ON seed.label = b.label AND abs(b.i - seed.i) <= 10 GROUP BY 1),
    w AS (SELECT b.vec_id, least(greatest(least(lo, coalesce(alo, lo)), 0), 63) AS lower, coalesce(own, (lo + hi) / 2) AS centre, greatest(hi, coalesce(ahi, hi)) AS upper FROM b LEFT JOIN a ON a.vec_id = b.vec_id) SELECT vec_id, round(lower::DOUBLE, 6) AS lower, round(centre::DOUBLE, 6) AS centre, round(least(greatest(upper, lower + 1), 63)::DOUBLE, 6) AS upper FROM w""",
)
def search_bounds(spark, d):
    """Rows' search ranges: the layer's offsets, below the layer above, opened by cones around seeds within ten rows."""
    cand = candidates(spark, d)
    known = seeds(cand).groupBy("label").agg(F.collect_list(F.struct("i", "s")).alias("seeds"))
    above = cand.groupBy("label", "vec_id", "i").agg(F.min("k").alias("v1")).join(known, "label")
    lo, hi = F.greatest(F.lit(8), F.col("v1") + 4).cast("double"), F.lit(56.0)
    near = F.filter("seeds", lambda x: F.abs(x["i"] - F.col("i")) <= 10)
    reach = lambda x: 2 * PULSE + 1.5 * F.abs(x["i"] - F.col("i"))
    lower = F.least(F.greatest(F.least(lo, F.coalesce(F.array_min(F.transform(near, lambda x: x["s"] - reach(x))), lo)), F.lit(0.0)), F.lit(63.0))
    upper = F.greatest(hi, F.coalesce(F.array_max(F.transform(near, lambda x: x["s"] + reach(x))), hi))
    own = F.get(F.filter("seeds", lambda x: x["i"] == F.col("i")), F.lit(0))["s"].cast("double")
    return above.select("vec_id", F.round(lower, 6).alias("lower"), F.round(F.coalesce(own, (lo + hi) / 2), 6).alias("centre"), F.round(F.least(F.greatest(upper, lower + 1), F.lit(63.0)), 6).alias("upper"))


@register(
    "prototype_conflicts",
    f"""WITH {SQL_CANDIDATES}, x AS (SELECT s.label, s.i, s.s, c.k, c.score, p.i AS other, c.score * CASE WHEN p.pole = c.pole THEN 1 ELSE 0.05 END AS support FROM seed s JOIN cand c ON c.label = s.label AND c.i = s.i JOIN seed p ON p.label = s.label AND p.i <> s.i),
    m AS (SELECT label, i, any_value(s) AS s, max(support) FILTER (WHERE k = s) AS own, max(support) FILTER (WHERE abs(k - s) >= 7) AS alt FROM x GROUP BY 1, 2) SELECT label, i, s, own < 0.12 AND coalesce(alt, own) > own + 0.28 AS conflict FROM m""",
)
def prototype_conflicts(spark, d):
    """Seeds that no other seed's prototype supports while it supports another place of the same trace."""
    cand = candidates(spark, d)
    known = seeds(cand)
    others = known.groupBy("label").agg(F.collect_list(F.struct("i", "pole")).alias("seeds"))
    at = cand.drop("n").join(known.select("label", "i", "s"), ["label", "i"]).join(others, "label")
    best = F.array_max(F.transform(F.filter("seeds", lambda x: x["i"] != F.col("i")), lambda x: F.col("score") * F.when(x["pole"] == F.col("pole"), 1.0).otherwise(0.05)))
    m = at.withColumn("support", best).groupBy("label", "i", "s").agg(F.max(F.when(F.col("k") == F.col("s"), F.col("support"))).alias("own"), F.max(F.when(F.abs(F.col("k") - F.col("s")) >= 7, F.col("support"))).alias("alt"))
    return m.select("label", "i", "s", ((F.col("own") < 0.12) & (F.coalesce("alt", "own") > F.col("own") + 0.28)).alias("conflict"))


@register(
    "family_assignments",
    f"""WITH {SQL_CANDIDATES}, f AS (SELECT c.vec_id, c.k, s.i AS family, c.score * CASE WHEN s.pole = c.pole THEN 1 ELSE 0 END - 0.01 * abs(c.k - s.s) - 0.002 * abs(c.i - s.i) AS support FROM cand c JOIN seed s ON s.label = c.label), b AS (SELECT vec_id, k, arg_min(family, (-support, family)) AS family, max(support) AS support FROM f GROUP BY 1, 2) SELECT vec_id, k, CASE WHEN support >= 0.3 THEN family ELSE -1 END AS family, round(greatest(support, 0), 6) AS support FROM b""",
)
def family_assignments(spark, d):
    """Each candidate to the seed whose prototype fits it best, to none below the threshold."""
    cand = candidates(spark, d)
    known = seeds(cand).groupBy("label").agg(F.collect_list(F.struct("i", "s", "pole")).alias("seeds"))
    # Whole numbers divided, as decimals become doubles, so that ties and the threshold fall as they do there; 0.01 * 7 as doubles is no 0.07.
    support = lambda x: F.when(x["pole"] == F.col("pole"), F.col("score")).otherwise(0.0) - F.abs(F.col("k") - x["s"]) / F.lit(100.0) - 2 * F.abs(F.col("i") - x["i"]) / F.lit(1000.0)
    fit = lambda x: F.struct((-support(x)).alias("o"), x["i"].alias("family"))
    best = cand.join(known, "label").withColumn("m", F.array_min(F.transform("seeds", fit)))
    return best.select("vec_id", "k", F.when(-F.col("m.o") >= 0.3, F.col("m.family")).otherwise(-1).alias("family"), F.round(F.greatest(-F.col("m.o"), F.lit(0.0)), 6).alias("support"))


@register(
    "matching_candidates",
    f"WITH {SQL_CANDIDATES}, r AS (SELECT vec_id, arg_min(k, (-score, k)) AS rk, arg_min(pole, (-score, k)) AS rp FROM cand GROUP BY 1) SELECT c.vec_id, c.k, abs(c.k - rk) <= 4 AND c.pole = rp AS same FROM cand c JOIN r ON r.vec_id = c.vec_id",
)
def matching_candidates(spark, d):
    """Candidates that stand for the reference pick: near it and of its lobe."""
    cand = candidates(spark, d)
    ref = F.min(F.struct((-F.col("score")).alias("o"), "k", "pole")).over(Window.partitionBy("vec_id"))
    return cand.withColumn("r", ref).select("vec_id", "k", ((F.abs(F.col("k") - F.col("r.k")) <= 4) & (F.col("pole") == F.col("r.pole"))).alias("same"))


@register(
    "seed_modes",
    f"""WITH {SQL_CANDIDATES}, m AS (SELECT label, i AS seed_row, s, pole, i >= 20 AS regime, lag(i >= 20) OVER (PARTITION BY label ORDER BY i) AS before FROM seed WHERE s >= 5 AND s + 5 < 64) SELECT m.label, seed_row, c.vec_id, c.k, round(CASE WHEN c.pole = m.pole THEN c.score ELSE 0 END, 6) AS evidence, coalesce(regime <> before, false) AS changes FROM m JOIN cand c ON c.label = m.label""",
)
def seed_modes(spark, d):
    """Evidence of every seed by itself: no maximum over seeds; a regime's first seed marks the change."""
    cand = candidates(spark, d)
    w = Window.partitionBy("label").orderBy("i")
    usable = seeds(cand).filter("s >= 5 and s + 5 < 64").withColumn("regime", F.col("i") >= 20)
    modes = usable.select("label", F.col("i").alias("seed_row"), F.col("pole").alias("sp"), F.coalesce(F.col("regime") != F.lag("regime").over(w), F.lit(False)).alias("changes"))
    return cand.join(modes, "label").select("label", "seed_row", "vec_id", "k", F.round(F.when(F.col("pole") == F.col("sp"), F.col("score")).otherwise(0.0), 6).alias("evidence"), "changes")


@register(
    "local_order_guard",
    f"""WITH {SQL_CANDIDATES}, b AS (SELECT label, i, arg_min(k, (-score, k)) AS upper, arg_min(k, (-score * (0.4 + 0.6 * (k / 63::DOUBLE)), k)) AS lower FROM cand GROUP BY 1, 2) SELECT label, i, upper, CASE WHEN i BETWEEN 5 AND 30 AND lower < upper + 4 THEN -1 ELSE lower END AS lower, i BETWEEN 5 AND 30 AND lower < upper + 4 AS withheld FROM b""",
)
def local_order_guard(spark, d):
    """A corrected interval's picks give way where they come closer to a kept neighbour than the least gap."""
    cand = candidates(spark, d).groupBy("label", "i").agg(F.min(F.struct((-F.col("score")).alias("o"), "k")).alias("u"), F.min(F.struct((-F.col("score") * (0.4 + 0.6 * (F.col("k") / 63))).alias("o"), "k")).alias("l"))
    bad = F.col("i").between(5, 30) & (F.col("l.k") < F.col("u.k") + 4)
    return cand.select("label", "i", F.col("u.k").alias("upper"), F.when(bad, -1).otherwise(F.col("l.k")).alias("lower"), bad.alias("withheld"))


@register(
    "competing_clicks",
    f"WITH {SQL_CANDIDATES}, p AS (SELECT vec_id, arg_min(k, (-score, k)) AS click FROM cand GROUP BY 1) SELECT c.vec_id, any_value(click) AS click, arg_min(c.k, (-abs(c.v), c.k)) AS competitor FROM cand c JOIN p ON p.vec_id = c.vec_id WHERE abs(c.k - click) BETWEEN 6 AND 24 GROUP BY 1",
)
def competing_clicks(spark, d):
    """The strongest other lobe 6 to 24 samples from a click, as a negative click."""
    cand = candidates(spark, d)
    click = F.min(F.struct((-F.col("score")).alias("o"), "k")).over(Window.partitionBy("vec_id"))["k"]
    far = cand.withColumn("click", click).filter(F.abs(F.col("k") - F.col("click")).between(6, 24))
    return far.groupBy("vec_id", "click").agg(F.min(F.struct((-F.abs("v")).alias("o"), "k")).alias("m")).select("vec_id", "click", F.col("m.k").alias("competitor"))


@register(
    "seed_targets",
    f"""WITH {SQL_CANDIDATES}, s AS (SELECT label, label % 3 + 1 AS layer, list(s ORDER BY i) AS samples FROM (SELECT * FROM seed WHERE label % 4 <> 0 OR i > 0) GROUP BY 1) SELECT label, layer, len(samples) AS n, CASE WHEN layer >= 2 OR len(samples) = 2 AND abs(samples[2] - samples[1]) > greatest(14, 0.1 * (samples[1] + samples[2])) THEN 3 ELSE 2 END AS needed FROM s""",
)
def seed_targets(spark, d):
    """Observations that a layer of unknown depth needs."""
    known = seeds(candidates(spark, d)).filter("label % 4 <> 0 or i > 0").groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "s"))), lambda x: x["s"]).alias("samples"))
    return known.select("label", (F.col("label") % 3 + 1).alias("layer"), F.size("samples").alias("n"), identity.seeds_needed(F.col("label") % 3 + 1, F.col("samples")).alias("needed"))
