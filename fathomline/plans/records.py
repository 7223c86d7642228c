"""Records around a run: evidence, coordinates, provenance, probabilities, answers, actions, comparisons of runs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import coordinates as co
from ..operators import identity, joins, quantiles
from .aggregates import SQL_PICKS, picks
from .candidates import SQL_CANDIDATES, candidates, seeds, traces
from .evaluation import SQL_SCORED, scored
from .registry import register
from .tables import SQL_EVENTS, events, read
from .windows import SQL_CELLS, cells

_ZEROS = sum(v == 0 for v in co.EVIDENCE.values())


@register(
    "evidence_projection",
    f"WITH {SQL_CELLS}, m AS (SELECT vec_id, max(abs(v)) AS strength, arg_min(k, (-abs(v), k)) AS top, avg(v * v) AS power FROM cell GROUP BY 1) SELECT vec_id, round(strength, 6) AS absolute_strength, CASE WHEN vec_id % 7 = 0 THEN -1.0::DOUBLE ELSE top::DOUBLE END AS graph_selected_sample, CASE WHEN vec_id % 5 = 0 THEN 0.0::DOUBLE ELSE round(strength / sqrt(power), 6) END AS local_snr, -1.0::DOUBLE AS regime_index, {len(co.EVIDENCE)} AS fields FROM m",
)
def evidence_projection(spark, d):
    """The known numbers of a pick as one struct of every evidence, defaults where a number is missing or not finite."""
    m = cells(spark, d).groupBy("vec_id").agg(F.max(F.abs("v")).alias("strength"), F.min(F.struct((-F.abs("v")).alias("o"), "k")).alias("t"), F.avg(F.col("v") * F.col("v")).alias("power"))
    snr = F.when(F.col("vec_id") % 5 == 0, F.lit(float("nan"))).otherwise(F.col("strength") / F.sqrt("power"))
    top = F.when(F.col("vec_id") % 7 == 0, F.lit(float("inf"))).otherwise(F.col("t.k").cast("double"))
    known = F.create_map(F.lit("absolute_strength"), F.col("strength"), F.lit("graph_selected_sample"), top, F.lit("local_snr"), snr)
    e = m.select("vec_id", co.evidence_of(known).alias("e"))
    size = F.size(F.map_keys(F.from_json(F.to_json("e"), "map<string,double>")))
    return e.select("vec_id", F.round("e.absolute_strength", 6).alias("absolute_strength"), "e.graph_selected_sample", F.round("e.local_snr", 6).alias("local_snr"), "e.regime_index", size.alias("fields"))


@register("visibility_states", f"WITH {SQL_EVENTS}, s AS (SELECT event_id, CASE event_type WHEN 'view' THEN 'visible' WHEN 'click' THEN 'uncertain' WHEN 'signup' THEN 'not_visible' WHEN 'purchase' THEN 'absent' ELSE event_type END AS state FROM ev) SELECT state, count(*) AS n, state IN ('visible', 'uncertain', 'not_visible', 'absent') AS known FROM s GROUP BY 1")
def visibility_states(spark, d):
    """A closed list of states; anything else is told apart, not mapped."""
    state = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in zip(("view", "click", "signup", "purchase"), co.VISIBILITY, strict=True) for x in pair]), F.col("event_type")), F.col("event_type"))
    return events(spark, d).groupBy(state.alias("state")).agg(F.count("*").alias("n")).select("state", "n", F.col("state").isin(*co.VISIBILITY).alias("known"))


@register("effective_stack", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 4 WHEN abs(c_acctbal) > 0 THEN greatest(1, CAST(ceil(0.4 / (abs(c_acctbal) / 20000)) AS BIGINT)) ELSE 1 END AS stack FROM customer")
def effective_stack(spark, d):
    asked = F.when(F.col("c_custkey") % 3 == 0, 4).otherwise(0)
    return read(spark, d, "customer").select("c_custkey", identity.stack_of(asked, F.abs("c_acctbal") / 20000).alias("stack"))


@register("provenance_mismatch", "WITH s AS (SELECT s_suppkey, sha256(s_name) AS source, CASE WHEN s_suppkey % 5 = 1 THEN sha256('x') ELSE sha256(s_name) END AS claimed, s_suppkey % 3 AS layer, CASE WHEN s_suppkey % 7 = 2 THEN 9 ELSE s_suppkey % 3 END AS said, CASE WHEN s_suppkey % 11 = 0 THEN 'short' ELSE sha256('m') END AS model, s_nationkey % 4 AS held, (s_nationkey + s_suppkey) % 4 AS trained FROM supplier) SELECT s_suppkey, CASE WHEN source <> claimed THEN 'source_sha256' WHEN layer <> said THEN 'layer' WHEN length(model) <> 64 THEN 'model_sha256' WHEN held = trained THEN 'training_groups' END AS mismatch FROM s")
def provenance_mismatch(spark, d):
    """The first thing that evidence claims and its use contradicts: source, layer, model fingerprint, a training road held out."""
    s = read(spark, d, "supplier")
    key, source = F.col("s_suppkey"), F.sha2(F.col("s_name"), 256)
    claimed = F.when(key % 5 == 1, F.sha2(F.lit("x"), 256)).otherwise(source)
    model = F.when(key % 11 == 0, "short").otherwise(F.sha2(F.lit("m"), 256))
    checks = [("source_sha256", source, claimed), ("layer", key % 3, F.when(key % 7 == 2, 9).otherwise(key % 3)), ("model_sha256", co.is_sha256(model), F.lit(True)), ("training_groups", F.col("s_nationkey") % 4 == (F.col("s_nationkey") + key) % 4, F.lit(False))]
    return s.select("s_suppkey", co.first_difference(checks).alias("mismatch"))


@register("station_anchors", f"WITH {SQL_EVENTS} SELECT user_id, event_type, string_agg(sec || ':' || round(value, 3)::DECIMAL(18, 3), ';' ORDER BY sec, event_id) AS anchors FROM ev WHERE event_type IN ('signup', 'view') AND event_id % 4 <> 0 GROUP BY 1, 2")
def station_anchors(spark, d):
    """Visible picks of model stations as ordered anchors of each layer."""
    use = events(spark, d).filter("event_type in ('signup', 'view') and event_id % 4 <> 0")
    text = F.concat_ws(":", F.col("sec").cast("string"), F.round("value", 3).cast("decimal(18,3)").cast("string"))
    listed = F.sort_array(F.collect_list(F.struct("sec", "event_id", text.alias("t"))))
    return use.groupBy("user_id", "event_type").agg(F.array_join(F.transform(listed, lambda x: x["t"]), ";").alias("anchors"))


@register("aligned_samples", "SELECT l_orderkey, l_linenumber, round(l_quantity + 70 - l_suppkey % 9, 6) AS aligned, round(l_quantity + 70 - l_suppkey % 9 - 70 + l_suppkey % 9, 6) AS back FROM lineitem")
def aligned_samples(spark, d):
    surface, reference = F.col("l_suppkey") % 9, F.lit(70)
    there = co.aligned_sample(F.col("l_quantity"), surface, reference)
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(there, 6).alias("aligned"), F.round(co.aligned_sample(there, surface, reference, inverse=True), 6).alias("back"))


@register(
    "coordinate_transform",
    "WITH t AS (SELECT s_suppkey AS s, 1 + s_suppkey % 4 AS a, s_suppkey % 10 AS b, 0.5 + (s_suppkey % 3) * 0.5 AS c, -2.0 AS o, s_suppkey % 2 = 0 AS verified, CASE s_suppkey % 4 WHEN 0 THEN 'acquisition_metadata' WHEN 1 THEN 'guess' ELSE 'radar_registration' END AS basis, (s_suppkey % 8) * 0.5 AS off FROM supplier) SELECT l_orderkey, l_linenumber, round(l_linenumber * a + b, 6) AS trace, round(l_quantity * c + o, 6) AS sample, round((l_linenumber * a + b - b) / a, 6) AS trace_back, round((l_quantity * c + o - o) / c, 6) AS sample_back, verified AND basis <> 'guess' AND off <= 1.5 AS scored FROM lineitem JOIN t ON s = l_suppkey",
)
def coordinate_transform(spark, d):
    """Affine mapping there and back, and whether its record lets accuracy be scored through it."""
    k = F.col("s_suppkey")
    basis = F.when(k % 4 == 0, "acquisition_metadata").when(k % 4 == 1, "guess").otherwise("radar_registration")
    gate = co.may_score(k % 2 == 0, basis, F.lit(True), (k % 8) * 0.5, F.lit(0.0), 3.0)
    t = read(spark, d, "supplier").select(k.alias("l_suppkey"), (1 + k % 4).alias("a"), (k % 10).alias("b"), (0.5 + (k % 3) * 0.5).alias("c"), F.lit(-2.0).alias("o"), gate.alias("scored"))
    rows = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity").join(t, "l_suppkey")
    scale = [F.col(c) for c in "abco"]
    there = co.forward(F.col("l_linenumber"), F.col("l_quantity"), *scale)
    back = co.inverse(*there, *scale)
    return rows.select("l_orderkey", "l_linenumber", *[F.round(x, 6).alias(n) for x, n in zip((*there, *back), ("trace", "sample", "trace_back", "sample_back"), strict=True)], "scored")


@register("segment_local_scores", f"WITH {SQL_EVENTS}, n AS (SELECT *, abs(value - lag(value) OVER w) AS move, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER w AS seg FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY sec, event_id)) SELECT user_id, CAST(seg AS BIGINT) AS seg, round(sum(value) / 100 - 0.03 * coalesce(sum(move), 0) * 0.1, 6) AS score FROM n GROUP BY user_id, seg")
def segment_local_scores(spark, d):
    """What a segment is worth by itself: its rows' scores less the cost of the steps inside it."""
    w = Window.partitionBy("user_id").orderBy("sec", "event_id")
    n = events(spark, d).withColumn("move", F.abs(F.col("value") - F.lag("value").over(w))).withColumn("seg", F.sum(F.when(F.col("event_type") == "error", 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return n.groupBy("user_id", "seg").agg(F.round(F.sum("value") / 100 - 0.03 * F.coalesce(F.sum("move"), F.lit(0.0)) * 0.1, 6).alias("score"))


@register("feature_clipped", f"WITH {SQL_CELLS}, p AS (SELECT label, quantile_cont(v, 0.02) AS lo, quantile_cont(v, 0.98) AS hi FROM cell GROUP BY 1) SELECT vec_id, k, round(CASE WHEN hi - lo > 1e-9 THEN least(greatest((v - lo) / (hi - lo), 0), 1) ELSE 0 END, 6) AS feature FROM cell JOIN p ON p.label = cell.label")
def feature_clipped(spark, d):
    """A branch between its 2nd and 98th percentile on the road, cut to 0 and 1."""
    c = cells(spark, d)
    p = quantiles.exact_quantiles(c, ["label"], "v", [0.02, 0.98], "q").select("label", F.col("q")[0].alias("lo"), F.col("q")[1].alias("hi"))
    span = F.col("hi") - F.col("lo")
    return c.join(p, "label").select("vec_id", "k", F.round(F.when(span > 1e-9, identity.clip01((F.col("v") - F.col("lo")) / span)).otherwise(0.0), 6).alias("feature"))


@register(
    "seed_gap_values",
    f"""WITH {SQL_EVENTS}, up AS (SELECT user_id, sec, avg(value) AS v FROM ev WHERE event_type = 'view' GROUP BY 1, 2), s AS (SELECT event_id, e.user_id, e.sec, e.value + 60 AS value, b.sec AS bx, b.v AS bv, a.sec AS ax, a.v AS av FROM ev e LEFT JOIN LATERAL (SELECT * FROM up WHERE up.user_id = e.user_id AND up.sec <= e.sec ORDER BY up.sec DESC LIMIT 1) b ON true LEFT JOIN LATERAL (SELECT * FROM up WHERE up.user_id = e.user_id AND up.sec >= e.sec ORDER BY up.sec LIMIT 1) a ON true WHERE event_type = 'signup'),
    g AS (SELECT *, CASE WHEN bx = sec THEN bv WHEN bx IS NOT NULL AND ax IS NOT NULL THEN bv + (av - bv) * (sec - bx)::DOUBLE / (ax - bx) ELSE coalesce(bv, av) END AS above FROM s) SELECT event_id, round(value - above, 6) AS gap FROM g WHERE value > above""",
)
def seed_gap_values(spark, d):
    """Gaps between seeds and the layer above, interpolated there and held beyond its ends; only positive ones."""
    seed = events(spark, d, "signup").select("event_id", "user_id", "sec", (F.col("value") + 60).alias("value"))
    up = events(spark, d, "view").select("user_id", "sec", F.col("value").alias("upper"), "event_id")
    inner = joins.interpolating(seed, up, ["user_id"], "sec", "upper", "above")
    ends = up.groupBy("user_id").agg(F.min(F.struct("sec")).alias("f"), F.max(F.struct("sec")).alias("l"))
    at = up.groupBy("user_id", "sec").agg(F.avg("upper").alias("v"))
    edges = ends.join(at.select("user_id", F.struct("sec").alias("f"), F.col("v").alias("fv")), ["user_id", "f"]).join(at.select("user_id", F.struct("sec").alias("l"), F.col("v").alias("lv")), ["user_id", "l"]).select("user_id", F.col("f.sec").alias("fx"), "fv", F.col("l.sec").alias("lx"), "lv")
    held = F.coalesce("above", F.when(F.col("sec") <= F.col("fx"), F.col("fv")).when(F.col("sec") >= F.col("lx"), F.col("lv")))
    return inner.join(edges, "user_id", "left").withColumn("a", held).filter("value > a").select("event_id", F.round(F.col("value") - F.col("a"), 6).alias("gap"))


_NEAR = "(sum(v * v) OVER w + greatest(7 + 1 - row_number() OVER o, 0) * first(v * v) OVER o + greatest(row_number() OVER o + 7 - 64, 0) * last(v * v) OVER f) / 15"


@register(
    "balanced_waveforms",
    f"WITH {SQL_CELLS}, e AS (SELECT *, {_NEAR} AS energy, 0.05 * sqrt(avg(v * v) OVER (PARTITION BY vec_id)) AS floor FROM cell WINDOW o AS (PARTITION BY vec_id ORDER BY k), f AS (PARTITION BY vec_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), w AS (PARTITION BY vec_id ORDER BY k ROWS BETWEEN 7 PRECEDING AND 7 FOLLOWING)) SELECT vec_id, k, round(CASE WHEN greatest(sqrt(greatest(energy, 0)), floor) > 0 THEN v / greatest(sqrt(greatest(energy, 0)), floor) ELSE 0 END, 6) AS value FROM e",
)
def balanced_waveforms(spark, d):
    """Samples over the local root mean square of two pulses, with a floor of a twentieth of the trace's."""
    from ..operators import windows

    c = cells(spark, d).withColumn("p", F.col("v") * F.col("v"))
    energy = windows.moving_mean("p", ["vec_id"], "k", 7)
    floor = 0.05 * F.sqrt(F.avg("p").over(Window.partitionBy("vec_id")))
    e = c.withColumn("scale", F.greatest(F.sqrt(F.greatest(energy, F.lit(0.0))), floor))
    return e.select("vec_id", "k", F.round(F.when(F.col("scale") > 0, F.col("v") / F.col("scale")).otherwise(0.0), 6).alias("value"))


@register(
    "warped_context_cosine",
    f"""WITH {SQL_CELLS}, p AS (SELECT a.vec_id, a.k, a.v AS x, b.v AS y FROM cell a JOIN cell b ON b.vec_id = a.vec_id + 1 AND b.k = a.k + a.vec_id % 3 - 1 WHERE abs(a.k - 32) <= 8 AND abs(b.k - 32) <= 8), m AS (SELECT *, x - avg(x) OVER (PARTITION BY vec_id) AS u, y - avg(y) OVER (PARTITION BY vec_id) AS w FROM p)
    SELECT vec_id, round(CASE WHEN vec_id % 3 = 2 THEN -1 WHEN count(*) < 3 OR sum(u * u) * sum(w * w) = 0 THEN -1 ELSE least(greatest(sum(u * w) / sqrt(sum(u * u) * sum(w * w)), -1), 1) END, 6) AS cosine FROM m GROUP BY 1""",
)
def warped_context_cosine(spark, d):
    """Demeaned cosine over the aligned pairs around two samples; -1 where the alignment maps the centre elsewhere, or too few pairs are near."""
    c = cells(spark, d).select("vec_id", "k", "v")
    other = c.select((F.col("vec_id") - 1).alias("vec_id"), F.col("k").alias("k2"), F.col("v").alias("y"))
    path = c.withColumn("k2", F.col("k") + F.col("vec_id") % 3 - 1).join(other, ["vec_id", "k2"]).filter("abs(k - 32) <= 8 and abs(k2 - 32) <= 8")
    s = path.groupBy("vec_id").agg(F.count("*").alias("n"), F.covar_pop("v", "y").alias("xy"), F.var_pop("v").alias("xx"), F.var_pop("y").alias("yy"), F.max(F.when(F.col("k") == 32, F.col("k2"))).alias("centre"))
    usable = (F.col("n") >= 3) & (F.col("xx") * F.col("yy") > 0) & (F.col("centre") <= 32)
    return s.select("vec_id", F.round(F.when(usable, F.least(F.greatest(F.col("xy") / F.sqrt(F.col("xx") * F.col("yy")), F.lit(-1.0)), F.lit(1.0))).otherwise(-1.0), 6).alias("cosine"))


@register(
    "patch_pair_features",
    f"WITH {SQL_CELLS} SELECT a.vec_id, round(sum(a.v * b.v) FILTER (WHERE a.k % 5 <> 0 AND b.k % 7 <> 0), 6) AS product, round(sum((a.v - b.v) ** 2) FILTER (WHERE a.k % 5 <> 0 AND b.k % 7 <> 0) / greatest(count(*) FILTER (WHERE a.k % 5 <> 0 AND b.k % 7 <> 0), 1), 6) AS difference, round(avg(CASE WHEN a.k % 5 <> 0 AND b.k % 7 <> 0 THEN 1.0 ELSE 0.0 END), 6) AS support FROM cell a JOIN cell b ON b.vec_id = a.vec_id + 1 AND b.k = a.k GROUP BY 1",
)
def patch_pair_features(spark, d):
    """Products, squared differences and support of two patches where both are supported: element-wise on arrays, no explode."""
    emb = read(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    pair = emb.join(emb.select((F.col("vec_id") - 1).alias("vec_id"), F.col("x").alias("y")), "vec_id")
    index = F.sequence(F.lit(0), F.lit(63))
    both = F.transform(index, lambda i: ((i % 5 != 0) & (i % 7 != 0)).cast("double"))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
    product = F.zip_with(F.zip_with("x", "y", lambda a, b: a * b), both, lambda v, m: v * m)
    square = F.zip_with(F.zip_with("x", "y", lambda a, b: (a - b) * (a - b)), both, lambda v, m: v * m)
    return pair.select("vec_id", F.round(total(product), 6).alias("product"), F.round(total(square) / F.greatest(total(both), F.lit(1.0)), 6).alias("difference"), F.round(total(both) / 64, 6).alias("support"))


@register(
    "resampled_valid",
    """WITH e AS (SELECT vec_id, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS x FROM embeddings), p AS (SELECT a.vec_id, a.x, b.x AS y, unnest(range(0, 63)) AS k FROM e a JOIN e b ON b.vec_id = a.vec_id + 1),
    h AS (SELECT vec_id, k, CASE WHEN (vec_id + k) % 11 <> 0 AND (vec_id + k + 1) % 11 <> 0 AND (vec_id + 1 + k) % 11 <> 0 AND (vec_id + k + 2) % 11 <> 0 THEN 0.25 * (x[k + 1] + x[k + 2] + y[k + 1] + y[k + 2]) END AS value FROM p)
    SELECT vec_id, CAST(k AS INTEGER) AS k, round(value, 6) AS value, value IS NOT NULL AS valid FROM h""",
)
def resampled_valid(spark, d):
    """The image halfway between traces and samples; a value needs all four neighbours to be valid."""
    emb = read(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    pair = emb.join(emb.select((F.col("vec_id") - 1).alias("vec_id"), F.col("x").alias("y")), "vec_id")
    known = lambda row, k, v: F.when((row + k) % 11 != 0, v)
    mid = F.transform(F.sequence(F.lit(0), F.lit(62)), lambda k: 0.25 * (known(F.col("vec_id"), k, F.get("x", k)) + known(F.col("vec_id"), k + 1, F.get("x", k + 1)) + known(F.col("vec_id") + 1, k, F.get("y", k)) + known(F.col("vec_id") + 1, k + 1, F.get("y", k + 1))))
    return pair.select("vec_id", F.posexplode(mid).alias("k", "v")).select("vec_id", "k", F.round("v", 6).alias("value"), F.col("v").isNotNull().alias("valid"))


#: Depth probabilities of a trace: the modulus, every ninth sample masked.
SQL_PROBABILITY = f"{SQL_CELLS}, q AS (SELECT *, CASE WHEN (vec_id + k) % 9 = 0 THEN 0 ELSE abs(v) END AS raw FROM cell), p AS (SELECT vec_id, label, k, (vec_id + k) % 9 <> 0 AS valid, CASE WHEN sum(raw) OVER (PARTITION BY vec_id) > 0 THEN raw / sum(raw) OVER (PARTITION BY vec_id) ELSE 0 END AS p FROM q)"


def probabilities(spark, d):
    q = cells(spark, d).withColumn("valid", (F.col("vec_id") + F.col("k")) % 9 != 0).withColumn("raw", F.when(F.col("valid"), F.abs("v")).otherwise(0.0))
    return q.withColumn("p", co.probability(F.col("raw"), F.sum("raw").over(Window.partitionBy("vec_id"))))


@register("prepared_probabilities", f"WITH {SQL_PROBABILITY} SELECT vec_id, round(sum(p), 6) AS total, round(-sum(CASE WHEN p > 0 THEN p * ln(p) ELSE 0 END) / ln(greatest(count(*) FILTER (WHERE valid), 2)), 6) AS entropy FROM p GROUP BY 1")
def prepared_probabilities(spark, d):
    """Masked and normalised depth probabilities of a trace, with their entropy between 0 and 1."""
    p = probabilities(spark, d)
    entropy = -F.sum(F.when(F.col("p") > 0, F.col("p") * F.log("p")).otherwise(0.0)) / F.log(F.greatest(F.count_if("valid"), F.lit(2)))
    return p.groupBy("vec_id").agg(F.round(F.sum("p"), 6).alias("total"), F.round(entropy, 6).alias("entropy"))


@register("direct_predictions", f"WITH {SQL_PROBABILITY}, m AS (SELECT vec_id, arg_min(k, (-round(p, 12), k)) AS proposal, max(p) AS confidence FROM p GROUP BY 1) SELECT vec_id, CASE WHEN confidence = 0 THEN -1 ELSE proposal END AS proposal, round(confidence, 6) AS confidence, confidence >= 0.06 AND confidence > 0 AS accepted, CASE WHEN confidence >= 0.06 AND confidence > 0 THEN proposal ELSE -1 END AS sample FROM m")
def direct_predictions(spark, d):
    """The likeliest depth of each trace, accepted from a threshold on: no seeds, no smoothing."""
    m = probabilities(spark, d).groupBy("vec_id").agg(F.min(F.struct((-F.round("p", 12)).alias("o"), "k")).alias("m"), F.max("p").alias("confidence"))
    some = F.col("confidence") > 0
    accepted = some & (F.col("confidence") >= 0.06)
    return m.select("vec_id", F.when(some, F.col("m.k")).otherwise(-1).alias("proposal"), F.round("confidence", 6).alias("confidence"), accepted.alias("accepted"), F.when(accepted, F.col("m.k")).otherwise(-1).alias("sample"))


@register(
    "seed_interpolation",
    f"""WITH {SQL_CANDIDATES}, u AS (SELECT * FROM seed WHERE i > 0 OR label % 2 = 0), r AS (SELECT t.label, t.i, (SELECT max(u.i) FROM u WHERE u.label = t.label AND u.i <= t.i) AS bi, (SELECT min(u.i) FROM u WHERE u.label = t.label AND u.i >= t.i) AS ai FROM trace t), j AS (SELECT r.*, b.s AS bs, a.s AS sa FROM r LEFT JOIN u b ON b.label = r.label AND b.i = bi LEFT JOIN u a ON a.label = r.label AND a.i = ai)
    SELECT label, i, round(CASE WHEN bi = ai THEN bs WHEN bi IS NOT NULL AND ai IS NOT NULL THEN bs + (sa - bs) * (i - bi)::DOUBLE / (ai - bi) ELSE coalesce(bs, sa) END, 6) AS held, round(CASE WHEN bi IS NULL OR ai IS NULL THEN -1 WHEN bi = ai THEN bs ELSE bs + (sa - bs) * (i - bi)::DOUBLE / (ai - bi) END, 6) AS inside FROM j""",
)
def seed_interpolation(spark, d):
    """The control that uses no radar: lines between seeds, held beyond them or -1 there."""
    u = seeds(candidates(spark, d)).filter("i > 0 or label % 2 = 0").select("label", "i", F.col("s").cast("double").alias("s"))
    rows = traces(spark, d).select("label", "i")
    inner = joins.interpolating(rows, u, ["label"], "i", "s", "x")
    ends = u.groupBy("label").agg(F.min(F.struct("i", "s")).alias("f"), F.max(F.struct("i", "s")).alias("l"))
    held = F.coalesce("x", F.when(F.col("i") < F.col("f.i"), F.col("f.s")).otherwise(F.col("l.s")))
    return inner.join(ends, "label").select("label", "i", F.round(held, 6).alias("held"), F.round(F.coalesce("x", F.lit(-1.0)), 6).alias("inside"))


@register("exact_answers", f"WITH {SQL_PICKS}, a AS (SELECT layer, CAST(x AS BIGINT) AS row, count(*) AS n, min(sample) AS sample, bool_and(sample = floor(sample) AND sample BETWEEN 0 AND 49) AS on_grid FROM pick WHERE status = 'accepted' GROUP BY 1, 2) SELECT layer, row, sample, CASE WHEN n > 1 THEN 'duplicate' WHEN NOT on_grid THEN 'off_grid' END AS refused FROM a")
def exact_answers(spark, d):
    """An answer for a row only where one reference on the grid gives it; else why not."""
    a = picks(spark, d).filter("status = 'accepted'").groupBy("layer", F.col("x").cast("long").alias("row")).agg(F.count("*").alias("n"), F.min("sample").alias("sample"), F.bool_and((F.col("sample") == F.floor("sample")) & F.col("sample").between(0, 49)).alias("on_grid"))
    return a.select("layer", "row", "sample", F.when(F.col("n") > 1, "duplicate").when(~F.col("on_grid"), "off_grid").alias("refused"))


@register("rate_table", f"{SQL_SCORED}, c AS (SELECT road, layer, count(*)::DOUBLE AS n, count(*) FILTER (WHERE score >= 0.7 AND NOT supplied AND correct) AS good, count(*) FILTER (WHERE score >= 0.7 AND NOT supplied AND NOT correct) AS wrong, count(*) FILTER (WHERE supplied) AS given FROM s GROUP BY 1, 2) SELECT road, layer, round(good / nullif(good + wrong, 0), 6) AS precision, round(good / n, 6) AS coverage, round(wrong / n, 6) AS wrong_rate, round(given / n, 6) AS supplied, round((n - good - wrong - given) / n, 6) AS unresolved FROM c")
def rate_table(spark, d):
    """Precision, coverage, wrong, supplied and unresolved shares of each road and layer."""
    take = (F.col("score") >= 0.7) & ~F.col("supplied")
    c = scored(spark, d).groupBy("road", "layer").agg(F.count("*").alias("n"), F.count_if(take & F.col("correct")).alias("good"), F.count_if(take & ~F.col("correct")).alias("wrong"), F.count_if("supplied").alias("given"))
    n, good, wrong, given = (F.col(x) for x in ("n", "good", "wrong", "given"))
    return c.select("road", "layer", F.round(F.try_divide(good, good + wrong), 6).alias("precision"), F.round(good / n, 6).alias("coverage"), F.round(wrong / n, 6).alias("wrong_rate"), F.round(given / n, 6).alias("supplied"), F.round((n - good - wrong - given) / n, 6).alias("unresolved"))


@register("endpoint_scores", f"{SQL_SCORED}, g AS (SELECT *, unnest(list_filter(['whole', CASE WHEN x > 300 AND x < 2200 THEN 'bracketed' END, CASE WHEN x < 300 THEN 'left_tail' END, CASE WHEN x > 2200 THEN 'right_tail' END, CASE WHEN x < 300 OR x > 2200 THEN 'tails' END], lambda p: p IS NOT NULL)) AS part FROM s WHERE NOT supplied) SELECT layer, part, count(*) AS n, count(*) FILTER (WHERE score >= 0.7) AS accepted, count(*) FILTER (WHERE score >= 0.7 AND correct) AS agree, round(avg(abs(sample - 25)) FILTER (WHERE score >= 0.7), 6) AS mean_error FROM g GROUP BY 1, 2")
def endpoint_scores(spark, d):
    """Scores of the whole road, between the outer seeds and in its tails, without the rows that were supplied."""
    x = F.col("x")
    part = F.filter(F.array(F.lit("whole"), F.when((x > 300) & (x < 2200), "bracketed"), F.when(x < 300, "left_tail"), F.when(x > 2200, "right_tail"), F.when((x < 300) | (x > 2200), "tails")), lambda p: p.isNotNull())
    g = scored(spark, d).filter("not supplied").withColumn("part", F.explode(part))
    take = F.col("score") >= 0.7
    return g.groupBy("layer", "part").agg(F.count("*").alias("n"), F.count_if(take).alias("accepted"), F.count_if(take & F.col("correct")).alias("agree"), F.round(F.avg(F.when(take, F.abs(F.col("sample") - 25))), 6).alias("mean_error"))


@register(
    "resolution_comparison",
    f"""WITH {SQL_CANDIDATES}, a AS (SELECT label, i, arg_min(k, (-score, k)) AS k, arg_min(pole, (-score, k)) AS pole, max(score) AS score FROM cand GROUP BY 1, 2), c AS (SELECT label, i - i % 2 AS i, k, pole, score FROM a WHERE i % 2 = 0), j AS (SELECT a.label, a.i, a.k AS ref, a.pole, a.k AS k1, a.score AS s1, n.k AS k2, n.score AS s2, n.pole AS p2 FROM a JOIN c ON c.label = a.label AND c.i = a.i JOIN a n ON n.label = a.label AND n.i = a.i + 1)
    SELECT label, count(*) AS common, count(*) FILTER (WHERE s1 >= 0.6) AS fine_accepted, count(*) FILTER (WHERE s2 >= 0.6) AS coarse_accepted, count(*) FILTER (WHERE s2 >= 0.6 AND abs(k2 - ref) <= 8 AND p2 = pole) AS coarse_agree, count(*) FILTER (WHERE s2 >= 0.6 AND p2 <> pole) AS switches, round(count(*) FILTER (WHERE s2 >= 0.6 AND abs(k2 - ref) <= 8 AND p2 = pole) / count(*), 6) AS coverage FROM j GROUP BY 1""",
)
def resolution_comparison(spark, d):
    """Two runs of different trace spacing on the rows that both have: accepted, agreeing, and switched to another lobe."""
    best = candidates(spark, d).groupBy("label", "i").agg(F.min(F.struct((-F.col("score")).alias("o"), "k", "pole")).alias("m"))
    fine = best.filter("i % 2 = 0").select("label", "i", F.col("m.k").alias("ref"), F.col("m.pole").alias("pole"), (-F.col("m.o")).alias("s1"))
    coarse = best.filter("i % 2 = 1").select("label", (F.col("i") - 1).alias("i"), F.col("m.k").alias("k2"), F.col("m.pole").alias("p2"), (-F.col("m.o")).alias("s2"))
    j = fine.join(coarse, ["label", "i"])
    take = F.col("s2") >= 0.6
    agree = take & (F.abs(F.col("k2") - F.col("ref")) <= 8) & (F.col("p2") == F.col("pole"))
    return j.groupBy("label").agg(F.count("*").alias("common"), F.count_if(F.col("s1") >= 0.6).alias("fine_accepted"), F.count_if(take).alias("coarse_accepted"), F.count_if(agree).alias("coarse_agree"), F.count_if(take & (F.col("p2") != F.col("pole"))).alias("switches"), F.round(F.count_if(agree) / F.count("*"), 6).alias("coverage"))


@register("layer_targets", f"WITH {SQL_CELLS}, t AS (SELECT vec_id, k, vec_id * 7 % 64 AS s, CASE vec_id % 4 WHEN 0 THEN 'absent' WHEN 1 THEN 'not_visible' ELSE 'visible' END AS vis, (vec_id % 3 + 2) * 4.0 AS pulse FROM cell) SELECT vec_id, k, round(CASE vis WHEN 'visible' THEN exp(-0.5 * ((k - s) / greatest(1, pulse / 4)) ** 2) WHEN 'absent' THEN 0 END, 6) AS target, vis <> 'not_visible' AS supervised FROM t")
def layer_targets(spark, d):
    """Training targets by sample: a Gaussian around a visible label, nothing where a layer is absent, ignored where only its visibility is known."""
    state = F.when(F.col("vec_id") % 4 == 0, "absent").when(F.col("vec_id") % 4 == 1, "not_visible").otherwise("visible")
    t = cells(spark, d).withColumn("vis", state).withColumn("target", co.layer_target(F.col("vec_id") * 7 % 64, F.col("k"), F.col("vis"), (F.col("vec_id") % 3 + 2) * 4.0))
    return t.select("vec_id", "k", F.round("target", 6).alias("target"), (F.col("vis") != "not_visible").alias("supervised"))


@register("overlay_series", f"WITH {SQL_PICKS} SELECT l_orderkey, l_linenumber, CASE WHEN sample >= 5 AND status IN ('accepted', 'high_confidence') AND l_linenumber <> 3 THEN CASE WHEN layer = 2 THEN sample ELSE sample + 0.5 END ELSE 'NaN'::DOUBLE END AS value FROM pick")
def overlay_series(spark, d):
    """Plotted values with gaps kept as NaN."""
    lobe = F.when(F.col("layer") != 2, F.col("sample") + 0.5)
    sample = F.when(F.col("sample") >= 5, F.col("sample")).otherwise(-1.0)
    return picks(spark, d).select("l_orderkey", "l_linenumber", co.plotted(sample, lobe, F.col("status"), ["accepted", "high_confidence"], F.col("l_linenumber") == 3, F.lit("visible")).alias("value"))


@register(
    "model_requests",
    f"""WITH {SQL_PROBABILITY}, h AS (SELECT p.vec_id, p.label, -sum(CASE WHEN p > 0 THEN p * ln(p) ELSE 0 END) / ln(greatest(count(*) FILTER (WHERE valid), 2)) AS entropy FROM p GROUP BY 1, 2), t AS (SELECT h.*, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS i, count(*) OVER (PARTITION BY label) AS n FROM h),
    o AS (SELECT *, least(i, n - 1 - i, abs(i - n // 2)) AS away FROM t WHERE i NOT IN (0, n // 2, n - 1)), best AS (SELECT label, arg_min(i, (-round(entropy * least(1.0, away * 0.1 / 1.0), 9), i)) AS row, max(round(entropy * least(1.0, away * 0.1 / 1.0), 9)) AS priority FROM o GROUP BY 1),
    m AS (SELECT label, arg_min(i, (-w, i)) AS row FROM (SELECT label, n, i, CASE WHEN i < n // 2 THEN n // 2 ELSE n - 1 - n // 2 END AS w, abs(i - CASE WHEN i < n // 2 THEN n // 2 / 2.0 ELSE (n // 2 + n - 1) / 2.0 END) AS off, row_number() OVER (PARTITION BY label, i < n // 2 ORDER BY abs(i - CASE WHEN i < n // 2 THEN n // 2 / 2.0 ELSE (n // 2 + n - 1) / 2.0 END), i) AS r FROM o) WHERE r = 1 GROUP BY 1),
    f AS (SELECT label, min(CAST(round_even((n - 1) / 5.0, 0) AS BIGINT)) AS row FROM t GROUP BY 1) SELECT best.label, best.row AS uncertain_row, round(best.priority, 6) AS priority, m.row AS midpoint_row, f.row AS spaced_row FROM best JOIN m ON m.label = best.label JOIN f ON f.label = best.label""",
)
def model_requests(spark, d):
    """The next row to ask for by three policies: entropy with a taper of a metre beside known rows, the middle of the widest interval, fixed spacing."""
    p = probabilities(spark, d)
    h = p.groupBy("vec_id").agg((-F.sum(F.when(F.col("p") > 0, F.col("p") * F.log("p")).otherwise(0.0)) / F.log(F.greatest(F.count_if("valid"), F.lit(2)))).alias("entropy"))
    t = h.join(traces(spark, d), "vec_id")
    half = F.floor(F.col("n") / 2)
    o = t.filter(~(F.col("i") == 0) & ~(F.col("i") == half) & ~(F.col("i") == F.col("n") - 1))
    away = F.least(F.col("i"), F.col("n") - 1 - F.col("i"), F.abs(F.col("i") - half))
    priority = F.round(F.col("entropy") * F.least(F.lit(1.0), away * 0.1), 9)
    first = F.col("i") < half
    width = F.when(first, half).otherwise(F.col("n") - 1 - half)
    off = F.abs(F.col("i") - F.when(first, half / 2).otherwise((half + F.col("n") - 1) / 2))
    r = o.groupBy("label").agg(F.min(F.struct((-priority).alias("p"), "i")).alias("q")).select("label", F.col("q.i").alias("uncertain_row"), F.round(-F.col("q.p"), 6).alias("priority"))
    # Of each interval its middle row, and of the intervals the widest.
    sides = o.groupBy("label", first.alias("first"), width.alias("w")).agg(F.min(F.struct(off.alias("o"), "i")).alias("m")).groupBy("label").agg(F.min(F.struct((-F.col("w")).alias("w"), F.col("m.i").alias("i"))).alias("b")).select("label", F.col("b.i").alias("midpoint_row"))
    spaced = t.groupBy("label").agg(F.min(F.bround((F.col("n") - 1) / 5, 0).cast("long")).alias("spaced_row"))
    return r.join(sides, "label").join(spaced, "label")


@register("correction_actions", f"WITH {SQL_EVENTS} SELECT user_id, event_id, value >= 0 AND event_id % 6 <> 5 AND event_id % 10 <> 9 AS usable, CASE WHEN event_id % 6 = 5 THEN 'source' WHEN event_id % 10 = 9 THEN 'scope' END AS refused, count(*) FILTER (WHERE event_type = 'click') OVER (PARTITION BY user_id ORDER BY sec, event_id) AS stations FROM ev")
def correction_actions(spark, d):
    """Actions frozen as JSON and read back: refused where the source or the scope does not hold, with the stations known at their time."""
    w = Window.partitionBy("user_id").orderBy("sec", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    e = events(spark, d).withColumn("stations", F.sum((F.col("event_type") == "click").cast("long")).over(w))
    source = F.when(F.col("event_id") % 6 == 5, "other").otherwise("own")
    stop = F.when(F.col("event_id") % 10 == 9, F.col("sec") - 10).otherwise(F.col("sec") + 10)
    action = F.to_json(F.struct(F.lit(1).alias("schema_version"), source.alias("source_sha256"), F.col("sec").alias("start"), stop.alias("stop"), F.array(F.lit(1), F.lit(2)).alias("layer_orders"), "stations"))
    read_back = e.select("user_id", "event_id", F.from_json(action, "schema_version int, source_sha256 string, start long, stop long, layer_orders array<int>, stations long").alias("a"))
    orders = F.forall("a.layer_orders", lambda o: o.between(1, 3)) & (F.size("a.layer_orders") > 0)
    refused = F.when((F.col("a.schema_version") != 1) | (F.col("a.source_sha256") != "own"), "source").when((F.col("a.start") > F.col("a.stop")) | ~orders, "scope")
    return read_back.select("user_id", "event_id", refused.isNull().alias("usable"), refused.alias("refused"), F.col("a.stations").alias("stations"))


@register(
    "confirmed_provisionals",
    f"""WITH {SQL_CANDIDATES}, p AS (SELECT vec_id, any_value(label) AS label, any_value(i) AS i, (vec_id * 13) % 70 AS display FROM cand GROUP BY vec_id), j AS (SELECT p.*, arg_min(c.k, (abs(c.k - display), c.k)) AS k, arg_min(c.pole, (abs(c.k - display), c.k)) AS pole, min(abs(c.k - display)) AS off FROM p JOIN cand c ON c.vec_id = p.vec_id GROUP BY ALL) SELECT vec_id, display BETWEEN 0 AND 63 AS confirmed, CASE WHEN display > 63 THEN -1 WHEN off <= 2 THEN k ELSE display END AS sample, CASE WHEN display <= 63 AND off <= 2 THEN pole END AS pole FROM j""",
)
def confirmed_provisionals(spark, d):
    """A confirmed proposal takes its frozen place, or that of the candidate within two samples; one off the grid cannot be confirmed."""
    c = candidates(spark, d).withColumn("display", F.col("vec_id") * 13 % 70)
    j = c.groupBy("vec_id", "display").agg(F.min(F.struct(F.abs(F.col("k") - F.col("display")).alias("off"), "k", "pole")).alias("m"))
    on, near = F.col("display") <= 63, F.col("m.off") <= 2
    return j.select("vec_id", on.alias("confirmed"), F.when(~on, -1).when(near, F.col("m.k")).otherwise(F.col("display")).alias("sample"), F.when(on & near, F.col("m.pole")).alias("pole"))


@register(
    "proposal_matches",
    f"""WITH {SQL_EVENTS}, a AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id, event_type ORDER BY sec, event_id) AS n, value FROM ev), b AS (SELECT user_id, event_type, n, value + CASE WHEN user_id % 9 = 0 AND n = 1 THEN 0.7 WHEN user_id % 2 = 0 THEN 0.4 ELSE 0 END AS value FROM a WHERE NOT (user_id % 11 = 0 AND n = 2))
    SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(a.event_type, b.event_type) AS event_type, bool_and(a.n IS NOT NULL AND b.n IS NOT NULL AND abs(coalesce(a.value, 1e9) - coalesce(b.value, -1e9)) <= 0.5) AS replayed FROM a FULL JOIN b ON a.user_id = b.user_id AND a.event_type = b.event_type AND a.n = b.n GROUP BY 1, 2""",
)
def proposal_matches(spark, d):
    """An acceptance is replayed only where the rerun shows the same rows, each within half a sample."""
    w = Window.partitionBy("user_id", "event_type").orderBy("sec", "event_id")
    a = events(spark, d).withColumn("n", F.row_number().over(w)).select("user_id", "event_type", "n", "value")
    moved = F.col("value") + F.when((F.col("user_id") % 9 == 0) & (F.col("n") == 1), 0.7).when(F.col("user_id") % 2 == 0, 0.4).otherwise(0.0)
    b = a.filter("not (user_id % 11 = 0 and n = 2)").select("user_id", "event_type", "n", moved.alias("again"))
    same = F.coalesce(F.abs(F.col("value") - F.col("again")) <= 0.5, F.lit(False))
    return a.join(b, ["user_id", "event_type", "n"], "full").groupBy("user_id", "event_type").agg(F.bool_and(same).alias("replayed"))


@register("layer_specs", "SELECT p_brand, p_size, 'L' || p_size AS name, count(*) AS n, count(*) FILTER (WHERE p_partkey % 13 = 0) AS mismatched FROM part GROUP BY 1, 2")
def layer_specs(spark, d):
    """Layers kept as JSON payloads under their order; a payload of another order is counted as mismatched."""
    stored = read(spark, d, "part").select("p_brand", "p_size", "p_partkey", F.to_json(F.struct(F.when(F.col("p_partkey") % 13 == 0, -1).otherwise(F.col("p_size")).alias("order"), F.concat(F.lit("L"), "p_size").alias("name"))).alias("payload"))
    back = stored.withColumn("s", F.from_json("payload", "order int, name string"))
    return back.groupBy("p_brand", "p_size", F.col("s.name").alias("name")).agg(F.count("*").alias("n"), F.count_if(F.col("s.order") != F.col("p_size")).alias("mismatched"))


@register(
    "dropout_requests",
    f"""WITH RECURSIVE {SQL_EVENTS}, r AS (SELECT user_id, sec, row_number() OVER (PARTITION BY user_id ORDER BY sec, event_id) AS n FROM ev WHERE event_type = 'error'), x AS (SELECT user_id, min(sec) AS lo, max(sec) AS hi, least(250000.0::DOUBLE, greatest(20000.0::DOUBLE, (max(sec) - min(sec)) / 8)) AS step FROM ev GROUP BY 1), o AS (SELECT user_id, list(sec::DOUBLE) AS occupied FROM ev WHERE event_type = 'signup' GROUP BY 1), t AS (SELECT user_id, max(n) AS last FROM r GROUP BY 1),
    g AS (SELECT r.user_id, r.n, sec - step AS a, sec + step AS b, step, lo, hi FROM r JOIN x ON x.user_id = r.user_id),
    f AS (SELECT t.user_id, CAST(0 AS BIGINT) AS n, coalesce(o.occupied, CAST([] AS DOUBLE[])) AS occupied, CAST([] AS DOUBLE[]) AS asked FROM t LEFT JOIN o ON o.user_id = t.user_id UNION ALL
    SELECT user_id, n, CASE WHEN pick IS NULL THEN occupied ELSE list_append(occupied, pick) END, CASE WHEN pick IS NULL THEN asked ELSE list_append(asked, pick) END FROM (SELECT *, CASE WHEN len(asked) < 3 THEN CASE WHEN a_ok AND (NOT b_ok OR ar >= br) THEN a WHEN b_ok THEN b END END AS pick FROM (SELECT f.user_id, g.n, f.occupied, f.asked, g.a, g.b,
    g.a BETWEEN lo AND hi AND len(list_filter(f.occupied, lambda v: abs(v - g.a) < 0.6 * g.step)) = 0 AS a_ok, g.b BETWEEN lo AND hi AND len(list_filter(f.occupied, lambda v: abs(v - g.b) < 0.6 * g.step)) = 0 AS b_ok, coalesce(list_min(list_transform(f.occupied, lambda v: abs(v - g.a))), 1e18) AS ar, coalesce(list_min(list_transform(f.occupied, lambda v: abs(v - g.b))), 1e18) AS br FROM f JOIN g ON g.user_id = f.user_id AND g.n = f.n + 1)))
    SELECT f.user_id, CAST(t.last AS INTEGER) AS rechecks, len(asked) AS companions, round(coalesce(list_sum(asked), 0), 3) AS places FROM f JOIN t ON t.user_id = f.user_id AND t.last = f.n""",
)
def dropout_requests(spark, d):
    """Contradicted seeds are asked again, and up to three companions beside them, each the roomier free place a step away."""
    e = events(spark, d)
    road = e.groupBy("user_id").agg(F.min("sec").alias("lo"), F.max("sec").alias("hi"), F.sort_array(F.collect_list(F.when(F.col("event_type") == "signup", F.col("sec").cast("double")))).alias("occupied"), F.sort_array(F.collect_list(F.when(F.col("event_type") == "error", F.struct("sec", "event_id")))).alias("r")).filter(F.size("r") > 0)
    step = F.least(F.lit(250000.0), F.greatest(F.lit(20000.0), (F.col("hi") - F.col("lo")) / 8))
    road = road.withColumn("step", step)
    start = F.struct(F.col("occupied").alias("occupied"), F.array().cast("array<double>").alias("asked"))

    def add(acc, r):
        def option(place):
            ok = place.between(F.col("lo"), F.col("hi")) & ~F.exists(acc["occupied"], lambda v: F.abs(v - place) < 0.6 * F.col("step"))
            room = F.coalesce(F.array_min(F.transform(acc["occupied"], lambda v: F.abs(v - place))), F.lit(1e18))
            return ok, room

        low, high = r["sec"] - F.col("step"), r["sec"] + F.col("step")
        (low_ok, low_room), (high_ok, high_room) = option(low), option(high)
        chosen = F.when(F.size(acc["asked"]) < 3, F.when(low_ok & (~high_ok | (low_room >= high_room)), low).when(high_ok, high))
        more = lambda a: F.when(chosen.isNull(), a).otherwise(F.concat(a, F.array(chosen)))
        return F.struct(more(acc["occupied"]).alias("occupied"), more(acc["asked"]).alias("asked"))

    done = road.withColumn("f", F.aggregate("r", start, add))
    return done.select("user_id", F.size("r").alias("rechecks"), F.size("f.asked").alias("companions"), F.round(F.aggregate("f.asked", F.lit(0.0), lambda s, v: s + v), 3).alias("places"))
