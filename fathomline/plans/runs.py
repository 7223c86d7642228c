"""Whole runs: calibration of roads, manifests, benchmarks of methods, risk reports, datasets and episodes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import alignment, calibration
from ..operators.solvers import matrix
from .aggregates import SQL_PICKS, picks
from .candidates import SQL_CANDIDATES, candidates, traces
from .evaluation import SQL_SCORED, scored
from .registry import register
from .reports import SQL_RUN, run
from .tables import read


def roads(spark, d):
    """(road, row, samples): the traces of every road, numbered."""
    emb = read(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("samples"))
    return traces(spark, d).join(emb, "vec_id").select(F.col("label").cast("string").alias("road"), F.col("i").cast("int").alias("row"), "samples")


@register("reciprocal_dtw_pairs")
def reciprocal_dtw_pairs(spark, d):
    """Agreement and centre displacement of neighbouring traces' windows, the worse of both ways. Pairs meet by a join and are aligned a batch at a time. A test compares them with a plain table."""
    rows = roads(spark, d)
    pairs = rows.join(rows.select("road", (F.col("row") - 1).alias("row"), F.col("samples").alias("following")), ["road", "row"])

    def run(batches):
        for batch in batches:
            x, y = (matrix(pa.chunked_array([batch[c]]))[:, 20:51] for c in ("samples", "following"))
            x, y = (v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9) for v in (x, y))
            agreement, shift = alignment.reciprocal(x, y, 3)
            one, own = alignment.aligned_pairs(x, y, 3)
            yield pa.RecordBatch.from_arrays([batch["road"], batch["row"], *map(pa.array, (agreement, shift, one, own))], names=["road", "row", "agreement", "displacement", "forward", "forward_displacement"])

    return pairs.mapInArrow(run, "road string, row int, agreement double, displacement double, forward double, forward_displacement double")


@register("calibrated_roads")
def calibrated_roads(spark, d):
    """Roads with flat surfaces; road 0 is the plate, which roads of an even number were recorded like. A test compares them with ``calibration.calibrated`` of whole roads."""
    return calibration.calibrated_traces(roads(spark, d), "0", F.col("road").cast("int") % 2 == 0, 2, 20)


@register(
    "run_manifest",
    f"""WITH {SQL_PICKS}, r AS (SELECT layer, status, count(*) AS n FROM pick GROUP BY 1, 2), t AS (SELECT layer, sum(n) AS total, sum(n) FILTER (WHERE status <> 'accepted') AS open FROM r GROUP BY 1) SELECT 'picks' AS section, layer || '/' || status AS name, n::DOUBLE AS value FROM r UNION ALL SELECT 'review_coverage', layer::VARCHAR, round(open / total, 6) FROM t UNION ALL SELECT 'run', 'trace_bins', count(DISTINCT x)::DOUBLE FROM pick UNION ALL SELECT 'run', 'unresolved_picks', (count(*) FILTER (WHERE status = 'unresolved'))::DOUBLE FROM pick""",
)
def run_manifest(spark, d):
    """A run's manifest as one JSON document, read back as rows of section, name and value."""
    p = picks(spark, d)
    counts = p.groupBy("layer", "status").agg(F.count("*").cast("double").alias("n"))
    listed = counts.agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("/", "layer", "status"), "n"))).alias("picks"))
    shares = counts.groupBy("layer").agg(F.round(F.sum(F.when(F.col("status") != "accepted", F.col("n")).otherwise(0.0)) / F.sum("n"), 6).alias("v")).agg(F.map_from_entries(F.collect_list(F.struct(F.col("layer").cast("string"), "v"))).alias("review_coverage"))
    whole = p.agg(F.countDistinct("x").cast("double").alias("bins"), F.count_if(F.col("status") == "unresolved").cast("double").alias("open")).select(F.create_map(F.lit("trace_bins"), "bins", F.lit("unresolved_picks"), "open").alias("run"))
    # Three rows of a few entries each.
    document = listed.join(F.broadcast(shares)).join(F.broadcast(whole)).select(F.to_json(F.struct("picks", "review_coverage", "run")).alias("document"))
    back = document.select(F.explode(F.from_json("document", "map<string,map<string,double>>")).alias("section", "values"))
    return back.select("section", F.explode("values").alias("name", "value"))


@register(
    "benchmark_runs",
    f"""WITH {SQL_RUN}, c AS (SELECT 'default' AS config, label, layer, i, k, pole, conf, rk, rpole FROM run UNION ALL SELECT 'alternative', label, layer, i, ak, apole, conf, rk, rpole FROM run), m AS (SELECT config, label, layer, count(*) AS n, count(*) FILTER (WHERE k IS NOT NULL AND conf >= 0.4) AS accepted, count(*) FILTER (WHERE k IS NOT NULL AND conf >= 0.4 AND abs(k - rk) <= 3 AND pole = rpole) AS agree, round(avg(abs(k - rk)) FILTER (WHERE k IS NOT NULL AND conf >= 0.4), 6) AS mae FROM c GROUP BY 1, 2, 3),
    g AS (SELECT config, layer, count(*) AS roads, CAST(sum(n) AS BIGINT) AS n, round(sum(agree) / nullif(sum(accepted), 0), 6) AS pooled, round(avg(agree / nullif(accepted, 0)), 6) AS macro, round(min(agree / nullif(accepted, 0)), 6) AS worst, round(sum(accepted) / sum(n), 6) AS coverage FROM m GROUP BY 1, 2) SELECT *, concat_ws(';', CASE WHEN macro < 0.6 THEN 'agreement' END, CASE WHEN coverage < 0.5 THEN 'coverage' END, CASE WHEN worst < 0.4 THEN 'worst_road' END) AS reasons, row_number() OVER (PARTITION BY layer ORDER BY macro DESC, coverage DESC, config) AS rank FROM g""",
)
def benchmark_runs(spark, d):
    """Every configuration on every road and layer: agreement pooled, by road and at worst, gates with reasons, and the order of the configurations."""
    r = run(spark, d)
    pick = lambda name, k, pole: F.struct(F.lit(name).alias("config"), F.col(k).alias("p"), F.col(pole).alias("q"))
    c = r.select("label", "layer", "conf", "rk", "rpole", F.inline(F.array(pick("default", "k", "pole"), pick("alternative", "ak", "apole"))))
    take = F.col("p").isNotNull() & (F.col("conf") >= 0.4)
    off = F.abs(F.col("p") - F.col("rk"))
    m = c.groupBy("config", "label", "layer").agg(F.count("*").alias("n"), F.count_if(take).alias("accepted"), F.count_if(take & (off <= 3) & (F.col("q") == F.col("rpole"))).alias("agree"))
    share = F.try_divide("agree", "accepted")
    g = m.groupBy("config", "layer").agg(F.count("*").alias("roads"), F.sum("n").alias("n"), F.round(F.try_divide(F.sum("agree"), F.sum("accepted")), 6).alias("pooled"), F.round(F.avg(share), 6).alias("macro"), F.round(F.min(share), 6).alias("worst"), F.round(F.sum("accepted") / F.sum("n"), 6).alias("coverage"))
    reasons = F.concat_ws(";", F.when(F.col("macro") < 0.6, "agreement"), F.when(F.col("coverage") < 0.5, "coverage"), F.when(F.col("worst") < 0.4, "worst_road"))
    return g.withColumn("reasons", reasons).withColumn("rank", F.row_number().over(Window.partitionBy("layer").orderBy(F.desc("macro"), F.desc("coverage"), "config")))


@register(
    "selective_risk_report",
    f"""{SQL_SCORED}, e AS (SELECT * FROM s WHERE NOT supplied), o AS (SELECT layer, score, correct, status, rank() OVER (PARTITION BY layer ORDER BY round(score, 9) DESC) AS place, count(*) OVER (PARTITION BY layer) AS n, sum(CASE WHEN correct THEN 0 ELSE 1 END) OVER (PARTITION BY layer ORDER BY round(score, 9) DESC) AS wrong, count(*) OVER (PARTITION BY layer ORDER BY round(score, 9) DESC) AS taken FROM e),
    b AS (SELECT layer, least(CAST(floor(score * 10) AS INTEGER), 9) AS bin, count(*) AS m, avg(score) AS s, avg(CASE WHEN correct THEN 1.0 ELSE 0.0 END) AS c FROM e GROUP BY 1, 2), k AS (SELECT layer, round(sum(m * abs(s - c)) / sum(m), 6) AS calibration_error FROM b GROUP BY 1)
    SELECT o.layer, max(n) AS eligible, round(avg(wrong / taken), 6) AS area, round(coalesce(max(taken / n) FILTER (WHERE wrong <= 0.35 * taken), 0), 6) AS coverage_35, round(coalesce(max(taken / n) FILTER (WHERE wrong <= 0.4 * taken), 0), 6) AS coverage_40, any_value(calibration_error) AS calibration_error, count(*) FILTER (WHERE status = 'review') AS review, count(*) FILTER (WHERE status = 'unresolved') AS unresolved FROM o JOIN k ON k.layer = o.layer GROUP BY 1""",
)
def selective_risk_report(spark, d):
    """How risk falls with selection, by layer: area under the curve, the widest coverage under a risk, the error of scores as probabilities, and what stays open."""
    e = scored(spark, d).filter("not supplied").withColumn("q", F.round("score", 9))
    # Picks of equal score are taken together: the curve needs one row a score, which is all that a layer's window sorts.
    levels = e.groupBy("layer", "q").agg(F.count("*").alias("m"), F.count_if(~F.col("correct")).alias("w"))
    w = Window.partitionBy("layer").orderBy(F.desc("q"))
    n = F.sum("m").over(Window.partitionBy("layer"))
    curve = levels.select("layer", "m", F.sum("m").over(w).alias("taken"), F.sum("w").over(w).alias("wrong"), n.alias("n"))
    widest = lambda risk: F.round(F.coalesce(F.max(F.when(F.col("wrong") <= risk * F.col("taken"), F.col("taken") / F.col("n"))), F.lit(0.0)), 6)
    c = curve.groupBy("layer").agg(F.max("n").alias("eligible"), F.round(F.sum(F.col("m") * F.col("wrong") / F.col("taken")) / F.sum("m"), 6).alias("area"), widest(0.35).alias("coverage_35"), widest(0.4).alias("coverage_40"))
    b = e.groupBy("layer", F.least(F.floor(F.col("score") * 10), F.lit(9)).alias("bin")).agg(F.count("*").alias("m"), F.avg("score").alias("s"), F.avg(F.col("correct").cast("double")).alias("c"))
    k = b.groupBy("layer").agg(F.round(F.sum(F.col("m") * F.abs(F.col("s") - F.col("c"))) / F.sum("m"), 6).alias("calibration_error"))
    o = e.groupBy("layer").agg(F.count_if(F.col("status") == "review").alias("review"), F.count_if(F.col("status") == "unresolved").alias("unresolved"))
    return c.join(k, "layer").join(o, "layer")


@register(
    "dataset_build",
    """WITH f AS (SELECT c_custkey AS path, sha256(CAST(c_custkey % 700 AS VARCHAR)) AS sha, sha256('l' || c_custkey % 350) AS label_sha, c_custkey % 4 <> 1 AS processed, c_custkey % 6 <> 2 AS paired, c_acctbal > -500 AS spaced, c_nationkey AS road_group FROM customer), b AS (SELECT DISTINCT sha256('l' || s_suppkey) AS denied FROM supplier), x AS (SELECT f.*, CASE WHEN NOT processed THEN 'not_processed' WHEN NOT paired THEN 'paired_labels_missing' WHEN b.denied IS NOT NULL THEN 'prohibited_or_evaluation_only' WHEN NOT spaced THEN 'missing_physical_spacing' END AS reason FROM f LEFT JOIN b ON b.denied = f.label_sha),
    y AS (SELECT *, CASE WHEN reason IS NULL AND row_number() OVER (PARTITION BY sha, label_sha, reason IS NULL ORDER BY path) > 1 THEN 'copy' ELSE reason END AS why FROM x) SELECT road_group, coalesce(why, 'record') AS status, count(*) AS files FROM y GROUP BY 1, 2""",
)
def dataset_build(spark, d):
    """What becomes of every file: one record for each content with its labels, copies as aliases, and the reasons why the others are no records."""
    key = F.col("c_custkey")
    f = read(spark, d, "customer").select(key.alias("path"), F.sha2((key % 700).cast("string"), 256).alias("sha"), F.sha2(F.concat(F.lit("l"), (key % 350).cast("string")), 256).alias("label_sha"), (key % 4 != 1).alias("processed"), (key % 6 != 2).alias("paired"), (F.col("c_acctbal") > -500).alias("spaced"), F.col("c_nationkey").alias("road_group"))
    denied = read(spark, d, "supplier").select(F.sha2(F.concat(F.lit("l"), F.col("s_suppkey").cast("string")), 256).alias("label_sha"), F.lit(True).alias("denied")).distinct()
    x = f.join(denied, "label_sha", "left").withColumn("reason", F.when(~F.col("processed"), "not_processed").when(~F.col("paired"), "paired_labels_missing").when(F.col("denied"), "prohibited_or_evaluation_only").when(~F.col("spaced"), "missing_physical_spacing"))
    # The first path of each content and its labels is the record: an aggregate that is combined before its shuffle.
    first = x.filter("reason is null").groupBy("sha", "label_sha").agg(F.min("path").alias("record"))
    y = x.join(first, ["sha", "label_sha"], "left").withColumn("status", F.when(F.col("reason").isNotNull(), F.col("reason")).when(F.col("path") != F.col("record"), "copy").otherwise("record"))
    return y.groupBy("road_group", "status").agg(F.count("*").alias("files"))


@register(
    "episode_index",
    f"""WITH {SQL_CANDIDATES}, a AS (SELECT label, label % 6 AS road_group, max(n) AS extent, md5(CAST(label AS VARCHAR)) AS sha FROM trace GROUP BY 1, 2), c AS (SELECT road_group, arg_max(label, (extent, sha)) AS label FROM a WHERE road_group <> 5 GROUP BY 1), l AS (SELECT DISTINCT c.road_group, c.label, cand.i, CASE WHEN cand.k BETWEEN 6 AND 30 THEN 1 WHEN cand.k BETWEEN 36 AND 58 THEN 2 END AS layer FROM c JOIN cand ON cand.label = c.label), b AS (SELECT layer, road_group, label, i // 10 AS block, count(*) AS labels FROM l WHERE layer IS NOT NULL GROUP BY 1, 2, 3, 4), g AS (SELECT layer, count(DISTINCT road_group) AS groups FROM b GROUP BY 1)
    SELECT b.layer, b.road_group, b.label, b.block, labels, block % 5 = 4 AS validation, round(1.0::DOUBLE / groups / count(*) OVER (PARTITION BY b.layer, b.road_group, block % 5 = 4), 9) AS share FROM b JOIN g ON g.layer = b.layer WHERE groups >= 2""",
)
def episode_index(spark, d):
    """Blocks that training episodes are drawn from, and each one's share: layers, their roads and the blocks of a road count alike, one acquisition a road, none of the road held out."""
    rows = read(spark, d, "embeddings").groupBy("label").agg(F.count("*").alias("extent")).withColumn("road_group", F.col("label") % 6).withColumn("sha", F.md5(F.col("label").cast("string")))
    chosen = rows.filter("road_group <> 5").groupBy("road_group").agg(F.max_by("label", F.struct("extent", "sha")).alias("label"))
    c = candidates(spark, d).withColumn("layer", F.when(F.col("k").between(6, 30), 1).when(F.col("k").between(36, 58), 2)).filter("layer is not null")
    b = c.join(chosen, "label").select("layer", "road_group", "label", "i").distinct().groupBy("layer", "road_group", "label", F.expr("i div 10").alias("block")).agg(F.count("*").alias("labels"))
    g = b.groupBy("layer").agg(F.countDistinct("road_group").alias("groups")).filter("groups >= 2")
    valid = F.col("block") % 5 == 4
    within = F.count("*").over(Window.partitionBy("layer", "road_group", "validation"))
    return b.withColumn("validation", valid).join(g, "layer").select("layer", "road_group", "label", "block", "labels", "validation", F.round(F.lit(1.0) / F.col("groups") / within, 9).alias("share"))
