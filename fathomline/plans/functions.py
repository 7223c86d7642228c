"""Scalar function queries: physics, parsing, JSON, text keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import physics
from .registry import register
from .tables import read


@register(
    "scalar_dielectrics",
    """WITH a AS (SELECT p_partkey, p_size / 5.0::DOUBLE AS twtt, p_retailprice / 3000 AS r, CASE WHEN p_size % 3 = 0 THEN p_size / 2.0::DOUBLE END AS analyst FROM part),
    b AS (SELECT *, CASE WHEN r > 0.01 AND r < 0.85 AND ((1 + r) / (1 - r)) ** 2 BETWEEN 2 AND 30 THEN ((1 + r) / (1 - r)) ** 2 END AS refl FROM a)
    SELECT p_partkey, round(refl, 6) AS reflection, round(coalesce(refl, CASE WHEN analyst > 1 AND analyst <= 40 THEN analyst END, 9.0::DOUBLE), 6) AS dielectric, CASE WHEN refl IS NOT NULL THEN 'reflection' WHEN analyst > 1 AND analyst <= 40 THEN 'analyst' ELSE 'scan' END AS source,
    round(0.299792458 * twtt / (2 * sqrt(coalesce(refl, CASE WHEN analyst > 1 AND analyst <= 40 THEN analyst END, 9.0::DOUBLE))) * 1000, 6) AS thickness,
    round(CASE WHEN 7 * ((1 - 0.04 + r / 10) / (1 - 0.2 + r / 10)) ** 2 BETWEEN 2 AND 30 THEN 7 * ((1 - 0.04 + r / 10) / (1 - 0.2 + r / 10)) ** 2 END, 6) AS below FROM b""",
)
def scalar_dielectrics(spark, d):
    size = F.col("p_size")
    a = read(spark, d, "part").select("p_partkey", (size / 5.0).alias("twtt"), (F.col("p_retailprice") / 3000).alias("r"), F.when(size % 3 == 0, size / 2.0).alias("analyst"))
    refl = physics.surface_dielectric(F.col("r"), F.lit(1.0))
    value, source = physics.resolved_dielectric(F.col("refl"), F.col("analyst"), F.lit(9.0))
    b = a.withColumn("refl", refl)
    return b.select("p_partkey", F.round("refl", 6).alias("reflection"), F.round(value, 6).alias("dielectric"), source.alias("source"), F.round(physics.thickness_mm(F.col("twtt"), value), 6).alias("thickness"), F.round(physics.recursive_dielectric(F.lit(7.0), F.lit(0.2), F.col("r") / 10), 6).alias("below"))


@register(
    "thickness_parsing",
    """WITH t AS (SELECT p_partkey, CASE p_size % 6 WHEN 0 THEN p_size || ' mm' WHEN 1 THEN p_size || 'cm' WHEN 2 THEN p_size || '.5 in' WHEN 3 THEN p_size || '"' WHEN 4 THEN 'about ' || p_size ELSE p_size || ' furlongs' END AS text FROM part),
    e AS (SELECT *, regexp_extract(text, '^\\s*([0-9]+(?:\\.[0-9]+)?)\\s*([a-zA-Z"]*)\\s*$', 1) AS num, lower(regexp_extract(text, '^\\s*([0-9]+(?:\\.[0-9]+)?)\\s*([a-zA-Z"]*)\\s*$', 2)) AS unit FROM t)
    SELECT p_partkey, text, round(TRY_CAST(num AS DOUBLE) * CASE WHEN unit IN ('', 'mm') THEN 1.0 WHEN unit = 'cm' THEN 10.0 WHEN unit IN ('in', 'inch', 'inches', '"') THEN 25.4 END, 6) AS mm FROM e""",
)
def thickness_parsing(spark, d):
    s, n = F.col("p_size"), F.col("p_size").cast("string")
    text = F.when(s % 6 == 0, F.concat(n, F.lit(" mm"))).when(s % 6 == 1, F.concat(n, F.lit("cm"))).when(s % 6 == 2, F.concat(n, F.lit(".5 in"))).when(s % 6 == 3, F.concat(n, F.lit('"'))).when(s % 6 == 4, F.concat(F.lit("about "), n)).otherwise(F.concat(n, F.lit(" furlongs")))
    return read(spark, d, "part").select("p_partkey", text.alias("text")).withColumn("mm", F.round(physics.parsed_thickness(F.col("text")), 6))


@register(
    "gps_coordinates",
    "SELECT s_suppkey, round((floor(p / 100) + (p - floor(p / 100) * 100) / 60) * CASE WHEN s_nationkey % 2 = 0 THEN -1 ELSE 1 END, 6) AS latitude FROM (SELECT s_suppkey, s_nationkey, (s_suppkey % 90) * 100 + abs(s_acctbal) % 60 AS p FROM supplier)",
)
def gps_coordinates(spark, d):
    p = (F.col("s_suppkey") % 90) * 100 + F.abs("s_acctbal") % 60
    return read(spark, d, "supplier").select("s_suppkey", F.round(physics.degrees(p, F.when(F.col("s_nationkey") % 2 == 0, "S").otherwise("N")), 6).alias("latitude"))


@register(
    "phase_class_histogram",
    """WITH c AS (SELECT label, CAST(embedding[k] AS DOUBLE) * 20 AS a, CAST(embedding[k + 1] AS DOUBLE) * 20 AS b FROM embeddings, (SELECT unnest(range(1, 64)) AS k)), m AS (SELECT label, least(CAST(floor((((a + pi()) % (2 * pi())) + 2 * pi()) % (2 * pi()) * 8 / (2 * pi())) AS INTEGER), 7) AS p, least(CAST(floor((((b + pi()) % (2 * pi())) + 2 * pi()) % (2 * pi()) * 8 / (2 * pi())) AS INTEGER), 7) AS q FROM c)
    SELECT label, p AS phase, count(*) AS n, round(avg(least(abs(p - q), 8 - abs(p - q)) / 4.0::DOUBLE), 6) AS mean_distance FROM m GROUP BY 1, 2""",
)
def phase_class_histogram(spark, d):
    arr = F.col("embedding").cast("array<double>")
    pairs = F.explode(F.arrays_zip(F.slice(arr, 1, 63).alias("a"), F.slice(arr, 2, 63).alias("b")))
    rows = read(spark, d, "embeddings").select("label", pairs.alias("z")).select("label", physics.phase_class(F.col("z.a") * 20).alias("phase"), physics.phase_class(F.col("z.b") * 20).alias("q"))
    return rows.groupBy("label", "phase").agg(F.count("*").alias("n"), F.round(F.avg(physics.class_distance(F.col("phase"), F.col("q")) / 4.0), 6).alias("mean_distance"))


@register(
    "canonical_sha256",
    """SELECT n_nationkey, sha256('{"key":' || n_nationkey || ',"name":"' || n_name || '","region":' || n_regionkey || '}') AS digest FROM nation""",
)
def canonical_sha256(spark, d):
    doc = F.to_json(F.struct(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("region")))
    return read(spark, d, "nation").select("n_nationkey", F.sha2(doc, 256).alias("digest"))


@register(
    "seed_json_explode",
    "SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k, CAST(json_extract(props, '$.k') AS INTEGER) BETWEEN 0 AND 80 AS valid FROM events",
)
def seed_json_explode(spark, d):
    k = F.from_json("props", "k int")["k"]
    return read(spark, d, "events").select("event_id", k.alias("k"), k.between(0, 80).alias("valid"))


@register(
    "unpivot_reference_depths",
    """WITH w AS (SELECT c_custkey, abs(c_acctbal) / 100 AS asphalt, abs(c_acctbal) / 100 + c_nationkey AS base, CASE WHEN c_nationkey % 4 <> 0 THEN abs(c_acctbal) / 100 + c_nationkey * 3 END AS subbase FROM customer),
    l AS (SELECT c_custkey, 1 AS layer, asphalt AS depth FROM w UNION ALL SELECT c_custkey, 2, base FROM w UNION ALL SELECT c_custkey, 3, subbase FROM w)
    SELECT c_custkey, layer, round(depth, 6) AS depth, round(depth - coalesce(lag(depth) OVER (PARTITION BY c_custkey ORDER BY layer), 0), 6) AS thickness FROM l WHERE depth IS NOT NULL""",
)
def unpivot_reference_depths(spark, d):
    from pyspark.sql import Window

    depth, n = F.abs("c_acctbal") / 100, F.col("c_nationkey")
    wide = read(spark, d, "customer").select("c_custkey", depth.alias("asphalt"), (depth + n).alias("base"), F.when(n % 4 != 0, depth + n * 3).alias("subbase"))
    long = wide.select("c_custkey", F.expr("stack(3, 1, asphalt, 2, base, 3, subbase) as (layer, depth)")).filter("depth is not null")
    w = Window.partitionBy("c_custkey").orderBy("layer")
    return long.select("c_custkey", "layer", F.round("depth", 6).alias("depth"), F.round(F.col("depth") - F.coalesce(F.lag("depth").over(w), F.lit(0.0)), 6).alias("thickness"))


@register(
    "calibration_tokens",
    "SELECT p_partkey, to_json(list_sort(list_distinct(list_filter(regexp_split_to_array(lower(p_name), '[^a-z0-9]+'), lambda x: x <> '')))) AS tokens, len(list_intersect(list_filter(regexp_split_to_array(lower(p_type), '[^a-z0-9]+'), lambda x: x <> ''), ['promo', 'standard'])) > 0 OR p_size <= 1 AS is_calibration FROM part",
)
def calibration_tokens(spark, d):
    return read(spark, d, "part").select("p_partkey", F.to_json(F.sort_array(physics.tokens(F.col("p_name")))).alias("tokens"), (F.arrays_overlap(physics.tokens(F.col("p_type")), F.array(F.lit("promo"), F.lit("standard"))) | (F.col("p_size") <= 1)).alias("is_calibration"))


@register("road_group_names", "SELECT page_id, regexp_replace(regexp_replace(lower(split_part(split_part(url, '://', 2), '/', 1)), '^(www|m|blog)\\.', ''), '\\.example\\.(com|net|org)$', '') AS road FROM pages")
def road_group_names(spark, d):
    host = F.lower(F.split_part(F.split_part("url", F.lit("://"), F.lit(2)), F.lit("/"), F.lit(1)))
    return read(spark, d, "pages").select("page_id", F.regexp_replace(F.regexp_replace(host, r"^(www|m|blog)\.", ""), r"\.example\.(com|net|org)$", "").alias("road"))


@register(
    "time_coordinates",
    "SELECT l_orderkey, l_linenumber, round(-2.5 + l_quantity * 0.05859375, 6) AS time_ns, round((-2.5 + l_quantity * 0.05859375 + 2.5) / 0.05859375, 6) AS sample, round((l_quantity - 42.666666666666664) * 0.05859375, 6) AS twtt FROM lineitem",
)
def time_coordinates(spark, d):
    """Sample number to time with an origin, back again, and to travel time from the measurement's zero."""
    t = -2.5 + F.col("l_quantity") * 0.05859375
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(t, 6).alias("time_ns"), F.round((t + 2.5) / 0.05859375, 6).alias("sample"), F.round((F.col("l_quantity") - 42.666666666666664) * 0.05859375, 6).alias("twtt"))
