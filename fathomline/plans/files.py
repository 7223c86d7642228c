"""Queries over sources and sinks: the driver's tables written as survey files to the shared folder and read back."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from .. import workspace
from ..sources import cache, radar, sinks, store, survey
from .aggregates import SQL_PICKS, picks
from .candidates import SQL_CANDIDATES, candidates, seeds, traces
from .registry import register
from .tables import SQL_EVENTS, events, read

SCALE = 1_000_000
SQL_TRACES = f"t AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS trace, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * {SCALE}) AS BIGINT)) AS s FROM embeddings)"


def _roads(spark, d):
    """(label, vec_id, samples): whole numbers."""
    return read(spark, d, "embeddings").select("label", "vec_id", F.transform(F.col("embedding").cast("array<double>"), lambda x: F.floor(x * SCALE).cast("long")).alias("samples"))


def _written(spark, d):
    """A folder of trace files, one a road, and their manifest. The manifest, a row a file, is kept beside them."""
    folder = workspace.new_folder(spark, "traces")
    made = radar.write_traces(_roads(spark, d), "label", "vec_id", "samples", f"{folder}/roads", fields={"scans_per_meter": 10.0, "range_ns": 15.0, "dielectric": 7.0})
    made.write.parquet(f"{folder}/manifest")
    radar.register(spark)
    return f"{folder}/roads", spark.read.parquet(f"{folder}/manifest")


@register("trace_files", f"WITH {SQL_TRACES} SELECT CAST(label AS INTEGER) AS label, trace, 0 AS channel, list_sum(s)::BIGINT AS total, s[1] AS first, s[64] AS last FROM t")
def trace_files(spark, d):
    """All traces of binary files of the roads, read in chunks of traces."""
    folder, _ = _written(spark, d)
    x = F.transform("samples", lambda v: v.cast("long"))
    rows = spark.read.format("traces").option("path", folder).load()
    return rows.select(F.regexp_extract("file", r"^(\d+)\.", 1).cast("int").alias("label"), "trace", "channel", F.aggregate(x, F.lit(0).cast("long"), lambda s, v: s + v).alias("total"), F.get(x, F.lit(0)).alias("first"), F.get(x, F.lit(63)).alias("last"))


@register("trace_slice", f"WITH {SQL_TRACES} SELECT CAST(label AS INTEGER) AS label, trace, s[1] AS first FROM t WHERE trace BETWEEN 5 AND 11")
def trace_slice(spark, d):
    """A range of traces of one channel: the rest of the files is not read."""
    folder, _ = _written(spark, d)
    rows = spark.read.format("traces").option("path", folder).option("start", 5).option("stop", 12).option("channel", 0).load()
    return rows.select(F.regexp_extract("file", r"^(\d+)\.", 1).cast("int").alias("label"), "trace", F.get("samples", F.lit(0)).cast("long").alias("first"))


@register("pushed_trace_filters", f"WITH {SQL_TRACES} SELECT CAST(label AS INTEGER) AS label, trace, s[1] AS first FROM t WHERE label IN (2, 3, 7) AND trace >= 4 AND trace < 30 AND trace % 2 = 0")
def pushed_trace_filters(spark, d):
    """A predicate on file, trace and channel bounds what is read: three files are opened and a range of their traces read; its last part is Spark's."""
    folder, _ = _written(spark, d)
    wanted = F.col("file").isin("2.dzt", "3.dzt", "7.dzt") & (F.col("trace") >= 4) & (F.col("trace") < 30) & (F.col("channel") == 0) & (F.col("trace") % 2 == 0)
    rows = radar.traces(spark, folder, wanted)
    return rows.select(F.regexp_extract("file", r"^(\d+)\.", 1).cast("int").alias("label"), "trace", F.get("samples", F.lit(0)).cast("long").alias("first"))


@register("trace_stream", f"WITH {SQL_TRACES} SELECT CAST(label AS INTEGER) AS label, trace, list_sum(s)::BIGINT AS total FROM t")
def trace_stream(spark, d):
    """The same files as a stream: what is there goes to a table, a batch at a time, each trace once."""
    folder, _ = _written(spark, d)
    out = workspace.new_folder(spark, "stream")
    x = F.transform("samples", lambda v: v.cast("long"))
    rows = spark.readStream.format("traces").option("path", folder).load().select(F.regexp_extract("file", r"^(\d+)\.", 1).cast("int").alias("label"), "trace", F.aggregate(x, F.lit(0).cast("long"), lambda s, v: s + v).alias("total"))
    rows.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/progress").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{out}/rows")


@register("trace_headers", f"WITH {SQL_TRACES} SELECT label || '.dzt' AS file, count(*) AS traces, 64 AS samples, 32 AS bits, 1 AS channels, 1024 + count(*) * 256 AS length, 7.0::DOUBLE AS dielectric, true AS same_hash FROM t GROUP BY label")
def trace_headers(spark, d):
    """Headers and fingerprints of files, and whether the fingerprint is that of the bytes that were written."""
    folder, manifest = _written(spark, d)
    heads = radar.headers(spark, folder).withColumn("file", F.element_at(F.split("path", "/"), -1))
    return heads.join(manifest.select("file", F.col("sha256").alias("written")), "file").select("file", "traces", "samples", "bits", "channels", "length", F.col("dielectric").cast("double").alias("dielectric"), (F.col("sha256") == F.col("written")).alias("same_hash"))


@register("layer_pick_files", "SELECT l_linenumber AS layer, 'L' || l_linenumber AS name, l_orderkey AS trace, CAST(l_quantity AS INTEGER) AS sample, 0 AS channel, CAST(l_suppkey AS INTEGER) AS property, round(l_extendedprice, 4) AS time_ns, round(l_tax, 4) AS velocity FROM lineitem")
def layer_pick_files(spark, d):
    """Picks as metadata XML, a file a survey with a group for each layer, and back."""
    folder = workspace.new_folder(spark, "picks")
    ints = F.concat_ws(",", "l_orderkey", F.col("l_quantity").cast("int"), F.lit(0), "l_suppkey")
    reals = F.concat_ws(",", F.round("l_extendedprice", 4).cast("string"), F.lit("0"), F.lit("1"), F.round("l_tax", 4).cast("string"))
    point = F.format_string("<LayerWayPt><scanSampChanProp>%s</scanSampChanProp><timeAmpDepVel>%s</timeAmpDepVel></LayerWayPt>", ints, reals)
    lines = read(spark, d, "lineitem").groupBy("l_suppkey", "l_linenumber").agg(F.concat_ws("", F.collect_list(point)).alias("p"))
    group = F.format_string("<LayerGroup><layerNum>%d</layerNum><groupName>L%d</groupName>%s</LayerGroup>", "l_linenumber", "l_linenumber", "p")
    files = lines.groupBy("l_suppkey").agg(F.concat(F.lit("<DZX>\n"), F.concat_ws("\n", F.collect_list(group)), F.lit("\n</DZX>")).cast("binary").alias("content"))
    radar.write_bytes(files.select(F.concat(F.col("l_suppkey").cast("string"), F.lit(".dzx")).alias("file"), "content"), folder).count()
    return survey.layer_picks(spark, folder).select("layer", "name", F.col("trace").cast("long").alias("trace"), "sample", "channel", "property", "time_ns", "velocity")


@register("design_files", "SELECT p_brand AS road_id, (p_partkey * 10)::DOUBLE AS start_m, (p_partkey * 10 + p_size)::DOUBLE AS end_m, p_type AS layer, round(CASE p_partkey % 3 WHEN 0 THEN p_size * 25.4::DOUBLE WHEN 1 THEN p_size * 10.0::DOUBLE ELSE p_size::DOUBLE END, 6) AS thickness_mm, round(CASE WHEN p_partkey % 4 = 0 THEN 1.5::DOUBLE ELSE 0.9::DOUBLE * CASE p_partkey % 3 WHEN 0 THEN p_size * 25.4::DOUBLE WHEN 1 THEN p_size * 10.0::DOUBLE ELSE p_size::DOUBLE END END, 6) AS low_mm FROM part WHERE p_partkey % 7 <> 0")
def design_files(spark, d):
    """Design schedules as CSV with units and blanks, and back."""
    folder, k = workspace.new_folder(spark, "design"), F.col("p_partkey")
    text = F.concat_ws(" ", F.col("p_size").cast("string"), F.when(k % 3 == 0, "in").when(k % 3 == 1, "cm").otherwise("mm"))
    rows = read(spark, d, "part").select(F.col("p_brand").alias("road_id"), F.when(k % 7 != 0, (k * 10).cast("string")).alias("start_chainage_m"), (k * 10 + F.col("p_size")).alias("end_chainage_m"), F.col("p_type").alias("layer_name"), text.alias("design_thickness_mm"), F.when(k % 4 == 0, "1.5").alias("tolerance_low_mm"))
    rows.write.option("header", True).csv(folder)
    return survey.design_schedule(spark, folder).select("road_id", "start_m", "end_m", "layer", F.round("thickness_mm", 6).alias("thickness_mm"), F.round("low_mm", 6).alias("low_mm"))


#: Events stand for picks of stations: a user is a survey, an hour a station, the kind of event its layer.
SQL_STATIONS = f"{SQL_EVENTS}, sp AS (SELECT user_id, sec // 3600 AS hour, CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 ELSE 3 END AS layer, max(value) AS sample, CASE WHEN min(event_id) % 6 = 5 THEN 'absent' ELSE 'visible' END AS visibility, CASE WHEN min(event_id) % 10 = 0 THEN 'correction' ELSE 'seed' END AS role, min(event_id) % 8 // 7 AS lobe, min(event_id) AS first FROM ev GROUP BY 1, 2, 3)"


def _stations(spark, d):
    kind = F.when(F.col("event_type") == "view", 1).when(F.col("event_type") == "click", 2).otherwise(3)
    g = events(spark, d).groupBy(F.col("user_id").cast("string").alias("survey_id"), F.expr("sec div 3600").alias("hour"), kind.alias("layer")).agg(F.max("value").alias("sample"), F.min("event_id").alias("first"))
    return g.select("survey_id", F.col("hour").cast("string").alias("station_id"), F.col("hour").cast("double").alias("chainage_m"), F.when(F.col("first") % 10 == 0, "correction").otherwise("seed").alias("role"), "layer", F.when(F.col("first") % 6 == 5, "absent").otherwise("visible").alias("visibility"), "sample", F.lit("default").alias("regime"), F.expr("first % 8 div 7").cast("string").alias("lobe"), F.lit(1).alias("polarity"), F.lit(0).alias("phase_class"))


_CLASH = "c AS (SELECT user_id, layer, hour, lobe, first_value(lobe) OVER (PARTITION BY user_id, layer ORDER BY hour) AS head FROM sp WHERE role <> 'correction' AND visibility = 'visible'), x AS (SELECT DISTINCT user_id, layer FROM c WHERE lobe <> head)"


@register("seed_conflicts", f"WITH {SQL_STATIONS}, {_CLASH} SELECT CAST(user_id AS VARCHAR) AS survey_id, layer, 'default' AS regime FROM x")
def seed_conflicts(spark, d):
    """Layers of surveys whose seeds stand on different lobes."""
    return sinks.seed_conflicts(_stations(spark, d))


@register("seed_files", f"WITH {SQL_STATIONS}, {_CLASH}, ok AS (SELECT * FROM sp WHERE user_id NOT IN (SELECT user_id FROM x)) SELECT CAST(user_id AS VARCHAR) AS survey_id, CAST(hour AS VARCHAR) AS station_id, role, layer, visibility, CASE WHEN visibility = 'visible' THEN round(sample, 6) END AS sample, CAST(lobe AS VARCHAR) AS selected_lobe, hour || ':' || layer AS event_id FROM ok")
def seed_files(spark, d):
    """Seed documents of surveys without conflicts, written as JSON and read back with their checks."""
    folder = workspace.new_folder(spark, "seeds")
    sinks.seed_documents(_stations(spark, d)).select(F.col("document").alias("value")).write.text(folder)
    rows = survey.seeds(spark, folder, lines=True, identity=True)
    return rows.select("survey_id", "station_id", "role", "layer", "visibility", F.round("sample", 6).alias("sample"), "selected_lobe", "event_id")


@register("checkpoint_files", f"WITH {SQL_EVENTS} SELECT CAST(user_id AS VARCHAR) AS survey_id, 'c' || event_id AS checkpoint_id, CAST(event_id % 3 + 1 AS INTEGER) AS layer_order, CASE WHEN event_id % 5 = 0 THEN NULL ELSE round(value, 6) END AS sample_index, CASE WHEN event_id % 5 = 0 THEN NULL ELSE round(value + CASE WHEN event_id % 2 = 0 THEN 1 ELSE 0 END, 6) END AS canonical_sample_index, CASE WHEN event_id % 5 = 0 THEN 'absent' ELSE 'visible' END AS visibility, 'default' AS regime_id, 7.0::DOUBLE AS pulse_width_samples FROM ev")
def checkpoint_files(spark, d):
    """Blinded checkpoints as JSON documents and back: what is missing gets its stated value."""
    folder, gone = workspace.new_folder(spark, "checkpoints"), F.col("event_id") % 5 == 0
    points = events(spark, d).select(F.col("user_id").cast("string").alias("survey_id"), F.concat(F.lit("c"), "event_id").alias("checkpoint_id"), (F.col("event_id") % 3 + 1).cast("int").alias("layer_order"), F.col("sec").cast("double").alias("chainage_m"), F.when(~gone, F.col("value")).alias("sample_index"), F.when(~gone & (F.col("event_id") % 2 == 0), F.col("value") + 1).alias("canonical_sample_index"), F.when(gone, "absent").otherwise("visible").alias("visibility"), F.lit(True).alias("user_confirmed"))
    sinks.checkpoint_documents(points).select(F.col("document").alias("value")).write.text(folder)
    rows = survey.checkpoints(spark, folder, lines=True)
    return rows.select("survey_id", "checkpoint_id", "layer_order", F.round("sample_index", 6).alias("sample_index"), F.round("canonical_sample_index", 6).alias("canonical_sample_index"), "visibility", "regime_id", "pulse_width_samples")


@register(
    "native_seed_files",
    f"""WITH {SQL_CANDIDATES}, {SQL_TRACES}, o AS (SELECT t.label, t.trace, seed.s, t.s AS x FROM seed JOIN t ON t.label = seed.label AND t.trace = seed.i), q AS (SELECT label, trace, s, sign(x[s + 1]) AS pole, x[s + 1]::DOUBLE AS re, list_sum(list_transform(range(0, 64), lambda k: CASE WHEN (s - k) % 2 <> 0 THEN x[k + 1] * (2 / 64.0::DOUBLE) / tan({math.pi} * (s - k) / 64) ELSE 0.0 END)) AS im,
    list_max(list_transform(range(0, 64), lambda k: CASE WHEN k < s AND sign(x[k + 1]) <> sign(x[s + 1]) THEN k END)) AS lo, list_min(list_transform(range(0, 64), lambda k: CASE WHEN k > s AND sign(x[k + 1]) <> sign(x[s + 1]) THEN k END)) AS hi FROM o)
    SELECT label || '.dzt' AS file, CAST(label % 3 + 1 AS INTEGER) AS layer, trace, s AS sample, CAST(pole AS INTEGER) AS polarity, CAST(least(floor((atan2(im, re) + {math.pi}) * 8 / {2 * math.pi}), 7) AS INTEGER) AS phase_class, CAST(coalesce(hi, 64) - coalesce(lo, -1) - 1 AS INTEGER) AS width, CASE WHEN pole < 0 THEN 'negative_trough' ELSE 'positive_peak' END AS lobe FROM q""",
)
def native_seed_files(spark, d):
    """Native seeds bound to their trace file by its hash; lobe, width and phase come from the file's own traces."""
    folder, manifest = _written(spark, d)
    points = seeds(candidates(spark, d)).groupBy("label").agg(F.collect_list(F.struct(F.col("i").alias("trace"), F.col("s").alias("sample"), F.lit(0).alias("channel"))).alias("p"))
    observed = F.create_map((F.col("label") % 3 + 1).cast("string"), F.col("p"))
    named = points.select(F.concat(F.col("label").cast("string"), F.lit(".dzt")).alias("file"), observed.alias("observations")).join(manifest.select("file", "sha256"), "file")
    documents = named.select("file", "sha256", F.to_json(F.struct(F.lit("conventional-native-seeds-v1").alias("schema"), F.lit("processed").alias("mode"), F.col("sha256").alias("dzt_sha256"), "observations")).alias("document"))
    return survey.native_observations(documents, spark.read.format("traces").option("path", folder).load())


@register("support_seeds", f"WITH {SQL_CANDIDATES}, b AS (SELECT label, i, arg_min(k, (-score, k)) AS s FROM cand GROUP BY 1, 2) SELECT label AS file, 1 AS layer, i // 4 AS row, CAST(s AS BIGINT) AS sample FROM b WHERE i % 12 = 0")
def support_seeds(spark, d):
    """Seeds on every fourth trace, each exactly a reviewed observation."""
    best = candidates(spark, d).groupBy("label", "i").agg(F.min(F.struct((-F.col("score")).alias("o"), "k")).alias("m")).select(F.col("label").alias("file"), F.lit(1).alias("layer"), F.col("i").alias("trace"), F.col("m.k").cast("long").alias("sample"))
    return survey.support(best.filter("trace % 12 = 0"), best, 4)


@register("support_of_evaluation", f"WITH {SQL_CANDIDATES}, b AS (SELECT label, i, arg_min(k, (-score, k)) AS s FROM cand GROUP BY 1, 2) SELECT label AS file, 1 AS layer, i // 4 AS row, CAST(s AS BIGINT) AS sample FROM b WHERE i % 12 = 0")
def support_of_evaluation(spark, d):
    """The same from an evaluation of two methods on every third trace: its rows times its stride, with the reviewed samples."""
    best = candidates(spark, d).groupBy("label", "i").agg(F.min(F.struct((-F.col("score")).alias("o"), "k")).alias("m")).select(F.col("label").alias("file"), F.lit(1).alias("layer"), F.col("i").alias("trace"), F.col("m.k").cast("long").alias("sample"))
    evaluated = best.filter("trace % 12 = 0").select("file", F.explode(F.array(F.lit("first"), F.lit("second"))).alias("method"), "layer", F.expr("trace div 3").alias("seed_row"), F.lit(3).alias("stride"))
    return survey.support(survey.support_of_evaluation(evaluated, best), best, 4)


@register("survey_inventory", "WITH f AS (SELECT n_nationkey AS k, 'road_' || n_nationkey AS stem FROM nation) SELECT stem, k % 2 = 0 AS has_positions, k % 3 = 0 AS has_metadata, 0 AS orphans FROM f WHERE k % 5 <> 4 UNION ALL SELECT 'none', false, false, count(*) FILTER (WHERE k % 2 = 0) + count(*) FILTER (WHERE k % 3 = 0) FROM f WHERE k % 5 = 4")
def survey_inventory(spark, d):
    """Surveys found below a folder with the companions of their name, and companions of none."""
    folder = workspace.new_folder(spark, "inventory")
    k = F.col("n_nationkey")
    kinds = F.filter(F.array(F.when(k % 5 != 4, "dzt"), F.when(k % 2 == 0, "dzg"), F.when(k % 3 == 0, "dzx")), lambda x: x.isNotNull())
    named = read(spark, d, "nation").select(F.concat(F.lit("road_"), k.cast("string")).alias("stem"), F.explode(kinds).alias("kind"))
    radar.write_bytes(named.select(F.concat_ws(".", "stem", "kind").alias("file"), F.col("stem").cast("binary").alias("content")), folder).count()
    found, orphans = survey.catalogue(survey.inventory(spark, folder))
    rows = found.select("stem", F.col("positions").isNotNull().alias("has_positions"), F.col("metadata").isNotNull().alias("has_metadata"), F.lit(0).cast("long").alias("orphans"))
    return rows.union(orphans.agg(F.count("*").alias("orphans")).select(F.lit("none"), F.lit(False), F.lit(False), "orphans"))


@register(
    "project_store",
    f"WITH {SQL_EVENTS}, r AS (SELECT event_id, user_id, sec, value, row_number() OVER (PARTITION BY user_id ORDER BY sec DESC, event_id DESC) AS back FROM ev WHERE event_type = 'signup') SELECT 1 AS layer, count(*) AS anchors, round(sum(sec) / 1e6, 3) AS places, round(sum(value), 3) AS samples, 2 AS runs, 'second' AS parameters, (SELECT count(*) FROM ev WHERE event_type = 'error') AS decisions, (SELECT count(*) FROM ev WHERE event_type = 'click') AS picks FROM r WHERE back = 1 AND (sec, event_id) <> (SELECT (sec, event_id) FROM ev WHERE event_type = 'signup' ORDER BY sec DESC, event_id DESC LIMIT 1)",
)
def project_store(spark, d):
    """A project's life: stations kept by their latest version, the last one taken back, runs, picks and decisions appended, and all read again."""
    project = store.Project(spark, workspace.new_folder(spark, "project"))
    e = events(spark, d)
    version = F.col("sec") * 10_000_000 + F.col("event_id")
    stations = e.filter("event_type = 'signup'").select(F.col("user_id").cast("string").alias("station_id"), F.col("sec").cast("double").alias("chainage_m"), F.lit("seed").alias("role"), F.to_json(F.create_map(F.lit("1"), "value")).alias("picks"), version.alias("version"), (F.col("event_id") % 2).alias("half"))
    for half in (0, 1):
        part = stations.filter(F.col("half") == half).drop("half")
        project.write("seed_stations", part.groupBy("station_id").agg(F.max_by(F.struct(*part.columns), "version").alias("r")).select("r.*"))
    project.remove_last("seed_stations", "version")
    project.new_run("first")
    number = project.new_run("second")
    project.write("picks", e.filter("event_type = 'click'").select(F.lit(number).alias("run_id"), F.lit(1).alias("layer"), F.col("sec").cast("double").alias("chainage_m"), F.lit("accepted").alias("status"), F.col("value").alias("sample")))
    project.write("review_events", e.filter("event_type = 'error'").select("event_id", F.lit("issue").alias("issue"), F.lit("accept").alias("action"), F.lit("").alias("payload")))
    total = lambda f: F.aggregate(F.transform("anchors", f), F.lit(0.0), lambda s, v: s + v)
    row = project.anchors().select("layer", F.size("anchors").cast("long").alias("anchors"), F.round(total(lambda a: a["chainage_m"]) / 1e6, 3).alias("places"), F.round(total(lambda a: a["sample"]), 3).alias("samples"))
    one = lambda name, out: project.read(name).agg(F.count("*").alias(out))
    latest = project.read("runs").agg(F.count("*").alias("runs"), F.max_by("parameters", "run_id").alias("parameters"))
    # Each of these is one row.
    return row.join(F.broadcast(latest)).join(F.broadcast(one("review_events", "decisions"))).join(F.broadcast(one("picks", "picks")))


@register("geojson_features", "SELECT c_custkey, c_name, c_acctbal / 1000 AS longitude, (c_custkey % 90)::DOUBLE AS latitude FROM customer WHERE c_custkey % 4 <> 0")
def geojson_features(spark, d):
    """Features as GeoJSON text and back; rows without a position have none."""
    folder = workspace.new_folder(spark, "features")
    rows = read(spark, d, "customer").select("c_custkey", "c_name", F.when(F.col("c_custkey") % 4 != 0, F.col("c_acctbal") / 1000).alias("lon"), (F.col("c_custkey") % 90).cast("double").alias("lat"))
    sinks.geojson(rows, "lat", "lon").select(F.col("feature").alias("value")).write.text(folder)
    back = spark.read.schema("geometry struct<coordinates array<double>>, properties struct<c_custkey long, c_name string>").json(folder)
    return back.select("properties.*", F.get("geometry.coordinates", F.lit(0)).alias("longitude"), F.get("geometry.coordinates", F.lit(1)).alias("latitude"))


@register("csv_rows", f"WITH {SQL_EVENTS} SELECT user_id, count(*) AS n, count(DISTINCT event_type) AS kinds, round(sum(value), 4) AS total FROM ev GROUP BY 1")
def csv_rows(spark, d):
    """Rows with arrays and structs as CSV with JSON cells, and back."""
    folder = workspace.new_folder(spark, "rows")
    nested = events(spark, d).groupBy("user_id").agg(F.collect_list(F.struct("event_type", "value")).alias("items"), F.sort_array(F.collect_set("event_type")).alias("kinds"))
    sinks.write_csv(nested, folder)
    back = spark.read.option("header", True).option("escape", '"').schema("user_id long, items string, kinds string").csv(folder)
    items = F.from_json("items", "array<struct<event_type string, value double>>")
    return back.select("user_id", F.size(items).cast("long").alias("n"), F.size(F.from_json("kinds", "array<string>")).cast("long").alias("kinds"), F.round(F.aggregate(items, F.lit(0.0), lambda s, x: s + x["value"]), 4).alias("total"))


def _records(spark, d):
    """(record, trace, samples), and labels (record, layer, trace, sample, amplitude) of which some are broken."""
    rows = _roads(spark, d).join(traces(spark, d).select("vec_id", "i"), "vec_id").select(F.col("label").cast("string").alias("record"), F.col("i").alias("trace"), "samples", "vec_id")
    two = rows.select("record", "trace", "samples", "vec_id", F.inline(F.array(F.struct(F.lit(1).alias("layer"), (F.col("vec_id") * 7 % 40).alias("sample")), F.struct(F.lit(2).alias("layer"), (F.col("vec_id") * 11 % 66).alias("sample")))))
    given = F.coalesce(F.get("samples", F.col("sample").cast("int")), F.lit(0)) + F.when(F.col("vec_id") % 9 == 0, 5).otherwise(0)
    return rows.drop("vec_id"), two.select("record", "layer", "trace", "sample", given.alias("amplitude"))


SQL_LABELS = f"{SQL_TRACES}, l AS (SELECT label, trace, vec_id, s, 1 AS layer, vec_id * 7 % 40 AS k FROM t UNION ALL SELECT label, trace, vec_id, s, 2, vec_id * 11 % 66 FROM t), a AS (SELECT *, CASE WHEN k >= 64 THEN 'off_grid' WHEN vec_id % 9 = 0 THEN 'amplitude' END AS reason FROM l), b AS (SELECT a.*, coalesce(a.reason, CASE WHEN EXISTS (SELECT 1 FROM a o WHERE o.label = a.label AND o.trace = a.trace AND o.reason IS NULL AND (o.layer = a.layer - 1 AND o.k >= a.k OR o.layer = a.layer + 1 AND o.k <= a.k)) THEN 'order' END) AS why FROM a)"


@register("label_audit", f"WITH {SQL_LABELS} SELECT layer, coalesce(why, 'kept') AS reason, count(*) AS n FROM b GROUP BY 1, 2")
def label_audit(spark, d):
    """Why labels are left out of a record: off the grid, unlike the trace, padded, in conflict, out of order."""
    rows, labels = _records(spark, d)
    return cache.label_reasons(labels, rows).groupBy("layer", F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


@register("processed_records", f"WITH {SQL_LABELS} SELECT CAST(t.label AS VARCHAR) AS record, count(*) AS traces, 64 AS samples, (SELECT count(*) FROM b WHERE b.label = t.label AND why IS NULL) AS labels, true AS intact FROM t GROUP BY t.label")
def processed_records(spark, d):
    """Records written with a manifest and opened again, their content checked against its hash."""
    rows, labels = _records(spark, d)
    folder = workspace.new_folder(spark, "records")
    manifest = cache.write_records(rows, labels, folder)
    return manifest.join(cache.verified(spark, folder), "record").select("record", "traces", "samples", "labels", "intact")


@register("audit_package", f"WITH {SQL_PICKS}, a AS (SELECT count(*) AS n, count(*) FILTER (WHERE status = 'unresolved') AS u FROM pick) SELECT 'interface_observations' AS name, n AS rows FROM a UNION ALL SELECT 'review', u FROM a")
def audit_package(spark, d):
    """A run's tables as a folder of CSV and JSON with a manifest of what it holds."""
    rows = picks(spark, d)
    review = rows.filter("status = 'unresolved'").select("l_orderkey", "l_linenumber", "layer")
    about = rows.groupBy("layer").agg(F.avg((F.col("status") != "accepted").cast("double")).alias("share")).agg(F.map_from_entries(F.collect_list(F.struct("layer", "share"))).alias("review_coverage"))
    return sinks.write_package(workspace.new_folder(spark, "package"), {"interface_observations": rows, "review": review}, about)


@register("confirmed_annotations", f"WITH {SQL_EVENTS} SELECT sha256(event_type) AS source_sha256, event_id AS trace_index, 1 AS layer_order, CASE WHEN user_id % 4 = 0 THEN NULL ELSE round(value - 70 + event_id % 9, 6) END AS sample_raw, CASE WHEN user_id % 4 = 0 THEN 'absent' ELSE 'visible' END AS visibility, CASE WHEN event_id % 3 = 0 THEN 'manual_correction' ELSE 'manual' END AS origin, 'allowed' AS training_use FROM ev WHERE event_id % 5 <> 0 AND event_id % 7 <> 0")
def confirmed_annotations(spark, d):
    """Confirmed clicks as annotation rows in the file's own coordinates."""
    e = events(spark, d)
    source = F.sha2(F.col("event_type"), 256)
    clicks = e.select(source.alias("source_sha256"), F.col("event_id").alias("trace_index"), F.lit(1).alias("layer_order"), F.col("value").alias("sample"), F.when(F.col("user_id") % 4 == 0, "absent").otherwise("visible").alias("visibility"), F.when(F.col("event_id") % 3 == 0, "correction").otherwise("seed").alias("role"), (F.col("event_id") % 5 != 0).alias("user_confirmed"), (F.col("event_id") % 7 != 0).alias("current"), F.lit(None).cast("string").alias("lobe"), F.lit(None).cast("double").alias("pulse"))
    surfaces = e.select(source.alias("source_sha256"), F.col("event_id").alias("trace_index"), (F.col("event_id") % 9).alias("surface"), F.lit(70).alias("reference"))
    rows = sinks.annotations(clicks, surfaces, processed=False)
    return rows.select("source_sha256", "trace_index", "layer_order", F.round("sample_raw", 6).alias("sample_raw"), "visibility", "origin", "training_use")
