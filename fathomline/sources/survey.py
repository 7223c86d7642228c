"""Text, XML, CSV and JSON inputs of surveys."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.physics import degrees, parsed_thickness


def positions(spark: SparkSession, path: str) -> DataFrame:
    """(path, trace, utc, latitude, longitude, altitude_m, fix_quality, satellites) of position files.

    A line ``$GSSIS,<trace>`` names the trace of the next ``$GPGGA`` line with a fix; any other line between clears it.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.monotonically_increasing_id().alias("line"), F.split("value", ",").alias("f"))
    kind = F.get("f", F.lit(0))
    w = Window.partitionBy("path").orderBy("line")
    before = F.lag("f").over(w)
    gga = lines.withColumn("b", before).filter((kind == "$GPGGA") & (F.get("b", F.lit(0)) == "$GSSIS"))
    at = lambda i: F.get("f", F.lit(i))
    rows = gga.select("path", F.get("b", F.lit(1)).try_cast("long").alias("trace"), at(1).alias("utc"), degrees(at(2).try_cast("double"), at(3)).alias("latitude"), degrees(at(4).try_cast("double"), at(5)).alias("longitude"), at(9).try_cast("double").alias("altitude_m"), at(6).try_cast("int").alias("fix_quality"), at(7).try_cast("int").alias("satellites"))
    return rows.filter("trace is not null and fix_quality > 0 and latitude is not null and longitude is not null")


def layer_picks(spark: SparkSession, path: str) -> DataFrame:
    """(path, layer, name, trace, sample, channel, property, time_ns, amplitude, depth, velocity) of metadata XML."""
    schema = "layerNum int, groupName string, LayerWayPt array<struct<scanSampChanProp string, timeAmpDepVel string>>"
    groups = spark.read.format("xml").option("rowTag", "LayerGroup").schema(schema).load(path).select(F.col("_metadata.file_path").alias("path"), F.col("layerNum").alias("layer"), F.col("groupName").alias("name"), F.explode("LayerWayPt").alias("p"))
    whole, real = F.split("p.scanSampChanProp", ","), F.split("p.timeAmpDepVel", ",")
    ints = [F.trim(F.get(whole, F.lit(i))).try_cast("int").alias(n) for i, n in enumerate(("trace", "sample", "channel", "property"))]
    floats = [F.trim(F.get(real, F.lit(i))).try_cast("double").alias(n) for i, n in enumerate(("time_ns", "amplitude", "depth", "velocity"))]
    strict = groups.withColumn("_ok", (F.size(whole) == 4) & (F.size(real) == 4))
    return strict.select("path", "layer", "name", *ints, *floats, F.assert_true(F.col("_ok"), F.lit("a pick needs four integers and four numbers")).alias("_a")).drop("_a")


def design_schedule(spark: SparkSession, path: str) -> DataFrame:
    """Design segments of a CSV schedule. Rows without a start are skipped, missing tolerances are 10 % of the thickness."""
    needed = ["road_id", "start_chainage_m", "end_chainage_m", "layer_name", "design_thickness_mm"]
    raw = spark.read.option("header", True).csv(path)
    names = {c.lstrip("﻿").strip(): c for c in raw.columns}
    if missing := [c for c in needed if c not in names]:
        raise ValueError(f"schedule lacks {missing}")
    col = lambda c: F.col(f"`{names[c]}`") if c in names else F.lit(None).cast("string")
    thick = parsed_thickness(col("design_thickness_mm"))
    out = raw.select(col("road_id").alias("road_id"), col("start_chainage_m").try_cast("double").alias("start_m"), col("end_chainage_m").try_cast("double").alias("end_m"), F.trim(col("layer_name")).alias("layer"), thick.alias("thickness_mm"), F.coalesce(col("tolerance_low_mm").try_cast("double"), thick * 0.9).alias("low_mm"), F.coalesce(col("tolerance_high_mm").try_cast("double"), thick * 1.1).alias("high_mm"))
    return out.filter("start_m is not null")


SEEDS = "schema_version int, survey_id string, layers map<string,string>, stations array<struct<station_id string, chainage_m double, role string, picks map<string,struct<sample_index double, visibility string, user_confirmed boolean, canonical_sample_index double, phase_class int, analytic_phase_rad double, polarity int, selected_lobe string, pulse_width_samples double, event_id string, regime_id string>>>>"
#: What a visible pick must say of its wavelet.
IDENTITY = ("canonical_sample_index", "phase_class", "analytic_phase_rad", "polarity", "selected_lobe", "pulse_width_samples", "event_id", "regime_id")


def seeds(spark: SparkSession, path: str, lines: bool = False, identity: bool = False) -> DataFrame:
    """(survey_id, station_id, chainage_m, role, layer, sample, visibility) of confirmed seed files of version 4, with ``lines`` a document a line; other versions and broken rows fail the read.

    With ``identity`` a visible pick must also have all of IDENTITY, phases in eighths and a positive pulse, stations are unique in their survey, and these columns
    are read as well.
    """
    doc = spark.read.schema(SEEDS).option("multiLine", not lines).option("mode", "FAILFAST").json(path)
    rows = doc.select("schema_version", "survey_id", F.explode("stations").alias("s")).select("schema_version", "survey_id", "s.*").select("*", F.explode("picks").alias("layer", "p"))
    sound = (F.col("schema_version") == 4) & (F.col("chainage_m") >= 0) & (F.col("p.sample_index").isNull() | (F.col("p.sample_index") >= 0)) & F.col("p.user_confirmed")
    if identity:
        told = F.lit(True)
        for name in IDENTITY:
            told = told & F.col(f"p.{name}").isNotNull()
        told = told & F.col("p.phase_class").between(0, 7) & F.col("p.polarity").between(-1, 1) & (F.col("p.pulse_width_samples") > 0) & (F.col("p.canonical_sample_index") >= 0)
        once = F.count("*").over(Window.partitionBy("survey_id", "station_id", "layer")) == 1
        rows = rows.withColumn("_once", once)
        sound = sound & F.col("_once") & ((F.col("p.visibility") != "visible") | F.coalesce(told, F.lit(False)))
    checked = rows.withColumn("_ok", sound).withColumn("_a", F.assert_true(F.coalesce("_ok", F.lit(False)), F.lit("seed file of another version, or an unconfirmed, negative, repeated or untold pick")))
    sample = F.when(F.col("p.visibility") == "visible", F.col("p.sample_index"))
    more = [F.col(f"p.{name}").alias(name) for name in IDENTITY] if identity else []
    return checked.filter("_a is null").select("survey_id", "station_id", "chainage_m", "role", F.col("layer").cast("int").alias("layer"), sample.alias("sample"), F.col("p.visibility").alias("visibility"), *more)


def inventory(spark: SparkSession, path: str) -> DataFrame:
    """(path, stem, kind, length, sha256) of all files below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    name = F.element_at(F.split("path", "/"), -1)
    return files.select("path", F.regexp_replace(name, r"\.[^.]*$", "").alias("stem"), F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1)).alias("kind"), "length", F.sha2("content", 256).alias("sha256"))


def catalogue(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(surveys with their companions, files that accompany none): companions have a survey's stem."""
    surveys = files.filter("kind = 'dzt'").select("stem", F.col("path").alias("survey"), "sha256")
    others = files.filter("kind in ('dzg', 'dzx')").select("stem", "kind", "path")
    attached = others.groupBy("stem").agg(F.min(F.when(F.col("kind") == "dzg", F.col("path"))).alias("positions"), F.min(F.when(F.col("kind") == "dzx", F.col("path"))).alias("metadata"))
    return surveys.join(attached, "stem", "left"), others.join(surveys.select("stem"), "stem", "left_anti")


CHECKPOINTS = "schema_version int, survey_id string, selection_source string, checkpoints array<struct<checkpoint_id string, layer_order int, chainage_m double, sample_index double, canonical_sample_index double, visibility string, user_confirmed boolean, selected_lobe string, event_family_id string, regime_id string, pulse_width_samples double, source string>>"


def checkpoints(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """(survey_id, checkpoint fields) of blinded checkpoint files of version 1; anything unconfirmed, repeated or out of range fails the read.

    A missing canonical sample is the sample, a missing regime ``default``, a missing pulse 7.
    """
    doc = spark.read.schema(CHECKPOINTS).option("multiLine", not lines).option("mode", "FAILFAST").json(path)
    ids = F.transform("checkpoints", lambda c: F.trim(c["checkpoint_id"]))
    whole = (F.col("schema_version") == 1) & (F.col("selection_source") == "radar_only") & (F.trim("survey_id") != "") & (F.size("checkpoints") > 0) & (F.size(F.array_distinct(ids)) == F.size("checkpoints")) & ~F.exists(ids, lambda i: i.isNull() | (i == ""))
    rows = doc.select("survey_id", F.coalesce(whole, F.lit(False)).alias("_w"), F.inline_outer("checkpoints"))
    positive = lambda c, least: F.col(c).isNull() | (F.col(c) >= least) & (F.col(c) < float("inf"))
    one = F.col("user_confirmed") & F.col("layer_order").between(1, 3) & (F.col("chainage_m") >= 0) & positive("sample_index", 0) & positive("canonical_sample_index", 0) & (F.col("pulse_width_samples").isNull() | (F.col("pulse_width_samples") > 0)) & ((F.coalesce("visibility", F.lit("visible")) != "visible") | F.col("sample_index").isNotNull()) & F.coalesce("visibility", F.lit("visible")).isin("visible", "uncertain", "not_visible", "absent")
    checked = rows.withColumn("_a", F.assert_true(F.col("_w") & F.coalesce(one, F.lit(False)), F.lit("not a confirmed checkpoint file of version 1")))
    return checked.filter("_a is null").select("survey_id", "checkpoint_id", "layer_order", "chainage_m", "sample_index", F.coalesce("canonical_sample_index", "sample_index").alias("canonical_sample_index"), F.coalesce("visibility", F.lit("visible")).alias("visibility"), "selected_lobe", "event_family_id", F.coalesce("regime_id", F.lit("default")).alias("regime_id"), F.coalesce("pulse_width_samples", F.lit(7.0)).alias("pulse_width_samples"), F.coalesce("source", F.lit("radar_only")).alias("source"))


NATIVE = "schema string, mode string, dzt_sha256 string, observations map<string,array<struct<trace long, sample int, channel int>>>"


def native_observations(documents: DataFrame, traces: DataFrame) -> DataFrame:
    """(file, layer, trace, sample, polarity, phase_class, width, lobe) of native seed documents, checked against the traces that they name.

    ``documents`` has (file, document, sha256), the file's own hash; ``traces`` (file, trace, channel, samples). A document of
    another schema or file, an unknown layer, a place off the grid or a repeated row of a layer fails. The width is that of the lobe: the run of
    one sign around the sample. The phase is that of the analytic signal, as one of eight classes.
    """
    read = documents.select("file", "sha256", F.from_json("document", NATIVE).alias("d"))
    bound = (F.col("d.schema") == "conventional-native-seeds-v1") & (F.col("d.mode") == "processed") & (F.col("d.dzt_sha256") == F.col("sha256"))
    checked = read.withColumn("_a", F.assert_true(F.coalesce(bound, F.lit(False)), F.lit("seeds of another schema or file"))).filter("_a is null")
    points = checked.select("file", F.explode("d.observations").alias("layer", "p")).select("file", F.col("layer").try_cast("int").alias("layer"), F.inline("p"))
    at = points.join(traces.select("file", "trace", F.col("channel").alias("_c"), F.col("samples").cast("array<double>").alias("x")).filter("_c = 0"), ["file", "trace"], "left")
    once = F.count("*").over(Window.partitionBy("file", "layer", "trace"))
    sound = F.col("layer").between(1, 3) & (F.col("channel") == 0) & F.col("x").isNotNull() & (F.col("sample") >= 0) & (F.col("sample") < F.size("x")) & (once == 1)
    kept = at.withColumn("_ok", sound).withColumn("_a", F.assert_true(F.coalesce("_ok", F.lit(False)), F.lit("an observation off the grid or given twice"))).filter("_a is null")
    sign = F.signum(F.get("x", F.col("sample")))
    other = F.transform("x", lambda v, k: F.when(F.signum(v) != sign, k))
    left = F.coalesce(F.array_max(F.filter(other, lambda k: k < F.col("sample"))), F.lit(-1))
    right = F.coalesce(F.array_min(F.filter(other, lambda k: k > F.col("sample"))), F.size("x"))
    return kept.select("file", "layer", "trace", "sample", sign.cast("int").alias("polarity"), phase_class(F.get("x", F.col("sample")), hilbert_at(F.col("x"), F.col("sample"))).alias("phase_class"), F.when(sign == 0, 1).otherwise(right - left - 1).cast("int").alias("width"), F.when(sign < 0, "negative_trough").otherwise("positive_peak").alias("lobe"))


def hilbert_at(x: Column, at: Column) -> Column:
    """The imaginary part of the analytic signal of an array of even length at one place: a sum over every second sample."""
    n = F.size(x)
    terms = F.transform(x, lambda v, k: F.when((at - k) % 2 != 0, v * (2 / n) / F.tan(F.lit(math.pi) * (at - k) / n)).otherwise(0.0))
    return F.aggregate(terms, F.lit(0.0), lambda s, v: s + v)


def phase_class(real: Column, imaginary: Column) -> Column:
    """The eighth of the circle, from -pi on, in which a phase lies."""
    return F.least(F.floor((F.atan2(imaginary, real) + math.pi) * 8 / (2 * math.pi)), F.lit(7)).cast("int")


def support_of_evaluation(evaluated: DataFrame, reviewed: DataFrame) -> DataFrame:
    """(file, layer, trace, sample) of the older form: an evaluation's seed rows, multiplied by its stride, with the samples that were reviewed there.

    ``evaluated`` has (file, method, layer, seed_row, stride), ``reviewed`` (file, layer, trace, sample). All methods of a file must name the same rows, and each must
    be exactly a reviewed trace; anything else fails.
    """
    rows = evaluated.select("file", "method", "layer", (F.col("seed_row").cast("long") * F.col("stride")).alias("trace"), (F.col("stride") >= 1).alias("_sound")).distinct()
    methods = rows.groupBy("file").agg(F.countDistinct("method").alias("_methods"))
    named = rows.groupBy("file", "layer", "trace").agg(F.countDistinct("method").alias("_by"), F.bool_and("_sound").alias("_sound")).join(methods, "file")
    known = reviewed.select("file", "layer", "trace", "sample").distinct()
    met = named.join(known, ["file", "layer", "trace"], "left").withColumn("_a", F.assert_true(F.col("_sound") & (F.col("_by") == F.col("_methods")), F.lit("methods differ in their seeds, or a stride is not positive")))
    met = met.withColumn("_b", F.assert_true(F.col("sample").isNotNull(), F.lit("a prior seed is no reviewed observation")))
    return met.filter("_a is null and _b is null").select("file", "layer", "trace", "sample")


def support(given: DataFrame, reviewed: DataFrame, stride: int) -> DataFrame:
    """(file, layer, row, sample): seeds of a file's layers on a grid of every ``stride``-th trace.

    ``given`` and ``reviewed`` have (file, layer, trace, sample). Every seed must be exactly a reviewed observation and stand on the grid, no trace of a
    layer may be given twice, and every reviewed layer must have seeds: nothing is snapped, anything else fails.
    """
    w = Window.partitionBy("file", "layer", "trace")
    known = reviewed.select("file", "layer", "trace", "sample").distinct().withColumn("_known", F.lit(True))
    # A layer without seeds stays as a row without a trace, which no observation equals.
    asked = reviewed.select("file", "layer").distinct().join(given.select("file", "layer", "trace", "sample"), ["file", "layer"], "full")
    checked = asked.join(known, ["file", "layer", "trace", "sample"], "left").withColumn("_n", F.count("*").over(w))
    sound = F.coalesce("_known", F.lit(False)) & F.coalesce(F.col("trace") % stride == 0, F.lit(False)) & (F.col("_n") == 1)
    return checked.withColumn("_a", F.assert_true(sound, F.lit("a seed is no reviewed observation on the grid, or a layer has none"))).filter("_a is null").select("file", "layer", F.expr(f"trace div {stride}").alias("row"), F.col("sample").cast("long").alias("sample"))
