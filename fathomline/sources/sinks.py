"""Outputs: GeoJSON, CSV with nested columns as JSON, manifests, keep-latest tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def geojson(df: DataFrame, latitude: str, longitude: str) -> DataFrame:
    """(feature): one GeoJSON point a row with a position, its other columns as properties."""
    rest = [c for c in df.columns if c not in (latitude, longitude)]
    feature = F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("Point").alias("type"), F.array(longitude, latitude).alias("coordinates")).alias("geometry"), F.struct(*rest).alias("properties"))
    return df.filter(F.col(latitude).isNotNull() & F.col(longitude).isNotNull()).select(F.to_json(feature, {"ignoreNullFields": "false"}).alias("feature"))


def flat(df: DataFrame) -> DataFrame:
    """Arrays, maps and structs as JSON text, for CSV."""
    nested = lambda kind: kind.startswith(("array", "map", "struct"))
    return df.select(*[F.to_json(c).alias(c) if nested(kind) else F.col(c) for c, kind in df.dtypes])


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; quotes inside a cell are doubled."""
    flat(df).write.option("header", True).option("escape", '"').mode("errorifexists").csv(path)


def manifest(df: DataFrame, columns: list[str]) -> Column:
    """sha256 of a row's canonical JSON: columns in the order of their names."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)


def keep_latest(old: DataFrame, new: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Rows of both with the highest version of each key; of equal versions the new one. One aggregate over whole rows, no sort."""
    columns = [c for c in old.columns if c not in (*keys, version)]
    both = old.withColumn("_n", F.lit(0)).unionByName(new.withColumn("_n", F.lit(1)))
    last = both.groupBy(*keys).agg(F.max_by(F.struct(version, *columns), F.struct(version, "_n")).alias("r"))
    return last.select(*keys, "r.*").select(old.columns)


def numbered(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows numbered from 1 within keys."""
    return df.withColumn("n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def seed_conflicts(picks: DataFrame) -> DataFrame:
    """(survey_id, layer, regime) in which visible model seeds name different lobes: another lobe or polarity than the first, or a phase three eighths away.

    ``picks`` has survey_id, station_id, chainage_m, role, layer, regime, lobe, polarity, phase_class.
    """
    model = picks.filter("role <> 'correction' and visibility = 'visible'")
    first = model.groupBy("survey_id", "layer", "regime").agg(F.min(F.struct("chainage_m", "station_id", "lobe", "polarity", "phase_class")).alias("f"))
    off = F.abs(F.col("phase_class") - F.col("f.phase_class"))
    unlike = (F.col("lobe") != F.col("f.lobe")) | (F.col("polarity") != F.col("f.polarity")) | (F.least(off, 8 - off) >= 3)
    return model.join(first, ["survey_id", "layer", "regime"]).filter(unlike).select("survey_id", "layer", "regime").distinct()


def seed_documents(picks: DataFrame) -> DataFrame:
    """(survey_id, document): a seed file of version 4 for each survey without conflicts, stations by chainage, each pick with what identifies its wavelet.

    Missing columns of that are the sample itself for canonical_sample_index, 0 for analytic_phase_rad, 7 for pulse_width_samples and the place for event_id.
    """
    sound = picks.join(seed_conflicts(picks).select("survey_id").distinct(), "survey_id", "left_anti")
    own = lambda name, other: F.col(name) if name in picks.columns else other
    place = F.concat_ws(":", "station_id", "layer")
    pick = F.struct(F.col("sample").cast("double").alias("sample_index"), "visibility", F.lit(True).alias("user_confirmed"), own("canonical_sample_index", F.col("sample").cast("double")).alias("canonical_sample_index"), "phase_class", own("analytic_phase_rad", F.lit(0.0)).alias("analytic_phase_rad"), "polarity", F.col("lobe").alias("selected_lobe"), own("pulse_width_samples", F.lit(7.0)).alias("pulse_width_samples"), own("event_id", place).alias("event_id"), F.col("regime").alias("regime_id"))
    stations = sound.groupBy("survey_id", "station_id", "chainage_m", "role").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col("layer").cast("string").alias("k"), pick.alias("v"))))).alias("picks"))
    listed = stations.groupBy("survey_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("chainage_m", "station_id", "role", F.to_json("picks").alias("picks")))), lambda s: F.struct(s["station_id"].alias("station_id"), s["chainage_m"].alias("chainage_m"), s["role"].alias("role"), F.from_json(s["picks"], "map<string,struct<sample_index double, visibility string, user_confirmed boolean, canonical_sample_index double, phase_class int, analytic_phase_rad double, polarity int, selected_lobe string, pulse_width_samples double, event_id string, regime_id string>>").alias("picks"))).alias("stations"))
    return listed.select("survey_id", F.to_json(F.struct(F.lit(4).alias("schema_version"), "survey_id", "stations")).alias("document"))


def checkpoint_documents(points: DataFrame) -> DataFrame:
    """(survey_id, document): a blinded checkpoint file of version 1 for each survey; training on it is prohibited."""
    rest = [c for c in points.columns if c != "survey_id"]
    listed = points.groupBy("survey_id").agg(F.sort_array(F.collect_list(F.struct("checkpoint_id", *[c for c in rest if c != "checkpoint_id"]))).alias("checkpoints"))
    return listed.select("survey_id", F.to_json(F.struct(F.lit(1).alias("schema_version"), "survey_id", F.lit("radar_only").alias("selection_source"), F.lit("prohibited").alias("training_use"), "checkpoints")).alias("document"))


def annotations(clicks: DataFrame, surfaces: DataFrame, processed: bool) -> DataFrame:
    """Annotation rows of confirmed clicks of current stations, in raw or processed coordinates; automatic picks never get here.

    ``clicks`` has source_sha256, trace_index, layer_order, sample, visibility, role, user_confirmed, current, lobe, pulse; ``surfaces``
    (source_sha256, trace_index, surface, reference). A raw sample is taken back from the flattened surface.
    """
    known = clicks.filter("user_confirmed and current").join(surfaces, ["source_sha256", "trace_index"])
    seen = F.col("visibility") == "visible"
    raw = F.lit(None).cast("double") if processed else F.when(seen, F.col("sample") - F.col("reference") + F.col("surface"))
    columns = ["source_sha256", "trace_index", "layer_order", raw.alias("sample_raw"), "visibility", F.lit("true").alias("verified"), F.when(F.col("role") == "correction", "manual_correction").otherwise("manual").alias("origin"), F.lit("incompatible_processed_coordinates" if processed else "allowed").alias("training_use"), F.coalesce("lobe", F.lit("")).alias("selected_lobe"), F.coalesce("pulse", F.lit(7.0)).alias("pulse_width_samples")]
    if processed:
        columns += [F.lit("processed").alias("input_mode"), F.when(seen, F.col("sample").cast("double")).alias("sample_processed")]
    return known.select(*columns)


def write_package(folder: str, tables: dict[str, DataFrame], about: DataFrame) -> DataFrame:
    """Write ``tables`` as CSV and ``about``, one row a run, as JSON below ``folder``; returns the manifest (name, rows), itself written as JSON.

    Rows are counted where they are read back, so the manifest says what a reader gets.
    """
    spark = about.sparkSession
    for name, df in tables.items():
        write_csv(df, f"{folder}/{name}")
    flat(about).write.mode("errorifexists").json(f"{folder}/about")
    parts = [spark.read.option("header", True).csv(f"{folder}/{name}").agg(F.count("*").alias("rows")).select(F.lit(name).alias("name"), "rows") for name in sorted(tables)]
    listed = parts[0]
    for part in parts[1:]:
        listed = listed.union(part)
    listed.coalesce(1).write.mode("errorifexists").json(f"{folder}/manifest")
    return spark.read.schema("name string, rows long").json(f"{folder}/manifest")
