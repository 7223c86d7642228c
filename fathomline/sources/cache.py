"""Processed records: a road's traces and reviewed labels as immutable Parquet, with a manifest that binds them to their hash."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Name and version of the manifest, fixed values.
SCHEMA, VERSION = "processed-records-v1", "stored-v1"


def validity(samples: str):
    """Flags of samples that carry signal: the runs of equal values at both ends of a trace are padding."""
    n = F.size(samples)
    lead = F.coalesce(F.array_min(F.transform(samples, lambda v, k: F.when(v != F.get(samples, F.lit(0)), k))), n)
    last = F.coalesce(F.array_max(F.transform(samples, lambda v, k: F.when(v != F.get(samples, n - 1), k))), F.lit(-1))
    return F.transform(samples, lambda v, k: ((lead <= 1) | (k >= lead)) & ((last >= n - 2) | (k <= last)))


def label_reasons(labels: DataFrame, traces: DataFrame) -> DataFrame:
    """``labels`` (record, layer, trace, sample, amplitude) with the reason why a label is left out, null for those that teach.

    Fixed rules: off the grid; a recorded amplitude more than 1 from the trace's; padding; another sample given for the same layer and trace;
    a layer at or above the one over it, for both.
    """
    at = labels.join(traces.select("record", "trace", "samples", validity("samples").alias("valid")), ["record", "trace"], "left")
    here = Window.partitionBy("record", "layer", "trace")
    off = F.col("samples").isNull() | (F.col("sample") < 0) | (F.col("sample") >= F.size("samples"))
    value = F.get("samples", F.col("sample").cast("int"))
    several = F.min("sample").over(here) != F.max("sample").over(here)
    first = F.when(off, "off_grid").when(F.abs(value - F.col("amplitude")) > 1, "amplitude").when(~F.get("valid", F.col("sample").cast("int")), "padding").when(several, "conflict")
    told = at.select("record", "layer", "trace", "sample", first.alias("reason"))
    usable = told.filter("reason is null").select("record", "layer", "trace", "sample").distinct()
    w = Window.partitionBy("record", "trace").orderBy("layer")
    above, below = F.lag(F.struct("layer", "sample")).over(w), F.lead(F.struct("layer", "sample")).over(w)
    crossed = ((above["layer"] == F.col("layer") - 1) & (above["sample"] >= F.col("sample"))) | ((below["layer"] == F.col("layer") + 1) & (below["sample"] <= F.col("sample")))
    wrong = usable.withColumn("_x", F.coalesce(crossed, F.lit(False))).filter("_x").select("record", "layer", "trace", F.lit("order").alias("_o"))
    return told.join(wrong, ["record", "layer", "trace"], "left").select("record", "layer", "trace", "sample", F.coalesce("reason", "_o").alias("reason"))


def write_records(traces: DataFrame, labels: DataFrame, folder: str) -> DataFrame:
    """Write both tables by record and the manifest; returns it: (schema, version, record, traces, samples, labels, content_sha256).

    The hash is that of the sorted hashes of a record's rows, so it does not depend on how rows are dealt to files.
    """
    spark = traces.sparkSession
    kept = traces.select("record", "trace", F.col("samples").cast("array<float>").alias("samples"), validity("samples").alias("valid"))
    kept.write.mode("errorifexists").partitionBy("record").parquet(f"{folder}/traces")
    sound = label_reasons(labels, traces).filter("reason is null").select("record", "layer", "trace", "sample").distinct()
    sound.write.mode("errorifexists").partitionBy("record").parquet(f"{folder}/labels")
    manifest = content(open_records(spark, folder)).select(F.lit(SCHEMA).alias("schema"), F.lit(VERSION).alias("version"), "*")
    counts = spark.read.parquet(f"{folder}/labels").groupBy(F.col("record").cast("string").alias("record")).agg(F.count("*").alias("labels"))
    manifest.join(counts, "record", "left").withColumn("labels", F.coalesce("labels", F.lit(0))).write.mode("errorifexists").json(f"{folder}/manifest")
    return read_manifest(spark, folder)


def open_records(spark: SparkSession, folder: str) -> DataFrame:
    """(record, trace, samples, valid); a filter on record reads that record's files only."""
    return spark.read.parquet(f"{folder}/traces").select(F.col("record").cast("string").alias("record"), "trace", "samples", "valid")


def content(rows: DataFrame) -> DataFrame:
    """(record, traces, samples, content_sha256): a bounded digest of each record, summed in the tasks that read it."""
    digest = F.conv(F.substring(F.sha2(F.to_json(F.struct("trace", "samples", "valid")), 256), 1, 15), 16, 10).cast("decimal(38,0)")
    return rows.groupBy("record").agg(F.count("*").alias("traces"), F.max(F.size("samples")).alias("samples"), F.sha2(F.sum(digest).cast("string"), 256).alias("content_sha256"))


def read_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """The manifest; of another schema or version it fails."""
    rows = spark.read.schema("schema string, version string, record string, traces long, samples int, content_sha256 string, labels long").json(f"{folder}/manifest")
    known = (F.col("schema") == SCHEMA) & (F.col("version") == VERSION)
    return rows.withColumn("_a", F.assert_true(F.coalesce(known, F.lit(False)), F.lit("records of another schema"))).filter("_a is null").drop("_a")


def verified(spark: SparkSession, folder: str) -> DataFrame:
    """(record, intact): whether a record's rows still give the manifest's hash."""
    now = content(open_records(spark, folder)).select("record", F.col("content_sha256").alias("now"))
    return read_manifest(spark, folder).join(now, "record", "left").select("record", F.coalesce(F.col("content_sha256") == F.col("now"), F.lit(False)).alias("intact"))
