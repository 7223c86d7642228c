"""The folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, a temporary folder for a local master and an error on a cluster."""
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if configured:
        return configured.rstrip("/")
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="fathomline-"))
    return f"file://{_own[0]}"


def new_folder(spark: SparkSession, label: str) -> str:
    """A path of its own below the shared folder, for one run's files."""
    return f"{shared_dir(spark)}/fathomline-{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def held(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read back: its lineage is cut, lost executors cost nothing, and it is computed once however often it is read."""
    path = new_folder(df.sparkSession, label)
    schema = df.schema
    df.write.parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)
