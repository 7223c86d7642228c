"""Input tables and the axes that queries use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seconds(ts: str) -> Column:
    """Whole seconds of a timestamp without zone."""
    return F.unix_seconds(F.col(ts).cast("timestamp"))


#: The same in SQL.
def sql_seconds(ts: str) -> str:
    return f"CAST(floor(epoch({ts})) AS BIGINT)"


def events(spark: SparkSession, sf_dir: str, kind: str | None = None) -> DataFrame:
    """(event_id, user_id, sec, event_type, value), of one kind or all."""
    df = read(spark, sf_dir, "events").select("event_id", "user_id", seconds("ts").alias("sec"), "event_type", "value")
    return df if kind is None else df.filter(F.col("event_type") == kind)


#: WITH-clause entry of the same.
SQL_EVENTS = f"ev AS (SELECT event_id, user_id, {sql_seconds('ts')} AS sec, event_type, value FROM events)"
