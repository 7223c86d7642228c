"""Binning, status lattices, profiles and robust summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The reference statuses of a pick, in plain text: fixed values.
UNRESOLVED, REVIEW, HIGH, ACCEPTED = "unresolved", "review", "high_confidence", "accepted"


def stacked(df: DataFrame, row: str, values: str, width: int) -> DataFrame:
    """(stack, sample, value, centre): the median of each sample over ``width`` consecutive rows."""
    cells = df.select(F.floor(F.col(row) / width).cast("long").alias("stack"), F.col(row), F.posexplode(values).alias("sample", "v"))
    return cells.groupBy("stack", "sample").agg(F.median(F.col("v").cast("double")).alias("value"), ((F.min(row) + F.max(row)) / 2).alias("centre"))


def bin_of(x: Column, width: float, last: Column) -> Column:
    """Half-open bins from 0; the last one holds its right edge ``last`` as well."""
    return F.least(F.floor(x / F.lit(width)), F.greatest(F.ceil(last / F.lit(width)) - 1, F.lit(0))).cast("long")


def status_lattice(status: Column) -> Column:
    """A group's status: unresolved where any is, accepted or high where all are, else review."""
    every = lambda *names: F.bool_and(status.isin(*names))
    return F.when(F.bool_or(status == UNRESOLVED), UNRESOLVED).when(every(ACCEPTED), ACCEPTED).when(every(HIGH, ACCEPTED), HIGH).otherwise(REVIEW)


def profile(df: DataFrame, keys: list[str], order: str, values: list[str]) -> DataFrame:
    """Running sums of ``values`` over layers up to the first missing one, null from there on."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    for v in values:
        whole = F.min(F.col(v).isNotNull().cast("int")).over(w) == 1
        df = df.withColumn(f"{v}_sum", F.when(whole, F.sum(v).over(w)))
    return df


def mad_flags(df: DataFrame, keys: list[str], value: str, floor: float, factor: float) -> DataFrame:
    """``df`` with median, mad and whether the value stands further from the median than max(floor, factor * mad)."""
    centre = df.groupBy(*keys).agg(F.median(value).alias("centre"))
    off = df.join(centre, keys).withColumn("_off", F.abs(F.col(value) - F.col("centre")))
    spread = off.groupBy(*keys).agg(F.median("_off").alias("mad"))
    return off.join(spread, keys).withColumn("outlier", F.col("_off") > F.greatest(F.lit(floor), F.lit(factor) * F.col("mad"))).drop("_off")


def first_reason(*cases: tuple[str, Column]) -> Column:
    """The name of the first condition that holds, null where none does."""
    out = None
    for name, condition in cases:
        out = F.when(condition, name) if out is None else out.when(condition, name)
    return out
