"""Moving windows, runs, gaps and islands, filling: one window a key, for keys bounded by what they are, such as a trace's samples. ``scans`` has the same for keys of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def moving_mean(value: str, keys: list[str], order: str, half: int) -> Column:
    """Centred mean of 2 * half + 1 rows; beyond the ends the first and the last value repeat."""
    whole = Window.partitionBy(*keys)
    rows = whole.orderBy(order)
    near = rows.rowsBetween(-half, half)
    number, count = F.row_number().over(rows), F.count(F.lit(1)).over(whole)
    left = F.greatest(F.lit(half + 1) - number, F.lit(0))
    right = F.greatest(number + F.lit(half) - count, F.lit(0))
    full = rows.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return (F.sum(value).over(near) + left * F.first(value).over(full) + right * F.last(value).over(full)) / F.lit(2 * half + 1)


def islands(df: DataFrame, keys: list[str], order: str, breaks: Column, name: str = "island") -> DataFrame:
    """Number runs of rows: a row for which ``breaks`` holds begins a new one. ``breaks`` may use windows over (keys, order)."""
    w = Window.partitionBy(*keys).orderBy(order)
    return df.withColumn("_break", F.coalesce(breaks, F.lit(False)).cast("int")).withColumn(name, F.sum("_break").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_break")


def runs(df: DataFrame, keys: list[str], order: str, flag: str, name: str = "run") -> DataFrame:
    """Number runs of equal ``flag`` along the order."""
    w = Window.partitionBy(*keys).orderBy(order)
    before = F.lag(flag).over(w)
    return islands(df, keys, order, before.isNull() | ~before.eqNullSafe(F.col(flag)), name)


def neighbours(value: str, at: str, keys: list[str], order: str) -> tuple[Column, Column, Column, Column]:
    """(value, place) of the last known row at or before each row and of the first at or after."""
    w = Window.partitionBy(*keys).orderBy(order)
    back, on = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    known = F.when(F.col(value).isNotNull(), F.struct(F.col(value).alias("v"), F.col(at).alias("x")))
    b, a = F.last(known, ignorenulls=True).over(back), F.first(known, ignorenulls=True).over(on)
    return b["v"], b["x"], a["v"], a["x"]


def fill_linear(df: DataFrame, keys: list[str], order: str, value: str, out: str, hold_ends: bool = False, most: int | None = None, jump: float | None = None) -> DataFrame:
    """Nulls of ``value`` linearly between the known rows around them.

    ``hold_ends`` repeats the first and last known value outside them; ``most`` leaves gaps of more rows open and ``jump`` those whose
    ends differ by more. ``order`` counts rows.
    """
    bv, bx, av, ax = neighbours(value, order, keys, order)
    made = df.withColumn("_bv", bv).withColumn("_bx", bx).withColumn("_av", av).withColumn("_ax", ax)
    inner = F.col("_bv") + (F.col("_av") - F.col("_bv")) * (F.col(order) - F.col("_bx")) / F.when(F.col("_ax") > F.col("_bx"), F.col("_ax") - F.col("_bx"))
    allowed = F.col("_bv").isNotNull() & F.col("_av").isNotNull()
    if most is not None:
        allowed = allowed & (F.col("_ax") - F.col("_bx") - 1 <= most)
    if jump is not None:
        allowed = allowed & (F.abs(F.col("_av") - F.col("_bv")) <= jump)
    filled = F.when(F.col(value).isNotNull(), F.col(value).cast("double")).when(allowed, inner)
    if hold_ends:
        filled = filled.when(F.col("_bv").isNull(), F.col("_av")).when(F.col("_av").isNull(), F.col("_bv"))
    return made.withColumn(out, filled).drop("_bv", "_bx", "_av", "_ax")


def merge_spans(df: DataFrame, keys: list[str], start: str, end: str, gap: float) -> DataFrame:
    """Unions of spans that overlap or stand at most ``gap`` apart: (keys, start, end, members)."""
    w = Window.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    numbered = df.withColumn("_new", (reach.isNull() | (F.col(start) > reach + F.lit(gap))).cast("int")).withColumn("_g", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "_g").agg(F.min(start).alias(start), F.max(end).alias(end), F.count(F.lit(1)).alias("members")).drop("_g")


def dilated(df: DataFrame, keys: list[str], order: str, flag: Column, least: int, by: int, out: str) -> DataFrame:
    """``flag`` kept only in runs of ``least`` rows, then grown by ``by`` rows to each side."""
    w = Window.partitionBy(*keys).orderBy(order)
    marked = runs(df.withColumn("_f", flag), keys, order, "_f", "_r")
    long = marked.withColumn("_k", F.col("_f") & (F.count(F.lit(1)).over(Window.partitionBy(*keys, "_r")) >= least))
    return long.withColumn(out, F.max(F.col("_k").cast("int")).over(w.rowsBetween(-by, by)) == 1).drop("_f", "_r", "_k")
