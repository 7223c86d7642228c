"""Joins along an axis: first-match interval, nearest, as-of, band, interpolating, exclusion.

None of them is a nested loop: intervals and bands meet through buckets of the axis, ordered joins through one window over
the union of both sides, cut into pieces of the axis, so a key's rows are sorted once, by many tasks, and each row is read once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _bucket(x: Column, width: float) -> Column:
    return F.floor(x / F.lit(width)).cast("long")


def interval_first_match(left: DataFrame, segments: DataFrame, keys: list[str], row_id: str, x: str, start: str, end: str, order: str, take: list[str], width: float) -> DataFrame:
    """``left`` with the ``take`` columns of the first segment, by ``order``, of its keys that holds x, both ends included; nulls without one.

    A segment stands in the buckets that it touches, two at most, of a width that doubles with its length from ``width`` on; a row
    looks into its bucket of each width that segments have, some dozens at most however long they are.
    """
    size = F.greatest(F.col(end) - F.col(start), F.lit(width))
    level = F.greatest(F.ceil(F.log2(size / F.lit(width))), F.lit(0)).cast("int")
    wide = lambda at: F.lit(width) * F.pow(F.lit(2.0), at)
    levelled = segments.select(*keys, start, end, order, *[c for c in take if c not in keys], level.alias("_level"))
    spread = levelled.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col(start) / wide(F.col("_level"))).cast("long"), F.floor(F.col(end) / wide(F.col("_level"))).cast("long"))))
    # One row: the levels that occur.
    levels = levelled.agg(F.collect_set("_level").alias("_levels"))
    probes = left.select(row_id, *keys, x).join(F.broadcast(levels)).withColumn("_level", F.explode("_levels")).withColumn("_bucket", F.floor(F.col(x) / wide(F.col("_level"))).cast("long"))
    near = probes.join(spread, [*keys, "_level", "_bucket"]).filter(F.col(x).between(F.col(start), F.col(end)))
    first = near.groupBy(row_id).agg(F.min(F.struct(order, *[c for c in take if c != order])).alias("_first"))
    return left.join(first, row_id, "left").select(*left.columns, *[F.col(f"_first.{c}").alias(c) for c in take])


#: Length of a piece of the axis. A key's rows are sorted piece by piece; what a piece needs of the others is a row a piece.
PIECE = 65536.0


def _both(left: DataFrame, right: DataFrame, keys: list[str], x: str, right_id: str, take: list[str]) -> DataFrame:
    """Rows of both sides on one axis; the right side's are a struct."""
    marks = right.select(*keys, F.col(x).alias("_x"), F.struct(F.col(x).alias("_at"), F.col(right_id).alias("_id"), *[F.col(c).alias(c) for c in take]).alias("_right"))
    rows = left.select(*keys, F.col(x).alias("_x"), F.struct(*left.columns).alias("_left"))
    return marks.withColumn("_left", F.lit(None).cast(rows.schema["_left"].dataType)).unionByName(rows.withColumn("_right", F.lit(None).cast(marks.schema["_right"].dataType)))


def _beside(both: DataFrame, keys: list[str], order: list, ahead: bool) -> DataFrame:
    """The left rows of ``both`` with the last right row at or before them as _b and, with ``ahead``, the first at or after as _a.

    No task sorts a whole key: rows are ordered within pieces of the axis, and pieces pass their first and last right rows on.
    """
    own = both.withColumn("_p", F.floor(F.col("_x") / F.lit(PIECE)))
    w = Window.partitionBy(*keys, "_p").orderBy(*order)
    at = F.when(F.col("_right").isNotNull(), F.struct("_x", F.col("_right._id").alias("i")))
    ends = own.groupBy(*keys, "_p").agg(F.max_by("_right", at).alias("_last"), F.min_by("_right", at).alias("_first"))
    pieces = Window.partitionBy(*keys).orderBy("_p")
    before = F.last("_last", ignorenulls=True).over(pieces.rowsBetween(Window.unboundedPreceding, -1))
    after = F.first("_first", ignorenulls=True).over(pieces.rowsBetween(1, Window.unboundedFollowing))
    passed = ends.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate([*keys, "_p"])], before.alias("_pb"), after.alias("_pa"))
    rows = own.withColumn("_b0", F.last("_right", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    if ahead:
        rows = rows.withColumn("_a0", F.first("_right", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing)))
    rows = rows.filter(F.col("_left").isNotNull())
    same = F.lit(True)
    for i, k in enumerate([*keys, "_p"]):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    made = rows.join(passed, same, "left").withColumn("_b", F.coalesce("_b0", "_pb"))
    return made.withColumn("_a", F.coalesce("_a0", "_pa")) if ahead else made


def asof(left: DataFrame, right: DataFrame, keys: list[str], x: str, right_id: str, take: list[str], tolerance: float | None = None) -> DataFrame:
    """``left`` with the latest right row at or before it (of equal ones the last id), as matched_at, matched_id and ``take``."""
    order = [F.col("_x"), F.col("_left").isNotNull(), F.col("_right._id")]
    both = _beside(_both(left, right, keys, x, right_id, take), keys, order, False)
    near = F.lit(True) if tolerance is None else F.col("_x") - F.col("_b._at") <= F.lit(tolerance)
    pick = lambda c: F.when(near, F.col(f"_b.{c}"))
    return both.select("_left.*", pick("_at").alias("matched_at"), pick("_id").alias("matched_id"), *[pick(c).alias(c) for c in take])


def nearest(left: DataFrame, right: DataFrame, keys: list[str], x: str, right_id: str, take: list[str], tolerance: float | None = None) -> DataFrame:
    """``left`` with the right row nearest on x, the earlier of two equally near, of equal places the smallest id."""
    unique = right.groupBy(*keys, x).agg(F.min(F.struct(right_id, *[c for c in take])).alias("_r")).select(*keys, x, "_r.*")
    both = _beside(_both(left, unique, keys, x, right_id, take), keys, [F.col("_x"), F.col("_left").isNotNull()], True)
    late = F.col("_b").isNull() | (F.col("_a._at") - F.col("_x") < F.col("_x") - F.col("_b._at"))
    both = both.withColumn("_m", F.when(late, F.col("_a")).otherwise(F.col("_b")))
    near = F.lit(True) if tolerance is None else F.abs(F.col("_m._at") - F.col("_x")) <= F.lit(tolerance)
    pick = lambda c: F.when(near, F.col(f"_m.{c}"))
    return both.select("_left.*", pick("_at").alias("matched_at"), pick("_id").alias("matched_id"), *[pick(c).alias(c) for c in take])


def band(left: DataFrame, right: DataFrame, keys: list[str], x: str, right_x: str, width: float) -> DataFrame:
    """Pairs with equal keys and |x - right_x| <= width; each right row is copied to three buckets."""
    wide = right.withColumn("_bucket", F.explode(F.array(*[_bucket(F.col(right_x), width) + k for k in (-1, 0, 1)])))
    return left.withColumn("_bucket", _bucket(F.col(x), width)).join(wide, [*keys, "_bucket"]).filter(F.abs(F.col(x) - F.col(right_x)) <= F.lit(width)).drop("_bucket")


def excluded(left: DataFrame, right: DataFrame, keys: list[str], x: str, right_x: str, width: float) -> DataFrame:
    """``left`` without the rows that have a right row of equal keys within ``width``."""
    wide = right.select(*keys, F.col(right_x).alias("_rx")).withColumn("_bucket", F.explode(F.array(*[_bucket(F.col("_rx"), width) + k for k in (-1, 0, 1)])))
    marked = left.withColumn("_bucket", _bucket(F.col(x), width)).alias("l")
    wide = wide.alias("r")
    same = (F.col("l._bucket") == F.col("r._bucket")) & (F.abs(F.col(f"l.{x}") - F.col("r._rx")) <= F.lit(width))
    for key in keys:
        same = same & (F.col(f"l.{key}") == F.col(f"r.{key}"))
    return marked.join(wide, same, "left_anti").drop("_bucket")


def interpolating(left: DataFrame, fixes: DataFrame, keys: list[str], x: str, value: str, out: str) -> DataFrame:
    """``left`` with ``value`` interpolated between the fixes around it; null outside them, exact where a fix stands (the mean of several)."""
    points = fixes.groupBy(*keys, x).agg(F.avg(value).alias(value)).withColumn("_k", F.lit(0))
    # A fix stands before a row of its own place, so that the row finds it behind; going ahead it is found by its piece or the next.
    both = _beside(_both(left, points, keys, x, "_k", [value]), keys, [F.col("_x"), F.col("_left").isNotNull()], True)
    share = (F.col("_x") - F.col("_b._at")) / (F.col("_a._at") - F.col("_b._at"))
    made = F.when(F.col("_b._at") == F.col("_x"), F.col(f"_b.{value}")).when(F.col("_b").isNotNull() & F.col("_a").isNotNull(), F.col(f"_b.{value}") + share * (F.col(f"_a.{value}") - F.col(f"_b.{value}")))
    return both.select("_left.*", made.alias(out))
