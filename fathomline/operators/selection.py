"""Ordered and greedy selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..workspace import held


def stable_top(df: DataFrame, keys: list[str], score: str, tie: str, count: int, name: str = "rank") -> DataFrame:
    """The ``count`` best of each key, of equal scores the smallest tie first. Spark limits each task's groups before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(F.desc(score), F.asc(tie))
    return df.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= count)


def suppress(df: DataFrame, keys: list[str], place: str, score: str, tie: str, apart: float, most: int) -> DataFrame:
    """Greedy peaks: best first, each at least ``apart`` from those taken, ``most`` a key: (keys, taken array of place, score, tie).

    A fold over the key's rows in order; it holds ``most`` taken rows at a time and runs in the JVM.
    """
    ordered = F.sort_array(F.collect_list(F.struct((-F.col(score)).alias("neg"), F.col(tie).alias("tie"), F.col(place).alias("place"))))
    rows = df.groupBy(*keys).agg(ordered.alias("_rows"))
    start = F.slice("_rows", 1, 0)
    taken = F.aggregate("_rows", start, lambda acc, r: F.when((F.size(acc) < most) & ~F.exists(acc, lambda t: F.abs(t["place"] - r["place"]) < F.lit(apart)), F.concat(acc, F.array(r))).otherwise(acc))
    return rows.select(*keys, taken.alias("_taken")).select(*keys, F.posexplode("_taken").alias("rank", "t")).select(*keys, (F.col("rank") + 1).alias("rank"), F.col("t.place").alias(place), (-F.col("t.neg")).alias(score), *([F.col("t.tie").alias(tie)] if tie != place else []))


def near_best(df: DataFrame, keys: list[str], group: str, score: str, tie: str, within: float, most: int) -> DataFrame:
    """Each group's best row where it is within ``within`` of the key's best, ``most`` a key."""
    best = df.groupBy(*keys, group).agg(F.min(F.struct((-F.col(score)).alias("n"), F.col(tie).alias(tie))).alias("m")).select(*keys, group, (-F.col("m.n")).alias(score), F.col(f"m.{tie}").alias(tie))
    top = F.max(score).over(Window.partitionBy(*keys))
    return stable_top(best.withColumn("_t", top).filter(F.col(score) >= F.col("_t") - within).drop("_t"), keys, score, tie, most)


def at_shares(df: DataFrame, keys: list[str], place: str, tie: str, shares: list[float]) -> DataFrame:
    """The row nearest to each share of a key's extent, earlier ones first: (keys, share, place, tie)."""
    extent = df.groupBy(*keys).agg(F.min(place).alias("_lo"), F.max(place).alias("_hi"))
    aims = F.explode(F.array(*[F.lit(s) for s in shares]))
    rows = df.join(extent, keys).withColumn("share", aims).withColumn("_far", F.abs(F.col(place) - (F.col("_lo") + F.col("share") * (F.col("_hi") - F.col("_lo")))))
    return rows.groupBy(*keys, "share").agg(F.min(F.struct("_far", place, tie)).alias("m")).select(*keys, "share", f"m.{place}", f"m.{tie}")


def pmod_class(x: Column, full: float, classes: int) -> Column:
    """The class of an angle-like value among ``classes`` equal parts of ``full``, half-open, negatives wrapped."""
    return F.floor(F.pmod(x + F.lit(full / 2), F.lit(full)) * F.lit(classes) / F.lit(full)).cast("int")


def numbered(df: DataFrame, keys: list[str], order: str, name: str, width: int = 4096) -> DataFrame:
    """``df`` with rows numbered from 0 along a whole-number ``order`` within keys, without a task that holds a key.

    Rows are ranked within pieces of the order of ``width``; the pieces' counts, a few rows, are summed along a key. Equal
    places share no number only where ``order`` is unique within keys.
    """
    pieces = df.withColumn("_p", F.floor(F.col(order) / width))
    counts = pieces.groupBy(*keys, "_p").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.withColumn("_b", F.sum("_n").over(Window.partitionBy(*keys).orderBy("_p")) - F.col("_n")).drop("_n")
    within = pieces.withColumn("_k", F.row_number().over(Window.partitionBy(*keys, "_p").orderBy(order)) - 1)
    return within.join(before, [*keys, "_p"]).withColumn(name, (F.col("_b") + F.col("_k")).cast("long")).drop("_p", "_k", "_b")


#: Widths of ``apart`` in a stretch of the axis, which one unit of work holds together with ``apart`` to either side, twice.
STRETCH = 4


def suppress_rounds(df: DataFrame, keys: list[str], place: str, score: str, tie: str, apart: int, most: int) -> DataFrame:
    """The result of ``suppress`` for keys of any size and whole-number places: (keys, rank, place, score, tie).

    Rounds of an independent set: a row that is the best open one within reach is taken, and what stands within its reach is out. No unit of
    work holds a key: rows are dealt to stretches of the axis with a margin of twice the reach, in which frames by range find both, so a stretch holds
    as many rows as places, of which only the best is ever taken, some 8 * ``apart`` at most. The best open row of a key is taken in every round and all that stays
    open is worse, so after ``most`` rounds the first ``most`` of every key are known. Each round is written before the next.
    """
    if most < 1:
        return df.limit(0).select(*keys, F.lit(0).alias("rank"), place, score, *([tie] if tie != place else []))
    best = F.struct(F.col(score).alias("s"), F.struct((-F.col(tie)).alias("t")).alias("t"))
    rows = df.filter(F.col(place).isNotNull() & F.col(score).isNotNull()).groupBy(F.struct(*keys).alias("_k"), F.col(place).cast("long").alias("_x")).agg(F.max(best).alias("_best"))
    open_, taken = held(rows, "suppress-open"), []
    size, near = STRETCH * apart, apart - 1
    own = F.floor(F.col("_x") / size)
    reach = Window.partitionBy("_k", "_b").orderBy("_x").rangeBetween(-near, near)
    for _ in range(most):
        stretches = F.array_distinct(F.array(own, F.floor((F.col("_x") - 2 * near) / size), F.floor((F.col("_x") + 2 * near) / size)))
        dealt = open_.withColumn("_b", F.explode(stretches))
        judged = dealt.withColumn("_take", F.max("_best").over(reach) == F.col("_best")).withColumn("_out", F.max("_take").over(reach))
        judged = held(judged.filter(F.col("_b") == own).filter("_take or not _out").select("_k", "_x", "_best", "_take"), "suppress-round")
        taken.append(judged.filter("_take"))
        open_ = judged.filter("not _take").drop("_take")
        if open_.isEmpty():
            break
    found = taken[0]
    for more in taken[1:]:
        found = found.union(more)
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("_k").orderBy(F.desc("_best")))).filter(F.col("rank") <= most)
    return ranked.select(*(F.col(f"_k.{k}").alias(k) for k in keys), "rank", F.col("_x").alias(place), F.col("_best.s").alias(score), *([(-F.col("_best.t.t")).alias(tie)] if tie != place else []))
