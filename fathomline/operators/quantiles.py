"""Exact quantiles of hot groups without collecting them: histograms narrow a bracket around each rank, then the few values inside are counted.

``F.percentile`` keeps every distinct value of a group in one task. Here that is done only for groups that are no hot ones. For hot ones, HOT at most whatever
the table's size, a mergeable sketch cuts each rank's bracket into BINS parts of about as many rows, whatever the distribution, an exact
histogram counts them, and the part that holds the rank is the next bracket. A value that is a cut is a part of its own, so every step leaves values
out, and ties end it. When a bracket holds few values, or one, these are counted as they are. All these aggregates have a fixed size and are combined
before their shuffle. The result has the digits of ``F.percentile``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..workspace import held
from .cuts import part_of, position, two_levels
from .cuts import shares as shares_of

#: Rows of a group that ``F.percentile`` takes whole; groups that may be hot; parts of a bracket; values that are counted as they are.
WHOLE, HOT, BINS, FEW = 1 << 18, 1000, 1024, 4096


def exact_quantiles(df: DataFrame, keys: list[str], value: str, shares: list[float], out: str, whole: int = WHOLE, bins: int = BINS, few: int = FEW) -> DataFrame:
    """(keys, ``out``): an array of the quantiles of ``value`` by linear interpolation, one for each of ``shares``; null for a group without a value.

    Nulls do not count, nor do NaNs; null keys are a group. ``df`` is read once for the counts, once for groups that are not hot, and once a pass, some six, where a group is hot.
    """
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    rows = df.select(F.struct(*keys).alias("_k"), F.when(~F.isnan(F.col(value).cast("double")), F.col(value).cast("double")).alias("_v"))
    counts = rows.groupBy("_k").agg(F.count("_v").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    total, most = counts.agg(F.sum("_n"), F.max("_n")).first()
    plain = lambda d: d.groupBy("_k").agg(F.percentile("_v", F.array(*map(F.lit, shares))).alias(out))
    back = [F.col(f"_k.{k}").cast(kinds[k]).alias(k) for k in keys]
    if not total or most <= whole or most * HOT <= total:
        return plain(rows).select(*back, out)
    # HOT rows at most.
    hot = held(counts.filter((F.col("_n") > whole) & (F.col("_n") * HOT > total)), "quantiles-hot")
    cold = plain(rows.join(F.broadcast(hot.select("_k")), "_k", "left_anti"))
    values = rows.filter("_v is not null").join(F.broadcast(hot.select("_k")), "_k")
    # A rank on either side of each place; many of them are equal.
    place = F.explode(F.transform(F.array(*map(F.lit, shares)), lambda s: (F.col("_n") - 1) * s))
    ranks = hot.select("_k", "_n", "_lo", "_hi", place.alias("_at")).select("_k", "_n", "_lo", "_hi", F.explode(F.array(F.floor("_at"), F.ceil("_at"))).alias("_rank")).distinct()
    brackets = held(ranks.select("_k", "_rank", "_lo", "_hi", F.lit(0).cast("long").alias("_below"), F.col("_n").alias("_inside")), "quantiles-bracket")
    open_ = (F.col("_inside") > few) & (F.col("_lo") < F.col("_hi"))
    while not brackets.filter(open_).isEmpty():
        # Ranks that still share a bracket share its histogram.
        wanted = brackets.filter(open_).select("_k", "_lo", "_hi").distinct()
        within = values.join(F.broadcast(wanted), "_k").filter("_v between _lo and _hi")
        sketch = within.groupBy("_k", "_lo", "_hi").agg(F.array_distinct(F.percentile_approx("_v", shares_of(bins), 10 * bins)).alias("_q"))
        first, split = two_levels("_q")
        cuts = held(sketch.select("_k", "_lo", "_hi", "_q", first.alias("_first"), split.alias("_split")), "quantiles-cuts")
        placed = values.join(F.broadcast(cuts), "_k").filter("_v between _lo and _hi").withColumn("_c", part_of("_first", F.col("_v"))).withColumn("_at", position(F.col("_c"), "_split", F.col("_v")))
        part = F.when(F.get("_q", F.col("_at") - 1) == F.col("_v"), 2 * F.col("_at") - 1).otherwise(2 * F.col("_at"))
        parts = placed.groupBy("_k", "_lo", "_hi", part.alias("_part")).agg(F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_a"), F.max("_v").alias("_b"))
        # At most 2 * ``bins`` rows a bracket.
        along = Window.partitionBy("_k", "_lo", "_hi").orderBy("_part")
        parts = parts.withColumn("_before", F.sum("_c").over(along) - F.col("_c"))
        narrower = brackets.filter(open_).join(parts, ["_k", "_lo", "_hi"]).filter("_rank - _below between _before and _before + _c - 1")
        narrower = narrower.select("_k", "_rank", F.col("_a").alias("_lo"), F.col("_b").alias("_hi"), (F.col("_below") + F.col("_before")).alias("_below"), F.col("_c").alias("_inside"))
        brackets = held(brackets.filter(~open_).union(narrower), "quantiles-bracket")
    spans = brackets.select("_k", "_lo", "_hi").distinct()
    counted = values.join(F.broadcast(spans), "_k").filter("_v between _lo and _hi").groupBy("_k", "_lo", "_hi", "_v").agg(F.count(F.lit(1)).alias("_c"))
    along = Window.partitionBy("_k", "_lo", "_hi").orderBy("_v")
    counted = counted.withColumn("_before", F.sum("_c").over(along) - F.col("_c"))
    found = brackets.join(counted, ["_k", "_lo", "_hi"]).filter("_rank - _below between _before and _before + _c - 1").select("_k", "_rank", "_v")
    met = hot.select("_k", "_n").join(found.groupBy("_k").agg(F.map_from_entries(F.collect_list(F.struct("_rank", "_v"))).alias("_at")), "_k", "left")

    def between(s):
        at = (F.col("_n") - 1) * s
        low, high = F.floor(at).cast("long"), F.ceil(at).cast("long")
        a, b = F.try_element_at("_at", low), F.try_element_at("_at", high)
        return F.when((low == high) | (a == b), a).otherwise((high - at) * a + (at - low) * b)

    hottest = met.select("_k", F.transform(F.array(*map(F.lit, shares)), between).alias(out))
    return cold.unionByName(hottest).select(*back, out)


def exact_median(df: DataFrame, keys: list[str], value: str, out: str, whole: int = WHOLE) -> DataFrame:
    """(keys, ``out``): the exact median of each group."""
    return exact_quantiles(df, keys, value, [0.5], out, whole).withColumn(out, F.col(out)[0])
