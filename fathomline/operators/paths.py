"""Dynamic programming and graph operators.

Components of link tables run as joins; alignments of bounded arrays as folds in the JVM. Chains of any length are in ``chains``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..workspace import shared_dir


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of the symmetric closure of (a, b), component the smallest node reachable.

    Each round takes the smallest label of the neighbours and then of the label's own label, so paths shrink
    fast; rounds go on until no label changes. Checkpoints in the folder of ``spark.checkpoint.dir`` cut the lineage.
    """
    context = edges.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_dir(edges.sparkSession))
    both = edges.select("a", "b").union(edges.select("b", "a")).distinct().checkpoint()
    labels = both.groupBy("a").agg(F.least(F.first("a"), F.min("b")).alias("l")).withColumnRenamed("a", "node").checkpoint()
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("l").alias("m"))
        joined = labels.join(near, F.col("node") == F.col("a")).select("node", F.least("l", "m").alias("l"), F.col("l").alias("old"))
        up = joined.select(F.col("node").alias("p"), F.col("l").alias("pl"))
        following = joined.join(up, F.col("l") == F.col("p"), "left").select("node", F.least("l", F.coalesce("pl", "l")).alias("l"), "old").checkpoint()
        labels = following.select("node", "l")
        if following.filter("l <> old").isEmpty():
            return labels.select("node", F.col("l").alias("component"))


def banded_dtw(a: Column, b: Column, n: int, band: int) -> Column:
    """Cost of aligning two arrays of n values by steps (1, 1), (1, 0), (0, 1) within a band, squared differences: a fold over rows of the band's cells."""
    big = F.lit(1e18)
    cells = F.sequence(F.lit(0), F.lit(2 * band))

    def row(acc: Column, i: Column) -> Column:
        # Cell d of row i is column i + d - band; the cell above it is d + 1 of the row before, the diagonal one d.
        def cell(done: Column, d: Column) -> Column:
            j = i + d - band
            cost = F.pow(F.get(a, i) - F.get(b, j), F.lit(2))
            before = F.least(F.coalesce(F.get(acc, d), big), F.coalesce(F.get(acc, d + 1), big), F.coalesce(F.get(done, d - 1), big))
            value = F.when((j >= 0) & (j < n), cost + F.when((i == 0) & (j == 0), F.lit(0.0)).otherwise(before)).otherwise(big)
            return F.concat(done, F.array(value))

        return F.aggregate(cells, F.array().cast("array<double>"), cell)

    return F.get(F.aggregate(F.sequence(F.lit(0), F.lit(n - 1)), F.array().cast("array<double>"), row), F.lit(band))
