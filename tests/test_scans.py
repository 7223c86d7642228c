"""Scans over cut keys against plain windows over whole keys, one key holding most rows."""

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from fathomline.operators import scans, selection, windows


@pytest.fixture(scope="module")
def rows(spark):
    draw = np.random.default_rng(5)
    made = []
    for key, n in (("hot", 900), (None, 120), ("b", 7), ("one", 1)):
        x = np.sort(draw.integers(0, 4 * n, n))
        made += [(key, int(x[i]), i, float(draw.standard_normal()) if draw.random() < 0.3 else None, bool(draw.random() < 0.6), float(draw.random())) for i in range(n)]
    return spark.createDataFrame(made, "k string, x int, i int, v double, f boolean, w double").repartition(6)


ORDER = ["x", "i"]
SMALL = 20


def same(got, want):
    columns = sorted(want.columns)
    a, b = ([tuple(r[c] for c in columns) for r in d.collect()] for d in (got, want))
    order = lambda r: tuple((v is not None, v) for v in r)
    a, b = sorted(a, key=order), sorted(b, key=order)
    assert len(a) == len(b) and sorted(got.columns) == columns
    for p, q in zip(a, b, strict=True):
        assert all(x == y or (isinstance(x, float) and y is not None and np.isclose(x, y)) for x, y in zip(p, q, strict=True)), (p, q)


def test_a_hot_key_is_spread_and_small_ones_are_not(rows):
    pieces = scans.cut(rows, ["k"], ORDER, SMALL)[0].groupBy("k", "_p").agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).collect()
    hot = sorted((r._p, r.lo, r.hi, r.n) for r in pieces if r.k == "hot")
    assert len(hot) > 30 and max(n for *_, n in hot) < 45 and all(a[2] < b[1] for a, b in zip(hot, hot[1:], strict=False))
    assert sum(r.k == "b" for r in pieces) == sum(r.k == "one" for r in pieces) == 1 and sum(r.n for r in pieces) == rows.count()
    whole, many = scans.cut(rows, ["k"], ORDER)
    assert [r._p for r in whole.select("_p").distinct().collect()] == [0] and not many


def test_shifts_and_numbers(rows):
    w = Window.partitionBy("k").orderBy(*ORDER)
    same(scans.shifted(rows, ["k"], ORDER, {"was": "v", "at": "x"}, False, SMALL), rows.withColumn("was", F.lag("v").over(w)).withColumn("at", F.lag("x").over(w)))
    same(scans.shifted(rows, ["k"], ORDER, {"next": "v"}, True, SMALL), rows.withColumn("next", F.lead("v").over(w)))
    same(scans.numbered(rows, ["k"], ORDER, "n", SMALL), rows.withColumn("n", (F.row_number().over(w) - 1).cast("long")))


def test_islands_and_runs(rows):
    w = Window.partitionBy("k").orderBy(*ORDER)
    before = F.lag("x").over(w)
    want = rows.withColumn("_n", (before.isNull() | (F.col("x") - before > 6)).cast("int")).withColumn("island", F.sum("_n").over(w)).drop("_n")
    same(scans.islands(rows, ["k"], ORDER, ["x"], lambda a, b: b("x") - a("x") > 6, rows=SMALL), want)
    numbered = rows.withColumn("o", F.col("x") * 10_000 + F.col("i"))
    same(scans.runs(numbered, ["k"], ["o"], "f", rows=SMALL), windows.runs(numbered, ["k"], "o", "f"))


def test_neighbours_and_filling(rows):
    numbered = rows.withColumn("o", F.col("x") * 10_000 + F.col("i"))
    names = ("bv", "bx", "av", "ax")
    want = numbered.select("*", *(c.alias(n) for c, n in zip(windows.neighbours("v", "o", ["k"], "o"), names, strict=True)))
    same(scans.neighbours(numbered, ["k"], ["o"], "v", "o", names, SMALL), want)
    for hold in (False, True):
        same(scans.fill_linear(numbered, ["k"], ["o"], "v", "y", hold, SMALL), windows.fill_linear(numbered, ["k"], "o", "v", "y", hold))


def test_spans(rows):
    spans = rows.select("k", "x", (F.col("x") + F.col("i") % 5).alias("e"))
    same(scans.merge_spans(spans, ["k"], "x", "e", 1, SMALL), windows.merge_spans(spans, ["k"], "x", "e", 1))


@pytest.mark.parametrize("half", [1, 3, 40])
def test_moving_means(rows, half):
    numbered = rows.withColumn("o", F.col("x") * 10_000 + F.col("i"))
    same(scans.moving_mean(numbered, ["k"], ["o"], "w", half, "m", True, SMALL, 16), numbered.withColumn("m", windows.moving_mean("w", ["k"], "o", half)))
    near = Window.partitionBy("k").orderBy("o").rowsBetween(-half, half)
    same(scans.moving_mean(numbered, ["k"], ["o"], "w", half, "m", False, SMALL, 16), numbered.withColumn("m", F.avg("w").over(near)))


@pytest.mark.parametrize("least,by", [(1, 0), (2, 1), (4, 3)])
def test_dilation(rows, least, by):
    numbered = rows.withColumn("o", F.col("x") * 10_000 + F.col("i"))
    same(scans.dilated(numbered, ["k"], ["o"], "f", least, by, "g", SMALL, 16), windows.dilated(numbered, ["k"], "o", F.col("f"), least, by, "g"))


def test_support_from_marks(rows):
    marked = rows.withColumn("mark", F.col("i") % 53 == 17)
    got = {(r.k, r.i): r.s for r in scans.from_marks(marked, ["k"], ORDER, "w", "mark", "s", SMALL).collect()}
    held = {}
    for r in sorted(marked.collect(), key=lambda r: (r.x, r.i)):
        held.setdefault(r.k, []).append(r)
    for key, chain in held.items():
        n = len(chain)
        ahead, back = [0.0] * n, [0.0] * n
        for i, r in enumerate(chain):
            ahead[i] = 1.0 if r.mark else min(ahead[i - 1], r.w) if i else 0.0
        for i in range(n - 1, -1, -1):
            back[i] = 1.0 if chain[i].mark else min(back[i + 1], chain[i + 1].w) if i + 1 < n else 0.0
        assert [got[key, r.i] for r in chain] == [max(a, b) for a, b in zip(ahead, back, strict=True)]


def test_no_rows(rows):
    none = rows.limit(0)
    assert scans.islands(none, ["k"], ORDER, ["x"], lambda a, b: b("x") > a("x")).collect() == [] and scans.merge_spans(none, ["k"], "x", "i", 1).collect() == []


@pytest.mark.parametrize("apart,most", [(5, 4), (1, 3), (60, 100)])
def test_suppression_by_rounds(rows, apart, most):
    """Ties of score, rows of one place, a key that rises all along, and one that holds nearly all rows."""
    rising = rows.sparkSession.range(400).selectExpr("'up' AS k", "CAST(id AS INT) AS x", "CAST(id AS INT) AS i", "id / 7.0 AS w")
    frame = rows.select("k", "x", "i", F.round("w", 1).alias("w")).union(rising.select("k", "x", "i", "w")).filter("k is not null")
    got = selection.suppress_rounds(frame, ["k"], "x", "w", "i", apart, most)
    same(got, selection.suppress(frame, ["k"], "x", "w", "i", apart, most))
