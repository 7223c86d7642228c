import numpy as np
import pytest
from pyspark.sql import functions as F

from fathomline.functions import physics
from fathomline.operators import aggregates, chains, evaluation, joins, paths, selection, signal, windows


def values(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.orderBy(*columns[:1]).collect()]


def test_nearest_takes_the_earlier_of_equally_near(spark):
    left = spark.createDataFrame([(1, "a", 10), (2, "a", 0), (3, "b", 5)], "i int, k string, x int")
    right = spark.createDataFrame([(7, "a", 8), (8, "a", 12), (9, "a", 12)], "id int, k string, x int")
    assert values(joins.nearest(left, right, ["k"], "x", "id", []), "i", "matched_id") == [(1, 7), (2, 7), (3, None)]
    assert values(joins.nearest(left, right, ["k"], "x", "id", [], 2), "i", "matched_id") == [(1, 7), (2, None), (3, None)]


def test_interval_ends_are_inclusive_and_the_first_segment_wins(spark):
    left = spark.createDataFrame([(i, "a", float(x)) for i, x in enumerate((0, 5, 10, 11, 25))], "i int, k string, x double")
    segments = spark.createDataFrame([("a", 5.0, 10.0, 2, "late"), ("a", 0.0, 5.0, 1, "early"), ("a", 10.0, 11.0, 3, "last")], "k string, lo double, hi double, ord int, name string")
    hit = joins.interval_first_match(left, segments, ["k"], "i", "x", "lo", "hi", "ord", ["name"], 4.0)
    assert values(hit, "i", "name") == [(0, "early"), (1, "early"), (2, "late"), (3, "last"), (4, None)]


def test_exclusion_and_band(spark):
    left = spark.createDataFrame([(1, "a", 0.0), (2, "a", 9.9), (3, "a", 20.1), (4, "b", 0.0)], "i int, k string, x double")
    right = spark.createDataFrame([("a", 10.0)], "k string, y double")
    assert [i for (i,) in values(joins.excluded(left, right, ["k"], "x", "y", 10.0), "i")] == [3, 4]
    assert [i for (i,) in values(joins.band(left, right, ["k"], "x", "y", 10.0), "i")] == [1, 2]


def test_moving_mean_repeats_the_edges(spark):
    x = [3.0, 1.0, 4.0, 1.0, 5.0]
    df = spark.createDataFrame([("t", i, v) for i, v in enumerate(x)], "k string, i int, v double")
    got = [r.m for r in df.select("i", windows.moving_mean("v", ["k"], "i", 2).alias("m")).orderBy("i").collect()]
    want = np.convolve(np.pad(x, 2, mode="edge"), np.ones(5) / 5, mode="valid")
    assert np.allclose(got, want)


def test_fill_linear(spark):
    df = spark.createDataFrame([("t", i, v) for i, v in enumerate([None, 2.0, None, None, 8.0, None])], "k string, i int, v double")
    assert [v for _, v in values(windows.fill_linear(df, ["k"], "i", "v", "o"), "i", "o")] == [None, 2, 4, 6, 8, None]
    assert [v for _, v in values(windows.fill_linear(df, ["k"], "i", "v", "o", hold_ends=True), "i", "o")] == [2, 2, 4, 6, 8, 8]
    assert [v for _, v in values(windows.fill_linear(df, ["k"], "i", "v", "o", most=1), "i", "o")] == [None, 2, None, None, 8, None]
    assert [v for _, v in values(windows.fill_linear(df, ["k"], "i", "v", "o", jump=5), "i", "o")] == [None, 2, None, None, 8, None]


def test_spans_and_dilation(spark):
    spans = spark.createDataFrame([("a", 0, 5), ("a", 2, 3), ("a", 6, 7), ("a", 20, 21)], "k string, lo int, hi int")
    assert sorted(tuple(r) for r in windows.merge_spans(spans, ["k"], "lo", "hi", 1).collect()) == [("a", 0, 7, 3), ("a", 20, 21, 1)]
    df = spark.createDataFrame([("t", i, f) for i, f in enumerate([1, 0, 1, 1, 0, 0, 1, 1, 0])], "k string, i int, f int")
    grown = windows.dilated(df, ["k"], "i", F.col("f") == 1, 2, 1, "g")
    assert [g for _, g in values(grown, "i", "g")] == [False, True, True, True, True, True, True, True, True]


def test_status_lattice(spark):
    groups = {"a": ["accepted", "accepted"], "b": ["accepted", "high_confidence"], "c": ["accepted", "review"], "d": ["accepted", "unresolved"]}
    df = spark.createDataFrame([(k, s) for k, v in groups.items() for s in v], "k string, s string")
    assert values(df.groupBy("k").agg(aggregates.status_lattice(F.col("s")).alias("l")), "k", "l") == [("a", "accepted"), ("b", "high_confidence"), ("c", "review"), ("d", "unresolved")]


def test_bins_close_the_last_edge(spark):
    df = spark.createDataFrame([(0.0,), (9.9,), (10.0,), (20.0,)], "x double")
    assert [b for _, b in values(df.select("x", aggregates.bin_of(F.col("x"), 10.0, F.lit(20.0)).alias("b")), "x", "b")] == [0, 0, 1, 1]


def test_suppression(spark):
    df = spark.createDataFrame([("t", i, float(v)) for i, v in enumerate([1, 9, 8, 2, 7, 3])], "k string, i int, v double")
    assert values(selection.suppress(df, ["k"], "i", "v", "i", 2, 2), "rank", "i") == [(1, 1), (2, 4)]


def test_numbering_by_pieces(spark):
    df = spark.createDataFrame([("a", i * i) for i in range(30)] + [("b", 5)], "k string, x long")
    rows = selection.numbered(df, ["k"], "x", "n", 50).orderBy("k", "x").collect()
    assert [r.n for r in rows] == [*range(30), 0]


def test_rates_of_nothing_are_null(spark):
    row = spark.createDataFrame([(False, True)], "a boolean, c boolean").agg(*evaluation.cohort(F.col("a"), F.col("c"))).first()
    assert row.precision is None and row.coverage == 0
    assert spark.range(1).select(evaluation.wilson(F.lit(0), F.lit(0))[0].alias("w")).first().w is None


def test_envelope_and_band(spark):
    n = 64
    t = np.arange(n)
    wave = np.cos(2 * np.pi * 8 * t / n)
    assert np.allclose(signal.envelope(wave[None]), 1)
    assert np.allclose(signal.cosine_phase(wave[None]), wave)
    low, high = np.sin(2 * np.pi * 1 * t / n), np.sin(2 * np.pi * 24 * t / n)
    assert np.abs(signal.band_pass(low[None], 0.1, 0.3)).max() < 0.2 and np.abs(signal.band_pass(high[None], 0.1, 0.3)).max() < 0.3
    assert np.abs(signal.band_pass(np.sin(2 * np.pi * 12 * t / n)[None], 0.1, 0.3)).max() > 0.8
    df = spark.createDataFrame([(1, wave.tolist()), (2, None), (3, []), (4, [1.0, 2.0])], "id long, s array<double>")
    got = {r["id"]: r["e"] for r in signal.per_trace(df, "id", "s", signal.envelope, "e").collect()}
    assert np.allclose(got[1], 1) and got[2] is None and got[3] == [] and len(got[4]) == 2


@pytest.mark.parametrize("seed", range(3))
def test_viterbi_and_dtw_against_loops(spark, seed):
    draw = np.random.default_rng(seed)
    scores = draw.standard_normal((6, 5))
    best = scores[0]
    for row in scores[1:]:
        best = np.max(best[None] - 0.3 * np.abs(np.arange(5)[:, None] - np.arange(5)[None]), axis=1) + row
    df = spark.createDataFrame([("r", i, s.tolist()) for i, s in enumerate(scores)], "k string, i int, s array<double>")
    assert np.isclose(chains.Chains(df, ["k"], "i", "s", chains.slope_steps(5, 0.3), 2, 2).best().first().best, best.max())
    a, b = draw.standard_normal(8), draw.standard_normal(8)
    cost = np.full((9, 9), np.inf)
    cost[0, 0] = 0
    for i in range(8):
        for j in range(8):
            if abs(i - j) <= 2:
                cost[i + 1, j + 1] = (a[i] - b[j]) ** 2 + min(cost[i, j + 1], cost[i, j], cost[i + 1, j])
    df = spark.createDataFrame([(a.tolist(), b.tolist())], "a array<double>, b array<double>")
    assert np.isclose(df.select(paths.banded_dtw(F.col("a"), F.col("b"), 8, 2).alias("c")).first().c, cost[8, 8])


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (103, 101), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in paths.components(edges).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[103] == got[101] == got[100] == 100
    assert paths.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_parsing(spark):
    df = spark.createDataFrame([("50 mm",), ("5cm",), ('2"',), ("2 Inches",), ("x",), ("-4",), ("0",), (None,)], "t string")
    assert [r.m for r in df.select(physics.parsed_thickness(F.col("t")).alias("m")).collect()] == [50, 50, 50.8, 50.8, None, None, None, None]


@pytest.mark.parametrize("piece", [3.0, 65536.0])
def test_ordered_joins_over_pieces_of_the_axis(spark, monkeypatch, piece):
    monkeypatch.setattr(joins, "PIECE", piece)
    draw = np.random.default_rng(11)
    lefts = [(i, None if i % 17 == 0 else "ab"[i % 2], float(v)) for i, v in enumerate(draw.integers(0, 60, 120))]
    rights = [(100 + i, None if i % 7 == 0 else "ab"[i % 2], float(v), float(i)) for i, v in enumerate(draw.choice(60, 14, replace=False))] + [(300, "a", 7.0, 9.0), (301, "a", 7.0, 8.0)]
    left = spark.createDataFrame(lefts, "i int, k string, x double")
    right = spark.createDataFrame(rights, "id int, k string, x double, v double")
    own = {i: [r for r in rights if r[1] == k] for i, k, _ in lefts}
    as_of = {r.i: r.matched_id for r in joins.asof(left, right, ["k"], "x", "id", ["v"]).collect()}
    near = {r.i: r.matched_id for r in joins.nearest(left, right, ["k"], "x", "id", ["v"]).collect()}
    made = {r.i: r.o for r in joins.interpolating(left, right, ["k"], "x", "v", "o").collect()}
    assert len(as_of) == len(near) == len(made) == 120
    for i, _, x in lefts:
        before = [r for r in own[i] if r[2] <= x]
        assert as_of[i] == (max(before, key=lambda r: (r[2], r[0]))[0] if before else None)
        assert near[i] == (min(own[i], key=lambda r: (abs(r[2] - x), r[2], r[0]))[0] if own[i] else None)
        points = sorted({r[2] for r in own[i]})
        values = [np.mean([r[3] for r in own[i] if r[2] == p]) for p in points]
        want = np.interp(x, points, values) if points and points[0] <= x <= points[-1] else None
        assert made[i] is None and want is None or np.isclose(made[i], want)


def test_long_segments_stand_in_few_buckets(spark):
    draw = np.random.default_rng(12)
    segments = [("a", float(a), float(a + n), k, f"s{k}") for k, (a, n) in enumerate(zip(draw.uniform(0, 1000, 60), 10 ** draw.uniform(0, 6, 60), strict=True))]
    rows = [(i, "a", float(v)) for i, v in enumerate(draw.uniform(-10, 5000, 300))]
    got = joins.interval_first_match(spark.createDataFrame(rows, "i int, k string, x double"), spark.createDataFrame(segments, "k string, lo double, hi double, ord int, name string"), ["k"], "i", "x", "lo", "hi", "ord", ["name"], 4.0).collect()
    want = {i: next((s[4] for s in segments if s[1] <= x <= s[2]), None) for i, _, x in rows}
    assert {r.i: r.name for r in got} == want


def test_transforms_take_few_traces_at_once(spark):
    df = spark.range(3000).selectExpr("id", "array(double(id), 1.0D) AS s").coalesce(1)
    got = {r.id: r.o for r in signal.per_trace(df, "id", "s", lambda x: np.stack([x[:, 0], np.full(len(x), len(x))], axis=1), "o").collect()}
    assert len(got) == 3000 and all(got[i][0] == i and got[i][1] <= signal.AT_ONCE for i in range(3000))
