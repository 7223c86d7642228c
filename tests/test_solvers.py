import itertools

import numpy as np
import pytest

from fathomline.operators import grids, solvers


def all_paths(n, m):
    return [np.array(p) for p in itertools.product(range(m), repeat=n)]


@pytest.mark.parametrize("seed", range(4))
def test_paths_by_enumeration(seed):
    s = np.random.default_rng(seed).standard_normal((5, 3))
    first = lambda p: s[np.arange(5), p].sum() - 0.3 * np.abs(np.diff(p)).sum()
    second = lambda p: first(p) - 0.2 * np.abs(np.diff(p, 2)).sum()
    path, value = solvers.second_order_path(s, 0.3, 0.2)
    assert np.isclose(value, max(map(second, all_paths(5, 3)))) and np.isclose(second(path), value)
    path, value = solvers.second_order_path(s, 0.3, 0.2, {2: 1})
    assert path[2] == 1 and np.isclose(value, max(second(p) for p in all_paths(5, 3) if p[2] == 1))
    ranked = sorted(map(first, all_paths(5, 3)), reverse=True)
    assert np.allclose([v for _, v in solvers.best_paths(s, 0.3, 4)], ranked[:4])
    marginals = solvers.min_marginals(-s, lambda a, b: 0.3 * np.abs(a - b))
    assert np.isclose(marginals[2, 1], min(-first(p) for p in all_paths(5, 3) if p[2] == 1))


@pytest.mark.parametrize("seed", range(4))
def test_gaps_by_enumeration(seed):
    s = np.random.default_rng(seed).standard_normal((5, 3)) - 0.5

    def value(p):
        total = 0.0
        for i, j in enumerate(p):
            total += 0.1 if j == 3 else s[i, j]
            if i:
                b = p[i - 1]
                total += 0 if b == j == 3 else -0.4 if 3 in (b, j) else -0.3 * abs(b - j)
        return total

    best = max(all_paths(5, 4), key=value)
    got = solvers.gapped_path(s, 0.3, 0.1, -0.4)
    assert np.isclose(value(np.where(got < 0, 3, got)), value(best))
    assert solvers.gapped_path(s, 0.3, 5.0, 0.0, {1: 2})[1] == 2


def test_layers_by_enumeration():
    draw = np.random.default_rng(1)
    a, b = draw.standard_normal((4, 3)), draw.standard_normal((4, 3))
    best = max(a[np.arange(4), p].sum() + b[np.arange(4), q].sum() - 0.3 * (np.abs(np.diff(p)).sum() + np.abs(np.diff(q)).sum()) for p in all_paths(4, 3) for q in all_paths(4, 3) if (q >= p + 1).all())
    path, value = solvers.layered_beam([a, b], 0.3, 1)
    assert np.isclose(value, best) and (path[:, 1] > path[:, 0]).all()


def test_logistic_separates():
    draw = np.random.default_rng(0)
    x = draw.standard_normal((400, 2))
    y = (x[:, 0] - 0.5 * x[:, 1] + 0.3 * draw.standard_normal(400) > 0).astype(float)
    beta, intercept = solvers.logistic(x, y, np.ones(400), 1.0)
    p = 1 / (1 + np.exp(-(x @ beta + intercept)))
    assert ((p > 0.5) == y).mean() > 0.9
    assert np.allclose(x.T @ (y - p) - beta, 0, atol=1e-6)


def test_blocks_equal_the_whole(spark):
    draw = np.random.default_rng(2)
    x = draw.standard_normal((50, 20))
    df = spark.createDataFrame([(1, i, r.tolist()) for i, r in enumerate(x)], "road int, row long, s array<double>")
    for fn, margin in ((grids.oriented_coherence, 3), (grids.structure_slope, 3), (grids.lateral_phase_coherence, 4)):
        got = {r.row: r.o for r in grids.over_blocks(df, ["road"], "row", "s", fn, 8, margin, "o").collect()}
        assert len(got) == 50 and np.allclose([got[i] for i in range(50)], fn(x))


def test_grid_transforms():
    flat = np.tile(np.sin(np.arange(40) / 3 + 0.5), (9, 1))
    assert grids.oriented_coherence(flat).min() > 0.99 and np.abs(grids.structure_slope(flat)).max() < 1e-9
    dipping = np.stack([np.sin((np.arange(60) - k) / 3) for k in range(12)])
    assert np.isclose(np.median(grids.structure_slope(dipping)[4:8, 10:50]), 1, atol=0.2)
    w = np.array([0, 1, 3, 1, 0.0])
    spikes = np.zeros((1, 64))
    spikes[0, [10, 40]] = 1, -1
    made = np.apply_along_axis(lambda r: np.convolve(r, w)[:64], 1, spikes)
    back = grids.deconvolved(made, w, 0.001)
    assert back[0].argmax() == 10 and back[0].argmin() == 40
    c = grids.packet_correlation(made, w)
    assert c[0].argmax() == 12 and np.isclose(c[0].max(), 1)


@pytest.mark.parametrize("seed", range(6))
def test_diverse_paths_by_enumeration(seed):
    s = np.random.default_rng(seed).standard_normal((5, 4))
    value = lambda p: s[np.arange(5), p].sum() - 0.2 * np.abs(np.diff(p)).sum()
    kept = []
    for p in sorted(all_paths(5, 4), key=value, reverse=True):
        if all(np.abs(p - q).max() > 1 for q in kept):
            kept.append(p)
        if len(kept) == 4:
            break
    got = solvers.best_paths(s, 0.2, 4, 1)
    assert np.allclose([v for _, v in got], [value(p) for p in kept]) and all(np.isclose(value(np.array(p)), v) for p, v in got)


@pytest.mark.parametrize("seed", range(6))
def test_dense_paths_by_enumeration(seed):
    draw = np.random.default_rng(seed)
    p = draw.random((5, 4))
    p[2, 1] = 0
    p /= p.sum(axis=1, keepdims=True)
    seeds, breaks = ({1: 1.4, 4: 2.0}, {3}) if seed % 2 else ({0: 0.0, 1: 2.6}, set())
    path, gap = solvers.dense_path(p, seeds, 0.5, 0.8, 0.3, 0.4, breaks)

    def value(way):
        total, places = 0.0, []
        for r, s in enumerate(way):
            if r in seeds:
                if s != int(round(seeds[r])):
                    return -np.inf
                places.append(seeds[r])
            elif s == 4:
                total += np.log(0.3)
                places.append(None)
            else:
                if p[r, s] == 0 or r in breaks:
                    return -np.inf
                total += np.log(p[r, s])
                places.append(float(s))
            if r:
                a, b = places[-2:]
                total -= 0.0 if a is None and b is None else 0.4 if a is None or b is None else 0.4 * abs(a - b)
        return total

    best = max(itertools.product(range(5), repeat=5), key=value)
    got = tuple(int(round(s)) if not g else 4 for s, g in zip(path, gap, strict=True))
    assert np.isclose(value(got), value(best)) and all(path[r] == s for r, s in seeds.items())


def test_slopes_of_roads_of_any_length(spark):
    # Roads of 1 and 62 traces, and others around the ends of blocks: what a block after the last one has is margin alone.
    draw = np.random.default_rng(3)
    x = {n: draw.standard_normal((n, 8)) for n in (1, 2, 61, 62, 63, 64, 65, 126)}
    df = spark.createDataFrame([(n, i, r.tolist()) for n, rows in x.items() for i, r in enumerate(rows)], "road int, row long, s array<double>")
    for fn, margin in ((grids.structure_slope, 3), (grids.oriented_coherence, 3), (grids.lateral_phase_coherence, 4)):
        got = {(r.road, r.row): r.o for r in grids.over_blocks(df, ["road"], "row", "s", fn, 64, margin, "o").collect()}
        assert len(got) == sum(x)
        assert all(np.allclose([got[n, i] for i in range(n)], fn(rows)) for n, rows in x.items())
    assert (grids.structure_slope(np.ones((1, 8))) == 0).all()


def test_second_order_paths_of_long_roads_keep_few_rows():
    import tracemalloc

    draw = np.random.default_rng(4)
    # Against a plain recursion over pairs of states, across many stretches; of small whole numbers, so ties too.
    for s in (draw.standard_normal((50, 4)), draw.integers(0, 3, (50, 4)).astype(float)):
        best = {(a, b): s[0, a] + s[1, b] - 0.3 * abs(a - b) for a in range(4) for b in range(4)}
        for row in s[2:]:
            best = {(b, c): max(best[a, b] - 0.2 * abs(c - 2 * b + a) for a in range(4)) + row[c] - 0.3 * abs(b - c) for b in range(4) for c in range(4)}
        path, value = solvers.second_order_path(s, 0.3, 0.2)
        assert np.isclose(value, max(best.values()))
        assert np.isclose(value, s[np.arange(50), path].sum() - 0.3 * np.abs(np.diff(path)).sum() - 0.2 * np.abs(np.diff(path, 2)).sum())
    scores = draw.standard_normal((4000, 32))
    tracemalloc.start()
    solvers.second_order_path(scores, 0.03, 0.008)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # The choices of all rows are 33 MB.
    assert peak < 8e6
