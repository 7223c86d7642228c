"""Chains by blocks against plain solvers that hold the whole chain."""

import numpy as np
import pytest

from fathomline.operators import chains, solvers
from fathomline.operators.chains import Chains, gap_steps, slope_steps


def plain_path(scores, step):
    best, back = scores[0], []
    for row in scores[1:]:
        ways = best[:, None] + step
        back.append(ways.argmax(axis=0))
        best = ways.max(axis=0) + row
    path = [int(best.argmax())]
    for choice in reversed(back):
        path.append(int(choice[path[-1]]))
    return path[::-1], float(best.max())


def frame(spark, roads):
    rows = [(key, 7 + 3 * i, row.tolist()) for key, scores in roads.items() for i, row in enumerate(scores)]
    return spark.createDataFrame(rows, "road string, at long, s array<double>").repartition(5)


def roads(states, lengths, seed=0):
    draw = np.random.default_rng(seed)
    return {f"r{k}": draw.standard_normal((n, states)) for k, n in enumerate(lengths)}


@pytest.mark.parametrize("lengths,block,fan", [((1, 2, 5, 300), 4, 3), ((16, 17, 33), 16, 2), ((700,), 2, 4), ((3,), 16, 4)])
def test_path_score_and_marginals_of_a_cut_chain(spark, lengths, block, fan):
    held, step = roads(5, lengths), slope_steps(5, 0.4)
    tree = Chains(frame(spark, held), ["road"], "at", "s", step, block, fan)
    assert len(tree.levels) == 1 + sum(-(-max(lengths) // block) > fan**k for k in range(12))
    best = {r.road: r.best for r in tree.best().collect()}
    paths, marginals = {}, {}
    for r in tree.path().orderBy("at").collect():
        paths.setdefault(r.road, []).append(r.state)
    for r in tree.marginals().orderBy("at").collect():
        marginals.setdefault(r.road, []).append(r.marginals)
    for key, scores in held.items():
        path, value = plain_path(scores, step)
        assert paths[key] == path and np.isclose(best[key], value)
        assert np.allclose(marginals[key], -solvers.min_marginals(-scores, lambda a, b: 0.4 * np.abs(a - b)))


def test_gap_state_beside_the_plain_decoder(spark):
    held = roads(6, (120, 9), 3)
    step = gap_steps(6, 0.3, -0.7)
    wide = {k: np.column_stack([v, np.full(len(v), 0.9)]) for k, v in held.items()}
    got = Chains(frame(spark, wide), ["road"], "at", "s", step, 16, 3).path().orderBy("at").collect()
    for key, scores in held.items():
        assert [-1 if r.state == 6 else r.state for r in got if r.road == key] == solvers.gapped_path(scores, 0.3, 0.9, -0.7).tolist()


def test_units_of_work_are_bounded(spark):
    """No unit is handed more rows than a block or more matrices than the fan, however long the one road is."""
    tree = Chains(frame(spark, roads(3, (500,))), ["road"], "at", "s", slope_steps(3, 0.2), 16, 4)
    sizes = tree.rows.groupBy("road", "_b").count().agg({"count": "max"}).first()[0]
    fans = [level.selectExpr("road", "_b div 4 AS p").groupBy("road", "p").count().agg({"count": "max"}).first()[0] for level in tree.levels]
    assert sizes == 16 and max(fans) <= 4 and [level.count() for level in tree.levels] == [32, 8, 2, 1]


def test_no_rows(spark):
    tree = Chains(frame(spark, {}), ["road"], "at", "s", slope_steps(3, 0.2))
    assert tree.best().collect() == [] and tree.path().collect() == [] and tree.marginals().collect() == []
    assert chains.best_through(np.zeros(2), np.array([[1.0, 2], [3, 0]])).tolist() == [3, 2]
