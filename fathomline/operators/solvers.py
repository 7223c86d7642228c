"""Sequential solvers on one group's arrays, in numpy; roads, blocks or brackets run in parallel through applyInArrow.

Every solver takes plain arrays, so it can be tested by enumeration, and ``grouped`` runs one over a table. A group is a road, whose
rows one unit of work holds.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

NEVER = -1e18


def second_order_path(scores: np.ndarray, slope: float, curve: float, fixed: dict[int, int] | None = None) -> tuple[np.ndarray, float]:
    """The path of states that maximises scores - slope * |step| - curve * |change of step|; rows in ``fixed`` must take their state.

    Exact over pairs of states: O(rows * states^3). The way forward keeps the pairs' scores at every so many rows only, some square root of the rows; the way
    back takes these stretches again, last first, with the choices of one stretch at a time.
    """
    n, m = scores.shape
    index = np.arange(m)
    step = slope * np.abs(index[:, None] - index[None, :])

    def row_of(row: int) -> np.ndarray:
        own = scores[row].astype(float)
        if fixed and row in fixed:
            keep = own[fixed[row]]
            own[:] = NEVER
            own[fixed[row]] = keep
        return own

    if n == 1:
        return np.array([int(row_of(0).argmax())]), float(row_of(0).max())
    bend = curve * np.abs((index[None, None, :] - index[None, :, None]) - (index[None, :, None] - index[:, None, None]))
    ways = np.empty_like(bend)

    def ahead(best: np.ndarray, row: int) -> np.ndarray:
        return np.subtract(best[:, :, None], bend, out=ways).max(axis=0) + row_of(row)[None, :] - step

    stretch = max(int(np.ceil(np.sqrt(n))), 1)
    best = row_of(0)[:, None] + row_of(1)[None, :] - step
    starts, marks = list(range(2, n, stretch)), []
    for row in range(2, n):
        if (row - 2) % stretch == 0:
            marks.append(best)
        best = ahead(best, row)
    j, k = np.unravel_index(best.argmax(), best.shape)
    value = float(best[j, k])
    path = np.empty(n, int)
    path[n - 1], path[n - 2] = k, j
    for start, best in zip(reversed(starts), reversed(marks), strict=True):
        stop, choices = min(start + stretch, n), []
        for row in range(start, stop):
            at = best
            best = ahead(at, row)
            choices.append(ways.argmax(axis=0).astype(np.int32))
        for row in range(stop - 1, start - 1, -1):
            path[row - 2] = choices[row - start][path[row - 1], path[row]]
    return path, value


def best_paths(scores: np.ndarray, slope: float, count: int, apart: int = 0) -> list[tuple[list[int], float]]:
    """The ``count`` best first-order paths, best first, each more than ``apart`` states from every better one in some row.

    Exact: beside its state a path carries which of the better ones it has left already, and only paths that have left all
    count. With ``apart`` 0 these are the best different paths. Of equal ones the lowest states from the end on win.
    """
    n, m = scores.shape
    index = np.arange(m)
    move = -slope * np.abs(index[:, None] - index[None, :])
    out: list[tuple[list[int], float]] = []
    for _ in range(count):
        masks = 1 << len(out)
        kept = np.array([p for p, _ in out]).reshape(len(out), n)
        # The set of better paths that each state of a row leaves.
        left = [np.array([sum((abs(j - int(kept[k, row])) > apart) << k for k in range(len(out))) for j in range(m)], int) for row in range(n)]
        best = np.full((masks, m), NEVER)
        best[left[0], index] = scores[0]
        back = []
        for row in range(1, n):
            reached = best[:, :, None] + move[None]  # mask, from, to
            choice = reached.argmax(axis=1)
            value = reached.max(axis=1)
            following, origin = np.full((masks, m), NEVER), np.zeros((masks, m, 2), int)
            for mask in range(masks):
                target = mask | left[row]
                better = value[mask] + scores[row] > following[target, index]
                at = index[better]
                following[target[better], at] = value[mask][better] + scores[row][better]
                origin[target[better], at, 0], origin[target[better], at, 1] = mask, choice[mask][better]
            best = following
            back.append(origin)
        last = int(best[masks - 1].argmax())
        total = float(best[masks - 1, last])
        if total <= NEVER / 2:
            break
        path, mask, state = [last], masks - 1, last
        for origin in reversed(back):
            mask, state = (int(x) for x in origin[mask, state])
            path.append(state)
        out.append((path[::-1], total))
    return out


def min_marginals(unary: np.ndarray, step: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """For each row and state the cost of the cheapest chain through it."""
    n, m = unary.shape
    index = np.arange(m)
    cost = step(index[:, None], index[None, :])
    forward, backward = np.zeros((n, m)), np.zeros((n, m))
    forward[0] = unary[0]
    for row in range(1, n):
        forward[row] = unary[row] + (forward[row - 1][:, None] + cost).min(axis=0)
    for row in range(n - 2, -1, -1):
        backward[row] = ((backward[row + 1] + unary[row + 1])[None, :] + cost).min(axis=1)
    return forward + backward


def gapped_path(log_p: np.ndarray, slope: float, gap: float, enter: float, seeds: dict[int, int] | None = None) -> np.ndarray:
    """First-order decoding with a gap state: -1 where ``gap`` a row and ``enter`` a change beat the samples. Seeds are forced."""
    n, m = log_p.shape
    p = log_p.astype(float).copy()
    hole = np.full(n, float(gap))
    for row, state in (seeds or {}).items():
        keep = p[row, state]
        p[row] = NEVER
        p[row, state] = keep if keep > NEVER / 2 else 0.0
        hole[row] = NEVER
    index = np.arange(m)
    move = -slope * np.abs(index[:, None] - index[None, :])
    best = np.append(p[0], hole[0])
    back = np.zeros((n, m + 1), int)
    for row in range(1, n):
        stay = best[:m, None] + move
        from_gap = np.full(m, best[m] + enter)
        choice = stay.argmax(axis=0)
        value = stay.max(axis=0)
        use = from_gap > value
        back[row, :m] = np.where(use, m, choice)
        into = best[:m].max() + enter
        back[row, m] = m if best[m] >= into else int(best[:m].argmax())
        best = np.append(np.where(use, from_gap, value) + p[row], max(best[m], into) + hole[row])
    path = [int(best.argmax())]
    for row in range(n - 1, 0, -1):
        path.append(int(back[row, path[-1]]))
    out = np.array(path[::-1])
    return np.where(out == m, -1, out)


def dense_path(p: np.ndarray, seeds: dict[int, float], interval: float, slope: float, gap: float, change: float, breaks: set[int] = frozenset()) -> tuple[np.ndarray, np.ndarray]:
    """(sample or -1, gap flag) of the path of most log probability less ``slope`` a ns of total variation, through seeds at their exact, also fractional, places.

    A gap costs -log ``gap`` a row and ``change`` at each of its ends; in ``breaks`` nothing can be picked. Each step is a distance transform
    in two sweeps, linear in the depths.
    """
    n, depth = p.shape
    rate = slope * interval
    with np.errstate(divide="ignore"):
        log_p = np.where(p > 0, np.log(np.maximum(p, 1e-300)), NEVER)
    log_p[list(breaks)] = NEVER
    at = np.arange(depth, dtype=float)
    back = np.full((n, depth + 1), -1)
    last = np.zeros(depth + 1)
    for row in range(n):
        before = seeds.get(row - 1)
        if row == 0:
            best, origin, into, start = np.zeros(depth), np.full(depth, -1), 0.0, -1
        else:
            if before is not None:
                slot = int(round(before))
                best, origin = last[slot] - rate * np.abs(at - before), np.full(depth, slot)
            else:
                best, origin = _sweeps(last[:depth], rate)
            hole = last[depth] - change
            origin = np.where(hole > best, depth, origin)
            best = np.maximum(best, hole)
            start = int(last[:depth].argmax())
            into = last[start] - change
            if last[depth] >= into:
                into, start = last[depth], depth
        now = np.append(best + log_p[row], into + np.log(gap))
        back[row] = np.append(origin, start)
        if row in seeds:
            exact = seeds[row]
            slot = int(round(exact))
            value, source = 0.0, -1
            if row:
                places = at.copy()
                if before is not None:
                    places[int(round(before))] = before
                ways = np.append(last[:depth] - rate * np.abs(places - exact), last[depth] - change)
                source = int(ways.argmax())
                value = ways[source]
            now = np.full(depth + 1, NEVER)
            now[slot], back[row, slot] = value, source
        last = now
    state, out = int(last.argmax()), np.full(n, -1.0)
    for row in range(n - 1, -1, -1):
        if state < depth:
            out[row] = seeds.get(row, float(state))
        state = int(back[row, state])
    return out, out < 0


def _sweeps(v: np.ndarray, rate: float) -> tuple[np.ndarray, np.ndarray]:
    """max_j v[j] - rate * |i - j| and its j, as running maxima of v + rate * j from below and v - rate * j from above."""
    j = np.arange(len(v))
    up, down = v + rate * j, v - rate * j
    low = np.maximum.accumulate(up)
    at_low = np.maximum.accumulate(np.where(up == low, j, 0))
    high = np.maximum.accumulate(down[::-1])[::-1]
    at_high = np.minimum.accumulate(np.where(down == high, j, len(v) - 1)[::-1])[::-1]
    a, b = low - rate * j, high + rate * j
    return np.maximum(a, b), np.where(a >= b, at_low, at_high)


def layered_beam(scores: list[np.ndarray], slope: float, between: int, beam: int = 256) -> tuple[np.ndarray, float]:
    """States of several layers at once, each at least ``between`` below the one above: (rows, layers) and its score.

    Keeps the ``beam`` best combinations a row, ties by the states; exact where a row has no more combinations than that.
    """
    n, layers = scores[0].shape[0], len(scores)

    def combinations(row: int) -> list[tuple[float, tuple[int, ...]]]:
        out: list[tuple[float, tuple[int, ...]]] = [(0.0, ())]
        for layer in range(layers):
            out = [(v + float(scores[layer][row, j]), (*c, j)) for v, c in out for j in range(scores[layer].shape[1]) if not c or j >= c[-1] + between]
            out.sort(key=lambda x: (-x[0], x[1]))
            out = out[: beam * 4]
        return out[:beam]

    first = combinations(0)
    if not first:
        return np.zeros((0, layers), int), NEVER
    states, values, history = np.array([c for _, c in first]), np.array([v for v, _ in first]), []
    for row in range(1, n):
        own = combinations(row)
        here = np.array([c for _, c in own])
        total = values[None, :] - slope * np.abs(states[None, :, :] - here[:, None, :]).sum(axis=2)
        origin = total.argmax(axis=1)
        reached = total.max(axis=1) + np.array([v for v, _ in own])
        order = np.lexsort((*here.T[::-1], -reached))[:beam]
        history.append((states, origin[order]))
        states, values = here[order], reached[order]
    k, path = 0, [states[0]]
    for before, origin in reversed(history):
        k = int(origin[k])
        path.append(before[k])
    return np.array(path[::-1]), float(values[0])


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float, steps: int = 50) -> tuple[np.ndarray, float]:
    """Weighted ridge logistic regression by Newton steps: (coefficients, intercept); the intercept is not shrunk."""
    a = np.column_stack([x, np.ones(len(x))])
    penalty = np.diag([ridge] * x.shape[1] + [0.0])
    beta = np.zeros(a.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ beta, -30, 30)))
        gradient = a.T @ (weight * (y - p)) - penalty @ beta
        change = np.linalg.solve((a * (weight * p * (1 - p))[:, None]).T @ a + penalty + 1e-9 * np.eye(len(beta)), gradient)
        beta += change
        if np.abs(change).max() < 1e-10:
            break
    return beta[:-1], float(beta[-1])


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Rows of a list column of one length as a matrix."""
    rows = column.combine_chunks()
    return np.asarray(rows.flatten(), np.float64).reshape(len(rows), -1)


def grouped(df: DataFrame, keys: list[str], order: str, values: str, solve: Callable[[np.ndarray], list[dict]], schema: str) -> DataFrame:
    """``solve`` over each key's matrix of ``values`` rows in order: its dicts become rows with the keys."""
    return by_road(df.select(*keys, order, values), keys, order, lambda road: solve(matrix(road[values])), schema)


def by_road(df: DataFrame, keys: list[str], order: str, solve: Callable[[pa.Table], list[dict]], schema: str) -> DataFrame:
    """``solve`` over each key's rows in order, as an Arrow table: its dicts become rows with the keys. A key's rows, a road, are one unit of work."""
    target = to_arrow_schema(StructType.fromDDL(schema))

    def run(road: pa.Table) -> pa.Table:
        road = road.sort_by(order)
        own = {k: road[k][0].as_py() for k in keys}
        return pa.Table.from_pylist([own | r for r in solve(road)], schema=target)

    return df.groupBy(*keys).applyInArrow(run, schema)
