"""Best paths and max-marginals of chains of any length, by blocks.

A chain is a key's rows in order, each with a score for every state; a step from state i to j has the score ``step[i, j]``. The best
scores between the states at a block's two ends are a matrix, and matrices of neighbouring blocks multiply in the (max, +)
semiring. So blocks are multiplied in a tree, up to one matrix a key, and a second pass goes down the tree: it hands each node the states (for paths) or the
vectors (for marginals) at its ends, until every block knows its own and solves its rows. No unit of work holds more than a block of
rows or FAN matrices, whatever the length of a key, and a key's blocks are spread over all tasks. Each level is written before the next.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..workspace import held
from .selection import numbered
from .solvers import matrix

#: Rows of a block, and matrices that one unit of work multiplies.
BLOCK, FAN = 64, 16
NEVER = -1e18


def best_through(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(max, +) product: the best over middle states. ``a`` may be one row."""
    out = np.full((*a.shape[:-1], b.shape[1]), -np.inf)
    for k in range(b.shape[0]):
        np.maximum(out, a[..., k, None] + b[k], out=out)
    return out


def block_matrix(scores: np.ndarray, step: np.ndarray, first: bool) -> np.ndarray:
    """Best score from each state before the block to each state of its last row; of a key's first block all rows are equal, as nothing stands before."""
    at = np.tile(scores[0], (step.shape[0], 1)) if first else step + scores[0]
    for row in scores[1:]:
        at = best_through(at, step) + row
    return at


def block_path(scores: np.ndarray, step: np.ndarray, first: bool, entry: int, leave: int) -> list[int]:
    """States of a block's best path between the state before it and the state of its last row; of equal ones the lowest from the end on."""
    best, back = scores[0] if first else step[entry] + scores[0], []
    for row in scores[1:]:
        ways = best[:, None] + step
        back.append(ways.argmax(axis=0))
        best = ways.max(axis=0) + row
    path = [leave]
    for choice in reversed(back):
        path.append(int(choice[path[-1]]))
    return path[::-1]


def block_marginals(scores: np.ndarray, step: np.ndarray, first: bool, prefix: np.ndarray, suffix: np.ndarray) -> np.ndarray:
    """[row, state] the best score of a whole path through it."""
    ahead, back = np.empty_like(scores), np.empty_like(scores)
    ahead[0] = scores[0] if first else best_through(prefix, step) + scores[0]
    for k in range(1, len(scores)):
        ahead[k] = best_through(ahead[k - 1], step) + scores[k]
    back[-1] = suffix
    for k in range(len(scores) - 1, 0, -1):
        back[k - 1] = (step + (scores[k] + back[k])[None, :]).max(axis=1)
    return ahead + back


def _packed(m: np.ndarray) -> bytes:
    return np.ascontiguousarray(m, "<f8").tobytes()


def _matrices(node: pa.Table, states: int) -> list[np.ndarray]:
    return [np.frombuffer(x.as_py(), "<f8").reshape(states, states) for x in node["m"]]


class Chains:
    """The tree over ``df``: keys, a whole-number ``order`` that is unique within them, and ``scores``, an array of as many values as ``step`` has rows."""

    def __init__(self, df: DataFrame, keys: list[str], order: str, scores: str, step: np.ndarray, block: int = BLOCK, fan: int = FAN):
        self.keys, self.order, self.step, self.fan = keys, order, np.asarray(step, float), fan
        kinds = dict(df.dtypes)
        self.key_schema = "".join(f"{k} {kinds[k]}, " for k in keys)
        self.order_kind = kinds[order]
        rows = df.select(*keys, order, F.col(scores).cast("array<double>").alias("_s"))
        place = numbered(rows.select(*keys, order), keys, order, "_i").withColumn("_b", F.expr(f"_i div {block}"))
        self.rows = held(rows.join(place, [*keys, order]), "chain-rows")
        states, matrix_of = self.step, self._leaf()
        self.levels = [held(self.rows.groupBy(*keys, "_b").applyInArrow(matrix_of, self.key_schema + "_b long, m binary"), "chain-level")]
        while (self.levels[-1].agg(F.max("_b")).first()[0] or 0) > 0:
            grouped = self.levels[-1].withColumn("_p", F.expr(f"_b div {fan}")).groupBy(*keys, "_p")
            self.levels.append(held(grouped.applyInArrow(self._product(len(states)), self.key_schema + "_b long, m binary"), "chain-level"))

    def _leaf(self) -> Callable[[pa.Table], pa.Table]:
        step, keys = self.step, self.keys

        def run(block: pa.Table) -> pa.Table:
            block = block.sort_by("_i")
            made = block_matrix(matrix(block["_s"]), step, block["_b"][0].as_py() == 0)
            return pa.table({k: block[k][:1] for k in keys} | {"_b": block["_b"][:1], "m": pa.array([_packed(made)], pa.binary())})

        return run

    def _product(self, states: int) -> Callable[[pa.Table], pa.Table]:
        keys = self.keys

        def run(node: pa.Table) -> pa.Table:
            node = node.sort_by("_b")
            first, *others = _matrices(node, states)
            for m in others:
                first = best_through(first, m)
            return pa.table({k: node[k][:1] for k in keys} | {"_b": node["_p"][:1], "m": pa.array([_packed(first)], pa.binary())})

        return run

    def _down(self, top: DataFrame, columns: str, hand: Callable[[pa.Table, list[np.ndarray]], dict]) -> DataFrame:
        """``top``, what the roots know of their ends, handed to the blocks level by level; ``hand`` gives each child's from its node's."""
        states, keys, known = len(self.step), self.keys, top
        names = [c.split(" ")[0] for c in columns.split(", ")]

        def run(node: pa.Table) -> pa.Table:
            node = node.sort_by("_b")
            return pa.table({k: node[k] for k in keys} | {"_b": node["_b"]} | hand(node, _matrices(node, states)))

        for level in reversed(self.levels[:-1]):
            children = level.withColumn("_p", F.expr(f"_b div {self.fan}")).join(known.select(*self.keys, F.col("_b").alias("_p"), *names), [*self.keys, "_p"])
            known = held(children.groupBy(*self.keys, "_p").applyInArrow(run, f"{self.key_schema}_b long, {columns}"), "chain-down")
        return known

    def _solved(self, known: DataFrame, solve: Callable[[pa.Table], pa.Array], out: str, kind: str) -> DataFrame:
        keys, order = self.keys, self.order

        def run(block: pa.Table) -> pa.Table:
            block = block.sort_by("_i")
            return pa.table({k: block[k] for k in keys} | {order: block[order], out: solve(block)})

        return self.rows.join(known, [*self.keys, "_b"]).groupBy(*self.keys, "_b").applyInArrow(run, f"{self.key_schema}{self.order} {self.order_kind}, {out} {kind}")

    def _roots(self) -> DataFrame:
        """(keys, best, _leave) of the whole chains."""
        states, keys = len(self.step), self.keys

        def run(batches):
            for batch in batches:
                last = [np.frombuffer(x.as_py(), "<f8", states) for x in batch["m"]]
                columns = [batch[k] for k in keys] + [batch["_b"], pa.array([float(v.max()) for v in last], pa.float64()), pa.array([0] * len(last), pa.int32()), pa.array([int(v.argmax()) for v in last], pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, names=[*keys, "_b", "best", "_enter", "_leave"])

        return self.levels[-1].mapInArrow(run, f"{self.key_schema}_b long, best double, _enter int, _leave int")

    def best(self) -> DataFrame:
        """(keys, best): the score of each key's best path."""
        return self._roots().select(*self.keys, "best")

    def path(self, out: str = "state") -> DataFrame:
        """(keys, order, ``out``): the states of each key's best path, one of them where several are equally good."""

        def hand(node: pa.Table, matrices: list[np.ndarray]) -> dict:
            # The best way from the node's entry to its exit through its children's ends.
            best, back = matrices[0][node["_enter"][0].as_py()], []
            for m in matrices[1:]:
                ways = best[:, None] + m
                back.append(ways.argmax(axis=0))
                best = ways.max(axis=0)
            ends = [node["_leave"][0].as_py()]
            for choice in reversed(back):
                ends.append(int(choice[ends[-1]]))
            ends.reverse()
            return {"_enter": pa.array([node["_enter"][0].as_py(), *ends[:-1]], pa.int32()), "_leave": pa.array(ends, pa.int32())}

        step = self.step

        def solve(block: pa.Table) -> pa.Array:
            return pa.array(block_path(matrix(block["_s"]), step, block["_b"][0].as_py() == 0, block["_enter"][0].as_py(), block["_leave"][0].as_py()), pa.int32())

        return self._solved(self._down(self._roots().drop("best"), "_enter int, _leave int", hand), solve, out, "int")

    def marginals(self, out: str = "marginals") -> DataFrame:
        """(keys, order, ``out``): for every state of a row the score of the best whole path through it."""
        states, step = len(self.step), self.step
        vector = lambda x: np.frombuffer(x.as_py(), "<f8")

        def hand(node: pa.Table, matrices: list[np.ndarray]) -> dict:
            before, after = [vector(node["_before"][0])], [vector(node["_after"][0])]
            for m in matrices[:-1]:
                before.append(best_through(before[-1], m))
            for m in reversed(matrices[1:]):
                after.append((m + after[-1][None, :]).max(axis=1))
            return {"_before": pa.array(map(_packed, before), pa.binary()), "_after": pa.array(map(_packed, reversed(after)), pa.binary())}

        def solve(block: pa.Table) -> pa.Array:
            found = block_marginals(matrix(block["_s"]), step, block["_b"][0].as_py() == 0, vector(block["_before"][0]), vector(block["_after"][0]))
            return pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1, dtype=np.int32) * states), pa.array(found.ravel()))

        start = np.full(states, NEVER)
        start[0] = 0.0
        ends = self.levels[-1].select(*self.keys, "_b", F.lit(_packed(start)).alias("_before"), F.lit(_packed(np.zeros(states))).alias("_after"))
        return self._solved(self._down(ends, "_before binary, _after binary", hand), solve, out, "array<double>")


def slope_steps(states: int, slope: float, most: int | None = None) -> np.ndarray:
    """Steps that cost ``slope`` a state moved, at most ``most`` states counted."""
    index = np.arange(states)
    far = np.abs(index[:, None] - index[None, :])
    return -slope * (far if most is None else np.minimum(far, most))


def gap_steps(states: int, slope: float, enter: float) -> np.ndarray:
    """The same with one further state, a gap, that ``enter`` is the score of going to or leaving."""
    out = np.zeros((states + 1, states + 1))
    out[:states, :states] = slope_steps(states, slope)
    out[:states, states] = out[states, :states] = enter
    return out
