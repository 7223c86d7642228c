"""Replay of actions in the order of their time, as a stream that puts them in order and as a batch.

Actions of a key arrive out of order, by ``delay`` at most as a rule. The stream holds them in a buffer, sorted by time and number, and folds an action when the key
has seen one that is later by ``delay``, or when nothing has come for ``idle`` of the clock. An action older than what was folded is late: it changes nothing and
is given out as such. A fold that returns nothing drops its action, as one must whose author saw another state than there is now. All of it is in the state store, so a restart
goes on where the last batch ended.
"""

from __future__ import annotations

import bisect
import json
from collections.abc import Callable

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

#: Folds an action, a dict of its columns, into the state, which JSON can hold; None drops the action.
Fold = Callable[[object, dict], object | None]

RESULT = "key string, kind string, at long, number long, folded long, dropped long, late long, pending long, state string"
NAMES = [c.split(" ")[0] for c in RESULT.split(", ")]
ARROW = pa.schema([("key", pa.string()), ("kind", pa.string()), *((n, pa.int64()) for n in ("at", "number", "folded", "dropped", "late", "pending")), ("state", pa.string())])


def _step(fold: Fold, at: dict, action: dict) -> None:
    """Fold one action into ``at``: the state, and how many were folded and dropped."""
    made = fold(at["state"], action)
    if made is None:
        at["dropped"] += 1
    else:
        at["state"], at["folded"] = made, at["folded"] + 1


def _replayer(fold: Fold, start: object, delay: int, idle_ms: int | None):
    """The update of one key: its buffer and its state, one JSON text in the store."""

    def out(key, rows: list[tuple], known: dict, pending: int) -> pd.DataFrame:
        return pd.DataFrame([(key, kind, at, number, known["folded"], known["dropped"], known["late"], pending, json.dumps(known["state"])) for kind, at, number in rows], columns=NAMES).astype({"at": "Int64", "number": "Int64"})

    def fold_until(known: dict, until: int | None) -> None:
        held = sorted(known["held"])
        n = len(held) if until is None else bisect.bisect_right(held, until, key=lambda a: a[0])
        for at, number, action in held[:n]:
            _step(fold, known, json.loads(action))
            known["mark"] = [at, number]
        known["held"] = held[n:]

    def update(key, frames, store):
        known = json.loads(store.get[0]) if store.exists else {"state": start, "folded": 0, "dropped": 0, "late": 0, "mark": None, "seen": None, "held": []}
        if store.hasTimedOut:
            fold_until(known, None)
            store.update((json.dumps(known),))
            yield out(key[0], [("state", known["seen"], None)], known, 0)
            return
        late, places = [], {(a, n) for a, n, _ in known["held"]}
        for frame in frames:
            for at, number, action in zip(frame["at"].tolist(), frame["number"].tolist(), frame["action"].tolist(), strict=True):
                if known["mark"] is not None and [at, number] <= known["mark"]:
                    late.append(("late", at, number))
                elif (at, number) not in places:
                    places.add((at, number))
                    known["held"].append([at, number, action])
                    known["seen"] = max(at, known["seen"] if known["seen"] is not None else at)
        if known["seen"] is not None:
            fold_until(known, known["seen"] - delay)
        known["late"] += len(late)
        store.update((json.dumps(known),))
        if known["held"] and idle_ms is not None:
            store.setTimeoutDuration(idle_ms)
        # The state with what is pending folded for the eye alone: that of the batch, if no more comes.
        shown = {k: v for k, v in known.items() if k != "held"}
        for _, _, action in known["held"]:
            _step(fold, shown, json.loads(action))
        yield out(key[0], [*late, ("state", known["seen"], None)], shown, len(known["held"]))

    return update


def _actions(log: DataFrame, key: str, at: str, number: str, columns: list[str]) -> DataFrame:
    return log.select(F.col(key).cast("string").alias("key"), F.col(at).cast("long").alias("at"), F.col(number).cast("long").alias("number"), F.to_json(F.struct(*columns)).alias("action"))


def replayed_stream(log: DataFrame, key: str, at: str, number: str, columns: list[str], fold: Fold, start: object, delay: int, idle_ms: int | None = 3_600_000) -> DataFrame:
    """RESULT rows of a streaming ``log``: for every key with new actions its state, and every late action.

    ``at`` is a whole number, ``number`` tells actions of one time apart; one that comes twice counts once while it is buffered and is late afterwards. ``state``
    is JSON. What a key holds in the store is its state and the actions of its last ``delay``. With ``idle_ms`` None nothing waits for the clock, as a run over
what is available needs to end: Spark goes on with empty batches while a clock may run out.
    """
    return _actions(log, key, at, number, columns).groupBy("key").applyInPandasWithState(_replayer(fold, start, delay, idle_ms), RESULT, "value string", "append", GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout)


def replayed(log: DataFrame, key: str, at: str, number: str, columns: list[str], fold: Fold, start: object) -> DataFrame:
    """The same of a whole ``log``, one RESULT row a key: rows come sorted by Spark and are folded as they stream by, so no task holds a key's actions."""
    ordered = _actions(log, key, at, number, columns).repartition("key").sortWithinPartitions("key", "at", "number")

    def run(batches):
        key, known, last = None, None, None

        def row():
            return {"key": key, "kind": "state", "at": last[0], "number": None, "folded": known["folded"], "dropped": known["dropped"], "late": 0, "pending": 0, "state": json.dumps(known["state"])}

        for batch in batches:
            out = []
            for name, when, number, action in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if known is None or name != key:
                    if known is not None:
                        out.append(row())
                    key, known, last = name, {"state": start, "folded": 0, "dropped": 0}, None
                if (when, number) != last:
                    _step(fold, known, json.loads(action))
                last = (when, number)
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=ARROW)
        if known is not None:
            yield pa.RecordBatch.from_pylist([row()], schema=ARROW)

    return ordered.mapInArrow(run, RESULT)
