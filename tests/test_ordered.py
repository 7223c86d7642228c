"""The ordered replay as a stream against its batch form, on shuffled input, with late actions, and over restarts."""

import json
import random
import time

import pytest

from fathomline.streaming import ordered

COLUMNS = "user string, at long, number long, kind string, value long, basis long"


def fold(state, action):
    """Errors reset, others add up to a cap; an action made on another state than there is now is dropped."""
    if action.get("basis") is not None and action["basis"] != state["changes"]:
        return None
    level = 0 if action["kind"] == "reset" else min(state["level"] + action["value"], 50)
    return {"level": level, "changes": state["changes"] + 1}


START = {"level": 0, "changes": 0}


def log(seed, n=120):
    draw = random.Random(seed)
    return [(draw.choice("abc"), 10 * i + draw.randrange(3), i, draw.choice(["add", "add", "add", "reset"]), draw.randrange(20), draw.choice([None, None, None, draw.randrange(30)])) for i in range(n)]


def write(spark, folder, part, rows):
    spark.createDataFrame(rows, COLUMNS).coalesce(1).write.parquet(f"{folder}/in-{part}")


def run(spark, folder, delay):
    """One run over all there is, a file a batch; state and output stay in the folder for the next."""
    stream = spark.readStream.schema(COLUMNS).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in-*")
    out = ordered.replayed_stream(stream, "user", "at", "number", ["kind", "value", "basis"], fold, START, delay, None)
    out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/progress").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.schema(ordered.RESULT).parquet(f"{folder}/out").collect()
    last = {}
    for r in rows:
        if r.kind == "state" and (r.key not in last or (r.at, r.folded + r.dropped) > (last[r.key].at, last[r.key].folded + last[r.key].dropped)):
            last[r.key] = r
    return {k: (json.loads(r.state), r.folded, r.dropped) for k, r in last.items()}, sorted(r.number for r in rows if r.kind == "late")


def batch(spark, rows):
    got = ordered.replayed(spark.createDataFrame(rows, COLUMNS), "user", "at", "number", ["kind", "value", "basis"], fold, START).collect()
    return {r.key: (json.loads(r.state), r.folded, r.dropped) for r in got}


def plain(rows):
    out = {}
    for user in {r[0] for r in rows}:
        state, folded, dropped = START, 0, 0
        for _, _, _, kind, value, basis in sorted(r for r in rows if r[0] == user):
            made = fold(state, {"kind": kind, "value": value, "basis": basis})
            state, folded, dropped = (state, folded, dropped + 1) if made is None else (made, folded + 1, dropped)
        out[user] = (state, folded, dropped)
    return out


@pytest.fixture(autouse=True)
def few_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_shuffled_within_the_delay(spark, tmp_path):
    rows = log(1)
    assert batch(spark, rows) == plain(rows)
    draw = random.Random(2)
    late = sorted(rows, key=lambda r: r[1] + draw.randrange(100))
    for part in range(3):
        write(spark, tmp_path, part, late[40 * part : 40 * part + 40])
    got, dropped = run(spark, tmp_path, 100)
    assert got == plain(rows) and dropped == []


def test_late_and_repeated_actions_over_a_restart(spark, tmp_path):
    rows = log(3)
    behind = [rows[5], rows[11]]
    first, second = [r for r in rows[:60] if r not in behind], [*behind, *rows[55:]]
    write(spark, tmp_path, 0, first)
    assert run(spark, tmp_path, 60) == (plain(first), [])
    write(spark, tmp_path, 1, second)
    got, late = run(spark, tmp_path, 60)
    assert late == [5, 11] and got == plain([r for r in rows if r not in behind])
    assert run(spark, tmp_path, 60) == (got, late)


def test_the_clock_folds_what_waits(spark, tmp_path):
    rows = [("a", 1, 1, "add", 5, None), ("a", 2, 2, "add", 6, None)]
    write(spark, tmp_path, 0, rows)
    stream = spark.readStream.schema(COLUMNS).parquet(f"{tmp_path}/in-*")
    out = ordered.replayed_stream(stream, "user", "at", "number", ["kind", "value", "basis"], fold, START, 1000, 100)
    query = out.writeStream.format("memory").queryName("waiting").outputMode("append").start()
    try:
        for _ in range(60):
            found = {(r.pending, r.folded) for r in spark.table("waiting").collect()}
            if (0, 2) in found:
                break
            time.sleep(0.5)
    finally:
        query.stop()
    assert (2, 2) in found and (0, 2) in found
