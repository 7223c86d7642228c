"""What the trace source reads for a query, and what its stream reads of files that grow."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathomline.sources import radar


def write(path, first, count, channels=2, samples=4, torn=0):
    """A file with traces whose samples say which they are; ``torn`` bytes of one more."""
    cube = np.arange(first, first + count)[:, None, None] * 100 + np.arange(channels)[None, :, None] * 10 + np.arange(samples)
    data = cube.astype("<i4").tobytes()
    path.write_bytes(radar.encode_header({"samples": samples, "bits": 32, "channels": channels}) + data + b"\0" * torn)


@pytest.fixture
def folder(spark, tmp_path):
    radar.register(spark)
    for name, n in (("a", 20_000), ("b", 9), ("c", 3)):
        write(tmp_path / f"{name}.dzt", 0, n)
    return tmp_path


def chunks(folder, *filters):
    reader = radar._TraceReader({"path": f"file://{folder}", "pushed": "true"})
    left = list(reader.pushFilters(filters))
    return [(c.path.rpartition("/")[2][0], c.start, c.stop) for c in reader.partitions()], left, reader.channels


def test_predicates_become_chunks(folder):
    eq, ge, lt, gt, le, one_of = radar.EqualTo, radar.GreaterThanOrEqual, radar.LessThan, radar.GreaterThan, radar.LessThanOrEqual, radar.In
    assert chunks(folder)[0] == [("a", 0, 8192), ("a", 8192, 16384), ("a", 16384, 20000), ("b", 0, 9), ("c", 0, 3)]
    assert chunks(folder, ge(("trace",), 8190), lt(("trace",), 8195))[0] == [("a", 8190, 8195)]
    assert chunks(folder, gt(("trace",), 2), le(("trace",), 5))[0] == [("a", 3, 6), ("b", 3, 6)]
    assert chunks(folder, eq(("trace",), 8), radar.IsNotNull(("trace",)))[:2] == ([("a", 8, 9), ("b", 8, 9)], [])
    rule = one_of(("trace",), (5, 7))
    assert chunks(folder, rule)[:2] == ([("a", 5, 8), ("b", 5, 8)], [rule])
    assert chunks(folder, one_of(("file",), ("b.dzt", "c.dzt")), radar.StringStartsWith(("file",), "b"))[0] == [("b", 0, 9)]
    assert chunks(folder, eq(("channel",), 1))[2] == {1} and chunks(folder, eq(("channel",), 1), eq(("channel",), 0))[0] == []
    other = radar.EqualTo(("samples",), [1.0])
    assert chunks(folder, other)[1] == [other]


def test_plans_and_rows(spark, folder):
    wanted = (F.col("file") == "b.dzt") & (F.col("trace") > 6) & (F.col("channel") == 1) & (F.col("trace") % 2 == 0)
    some = radar.traces(spark, f"file://{folder}", wanted)
    assert [(r.trace, r.channel, r.samples) for r in some.collect()] == [(8, 1, [810.0, 811.0, 812.0, 813.0])]
    plan = some._jdf.queryExecution().executedPlan().toString()
    conditions = " ".join(line for line in plan.splitlines() if "Filter (" in line)
    assert "file" not in conditions and "channel" not in conditions and "% 2" in conditions
    assert some.rdd.getNumPartitions() == 1 and radar.traces(spark, f"file://{folder}").rdd.getNumPartitions() == 5
    assert radar.traces(spark, f"file://{folder}", "file = 'nowhere'").collect() == []


def test_frames_are_used_more_than_once(spark, folder):
    """All scans of a frame read the same, in one plan or another, with further predicates or without."""
    for rows in (radar.traces(spark, f"file://{folder}"), spark.read.format("traces").option("path", f"file://{folder}").load()):
        assert [rows.filter("file = 'b.dzt' and trace > 6").count(), rows.count(), rows.filter("trace < 2").count(), rows.count()] == [4, 40_024, 12, 40_024]
        both = rows.filter("file = 'c.dzt'").select("file", "trace", "channel").join(rows, ["file", "trace", "channel"])
        assert both.count() == 6 and rows.filter("trace < 1").unionByName(rows).count() == 40_030
    few = radar.traces(spark, f"file://{folder}", "trace between 3 and 10")
    assert few.count() == 28 and few.filter("trace = 4").unionByName(few).unionByName(few.filter("file = 'b.dzt'")).count() == 4 + 28 + 12


def batch(spark, folder, out):
    rows = spark.readStream.format("traces").option("path", f"file://{folder}").load().filter("channel = 0").select("file", "trace", F.get("samples", F.lit(0)).cast("int").alias("v"))
    rows.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/progress").trigger(availableNow=True).start().awaitTermination()
    got = [(r.file[0], r.trace, r.v) for r in spark.read.schema(rows.schema).parquet(f"{out}/rows").collect()]
    assert len(set(got)) == len(got) and all(v == 100 * t for _, t, v in got)
    return {name: sorted(t for f, t, _ in got if f == name) for name in "abc"}


def test_each_trace_once_also_after_a_restart(spark, tmp_path_factory):
    radar.register(spark)
    folder, out = tmp_path_factory.mktemp("files"), f"file://{tmp_path_factory.mktemp('out')}"
    write(folder / "a.dzt", 0, 5, torn=7)
    assert batch(spark, folder, out) == {"a": list(range(5)), "b": [], "c": []}
    write(folder / "a.dzt", 0, 8)
    (folder / "b.dzt").write_bytes(b"")  # a file that is only just made
    assert batch(spark, folder, out) == {"a": list(range(8)), "b": [], "c": []}
    write(folder / "b.dzt", 0, 2, torn=3)
    write(folder / "c.dzt", 0, 10_000)
    assert batch(spark, folder, out) == {"a": list(range(8)), "b": [0, 1], "c": list(range(10_000))}
    assert batch(spark, folder, out)["b"] == [0, 1]
    write(folder / "a.dzt", 0, 2)
    with pytest.raises(Exception, match="lost traces"):
        batch(spark, folder, out)
