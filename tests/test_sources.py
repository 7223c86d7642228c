import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathomline.sources import radar, sinks, survey
from fathomline.streaming import replay


def trace_file(path, traces=20, samples=16, channels=2, bits=32, cut=0):
    head = bytearray(1024)
    for name, value in {"tag": 255, "data_field": 1, "samples": samples, "bits": bits, "scans_per_meter": 10.0, "range_ns": 15.0, "channels": channels, "dielectric": 7.0}.items():
        at, code = radar.HEADER[name]
        struct.pack_into("<" + code, head, at, value)
    head[98:103] = b"51600"
    kind = radar.SAMPLE[bits][0]
    cube = (np.arange(traces * channels * samples) % 200).astype(kind).reshape(traces, channels, samples)
    data = bytes(head) + cube.tobytes()
    path.write_bytes(data[: len(data) - cut])
    return cube


@pytest.mark.parametrize("bits", [8, 16, 32])
def test_trace_source(spark, tmp_path, monkeypatch, bits):
    cube = trace_file(tmp_path / "road.dzt", bits=bits)
    radar.register(spark)
    read = spark.read.format("traces").option("path", f"{tmp_path}/road.dzt")
    got = {(r.trace, r.channel): r.samples for r in read.load().collect()}
    assert len(got) == 40 and np.allclose(got[3, 1], cube[3, 1].astype(float) - radar.SAMPLE[bits][1])
    part = read.option("start", 5).option("stop", 9).option("channel", 0).load()
    assert sorted((r.trace, r.channel) for r in part.collect()) == [(i, 0) for i in range(5, 9)]


def test_headers(spark, tmp_path):
    trace_file(tmp_path / "road.dzt")
    row = radar.headers(spark, str(tmp_path)).first()
    assert (row.traces, row.samples, row.channels, row.antenna, row.dielectric) == (20, 16, 2, "51600", 7.0) and len(row.sha256) == 64
    with pytest.raises(ValueError):
        radar.parse_header(b"x" * 100, 100)
    trace_file(tmp_path / "cut.dzt", cut=3)
    with pytest.raises(ValueError):
        radar.parse_header((tmp_path / "cut.dzt").read_bytes()[:1024], (tmp_path / "cut.dzt").stat().st_size)


def test_positions(spark, tmp_path):
    (tmp_path / "a.dzg").write_text("$GSSIS,0,1\n$GPGGA,1.0,3130.0,N,07420.5,E,1,7,1,210.5,M\n$GSSIS,10,1\nbroken\n$GPGGA,2.0,3130.0,N,07420.5,E,1,7,1,210.5,M\n$GSSIS,20,1\n$GPGGA,3.0,3130.0,S,07420.5,W,0,7,1,1,M\n$GSSIS,30,1\n$GPGGA,3.0,3115.0,S,07415.0,W,2,9,1,,M\n")
    rows = [tuple(r)[1:] for r in survey.positions(spark, f"{tmp_path}/a.dzg").orderBy("trace").collect()]
    assert rows == [(0, "1.0", 31.5, 74 + 20.5 / 60, 210.5, 1, 7), (30, "3.0", -31.25, -74.25, None, 2, 9)]


def test_layer_picks(spark, tmp_path):
    (tmp_path / "a.dzx").write_text("<DZX><LayerGroup><layerNum>1</layerNum><groupName>Base</groupName><LayerWayPt><scanSampChanProp>3, 40,0,1</scanSampChanProp><timeAmpDepVel>2.5,7,0.1,0.2</timeAmpDepVel></LayerWayPt></LayerGroup></DZX>")
    assert [tuple(r)[1:] for r in survey.layer_picks(spark, f"{tmp_path}/a.dzx").collect()] == [(1, "Base", 3, 40, 0, 1, 2.5, 7.0, 0.1, 0.2)]


def test_design_schedule(spark, tmp_path):
    (tmp_path / "d.csv").write_text("﻿road_id,start_chainage_m,end_chainage_m,layer_name,design_thickness_mm,tolerance_low_mm\nr,0,100, Base ,50 mm,40\nr,,5,Base,1,\nr,100,200,Base,2 in,\n", encoding="utf-8")
    rows = [tuple(r) for r in survey.design_schedule(spark, f"{tmp_path}/d.csv").orderBy("start_m").collect()]
    assert rows[0] == ("r", 0.0, 100.0, "Base", 50.0, 40.0, pytest.approx(55.0)) and rows[1][4] == 50.8 and len(rows) == 2
    (tmp_path / "bad.csv").write_text("road_id\nr\n")
    with pytest.raises(ValueError):
        survey.design_schedule(spark, f"{tmp_path}/bad.csv")


def test_seeds(spark, tmp_path):
    pick = {"sample_index": 4.0, "visibility": "visible", "user_confirmed": True}
    doc = {"schema_version": 4, "survey_id": "s", "layers": {"1": "a"}, "stations": [{"station_id": "x", "chainage_m": 1.5, "role": "seed", "picks": {"1": pick, "2": pick | {"visibility": "absent"}}}]}
    (tmp_path / "s.json").write_text(json.dumps(doc, indent=1))
    assert sorted((r.layer, r["sample"], r.visibility) for r in survey.seeds(spark, f"{tmp_path}/s.json").collect()) == [(1, 4.0, "visible"), (2, None, "absent")]
    doc["schema_version"] = 3
    (tmp_path / "s.json").write_text(json.dumps(doc))
    with pytest.raises(Exception, match="seed file"):
        survey.seeds(spark, f"{tmp_path}/s.json").collect()


def test_catalogue(spark, tmp_path):
    for name in ("a.dzt", "a.dzg", "b.dzx"):
        (tmp_path / name).write_bytes(b"x")
    surveys, orphans = survey.catalogue(survey.inventory(spark, str(tmp_path)))
    assert [(r.stem, r.positions is not None, r.metadata) for r in surveys.collect()] == [("a", True, None)] and [r.stem for r in orphans.collect()] == ["b"]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, 2.0, 3.0, [1, 2]), (2, None, 3.0, None)], "id int, lat double, lon double, tags array<int>")
    features = [json.loads(r.feature) for r in sinks.geojson(df, "lat", "lon").collect()]
    assert features == [{"type": "Feature", "geometry": {"type": "Point", "coordinates": [3.0, 2.0]}, "properties": {"id": 1, "tags": [1, 2]}}]
    sinks.write_csv(df, f"{tmp_path}/out")
    assert [r.tags for r in spark.read.option("header", True).csv(f"{tmp_path}/out").orderBy("id").collect()] == ["[1,2]", None]
    old, new = spark.createDataFrame([(1, 1, "a"), (2, 5, "b")], "k int, v int, x string"), spark.createDataFrame([(1, 1, "c"), (2, 4, "d"), (3, 1, "e")], "k int, v int, x string")
    assert sorted(tuple(r) for r in sinks.keep_latest(old, new, ["k"], "v").collect()) == [(1, 1, "c"), (2, 5, "b"), (3, 1, "e")]
    assert len({r[0] for r in df.select(sinks.manifest(df, ["id", "lat"])).collect()}) == 2


def test_streaming_replay(spark, tmp_path):
    rows = spark.sql("select cast('2024-01-01 10:00:00' as timestamp) ts, 'a' k, 'x' d union all select cast('2024-01-01 11:00:00' as timestamp), 'a', 'y' union all select cast('2024-01-02 09:00:00' as timestamp), 'b', 'z'")
    rows.write.parquet(f"{tmp_path}/log")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/log")
    query = replay.latest_decisions(stream, ["k"], "ts", "d").writeStream.outputMode("complete").format("memory").queryName("latest").start()
    query.processAllAvailable()
    query.stop()
    assert sorted((r.k, r.d, r.actions) for r in spark.table("latest").collect()) == [("a", "y", 2), ("b", "z", 1)]
    batch = replay.latest_decisions(rows, ["k"], "ts", "d").select(F.col("k"), "d").collect()
    assert sorted(tuple(r) for r in batch) == [("a", "y"), ("b", "z")]


def test_checkpoints_fail_on_anything_unsound(spark, tmp_path):
    point = {"checkpoint_id": "a", "layer_order": 1, "chainage_m": 1.0, "sample_index": 4.0, "user_confirmed": True}
    doc = {"schema_version": 1, "survey_id": "s", "selection_source": "radar_only", "checkpoints": [point, point | {"checkpoint_id": "b", "visibility": "absent", "sample_index": None}]}

    def rows(change):
        made = json.loads(json.dumps(doc))
        change(made)
        (tmp_path / "c.json").write_text(json.dumps(made, indent=1))
        return survey.checkpoints(spark, f"{tmp_path}/c.json").collect()

    assert sorted((r.checkpoint_id, r.canonical_sample_index, r.regime_id, r.pulse_width_samples) for r in rows(lambda m: None)) == [("a", 4.0, "default", 7.0), ("b", None, "default", 7.0)]
    for change in (lambda m: m.update(schema_version=2), lambda m: m.update(survey_id=" "), lambda m: m.update(checkpoints=[]), lambda m: m["checkpoints"][1].update(checkpoint_id="a"), lambda m: m["checkpoints"][0].update(user_confirmed=False), lambda m: m["checkpoints"][0].update(sample_index=None), lambda m: m["checkpoints"][0].update(layer_order=4), lambda m: m["checkpoints"][0].update(pulse_width_samples=0.0)):
        with pytest.raises(Exception, match="checkpoint file"):
            assert rows(change)


def test_native_observations_are_bound_to_their_file(spark):
    x = np.sin(np.arange(16) / 2.0)
    traces = spark.createDataFrame([("f", 0, 0, x.tolist()), ("f", 1, 0, (-x).tolist())], "file string, trace long, channel int, samples array<double>")

    def rows(points, sha="h", layer="2"):
        doc = json.dumps({"schema": "conventional-native-seeds-v1", "mode": "processed", "dzt_sha256": sha, "observations": {layer: points}})
        return survey.native_observations(spark.createDataFrame([("f", doc, "h")], "file string, document string, sha256 string"), traces).collect()

    point = {"trace": 0, "sample": 3, "channel": 0}
    got = {r.trace: r for r in rows([point, point | {"trace": 1}])}
    spectrum = np.fft.fft(x)
    spectrum[1:8] *= 2
    spectrum[9:] = 0
    phase = np.angle(np.fft.ifft(spectrum)[3])
    assert (got[0].polarity, got[1].polarity, got[0].width, got[0].lobe) == (1, -1, 6, "positive_peak") and got[0].phase_class == int((phase + np.pi) * 8 / (2 * np.pi))
    for bad in ([point, point], [point | {"sample": 16}], [point | {"channel": 1}], [point | {"trace": 5}]):
        with pytest.raises(Exception, match="off the grid"):
            assert rows(bad)
    with pytest.raises(Exception, match="another schema"):
        assert rows([point], sha="other")
    with pytest.raises(Exception, match="off the grid"):
        assert rows([point], layer="7")


def test_support_never_snaps(spark):
    kind = "file string, layer int, trace long, sample long"
    reviewed = spark.createDataFrame([("f", 1, 0, 5), ("f", 1, 4, 6), ("f", 1, 5, 6), ("f", 2, 0, 9)], kind)
    rows = lambda given: sorted(tuple(r) for r in survey.support(spark.createDataFrame(given, kind), reviewed, 4).collect())
    assert rows([("f", 1, 4, 6), ("f", 2, 0, 9)]) == [("f", 1, 1, 6), ("f", 2, 0, 9)]
    for bad in ([("f", 1, 4, 6)], [("f", 1, 4, 7), ("f", 2, 0, 9)], [("f", 1, 5, 6), ("f", 2, 0, 9)], [("f", 1, 4, 6), ("f", 1, 4, 6), ("f", 2, 0, 9)], [("f", 1, 4, 6), ("f", 2, 0, 9), ("f", 3, 0, 9)]):
        with pytest.raises(Exception, match="reviewed observation"):
            assert rows(bad)


def test_records_notice_changed_content(spark, tmp_path):
    from fathomline.sources import cache

    rows = spark.createDataFrame([("a", t, [0, 0, t + 1, 2, 3, 3]) for t in range(5)] + [("b", 0, [1, 2, 3, 4, 5, 6])], "record string, trace long, samples array<long>")
    labels = spark.createDataFrame([("a", 1, 0, 3, 2), ("a", 1, 1, 3, 9), ("a", 1, 2, 0, 0), ("a", 1, 3, 2, 4), ("a", 1, 3, 3, 2), ("b", 1, 0, 3, 4), ("b", 2, 0, 2, 3), ("b", 1, 7, 0, 0)], "record string, layer int, trace long, sample long, amplitude long")
    reasons = sorted((r.record, r.layer, r.trace, r["sample"], r.reason) for r in cache.label_reasons(labels, rows).collect())
    assert reasons == [("a", 1, 0, 3, None), ("a", 1, 1, 3, "amplitude"), ("a", 1, 2, 0, "padding"), ("a", 1, 3, 2, "conflict"), ("a", 1, 3, 3, "conflict"), ("b", 1, 0, 3, "order"), ("b", 1, 7, 0, "off_grid"), ("b", 2, 0, 2, "order")]
    manifest = {r.record: (r.traces, r.samples, r.labels) for r in cache.write_records(rows, labels, f"file://{tmp_path}/r").collect()}
    assert manifest == {"a": (5, 6, 1), "b": (1, 6, 0)}
    assert all(r.intact for r in cache.verified(spark, f"file://{tmp_path}/r").collect())
    rows.limit(1).selectExpr("trace + 100 as trace", "cast(samples as array<float>) samples", "array(true) as valid").write.mode("append").parquet(f"{tmp_path}/r/traces/record=a")
    assert {r.record: r.intact for r in cache.verified(spark, f"file://{tmp_path}/r").collect()} == {"a": False, "b": True}


def test_seed_identity_is_asked_for(spark, tmp_path):
    pick = {"sample_index": 4.0, "visibility": "visible", "user_confirmed": True, "canonical_sample_index": 4.5, "phase_class": 3, "analytic_phase_rad": 0.1, "polarity": -1, "selected_lobe": "negative_trough", "pulse_width_samples": 6.0, "event_id": "e", "regime_id": "default"}

    def rows(change=None, twice=False):
        own = {k: v for k, v in (pick | (change or {})).items() if v is not None}
        station = {"station_id": "x", "chainage_m": 1.5, "role": "seed", "picks": {"1": own}}
        doc = {"schema_version": 4, "survey_id": "s", "layers": {}, "stations": [station] * (1 + twice)}
        (tmp_path / "s.json").write_text(json.dumps(doc))
        return survey.seeds(spark, f"{tmp_path}/s.json", identity=True).collect()

    assert [(r["sample"], r.canonical_sample_index, r.selected_lobe) for r in rows()] == [(4.0, 4.5, "negative_trough")]
    assert len(rows({"visibility": "absent", "event_id": None})) == 1
    for change in ({"event_id": None}, {"phase_class": 9}, {"pulse_width_samples": 0.0}, {"polarity": None}):
        with pytest.raises(Exception, match="seed file"):
            rows(change)
    with pytest.raises(Exception, match="seed file"):
        rows(twice=True)


def test_support_of_an_older_evaluation(spark):
    reviewed = spark.createDataFrame([("f", 1, 6, 40), ("f", 1, 12, 41), ("f", 2, 6, 70)], "file string, layer int, trace long, sample long")
    columns = "file string, method string, layer int, seed_row int, stride int"
    rows = [("f", m, layer, row, 6) for m in ("a", "b") for layer, row in ((1, 1), (1, 2), (2, 1))]
    got = survey.support_of_evaluation(spark.createDataFrame(rows, columns), reviewed)
    assert sorted(map(tuple, got.collect())) == [("f", 1, 6, 40), ("f", 1, 12, 41), ("f", 2, 6, 70)]
    assert sorted(map(tuple, survey.support(got, reviewed, 3).collect())) == [("f", 1, 2, 40), ("f", 1, 4, 41), ("f", 2, 2, 70)]
    for wrong in (rows[:-1], [*rows, ("f", "a", 1, 5, 6), ("f", "b", 1, 5, 6)], [(*r[:4], 0) for r in rows]):
        with pytest.raises(Exception, match="seed"):
            survey.support_of_evaluation(spark.createDataFrame(wrong, columns), reviewed).collect()
