import numpy as np

from fathomline.operators import alignment, calibration


def pulse(n, at, width):
    z = (np.arange(n) - at) / width
    return (1 - z**2) * np.exp(-(z**2) / 2)


def test_reciprocal_alignment_with_displacement():
    draw = np.random.default_rng(1)
    a, b = draw.standard_normal((2, 4, 7))

    def plain(u, v, band):
        n = len(u)
        w = np.full((n + 1, n + 1), np.inf)
        w[0, 0] = 0
        way = {}
        for i in range(1, n + 1):
            for j in range(max(1, i - band), min(n, i + band) + 1):
                options = [w[i - 1, j - 1], w[i - 1, j], w[i, j - 1]]
                way[i, j] = int(np.argmin(options))
                w[i, j] = (u[i - 1] - v[j - 1]) ** 2 + min(options)
        i = j = n
        centre = []
        while i and j:
            if i - 1 == n // 2:
                centre.append(j - 1 - n // 2)
            step = way[i, j]
            i, j = i - (step != 2), j - (step != 1)
        return np.exp(-w[n, n]), np.mean(centre)

    one = [plain(u, v, 2) for u, v in zip(a, b, strict=True)]
    two = [plain(v, u, 2) for u, v in zip(a, b, strict=True)]
    agreement, shift = alignment.aligned_pairs(a, b, 2)
    assert np.allclose(agreement, [r[0] for r in one]) and np.allclose(shift, [r[1] for r in one])
    agreement, shift = alignment.reciprocal(a, b, 2)
    assert np.allclose(agreement, [min(p[0], q[0]) for p, q in zip(one, two, strict=True)]) and np.allclose(shift, [max(abs(p[1]), abs(q[1])) for p, q in zip(one, two, strict=True)])


def test_calibration_flattens_and_subtracts_only_what_compares():
    n = 128
    top = 40 + np.round(2 * np.sin(np.arange(50) / 5)).astype(int)
    road_ = np.stack([-4 * pulse(n, t, 3) + 1.0 * pulse(n, t + 40, 3) for t in top])
    plate = np.stack([-8 * pulse(n, 45, 3) + 3 * pulse(n, 60, 3)] * 9)
    made = calibration.calibrated(road_, plate, 20, 70)
    assert made["subtracted"] and (made["surface"] == top).all() and made["reference"] == int(np.median(top))
    r = made["reference"]
    flat = calibration.calibrated(road_, plate, 20, 70, same_setup=False)
    assert not flat["subtracted"] and np.abs(flat["corrected"][:, r] - flat["corrected"][0, r]).max() < 1e-9
    assert np.abs(made["corrected"][:, r]).max() < 0.2 * np.abs(flat["corrected"][:, r]).max() and made["corrected"][:, r + 40].min() > 0.5
    assert not calibration.calibrated(road_, plate, 20, 70, clipped=7.0)["subtracted"] and not calibration.calibrated(road_, None, 20, 70)["subtracted"]
    assert (calibration.moved(np.arange(6.0)[None], np.array([2])) == [[0, 0, 0, 1, 2, 3]]).all() and (calibration.moved(np.arange(6.0)[None], np.array([-2])) == [[2, 3, 4, 5, 0, 0]]).all()


def test_calibration_by_traces_equals_whole_roads_and_needs_no_plate(spark, small, tmp_path):
    from collections import defaultdict

    from fathomline.plans import registry

    query = registry.queries()["calibrated_roads"]
    table = spark.read.parquet(f"{small}/embeddings.parquet")
    roads = defaultdict(list)
    for r in table.orderBy("vec_id").collect():
        roads[r.label].append(r.embedding)
    roads = {k: np.array(v, float) for k, v in roads.items()}
    # Roads without a plate are still calibrated; with one, no row carries its traces.
    table.filter("label <> 0").write.parquet(f"{tmp_path}/embeddings.parquet")
    for where, plate in ((small, roads[0]), (str(tmp_path), None)):
        frame = query(spark, where)
        assert all(f.name != "plate" for f in frame.schema)
        got = defaultdict(list)
        for r in sorted(frame.collect(), key=lambda r: r.row):
            got[int(r.road)].append(r)
        assert set(got) == {k for k in roads if plate is not None or k}
        for k, rows in got.items():
            want = calibration.calibrated(roads[k], plate, 2, 20, same_setup=k % 2 == 0)
            assert [r.row for r in rows] == list(range(len(roads[k]))) and [r.surface for r in rows] == want["surface"].tolist()
            assert {(r.reference, r.subtracted) for r in rows} == {(want["reference"], want["subtracted"])}
            assert np.allclose([r.corrected for r in rows], want["corrected"], atol=1e-12)
