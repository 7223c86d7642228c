import threading
import zipfile

import numpy as np

from fathomline.operators import signal
from fathomline.sources import sheets, store


def workbook(path):
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="Road 1" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}"><si><t>Chainage (m)</t></si><si><t>Asphalt depth (cm)</t></si><si><t>Base course depth (mm)</t></si></sst>')
        rows = '<row r="1"><c r="A1" t="inlineStr"><is><t>Survey</t></is></c></row><row r="2"><c r="A2" t="s"><v>0</v></c><c r="B2" t="s"><v>1</v></c><c r="C2" t="s"><v>2</v></c></row>'
        rows += '<row r="3"><c r="A3"><v>5</v></c><c r="B3"><v>4.8</v></c><c r="C3"><v>132</v></c></row><row r="4"><c r="A4"><v>10</v></c><c r="B4"><v>5</v></c><c r="C4"><f>FORECAST(A4,C3:C3,A3:A3)</f><v>140</v></c></row>'
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{main}"><sheetData>{rows}</sheetData></worksheet>')


def test_reference_workbook(spark, tmp_path):
    workbook(tmp_path / "r.xlsx")
    got = [(r.chainage_m, r.layer, round(r.depth_mm, 6), round(r.thickness_mm, 6), r.origin) for r in sheets.reference_depths(sheets.cells(spark, str(tmp_path))).orderBy("chainage_m", "layer").collect()]
    assert got == [(5.0, 1, 48.0, 48.0, "manual"), (5.0, 3, 132.0, 84.0, "manual"), (10.0, 1, 50.0, 50.0, "manual"), (10.0, 3, 140.0, 90.0, "extrapolated")]


def test_origins_by_fill(spark, tmp_path):
    """Fills of cells name interpolated depths, also under a formula; a layer that is less deep than the one above has no thickness."""
    workbook(tmp_path / "plain.xlsx")
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    fills = '<fill><patternFill patternType="none"/></fill><fill><patternFill patternType="solid"><fgColor rgb="fffff2cc"/></patternFill></fill><fill><patternFill patternType="solid"><fgColor rgb="FF00FF00"/></patternFill></fill><fill><patternFill patternType="gray125"><fgColor rgb="FFFFF2CC"/></patternFill></fill><fill><patternFill patternType="solid"><fgColor theme="4"/></patternFill></fill>'
    styles = f'<styleSheet xmlns="{main}"><fills>{fills}</fills><cellStyleXfs><xf fillId="1"/></cellStyleXfs><cellXfs>' + "".join(f'<xf fillId="{k}"/>' for k in range(5)) + "</cellXfs></styleSheet>"
    cell = lambda at, style, value, formula="": f'<c r="{at}" s="{style}">{formula}<v>{value}</v></c>'
    body = '<row r="1"><c r="A1" t="inlineStr"><is><t>Chainage</t></is></c><c r="B1" t="inlineStr"><is><t>Asphalt depth (mm)</t></is></c><c r="C1" t="inlineStr"><is><t>Base course depth (mm)</t></is></c></row>'
    rows = [("0", cell("B2", 1, 40), cell("C2", 0, 90)), ("5", cell("B3", 2, 41), cell("C3", 1, 91, "<f>FORECAST(1,2,3)</f>")), ("10", cell("B4", 3, 42), cell("C4", 4, 92, "<f>B4+50</f>")), ("15", cell("B5", 0, 60), cell("C5", 0, 50, "<f>TREND(1)</f>"))]
    body += "".join(f'<row r="{k}"><c r="A{k}"><v>{x}</v></c>{b}{c}</row>' for k, (x, b, c) in enumerate(rows, 2))
    with zipfile.ZipFile(tmp_path / "plain.xlsx") as old, zipfile.ZipFile(tmp_path / "fills.xlsx", "w") as new:
        for name in old.namelist():
            new.writestr(name, f'<worksheet xmlns="{main}"><sheetData>{body}</sheetData></worksheet>' if "worksheets" in name else old.read(name))
        new.writestr("xl/styles.xml", styles)
    got = sheets.reference_depths(sheets.cells(spark, f"{tmp_path}/fills.xlsx")).orderBy("chainage_m", "layer").collect()
    assert [(r.chainage_m, r.layer, r.origin, r.thickness_mm) for r in got] == [(0, 1, "interpolated", 40), (0, 3, "manual", 50), (5, 1, "manual", 41), (5, 3, "interpolated", 50), (10, 1, "manual", 42), (10, 3, "formula", 50), (15, 1, "manual", 60), (15, 3, "extrapolated", None)]


def test_project(spark, tmp_path):
    project = store.Project(spark, f"file://{tmp_path}/p")
    assert project.read("seed_stations").count() == 0 and project.latest_parameters() is None
    assert [project.new_run("a"), project.new_run("b")] == [1, 2] and project.latest_parameters() == "b"
    assert project.new_run("c") == 3 and project.latest_parameters() == "c"
    columns = "station_id string, chainage_m double, role string, picks string, version long"
    project.write("seed_stations", spark.createDataFrame([("x", 1.0, "seed", '{"1": 5.0}', 1), ("y", 0.5, "seed", '{"1": 4.0, "2": null}', 2)], columns))
    project.write("seed_stations", spark.createDataFrame([("x", 1.0, "seed", '{"1": 6.0}', 3)], columns))
    assert {r.layer: [tuple(a) for a in r.anchors] for r in project.anchors().collect()} == {1: [(0.5, 4.0), (1.0, 6.0)]}
    project.remove_last("seed_stations", "version")
    assert [r.station_id for r in project.read("seed_stations").collect()] == ["y"]
    for k in range(3):
        project.write("review_events", spark.createDataFrame([(k, "i", "accept", "")], store.TABLES["review_events"][0]))
    assert project.read("review_events").count() == 3


COLUMNS = "station_id string, chainage_m double, role string, picks string, version long"


def station(spark, *rows):
    return spark.createDataFrame([(k, 1.0, "seed", p, v) for k, v, p in rows], COLUMNS)


def stations(project, at=None):
    return {r.station_id: (r.version, r.picks) for r in project.read("seed_stations", at).collect()}


def test_latest_removed_and_compacted_rows(spark, tmp_path):
    project = store.Project(spark, f"file://{tmp_path}/a b")
    assert project.remove_last("seed_stations", "version") is None
    project.write("seed_stations", station(spark, ("x", 5, "a"), ("y", 7, "b")))
    project.write("seed_stations", station(spark, ("x", 4, "old"), ("y", 7, "same version, later")))
    assert stations(project) == {"x": (5, "a"), "y": (7, "same version, later")}
    project.remove_last("seed_stations", "version")
    assert stations(project) == {"x": (5, "a")} and stations(project, 1) == {"x": (5, "a"), "y": (7, "b")}
    project.write("seed_stations", station(spark, ("y", 2, "again")))
    before, kept = project.version("seed_stations"), stations(project)
    assert kept == {"x": (5, "a"), "y": (2, "again")}
    # A writer between the reading and the entry of a compaction keeps its rows.
    real = project.read
    project.read = lambda name, at=None: (real(name, at), project.__dict__.pop("read"), project.write(name, station(spark, ("z", 1, "between"))))[0]
    project.compact("seed_stations")
    assert stations(project) == kept | {"z": (1, "between")} and project.version("seed_stations") == before + 2
    project.remove_last("seed_stations", "version")
    assert stations(project) == {"y": (2, "again"), "z": (1, "between")} and stations(project, before) == kept


def test_writers_at_the_same_time_lose_nothing(spark, tmp_path):
    path = f"file://{tmp_path}/p"
    numbers, failed = [], []

    def work(writer):
        project = store.Project(spark, path)
        try:
            for k in range(4):
                project.write("seed_stations", station(spark, (f"{writer}-{k}", 10 * k + writer, "p"), ("shared", 10 * k + writer, f"{writer}")))
                project.write("review_events", spark.createDataFrame([(100 * writer + k, "i", "accept", "")], store.TABLES["review_events"][0]))
                numbers.append(project.new_run(f"{writer}-{k}"))
        except Exception as error:  # noqa: BLE001
            failed.append(error)

    threads = [threading.Thread(target=work, args=(w,)) for w in range(3)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    project = store.Project(spark, path)
    assert not failed
    assert stations(project) == {f"{w}-{k}": (10 * k + w, "p") for w in range(3) for k in range(4)} | {"shared": (32, "2")}
    assert sorted(r.event_id for r in project.read("review_events").collect()) == sorted(100 * w + k for w in range(3) for k in range(4))
    assert sorted(numbers) == list(range(1, 13)) and sorted(r.run_id for r in project.read("runs").collect()) == list(range(1, 13))


def test_a_change_that_was_read_too_early_starts_again(spark, tmp_path):
    project = store.Project(spark, f"file://{tmp_path}/p")
    project.write("seed_stations", station(spark, ("x", 1, "a"), ("y", 2, "b")))
    real, calls = project._commit, []

    def late(name, entry, seen=None):
        calls.append(seen)
        if len(calls) == 1:
            store.Project(project.spark, project.path).write(name, station(spark, ("z", 3, "c")))
        return real(name, entry, seen)

    project._commit = late
    project.remove_last("seed_stations", "version")
    assert calls == [1, 2] and set(stations(project)) == {"x", "y"}


def test_wavelets_and_alignment():
    t = np.arange(-20, 21) / 4
    wave = (1 - t**2) * np.exp(-(t**2) / 2)
    least = signal.minimum_phase(wave)
    energy = np.cumsum(least**2) / np.sum(least**2)
    assert energy[10] > (np.cumsum(wave**2) / np.sum(wave**2))[10]
    draw = np.random.default_rng(0)
    clean = np.zeros((3, 128))
    clean[:, 60:64] = 5
    noisy = clean + 0.2 * draw.standard_normal(clean.shape)
    assert np.linalg.norm(signal.soft_denoise(noisy) - clean) < np.linalg.norm(noisy - clean)
    target = np.zeros(30)
    target[12:15] = 1, 3, 1
    moved = np.stack([np.roll(target, s) for s in (-3, 0, 2)])
    shifts, back = signal.aligned(moved, target, 4)
    assert shifts.tolist() == [3, 0, -2] and np.allclose(back, target)
    x = signal.analytic(np.random.default_rng(3).standard_normal((5, 200)) ** 3)
    angle, _ = signal.sparsest_rotation(x.real)
    ratio = lambda v: np.percentile(np.abs(v), 99, axis=1) / np.median(np.abs(v), axis=1)
    turned = (signal.analytic(x.real) * np.exp(1j * angle[:, None])).real
    assert (ratio(turned) >= ratio(x.real) - 1e-9).all()
