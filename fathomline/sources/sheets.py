"""Cells of XLSX workbooks, read as zipped XML; no spreadsheet library is needed."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CELLS = "path string, sheet string, row int, col int, text string, formula string, fill string"
#: The fill of interpolated depths, a fixed value.
INTERPOLATED = "FFF2CC"
#: Words of headers, fixed values: what a column holds and its unit in mm.
DISTANCE = r"(?i)chainage|distance|station"
LAYERS = ((1, r"(?i)asphalt|surface|wearing"), (2, r"(?i)sub.?base"), (3, r"(?i)base"))


def _column(name: str) -> int:
    n = 0
    for c in name:
        n = n * 26 + ord(c) - 64
    return n


def solid_fills(styles: bytes) -> list[str | None]:
    """For each cell style of a workbook's style table the colour of its fill, if that is solid and given as red, green and blue."""
    local = lambda e: e.tag.rpartition("}")[2]
    parts = {local(e): e for e in ElementTree.fromstring(styles)}
    colours: list[str | None] = []
    for fill in parts.get("fills", ()):
        pattern = next((e for e in fill if local(e) == "patternFill" and e.get("patternType") == "solid"), ())
        colour = next((e.get("rgb") for e in pattern if local(e) == "fgColor"), None)
        colours.append(colour.upper() if colour else None)
    numbers = [int(xf.get("fillId", 0)) for xf in parts.get("cellXfs", ())]
    return [colours[n] if n < len(colours) else None for n in numbers]


def parse(data: bytes) -> Iterator[tuple[str, int, int, str | None, str | None, str | None]]:
    """(sheet, row, column, text, formula, fill) of every cell that holds anything, rows and columns from 1."""
    local = lambda e: e.tag.rpartition("}")[2]
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = set(z.namelist())
        shared = ["".join(t.text or "" for t in s.iter() if local(t) == "t") for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in names else []
        fills = solid_fills(z.read("xl/styles.xml")) if "xl/styles.xml" in names else []
        links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        for sheet in (e for e in ElementTree.fromstring(z.read("xl/workbook.xml")).iter() if local(e) == "sheet"):
            target = links[next(v for k, v in sheet.attrib.items() if k.endswith("}id"))]
            root = ElementTree.fromstring(z.read(target.lstrip("/") if target.startswith("/") else f"xl/{target}"))
            for cell in (e for e in root.iter() if local(e) == "c"):
                letters, digits = re.fullmatch(r"([A-Z]+)(\d+)", cell.get("r")).groups()
                parts = {local(x): x for x in cell}
                value = parts["v"].text if "v" in parts else "".join(t.text or "" for t in parts["is"].iter() if local(t) == "t") if "is" in parts else None
                if cell.get("t") == "s" and value is not None:
                    value = shared[int(value)]
                formula = parts["f"].text if "f" in parts else None
                if value is not None or formula is not None:
                    style = int(cell.get("s", 0))
                    yield sheet.get("name"), int(digits), _column(letters), value, formula, fills[style] if style < len(fills) else None


def cells(spark: SparkSession, path: str) -> DataFrame:
    """(path, sheet, row, col, text, formula, fill) of all workbooks below a path; a workbook is one task's unit."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(path).select("path", "content")

    def run(batches):
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = [(name, *c) for c in parse(content.as_py())]
                if found:
                    kinds = (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string())
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)], names=["path", "sheet", "row", "col", "text", "formula", "fill"])

    return files.mapInArrow(run, CELLS)


def reference_depths(sheet_cells: DataFrame, header_rows: int = 30) -> DataFrame:
    """(path, sheet, row, chainage_m, layer, depth_mm, thickness_mm, origin): long rows of wide reference sheets.

    The header is the first of ``header_rows`` rows with a distance and a layer column. Units in headers scale depths to mm (cm, in);
    thickness is the depth less that of the layer above there, null where it is less deep. Origin: interpolated (a solid fill of the colour for it), extrapolated (a FORECAST or
    TREND formula), formula, manual.
    """
    layer = F.lit(None).cast("int")
    for order, words in reversed(LAYERS):
        layer = F.when(F.col("text").rlike(words), order).otherwise(layer)
    heads = sheet_cells.filter(F.col("row") <= header_rows).select("path", "sheet", "row", "col", F.col("text").rlike(DISTANCE).alias("is_x"), layer.alias("layer"), F.when(F.col("text").rlike(r"(?i)\bin(ch|ches)?\b|\""), 25.4).when(F.col("text").rlike(r"(?i)\bcm\b"), 10.0).otherwise(1.0).alias("scale"))
    first = heads.groupBy("path", "sheet", "row").agg(F.bool_or("is_x").alias("x"), F.count("layer").alias("l")).filter("x and l > 0").groupBy("path", "sheet").agg(F.min("row").alias("head"))
    columns = heads.join(first, ["path", "sheet"]).filter("row = head").select("path", "sheet", "head", "col", "is_x", "layer", "scale")
    body = sheet_cells.join(columns, ["path", "sheet", "col"]).filter(F.col("row") > F.col("head"))
    at = body.filter("is_x").select("path", "sheet", "row", F.col("text").try_cast("double").alias("chainage_m")).filter("chainage_m is not null")
    origin = F.when(F.col("fill").endswith(INTERPOLATED), "interpolated").when(F.col("formula").rlike("(?i)FORECAST|TREND"), "extrapolated").when(F.col("formula").isNotNull(), "formula").otherwise("manual")
    depth = body.filter("layer is not null and not is_x").select("path", "sheet", "row", "layer", (F.col("text").try_cast("double") * F.col("scale")).alias("depth_mm"), origin.alias("origin")).filter("depth_mm is not null")
    w = Window.partitionBy("path", "sheet", "row").orderBy("layer")
    above = F.coalesce(F.lag("depth_mm").over(w), F.lit(0.0))
    return at.join(depth, ["path", "sheet", "row"]).withColumn("thickness_mm", F.when(F.col("depth_mm") >= above, F.col("depth_mm") - above))
