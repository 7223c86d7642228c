"""A project as a folder of Parquet tables: runs append, decisions keep their latest, events are a log. Several may write at once.

A table is a log of numbered entries, each a small file that names a folder of rows. Rows are written first, to a folder of their own; then
the entry is put under the next number, which only one writer can do, and the others take the number after. So no rows are lost, and a
reader sees whole entries alone. Writes of keyed tables add rows and marks of removal; the latest of each key is found when they are read. What depends on
what it has read, removing the last row or numbering a run, names the entry that it has seen and starts again where another has come after it.
"""

from __future__ import annotations

import json
import os
import uuid
from urllib.parse import unquote, urlparse

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: table: (schema, key columns, version column); without keys a table only grows. Fixed values.
TABLES = {
    "files": ("path string, sha256 string, length long, version long", ["path"], "version"),
    "design_segments": ("road_id string, start_m double, end_m double, layer string, thickness_mm double, version long", ["road_id", "start_m", "layer"], "version"),
    "seed_stations": ("station_id string, chainage_m double, role string, picks string, version long", ["station_id"], "version"),
    "runs": ("run_id long, parameters string, version long", [], None),
    "picks": ("run_id long, layer int, chainage_m double, status string, sample double", [], None),
    "review_events": ("event_id long, issue string, action string, payload string", [], None),
}


class Conflict(RuntimeError):
    """Another entry has come after the one that was read."""


class Project:
    """Tables below one path of any store that Spark writes to."""

    #: How often a change that depends on what it has read is tried.
    TRIES = 50

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    # ------------------------------------------------------------ the log

    def _hadoop(self, path: str):
        place = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return place, place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _put_if_absent(self, path: str, content: bytes) -> bool:
        """Make a file with this content where none is; False where there is one. Whole or not at all: it is written aside, then linked or renamed."""
        jvm, (target, system) = self.spark.sparkContext._jvm, self._hadoop(path)
        aside = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.tmp")
        system.mkdirs(target.getParent())
        stream = system.create(aside, False)
        stream.write(bytearray(content))
        stream.close()
        try:
            if system.getScheme() == "file":
                os.link(unquote(urlparse(aside.toUri().toString()).path), unquote(urlparse(target.toUri().toString()).path))
            else:
                jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration()).rename(aside, target, self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except FileExistsError:
            return False
        except Py4JJavaError as taken:
            if system.exists(target):
                return False
            raise taken
        finally:
            system.delete(aside, False)
        return True

    def entries(self, name: str, at: int | None = None) -> list[dict]:
        """The entries of a table in order, up to number ``at``: number, folder, and for a compaction the number that it replaces all up to."""
        folder, system = self._hadoop(f"{self.path}/{name}/log")
        if not system.exists(folder):
            return []
        names = sorted(s.getPath().getName() for s in system.listStatus(folder) if s.getPath().getName().endswith(".json"))
        out = []
        for file in names:
            number = int(file.split(".")[0])
            if at is None or number <= at:
                stream = system.open(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}/log/{file}"))
                out.append({"number": number} | json.loads(bytes(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))))
                stream.close()
        return out

    def version(self, name: str) -> int:
        """The number of a table's last entry, 0 without one."""
        return max((e["number"] for e in self.entries(name)), default=0)

    def _commit(self, name: str, entry: dict, seen: int | None = None) -> int:
        """Put an entry under the next number; with ``seen`` only if that is still the last."""
        number = (self.version(name) if seen is None else seen) + 1
        while not self._put_if_absent(f"{self.path}/{name}/log/{number:010d}.json", json.dumps(entry).encode()):
            if seen is not None:
                raise Conflict(f"{name} has an entry {number}")
            number += 1
        return number

    def _folder(self, name: str, rows: DataFrame, gone: bool | None) -> str:
        folder = uuid.uuid4().hex
        (rows if gone is None else rows.withColumn("_gone", F.lit(gone))).write.mode("errorifexists").parquet(f"{self.path}/{name}/rows/{folder}")
        return folder

    # ------------------------------------------------------------ tables

    def read(self, name: str, at: int | None = None) -> DataFrame:
        """A table as its entries up to ``at`` leave it: all rows of a log; of a keyed table the highest version of each key, of equal ones the last, that was not removed since."""
        schema, keys, version = TABLES[name]
        entries = self.entries(name, at)
        whole = max((e for e in entries if "replaces" in e), key=lambda e: e["replaces"], default=None)
        since = whole["replaces"] if whole else 0
        live = {e["folder"]: e["number"] for e in entries if "replaces" not in e and e["number"] > since} | ({whole["folder"]: since} if whole else {})
        if not live:
            return self.spark.createDataFrame([], schema)
        stored = self.spark.read.schema(schema + (", _gone boolean" if keys else "")).parquet(*[f"{self.path}/{name}/rows/{f}" for f in live])
        if not keys:
            return stored
        # One row an entry since the last compaction.
        order = self.spark.createDataFrame(list(live.items()), "_folder string, _number long")
        rows = stored.withColumn("_folder", F.element_at(F.split("_metadata.file_path", "/"), -2)).join(F.broadcast(order), "_folder")
        columns = [c for c in stored.columns if c not in keys]
        newest = F.max_by(F.struct(*columns), F.struct(version, "_number"))
        # Marks of removal count against the entries before them.
        removed = rows.filter("_gone").groupBy(*keys).agg(F.max("_number").alias("_removed"))
        kept = rows.filter("not _gone").join(removed, keys, "left").filter("_removed is null or _number > _removed")
        return kept.groupBy(*keys).agg(newest.alias("r")).select(*keys, "r.*").select([c.split(" ")[0] for c in schema.split(", ")])

    def write(self, name: str, rows: DataFrame) -> int:
        """Append to a log, or add rows of which the latest of each key counts; returns the entry's number. Writers at the same time do not disturb each other."""
        schema, keys, _ = TABLES[name]
        fields = [c.split(" ") for c in schema.split(", ")]
        typed = rows.select(*[F.col(c).cast(kind).alias(c) for c, kind in fields])
        return self._commit(name, {"folder": self._folder(name, typed, False if keys else None)})

    def remove_last(self, name: str, order: str) -> int | None:
        """Remove the row of the highest ``order``; of equal ones the largest key goes. Begins again where another writer comes between."""
        schema, keys, _ = TABLES[name]
        for _ in range(self.TRIES):
            seen = self.version(name)
            rows = self.read(name, seen)
            last = rows.agg(F.max(F.struct(order, *keys)).alias("m")).filter("m is not null").select(*[F.col(f"m.{k}").alias(k) for k in keys])
            found = last.collect()
            if not found:
                return None
            mark = self.spark.createDataFrame([tuple(found[0].asDict().get(c.split(" ")[0]) for c in schema.split(", "))], schema)
            try:
                return self._commit(name, {"folder": self._folder(name, mark, True)}, seen)
            except Conflict:
                continue
        raise Conflict(f"{name} is written too often")

    def compact(self, name: str) -> int:
        """One folder in place of all entries that are there now; those of writers that come meanwhile stay as they are."""
        seen = self.version(name)
        keys = TABLES[name][1]
        return self._commit(name, {"folder": self._folder(name, self.read(name, seen), False if keys else None), "replaces": seen})

    def new_run(self, parameters: str) -> int:
        """Append a run numbered after the last. The entry counts only where no other run has come since the number was read, so two at once get two."""
        for _ in range(self.TRIES):
            seen = self.version("runs")
            number = (self.read("runs", seen).agg(F.max("run_id")).first()[0] or 0) + 1
            rows = self.spark.createDataFrame([(number, parameters, number)], TABLES["runs"][0])
            try:
                self._commit("runs", {"folder": self._folder("runs", rows, None)}, seen)
                return number
            except Conflict:
                continue
        raise Conflict("runs are written too often")

    def latest_parameters(self) -> str | None:
        return self.read("runs").agg(F.max_by("parameters", "run_id")).first()[0]

    def anchors(self) -> DataFrame:
        """(layer, anchors): ordered (chainage, sample) of the stations' picks, JSON maps of layer to sample."""
        picks = self.read("seed_stations").select("chainage_m", F.explode(F.from_json("picks", "map<string,double>")).alias("layer", "sample")).filter("sample is not null")
        return picks.groupBy(F.col("layer").cast("int").alias("layer")).agg(F.sort_array(F.collect_list(F.struct("chainage_m", "sample"))).alias("anchors"))
