"""Binary trace files as a Spark data source, and the header as a table.

Layout (fixed values of the format): a little-endian header of 1024 bytes a unit of ``data_field``, then samples by trace,
channel and sample. Fields by byte offset are in HEADER.
"""

from __future__ import annotations

import hashlib
import struct
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    DataSourceStreamReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    IsNotNull,
    LessThan,
    LessThanOrEqual,
    StringEndsWith,
    StringStartsWith,
)

#: name: (offset, struct code).
HEADER = {
    "tag": (0, "H"),
    "data_field": (2, "H"),
    "samples": (4, "H"),
    "bits": (6, "H"),
    "zero": (8, "h"),
    "scans_per_second": (10, "f"),
    "scans_per_meter": (14, "f"),
    "meters_per_mark": (18, "f"),
    "position_ns": (22, "f"),
    "range_ns": (26, "f"),
    "passes": (30, "H"),
    "gain_offset": (40, "H"),
    "gain_size": (42, "H"),
    "channels": (52, "H"),
    "dielectric": (54, "f"),
    "top_m": (58, "f"),
    "depth_m": (62, "f"),
}
UNIT = 1024
SAMPLE = {8: ("u1", 128), 16: ("<u2", 32768), 32: ("<i4", 0)}
#: Traces of one input partition.
CHUNK = 8192


def parse_header(raw: bytes, size: int, whole: bool = True) -> dict:
    """Header fields with the payload's place, sample type and number of traces. Fails on anything that cannot be a trace file; without ``whole`` a last trace may be cut off."""
    if len(raw) < UNIT:
        raise ValueError("file is shorter than its header")
    out = {name: struct.unpack_from("<" + code, raw, at)[0] for name, (at, code) in HEADER.items()}
    out["antenna"] = raw[98:112].split(b"\0")[0].decode("latin-1").strip()
    out["channels"] = max(1, out["channels"])
    if out["bits"] not in SAMPLE:
        raise ValueError(f"{out['bits']} bits a sample")
    if not out["samples"]:
        raise ValueError("no samples a trace")
    offset = UNIT * out["data_field"] if out["data_field"] < UNIT else out["data_field"]
    out["data_offset"] = offset or UNIT * out["channels"]
    width = np.dtype(SAMPLE[out["bits"]][0]).itemsize * out["samples"] * out["channels"]
    payload = size - out["data_offset"]
    if whole and (payload < 0 or payload % width):
        raise ValueError("payload is not a whole number of traces")
    out["traces"] = max(payload, 0) // width
    return out


def headers(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256, length, header fields) of trace files; the bytes are read by Spark, so any store works."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.dzt").load(path)
    fields = [f"{n} {'int' if c in 'Hh' else 'float'}" for n, (_, c) in HEADER.items()] + ["antenna string", "data_offset long", "traces long"]

    def run(batches):
        for batch in batches:
            rows = [{"path": p, "sha256": s, "length": n} | parse_header(h, n) for p, s, n, h in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=_arrow(fields))

    return files.select("path", F.sha2("content", 256).alias("sha256"), "length", F.substring("content", 1, UNIT).alias("head")).mapInArrow(run, ", ".join(["path string", "sha256 string", "length long", *fields]))


def _arrow(fields: list[str]) -> pa.Schema:
    kinds = {"int": pa.int32(), "float": pa.float32(), "string": pa.string(), "long": pa.int64()}
    return pa.schema([("path", pa.string()), ("sha256", pa.string()), ("length", pa.int64()), *[(n, kinds[t]) for n, t in (f.split(" ") for f in fields)]])


def encode_header(fields: dict) -> bytes:
    """A header of one unit with the given fields, others zero."""
    head = bytearray(UNIT)
    for name, value in ({"tag": 255, "data_field": 1, "channels": 1} | fields).items():
        at, code = HEADER[name]
        struct.pack_into("<" + code, head, at, value)
    return bytes(head)


WRITTEN = "file string, traces long, length long, sha256 string"


def write_traces(df: DataFrame, key: str, order: str, samples: str, folder: str, bits: int = 32, fields: dict | None = None) -> DataFrame:
    """Write a trace file ``<key>.dzt`` for each ``key`` below ``folder`` and return (file, traces, length, sha256) of each.

    ``samples`` holds whole numbers, an array of one length a road. A road is one unit of work. The frame must be used once for
    the files to be written; a unit that runs again writes the same bytes, in place of the old ones when they are complete.
    """
    kind, zero = SAMPLE[bits]

    def run(road: pa.Table) -> pa.Table:
        road = road.sort_by(order)
        rows = road[samples].combine_chunks()
        cube = (np.asarray(rows.flatten(), np.int64) + zero).astype(kind).reshape(len(rows), -1)
        data = encode_header({"samples": cube.shape[1], "bits": bits} | (fields or {})) + cube.tobytes()
        system, path = pa.fs.FileSystem.from_uri(folder)
        system.create_dir(path, recursive=True)
        target, part = f"{path}/{road[key][0].as_py()}.dzt", f"{path}/.{uuid.uuid4().hex}"
        with system.open_output_stream(part) as f:
            f.write(data)
        system.move(part, target)
        return pa.table({"file": [target.rpartition("/")[2]], "traces": pa.array([len(cube)], pa.int64()), "length": pa.array([len(data)], pa.int64()), "sha256": [hashlib.sha256(data).hexdigest()]})

    return df.select(key, order, samples).groupBy(key).applyInArrow(run, WRITTEN)


def write_bytes(df: DataFrame, folder: str) -> DataFrame:
    """Write each row of (file, content) as a file below ``folder``; returns (file, length). The frame must be used once."""

    def run(batches):
        system, path = pa.fs.FileSystem.from_uri(folder)
        system.create_dir(path, recursive=True)
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with system.open_output_stream(f"{path}/{name}") as f:
                    f.write(content)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in batch.column(1).to_pylist()], pa.int64())], names=["file", "length"])

    return df.select("file", "content").mapInArrow(run, "file string, length long")


class _Chunk(InputPartition):
    def __init__(self, path: str, start: int, stop: int):
        self.path, self.start, self.stop = path, start, stop


def _fits(value: str, rule: Filter) -> bool:
    if isinstance(rule, EqualTo):
        return value == rule.value
    if isinstance(rule, In):
        return value in rule.value
    return value.startswith(rule.value) if isinstance(rule, StringStartsWith) else value.endswith(rule.value)


class _Traces:
    """Whole traces of files below a path of any file system that Arrow knows; a trace at a file's end that is not whole yet is none."""

    def __init__(self, options):
        self.uri = options["path"]
        self.channel = int(options["channel"]) if "channel" in options else None
        self.channels: set[int] | None = None

    def _head(self, system, path: str, whole: bool = True) -> dict | None:
        with system.open_input_file(path) as f:
            size, raw = f.size(), f.read(UNIT)
        if not whole and (len(raw) < UNIT or not sum(raw)):
            return None
        head = parse_header(raw, size, whole)
        if self.channel is not None and not 0 <= self.channel < head["channels"]:
            raise ValueError("no such channel")
        return head

    def _files(self, system, path: str) -> list[str]:
        info = system.get_file_info(path)
        if info.type == pa.fs.FileType.Directory:
            return sorted(x.path for x in system.get_file_info(pa.fs.FileSelector(path)) if x.path.endswith(".dzt"))
        return [path]

    def read(self, partition):
        if partition is None:  # what Spark hands over where there are no partitions
            return
        system, _ = pa.fs.FileSystem.from_uri(self.uri)
        head = self._head(system, partition.path, False)
        kind, zero = SAMPLE[head["bits"]]
        width = head["samples"] * head["channels"]
        size = np.dtype(kind).itemsize
        with system.open_input_file(partition.path) as f:
            f.seek(head["data_offset"] + partition.start * width * size)
            data = np.frombuffer(f.read((partition.stop - partition.start) * width * size), kind)
        cube = data.reshape(-1, head["channels"], head["samples"])
        file = partition.path.rpartition("/")[2]
        for channel in range(head["channels"]):
            if channel != (channel if self.channel is None else self.channel) or (self.channels is not None and channel not in self.channels):
                continue
            rows = cube[:, channel].astype(np.float32) - zero
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * head["samples"]), pa.array(rows.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array([file] * len(rows)), pa.array(range(partition.start, partition.stop), pa.int64()), pa.array([channel] * len(rows), pa.int32()), lists], names=["file", "trace", "channel", "samples"])


class TraceSource(DataSource):
    """``spark.read.format("traces").option("path", ...)``: (file, trace, channel, samples) of a trace file, or of all in a folder.

    Files are read through Arrow's file systems, so the path may be a URI of any that it knows. Options start, stop and channel bound what is
    read; ``traces`` takes such bounds from a predicate. ``spark.readStream`` gives the whole traces that files have gained since the last batch, and those of new files.
    """

    @classmethod
    def name(cls) -> str:
        return "traces"

    def schema(self) -> str:
        return "file string, trace long, channel int, samples array<float>"

    def reader(self, schema) -> DataSourceReader:
        return _TraceReader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _TraceStream(self.options)


class _TraceReader(_Traces, DataSourceReader):
    def __init__(self, options):
        super().__init__(options)
        self.start, self.stop = int(options.get("start", 0)), int(options["stop"]) if "stop" in options else None
        if self.start < 0:
            raise ValueError("no such trace")
        self.pushed = options.get("pushed", "false").lower() == "true"
        self.rules: list[Filter] = []

    def pushFilters(self, filters):
        """Take what bounds traces, channels and files; the rest goes back to Spark, and everything does where ``traces`` did not load the frame."""
        if not self.pushed:
            yield from filters
            return
        for rule in filters:
            column = rule.attribute[0] if len(getattr(rule, "attribute", ())) == 1 else None
            if isinstance(rule, IsNotNull) and column in ("file", "trace", "channel", "samples"):
                continue
            if column == "trace" and isinstance(rule, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                if not isinstance(rule, (LessThan, LessThanOrEqual)):
                    self.start = max(self.start, rule.value + isinstance(rule, GreaterThan))
                if not isinstance(rule, (GreaterThan, GreaterThanOrEqual)):
                    stop = rule.value + (not isinstance(rule, LessThan))
                    self.stop = stop if self.stop is None else min(self.stop, stop)
            elif column == "channel" and isinstance(rule, (EqualTo, In)):
                wanted = set(rule.value) if isinstance(rule, In) else {rule.value}
                self.channels = wanted if self.channels is None else self.channels & wanted
            elif column == "file" and isinstance(rule, (EqualTo, In, StringStartsWith, StringEndsWith)):
                self.rules.append(rule)
            else:
                if column == "trace" and isinstance(rule, In) and rule.value:
                    # Its bounds are read; Spark picks the traces.
                    self.start, last = max(self.start, min(rule.value)), max(rule.value) + 1
                    self.stop = last if self.stop is None else min(self.stop, last)
                yield rule

    def partitions(self) -> list[InputPartition]:
        """One for each chunk of the asked range of each asked file: traces outside it are never read."""
        system, path = pa.fs.FileSystem.from_uri(self.uri)
        out = []
        for name in self._files(system, path):
            if self.channels == set() or not all(_fits(name.rpartition("/")[2], rule) for rule in self.rules):
                continue
            stop = min(self._head(system, name)["traces"], self.stop if self.stop is not None else 1 << 62)
            out += [_Chunk(name, a, min(a + CHUNK, stop)) for a in range(self.start, stop, CHUNK)]
        return out


class _TraceStream(_Traces, DataSourceStreamReader):
    """Offsets are the whole traces of each file. What a folder holds decides the latest, so a batch that runs again, also after a restart, reads the same traces."""

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        system, path = pa.fs.FileSystem.from_uri(self.uri)
        heads = {name.rpartition("/")[2]: self._head(system, name, False) for name in self._files(system, path)}
        return {name: head["traces"] for name, head in heads.items() if head and head["traces"]}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        system, path = pa.fs.FileSystem.from_uri(self.uri)
        folder = path if system.get_file_info(path).type == pa.fs.FileType.Directory else path.rpartition("/")[0]
        out = []
        for name, stop in sorted(end.items()):
            first = start.get(name, 0)
            if stop < first:
                raise ValueError(f"{name} has lost traces")
            out += [_Chunk(f"{folder}/{name}", a, min(a + CHUNK, stop)) for a in range(first, stop, CHUNK)]
        return out

    def commit(self, end: dict) -> None:
        """Nothing is kept but the files themselves."""


def traces(spark: SparkSession, path: str, where: Column | str = "true") -> DataFrame:
    """The trace source with the predicate ``where`` pushed into it: as far as it bounds file, trace and channel, other files are not opened, other traces not read, other channels not decoded.

    Spark 4.1 keeps one pushed state for each loaded frame, whatever queries are made of it: a second scan in one plan, or a later query without predicates, would
    read what another one pushed. So all scans of this frame push the same, ``where`` and a predicate that always holds, and a filter that is not deterministic keeps
    Spark from pushing more of a query into it; further predicates are Spark's own. The bare format pushes nothing.
    """
    register(spark)
    return spark.read.format("traces").option("path", path).option("pushed", "true").load().filter("trace >= 0").filter(where).filter(F.monotonically_increasing_id() >= 0)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TraceSource)
