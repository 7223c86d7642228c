"""What the corpus operators share: bounded text batches, stage tables in the shared folder, connected components."""

from __future__ import annotations

import atexit
import ctypes
import functools
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes handled at once by a Python worker; a longer single text is handled alone.
SLICE_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, read by Spark only, so that any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents_of(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) alone: other columns, clashing names included, never reach an operator."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def slices(batch: pa.RecordBatch, text_col: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``limit`` text bytes each, at least one row."""
    n = batch.num_rows
    column = batch.column(batch.schema.get_field_index(text_col))
    lengths = np.asarray(pc.fill_null(pc.binary_length(column), 0), dtype=np.int64)
    ends = np.cumsum(lengths)
    start = 0
    while start < n:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(start, min(stop, n) - start)
        start = stop


def give_back() -> None:
    """Return freed memory to the system at a task's end, as workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another libc
        pass


def map_texts(df: DataFrame, fn: Callable[[np.ndarray, list], dict], schema: str) -> DataFrame:
    """``fn(ids, texts) -> columns`` over (doc_id, text), in slices of bounded bytes, one output row a row.

    ``ids`` keeps nulls as None in an object list only where there are any; texts may hold None.
    """
    names = [part.strip().split(" ")[0] for part in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                columns = fn(part.column(0), part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in (columns[n] for n in names)], names=names)
        give_back()

    return documents_of(df).mapInArrow(run, schema)


def crc_text(value) -> int:
    """crc32 of a value's decimal text."""
    return zlib.crc32(str(value).encode())


def id_crc(column: str = "doc_id"):
    """crc32 of an id's decimal text, as Spark computes it; null ids count as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Bytes of a batch that goes to a Python worker where rows are sets or vectors, in place of Spark's own 64 MB.
BATCH_BYTES = 16 << 20


def bounded_batches(fn: Callable) -> Callable:
    """``fn(df, ...)`` with batches of BATCH_BYTES for what it writes itself; the session's setting is put back."""

    @functools.wraps(fn)
    def run(df: DataFrame, *args, **named):
        conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
        before = conf.get(key, None)
        conf.set(key, str(BATCH_BYTES))
        try:
            return fn(df, *args, **named)
        finally:
            if before is None:
                conf.unset(key)
            else:
                conf.set(key, before)

    return run


# ---------------------------------------------------------------- stage tables

_own_dir: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where that is unset, a temporary one for a local master, as in tests, and an error on a cluster."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own_dir:
        _own_dir.append(tempfile.mkdtemp(prefix="fathomline-"))
    return f"file://{_own_dir[0]}"


def delete_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


_kept: dict[str, list[tuple[SparkSession, str]]] = {}


def _drop_kept() -> None:
    for entries in _kept.values():
        for spark, path in entries:
            try:
                delete_path(spark, path)
            except Exception:  # the session may be gone already: the folder is the cluster's to clean
                return


atexit.register(_drop_kept)


def stage_table(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage is cut and lost executors cost nothing.

    Returns the frame and its path. Paths are dropped with ``delete_path`` or when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/fathomline-{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    _kept.setdefault(label, []).append((spark, path))
    return spark.read.schema(schema).parquet(path), path


class Stages:
    """Stage tables of one run, dropped together when what was made of them is written."""

    def __init__(self) -> None:
        self.held: list[tuple[SparkSession, str]] = []

    def keep(self, df: DataFrame, label: str) -> DataFrame:
        out, path = stage_table(df, label)
        self.held.append((df.sparkSession, path))
        return out

    def drop(self) -> None:
        for spark, path in self.held:
            delete_path(spark, path)
        self.held.clear()


# ---------------------------------------------------------------- joins with hot keys

#: A key is hot where it meets more than 1 / HOT of the rows, so HOT keys at most are.
HOT = 1000


def keyed_join(left: DataFrame, right: DataFrame, keys: list[str], weight: str, total: int, spread: Column) -> DataFrame:
    """``left`` left-joined with ``right`` on ``keys``, the first a string, of which ``right`` has one row each.

    ``weight`` in ``right`` says how many rows of ``left`` a key meets, ``total`` how many rows there are. Hot keys, HOT at most
    whatever the size of the tables, are broadcast. The rows of ``left`` that these take go through the shuffle of the others
    under a key of their own, made of ``spread``, which nothing meets. The weight is left out of the result.
    """
    values = [c for c in right.columns if c not in keys and c != weight]
    held = right.select(*keys, F.struct(F.lit(True).alias("met"), *values).alias("_v"), (F.col(weight) * HOT > total).alias("_hot"))
    first = left.join(F.broadcast(held.filter("_hot").select(*keys, F.col("_v").alias("_h"))), keys, "left")
    # A zero character before the key: no key of a cold row begins with two.
    own = F.when(F.col("_h").isNotNull(), F.concat(F.lit("\0\0"), spread.cast("string"))).otherwise(F.concat(F.lit("\0"), F.col(keys[0])))
    cold = held.filter("not _hot").withColumn("_k", F.concat(F.lit("\0"), F.col(keys[0]))).select("_k", *keys[1:], F.col("_v").alias("_c"))
    met = first.withColumn("_k", own).join(cold, ["_k", *keys[1:]], "left")
    return met.select(*left.columns, *(F.coalesce(F.col("_h")[c], F.col("_c")[c]).alias(c) for c in values))


# ---------------------------------------------------------------- connected components


def _local_roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node reachable) of the edges a-b, by hooking and pointer jumping in numpy."""
    nodes, inverse = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = inverse[: len(a)], inverse[len(a) :]
    parent = np.arange(len(nodes))
    while True:
        pu, pv = parent[u], parent[v]
        low, high = np.minimum(pu, pv), np.maximum(pu, pv)
        if np.array_equal(low, high):
            return nodes, nodes[parent]
        np.minimum.at(parent, high, low)
        while not np.array_equal(up := parent[parent], parent):
            parent = up


def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per task, replace edges (a, b) by the stars of their components: at most one edge a node and task."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def flush():
        a = np.concatenate([x[0] for x in held])
        b = np.concatenate([x[1] for x in held])
        nodes, roots = _local_roots(a, b)
        keep = nodes != roots
        return nodes[keep], roots[keep]

    for batch in batches:
        if batch.num_rows:
            held.append((np.asarray(batch.column(0)), np.asarray(batch.column(1))))
            size += batch.num_rows
            if size > 2_000_000:
                held = [flush()]
                size = len(held[0][0])
    if held:
        a, b = flush()
        for i in range(0, len(a), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(a[i : i + 50_000]), pa.array(b[i : i + 50_000])], names=["a", "b"])


#: Edges that one task contracts; a set of no more is solved by one.
TASK_EDGES = 500_000


def components(edges: DataFrame, label: str = "cc") -> DataFrame:
    """(node, component) of every node with an edge, component the smallest node reachable.

    ``edges`` has the long columns a and b. Each task contracts its edges to stars, at most one edge a node and
    task, in tasks of about TASK_EDGES edges. Where that leaves more than one task, alternating large-star and small-star
    steps, grouped minima that Spark combines before the shuffle, bring stars of different tasks together. Every step is written to the
    shared folder, so a lost executor never repeats more than one.
    """
    spark = edges.sparkSession
    # A union of many inputs has the sum of their partitions: no more tasks than for one.
    current, path = stage_table(edges.select("a", "b").coalesce(max(spark.sparkContext.defaultParallelism, shuffle_partitions(spark))).mapInArrow(contract, "a long, b long"), label)
    while True:
        tasks = -(-current.count() // TASK_EDGES)
        following, next_path = stage_table(current.coalesce(max(1, tasks)).mapInArrow(contract, "a long, b long"), label)
        delete_path(spark, path)
        current, path = following, next_path
        if tasks <= 1:
            break
        # Large star: every larger neighbour of a node points at the smallest node beside it.
        both = current.union(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        # Small star: every smaller neighbour, and the node itself, point at the smallest of them.
        low2 = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low2, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low2.select("a", F.col("m").alias("b"))).distinct()
        following, next_path = stage_table(small.mapInArrow(contract, "a long, b long"), label)
        delete_path(spark, path)
        current, path = following, next_path
        # Done when no node points at two others and none that is pointed at points on.
        ends = current.select(F.col("a").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("in")).union(current.select("b", F.lit(0), F.lit(1)))
        if ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("in").alias("in")).filter("out > 1 or (out = 1 and in = 1)").isEmpty():
            break
    nodes = current.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.union(current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
