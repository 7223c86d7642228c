"""Audit of how filters act on each other: every order of five filters, by first-failure lookup."""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import give_back, keyed_join, slices, stage_table, table

FILTERS = "ABCDE"
ORDERS = tuple("".join(p) for p in itertools.permutations(FILTERS))
STEPS = len(FILTERS)
#: A document needs so many words, so many distinct ones in 100, at most so many capitals in 100 characters, and none of the signs.
LEAST_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT, SIGNS = 200, 50, 3, b"#$%&*|"
CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
#: Bytes that go on with a character of UTF-8.
CONTINUED = bytes(range(0x80, 0xC0))
#: Rows looked up at once, and parts whose arrays a task holds before it hands them on.
ROWS, PARTS = 8192, 512
MEASURES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def first_failures() -> np.ndarray:
    """[set of failures, order] -> the step, from 0, of the first filter of the order that fails; STEPS where none does."""
    out = np.full((1 << STEPS, len(ORDERS)), STEPS, np.int64)
    sets = np.arange(1 << STEPS)
    for o, order in enumerate(ORDERS):
        for step in reversed(range(STEPS)):
            out[sets >> FILTERS.index(order[step]) & 1 == 1, o] = step
    return out


#: [order, step] -> number of the filter that stands there.
PLACES = np.array([[FILTERS.index(letter) for letter in order] for order in ORDERS])


def failures(text: bytes) -> int:
    """The filters A to D that a text fails, a bit each."""
    words = text.split()  # bytes are split at space, tab, line feed, vertical tab, form feed and return alone
    capitals = len(text) - len(text.translate(None, CAPITALS))
    return (
        (len(words) < LEAST_WORDS)
        | (100 * len(set(words)) < DISTINCT_PERCENT * len(words)) << 1
        | (100 * capitals > CAPITAL_PERCENT * len(text.translate(None, CONTINUED))) << 2
        | (len(text.translate(None, SIGNS)) < len(text)) << 3
    )


def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch):
            texts = [t or b"" for t in part.column(1).cast(pa.binary()).to_pylist()]
            digests = [hashlib.blake2b(t, digest_size=16).hexdigest() for t in texts]
            masks = [failures(t) for t in texts]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(digests), pa.array(masks, pa.int32())], names=["doc_id", "part", "digest", "mask"])
    give_back()


def _reports(names: list[str], steps: np.ndarray, masks: np.ndarray) -> pa.RecordBatch:
    """All orders and steps of some parts; ``steps`` [part, label, order, step or none] and ``masks`` [part, set] are counts."""
    n = len(names)
    removed, good, toxic = (steps[:, k, :, :STEPS] for k in range(3))
    kept = steps[:, 0].sum(axis=2)[:, :, None] - removed.cumsum(axis=2)
    has = np.arange(1 << STEPS)[:, None] >> np.arange(STEPS) & 1 == 1
    fails = masks @ has
    unique = masks[:, 1 << np.arange(STEPS)]
    shares = np.zeros((n, STEPS), np.int64)
    for f in range(STEPS):
        shares[:, f] = removed[:, PLACES == f].sum(axis=1)
    columns = {"kept": kept, "removed": removed, "redundant": fails[:, PLACES] - removed, "unique_fails": unique[:, PLACES], "good_lost": good, "toxic_lost": toxic, "shapley": shares[:, PLACES]}
    cells = len(ORDERS) * STEPS
    keys = [pa.array(np.repeat(np.array(names, object), cells), pa.string()), pa.array(np.tile(np.repeat(np.array(ORDERS, object), STEPS), n), pa.string()), pa.array(np.tile(np.arange(1, STEPS + 1), n * len(ORDERS)), pa.int32())]
    return pa.RecordBatch.from_arrays([*keys, *(pa.array(columns[m].reshape(-1), pa.int64()) for m in MEASURES)], names=["part", "filter_order", "step", *MEASURES])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(part, mask, good, toxic) to the task's own report of every part: sums of it over all tasks are the whole report."""
    table_of, orders = first_failures(), np.arange(len(ORDERS)) * (STEPS + 1)
    cells = len(ORDERS) * (STEPS + 1)
    held: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def hand_on():
        for names in itertools.batched(held, 64):
            yield _reports(list(names), np.stack([held[x][0] for x in names]), np.stack([held[x][1] for x in names]))
        held.clear()

    for batch in batches:
        for start in range(0, batch.num_rows, ROWS):
            rows = batch.slice(start, ROWS)
            coded = rows.column(0).dictionary_encode()
            names, codes = coded.dictionary.to_pylist(), np.asarray(coded.indices).astype(np.int64)
            masks = np.asarray(rows.column(1)).astype(np.int64)
            keys = table_of[masks] + orders + codes[:, None] * cells
            wanted = [slice(None)] + [np.asarray(rows.column(k).cast(pa.int8())) == 1 for k in (2, 3)]
            steps = np.stack([np.bincount(keys[w].ravel(), minlength=len(names) * cells).reshape(len(names), len(ORDERS), STEPS + 1) for w in wanted], axis=1)
            sets = np.bincount(codes << STEPS | masks, minlength=len(names) << STEPS).reshape(len(names), -1)
            for k, name in enumerate(names):
                if name in held:
                    held[name][0][...] += steps[k]
                    held[name][1][...] += sets[k]
                else:
                    held[name] = (steps[k].copy(), sets[k].copy())
            if len(held) > PARTS:
                yield from hand_on()
    yield from hand_on()
    give_back()


def audit(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """(part, filter_order, step, MEASURES): a row for every value of ``part``, order of the five filters and step, zeros included.

    ``docs`` has doc_id, text and ``part``, ``labels`` doc_id, quality and toxic; other columns are not read, so none can clash. A null text is
    the empty one, a null part the empty string. A text is a repeat (E) where the same text, compared by a 128-bit hash, stands under a smaller
    id: rows that repeat an id are no repeats of each other, and a null id neither is nor makes a repeat. A document is good or toxic where
    any of its labels is 1; a null id has no labels. Long texts are read whole; an empty table gives no rows.

    The texts are read once; what goes on of a document are its id, part, hash and failures. Smallest ids by hash are combined before
    their shuffle and joined with hot hashes broadcast (``keyed_join``), so the copies of one text are spread over all tasks.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"))
    judged, _ = stage_table(rows.mapInArrow(_judged, "doc_id long, part string, digest string, mask int"), "audit-judged")
    repeats = judged.groupBy("digest").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    met = keyed_join(judged, repeats, ["digest"], "n", judged.count(), F.monotonically_increasing_id())
    masks = met.select("doc_id", "part", F.when(F.col("doc_id") > F.col("least"), F.col("mask") + F.lit(1 << FILTERS.index("E"))).otherwise(F.col("mask")).alias("mask"))
    # A null id meets no label: such rows are spread over the join's tasks by a number of their own.
    own = F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id()).otherwise(F.lit(0).cast("long"))
    marked = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(*(F.max(F.coalesce(F.col(c) == 1, F.lit(False))).alias(c) for c in ("quality", "toxic")))
    told = masks.withColumn("own", own).join(marked.withColumn("own", F.lit(0).cast("long")), ["doc_id", "own"], "left")
    facts = told.select("part", "mask", F.coalesce("quality", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))
    counted = facts.mapInArrow(_counted, "part string, filter_order string, step int, " + ", ".join(f"{m} long" for m in MEASURES))
    return counted.groupBy("part", "filter_order", "step").agg(*(F.sum(m).alias(m) for m in MEASURES))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 120 orders of the five filters over all documents, by language."""
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
