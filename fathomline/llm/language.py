"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents_of, give_back, id_crc, map_texts, slices, table
from .ngrams import Batch

ORDERS, BITS, ALPHA = (1, 2, 3), 16, 0.1
#: Counts travel in slices of so many buckets, added up in so many groups of tasks before they meet.
SLICE, TASK_GROUPS = 4096, 512
#: Labels that a model may have; each costs some MB in every task and at the driver.
MOST_LABELS = 200
UNKNOWN = "und"
LETTER = regex.compile(r"\p{L}")


def _counted(batch: Batch, labels: np.ndarray, n_labels: int) -> np.ndarray:
    """Counts by label and bucket, each order in a range of its own."""
    out = np.zeros((n_labels, len(ORDERS) << BITS), np.int64)
    owners = np.repeat(np.arange(batch.size), np.append(batch.starts[1:], len(batch.points)) - batch.starts) if batch.size else np.zeros(0, np.int64)
    for k, n in enumerate(ORDERS):
        bucket, inside = batch.grams(n, BITS)
        key = labels[owners[inside]].astype(np.int64) << BITS | bucket[inside]
        out[:, k << BITS : k + 1 << BITS] += np.bincount(key, minlength=n_labels << BITS).reshape(n_labels, -1)
    return out


class Model:
    """Label names and the matrix of log probabilities, bucket by label."""

    def __init__(self, labels: list[str], prior: np.ndarray, weights: np.ndarray):
        self.labels, self.prior, self.weights = labels, prior, weights

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """(label, its posterior). Texts that are null or have no letter are UNKNOWN with score 0."""
        return self.judge(texts)[:2]

    def judge(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(label, its posterior, gain): the gain is the mean log probability of an n-gram under the label, less that of a
        bucket drawn evenly. The posterior only compares labels; a text unlike all of them has a gain below zero, whatever its length.
        """
        known = np.fromiter((bool(t) and LETTER.search(t) is not None for t in texts), bool, len(texts))
        if not self.labels:
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
        batch = Batch([(t or "").lower() for t in texts])
        total = np.tile(self.prior, (batch.size, 1))
        for k, n in enumerate(ORDERS):
            bucket, inside = batch.grams(n, BITS)
            rows = self.weights[k << BITS : k + 1 << BITS]
            for j in range(len(self.labels)):
                values = rows[:, j][bucket]
                values[~inside] = 0
                total[:, j] += batch.sums(values)
        best = total.argmax(axis=1)
        at = np.arange(batch.size)
        grams = sum(np.maximum(batch.ends - batch.starts - n + 1, 0) for n in ORDERS)
        gain = (total[at, best] - self.prior[best]) / np.maximum(grams, 1) + BITS * np.log(2)
        total -= total.max(axis=1, keepdims=True)
        odds = np.exp(total)
        score = odds[at, best] / odds.sum(axis=1)
        return [self.labels[b] if ok else UNKNOWN for b, ok in zip(best, known, strict=True)], np.where(known, score, 0.0), gain


def fit(df: DataFrame, text_col: str, label_col: str) -> Model:
    """Counts over all rows with text and label. Each task adds up its own rows; what leaves it has a size set by labels and buckets.

    The tasks' sums are added up in two steps, so that a unit of work holds TASK_GROUPS of them, or a TASK_GROUPS-th part, however many tasks
    there are. More than MOST_LABELS labels are an error: the matrix grows with them. No rows give a model without labels.
    """
    named = df.filter(F.col(label_col).isNotNull()).select(label_col).distinct().limit(MOST_LABELS + 1).count()
    if named > MOST_LABELS:
        raise ValueError(f"more than {MOST_LABELS} labels")
    rows = df.filter(F.col(label_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(label_col).cast("string").alias("label"), F.col(text_col).cast("string").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        docs: dict[str, int] = {}
        for batch in batches:
            for part in slices(batch):
                labels = part.column(0).to_pylist()
                names = sorted(set(labels))
                codes = np.array([names.index(x) for x in labels], np.int64)
                found = _counted(Batch([t.lower() for t in part.column(1).to_pylist()]), codes, len(names))
                for k, name in enumerate(names):
                    sums[name] = sums[name] + found[k] if name in sums else found[k]
                    docs[name] = docs.get(name, 0) + int((codes == k).sum())
        context = TaskContext.get()
        group = context.partitionId() % TASK_GROUPS if context else 0
        for name, counts in sums.items():
            pieces = [counts[i : i + SLICE].tobytes() for i in range(0, len(counts), SLICE)]
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(pieces)), pa.array([group] * len(pieces), pa.int32()), pa.array(range(len(pieces)), pa.int32()), pa.array([docs[name] if not i else 0 for i in range(len(pieces))], pa.int64()), pa.array(pieces, pa.binary())], names=["label", "tasks", "part", "docs", "counts"])
        sums.clear()
        give_back()

    def add(key, group):
        total = np.zeros(SLICE, np.int64)
        for blob in group["counts"]:
            total += np.frombuffer(blob.as_py(), np.int64)
        return pa.table({"label": [key[0].as_py()], "part": pa.array([key[-1].as_py()], pa.int32()), "docs": pa.array([sum(group["docs"].to_pylist())], pa.int64()), "counts": pa.array([total.tobytes()], pa.binary())})

    schema = "label string, part int, docs long, counts binary"
    some = rows.mapInArrow(count, "label string, tasks int, part int, docs long, counts binary").groupBy("label", "tasks", "part").applyInArrow(add, schema)
    counted = some.groupBy("label", "part").applyInArrow(add, schema).collect()
    labels = sorted({r["label"] for r in counted})
    counts = np.zeros((len(ORDERS) << BITS, len(labels)))
    docs = np.zeros(len(labels))
    for r in counted:
        j = labels.index(r["label"])
        counts[r["part"] * SLICE : (r["part"] + 1) * SLICE, j] = np.frombuffer(r["counts"], np.int64)
        docs[j] += r["docs"]
    weights = np.empty(counts.shape, np.float32)
    for k in range(len(ORDERS)):
        own = counts[k << BITS : k + 1 << BITS] + ALPHA
        weights[k << BITS : k + 1 << BITS] = np.log(own / own.sum(axis=0))
    return Model(labels, np.log(docs / docs.sum()) if labels else docs, weights)


def identify(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) of every whole text. The matrix, some MB whatever the corpus, is broadcast.

    A null or empty text, or one without a letter, is UNKNOWN with score 0, as is every text under a model without labels.
    Of equal posteriors the first label by name wins. Equal texts and rows that repeat an id are judged alike, a row each; null
    ids stay; other columns are not read, so none can clash; an empty table gives no rows. Long texts are read whole, in slices.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(ids, texts):
        labels, scores = shared.value.predict(texts)
        return {"doc_id": ids, "lang_pred": pa.array(labels, pa.string()), "score": pa.array(np.round(scores, 9))}

    return map_texts(documents_of(df, id_col, text_col), run, "doc_id long, lang_pred string, score double")


def held_out() -> Column:
    return F.pmod(id_crc(), F.lit(4)) == 2


def trained(docs: DataFrame) -> Model:
    """The query's model: all rows that are not held out."""
    return fit(docs.filter(~held_out()), "text", "lang")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of all documents; learns from rows outside the held-out quarter."""
    docs = table(spark, sf_dir, "documents")
    return identify(docs, trained(docs)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
