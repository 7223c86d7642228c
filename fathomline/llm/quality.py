"""Quality classifier: supervised subword embeddings.

A document is the mean of learned vectors of its hashed words and character n-grams; a softmax over two classes is
trained on top of it by stochastic gradient descent in numpy. As the mean is linear, scoring needs one number a bucket:
the product of the bucket's vector with the difference of the two output rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import delete_path, documents_of, id_crc, map_texts, slices, stage_table, table
from .ngrams import Batch

ORDERS, BITS, DIM = (2, 3, 4), 16, 8
#: Labelled rows that the model is fitted on at most: those with the smallest hash of doc_id.
SAMPLE = 4000
#: Bytes of features that the model is fitted on at most; in the same order, a row that would go beyond is left out.
FEATURE_BYTES = 64 << 20
EPOCHS, RATE, SEED = 6, 0.4, 17
THRESHOLD = 0.3


#: Buckets of all n-gram orders and of words, and one for words that repeat the word before them.
SIZE = ((len(ORDERS) + 1) << BITS) + 1


def repeats(batch: Batch, bucket: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Whether each word equals the word before it in its text."""
    owner = batch.owner(places)
    return np.concatenate([[False], (bucket[1:] == bucket[:-1]) & (owner[1:] == owner[:-1])]) if len(bucket) else np.zeros(0, bool)


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, counts) of one whole text; words and each n-gram order have a range of their own."""
    batch = Batch([text])
    found = []
    for k, n in enumerate(ORDERS):
        bucket, inside = batch.grams(n, BITS)
        found.append(bucket[inside].astype(np.int64) + (k << BITS))
    bucket, places = batch.words(BITS)
    found.append(bucket.astype(np.int64) + (len(ORDERS) << BITS))
    found.append(np.full(int(repeats(batch, bucket, places).sum()), SIZE - 1, np.int64))
    return np.unique(np.concatenate(found), return_counts=True)


class Model:
    """One weight a bucket, and the bias."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias

    def score(self, texts: list[str | None]) -> np.ndarray:
        """Probability of label 1; a text without words or n-grams, empty or null, has what the bias alone gives."""
        batch = Batch([t or "" for t in texts])
        total, count = np.zeros(batch.size), np.zeros(batch.size)
        for k, n in enumerate(ORDERS):
            bucket, inside = batch.grams(n, BITS)
            values = self.weights[k << BITS : k + 1 << BITS][bucket]
            values[~inside] = 0
            total += batch.sums(values)
            count += np.maximum(batch.ends - batch.starts - n + 1, 0)
        bucket, places = batch.words(BITS)
        values = np.zeros(len(batch.points))
        again = repeats(batch, bucket, places)
        values[places] = self.weights[len(ORDERS) << BITS : SIZE - 1][bucket] + again * self.weights[SIZE - 1]
        total += batch.sums(values)
        owner = batch.owner(places)
        count += np.bincount(owner, minlength=batch.size) + np.bincount(owner, weights=again, minlength=batch.size)
        return 1 / (1 + np.exp(-np.clip(total / np.maximum(count, 1) + self.bias, -40, 40)))


def train(rows: list[tuple[np.ndarray, np.ndarray, int]]) -> Model:
    """SGD over (buckets, counts, label) in an order drawn with a fixed seed."""
    draw = np.random.default_rng(SEED)
    vectors = draw.uniform(-1 / DIM, 1 / DIM, (SIZE, DIM)).astype(np.float32)
    out, bias = np.zeros((2, DIM), np.float32), np.zeros(2, np.float32)
    steps, step = EPOCHS * max(1, len(rows)), 0
    for _ in range(EPOCHS):
        for i in draw.permutation(len(rows)):
            buckets, counts, label = rows[i]
            rate = RATE * (1 - step / steps)
            step += 1
            share = (counts / counts.sum()).astype(np.float32) if len(counts) else np.zeros(0, np.float32)
            mine = vectors[buckets]
            mean = share @ mine if len(counts) else np.zeros(DIM, np.float32)
            logit = out @ mean + bias
            p = np.exp(logit - logit.max())
            p /= p.sum()
            p[label] -= 1
            down = p @ out
            out -= rate * np.outer(p, mean)
            bias -= 0.1 * rate * p
            # Each feature takes the whole gradient of the mean: the mean itself then moves by one step.
            vectors[buckets] = mine - rate * down
    return Model((vectors @ (out[1] - out[0])).astype(np.float64), float(bias[1] - bias[0]))


def fit(df: DataFrame, id_col: str, text_col: str, label_col: str) -> Model:
    """Fitted on the rows given, whose number the caller bounds; features are counted on the executors, FEATURE_BYTES of them reach the driver.

    Rows whose label is null or neither 0 nor 1 teach nothing; a null or empty text has no features; rows that repeat an id and a label count once.
    """

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                found = [features(t or "") for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), pa.array([8 * len(a) for a, _ in found], pa.int64()), pa.array([zlib.compress(np.concatenate([np.diff(a, prepend=0), b]).astype("<i4").tobytes(), 1) for a, b in found], pa.binary())],
                    names=["id", "label", "bytes", "packed"],
                )

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), F.col(label_col).cast("int").alias("label")).filter("label in (0, 1)")
    found = rows.mapInArrow(extract, "id long, label int, bytes long, packed binary")
    # A repeated id counts once; so the number of rows is that of the ids.
    once, path = stage_table(found.groupBy("id", "label").agg(F.min(F.struct("bytes", "packed")).alias("f")).select("id", "label", "f.*"), "quality-features")
    sizes = once.select(F.xxhash64("id").alias("h"), "id", "label", "bytes").collect()
    chosen, total = [], 0
    for r in sorted(sizes, key=lambda r: (r["h"], r["id"] or 0, r["label"])):
        if total + r["bytes"] <= FEATURE_BYTES:
            total += r["bytes"]
            chosen.append((r["id"], r["label"]))
    if len(chosen) < len(sizes):
        once = once.join(F.broadcast(df.sparkSession.createDataFrame(chosen, "id long, label int")), ["id", "label"])
    got = once.select("id", "label", "packed").toArrow()
    delete_path(df.sparkSession, path)
    examples = []
    for k in sorted(range(got.num_rows), key=lambda k: (-1 if got["id"][k].as_py() is None else got["id"][k].as_py(), got["label"][k].as_py())):
        # Differences of sorted buckets, then counts.
        values = np.frombuffer(zlib.decompress(got["packed"][k].as_py()), "<i4")
        half = len(values) // 2
        examples.append((np.cumsum(values[:half], dtype=np.int32), values[half:], got["label"][k].as_py()))
    del got
    return train(examples)


def rate(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every whole text; the weights, 2 MB, are broadcast.

    A null or empty text gets what the bias alone gives. Equal texts and rows that repeat an id are scored alike, a row each; null ids
    stay; other columns are not read, so none can clash; an empty table gives no rows. Long texts are read whole, in slices.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(ids, texts):
        return {"doc_id": ids, "score": pa.array(np.round(shared.value.score(texts), 9))}

    return map_texts(documents_of(df, id_col, text_col), run, "doc_id long, score double")


def held_out() -> Column:
    return F.pmod(id_crc(), F.lit(5)) == 0


def trained(docs: DataFrame, labels: DataFrame) -> Model:
    """The query's model: labelled rows outside the held-out fifth, SAMPLE of them at most."""
    chosen = labels.filter(~held_out() & F.col("quality").isin(0, 1)).select("doc_id", "quality").orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(SAMPLE)
    # SAMPLE rows of two numbers: a proven bound.
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    return fit(texts, "doc_id", "text", "quality")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents; learns from labelled rows outside the held-out fifth."""
    docs = table(spark, sf_dir, "documents")
    scored = rate(docs, trained(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
