import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from fathomline.llm import language, ngrams, quality

from . import fixtures


def test_grams_stay_in_their_text():
    texts = ["abc", "", "b", "abcd", "é🙂é"]
    batch = ngrams.Batch(texts)
    for n in (1, 2, 3):
        bucket, inside = batch.grams(n, 16)
        for k, text in enumerate(texts):
            own = np.arange(batch.starts[k], batch.ends[k])
            assert inside[own].sum() == max(0, len(text) - n + 1)
    one, _ = batch.grams(2, 16)
    assert one[batch.starts[0]] == one[batch.starts[3]] and one[batch.starts[0]] != one[batch.starts[0] + 1]
    value, places = ngrams.Batch(["ab cd", "cd\tab", ""]).words(16)
    assert value[0] == value[3] and value[1] == value[2] and len(value) == 4


def test_language_matches_plain_bayes(spark):
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("the sea the sky", "en"), ("das meer der see", "de"), ("a shore", "en"), ("ein ufer", "de"), ("", "en"), (None, "de")])]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(df, "text", "lang")
    used = [(t, lang) for _, t, lang in rows if t is not None]
    counts = defaultdict(Counter)
    for text, lang in used:
        batch = ngrams.Batch([text])
        for k, n in enumerate(language.ORDERS):
            bucket, inside = batch.grams(n, language.BITS)
            counts[lang].update((k, int(b)) for b in bucket[inside])
    for text in ("the see", "ufer", "q"):
        want = {}
        for lang in counts:
            total = math.log(sum(x == lang for _, x in used) / len(used))
            batch = ngrams.Batch([text])
            for k, n in enumerate(language.ORDERS):
                bucket, inside = batch.grams(n, language.BITS)
                size = sum(v for (o, _), v in counts[lang].items() if o == k) + language.ALPHA * 2**language.BITS
                total += sum(math.log((counts[lang][k, int(b)] + language.ALPHA) / size) for b in bucket[inside])
            want[lang] = total
        labels, scores = model.predict([text])
        best = max(want, key=want.get)
        assert labels == [best] and abs(scores[0] - 1 / sum(math.exp(v - want[best]) for v in want.values())) < 1e-4


def test_language_edge_rows(spark, tmp_path):
    fixtures.frame(spark).write.parquet(f"{tmp_path}/a/documents.parquet")
    rows = {r.doc_id: r for r in language.op4_language_id(spark, f"{tmp_path}/a").collect()}
    assert rows[0].lang_pred == rows[1].lang_pred == rows[15].lang_pred == "und" and rows[10].lang_pred == "en"
    fixtures.empty(spark).write.parquet(f"{tmp_path}/b/documents.parquet")
    assert language.op4_language_id(spark, f"{tmp_path}/b").collect() == []
    unlabelled = fixtures.frame(spark).drop("lang").selectExpr("*", "cast(null as string) lang")
    unlabelled.write.parquet(f"{tmp_path}/c/documents.parquet")
    assert {r.lang_pred for r in language.op4_language_id(spark, f"{tmp_path}/c").collect()} == {"und"}


def test_language_held_out_accuracy(spark):
    where = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{where}/documents.parquet").select("doc_id", "lang").collect()}
    rows = language.op4_language_id(spark, where).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.97


def test_quality_held_out_accuracy(spark):
    where = "/root/testdata/sf0.1"
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{where}/labels.parquet").collect()}
    rows = quality.op8_quality(spark, where).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    assert sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.97


def test_quality_scores_are_the_mean_of_learned_weights(spark):
    model = quality.Model(np.random.default_rng(0).standard_normal(quality.SIZE), 0.3)
    for text in ("", None, "a", "good good text", "x " * 50):
        buckets, counts = quality.features(text or "")
        z = (model.weights[buckets] @ counts / counts.sum() if counts.sum() else 0) + model.bias
        assert abs(model.score([text])[0] - 1 / (1 + math.exp(-z))) < 1e-9


def test_quality_edge_rows(spark, tmp_path):
    fixtures.frame(spark).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(10, 1, 0), (11, 0, 1), (None, 1, 1), (3, None, 0), (10, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    rows = quality.op8_quality(spark, str(tmp_path)).collect()
    assert len(rows) == len(fixtures.rows()) and all(0 <= r.score <= 1 for r in rows)


def test_language_sums_in_groups_of_tasks(spark, small, monkeypatch):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    one = language.fit(docs.coalesce(1), "text", "lang")
    monkeypatch.setattr(language, "TASK_GROUPS", 3)
    many = language.fit(docs.repartition(11), "text", "lang")
    assert one.labels == many.labels and (one.weights == many.weights).all() and (one.prior == many.prior).all()
    monkeypatch.setattr(language, "MOST_LABELS", 1)
    with pytest.raises(ValueError):
        language.fit(docs, "text", "lang")


def test_quality_features_are_bounded(spark, monkeypatch):
    texts = ["good " + " ".join(f"w{i}{j}" for j in range(i % 7 + 1)) for i in range(40)] + ["bad " + "x".join(str(j) for j in range(3000))] * 2
    rows = [(i, t, i % 2) for i, t in enumerate(texts)]
    seen = []
    train = quality.train
    monkeypatch.setattr(quality, "train", lambda found: seen.append(sum(8 * len(b) for b, _, _ in found)) or train(found))
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    whole = quality.fit(df, "doc_id", "text", "quality")
    monkeypatch.setattr(quality, "FEATURE_BYTES", 20_000)
    quality.fit(df, "doc_id", "text", "quality")
    assert seen[0] > 20_000 >= seen[1] > 0 and np.isfinite(whole.bias)


def test_quality_on_empty_tables(spark, tmp_path):
    fixtures.empty(spark).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert quality.op8_quality(spark, str(tmp_path)).collect() == []


def test_training_equals_a_plain_version(monkeypatch):
    """The same steps written out bucket by bucket."""
    monkeypatch.setattr(quality, "EPOCHS", 2)
    rows = [(*quality.features(t), y) for t, y in (("good text here", 1), ("bad bad", 0), ("", 1), ("good bad", 0))]
    got = quality.train(rows)
    draw = np.random.default_rng(quality.SEED)
    start = draw.uniform(-1 / quality.DIM, 1 / quality.DIM, (quality.SIZE, quality.DIM)).astype(np.float32)
    vectors = {}
    out, bias = [[0.0] * quality.DIM for _ in range(2)], [0.0, 0.0]
    step = 0
    for _ in range(2):
        for i in draw.permutation(len(rows)):
            buckets, counts, label = rows[i]
            rate = quality.RATE * (1 - step / (2 * len(rows)))
            step += 1
            own = [vectors.setdefault(int(b), [float(x) for x in start[b]]) for b in buckets]
            mean = [sum(c * v[k] for c, v in zip(counts, own, strict=True)) / max(1, sum(counts)) for k in range(quality.DIM)]
            logit = [sum(o * m for o, m in zip(out[y], mean, strict=True)) + bias[y] for y in range(2)]
            e = [math.exp(z - max(logit)) for z in logit]
            p = [x / sum(e) - (y == label) for y, x in enumerate(e)]
            down = [p[0] * out[0][k] + p[1] * out[1][k] for k in range(quality.DIM)]
            for y in range(2):
                out[y] = [o - rate * p[y] * m for o, m in zip(out[y], mean, strict=True)]
                bias[y] -= 0.1 * rate * p[y]
            for b, v in zip(buckets, own, strict=True):
                vectors[int(b)] = [x - rate * g for x, g in zip(v, down, strict=True)]
    for b, v in vectors.items():
        assert abs(got.weights[b] - sum(x * (out[1][k] - out[0][k]) for k, x in enumerate(v))) < 1e-4
    assert abs(got.bias - (bias[1] - bias[0])) < 1e-4
