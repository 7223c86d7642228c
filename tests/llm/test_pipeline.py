import math
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from fathomline.llm import language, ngrams, packing, quality

from . import fixtures
from .test_jaccard import brute


def test_stages_against_a_plain_version(spark, small, tmp_path):
    fixtures.frame(spark).select("doc_id", "text", "lang", "source", "n_chars").union(spark.read.parquet(f"{small}/documents.parquet")).dropDuplicates(["doc_id"]).filter("doc_id is not null").write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{small}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    where = str(tmp_path)
    docs = spark.read.parquet(f"{where}/documents.parquet")
    columns = docs.columns
    rows = {r.doc_id: r.text for r in docs.collect()}
    model = quality.trained(docs, spark.read.parquet(f"{where}/labels.parquet"))
    rows = {d: t for d, t in rows.items() if model.score([t])[0] >= quality.THRESHOLD}
    first = corpus_pipeline.quality_stage(spark, docs, where)
    assert first.columns == columns and {r.doc_id for r in first.collect()} == set(rows)
    speaks = language.trained(first)

    def likely(text):
        """Mean log probability of an n-gram under the predicted language, n-gram by n-gram, against an even draw of buckets."""
        label, score = (x[0] for x in speaks.predict([text]))
        if label == "und" or score < corpus_pipeline.SURE:
            return False
        batch, found = ngrams.Batch([text.lower()]), []
        for k, n in enumerate(language.ORDERS):
            bucket, inside = batch.grams(n, language.BITS)
            found += [speaks.weights[(k << language.BITS) + int(b), speaks.labels.index(label)] for b in bucket[inside]]
        return sum(found) / len(found) > math.log(1 / (1 << language.BITS))

    rows = {d: t for d, t in rows.items() if likely(t)}
    second = corpus_pipeline.language_stage(spark, first, where)
    assert second.columns == columns and {r.doc_id for r in second.collect()} == set(rows)
    kept = {d for d, _, c in brute(sorted(rows.items()), 5, 80) if d == c}
    third = corpus_pipeline.jaccard_stage(spark, second, where)
    assert third.columns == columns and {r.doc_id for r in third.collect()} == kept
    library = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    want = set()
    for d in kept:
        ids = np.array([*library.encode(rows[d], add_special_tokens=False).ids, 0], "<u4")
        want |= {(d, k, s, n, zlib.crc32(ids[s : s + n].tobytes())) for k, (s, n) in enumerate(packing.cut(len(ids)))}
    packed = corpus_pipeline.run(spark, where).collect()
    assert {tuple(r)[:5] for r in packed} == want and len(packed) == len(want)
    fills = defaultdict(int)
    for r in packed:
        fills[r.sequence_id] += r.length
        assert len(r.ids) == 4 * r.length and zlib.crc32(r.ids) == r.ids_crc32
    assert max(fills.values()) <= packing.CAPACITY


def test_repeated_ids_and_nulls(spark, tmp_path):
    docs = fixtures.frame(spark)
    kept = corpus_pipeline.jaccard_stage(spark, docs, str(tmp_path))
    ids = [r.doc_id for r in kept.collect()]
    assert kept.columns == docs.columns and ids.count(10) == 1 and 11 not in ids and None in ids


def test_texts_unlike_every_language_go(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    draw = random.Random(3)
    foreign = ["".join(chr(draw.randrange(0x4E00, 0x9FFF)) for _ in range(n)) for n in (30, 3000)] + ["".join(draw.choice("qxzjkvwþ§ß") for _ in range(400))]
    extra = spark.createDataFrame([(10**9 + i, t, "en", "s", len(t)) for i, t in enumerate(foreign)], docs.schema)
    model = language.trained(docs)
    assert all(g <= 0 for g in model.judge(foreign)[2])
    kept = {r.doc_id for r in corpus_pipeline.language_stage(spark, docs.union(extra), small).collect()}
    assert not any(10**9 + i in kept for i in range(2)) and len(kept) >= 0.98 * docs.count()


def test_empty_tables(spark, small, tmp_path):
    spark.read.parquet(f"{small}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{small}/labels.parquet").limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
