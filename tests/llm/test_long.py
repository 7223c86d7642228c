"""A text of 10 MB among small ones, through every operator of documents."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from fathomline.llm import bytebpe, filteraudit, fst, jaccard, language, licenses, packing, quality, sharding, tiff
from fathomline.llm.shingles import shingle_sets

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def where(spark, tmp_path_factory):
    draw = random.Random(4)
    words = ["".join(draw.choice("abcdefghijklmnopqrstuvwxyzéß") for _ in range(draw.randrange(2, 9))) for _ in range(4000)]
    parts, size = [], 0
    while size < 10_000_000:
        line = " ".join(draw.choice(words) for _ in range(200)) + draw.choice([". ", "\n", "  "])
        parts.append(line)
        size += len(line.encode())
    long = "".join(parts)
    near = long[:-200] + " a different end of the same long text"
    rows = [(1, long, "en", "s", len(long)), (2, near, "en", "s", len(near)), (3, "a small text here", "de", "s", 17), (4, None, None, "s", 0), (5, "", "de", "s", 0)]
    folder = tmp_path_factory.mktemp("long")
    spark.createDataFrame(rows, SCHEMA).repartition(2).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (3, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder), {r[0]: r[1] for r in rows}


def test_jaccard(spark, where):
    folder, texts = where
    got = {r.doc_id: r for r in jaccard.op1_jaccard_join(spark, folder).collect()}
    _, bounds = shingle_sets([texts[1]], 4)
    assert got[1].n_shingles == bounds[1] and got[2].component_id == 1 and {got[k].component_id for k in (3, 4, 5)} == {3, 4, 5}


def test_packing_and_counts(spark, where):
    folder, texts = where
    library = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    want = {k: library.encode(t or "", add_special_tokens=False).ids for k, t in texts.items()}
    assert {r.doc_id: r.n_tokens for r in fst.op10_token_counts(spark, folder).collect()} == {k: len(v) for k, v in want.items()}
    rows = packing.op2_best_fit(spark, folder).collect()
    ids = {k: np.array([*v, 0], "<u4") for k, v in want.items()}
    assert all(r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) for r in rows)
    assert {k: sum(r.length for r in rows if r.doc_id == k) for k in ids} == {k: len(v) for k, v in ids.items()}


def test_coding(spark, where):
    folder, texts = where
    plain = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bytebpe.read_ranks(public_tokenizers.path(bytebpe.VOCABULARY)), special_tokens={})
    for r in bytebpe.op3_byte_bpe(spark, folder).collect():
        text = texts[r.doc_id] or ""
        ids = plain.encode_ordinary(text)
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest() and r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_classifiers_shards_and_media(spark, where):
    folder, texts = where
    langs = {r.doc_id: r.lang_pred for r in language.op4_language_id(spark, folder).collect()}
    assert langs[4] == langs[5] == "und" and langs[1] == langs[2]
    assert all(0 <= r.score <= 1 for r in quality.op8_quality(spark, folder).collect())
    sizes = {r.doc_id: r["size"] for r in sharding.op5_shard_tree(spark, folder).collect()}
    media = {r.doc_id: r for r in tiff.op6_media_tiff(spark, folder).collect()}
    for k, text in texts.items():
        raw = (text or "").encode()
        payload = raw + b" " * (max(192, -(-len(raw) // 192) * 192) - len(raw))
        assert sizes[k] == len(raw) + 8 and media[k].payload_sha256 == hashlib.sha256(payload).hexdigest() and media[k].n_bytes == len(raw)


def test_filters_and_licenses(spark, where):
    folder, texts = where
    got = filteraudit.op11_filter_audit(spark, folder).filter("filter_order = 'ABCDE' and step = 1").collect()
    assert {r.part: r.kept + r.removed for r in got} == {"en": 2, "de": 2, "": 1}
    scanned = {r.doc_id: r for r in licenses.op13_license_scan(spark, folder).collect()}
    assert len(scanned) == len(texts) and scanned[3].n_words == 4 and scanned[1].n_base == 0
