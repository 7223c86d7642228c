import hashlib
import sys

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from fathomline.llm import bytebpe, charclass

from . import fixtures

PATH = public_tokenizers.path(bytebpe.VOCABULARY)


@pytest.fixture(scope="module")
def judge():
    return tiktoken.Encoding("judge", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bytebpe.read_ranks(PATH), special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    judge = tiktoken.Encoding("judge", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bytebpe.read_ranks(PATH), special_tokens={}) if not hasattr(test_any_text, "judge") else test_any_text.judge
    test_any_text.judge = judge
    coder = bytebpe.load(PATH, charclass.packed_disputes())
    ids = coder.encode(text)
    assert ids == judge.encode_ordinary(text) and coder.decode(ids).decode() == text


def test_every_character(judge):
    """Each character alone between letters: classes of the pattern and byte fallbacks agree with the library."""
    coder = bytebpe.load(PATH, charclass.packed_disputes())
    bad = []
    for low in range(0, sys.maxunicode + 1, 0x1000):
        for c in range(low, low + 0x1000):
            if 0xD800 <= c < 0xE000:
                continue
            text = f"a{chr(c)}1 {chr(c)}"
            if low < 0x3000 and coder.encode(text) != judge.encode_ordinary(text):
                bad.append(hex(c))
        text = "".join(f"{chr(c)}a1 " for c in range(low, low + 0x1000) if not 0xD800 <= c < 0xE000)
        if coder.encode(text) != judge.encode_ordinary(text):
            bad.append(hex(low))
    assert bad == []


def test_query(spark, small, judge, tmp_path):
    fixtures.frame(spark).write.parquet(f"{tmp_path}/documents.parquet")
    for where in (small, str(tmp_path)):
        source = spark.read.parquet(f"{where}/documents.parquet").collect()
        want = sorted((str(r.doc_id), len(i := judge.encode_ordinary(r.text or "")), hashlib.sha256(",".join(map(str, i)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()) for r in source)
        got = sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bytebpe.op3_byte_bpe(spark, where).collect())
        assert got == want


def test_ranks_must_be_whole():
    with pytest.raises(ValueError):
        bytebpe.sentencepiece_model({b"a": 0})


def test_empty_table(spark):
    assert bytebpe.encode_decode(fixtures.empty(spark)).collect() == []
