import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from fathomline.llm import charclass, fst

from . import fixtures

PATH = public_tokenizers.path(fst.VOCABULARY)
LIBRARY = Tokenizer.from_file(PATH)
COUNTER = fst.load(PATH, charclass.packed_classes())


def wanted(texts):
    return [len(LIBRARY.encode(t, add_special_tokens=False).ids) for t in texts]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=40), st.text(alphabet="a's t'llre  \n\t1é!-<|endoftext|>", max_size=60)), max_size=5))
def test_any_texts(texts):
    assert COUNTER(texts).tolist() == wanted(texts)


def test_long_runs_and_specials():
    texts = ["x" * 3000, " " * 1500, "\n" * 301 + "a", "ab" * 999, "<|endoftext|>" * 3 + " <|endoftext|>a", "<|endoftext", "1" * 500, "é" * 500, "'s" * 50, " 's", "\n's", "a's's b'llx 'LL"]
    assert COUNTER(texts).tolist() == wanted(texts)


@pytest.mark.parametrize("chunk", [1, 3, 7, 128, 1000])
def test_chunks_do_not_matter(chunk):
    draw = np.random.RandomState(chunk)
    seen = draw.randint(0, fst.SYMBOLS, 2000).astype(np.uint8)
    step, mark = fst.boundary_machine()
    state, want = fst.AT, []
    for s in seen:
        want.append(mark[state * fst.SYMBOLS + s])
        state = step[state * fst.SYMBOLS + s]
    assert fst.marks(seen, chunk).tolist() == want


def test_query(spark, small, tmp_path):
    fixtures.frame(spark).write.parquet(f"{tmp_path}/documents.parquet")
    for where in (small, str(tmp_path)):
        source = spark.read.parquet(f"{where}/documents.parquet").collect()
        want = sorted((str(r.doc_id), len((r.text or "").encode()), n := wanted([r.text or ""])[0], n > 1024) for r in source)
        assert sorted((str(r.doc_id), *r[1:]) for r in fst.op10_token_counts(spark, where).collect()) == want


def test_a_table_keeps_what_it_was_given():
    held, want = fst.Table(), {}
    draw = np.random.default_rng(4)
    for _ in range(40):
        keys = np.setdiff1d(draw.integers(0, 1 << 40, 700), np.array(list(want), np.int64))
        to, emit = draw.integers(0, 1 << 30, len(keys)).astype(np.int32), draw.integers(-99, 2, len(keys)).astype(np.int16)
        held.add(keys, to, emit)
        want |= dict(zip(keys.tolist(), zip(to.tolist(), emit.tolist(), strict=True), strict=True))
    keys = np.array(list(want), np.int64)
    at = held.find(keys)
    assert list(zip(held.to[at].tolist(), held.emit[at].tolist(), strict=True)) == list(want.values())
    assert (held.find(np.array([-5 + (1 << 41), (1 << 42)])) == -1).all()


def test_long_pre_tokens_by_chunks(monkeypatch):
    monkeypatch.setattr(fst, "PIECE", 8)
    draw = np.random.default_rng(6)
    words = ["".join(draw.choice(list("abcdeihrtAB"), n)) for n in (17, 40, 400, 3000)] + ["=" * 700, "ab" * 400, "the" * 300, "-_" * 333, "0" * 99, " " * 500]
    machine = fst.TokenMachine(PATH)
    assert machine.counts([w.encode() for w in words]) == wanted(words)
    machine = fst.TokenMachine(PATH)
    monkeypatch.setattr(machine, "longest", 0)  # no run-up: chunks start wrong and are run again
    assert machine.counts([w.encode() for w in words]) == wanted(words)


def test_states_are_forgotten_without_harm(monkeypatch):
    monkeypatch.setattr(fst, "STATES_HELD", 5)
    machine = fst.TokenMachine(PATH)
    for text in ("hello", "world", "hello", "strawberries"):
        assert machine.counts([text.encode()]) == wanted([text])


def test_empty_table(spark):
    assert fst.token_counts(fixtures.empty(spark), PATH).collect() == []


def test_a_text_of_megabytes():
    text = ("the quick brown fox " * 60_000) + "z" * 50_000 + "\n" * 20_000
    assert COUNTER([text]).tolist() == wanted([text])
