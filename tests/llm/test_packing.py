import random
import time
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from fathomline.llm import packing

from . import fixtures

PATH = public_tokenizers.path(packing.VOCABULARY)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=60))
def test_pack_keeps_every_item_within_capacity(lengths):
    bins = packing.pack(lengths, 64)
    assert sorted(i for b in bins for i in b) == list(range(len(lengths)))
    assert all(0 < sum(lengths[i] for i in b) <= 64 for b in bins)


def test_local_search_saves_a_bin_that_best_fit_wastes():
    # Best fit needs three bins; exchanges of one for one and two for one fill two.
    lengths, capacity = [24, 14, 16, 29, 25, 29, 14, 22], 88
    bins = packing.Bins(lengths, capacity)
    bins.best_fit()
    before = sum(1 for b in bins.bins if b)
    bins.improve()
    assert before == 3 and sum(1 for b in bins.bins if b) == 2


def test_triples_of_middling_lengths():
    lengths = np.random.default_rng(1).integers(600, 761, 3000).tolist()
    assert len(packing.pack(lengths, 2048)) <= 1090


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 40), min_size=2, max_size=40))
def test_search_never_lowers_the_sum_of_squares(lengths):
    bins = packing.Bins(lengths, 40)
    bins.bins = [[i] for i in range(len(lengths))]
    bins.free = [40 - x for x in lengths]
    before = sum(x * x for x in lengths)
    bins.improve()
    assert sum((40 - f) ** 2 for f in bins.free) >= before and all(f >= 0 for f in bins.free)


@pytest.mark.parametrize(("low", "high"), [(400, 1000), (500, 900), (250, 700)])
def test_local_search_saves_bins_of_middling_lengths(low, high):
    lengths = np.random.default_rng(7).integers(low, high + 1, 1500).tolist()
    bins = packing.Bins(lengths, 2048)
    bins.best_fit()
    assert len(packing.pack(lengths, 2048)) < sum(1 for b in bins.bins if b)


def test_cut():
    assert packing.cut(5, 10) == [(0, 5)] and packing.cut(10, 10) == [(0, 10)] and packing.cut(23, 10) == [(0, 3), (3, 10), (13, 10)] and packing.cut(20, 10) == [(0, 10), (10, 10)]


def check(spark, where, library):
    want = set()
    source = spark.read.parquet(f"{where}/documents.parquet").collect()
    total = 0
    for r in source:
        ids = np.array([*library.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4")
        total += len(ids)
        want |= {(r.doc_id, k, s, n, zlib.crc32(ids[s : s + n].tobytes())) for k, (s, n) in enumerate(packing.cut(len(ids)))}
    rows = packing.op2_best_fit(spark, where).collect()
    assert {tuple(r)[:5] for r in rows} == want
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
    return len(rows), len(bins), total


def test_query(spark, small, library, tmp_path):
    n, used, total = check(spark, small, library)
    assert used <= -(-total // packing.CAPACITY) * 1.03 + 1
    fixtures.frame(spark).write.parquet(f"{tmp_path}/a/documents.parquet")
    assert check(spark, f"{tmp_path}/a", library)[0] >= len(fixtures.rows())
    fixtures.empty(spark).write.parquet(f"{tmp_path}/b/documents.parquet")
    assert packing.op2_best_fit(spark, f"{tmp_path}/b").collect() == []


@pytest.mark.parametrize(("group", "waste"), [(8, 1.25), (64, 1.07)])
def test_small_groups_pack_again_and_keep_every_piece(spark, monkeypatch, group, waste):
    monkeypatch.setattr(packing, "GROUP", group)
    lengths = np.random.default_rng(2).integers(1, 2049, 500).tolist()
    rows = [(None if i % 50 == 0 else i % 90, 0, 0, n, i, bytes([i % 256])) for i, n in enumerate(lengths)]
    got = packing.packed(spark.createDataFrame(rows, packing.PIECES + ", ids binary")).collect()
    assert sorted((r.length, r.ids_crc32, r.ids) for r in got) == sorted((n, i, bytes([i % 256])) for i, n in enumerate(lengths))
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
    assert len(bins) <= -(-sum(lengths) // packing.CAPACITY) * waste



def test_no_level_loses_a_piece(spark, monkeypatch):
    """More levels than any limit there was: pieces that fill no sequence go on from level to level, and the last one keeps them."""
    monkeypatch.setattr(packing, "GROUP", 4)
    monkeypatch.setattr(packing, "_last", lambda level, *_: level == 66)
    rows = [(i, 0, 0, 1500 if i % 3 else 2048, i) for i in range(12)]
    got = packing.packed(spark.createDataFrame(rows, packing.PIECES).coalesce(2)).collect()
    assert sorted(r.doc_id for r in got) == list(range(12)) and len({r.sequence_id for r in got}) == 12


def test_search_of_middling_lengths_is_quick_and_good():
    draw = random.Random(1)
    lengths = [draw.randint(500, 900) for _ in range(4096)]
    start = time.process_time()
    bins = packing.pack(lengths)
    assert len(bins) <= 1480 and sorted(i for b in bins for i in b) == list(range(4096)) and time.process_time() - start < 20
