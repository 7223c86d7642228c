import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fathomline.llm import jaccard
from fathomline.llm.shingles import shingle_sets

from . import fixtures


def word_set(text, words):
    w = (text or "").encode().lower().split()
    if len(w) < words:
        return {tuple(w)} if w else set()
    return {tuple(w[i : i + words]) for i in range(len(w) - words + 1)}


def brute(rows, words, percent):
    """doc_id -> (set size, component) by comparing all pairs."""
    sets = [(d, word_set(t, words)) for d, t in rows]
    parent = {d: d for d, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, s) in enumerate(sets):
        for b, t in sets[:i]:
            if s and t and 100 * len(s & t) >= percent * len(s | t) and root(a) != root(b):
                parent[max(root(a), root(b))] = min(root(a), root(b))
    return sorted((d, len(s), root(d)) for d, s in sets)


def got(spark, rows, words=4, percent=85):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted(tuple(r) for r in jaccard.jaccard_components(df, words, percent).collect())


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(alphabet="ab AB\té\n\x1c", max_size=40), max_size=6), st.integers(1, 5))
def test_shingle_sets(texts, words):
    hashes, bounds = shingle_sets(texts, words)
    assert np.diff(bounds).tolist() == [len(word_set(t, words)) for t in texts]
    for i, a in enumerate(texts):
        for j, b in enumerate(texts):
            common = len(np.intersect1d(hashes[bounds[i] : bounds[i + 1]], hashes[bounds[j] : bounds[j + 1]]))
            assert common == len(word_set(a, words) & word_set(b, words))


@pytest.mark.parametrize("percent", [80, 85])
def test_linked_sets_share_a_signature(percent):
    draw = np.random.default_rng(3)
    for size in [*range(1, 60), 100, 300, 1000]:
        for _ in range(12):
            base = draw.integers(0, 1 << 64, size, dtype=np.uint64)
            other = base.copy()
            change = draw.integers(0, max(1, size * (100 - percent) // 150) + 1)
            other[:change] = draw.integers(0, 1 << 64, change, dtype=np.uint64)
            other = other[draw.integers(0, 2) * draw.integers(0, max(1, size // 20)) :]
            a, b = np.unique(base), np.unique(other)
            if 100 * len(np.intersect1d(a, b)) >= percent * len(np.union1d(a, b)):
                who, signs = jaccard.signatures(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]), percent)
                assert set(signs[who == 0]) & set(signs[who == 1])


def copies(n, length, edits, seed):
    draw = random.Random(seed)
    base = [f"w{draw.randrange(5000)}" for _ in range(length)]
    out = []
    for _ in range(n):
        words = list(base)
        for _ in range(draw.randrange(edits + 1)):
            words[draw.randrange(length)] = f"x{draw.randrange(10**6)}"
        out.append(" ".join(words))
    return out


def test_against_brute_force(spark, small):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    assert got(spark, rows) == brute(rows, 4, 85)
    assert got(spark, rows, 5, 80) == brute(rows, 5, 80)


def test_large_groups_are_split_without_loss(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "UNIT", 12)
    monkeypatch.setattr(jaccard, "PIVOTS", 2)
    texts = copies(90, 90, 8, 1) + copies(60, 40, 3, 2) + [" ".join(f"p{i}" for i in range(60)) + " " + " ".join(f"own{k}_{i}" for i in range(30)) for k in range(60)] + copies(30, 8, 1, 4)
    rows = list(enumerate(texts))
    random.Random(0).shuffle(rows)
    assert got(spark, rows) == brute(sorted(rows), 4, 85)
    assert got(spark, rows, 5, 80) == brute(sorted(rows), 5, 80)


def test_any_hot_tokens_keep_all_links():
    draw = np.random.default_rng(8)
    for size in (5, 20, 80, 400):
        base = np.unique(draw.integers(0, 1 << 64, size, dtype=np.uint64))
        other = np.unique(np.concatenate([base[size // 12 :], draw.integers(0, 1 << 64, size // 20, dtype=np.uint64)]))
        if 100 * len(np.intersect1d(base, other)) < 80 * len(np.union1d(base, other)):
            continue
        for share in (0.0, 0.3, 0.9, 1.0):
            hot = np.sort(draw.permutation(base)[: int(share * len(base))])
            who, signs = jaccard.signatures(np.concatenate([base, other]), np.array([0, len(base), len(base) + len(other)]), 80, hot)
            assert set(signs[who == 0]) & set(signs[who == 1])


def test_edge_rows(spark):
    df = fixtures.frame(spark)
    rows = jaccard.jaccard_components(df).collect()
    assert len(rows) == df.count()
    assert [tuple(r) for r in rows if r.doc_id is None] == [(None, 1, None)]
    found = {r.doc_id: r for r in rows}
    assert found[10].component_id == 10 and found[11].component_id == 10  # equal texts
    assert found[0].n_shingles == found[1].n_shingles == found[2].n_shingles == 0 and found[1].component_id == 1
    assert jaccard.jaccard_components(fixtures.empty(spark)).collect() == []


def windows(n, step=6, length=44):
    """Overlapping windows of one long text: neighbours share most words, but too few for a link."""
    draw = random.Random(5)
    words = [f"w{draw.randrange(10**6)}" for _ in range(n * step + length)]
    return [" ".join(words[i * step : i * step + length]) for i in range(n)]


def test_a_chain_of_windows_opens_blocks_in_proportion(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "UNIT", 16)
    monkeypatch.setattr(jaccard, "LEAST_HOT", 3)
    shipped = {}
    keep = jaccard.Stages.keep

    def watched(self, df, label):
        out = keep(self, df, label)
        if label == "jaccard-named":
            shipped[count] = out.count()
        return out

    monkeypatch.setattr(jaccard.Stages, "keep", watched)
    for count in (600, 1200):
        texts = windows(count) + copies(20, 40, 2, 9)
        rows = list(enumerate(texts))
        assert got(spark, rows) == brute(rows, 4, 85)
        # The same windows as one large group: what is shipped grows with the texts, not with their square.
        hashes, bounds = shingle_sets(texts, 4)
        sets = spark.createDataFrame([(0, i, int(b - a), hashes[a:b].tobytes()) for i, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False))], "g long, doc_id long, n long, tokens binary")
        hot = spark.sparkContext.broadcast((np.zeros(0, np.uint64), np.zeros(0, np.uint32)))
        links = jaccard._opened(sets, 85, hot, jaccard.Stages())
        pairs = {tuple(sorted((r.a, r.b))) for part in links for r in part.collect()}
        assert all(a >= count for a, _ in pairs) and pairs
    assert shipped[600] and shipped[1200] <= 2.2 * shipped[600] and shipped[1200] < 1200 * 14


def test_the_smallest_long_is_an_id(spark):
    text = " ".join(fixtures.WORDS)
    rows = [(-(1 << 63), text), (5, text), (7, "other words than these here"), (None, text)]
    out = sorted(((r.doc_id is None, r.doc_id, r.component_id) for r in jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert out == sorted([(False, -(1 << 63), -(1 << 63)), (False, 5, -(1 << 63)), (False, 7, 7), (True, None, None)], key=str)


def test_segments_do_not_matter(monkeypatch):
    from fathomline.llm import shingles

    draw = random.Random(8)
    texts = [" ".join("".join(draw.choice("abÀ") for _ in range(draw.randrange(1, 30))) for _ in range(60)), "x" * 500, "", " a ", None, "end"]
    want = shingle_sets(texts, 4)
    for size in (1, 7, 64):
        monkeypatch.setattr(shingles, "SEGMENT", size)
        got_sets = shingle_sets(texts, 4)
        assert (got_sets[0] == want[0]).all() and (got_sets[1] == want[1]).all()
