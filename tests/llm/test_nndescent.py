import numpy as np

from fathomline.llm import nndescent


def brute(rows, threshold=0.9):
    scaled = {i: np.array(v, float) / np.abs(v).max() for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and np.any(v)}
    usable = {i: v / np.linalg.norm(v) for i, v in scaled.items()}
    links = {i: {j for j in usable if j != i and len(usable[i]) == len(usable[j]) and usable[i] @ usable[j] >= threshold} for i in usable}
    out = []
    for i, _ in rows:
        seen, todo = set(), [i]
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += links.get(x, ())
        out.append((i, len(links.get(i, ())), min(seen), i == min(seen)))
    return sorted(out)


def clustered(seed=0):
    draw = np.random.default_rng(seed)
    rows, k = [], 0
    for size, spread in ((150, 0.01), (60, 0.04), (9, 0.05), (2, 0.03), (1, 0), (40, 0.055)):
        centre = draw.standard_normal(32)
        centre /= np.linalg.norm(centre)
        for _ in range(size):
            rows.append((k * 7 % 1009, (centre + spread * draw.standard_normal(32)).tolist()))
            k += 1
    return rows + [(2000 + i, draw.standard_normal(32).tolist()) for i in range(150)]


def got(spark, rows):
    return sorted(tuple(r) for r in nndescent.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect())


def test_against_brute_force(spark):
    rows = clustered()
    assert got(spark, [(*r, 1) for r in rows]) == brute(rows)


def test_blocks_and_leaves_do_not_change_the_result(spark, monkeypatch):
    monkeypatch.setattr(nndescent, "BLOCK", 16)
    monkeypatch.setattr(nndescent, "LEAF", 32)
    rows = clustered(5)
    assert got(spark, [(*r, 1) for r in rows]) == brute(rows)


def test_edge_rows(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [float("nan"), 1.0]), (7, [None, 1.0]), (8, [float("inf"), 1.0]), (9, [1.0, 0.0, 0.0]), (10, [1e-300, 0.0])]
    assert got(spark, [(*r, 0) for r in rows]) == brute(rows)
    repeated = nndescent.near_duplicates(spark.createDataFrame([(None, [1.0, 0.0]), (4, [1.0, 0.0]), (4, [1.0, 0.0]), (5, [1.0, 0.1])], "vec_id long, embedding array<double>")).collect()
    assert sorted((str(r.vec_id), r.n_links, r.component_id, r.kept) for r in repeated) == [("4", 1, 4, True), ("4", 1, 4, True), ("5", 1, 4, False), ("None", 0, None, False)]
    assert got(spark, []) == []


def test_joins_improve_the_lists_until_they_settle(spark, monkeypatch):
    draw = np.random.default_rng(3)
    x = draw.standard_normal((400, 3)) @ draw.standard_normal((3, 16))
    x /= np.linalg.norm(x, axis=1)[:, None]
    near = x @ x.T
    np.fill_diagonal(near, -2)
    best = {i: set(np.argsort(-r)[: nndescent.K].tolist()) for i, r in enumerate(near)}
    recalls, descend = [], nndescent._descend

    def watched(lists, vectors, threshold):
        rows = lists.select("u", "v").collect()
        recalls.append(sum(r.v in best[r.u] for r in rows) / (nndescent.K * len(x)))
        return descend(lists, vectors, threshold)

    monkeypatch.setattr(nndescent, "_descend", watched)
    monkeypatch.setattr(nndescent, "TREES", 1)
    monkeypatch.setattr(nndescent, "LEAF", 16)
    rows = [(i, r.tolist()) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got_rows = sorted(tuple(r) for r in nndescent.near_duplicates(df, threshold=0.9999).collect())
    assert got_rows == brute(rows, 0.9999)
    # One tree's lists miss most true neighbours; the joins find them without fresh trees.
    assert recalls[0] < 0.7 and len(recalls) > 2 and recalls[-1] > 0.9


def test_a_dense_group_does_not_hide_lost_pairs(spark, monkeypatch):
    draw = np.random.default_rng(9)
    rows = [(i, (np.eye(16)[0] + 0.001 * draw.standard_normal(16)).tolist()) for i in range(100)]
    for i in range(60):
        a, b = np.linalg.qr(draw.standard_normal((16, 2)))[0].T
        rows += [(1000 + 2 * i, a.tolist()), (1001 + 2 * i, (0.905 * a + (1 - 0.905**2) ** 0.5 * b).tolist())]
    monkeypatch.setattr(nndescent, "TREES", 1)
    monkeypatch.setattr(nndescent, "LEAF", 2)
    monkeypatch.setattr(nndescent, "K", 1)
    monkeypatch.setattr(nndescent, "SATURATED", 1)
    monkeypatch.setattr(nndescent, "ROUNDS", 1)
    monkeypatch.setattr(nndescent, "SIDE", 50, raising=False)
    assert got(spark, [(*r, 1) for r in rows]) == brute(rows)


def test_the_audit_weighs_vectors_and_not_links(spark):
    from pyspark.sql import functions as F

    rows = [(i, [1.0, 0.0] + [0.0] * 20) for i in range(300)]
    rows += [(1000 + i, [0.0, 0.0] + [float(i // 2 == k) for k in range(20)]) for i in range(40)]
    vectors = spark.createDataFrame([(i, 22, np.array(v).tobytes()) for i, v in rows], "id long, d int, vec binary")
    # 89,700 of 89,740 links: the 20 pairs are lost.
    counts = spark.createDataFrame([(i, 299) for i in range(300)], "id long, n long")
    assert nndescent._audit(vectors, counts, 0.9) < nndescent.RECALL
    whole = counts.union(vectors.filter("id >= 1000").select("id", F.lit(1).cast("long")))
    assert nndescent._audit(vectors, whole, 0.9) == 1


def test_copies_clusters_and_a_hub(spark, monkeypatch):
    """2,000 vectors: a third copies of one, a cluster of near copies, a hub between two groups that link through it alone; blocks of 64."""
    draw = np.random.default_rng(21)
    monkeypatch.setattr(nndescent, "BLOCK", 64)
    unit = lambda v: v / np.linalg.norm(v)
    base, other = unit(draw.standard_normal(24)), unit(draw.standard_normal(24))
    rows = [(i, base.tolist()) for i in range(660)]
    rows += [(1000 + i, unit(other + 0.05 * draw.standard_normal(24)).tolist()) for i in range(500)]
    a, b = np.linalg.qr(draw.standard_normal((24, 2)))[0].T
    turned = lambda angle: np.cos(angle) * a + np.sin(angle) * b
    rows += [(2000 + i, (turned(0.0) + 0.002 * draw.standard_normal(24)).tolist()) for i in range(150)]
    rows += [(3000 + i, (turned(0.84) + 0.002 * draw.standard_normal(24)).tolist()) for i in range(150)] + [(4000, turned(0.42).tolist())]
    rows += [(5000 + i, draw.standard_normal(24).tolist()) for i in range(400)]
    scaled = {i: np.array(v) / np.linalg.norm(v) for i, v in rows}
    ids = np.array(list(scaled))
    x = np.stack([scaled[i] for i in ids])
    near = x @ x.T >= 0.9
    np.fill_diagonal(near, False)
    label = ids.copy()
    while True:
        low = np.array([label[near[k]].min(initial=label[k]) for k in range(len(ids))])
        if (low == label).all():
            break
        label = np.minimum(label, low)
    want = sorted((int(i), int(n), int(c), bool(i == c)) for i, n, c in zip(ids, near.sum(axis=1), label, strict=True))
    assert got(spark, [(*r, 0) for r in rows]) == want
    assert {c for i, _, c, _ in want if 2000 <= i <= 4000} == {2000}


def test_clashing_names_and_doubles(spark):
    rows = [(1, [0.1, 0.2], 9, "x"), (2, [0.1, 0.2000001], 9, "x"), (3, [-0.3, 0.1], 9, "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, id long, vec string")
    got_rows = sorted(tuple(r) for r in nndescent.near_duplicates(df).collect())
    assert got_rows == [(1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True)]
