"""Queries over whole tables against plain loops."""

from collections import defaultdict

import duckdb
import numpy as np

from fathomline.operators import solvers
from fathomline.plans import registry
from fathomline.plans.evaluation import scored

QUERIES = registry.queries()


def test_components_of_all_orders(spark, small):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for r in spark.read.parquet(f"{small}/orders.parquet").select("o_custkey", "o_orderkey").collect():
        a, b = find(r.o_custkey), find(1000000 + r.o_orderkey % 700)
        parent[max(a, b)] = min(a, b)
    assert {(r.node, r.component) for r in QUERIES["connected_components_roads"](spark, small).collect()} == {(x, find(x)) for x in parent}


def test_case_metrics_count_all_orders(spark, small):
    errors = defaultdict(list)
    for r in spark.read.parquet(f"{small}/orders.parquet").collect():
        errors[r.o_orderpriority, "seed" if r.o_orderkey % 3 == 0 else "blind"].append(abs(float(r.o_totalprice) / 1000 - 150))
    got = {(r.layer, r.kind): r for r in QUERIES["case_metrics"](spark, small).collect()}
    assert set(got) == set(errors)
    assert all(got[k].n == len(e) and abs(got[k].mae - sum(e) / len(e)) < 1e-5 and abs(got[k].pass_rate - sum(x <= 50 for x in e) / len(e)) < 1e-5 for k, e in errors.items())


def test_rollup_of_all_roads(spark, small):
    n, taken, right = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in scored(spark, small).collect():
        n[r.layer] += 1
        if r.score is not None and r.score >= 0.9:
            taken[r.layer, r.road] += 1
            right[r.layer, r.road] += bool(r.correct)
    for r in QUERIES["macro_vs_pooled_rollup"](spark, small).collect():
        rates = [right[k] / taken[k] for k in taken if k[0] == r.layer]
        assert r.n == n[r.layer] and abs(r.worst_road - min(rates)) < 1e-5 and abs(r.macro - sum(rates) / len(rates)) < 1e-5


def roads(spark, small):
    out = defaultdict(list)
    for r in sorted(spark.read.parquet(f"{small}/embeddings.parquet").collect(), key=lambda r: r.vec_id):
        out[r.label].append((r.vec_id, np.array(r.embedding, float)))
    return out


def test_solvers_take_whole_roads(spark, small):
    for label, rows in roads(spark, small).items():
        s = np.stack([v for _, v in rows])
        want = solvers.second_order_path(s, 0.03, 0.008)[1]
        got = [r for r in QUERIES["second_order_paths"](spark, small).filter(f"label = {label}").collect()]
        assert len(got) == 1 and len(got[0].path) == len(s) and np.isclose(got[0].score, want)
        break
    for name in ("gapped_decoding", "interval_min_marginals"):
        got = QUERIES[name](spark, small).groupBy("label").count().collect()
        assert {r.label: r["count"] for r in got} == {k: len(v) for k, v in roads(spark, small).items()}


def test_all_samples_count(spark, small):
    traces = {i: v for rows in roads(spark, small).values() for i, v in rows}
    best = {}
    step = 0.05 * np.abs(np.arange(64)[:, None] - np.arange(64))
    for label, rows in roads(spark, small).items():
        acc = rows[0][1]
        for _, v in rows[1:]:
            acc = (acc[:, None] - step).max(axis=0) + v
        best[label] = acc.max()
    got = {r.label: r.best for r in QUERIES["viterbi_l1_score"](spark, small).collect()}
    assert set(got) == set(best) and all(abs(got[k] - best[k]) < 1e-4 for k in best)
    assert QUERIES["blended_seed_scores"](spark, small).count() == 64 * len(traces)
    pairs = {r.vec_id: r.cost for r in QUERIES["constrained_dtw_pairs"](spark, small).collect()}
    assert set(pairs) == {i for i in traces if i + 1 in traces}
    for i in sorted(pairs)[:20]:
        w = np.full((65, 65), np.inf)
        w[0, 0] = 0
        for a in range(1, 65):
            for b in range(max(1, a - 2), min(64, a + 2) + 1):
                w[a, b] = (traces[i][a - 1] - traces[i + 1][b - 1]) ** 2 + min(w[a - 1, b], w[a, b - 1], w[a - 1, b - 1])
        assert abs(pairs[i] - w[64, 64]) < 1e-4


def test_two_hop_routes_of_many_that_share_their_ends(spark, tmp_path):
    import threading

    n = 12_000
    # All suppliers link to 0 and 1, which is 288 million pairs of suppliers; the strongest links are the only ones of their kind.
    rows = spark.range(n).selectExpr("id AS l_suppkey", "explode(array(400L, 1L)) AS l_partkey")
    rows.selectExpr("*", "CASE WHEN l_suppkey = 5 THEN 50.0D + l_partkey % 400 ELSE 45.0D + (l_suppkey + l_partkey) % 3 END AS l_quantity").write.parquet(f"{tmp_path}/lineitem.parquet")
    q = lambda a, b: 50.0 + b if a == 5 else 45.0 + (a + (b or 400)) % 3
    timer = threading.Timer(100, spark.sparkContext.cancelAllJobs)
    timer.start()
    try:
        got = {(r.a, r.b): r for r in QUERIES["two_hop_routes"](spark, str(tmp_path)).collect()}
    finally:
        timer.cancel()
    assert len(got) == 2 * n
    for (a, b), r in got.items():
        route = min(q(a, 1 - b), 47.0 if a == 5 else 50.0 + b)
        assert (r.q, r.route, r.kept) == (q(a, b), route, route >= 47)


def test_families_at_the_threshold_and_in_ties(spark, tmp_path):
    # Seeds have one peak each, of score 1, and all other traces peaks of score 1 at every other sample. Roads of equal seeds meet the threshold, others have ties.
    roads = [{0: 1, 150: 9, 300: 39}, {0: 1, 150: 1, 300: 1}]
    peaks = {1000 * road + i: [seeds[i]] if i in seeds else list(range(1, 63, 2)) for road, seeds in enumerate(roads) for i in range(301)}
    traces = [(at, [1.0 if k in own else 0.0 for k in range(64)], at // 1000) for at, own in peaks.items()]
    spark.createDataFrame(traces, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {(r.vec_id, r.k): r.family for r in QUERIES["family_assignments"](spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = {(at, k): family for at, k, family in con.sql(f"SELECT vec_id, k, family FROM ({registry.oracle_sql()['family_assignments']})").fetchall()}
    assert len(want) == sum(map(len, peaks.values())) and got == want
