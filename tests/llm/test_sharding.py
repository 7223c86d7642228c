import math
import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from fathomline.llm import sharding

from . import fixtures


def test_slots_are_gapless_and_growth_moves_rows_only_into_the_new_shard(spark, small):
    rows = sharding.op5_shard_tree(spark, small).collect()
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    assert len(rows) == len(texts)
    slots = defaultdict(list)
    for r in rows:
        raw = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law) == (len(raw) + 8, zlib.crc32(raw), "key")
        assert r.grown_shard in (r.shard, 24)
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def path(shard):
    rack = shard // sharding.SHARDS_PER_RACK
    return rack // sharding.RACKS_PER_REGION, rack, shard


def test_weights_move_rows_only_in_subtrees_whose_weights_change(spark):
    ids = spark.range(8000).withColumnRenamed("id", "doc_id")
    placed = lambda **more: {r.doc_id: path(r.shard) for r in sharding.shard(ids, "doc_id", 24, **more).collect()}
    before, after, gone = placed(), placed(weights={5: 3.0}), placed(weights={5: 0.0})
    for old, new in zip(before.values(), (after[k] for k in before), strict=True):
        if old != new:
            level = next(n for n in range(3) if old[n] != new[n])
            assert new[level] == path(5)[level]
    for old, new in zip(before.values(), (gone[k] for k in before), strict=True):
        if old != new:
            level = next(n for n in range(3) if old[n] != new[n])
            assert old[level] == path(5)[level] and new[2] != 5
    counts = Counter(p[2] for p in after.values())
    assert all(abs(counts[s] - 8000 * (3 if s == 5 else 1) / 26) < 90 for s in range(24)) and 5 not in Counter(p[2] for p in gone.values())
    assert all(abs(n - 8000 / 24) < 90 for n in Counter(p[2] for p in before.values()).values())


def test_edge_rows(spark):
    df = fixtures.frame(spark)
    rows = sharding.shard(df, "doc_id", 3).collect()
    assert len(rows) == df.count() and len({(r["shard"], r["slot"]) for r in rows}) == len(rows)
    assert len({r["shard"] for r in rows if r["doc_id"] == 10}) == 1
    assert sharding.shard(fixtures.empty(spark), "doc_id", 3).collect() == []


def test_copies_of_one_row_are_dealt_to_several_chunks(spark):
    one = spark.range(1000, numPartitions=8).selectExpr("cast(7 as long) as doc_id", "'t' as text")
    got = sharding.shard(one, "doc_id", 3).collect()
    assert len({r["shard"] for r in got}) == 1 and sorted(r["slot"] for r in got) == list(range(1000))


def test_shards_are_those_of_a_plain_descent(spark):
    weights = {s: 1.0 + s % 3 for s in range(30)}
    tree = sharding.tree(30, weights)
    total = lambda node: node if isinstance(node, float) else sum(map(total, node.values()))
    nodes = {(0, r) for r in tree} | {(1, k) for below in tree.values() for k in below} | {(2, s) for s in weights}
    keys = spark.range(500).select(F.col("id").cast("string").alias("k"))
    rows = keys.select("k", *[F.shiftrightunsigned(F.xxhash64("k", F.lit(level), F.lit(n)), 12).alias(f"h{level}_{n}") for level, n in nodes], sharding.place(F.col("k"), tree).alias("s")).collect()
    for r in rows:
        node = tree
        for level in range(3):
            chosen = min(node, key=lambda n, level=level, node=node: -math.log((r[f"h{level}_{n}"] + 0.5) / 2**52) / total(node[n]))
            node = node[chosen]
        assert r["s"] == chosen
