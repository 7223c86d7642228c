"""Shards by a hierarchical weighted hash tree (regions, racks, shards)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents_of, shuffle_partitions, stage_table, table

#: Shards of a rack and racks of a region in the query's tree.
SHARDS_PER_RACK, RACKS_PER_REGION = 4, 3


def tree(shards: int, weights: dict[int, float] | None = None) -> dict[int, dict[int, dict[int, float]]]:
    """region -> rack -> shard -> weight. Shard numbers fix their place, so a further shard changes one path only."""
    out: dict[int, dict[int, dict[int, float]]] = {}
    for shard in range(shards):
        weight = float((weights or {}).get(shard, 1.0))
        if weight < 0 or weight != weight:
            raise ValueError(f"weight of shard {shard} must not be negative")
        rack = shard // SHARDS_PER_RACK
        out.setdefault(rack // RACKS_PER_REGION, {}).setdefault(rack, {})[shard] = weight
    return out


def _draw(key: Column, level: int, node: int, weight: float) -> Column:
    """An exponential draw of rate ``weight``: -ln(u) / weight, u in (0, 1) from a 52-bit hash of key, level and node."""
    if weight == 0:
        return F.lit(float("inf"))
    bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(level), F.lit(node)), 12).cast("double")
    return -F.log((bits + F.lit(0.5)) / F.lit(float(1 << 52))) / F.lit(weight)


def _drawn(key: Column, level: int, nodes: dict[int, float]) -> Column:
    """The node with the smallest draw, of equal draws the first: each in proportion to its weight."""
    if len(nodes) == 1:
        return F.lit(next(iter(nodes)))
    return F.array_min(F.array(*(F.struct(_draw(key, level, n, w).alias("d"), F.lit(n).alias("n")) for n, w in nodes.items())))["n"]


def _below(chosen: Column, key: Column, level: int, children: dict[int, dict[int, float]]) -> Column:
    """The child drawn below the node ``chosen``, which is found once; only its own children draw."""

    def of(node: Column) -> Column:
        cases = None
        for n, below in children.items():
            cases = F.when(node == n, _drawn(key, level, below)) if cases is None else cases.when(node == n, _drawn(key, level, below))
        return cases

    return F.transform(F.array(chosen), of)[0]


def place(key: Column, levels: dict[int, dict[int, dict[int, float]]]) -> Column:
    """The shard of ``key``: descend region, rack and shard, at each level into the child with the smallest draw.

    A node's draw is its own, exponential with the weight of its subtree as rate, so each level picks a child in proportion to that, and only
    the children of the chosen node draw: with 24 shards 2, 3 and 4 draws a row. Draws of subtrees whose weights stay do not move, so a change of weights moves
    rows only out of subtrees that lose weight and into such as gain it; what moves into a subtree is then drawn among all its
    children. A further shard that opens a region of its own, as number 24 does, therefore takes rows only into itself; one inside a rack also
    draws rows into that rack's region and rack, and so to its neighbours there.
    """
    racks = {rack: shards for below in levels.values() for rack, shards in below.items()}
    regions = {region: sum(sum(shards.values()) for shards in below.values()) for region, below in levels.items()}
    heavy = {region: {rack: sum(shards.values()) for rack, shards in below.items()} for region, below in levels.items()}
    return _below(_below(_drawn(key, 0, regions), key, 1, heavy), key, 2, racks)


def shard(df: DataFrame, id_col: str, shards: int = 24, grow: int = 1, weights: dict[int, float] | None = None, carry: list[str] | None = None) -> DataFrame:
    """``carry`` columns with id, shard, grown_shard (with ``grow`` more shards) and slot, gapless from 0 in each shard.

    The id alone decides the shard (law ``key``), so equal texts may part and repeated ids stay together; a null id is
    a key of its own. Slots follow chunks of a hash of the row and of the task that read it, numbered within each chunk, so no task holds a whole
    shard, nor all copies of a row: only the chunk counts, a few for each shuffle partition, are summed along a shard. The placed rows
    are written first, so that a slot never depends on a second reading. A column of ``carry`` must not be named shard,
    grown_shard, chunk, k, before or slot; others are not read; an empty table gives no rows. ``place`` says where rows go when shards or weights change.
    """
    if shards < 1:
        raise ValueError("at least one shard")
    key = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    chunks = 4 * shuffle_partitions(df.sparkSession)
    placed = df.select(
        F.col(id_col),
        *[F.col(c) for c in carry or []],
        place(key, tree(shards, weights)).cast("int").alias("shard"),
        place(key, tree(shards + grow, weights)).cast("int").alias("grown_shard"),
        F.pmod(F.xxhash64(key, F.spark_partition_id(), *[F.col(c) for c in carry or []]), F.lit(chunks)).cast("int").alias("chunk"),
    )
    placed, _ = stage_table(placed, "shards")
    numbered = placed.withColumn("k", F.row_number().over(Window.partitionBy("shard", "chunk").orderBy(id_col, *(carry or []))))
    counts = placed.groupBy("shard", "chunk").count()
    offsets = counts.select("shard", "chunk", (F.sum("count").over(Window.partitionBy("shard").orderBy("chunk")) - F.col("count")).alias("before"))
    return numbered.join(offsets, ["shard", "chunk"]).select(id_col, *(carry or []), "shard", (F.col("before") + F.col("k") - 1).alias("slot"), "grown_shard")


def op5_shard_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards under the law ``key``; a null text has size 8 and the crc32 of no bytes."""
    docs = documents_of(table(spark, sf_dir, "documents"))
    bytes_ = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    sized = docs.select("doc_id", (F.octet_length(bytes_).cast("long") + F.lit(8).cast("long")).alias("size"), F.crc32(bytes_).alias("text_crc32"))
    out = shard(sized, "doc_id", 24, 1, carry=["size", "text_crc32"])
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), "grown_shard")
