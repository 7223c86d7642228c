"""Near-duplicate embeddings by NN-descent.

Exact copies are one vector with a weight. Neighbour lists start from leaves of random hyperplane trees and are refined by
joining neighbours of neighbours: every vector meets, in one unit of work, its neighbours and those it is a neighbour of, and all
of these are compared with each other. What they find is merged into the lists, and joins go on until few entries change. A
list that is full of links (saturated) is enlarged. Every pair at the threshold that a unit sees is an edge, kept as stars, so that a dense
group costs a few edges a member however long its lists would have to be. Links stay within components; their exact
number is counted there: members are dealt to blocks that lie close together, pairs of blocks are settled by the angles between
their centres where these allow, and by products of their members where not. An audit compares the links of a fixed number of vectors
with brute force over all rows and adds further trees and refinements until the recall is reached. It weighs vectors, not
links, and looks at vectors of few links by themselves, so that a dense group cannot hide lost pairs. Where the rounds are used
up before, all pairs are compared, block against block.

Vectors travel as 32-bit numbers where that loses nothing and are normalised to doubles in each unit.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Stages, _local_roots, bounded_batches, components, delete_path, give_back, keyed_join, shuffle_partitions, stage_table, table
from .jaccard import _units

THRESHOLD = 0.9
#: Length of a list, and of a saturated one; trees a round; rows of a leaf and of a block.
K, SATURATED, TREES, LEAF, BLOCK = 8, 24, 4, 256, 1024
#: Vectors of the audit, the recall it asks for, and the rounds after which all pairs are compared.
AUDIT, RECALL, ROUNDS = 200, 0.995, 6
#: Vectors of the audit among those with no link found, and among those with K at most.
SPARSE = 2000
#: Rows of a side of the exact pass.
SIDE = 4096
#: Joins go on while more than this share of the lists' entries is new.
SETTLED = 0.03
#: Blocks whose pairs are settled in one unit, and partners that a block meets in one.
CENTRES, PARTNERS = 1024, 16
#: Vectors of small units that are compared at once.
AT_ONCE = 2048
EDGE = "kind int, u long, v long, s double"
LIST, LINK = 0, 1
#: Neighbours that one neighbourhood names to each of its members.
FEW = 3


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, d, vec): the numbers as bytes, 32-bit ones where that loses nothing; vec is null where the vector has no direction."""
    for batch in batches:
        ids, d, out = batch.column(0), [], []
        for vector in batch.column(1).to_pylist():
            raw = None
            if vector and None not in vector:
                x = np.array(vector, np.float64)
                if np.isfinite(x).all() and x.any():
                    with np.errstate(over="ignore"):
                        short = x.astype(np.float32)
                    raw = (short if (short == x).all() else x).tobytes()
            out.append(raw)
            d.append(len(vector) if vector else 0)
        yield pa.RecordBatch.from_arrays([ids, pa.array(d, pa.int32()), pa.array(out, pa.binary())], names=["id", "d", "vec"])


def _matrix(column, d: int) -> np.ndarray:
    """Unit vectors of packed ones, as doubles. Each row depends on its own bytes only."""
    raws = [x.as_buffer() for x in column]
    x = np.empty((len(raws), d))
    short = np.fromiter((r.size == 4 * d for r in raws), bool, len(raws))
    for some, kind in ((short, np.float32), (~short, np.float64)):
        at = np.flatnonzero(some)
        if len(at):
            x[at] = np.frombuffer(b"".join(raws[i].to_pybytes() for i in at.tolist()), kind).reshape(-1, d)
    x /= np.abs(x).max(axis=1, keepdims=True, initial=np.finfo(float).tiny)
    x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x


def _leaves(first: int, trees: int, bits: int):
    """(t, code, d, id, vec) of every vector in each of some trees: the sides of ``bits`` hyperplanes."""

    def run(batches):
        for batch in batches:
            dims = np.asarray(batch.column(1))
            for d in np.unique(dims).tolist():
                rows = batch.filter(pa.array(dims == d))
                x = _matrix(rows.column(2), d)
                for t in range(first, first + trees):
                    planes = np.random.default_rng([71, t, d]).standard_normal((d, bits))
                    code = (x @ planes > 0) @ (1 << np.arange(bits, dtype=np.int64)) if bits else np.zeros(len(x), np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), t, np.int32)), pa.array(code.astype(np.int64)), rows.column(1), rows.column(0), rows.column(2)], names=["t", "code", "d", "id", "vec"])
        give_back()

    return run


def _found(kinds: list, us: list, vs: list, ss: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(kinds)), pa.array(np.concatenate(us)), pa.array(np.concatenate(vs)), pa.array(np.concatenate(ss))], names=["kind", "u", "v", "s"])


def _compare(keys: int, threshold: float):
    """Units of vectors: each one's nearest others as LIST rows, and stars of the pairs at the threshold as LINK rows."""

    def run(batches):
        for unit in _units(batches, keys):
            unit = unit.combine_chunks()
            ids, first = np.unique(unit["id"].to_numpy(), return_index=True)
            if len(ids) < 2:
                continue
            x = _matrix(unit["vec"].take(pa.array(first)).combine_chunks(), unit["d"][0].as_py())
            s = np.clip(x @ x.T, -1, 1)
            a, b = np.nonzero(np.triu(s >= threshold, 1))
            kinds, us, vs, ss = [], [], [], []
            if len(a):
                nodes, roots = _local_roots(ids[a], ids[b])
                off = nodes != roots
                us.append(nodes[off])
                vs.append(roots[off])
                ss.append(np.ones(off.sum()))
                kinds.append(np.full(off.sum(), LINK, np.int32))
            np.fill_diagonal(s, -2)
            most = min(len(ids) - 1, SATURATED)
            order = np.argpartition(-s, most - 1, axis=1)[:, :most] if most < len(ids) - 1 else np.argsort(-s, axis=1)[:, :most]
            near = np.take_along_axis(s, order, axis=1)
            rank = np.argsort(-near, axis=1, kind="stable")
            order, near = np.take_along_axis(order, rank, axis=1), np.take_along_axis(near, rank, axis=1)
            # Beyond K only lists that are full of links go on.
            use = np.ones(near.shape, bool)
            use[:, K:] = (near[:, K - 1] >= threshold)[:, None] if near.shape[1] > K else False
            r, c = np.nonzero(use)
            us.append(ids[r])
            vs.append(ids[order[r, c]])
            ss.append(near[r, c])
            kinds.append(np.full(len(r), LIST, np.int32))
            yield _found(kinds, us, vs, ss)
        give_back()

    return run


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Whole runs of rows with an equal first column, several together in tables of about AT_ONCE rows."""
    held, size = [], 0
    for unit in _units(batches, 1):
        held.append(unit)
        size += unit.num_rows
        if size >= AT_ONCE:
            yield pa.concat_tables(held).combine_chunks()
            held, size = [], 0
    if held:
        yield pa.concat_tables(held).combine_chunks()


def _compare_around(threshold: float):
    """Neighbourhoods (w, id, d, vec, least) of many vectors w at once: from each, the few best of every member that are better than its list's last, and stars of the links."""

    def run(batches):
        for table_ in _gathered(batches):
            dims = table_["d"].to_numpy()
            for d in np.unique(dims).tolist():
                part = table_.filter(pa.array(dims == d)).combine_chunks()
                w, ids, least = part["w"].to_numpy(), part["id"].to_numpy(), part["least"].to_numpy()
                x = _matrix(part["vec"].combine_chunks(), d)
                heads = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1]]))
                sizes = np.diff(np.append(heads, len(w)))
                wide = int(sizes.max())
                unit = np.repeat(np.arange(len(heads)), sizes)
                place = np.arange(len(w)) - heads[unit]
                row = np.full((len(heads), wide), -1)
                row[unit, place] = np.arange(len(w))
                grid = np.zeros((len(heads), wide, d))
                grid[unit, place] = x
                s = np.clip(grid @ grid.transpose(0, 2, 1), -1, 1)
                s[np.broadcast_to((row < 0)[:, None, :], s.shape)] = -2
                s[:, np.arange(wide), np.arange(wide)] = -2
                # A vector that a neighbourhood holds twice is no neighbour of itself.
                named = np.where(row >= 0, ids[row], 0)
                s[(named[:, :, None] == named[:, None, :])] = -2
                kinds, us, vs, ss = [], [], [], []
                t, i, j = np.nonzero(s >= threshold)
                use = (row[t, i] >= 0) & (i < j)
                if use.any():
                    nodes, roots = _local_roots(named[t, i][use], named[t, j][use])
                    off = nodes != roots
                    us.append(nodes[off])
                    vs.append(roots[off])
                    ss.append(np.ones(off.sum()))
                    kinds.append(np.full(off.sum(), LINK, np.int32))
                most = min(wide - 1, FEW)
                if most > 0:
                    order = np.argpartition(-s, most - 1, axis=2)[:, :, :most]
                    near = np.take_along_axis(s, order, axis=2)
                    bar = np.where(row >= 0, least[row], 2.0)
                    t, i, k = np.nonzero((near > bar[:, :, None]) & (near > -2))
                    us.append(named[t, i])
                    vs.append(named[t, order[t, i, k]])
                    ss.append(near[t, i, k])
                    kinds.append(np.full(len(t), LIST, np.int32))
                if us:
                    yield _found(kinds, us, vs, ss)
        give_back()

    return run


def _trim(pairs: DataFrame, threshold: float) -> DataFrame:
    """(u, v, s, fresh): the K best of each u, SATURATED where the K-th is a link. A unit sends a bounded number a vector, so lists to merge are short.

    ``pairs`` has (u, v, s, fresh); an entry is fresh where no row of it is not. Equal cosines (rounded, as a product's last
    digits depend on its unit) go by a hash of the pair, so that copies do not all list the same few.
    """
    once = pairs.groupBy("u", "v").agg(F.max("s").alias("s"), F.bool_and("fresh").alias("fresh"))
    entry = F.struct((-F.round("s", 12)).alias("far"), F.xxhash64("u", "v").alias("h"), "v", "fresh")
    best = once.groupBy("u").agg(F.sort_array(F.collect_list(entry)).alias("l"))
    long = F.coalesce(F.get("l", F.lit(K - 1))["far"], F.lit(2.0)) <= -threshold
    cut = best.select("u", F.explode(F.slice("l", F.lit(1), F.when(long, SATURATED).otherwise(K))).alias("e"))
    return cut.select("u", F.col("e.v").alias("v"), (-F.col("e.far")).alias("s"), F.col("e.fresh").alias("fresh"))


def _tree_round(vectors: DataFrame, n: int, turn: int, threshold: float) -> DataFrame:
    """Lists and links of fresh leaves. A leaf above LEAF rows is dealt to parts by a hash, other parts in each tree."""
    parts = shuffle_partitions(vectors.sparkSession)
    bits = max(0, math.ceil(math.log2(max(1, n / LEAF))))
    leaves = vectors.mapInArrow(_leaves(turn * TREES, TREES, bits), "t int, code long, d int, id long, vec binary")
    counts = leaves.groupBy("t", "code", "d").count().filter(F.col("count") > LEAF).select("t", "code", "d", F.ceil(F.col("count") / LEAF).cast("int").alias("k"))
    dealt = leaves.join(counts, ["t", "code", "d"], "left").select("t", "code", "d", F.pmod(F.xxhash64("id", "t"), F.coalesce("k", F.lit(1))).cast("int").alias("part"), "id", "vec")
    keys = ["t", "code", "d", "part"]
    return dealt.repartition(parts, *keys).sortWithinPartitions(*keys).mapInArrow(_compare(4, threshold), EDGE)


def _descend(lists: DataFrame, vectors: DataFrame, threshold: float) -> DataFrame:
    """Neighbours of neighbours: each vector's list and at most K of those that list it are compared in one unit.

    Only units that a fresh entry touches are run: the others have compared the same vectors before.
    """
    parts = shuffle_partitions(vectors.sparkSession)
    fresh = lists.filter("fresh")
    active = fresh.select(F.col("u").alias("w")).union(fresh.select(F.col("v").alias("w"))).distinct()
    back = lists.groupBy(F.col("v").alias("w"), F.pmod(F.xxhash64("u"), F.lit(K)).alias("slot")).agg(F.min("u").alias("id")).select("w", "id")
    around = lists.select(F.col("u").alias("w"), F.col("v").alias("id")).union(back).union(lists.select(F.col("u").alias("w"), F.col("u").alias("id"))).join(active, "w", "left_semi").distinct()
    # A list's last entry, for lists that are full: worse ones need not come back. A list of links always takes more.
    last = lists.groupBy(F.col("u").alias("id")).agg(F.count("*").alias("n"), F.min("s").alias("s")).select("id", F.when((F.col("n") >= K) & ((F.col("n") >= SATURATED) | (F.col("s") < threshold)), F.col("s")).alias("bar"))
    known = vectors.join(last, "id", "left").select("id", "d", "vec", F.coalesce("bar", F.lit(-2.0)).alias("least"))
    met = around.join(known, "id").select("w", "id", "d", "vec", "least")
    return met.repartition(parts, "w").sortWithinPartitions("w", "id").mapInArrow(_compare_around(threshold), EDGE)


def _refine(pairs: DataFrame, lists: DataFrame | None, vectors: DataFrame, threshold: float, stages: Stages) -> tuple[DataFrame, DataFrame | None]:
    """(lists, links seen): fresh ``pairs`` merged with the ``lists`` so far, then joins merged into them until few entries change."""
    links = None
    found = pairs.select("u", "v", "s", F.lit(True).alias("fresh"))
    while True:
        lists = stages.keep(_trim(found if lists is None else lists.withColumn("fresh", F.lit(False)).union(found), threshold), "nn-lists")
        entries, fresh = lists.agg(F.count("*"), F.count_if("fresh")).first()
        if fresh <= SETTLED * entries:
            return lists, links
        joined = stages.keep(_descend(lists, vectors, threshold), "nn-joined")
        seen = joined.filter(F.col("kind") == LINK).select(F.col("u").alias("a"), F.col("v").alias("b"))
        links = seen if links is None else links.union(seen)
        found = joined.filter(F.col("kind") == LIST).select("u", "v", "s", F.lit(True).alias("fresh"))


def _codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(g, id, d, vec, w, k, ref) with the code of the side of each of log2(k) hyperplanes through ref on which a vector lies."""
    for batch in batches:
        dims, blocks = np.asarray(batch.column(2)), np.asarray(batch.column(5))
        code = np.zeros(batch.num_rows, np.int64)
        for d in np.unique(dims[blocks > 1]).tolist():
            at = np.flatnonzero((dims == d) & (blocks > 1))
            rows = batch.take(pa.array(at))
            bits = np.ceil(np.log2(blocks[at])).astype(np.int64)
            planes = np.random.default_rng([73, d]).standard_normal((d, 32))
            side = (_matrix(rows.column(3), d) - _matrix(rows.column(6), d)) @ planes > 0
            code[at] = (side & (np.arange(32) < bits[:, None])) @ (1 << np.arange(32, dtype=np.int64))
        yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(code)], names=["g", "id", "d", "vec", "w", "code"])


COUNT = "id long, n long, g string, b long, d int, centre binary, least double"


def _count_direct(threshold: float):
    """Units (g, b, id, d, vec, w): each member's links in the unit, and the block's weight, centre and least cosine to it."""

    def run(batches):
        for unit in _units(batches, 2):
            unit = unit.combine_chunks()
            ids, d, weight = unit["id"].to_numpy(), unit["d"][0].as_py(), unit["w"].to_numpy()
            x = _matrix(unit["vec"].combine_chunks(), d)
            n = np.zeros(len(x), np.int64)
            for i in range(0, len(x), 1024):
                linked = x[i : i + 1024] @ x.T >= threshold
                # A vector meets itself and its copies whatever its product rounds to; it never counts itself.
                linked[np.arange(len(linked)), np.arange(i, i + len(linked))] = True
                n[i : i + 1024] = linked @ weight - 1
            size = len(ids)
            none = lambda kind, size=size: pa.nulls(size, kind)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(n), none(pa.string()), none(pa.int64()), none(pa.int32()), none(pa.binary()), none(pa.float64())], names=["id", "n", "g", "b", "d", "centre", "least"])
            centre = x.mean(axis=0)
            centre /= max(np.linalg.norm(centre), 1e-300)
            yield pa.RecordBatch.from_pydict({"id": pa.array([None], pa.int64()), "n": pa.array([int(weight.sum())]), "g": pa.array([unit["g"][0].as_py()]), "b": pa.array([unit["b"][0].as_py()]), "d": pa.array([d], pa.int32()), "centre": pa.array([centre.tobytes()], pa.binary()), "least": pa.array([float((x @ centre).min())])})
        give_back()

    return run


PAIRED = "g string, i long, j long, part int, n long"


def _settle(threshold: float):
    """Units (g, part, own, b, n, d, centre, least): for own blocks, the weight of the others that are all within the threshold, and as pairs (i, j, part) those that only products can tell."""
    limit = math.acos(threshold)

    def run(batches):
        for unit in _units(batches, 2):
            unit = unit.combine_chunks()
            own, names, weight = unit["own"].to_numpy(zero_copy_only=False), unit["b"].to_numpy(), unit["n"].to_numpy()
            centres = np.frombuffer(b"".join(unit["centre"].to_pylist()), np.float64).reshape(len(names), -1)
            radius = np.arccos(np.clip(unit["least"].to_numpy(), -1, 1))
            g = unit["g"][0].as_py()
            for i in np.flatnonzero(own).tolist():
                angle = np.arccos(np.clip(centres @ centres[i], -1, 1))
                inside = angle + radius + radius[i] <= limit - 1e-7
                inside[i] = False
                ask = names[(~inside) & (angle - radius - radius[i] <= limit + 1e-7) & (names > names[i])]
                size = 1 + len(ask)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([g] * size), pa.array(np.full(size, names[i])), pa.array([None, *ask.tolist()], pa.int64()), pa.array(np.concatenate([[0], np.arange(len(ask)) // PARTNERS]).astype(np.int32)), pa.array(np.concatenate([[weight[inside].sum()], np.zeros(len(ask), np.int64)]).astype(np.int64))],
                    names=["g", "i", "j", "part", "n"],
                )

    return run


def _count_open(threshold: float):
    """Units (g, i, part, role, id, d, vec, w): links between block i, role 0, which comes first and is held, and the members of its partners, a batch at a time."""

    def run(batches):
        key, ids, x, weight, total = None, None, None, None, None

        def counted():
            return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total)], names=["id", "n"])

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True))
            cuts = [0, *(k for k in range(1, len(keys)) if keys[k] != keys[k - 1]), len(keys)]
            for low, high in zip(cuts, cuts[1:], strict=False):
                *unit, role = keys[low]
                part = batch.slice(low, high - low)
                d, own, w = part.column(5)[0].as_py(), np.asarray(part.column(4)), np.asarray(part.column(7))
                y = _matrix(part.column(6), d)
                if unit != key:
                    if key is not None:
                        yield counted()
                    key, ids, x, weight, total = unit, own[:0], y[:0], w[:0], np.zeros(0, np.int64)
                if role == 0:
                    ids, x, weight, total = np.concatenate([ids, own]), np.concatenate([x, y]), np.concatenate([weight, w]), np.concatenate([total, np.zeros(len(own), np.int64)])
                    continue
                linked = x @ y.T >= threshold
                total += linked @ w
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(weight @ linked)], names=["id", "n"])
        if key is not None:
            yield counted()
        give_back()

    return run


def _link_counts(vectors: DataFrame, roots: DataFrame, threshold: float, stages: Stages) -> DataFrame:
    """(id, n): links of every vector within its component, copies counted by their weight.

    Components of more than BLOCK vectors are dealt to blocks by hyperplanes through their first vector, so that blocks
    lie close together; a code with more than BLOCK of them is split further by a hash.
    """
    spark = vectors.sparkSession
    parts = shuffle_partitions(spark)
    # The component's first vector is one of its members: no search for a centre.
    large = roots.groupBy("component").agg(F.count("*").alias("size")).filter(F.col("size") > BLOCK).join(vectors.select(F.col("id").alias("component"), F.col("vec").alias("ref")), "component")
    large = large.select(F.col("component").cast("string").alias("g"), "size", F.ceil(F.col("size") / BLOCK).cast("int").alias("k"), "ref")
    total = roots.count()
    named = keyed_join(roots.select(F.col("node").alias("id"), F.col("component").cast("string").alias("g")), large, ["g"], "size", total, F.col("id"))
    member = vectors.join(named, "id").select("g", "id", "d", "vec", "w", F.coalesce("k", F.lit(1)).alias("k"), "ref")
    coded, coded_path = stage_table(member.mapInArrow(_codes, "g string, id long, d int, vec binary, w long, code long"), "nn-coded")
    full = coded.groupBy("g", "code").agg(F.count("*").alias("size")).filter(F.col("size") > BLOCK).select("g", "code", "size", F.ceil(F.col("size") / BLOCK).cast("int").alias("k"))
    block = F.shiftleft("code", 24) + F.pmod(F.xxhash64("id"), F.coalesce("k", F.lit(1)))
    dealt = stages.keep(keyed_join(coded, full, ["g", "code"], "size", total, F.col("id")).select("g", block.alias("b"), "id", "d", "vec", "w"), "nn-members")
    delete_path(spark, coded_path)
    direct = stages.keep(dealt.repartition(parts, "g", "b").sortWithinPartitions("g", "b").mapInArrow(_count_direct(threshold), COUNT), "nn-direct")
    counts = direct.filter("g is null").select("id", "n")
    blocks = direct.filter("g is not null").select("g", "b", "n", "d", "centre", "least")
    several = blocks.groupBy("g").agg(F.ceil(F.count("*") / CENTRES).cast("int").alias("k"), F.count("*").alias("c")).filter("c > 1").select("g", "k")
    shown = blocks.join(several, "g").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("k") - 1))).select("g", "part", (F.pmod(F.xxhash64("b"), F.col("k")) == F.col("part")).alias("own"), "b", "n", "d", "centre", "least")
    pairs = stages.keep(shown.repartition(parts, "g", "part").sortWithinPartitions("g", "part", "b").mapInArrow(_settle(threshold), PAIRED), "nn-pairs")
    settled = dealt.select("g", F.col("b").alias("i"), "id").join(pairs.filter("j is null and n > 0").select("g", "i", "n"), ["g", "i"]).select("id", "n")
    open_ = pairs.filter("j is not null")
    columns = ["g", "i", "part", "role", "id", "d", "vec", "w"]
    first = open_.select("g", "i", "part", F.lit(0).alias("role")).distinct().join(dealt.withColumnRenamed("b", "i"), ["g", "i"]).select(columns)
    other = open_.select("g", "i", "part", F.lit(1).alias("role"), F.col("j").alias("b")).join(dealt, ["g", "b"]).select(columns)
    across = first.union(other).repartition(parts, "g", "i", "part").sortWithinPartitions("g", "i", "part", "role").mapInArrow(_count_open(threshold), "id long, n long")
    return counts.union(settled).union(across).groupBy("id").agg(F.sum("n").alias("n"))


def _audit(vectors: DataFrame, counts: DataFrame, threshold: float) -> float:
    """The smaller of two mean recalls, of vectors with up to K true links and of those with more, 1 where there are none.

    Vectors are drawn from those with no link found, up to K and more (SPARSE, SPARSE, AUDIT), each standing for its share of
    these, and compared with all rows. No more than these reach the driver.
    """
    found = F.coalesce("n", F.lit(0))
    layer = F.when(found == 0, 0).when(found <= K, 1).otherwise(2)
    marked, path = stage_table(vectors.select("id").join(counts, "id", "left").select("id", found.alias("found"), layer.alias("layer")), "nn-audit")
    sizes = {r["layer"]: r["count"] for r in marked.groupBy("layer").count().collect()}
    seen: dict[int, tuple[int, float]] = {}
    for k, most in enumerate((SPARSE, SPARSE, AUDIT)):
        chosen = marked.filter(F.col("layer") == k).orderBy(F.xxhash64(F.lit(5), "id"), "id").limit(most).select("id", "found").collect()
        seen |= {r["id"]: (r["found"], sizes[k] / len(chosen)) for r in chosen}
    sample: dict[int, tuple[list, list]] = {}
    for r in vectors.filter(F.col("id").isin(list(seen))).select("id", "d", "vec").collect():
        ids, units = sample.setdefault(r["d"], ([], []))
        ids.append(r["id"])
        units.append(bytes(r["vec"]))
    delete_path(vectors.sparkSession, path)
    queries = {d: (np.array(ids), _matrix(pa.array(units, pa.binary()), d)) for d, (ids, units) in sample.items()}

    def run(batches):
        totals = {d: np.zeros(len(ids), np.int64) for d, (ids, _) in queries.items()}
        for batch in batches:
            dims = np.asarray(batch.column(0))
            for d in np.unique(dims).tolist():
                if d in queries:
                    rows = batch.filter(pa.array(dims == d))
                    x, w = _matrix(rows.column(1), d), np.asarray(rows.column(2))
                    for i in range(0, len(x), 1024):
                        totals[d] += w[i : i + 1024] @ (x[i : i + 1024] @ queries[d][1].T >= threshold)
        for d, n in totals.items():
            yield pa.RecordBatch.from_arrays([pa.array(queries[d][0]), pa.array(n)], names=["id", "n"])

    weight = F.col("w") if "w" in vectors.columns else F.lit(1).cast("long")
    true = vectors.select("d", "vec", weight.alias("w")).mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    total, reached = [0.0, 0.0], [0.0, 0.0]
    for r in true:
        # A vector meets itself among all rows, and its copies are links found at the start.
        n, (got, weight) = r["n"] - 1, seen[r["id"]]
        if n > 0:
            total[n > K] += weight
            reached[n > K] += weight * min(1.0, got / n)
    return min((b / a for a, b in zip(total, reached, strict=True) if a), default=1.0)


def _compare_sides(threshold: float):
    """Units (d, i, j, b, id, vec) of the blocks i and j: stars (a, b) of all their pairs at the threshold."""

    def run(batches):
        for unit in _units(batches, 3):
            unit = unit.combine_chunks()
            ids, blocks, d = unit["id"].to_numpy(), unit["b"].to_numpy(), unit["d"][0].as_py()
            i, j = unit["i"][0].as_py(), unit["j"][0].as_py()
            x = _matrix(unit["vec"].combine_chunks(), d)
            left, right = np.flatnonzero(blocks == i), np.flatnonzero(blocks == j)
            held_a, held_b = [], []
            for k in range(0, len(left), 512):
                rows = left[k : k + 512]
                a, b = np.nonzero(x[rows] @ x[right].T >= threshold)
                a, b = ids[rows[a]], ids[right[b]]
                off = a != b
                if off.any():
                    nodes, roots = _local_roots(a[off], b[off])
                    held_a.append(nodes[nodes != roots])
                    held_b.append(roots[nodes != roots])
            if held_a:
                nodes, roots = _local_roots(np.concatenate(held_a), np.concatenate(held_b))
                yield pa.RecordBatch.from_arrays([pa.array(nodes[nodes != roots]), pa.array(roots[nodes != roots])], names=["a", "b"])

    return run


def _all_links(vectors: DataFrame, n: int, threshold: float) -> DataFrame:
    """(a, b): stars of the links of all pairs. Every two blocks of a hash, of SIDE rows or so, meet in one unit."""
    parts = shuffle_partitions(vectors.sparkSession)
    k = max(1, math.ceil(n / SIDE))
    own = vectors.withColumn("b", F.pmod(F.xxhash64("id"), F.lit(k)).cast("int"))
    met = own.withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(k - 1)))).select("d", F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"), "b", "id", "vec")
    links, _ = stage_table(met.repartition(parts, "d", "i", "j").sortWithinPartitions("d", "i", "j").mapInArrow(_compare_sides(threshold), "a long, b long"), "nn-exact")
    return links


@bounded_batches
def near_duplicates(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """(vec_id, n_links, component_id, kept), a row a row of ``df``.

    Vectors of one length link at a cosine of at least ``threshold``, in doubles. Vectors that are null, empty or zero or hold
    null or non-finite components, and rows with a null id, have no links; a null id has a null component and is not
    kept. Rows that repeat an id count as one vector, the first by its bytes.
    """
    spark = df.sparkSession
    raw = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    every, _ = stage_table(raw.mapInArrow(_packed, "id long, d int, vec binary"), "nn-vectors")
    rows = every.select("id")
    once = every.filter("id is not null and vec is not null").groupBy("id").agg(F.min(F.struct("d", "vec")).alias("x"))
    usable, _ = stage_table(once.select("id", "x.d", "x.vec", F.xxhash64("x.vec").cast("string").alias("h")), "nn-usable")
    vectors, _ = stage_table(usable.groupBy("d", "vec").agg(F.min("id").alias("id"), F.count("*").alias("w")).select("id", "d", "vec", "w"), "nn-unit")
    # Copies point at the first of them.
    copied = vectors.filter("w > 1").select(F.xxhash64("vec").cast("string").alias("h"), "vec", "w", F.col("id").alias("first"))
    owner, _ = stage_table(keyed_join(usable.select("id", "h", "vec"), copied, ["h", "vec"], "w", usable.count(), F.col("id")).select("id", F.coalesce("first", "id").alias("first")), "nn-owner")
    n = vectors.count()
    lists, counts, roots = None, None, None
    # The tables of a round go when the next one's lists are written; links found so far go on as components.
    before = Stages()
    for turn in range(ROUNDS):
        if n < 2:
            break
        stages = Stages()
        seen = stages.keep(_tree_round(vectors, n, turn, threshold), "nn-leaves")
        lists, met = _refine(seen.filter(F.col("kind") == LIST).select("u", "v", "s"), lists, vectors, threshold, stages)
        links = seen.filter(F.col("kind") == LINK).select(F.col("u").alias("a"), F.col("v").alias("b"))
        links = links if met is None else links.union(met)
        if roots is not None:
            links = links.union(roots.filter("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b")))
        roots, _ = stage_table(components(links, "nn-cc"), "nn-roots")
        counts, _ = stage_table(_link_counts(vectors, roots, threshold, stages), "nn-counts")
        before.drop()
        before = stages
        if _audit(vectors, counts, threshold) >= RECALL:
            break
    else:
        roots, _ = stage_table(components(_all_links(vectors, n, threshold), "nn-cc"), "nn-roots")
        counts, _ = stage_table(_link_counts(vectors, roots, threshold, before), "nn-counts")
    before.drop()
    known = vectors.select("id", (F.col("w") - 1).alias("copies"))
    if counts is not None:
        known = known.join(counts, "id", "left").join(roots.select(F.col("node").alias("id"), "component"), "id", "left").select("id", F.coalesce("n", "copies").alias("n"), F.coalesce("component", "id").alias("component"))
    else:
        known = known.select("id", F.col("copies").alias("n"), F.col("id").alias("component"))
    # A first vector has many copies only where these are exact: its row is joined by the same rule as above.
    weights = vectors.select(F.col("id").alias("first"), "w")
    of = known.withColumnRenamed("id", "first").join(weights, "first").select(F.col("first").cast("string").alias("first"), "n", "component", "w")
    told = keyed_join(owner.select(F.col("first").cast("string").alias("first"), "id"), of, ["first"], "w", owner.count(), F.col("id")).select("id", "n", "component")
    out = rows.join(told, "id", "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias("vec_id"), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))


def op7_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings at a cosine of 0.9."""
    return near_duplicates(table(spark, sf_dir, "embeddings"))
