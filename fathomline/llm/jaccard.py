"""N-gram Jaccard join by a token-group matrix.

Documents are shingle sets. Similar documents are put into groups, each group's token union is stored, and a query opens
a group only where its overlap with the union can reach the threshold.

1. Grouping. Sets, without the tokens of very many documents, are cut into token ranges: a pair at the threshold differs in
   at most S tokens, so of more than S filled ranges one is equal in both. Documents with an equal range (of one size
   class) are chained, within a task and then across tasks, a document and its chain's first at a time; the chains' components
   are the groups. Every pair that links lies in one group; a passage that many documents share makes none.
2. Small groups are opened by one unit of work each: overlaps of all members at once from the group's token matrix.
3. Large groups are dealt to blocks by a hash. Block unions show which tokens of a document nobody else in the group
   has; documents that cannot reach the threshold without these leave. Each block is joined in itself, then
   with a few pivots of the group, so that copies fall into one component at the cost of one pass. Only documents outside
   the group's largest component are queries against the other blocks, and only blocks whose union bound allows it are opened:
   links inside a component are never looked for again.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Stages, _local_roots, bounded_batches, components, delete_path, documents_of, give_back, shuffle_partitions, slices, stage_table, table
from .shingles import C, mix, shingle_sets

WORDS, PERCENT = 4, 85
#: Ratio of the size classes' bounds.
RATIO = 1.3
#: Members of a unit of work, and pivots of a large group.
UNIT, PIVOTS = 256, 8
#: Tokens of at most so many members of a unit are counted pair by pair.
FEW = 24
#: A token is hot in more than so many documents; at most so many are; tokens counted at once in a task.
LEAST_HOT, MOST_HOT, COUNTED = 40, 1_000_000, 2_000_000
#: Signatures sorted at once in a task.
HELD = 700_000
#: Tokens of a block or of its queries in one unit, and pairs of members counted at once.
WEIGHT, AT_ONCE = 1_000_000, 2_000_000
_R1, _R2, _S32 = np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9), np.uint64(32)


@functools.lru_cache(maxsize=8)
def _classes(percent: int, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    top, differ, ranges = [], [], []
    for _ in range(count):
        low = top[-1] + 1 if top else 1
        top.append(max(low, int((top[-1] if top else 1) * RATIO)))
        s = (100 - percent) * top[-1] // percent
        m = s + 1
        # The smallest set of the class should fill more than s ranges with two deviations to spare.
        while s and m < 3 * s + 3:
            mean = low / m
            empty = m * math.exp(-mean)
            if m - empty - 2 * math.sqrt(max(0.0, empty * (1 - (1 + mean) * math.exp(-mean)))) > s:
                break
            m += max(1, s // 100)
        differ.append(s)
        ranges.append(m)
    return np.array(top, np.int64), np.array(differ, np.int64), np.array(ranges, np.int64)


def size_classes(percent: int, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(upper size, most tokens in which a linked pair differs, ranges) of each class up to a size of ``most``."""
    count = 16
    while _classes(percent, count)[0][-1] < most:
        count *= 2
    return _classes(percent, count)


def _ranges(hashes: np.ndarray, bounds: np.ndarray, wanted: np.ndarray, spread: np.ndarray, tag: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number in ``wanted``, signature) of each filled range, and the filled ranges of each wanted set."""
    n = bounds[wanted + 1] - bounds[wanted]
    place = np.repeat(bounds[wanted] - (np.cumsum(n) - n), n) + np.arange(n.sum())
    who = np.repeat(np.arange(len(wanted)), n)
    token = hashes[place]
    part = (token >> _S32) * spread[who] >> _S32
    new = np.flatnonzero((np.diff(part.astype(np.int64), prepend=-1) != 0) | (np.diff(who, prepend=-1) != 0))
    total = np.add.reduceat(mix(token + C), new) if len(new) else np.zeros(0, np.uint64)
    who = who[new]
    return who, mix(total + part[new] * _R1 + tag[who] * _R2), np.bincount(who, minlength=len(wanted))


def signatures(hashes: np.ndarray, bounds: np.ndarray, percent: int, hot: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(set number, signature) such that two sets that link share one, by the argument of the module's head.

    A set signs for its own size class and for the lower ones that hold possible partners. Tokens in ``hot``, a sorted array, are
    left out first: any pair differs in no more of the others. A set that fills too few ranges with the others
    signs with all its tokens too, and one that still does with each token of its prefix in hash order: of a linked
    pair either one set fills enough ranges, or both sign in the next way.
    """
    sizes = np.diff(bounds)
    full = np.flatnonzero(sizes)
    if not len(full):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    top, differ, ranges = size_classes(percent, int(sizes.max()))
    own = np.searchsorted(top, sizes)
    rare, rare_bounds = hashes, bounds
    if hot is not None and len(hot):
        at = np.searchsorted(hot, hashes)
        at[at == len(hot)] = 0
        keep = hot[at] != hashes
        rare, rare_bounds = hashes[keep], np.concatenate([[0], np.cumsum(keep)])[bounds]
    owners, signs = [], []
    for down in range(64):
        wanted = full[own[full] >= down]
        # A partner in the class has at least percent / 100 of this set's size.
        wanted = wanted[top[own[wanted] - down] * 100 >= percent * sizes[wanted]] if down else wanted
        if not len(wanted):
            break
        kind = own[wanted] - down
        tag = (kind + 1).astype(np.uint64)
        who, sign, filled = _ranges(rare, rare_bounds, wanted, ranges[kind].astype(np.uint64), tag)
        owners.append(wanted[who])
        signs.append(sign)
        few = filled <= differ[kind]
        wanted, kind, tag = wanted[few], kind[few], tag[few]
        if rare is not hashes:
            who, sign, filled = _ranges(hashes, bounds, wanted, ranges[kind].astype(np.uint64), tag + np.uint64(1 << 20))
            owners.append(wanted[who])
            signs.append(sign)
            few = filled <= differ[kind]
            wanted, tag = wanted[few], tag[few]
        for k, t in zip(wanted.tolist(), tag, strict=True):
            a, b = bounds[k], bounds[k + 1]
            prefix = (b - a) - -(-percent * (b - a) // 100) + 1
            signs.append(mix(hashes[a : a + prefix] + np.array([t], np.uint64) * C))
            owners.append(np.full(prefix, k))
    return np.concatenate(owners), np.concatenate(signs)


def _chain(ids: np.ndarray, signs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(member, first) of every signature that several ids have, and the places of one id for each signature."""
    order = np.lexsort((ids, signs))
    s, d = signs[order], ids[order]
    new = np.concatenate([[True], s[1:] != s[:-1]]) if len(s) else np.zeros(0, bool)
    heads = np.flatnonzero(new)
    first = np.repeat(d[heads], np.diff(np.append(heads, len(s))))
    other = np.flatnonzero(d != first)
    pairs = np.unique(np.stack([d[other], first[other]], axis=1), axis=0) if len(other) else np.zeros((0, 2), np.int64)
    return pairs[:, 0], pairs[:, 1], order[heads]


DOC, CHAIN, SAME, NAMELESS = 0, 1, 2, 3


def _sketch(percent: int, buckets: int, read, hot):
    """Sets, read from batches by ``read``, to packed rows (p, kind, a, b): sizes of documents, chains and equal sets of this task, and one id a signature and task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        prints: dict[tuple[int, int], int] = {}
        turn = 0

        def rows(kind: int, a: np.ndarray, b: np.ndarray, p: int | None = None):
            nonlocal turn
            turn += 1
            return (int(mix(np.array([turn * 7919 + kind + (int(a[0]) & 0xFFFFFF)], np.uint64))[0] % np.uint64(buckets)) if p is None else p, kind, a.tobytes(), b.tobytes())

        def packed(found):
            return pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int32()), pa.array([f[1] for f in found], pa.int32()), pa.array([f[2] for f in found], pa.binary()), pa.array([f[3] for f in found], pa.binary())], names=["p", "kind", "a", "b"])

        def flush():
            ids, signs = (np.concatenate(x) for x in zip(*held, strict=True))
            member, first, heads = _chain(ids, signs)
            out = [rows(CHAIN, member, first)] if len(member) else []
            ids, signs = ids[heads], signs[heads]
            bucket = (signs >> np.uint64(40)) % np.uint64(buckets)
            order = np.lexsort((ids, bucket))
            ids, signs, bucket = ids[order], signs[order], bucket[order].astype(np.int64)
            ends = np.searchsorted(bucket, np.arange(buckets + 1))
            out += [(p, -1, ids[a:b].tobytes(), signs[a:b].tobytes()) for p, (a, b) in enumerate(zip(ends, ends[1:], strict=False)) if b > a]
            for i in range(0, len(out), 512):
                yield packed(out[i : i + 512])

        count = 0
        for batch in batches:
            for ids, named, hashes, bounds in read(batch):
                sizes = np.diff(bounds)
                out = [rows(kind, ids[some], sizes[some]) for kind, some in ((DOC, named), (NAMELESS, ~named)) if some.any()]
                # Equal sets of this task: all but one leave.
                usable = np.flatnonzero((sizes > 0) & named)
                same, keep = [], []
                sums = np.zeros(len(sizes), np.uint64)
                if len(usable):
                    sums[usable] = np.add.reduceat(mix(hashes + _R1), bounds[usable]) if len(hashes) else 0
                for i in usable.tolist():
                    first = prints.setdefault((int(sums[i]), int(sizes[i])), int(ids[i]))
                    if first == ids[i]:
                        keep.append(i)
                    else:
                        same.append((int(ids[i]), first))
                if len(prints) > 1_000_000:
                    prints.clear()
                if same:
                    pair = np.array(same, np.int64)
                    out.append(rows(SAME, np.ascontiguousarray(pair[:, 0]), np.ascontiguousarray(pair[:, 1])))
                yield packed(out)
                if keep:
                    n = sizes[keep]
                    place = np.repeat(bounds[keep] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                    who, signs = signatures(hashes[place], np.concatenate([[0], np.cumsum(n)]), percent, hot.value[0])
                    held.append((ids[keep][who], signs))
                    count += len(signs)
                    if count > HELD:
                        yield from flush()
                        held, count = [], 0
        if held:
            yield from flush()
        held.clear()
        give_back()

    return run


def _from_texts(words: int):
    """Reader of (doc_id, text): ids, which of them are not null, and the sets."""

    def read(batch):
        for part in slices(batch):
            ids = part.column(0)
            yield np.asarray(pc.fill_null(ids, 0)), np.asarray(pc.is_valid(ids)), *shingle_sets(part.column(1).to_pylist(), words)

    return read


def _from_sets(batch):
    """Reader of (doc_id, tokens)."""
    for i in range(0, batch.num_rows, 512):
        part = batch.slice(i, 512)
        yield part.column(0).to_numpy(), np.ones(part.num_rows, bool), *_unpack(part.column(1))


def _links(kind: int, a: np.ndarray, b: np.ndarray) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(a), 50_000):
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(a[i : i + 50_000]), kind, np.int32)), pa.array(a[i : i + 50_000]), pa.array(b[i : i + 50_000])], names=["kind", "a", "b"])


def _match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chains across tasks of one partition's signatures; other rows are unpacked."""
    ids, signs = [], []
    for batch in batches:
        for kind, a, b in zip(batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
            left = np.frombuffer(a.as_buffer(), np.int64)
            if kind >= 0:
                yield from _links(kind, left, np.frombuffer(b.as_buffer(), np.int64))
            else:
                ids.append(left.copy())
                signs.append(np.frombuffer(b.as_buffer(), np.uint64).copy())
    if ids:
        member, first, _ = _chain(np.concatenate(ids), np.concatenate(signs))
        ids.clear()
        signs.clear()
        yield from _links(CHAIN, member, first)
    give_back()


# ---------------------------------------------------------------- units of work


def reach(size: np.ndarray, partner: np.ndarray, percent: int) -> np.ndarray:
    """The least overlap with which sets of these sizes link."""
    return -(-percent * (size + partner) // (100 + percent))


class Unit:
    """Sets of one group or block, with their token matrix."""

    def __init__(self, ids: np.ndarray, hashes: np.ndarray, bounds: np.ndarray, percent: int):
        self.ids, self.percent = ids, percent
        self.sizes = np.diff(bounds)
        self.owner = np.repeat(np.arange(len(ids)), self.sizes)
        self.tokens, self.column, counts = np.unique(hashes, return_inverse=True, return_counts=True)
        self.shared = counts > 1

    def overlaps(self, rows: np.ndarray, others: np.ndarray) -> np.ndarray:
        """Intersection sizes of chosen members. Tokens that few members have are counted pair by pair, others by products of some columns of the matrix at a time."""
        row_of, other_of = np.full(len(self.ids), -1), np.full(len(self.ids), -1)
        row_of[rows], other_of[others] = np.arange(len(rows)), np.arange(len(others))
        use = self.shared[self.column] & ((row_of >= 0) | (other_of >= 0))[self.owner]
        owner, place = self.owner[use], self.column[use]
        order = np.argsort(place, kind="stable")
        owner, place = owner[order], place[order]
        heads = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]])) if len(place) else np.zeros(0, np.int64)
        counts = np.diff(np.append(heads, len(place)))
        flat = np.zeros(len(rows) * len(others), np.int64)
        for c in range(2, FEW + 1):
            start = heads[counts == c]
            # Some millions of pairs at once, whatever c is.
            some = max(1, AT_ONCE // (c * c))
            for k in range(0, len(start), some):
                members = owner[start[k : k + some, None] + np.arange(c)]
                left, right = row_of[members][:, :, None], other_of[members][:, None, :]
                at = (left * len(others) + right)[(left >= 0) & (right >= 0)]
                if len(at) > len(flat) // 8:
                    flat += np.bincount(at, minlength=len(flat))
                elif len(at):
                    np.add.at(flat, at, 1)
        out = flat.reshape(len(rows), len(others))
        start, size = heads[counts > FEW], counts[counts > FEW]
        for k in range(0, len(start), 4096):
            n = size[k : k + 4096]
            o = owner[np.repeat(start[k : k + 4096] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            p = np.repeat(np.arange(len(n)), n)
            left = np.zeros((len(rows), len(n)), np.float32)
            mine = row_of[o] >= 0
            left[row_of[o[mine]], p[mine]] = 1
            right = left
            if rows is not others:
                right = np.zeros((len(others), len(n)), np.float32)
                theirs = other_of[o] >= 0
                right[other_of[o[theirs]], p[theirs]] = 1
            out += (left @ right.T).astype(np.int64)
        return out

    def links(self, queries: np.ndarray | None = None, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Linked pairs as member numbers. With flags ``queries`` and ``own`` only pairs of a query and a member of its own group.

        Before a query opens the group its overlap with the union of the others is compared with what the smallest possible partner asks for.
        """
        none = np.zeros(0, np.int64), np.zeros(0, np.int64)
        n = len(self.ids)
        if n < 2 or not (self.sizes > 0).any():
            return none
        with_others = np.bincount(self.owner, weights=self.shared[self.column], minlength=n).astype(np.int64)
        least = np.maximum(-(-self.percent * self.sizes // 100), int(self.sizes[self.sizes > 0].min()))
        opens = (self.sizes > 0) & (with_others >= reach(self.sizes, least, self.percent))
        others = np.flatnonzero(opens if own is None else opens & own)
        rows = others if queries is None else np.flatnonzero(opens & queries)
        if not len(rows) or not len(others):
            return none
        found_a, found_b = [], []
        for k in range(0, len(rows), 1024):
            part = others if queries is None and len(rows) <= 1024 else rows[k : k + 1024]
            common = self.overlaps(part, others)
            a, b = np.nonzero((100 + self.percent) * common >= self.percent * (self.sizes[part][:, None] + self.sizes[others][None, :]))
            a, b = part[a], others[b]
            found_a.append(a[a != b])
            found_b.append(b[a != b])
        return np.concatenate(found_a), np.concatenate(found_b)


def _units(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Runs of rows with equal first ``keys`` columns, of rows sorted by them."""
    held: list[pa.RecordBatch] = []
    current = None
    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.stack([np.asarray(batch.column(i)) for i in range(keys)], axis=1)
        cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            this = tuple(key[a])
            if held and this != current:
                yield pa.Table.from_batches(held)
                held = []
            current = this
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def _unpack(column) -> tuple[np.ndarray, np.ndarray]:
    sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in column]
    return np.concatenate(sets) if sets else np.zeros(0, np.uint64), np.concatenate([[0], np.cumsum([len(x) for x in sets])]).astype(np.int64)


def _edges(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _stars(ids: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The components of links between member numbers, as edges to each one's smallest id."""
    if not len(a):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    nodes, roots = _local_roots(ids[a], ids[b])
    return nodes[nodes != roots], roots[nodes != roots]


def _join_small(words: int, percent: int):
    """Units of (g, doc_id, text): all links of each group, as stars."""

    def run(batches):
        for unit in _units(batches, 1):
            if unit.num_rows < 2:
                continue
            unit = unit.combine_chunks()
            ids = unit["doc_id"].to_numpy()
            hashes, bounds = shingle_sets(unit["text"].to_pylist(), words)
            a, b = _stars(ids, *Unit(ids, hashes, bounds, percent).links())
            if len(a):
                yield _edges(a, b)

    return run


def _pack_sets(words: int):
    def run(batches):
        for batch in batches:
            for part in slices(batch):
                hashes, bounds = shingle_sets(part.column(2).to_pylist(), words)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(np.diff(bounds), pa.int64()), pa.array([hashes[x:y].tobytes() for x, y in zip(bounds, bounds[1:], strict=False)], pa.binary())], names=["g", "doc_id", "n", "tokens"])

    return run


def _block_tokens(batches):
    """Units (g, block, doc_id, k, n, tokens): the block's union dealt to the group's k token ranges, with the owner of tokens that one document alone has here."""
    for unit in _units(batches, 2):
        hashes, bounds = _unpack(unit["tokens"].combine_chunks())
        ids = unit["doc_id"].to_numpy()
        tokens, first, counts = np.unique(hashes, return_index=True, return_counts=True)
        owner = np.repeat(ids, np.diff(bounds))[first] if len(first) else np.zeros(0, np.int64)
        once = counts == 1
        k = unit["k"][0].as_py()
        part = ((tokens >> _S32) * np.uint64(k) >> _S32).astype(np.int64)
        ends = np.searchsorted(part, np.arange(k + 1))
        g = unit["g"][0].as_py()
        found = [(int(x), int(y)) for x, y in zip(ends, ends[1:], strict=False)]
        for i in range(0, k, 256):
            some = [(j, x, y) for j, (x, y) in enumerate(found[i : i + 256], i) if y > x]
            if some:
                yield pa.RecordBatch.from_arrays([pa.array([g] * len(some), pa.int64()), pa.array([s[0] for s in some], pa.int32()), pa.array([tokens[s[1] : s[2]].tobytes() for s in some], pa.binary()), pa.array([owner[s[1] : s[2]].tobytes() for s in some], pa.binary()), pa.array([once[s[1] : s[2]].tobytes() for s in some], pa.binary())], names=["g", "block", "tokens", "owners", "once"])


def _alone(batches):
    """Units (g, range, tokens, owners, once) of all blocks: how many tokens each document has that no other in the group has."""
    for unit in _units(batches, 2):
        tokens = np.concatenate([np.frombuffer(x.as_buffer(), np.uint64) for c in unit["tokens"].chunks for x in c])
        owners = np.concatenate([np.frombuffer(x.as_buffer(), np.int64) for c in unit["owners"].chunks for x in c])
        once = np.concatenate([np.frombuffer(x.as_buffer(), np.bool_) for c in unit["once"].chunks for x in c])
        _, first, counts = np.unique(tokens, return_index=True, return_counts=True)
        first = first[counts == 1]
        ids, n = np.unique(owners[first[once[first]]], return_counts=True)
        if len(ids):
            yield _edges(ids, n.astype(np.int64))


LINKS = "a long, b long, best boolean"


def _join_block(percent: int):
    """Units (g, block, doc_id, tokens, query): links of each block as stars; with queries, only theirs with the block's own. The member with most links comes back as a row that is ``best``."""

    def run(batches):
        for unit in _units(batches, 2):
            unit = unit.combine_chunks()
            ids, asks = unit["doc_id"].to_numpy(), unit["query"].to_numpy(zero_copy_only=False)
            hashes, bounds = _unpack(unit["tokens"].combine_chunks())
            found = Unit(ids, hashes, bounds, percent)
            a, b = found.links(asks, ~asks) if asks.any() else found.links()
            x, y = _stars(ids, a, b)
            if len(x):
                most = ids[np.bincount(a, minlength=len(ids)).argmax()]
                yield pa.RecordBatch.from_arrays([pa.array(np.append(x, most)), pa.array(np.append(y, most)), pa.array(np.append(np.zeros(len(x), bool), True))], names=["a", "b", "best"])

    return run


def _hot_tokens(df: DataFrame, read) -> tuple[np.ndarray, np.ndarray]:
    """Tokens in more than LEAST_HOT documents, sorted, and their counts; where these are more than MOST_HOT, the most frequent ones by classes of their count.

    Each task counts its documents in portions of about COUNTED tokens and reports the tokens that several documents there
    have; signatures hold for any choice of hot tokens, so one that a portion passes over costs time, never a link.
    """

    def report(held):
        tokens, counts = np.unique(np.concatenate(held), return_counts=True)
        often = counts > 1
        return pa.RecordBatch.from_arrays([pa.array(tokens[often].view(np.int64)), pa.array(counts[often])], names=["token", "n"])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for _, _, hashes, _ in read(batch):
                held.append(hashes)
                size += len(hashes)
                if size > COUNTED:
                    yield report(held)
                    held, size = [], 0
        if held:
            yield report(held)
        held.clear()
        give_back()

    counts = df.mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).filter(F.col("n") > LEAST_HOT)
    counted, path = stage_table(counts, "jaccard-counts")
    sizes = counted.groupBy(F.floor(4 * F.log2("n")).cast("int").alias("c")).count().collect()
    least, total = 0, 0
    for row in sorted(sizes, reverse=True):
        total += row["count"]
        if total > MOST_HOT:
            least = row["c"] + 1
            break
    found = counted.filter(F.floor(4 * F.log2("n")) >= least).select("token", "n").toArrow()
    delete_path(df.sparkSession, path)
    tokens = found["token"].to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(tokens)
    return tokens[order], np.minimum(found["n"].to_numpy()[order], 1 << 31).astype(np.uint32)


def _group(df: DataFrame, percent: int, read, hot, label: str, stages: Stages) -> DataFrame:
    """The staged rows (kind, a, b) of ``df`` under the signatures: DOC and NAMELESS sizes, CHAIN and SAME edges. ``hot``: the broadcast hot tokens and their counts."""
    parts = shuffle_partitions(df.sparkSession)
    sketched = df.mapInArrow(_sketch(percent, 8 * parts, read, hot), "p int, kind int, a binary, b binary")
    return stages.keep(sketched.repartition(parts, "p").mapInArrow(_match, "kind int, a long, b long"), label)


def _edges_of(found: DataFrame, kind: int) -> DataFrame:
    return found.filter(F.col("kind") == kind).select("a", "b")


def _sizes(df: DataFrame) -> DataFrame:
    """Blocks k of each group, and its smallest set."""
    return df.groupBy("g").agg(F.ceil(F.greatest(F.count("*") / UNIT, F.sum("n") / WEIGHT)).cast("int").alias("k"), F.min("n").alias("least"))


def _blocks(df: DataFrame, sizes: DataFrame) -> DataFrame:
    """``df`` with the block of each document among its group's k."""
    return df.join(sizes, "g").withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("k")).cast("int"))


def _run(df: DataFrame, fn, schema: str, *columns: str) -> DataFrame:
    return df.select("g", "block", *columns).repartition(shuffle_partitions(df.sparkSession), "g", "block").sortWithinPartitions("g", "block").mapInArrow(fn, schema)


def _prune(sets: DataFrame, percent: int, stages: Stages) -> DataFrame:
    """Without the documents whose tokens that somebody else in the group has are too few for any link."""
    held = _blocks(sets, _sizes(sets))
    tokens = _run(held, _block_tokens, "g long, block int, tokens binary, owners binary, once binary", "doc_id", "k", "n", "tokens")
    alone = _run(tokens, _alone, "a long, b long", "tokens", "owners", "once").groupBy("a").agg(F.sum("b").alias("alone"))
    known = held.join(alone.withColumnRenamed("a", "doc_id"), "doc_id", "left")
    partner = F.greatest("least", F.ceil(F.col("n") * percent / 100))
    able = known.filter((F.col("n") - F.coalesce("alone", F.lit(0))) * (100 + percent) >= percent * (F.col("n") + partner)).select("g", "doc_id", "n", "tokens")
    return stages.keep(able, "jaccard-able")


def _is_large(members: DataFrame) -> DataFrame:
    """(g, large) of the groups that one unit of work should not take; ``members`` has g and n."""
    weight = members.groupBy("g").agg(F.count("*").alias("members"), F.sum("n").alias("weight"))
    return weight.filter((F.col("members") > UNIT) | (F.col("weight") > 2 * WEIGHT)).select("g", F.lit(True).alias("large"))


def _large(sets: DataFrame, percent: int, hot, stages: Stages) -> list[DataFrame]:
    """Links (a, b) of large groups; ``sets`` has g, doc_id, n, tokens.

    Documents that cannot link leave, and those that stay are grouped again: chains that ran over the others break. Groups
    that are small then are opened whole; those that stay large go on to their blocks.
    """
    able = _prune(sets, percent, stages)
    found = _group(able.select("doc_id", "tokens"), percent, _from_sets, hot, "jaccard-regrouped", stages)
    groups = components(_edges_of(found, CHAIN), "jaccard-regroup").select(F.col("node").alias("doc_id"), F.col("component").alias("g"))
    grouped = able.drop("g").join(groups, "doc_id")
    members = stages.keep(grouped.join(_is_large(grouped.select("g", "n")), "g", "left").select("g", "doc_id", "n", "tokens", F.coalesce("large", F.lit(False)).alias("large")), "jaccard-members")
    small = members.filter("not large").select("g", F.lit(0).alias("block"), "doc_id", "tokens", F.lit(False).alias("query"))
    out = [_edges_of(found, SAME), _run(small, _join_block(percent), LINKS, "doc_id", "tokens", "query").filter("not best").select("a", "b")]
    left = members.filter("large").drop("large")
    return out if left.isEmpty() else out + _opened(left, percent, hot, stages)


def _rarest(percent: int, hot, key: str):
    """(g, key, token) of the rarest tokens of each set of (g, key, tokens): two sets that link share one of them.

    A set of n tokens shares with any partner all but n - ceil(percent * n / 100) of them at most, and the same order, by the
    count of hot tokens and then by hash, holds for all sets.
    """

    def run(batches):
        tokens_hot, counts_hot = hot.value
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                hashes, bounds = _unpack(part.column(2))
                cost = np.zeros(len(hashes), np.uint32)
                if len(tokens_hot):
                    at = np.searchsorted(tokens_hot, hashes)
                    at[at == len(tokens_hot)] = 0
                    cost = np.where(tokens_hot[at] == hashes, counts_hot[at], 0)
                sizes = np.diff(bounds)
                owner = np.repeat(np.arange(len(sizes)), sizes)
                order = np.lexsort((hashes, cost, owner))
                rank = np.arange(len(hashes)) - bounds[owner]
                take = order[rank < (sizes - -(-percent * sizes // 100) + 1)[owner]]
                who = pa.array(owner[take])
                yield pa.RecordBatch.from_arrays([part.column(0).take(who), part.column(1).take(who), pa.array(hashes[take].view(np.int64))], names=["g", key, "token"])

    return run


def _opened(sets: DataFrame, percent: int, hot, stages: Stages) -> list[DataFrame]:
    """Links of large groups by blocks: within each, with pivots, and of the documents outside a group's main component with the blocks that can hold a partner.

    These blocks are found before any set is shipped: a document opens a block only where one of its rarest tokens is
    among the rarest of a member there, which no link can do without. What a token costs is bounded by its own documents in
    the group, so a long chain of overlapping texts opens a few blocks a document. Queries come to a block in parts of bounded weight.
    """
    sizes = _sizes(sets)
    dealt = _blocks(sets, sizes)
    columns = ["g", "block", "part", "doc_id", "tokens", "query"]

    def opened(queries: DataFrame | None, label: str) -> DataFrame:
        """Blocks in themselves, or ``queries`` (g, block, doc_id, n, tokens) with the blocks that they name."""
        if queries is None:
            rows, join = dealt.select("g", "block", F.lit(0).alias("part"), "doc_id", "tokens", F.lit(False).alias("query")), _join_block(percent)
        else:
            parts = queries.groupBy("g", "block").agg(F.ceil(F.greatest(F.count("*") / (4 * UNIT), F.sum("n") / WEIGHT)).cast("int").alias("parts"))
            asking = queries.join(parts, ["g", "block"]).select("g", "block", F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int").alias("part"), "doc_id", "tokens", F.lit(True).alias("query"))
            asked = dealt.join(parts, ["g", "block"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("g", "block", "part", "doc_id", "tokens", F.lit(False).alias("query"))
            rows, join = asking.union(asked), _only_queries(percent)
        unit = rows.select(columns).repartition(shuffle_partitions(sets.sparkSession), "g", "block", "part").sortWithinPartitions("g", "block", "part")
        return stages.keep(unit.mapInArrow(join, LINKS), label)

    first = opened(None, "jaccard-first")
    links = first.filter("not best").select("a", "b")
    # Pivots: the best linked members of some blocks, sent to every block of their group.
    best = first.filter("best").select(F.col("a").alias("doc_id")).distinct().join(sets, "doc_id")
    pivots = best.withColumn("r", F.row_number().over(Window.partitionBy("g").orderBy(F.xxhash64("doc_id")))).filter(F.col("r") <= PIVOTS)
    everywhere = pivots.join(sizes.select("g", "k"), "g").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("k") - 1))).select("g", "block", "doc_id", "n", "tokens")
    second = opened(everywhere, "jaccard-second").filter("not best").select("a", "b")
    roots = components(links.union(second), "jaccard-large")
    labelled = stages.keep(sets.select("g", "doc_id").join(roots.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("g", "doc_id", F.coalesce("component", "doc_id").alias("c")), "jaccard-labels")
    main = labelled.groupBy("g", "c").count().groupBy("g").agg(F.max(F.struct("count", "c")).alias("m")).select("g", F.col("m.c").alias("c"))
    minor = stages.keep(labelled.join(main, ["g", "c"], "left_anti").select("doc_id").join(sets, "doc_id").select("g", "doc_id", "n", "tokens"), "jaccard-minor")
    asked = minor.select("g", "doc_id", "tokens").mapInArrow(_rarest(percent, hot, "doc_id"), "g long, doc_id long, token long")
    held = dealt.select("g", "block", "tokens").mapInArrow(_rarest(percent, hot, "block"), "g long, block int, token long").distinct()
    named = stages.keep(asked.join(held, ["g", "token"]).select("g", "block", "doc_id").distinct(), "jaccard-named")
    third = opened(named.join(minor, ["g", "doc_id"]).select("g", "block", "doc_id", "n", "tokens"), "jaccard-third").filter("not best").select("a", "b")
    return [links, second, third]


def _only_queries(percent: int):
    """As _join_block, for blocks that have queries; others have been joined in themselves."""
    join = _join_block(percent)

    def run(batches):
        for unit in _units(batches, 3):
            if any(unit["query"].to_pylist()):
                yield from join(iter(unit.to_batches()))

    return run


@bounded_batches
def jaccard_components(df: DataFrame, words: int = WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id), a row a row of ``df``.

    Two documents link when 100 * intersection >= percent * union of their sets of distinct ``words``-word shingles;
    component_id is the smallest doc_id reachable by links. Texts that are null or without words have the empty set
    and link with nothing, not even each other; shorter texts are one shingle, very long ones are read whole. Rows with a null id link with nothing
    and have a null component; rows with one id are one node, with the links of all their texts. Other columns are not
    read, so none can clash; an empty table gives no rows. Sets are held as 64-bit hashes.
    """
    stages = Stages()
    parts = shuffle_partitions(df.sparkSession)
    docs = documents_of(df, id_col, text_col)
    read = _from_texts(words)
    hot = df.sparkSession.sparkContext.broadcast(_hot_tokens(docs, read))
    found = _group(docs, percent, read, hot, "jaccard-sketch", Stages())
    rows = found.filter(F.col("kind").isin(DOC, NAMELESS)).select(F.when(F.col("kind") == DOC, F.col("a")).alias("doc_id"), F.col("b").alias("n_shingles"))
    groups = stages.keep(components(_edges_of(found, CHAIN), "jaccard-groups").select(F.col("node").alias("doc_id"), F.col("component").alias("g")), "jaccard-grouped")
    large = _is_large(rows.groupBy("doc_id").agg(F.max("n_shingles").alias("n")).join(groups, "doc_id"))
    # One plan at every size: the texts move once, to their ids, and only members of groups are kept.
    members = stages.keep(docs.join(groups.hint("merge"), "doc_id").dropDuplicates(["doc_id", "text"]).join(large, "g", "left").select("g", "doc_id", "text", F.coalesce("large", F.lit(False)).alias("large")), "jaccard-texts")
    small = members.filter("not large").select("g", "doc_id", "text").repartition(parts, "g").sortWithinPartitions("g").mapInArrow(_join_small(words, percent), "a long, b long")
    links = [_edges_of(found, SAME), small]
    sets = stages.keep(members.filter("large").select("g", "doc_id", "text").mapInArrow(_pack_sets(words), "g long, doc_id long, n long, tokens binary"), "jaccard-sets")
    if not sets.isEmpty():
        links += _large(sets, percent, hot, stages)
    every = links[0]
    for more in links[1:]:
        every = every.union(more)
    # The links are written by the first step of this, after which only the sketch's rows and the components are read.
    roots = components(every, "jaccard-links")
    stages.drop()
    hot.unpersist()
    return rows.join(roots.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents under the 4-word Jaccard join at 0.85."""
    return jaccard_components(table(spark, sf_dir, "documents"))
