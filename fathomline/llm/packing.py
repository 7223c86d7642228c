"""Best-fit packing of token sequences by swap-based local search."""

from __future__ import annotations

import functools
import json
import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytebpe import byte_characters
from .common import map_texts, shuffle_partitions, stage_table, table
from .jaccard import _units

VOCABULARY, CAPACITY, END = "byte_bpe_50k.json", 2048, 0
#: Bins with more free tokens than this are packed again with those of other groups.
SLACK = 16
#: The share of its sequences that a level must save for another to follow.
WORTH = 0.01
#: Pieces of a group, which one unit of work packs, whatever the size of the table.
GROUP = 4096


@functools.lru_cache(maxsize=2)
def coder(path: str):
    """ids of byte-level BPE as the tokenizers file defines them, run by tiktoken's faster merge loop on the same ranks.

    The file's vocabulary, merges and added tokens are read here and must have the plain shape that this relies on;
    a test compares the ids with the tokenizers library on all small tables.
    """
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    value = {c: i for i, c in enumerate(byte_characters())}
    raw = lambda s: bytes(value[c] for c in s)
    vocab = spec["model"]["vocab"]
    for rank, (left, right) in enumerate(spec["model"]["merges"]):
        if vocab[left + right] != 256 + rank:
            raise ValueError("merges and ids are not in the same order")
    if spec["normalizer"] or spec["pre_tokenizer"] != {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}:
        raise ValueError("not a plain byte-level tokenizer")
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={raw(k): v for k, v in vocab.items() if k not in special}, special_tokens=special)
    return lambda text: encoding.encode_to_numpy(text, allowed_special="all")


def cut(length: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: whole, or full pieces after a first one with what is over."""
    first = length % capacity or capacity
    return [(0, min(length, first))] + [(s, capacity) for s in range(first, length, capacity)]


class Bins:
    """Bins of item lengths. Items are numbers of the lengths given; a bin is a list of them."""

    def __init__(self, lengths: list[int], capacity: int):
        self.lengths, self.capacity = lengths, capacity
        self.bins: list[list[int]] = []
        self.free: list[int] = []

    def best_fit(self) -> None:
        """Longest first, each into the fullest bin that takes it; by room, so that a step costs log(capacity)."""
        rooms: list[int] = []  # sorted free sizes that some bin has
        at: dict[int, list[int]] = defaultdict(list)
        for item in sorted(range(len(self.lengths)), key=lambda i: (-self.lengths[i], i)):
            need = self.lengths[item]
            k = bisect_left(rooms, need)
            if k == len(rooms):
                b = len(self.bins)
                self.bins.append([])
                self.free.append(self.capacity)
            else:
                room = rooms[k]
                b = at[room].pop()
                if not at[room]:
                    rooms.pop(k)
            self.bins[b].append(item)
            self.free[b] -= need
            room = self.free[b]
            if room:
                if not at[room]:
                    insort(rooms, room)
                at[room].append(b)

    def improve(self) -> None:
        """Local search on the sum of squared fills over underfull bins.

        Every bin gives in turn, the emptiest first: its items move into another bin (move), or swap with a shorter item there
        (one-for-one) or with two shorter ones (two-for-one), where that raises the sum of squared fills. Of all underfull bins the one
        that is left fullest takes an item. When a bin is empty, a sequence is saved. The search ends when a
        sweep over all givers finds nothing, or no bin can be saved.
        """
        lengths = self.lengths
        under = [b for b in range(len(self.bins)) if self.bins[b] and self.free[b]]
        options = Options(self, under)
        room = sum(self.free[b] for b in under)
        moved = True
        while moved:
            moved = False
            for giver in sorted(under, key=lambda b: (-self.free[b], b)):
                # Another bin is saved only if the free room in all could take a whole one.
                if room < self.capacity:
                    return
                for item in sorted(self.bins[giver], key=lambda i: (-lengths[i], i)):
                    if item not in self.bins[giver]:
                        continue
                    found = options.best(giver, lengths[item])
                    if found:
                        taker, theirs = found
                        self._exchange(giver, [item], taker, theirs)
                        options.renew(giver)
                        options.renew(taker)
                        moved = True
                        if not self.bins[giver]:
                            room -= self.capacity

    def _exchange(self, a: int, from_a: list[int], b: int, from_b: list[int]) -> None:
        gone = sum(self.lengths[i] for i in from_a) - sum(self.lengths[i] for i in from_b)
        self.bins[a] = [i for i in self.bins[a] if i not in from_a] + from_b
        self.bins[b] = [i for i in self.bins[b] if i not in from_b] + from_a
        self.free[a] += gone
        self.free[b] -= gone


class Options:
    """What the underfull bins could give for an item that comes: nothing, one item or two, an entry for each sum in a bin.

    An item of length L fits an entry's place where sum + free >= L, and leaves that bin sum + free - L of room. Entries stand in a heap for each sum + free,
    the bin with the most room first; a number whose bits say which heaps hold any leads from one to the next. So an item looks at the tops of a few heaps, not at all entries.
    """

    def __init__(self, bins: Bins, under: list[int]):
        self.of = bins
        self.heaps: list[list] = [[] for _ in range(bins.capacity + 1)]
        self.some, self.stamp = 0, [0] * len(bins.bins)
        for b in under:
            self.renew(b)

    def renew(self, b: int) -> None:
        """The entries of a bin that has changed; its old ones are known by their stamp and dropped when they are met."""
        self.stamp[b] += 1
        free, lengths = self.of.free[b], self.of.lengths
        if not free or not self.of.bins[b]:
            return
        # One or two items of each length stand for all of that length.
        kept: dict[int, list[int]] = defaultdict(list)
        for i in sorted(self.of.bins[b]):
            if len(kept[lengths[i]]) < 2:
                kept[lengths[i]].append(i)
        items = [i for x in kept.values() for i in x]
        found: dict[int, list[int]] = {0: []} | {lengths[i]: [i] for i in items}
        for k, i in enumerate(items):
            for j in items[k + 1 :]:
                found.setdefault(lengths[i] + lengths[j], [i, j])
        for total, what in found.items():
            heappush(self.heaps[total + free], (-free, b, self.stamp[b], what))
            self.some |= 1 << total + free

    def best(self, giver: int, length: int) -> tuple[int, list[int]] | None:
        """(bin, items that leave it) where an item of the giver fits, the sum of squares rises and the least room is left."""
        limit, rest = self.of.free[giver], self.some >> length
        while rest:
            room = (rest & -rest).bit_length() - 1
            # The taker ends fuller than the giver was: its room stays below the giver's.
            if room >= limit:
                return None
            heap, aside, found = self.heaps[length + room], None, None
            while heap:
                free, b, stamp, what = heap[0]
                if stamp != self.stamp[b]:
                    heappop(heap)
                elif -free <= room:  # what leaves would be as long as what comes, here and below
                    break
                elif b == giver:
                    aside = [*(aside or ()), heappop(heap)]
                else:
                    found = b, what
                    break
            for entry in aside or ():
                heappush(heap, entry)
            if found:
                return found
            if not heap:
                self.some &= ~(1 << length + room)
            rest &= rest - 1
        return None


def pack(lengths: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Bins of item numbers, each with a sum of at most ``capacity``; the fewest that best fit and local search find."""
    bins = Bins(lengths, capacity)
    bins.best_fit()
    bins.improve()
    return [b for b in bins.bins if b]


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = PIECES + ", sequence_id long, offset long"


def pieces(df: DataFrame, path: str, capacity: int = CAPACITY, carry_ids: bool = False) -> DataFrame:
    """One row a piece of every document: its ids, END after them, cut where longer than ``capacity``.

    A null or empty text is END alone; a very long one is encoded whole. Rows that repeat an id give their pieces each;
    columns other than doc_id and text are not read; an empty table gives no rows.
    """

    def run(ids, texts):
        encode = coder(path)
        rows = []
        keys = ids.to_pylist()
        for key, text in zip(keys, texts, strict=True):
            code = np.append(encode(text or ""), np.uint32(END)).astype("<u4")
            for k, (start, length) in enumerate(cut(len(code), capacity)):
                part = code[start : start + length].tobytes()
                rows.append((key, k, start, length, zlib.crc32(part)) + ((part,) if carry_ids else ()))
        columns = list(zip(*rows, strict=True))
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
        return {n: pa.array(c, t) for n, c, t in zip(("doc_id", "piece", "start", "length", "ids_crc32", "ids"), columns, kinds, strict=False)}

    return map_texts(df, run, PIECES + (", ids binary" if carry_ids else ""))


def _packer(level: int, capacity: int):
    """Units (g, pid, piece columns): sequence_id and offset of each piece, and whether its sequence should be packed again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for unit in _units(batches, 1):
            unit = unit.sort_by([("length", "descending"), ("pid", "ascending")]).combine_chunks()
            lengths = unit["length"].to_pylist()
            number, offset, again = np.empty(len(lengths), np.int64), np.zeros(len(lengths), np.int64), np.zeros(len(lengths), bool)
            base = (level << 51) + (unit["g"][0].as_py() << 20)
            for k, items in enumerate(pack(lengths, capacity)):
                at = 0
                for item in items:
                    number[item], offset[item] = base + k, at
                    at += lengths[item]
                again[items] = capacity - at > SLACK
            out = unit.drop_columns(["g"]).append_column("sequence_id", pa.array(number)).append_column("offset", pa.array(offset)).append_column("again", pa.array(again))
            yield from out.combine_chunks().to_batches(max_chunksize=20_000)

    return run


def _last(level: int, groups: int, opened: int, saved: int | None, bins: int | None) -> bool:
    """Whether a level is the last: all pieces were in one group, no sequence is left to pack again, or too few were saved. There are at most as many levels as WORTH allows."""
    return groups == 1 or not opened or (saved is not None and saved < WORTH * bins)


def packed(parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``parts`` (PIECES, and further columns such as the ids) with sequence_id and offset.

    Pieces are dealt evenly by a hash of their row to groups of about GROUP, so a unit of work is bounded
    whatever the sources and the size of the table. Sequences that stay emptier than SLACK allows are packed again, in groups of other
    pieces, as long as a level saves WORTH of them. Every piece keeps its own row: rows that repeat
    an id, equal texts and pieces of equal length are packed each for itself, in the order of their rows; a clashing further
    column must not be named pid, g, again, sequence_id or offset; no rows give none. A piece longer than ``capacity`` is an error.
    """
    spark = parts.sparkSession
    most = shuffle_partitions(spark)
    columns = ["pid", *(c.split(" ")[0] for c in PIECES.split(", "))]
    schema = "pid long, " + PACKED + ", again boolean"
    held, _ = stage_table(parts.withColumn("pid", F.monotonically_increasing_id()), "packing-pieces")
    left, bins, done, level = held.select(columns), None, [], 0
    while n := left.count():
        groups = -(-n // GROUP)
        dealt = left.select(F.pmod(F.xxhash64("pid", F.lit(level)), F.lit(groups)).alias("g"), *columns)
        out, _ = stage_table(dealt.repartition(min(most, groups), "g").sortWithinPartitions("g").mapInArrow(_packer(level, capacity), schema), "packing")
        opened = out.filter("again and offset = 0").count()
        saved = None if bins is None else bins - out.filter("offset = 0").count()
        if _last(level, groups, opened, saved, bins):
            done.append(out)
            break
        done.append(out.filter("not again"))
        left, bins, level = out.filter("again").select(columns), opened, level + 1
    placed = functools.reduce(DataFrame.union, done) if done else spark.createDataFrame([], schema)
    extra = [c for c in held.columns if c not in columns]
    if extra:
        placed = placed.join(held.select("pid", *extra), "pid")
    return placed.select(*columns[1:], "sequence_id", "offset", *extra)


def op2_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 tokens; a null text is the end token alone."""
    return packed(pieces(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY)))
