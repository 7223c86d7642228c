"""Repair of conversation structure: error-correcting Earley parsing of the turns' roles."""

from __future__ import annotations

import functools
import hashlib
import heapq
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import give_back, shuffle_partitions, slices, table

#: A talk is empty, or rounds of user and assistant after a system turn or none. Capitals are nonterminals, the first is the start; all recursion is to the left,
#: so every item begins at the talk's start and a set of the chart holds a fixed number of items.
GRAMMAR = (("Talk", ()), ("Talk", ("Round",)), ("Round", ("Asked", "a")), ("Asked", ("u",)), ("Asked", ("Head", "u")), ("Asked", ("Round", "u")), ("Head", ("s",)))
START = GRAMMAR[0][0]
#: What the error productions cost; a kept row costs nothing, a truncated one that stays costs TRUNCATED more.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Roles that a row may be given, and that may be inserted, by initial.
GIVEN = {"u": "user", "a": "assistant"}
LEGAL = {"su", "ua", "au"}
BLANKS, ENDS = " \t\n\x0b\x0c\r", ".!?"
#: Rows and characters of a conversation that a task holds before it goes on row by row with running hashes; audits that a worker remembers, and of how many rows at most.
HELD_ROWS, HELD_CHARS, REMEMBER, REMEMBER_ROWS = 512, 4 << 20, 100_000, 48
#: Rows after which what all audits of the chart begin with is set apart.
APART = 64


def _waiting() -> dict[str, list[tuple[int, int]]]:
    """symbol -> items (production, dot) that wait for it."""
    out: dict[str, list[tuple[int, int]]] = {}
    for p, (_, right) in enumerate(GRAMMAR):
        for dot, symbol in enumerate(right):
            out.setdefault(symbol, []).append((p, dot))
    return out


WAITING = _waiting()


def symbol_of(role: str, fault: str) -> str:
    """What the grammar sees of a row: x where it must go, else its role's initial, upper case where truncated, o and O for other roles."""
    if fault in ("blank", "duplicate"):
        return "x"
    initial = role[:1] if role[:1] in ("s", "u", "a") else "o"
    return initial.upper() if fault == "truncated" else initial


class Chart:
    """The last set of an Earley chart: for each item (production, dot) the least (cost, audit) of its derivations.

    As the grammar recurs to the left only, all items begin at the first set and a completed item meets what waited there, at cost 0; so a set is
    all that a row needs. With ``hashing`` each item also carries the hash of its repaired lines. Of two derivations of an item with one
    cost neither audit begins with the other (letters after it would be insertions, which cost), so the least stays least whatever follows.
    """

    def __init__(self, hashing: bool = False):
        self.done: list[str] = []
        self.rows = 0
        first = hashlib.sha256() if hashing else None
        self.items = self._closed([((p, 0), 0, "", first, False) for p in range(len(GRAMMAR))])

    @staticmethod
    def _line(state, started: bool, role: str, text: str):
        if state is None:
            return None
        state = state.copy()
        state.update((("\n" if started else "") + role + ":").encode("utf-8", "surrogatepass"))
        state.update(text.encode("utf-8", "surrogatepass"))
        return state

    def _closed(self, found: list) -> dict:
        """The set with completions and insertions, cheapest derivations first, so that an item is final when it is taken."""
        heap = [(cost, audit, n, item, state, started) for n, (item, cost, audit, state, started) in enumerate(found)]
        heapq.heapify(heap)
        n, items = len(heap), {}
        while heap:
            cost, audit, _, item, state, started = heapq.heappop(heap)
            if item in items:
                continue
            items[item] = (cost, audit, state, started)
            left, right = GRAMMAR[item[0]]
            if item[1] == len(right):  # complete: advance what waits for it
                for p, dot in WAITING.get(left, ()):
                    if not dot and (p, 1) not in items:
                        heapq.heappush(heap, (cost, audit, n, (p, 1), state, started))
                        n += 1
            elif right[item[1]] in GIVEN and (item[0], item[1] + 1) not in items:  # insert
                role = GIVEN[right[item[1]]]
                heapq.heappush(heap, (cost + INSERT, audit + "I", n, (item[0], item[1] + 1), self._line(state, started, role, ""), True))
                n += 1
        return items

    def row(self, symbol: str, role: str = "", text: str = "") -> None:
        """Scan a row: keep it, give it another role, or delete it before the terminal or the end that an item waits for."""
        kind, more = symbol.lower(), TRUNCATED if symbol.isupper() else 0
        found = []
        for item, (cost, audit, state, started) in self.items.items():
            left, right = GRAMMAR[item[0]]
            awaited = right[item[1]] if item[1] < len(right) else None
            if awaited is None:
                if left == START:
                    found.append((item, cost + DELETE, audit + "D", state, started))
                continue
            if awaited[0].isupper():
                continue
            found.append((item, cost + DELETE, audit + "D", state, started))
            if kind == awaited:
                found.append(((item[0], item[1] + 1), cost + more, audit + "K", self._line(state, started, role, text), True))
            elif kind != "x" and awaited in GIVEN:
                found.append(((item[0], item[1] + 1), cost + REROLE + more, audit + "R", self._line(state, started, GIVEN[awaited], text), True))
        self.items = self._closed(found)
        self.rows += 1
        if self.rows % APART == 0:
            same = os.path.commonprefix([x[1] for x in self.items.values()])
            self.done.append(same)
            self.items = {k: (c, a[len(same) :], s, b) for k, (c, a, s, b) in self.items.items()}

    def result(self) -> tuple[int, str, str | None]:
        """(cost, audit, hash) of the cheapest complete talk."""
        ends = [v for (p, dot), v in self.items.items() if GRAMMAR[p][0] == START and dot == len(GRAMMAR[p][1])]
        cost, audit, state, _ = min(ends, key=lambda v: v[:2])
        return cost, "".join(self.done) + audit, state.hexdigest() if state else None


def cheapest(symbols: str) -> tuple[int, str]:
    """(cost, audit) of a talk's symbols: the cheapest edits, of equal ones the audit that is least by ASCII."""
    chart = Chart()
    for s in symbols:
        chart.row(s)
    return chart.result()[:2]


remembered = functools.lru_cache(maxsize=REMEMBER)(cheapest)


def edited(audit: str, rows: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """(role, text) of a talk after its edits: the audit's letters say what becomes of each row, the grammar which role stands next."""
    out, source, awaited = [], iter(rows), "u"
    for letter in audit:
        if letter == "D":
            next(source)
            continue
        role, text = (GIVEN[awaited], "") if letter == "I" else next(source)
        out.append((GIVEN[awaited] if letter == "R" else role, text))
        awaited = "a" if out[-1][0][:1] == "u" else "u"
    return out


class Talk:
    """A conversation as its rows arrive in order: counts, faults, and the rows themselves until there are too many."""

    def __init__(self, messages: bool):
        self.messages = messages
        self.low = self.high = self.turn = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = self.chars = 0
        self.before: str | None = None
        self.seen: set[bytes] = set()
        self.symbols: list[str] = []
        self.held: list[tuple[str, str]] = []
        self.chart: Chart | None = None

    def fault(self, role: str, text: str) -> str:
        body = text.strip(BLANKS)
        size = len(role).to_bytes(8, "little")  # no other role and text give the same bytes
        key = hashlib.blake2b(size + (role + text).encode("utf-8", "surrogatepass"), digest_size=16).digest()
        known = key in self.seen
        self.seen.add(key)
        if not body:
            return "blank"
        if known:
            return "duplicate"
        return "" if body[-1] in ENDS else "truncated"

    def add(self, turn: int | None, role: str, text: str) -> None:
        if turn is not None:
            self.low = turn if self.low is None else self.low
            self.turns += turn != self.turn
            self.turn = self.high = turn
        initial = role[:1]
        self.illegal += self.before is not None and self.before + initial not in LEGAL
        self.before = initial
        fault = self.fault(role, text)
        if fault:
            setattr(self, fault, getattr(self, fault) + 1)
        symbol = symbol_of(role, fault)
        if self.chart:
            self.chart.row(symbol, role, text)
            return
        self.symbols.append(symbol)
        self.held.append((role, text))
        self.chars += len(text)
        if not self.messages and (len(self.held) > HELD_ROWS or self.chars > HELD_CHARS):
            self.chart = Chart(hashing=True)
            for s, (r, t) in zip(self.symbols, self.held, strict=True):
                self.chart.row(s, r, t)
            self.held.clear()

    def report(self, conv) -> dict:
        rows = None
        if self.chart:
            cost, audit, digest = self.chart.result()
        else:
            symbols = "".join(self.symbols)
            cost, audit = (remembered if len(symbols) <= REMEMBER_ROWS else cheapest)(symbols)
            rows = edited(audit, self.held)
            digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in rows).encode("utf-8", "surrogatepass")).hexdigest()
        gaps = self.high - self.low + 1 - self.turns if self.low is not None else 0
        out = {"conv_id": conv, "gaps": gaps, "blank": self.blank, "duplicate": self.duplicate, "truncated": self.truncated, "illegal": self.illegal, "cost": cost, "audit": audit, "repaired_sha256": digest}
        return out | ({"messages": [{"role": r, "text": t} for r, t in rows or ()]} if self.messages else {})


REPORT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
MESSAGES = ", messages array<struct<role:string,text:string>>"
COUNTS = [pa.field(n, pa.int64()) for n in ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
ARROW = pa.schema([*COUNTS, pa.field("audit", pa.string()), pa.field("repaired_sha256", pa.string())])


def _repairer(messages: bool):
    schema = ARROW.append(pa.field("messages", pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())])))) if messages else ARROW

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[dict] = []
        size, talk, conv = 0, None, None
        for batch in batches:
            for part in slices(batch):
                for key, turn, role, text, copies in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    if talk is None or key != conv:
                        if talk:
                            out.append(talk.report(conv))
                            size += 1 + talk.chars // 1000 * messages
                        talk, conv = Talk(messages), key
                    for _ in range(copies):
                        talk.add(turn, role, text)
                    if size >= 2000:
                        yield pa.RecordBatch.from_pylist(out, schema=schema)
                        out, size = [], 0
        if talk:
            out.append(talk.report(conv))
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=schema)
        give_back()

    return run


def repaired(talks: DataFrame, copies: Column | None = None, messages: bool = False) -> DataFrame:
    """REPORT, a row a conversation, the null id being one of its own; with ``messages`` also the repaired rows.

    ``talks`` has conv_id, turn, role and text; other columns are not read, so none can clash. Null roles and texts are one space. Rows stand by
    turn, null turns first; rows of one turn by role and then by text, so equal rows are beside each other. ``copies`` says how often a
    row stands there: one with 0 only names its conversation, whose report is then zeros, an empty audit and the hash of nothing where it has no others.
    A row's first fault counts: blank, duplicate (the same role and text stood earlier; compared by a 128-bit hash), truncated. Equal costs are
    decided by the audit. Long texts are read whole; an empty table gives no rows.

    A conversation is one unit of work, as its audit is one value and its hash runs over its lines in order. Rows come sorted by Spark and are
    read as a stream; from HELD_ROWS rows or HELD_CHARS characters on, the chart carries hashes in place of rows, so what a task holds of
    a very long conversation are a hash of 16 bytes and an audit letter a row, never its texts. Only ``messages`` holds them, as its result does.
    """
    rows = talks.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *(F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")), (F.lit(1) if copies is None else copies).cast("int").alias("copies"))
    ordered = rows.repartition(shuffle_partitions(talks.sparkSession), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    # Text last: slices() bounds a batch by it.
    return ordered.select("conv_id", "turn", "role", "text", "copies").mapInArrow(_repairer(messages), REPORT + MESSAGES * messages)


def damaged(talks: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies): rows damaged by crc32 of ``conv_id:turn`` modulo 20, as a test of repair.

    0 drops the row (no copies), 1 empties its text, 2 takes its ``.!?`` out, 3 repeats it, 4 makes its role user. Nulls are one space, in the key too;
    the turn itself stays null.
    """
    written = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(written("conv_id"), F.lit(":"), written("turn")).cast("binary")) % 20
    rows = talks.select(F.col("conv_id"), F.col("turn"), written("role").alias("role"), written("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.translate("text", ENDS, "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role"))
    copies = F.when(F.col("kind") == 0, F.lit(0)).when(F.col("kind") == 3, F.lit(2)).otherwise(F.lit(1))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copies"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations after damage, with their faults, cheapest edits and the hash of what the edits give."""
    talks = damaged(table(spark, sf_dir, "conversations"))
    return repaired(talks, F.col("copies"))
