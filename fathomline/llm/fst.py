"""Token counts by finite-state transducers.

Two deterministic machines count tokens without building them:

* The boundary machine reads characters (as classes with a short look-ahead) and marks those that begin a pre-token. It has
  eight states. Text is cut into chunks; the map from start state to end state of each chunk is computed for all chunks
  at once, the maps are composed by a parallel prefix scan, and a second pass from the known start states annotates
  every transition. A document boundary is a symbol that resets the machine, so one scan serves a whole batch and
  a long text has no sequential tail.
* The token machine reads the bytes of a pre-token. A state is the set of places from which a token could still run on: for each
  the place in the vocabulary's trie, the last token before it and the tokens up to it. The transition on a byte emits the change
  of the number of tokens (a merge may take tokens back). Transitions are compiled when they are first met, into a table
  (state, byte) -> (state, emitted) that all pre-tokens of a batch read at once, a byte of each at a time. Pre-tokens longer than a
  chunk are cut: each chunk starts from the state that its run-up gives, the chunks' maps are composed, and a chunk whose start
  was not the end of the one before it runs again from there.
"""

from __future__ import annotations

import functools
import json
import re
from array import array

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from .bytebpe import byte_characters
from .charclass import NUMBER, SPACE, packed_classes, unpack
from .common import documents_of, slices, table
from .shingles import C, mix, span_hashes

VOCABULARY, LIMIT = "byte_bpe_50k.json", 1024
#: Characters of a chunk of the scan.
CHUNK = 128
#: Pre-tokens whose count a worker remembers, and states of the token machine.
REMEMBER, STATES_HELD = 600_000, 200_000
#: Bytes of a chunk of a long pre-token.
PIECE = 1024

# States of the boundary machine: at a boundary; in letters, numbers, other marks; after a space that joins what
# follows; in white space; with one or two characters of a contraction to come.
AT, IN_L, IN_N, IN_P, JOINED, IN_W, LAST1, LAST2 = range(8)
STATES = 8
# Symbols: letter, number, mark, apostrophe before s t m d, apostrophe before re ve ll, space and other white space
# before a non-space, white space before white space or the end, document boundary.
S_L, S_N, S_P, S_Q1, S_Q2, S_SX, S_WX, S_WW, S_RESET = range(9)
SYMBOLS = 9


@functools.lru_cache(maxsize=1)
def boundary_machine() -> tuple[np.ndarray, np.ndarray]:
    """(next state, 1 if the character begins a pre-token) by state * SYMBOLS + symbol."""
    step = np.zeros((STATES, SYMBOLS), np.uint8)
    mark = np.zeros((STATES, SYMBOLS), np.uint8)
    for state in range(STATES):
        for symbol, inside in ((S_L, IN_L), (S_N, IN_N), (S_P, IN_P)):
            step[state, symbol] = inside
            mark[state, symbol] = state not in (inside, JOINED)
        for symbol, rest in ((S_Q1, LAST1), (S_Q2, LAST2)):
            joins = state in (IN_P, JOINED)
            step[state, symbol] = IN_P if joins else rest
            mark[state, symbol] = not joins
        step[state, S_SX], mark[state, S_SX] = JOINED, 1
        step[state, S_WX], mark[state, S_WX] = AT, 1
        step[state, S_WW], mark[state, S_WW] = IN_W, state != IN_W
        step[state, S_RESET] = AT
    for symbol in (S_L, S_N, S_P):
        step[LAST1, symbol], step[LAST2, symbol] = AT, LAST1
        mark[LAST1, symbol] = mark[LAST2, symbol] = 0
    return step.ravel(), mark.ravel()


def symbols(points: np.ndarray, resets: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Symbols of code points; ``resets`` are the positions of document boundaries."""
    kind = classes[points]
    kind[resets] = SPACE  # white space before the end, as before white space, stays together
    out = np.zeros(len(points), np.uint8)
    out[kind == NUMBER] = S_N
    out[kind == 0] = S_P
    white = kind == SPACE
    before_mark = np.append(~white[1:], False)
    out[white] = S_WW
    single = white & before_mark
    out[single] = S_WX
    out[single & (points == 32)] = S_SX
    quote = np.flatnonzero(points == 39)
    following = np.append(points, [0, 0]).astype(np.uint32)
    first, second = following[quote + 1], following[quote + 2]
    out[quote[np.isin(first, [115, 116, 109, 100])]] = S_Q1
    out[quote[((first == 114) | (first == 118)) & (second == 101) | (first == 108) & (second == 108)]] = S_Q2
    out[resets] = S_RESET
    return out


def compose(maps: np.ndarray) -> np.ndarray:
    """Inclusive prefix composition of state maps (rows), by doubling: row k becomes maps[k] o ... o maps[0]."""
    maps = maps.copy()
    distance = 1
    while distance < len(maps):
        maps[distance:] = np.take_along_axis(maps[distance:], maps[:-distance].astype(np.intp), axis=1)
        distance *= 2
    return maps


def marks(seen: np.ndarray, chunk: int = CHUNK) -> np.ndarray:
    """1 at each symbol on whose transition the boundary machine, started AT a boundary, begins a pre-token."""
    step, mark = boundary_machine()
    n = len(seen)
    rows = -(-n // chunk)
    grid = np.full(rows * chunk, S_RESET, np.uint8)
    grid[:n] = seen
    columns = np.ascontiguousarray(grid.reshape(rows, chunk).T)
    maps = np.repeat(np.arange(STATES, dtype=np.uint8)[:, None], rows, axis=1)
    for column in columns:
        maps = step[maps * np.uint8(SYMBOLS) + column]
    ends = compose(np.ascontiguousarray(maps.T))
    state = np.concatenate([[AT], ends[:-1, AT]]).astype(np.uint8)
    out = np.empty((chunk, rows), np.uint8)
    for k, column in enumerate(columns):
        at = state * np.uint8(SYMBOLS) + column
        out[k] = mark[at]
        state = step[at]
    return out.T.reshape(-1)[:n]


class Table:
    """Transitions (state, byte) -> (state, emitted) by open addressing, read for many at once."""

    def __init__(self) -> None:
        self.size, self.bits = 0, 14
        self._empty()

    def _empty(self) -> None:
        self.keys, self.to, self.emit = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int32), np.zeros(1 << self.bits, np.int16)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, or the free slot where it would go."""
        last = (1 << self.bits) - 1
        at = (mix(keys.view(np.uint64)) & np.uint64(last)).astype(np.int64)
        open_ = np.flatnonzero((self.keys[at] != keys) & (self.keys[at] >= 0))
        while len(open_):
            at[open_] = (at[open_] + 1) & last
            held = self.keys[at[open_]]
            open_ = open_[(held != keys[open_]) & (held >= 0)]
        return at

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 for keys that are not there."""
        at = self._slots(keys)
        return np.where(self.keys[at] == keys, at, -1)

    def add(self, keys: np.ndarray, to: np.ndarray, emit: np.ndarray) -> None:
        """Distinct keys that are not there yet."""
        if 2 * (self.size + len(keys)) > len(self.keys):
            used = self.keys >= 0
            old = self.keys[used], self.to[used], self.emit[used]
            while 2 * (self.size + len(keys)) > 1 << self.bits:
                self.bits += 1
            self._empty()
            self.size = 0
            self._put(*old)
        self._put(keys, to, emit)

    def _put(self, keys: np.ndarray, to: np.ndarray, emit: np.ndarray) -> None:
        self.size += len(keys)
        while len(keys):
            at = self._slots(keys)
            _, first = np.unique(at, return_index=True)
            self.keys[at[first]], self.to[at[first]], self.emit[at[first]] = keys[first], to[first], emit[first]
            rest = np.ones(len(keys), bool)
            rest[first] = False
            keys, to, emit = keys[rest], to[rest], emit[rest]


class TokenMachine:
    """Counts of byte-level BPE tokens of pre-tokens by a transducer over bytes."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        value = {c: i for i, c in enumerate(byte_characters())}
        raw = lambda s: bytes(value[c] for c in s)
        specials = sorted((t["content"] for t in spec["added_tokens"]), key=lambda t: (-len(t), t))
        #: Of special strings that overlap the first counts, of those that begin together the longest.
        self.special = re.compile("|".join(map(re.escape, specials))) if specials else None
        rank = {k: i for i, k in enumerate([*byte_characters(), *(a + b for a, b in spec["model"]["merges"])])}
        if len(rank) != 256 + len(spec["model"]["merges"]):
            raise ValueError("a token comes from two merges")
        # Tokens are numbered by merge order here, bytes first, whatever their ids are: only counts leave this class.
        self.parts = {256 + i: (rank[a], rank[b]) for i, (a, b) in enumerate(spec["model"]["merges"])}
        self.merged = {pair: k for k, pair in self.parts.items()}
        self.pairs: dict[int, bool] = {}
        # The trie of all tokens: (node, byte) -> node, the token that ends at a node, and whether one goes on from it.
        self.child: dict[int, int] = {}
        self.token, self.more = [-1], [True]
        for text, number in rank.items():
            node = 0
            for byte in raw(text):
                self.more[node] = True
                following = self.child.setdefault(node << 8 | byte, len(self.token))
                if following == len(self.token):
                    self.token.append(-1)
                    self.more.append(False)
                node = following
            self.token[node] = number
        self.longest = max(map(len, rank))
        self.none = len(rank)  # stands for the token before a pre-token
        self._forget()

    def _forget(self) -> None:
        self.states: list[bytes] = []
        self.number: dict[bytes, int] = {}
        self.table = Table()
        self._state([self._place(0, self.none, 0)])

    @staticmethod
    def _place(node: int, left: int, total: int) -> int:
        """A place from which a token could run on: trie node, token before it, tokens up to it less those up to here."""
        return (node << 20 | left) << 20 | total + (1 << 19)

    def _state(self, places: list[int]) -> int:
        key = array("q", places).tobytes()
        found = self.number.get(key)
        if found is None:
            found = self.number[key] = len(self.states)
            self.states.append(key)
        return found

    def _compile(self, state: int, byte: int) -> tuple[int, int]:
        """The transition of one state, whose places are ordered from the earliest: the first token that fits is the longest, as in BPE."""
        last = emitted = None
        going = []
        mask = (1 << 20) - 1
        for place in array("q", self.states[state]):
            left, total = place >> 20 & mask, (place & mask) - (1 << 19)
            node = self.child.get(place >> 40 << 8 | byte)
            if node is None:
                continue
            token = self.token[node]
            if last is None and token >= 0 and (left == self.none or self.adjacent(left, token)):
                last, emitted = token, total + 1
            if self.more[node]:
                going.append((node, left, total))
        if last is None:
            raise AssertionError("a byte without a token")
        return self._state([*(self._place(node, left, total - emitted) for node, left, total in going), self._place(0, last, 0)]), emitted

    def _step(self, states: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys = states.astype(np.int64) << 8 | data
        at = self.table.find(keys)
        if (at < 0).any():
            fresh = np.unique(keys[at < 0])
            made = [self._compile(k >> 8, k & 255) for k in fresh.tolist()]
            self.table.add(fresh, np.array([m[0] for m in made], np.int32), np.array([m[1] for m in made], np.int16))
            at = self.table.find(keys)
        return self.table.to[at], self.table.emit[at]

    def run(self, data: np.ndarray, begins: np.ndarray, stops: np.ndarray, states: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(end state, tokens emitted) of spans of bytes, a byte of every span at a time."""
        order = np.argsort(begins - stops, kind="stable")
        at, left, state = begins[order], (stops - begins)[order], states[order].astype(np.int32)
        total = np.zeros(len(at), np.int64)
        alive = len(at)
        for k in range(int(left[0]) if len(left) else 0):
            while left[alive - 1] <= k:
                alive -= 1
            state[:alive], emitted = self._step(state[:alive], data[at[:alive] + k])
            total[:alive] += emitted
        ends, counts = np.empty_like(state), np.empty_like(total)
        ends[order], counts[order] = state, total
        return ends, counts

    def _pieces(self, data: np.ndarray, begins: np.ndarray, stops: np.ndarray) -> np.ndarray:
        """Tokens of spans that are longer than a chunk: maps of their chunks, each for the state that its run-up gives, composed."""
        n = -(-(stops - begins) // PIECE)
        owner = np.repeat(np.arange(len(n)), n)
        low = begins[owner] + PIECE * (np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n))
        high = np.minimum(low + PIECE, stops[owner])
        head = np.concatenate([[True], owner[1:] != owner[:-1]])
        start, _ = self.run(data, np.where(head, low, np.maximum(low - 2 * self.longest, begins[owner])), low, np.zeros(len(low), np.int32))
        end, count = self.run(data, low, high, start)
        while True:
            wrong = np.flatnonzero(~head & (start != np.concatenate([[0], end[:-1]])))
            if not len(wrong):
                return np.bincount(owner, weights=count, minlength=len(n)).astype(np.int64)
            start[wrong] = end[wrong - 1]
            end[wrong], count[wrong] = self.run(data, low[wrong], high[wrong], start[wrong])

    def counts(self, words: list[bytes]) -> list[int]:
        """Tokens of each pre-token."""
        if len(self.states) > STATES_HELD:
            self._forget()
        if len(self.pairs) > 2_000_000:
            self.pairs.clear()
        data = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        stops = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
        begins = np.concatenate([[0], stops[:-1]])
        long = stops - begins > 2 * PIECE
        out = np.zeros(len(words), np.int64)
        out[~long] = self.run(data, begins[~long], stops[~long], np.zeros(int((~long).sum()), np.int32))[1]
        if long.any():
            out[long] = self._pieces(data, begins[long], stops[long])
        return out.tolist()

    def adjacent(self, left: int, right: int) -> bool:
        """Whether BPE can leave ``left`` beside ``right``: no merge across their border comes before the merges that made them."""
        key = left << 20 | right
        known = self.pairs.get(key)
        if known is None:
            known = self.pairs[key] = self._adjacent(left, right)
        return known

    def _adjacent(self, left: int, right: int) -> bool:
        # Undo the later of the two tokens again and again: the border then shows what stood there when
        # a merge of ``limit`` or later was done. A merge over the border of an earlier rank would have come first.
        limit = 1 << 40
        parts, merged = self.parts, self.merged
        while True:
            over = merged.get((left, right))
            if over is not None and over < limit:
                return False
            if left > right:
                limit = left
                if left not in parts:
                    return True
                left = parts[left][1]
            else:
                limit = right + 1
                if right in parts:
                    right = parts[right][0]
                else:
                    # Both are bytes, or the left one is older than the right byte: undo the left one.
                    limit = left
                    if left not in parts:
                        return True
                    left = parts[left][1]


class Counter:
    """Token counts of texts in batches; what a worker keeps between batches is bounded by REMEMBER."""

    def __init__(self, path: str, classes: bytes):
        self.machine = TokenMachine(path)
        self.classes = unpack(classes)
        self.hashes = np.zeros(0, np.uint64)
        self.known = np.zeros(0, np.int32)

    def __call__(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text, special tokens in it counting one each."""
        parts, owner, counts = [], [], np.zeros(len(texts), np.int64)
        for k, text in enumerate(texts):
            pieces = self.machine.special.split(text) if self.machine.special else [text]
            counts[k] += len(pieces) - 1
            for piece in pieces:
                if piece:
                    parts.append(piece)
                    owner.append(k)
        if not parts:
            return counts
        joined = "\n".join(parts) + "\n"
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        ends = np.cumsum([len(p) + 1 for p in parts]) - 1
        begins = np.flatnonzero(marks(symbols(points, ends, self.classes)))
        stops = np.append(begins[1:], len(points))
        piece_of = np.searchsorted(ends, begins)
        stops = np.minimum(stops, ends[piece_of])
        keys = span_hashes(mix(points.astype(np.uint64) + C), begins, stops)
        unique, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
        found = self._look_up(unique, joined, begins[first], stops[first])
        np.add.at(counts, np.asarray(owner), np.bincount(piece_of, weights=found[inverse], minlength=len(parts)).astype(np.int64))
        return counts

    def _look_up(self, unique: np.ndarray, joined: str, begins: np.ndarray, stops: np.ndarray) -> np.ndarray:
        """Counts of pre-tokens by hash; those not met before stand in ``joined`` at the given places."""
        at = np.searchsorted(self.hashes, unique)
        at[at == len(self.hashes)] = 0
        hit = self.hashes[at] == unique if len(self.hashes) else np.zeros(len(unique), bool)
        out = np.zeros(len(unique), np.int64)
        out[hit] = self.known[at[hit]]
        miss = np.flatnonzero(~hit)
        if len(miss):
            fresh = self.machine.counts([joined[a:b].encode() for a, b in zip(begins[miss].tolist(), stops[miss].tolist(), strict=True)])
            out[miss] = fresh
            short = miss[stops[miss] - begins[miss] <= 64]
            if len(self.hashes) + len(short) > REMEMBER:
                self.hashes, self.known = np.zeros(0, np.uint64), np.zeros(0, np.int32)
            hashes = np.concatenate([self.hashes, unique[short]])
            order = np.argsort(hashes, kind="stable")
            self.hashes, self.known = hashes[order], np.concatenate([self.known, out[short].astype(np.int32)])[order]
        return out


@functools.lru_cache(maxsize=2)
def load(path: str, classes: bytes) -> Counter:
    return Counter(path, classes)


def token_counts(df: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every whole text; a null text counts as empty: no bytes, no tokens.

    A special string of the vocabulary inside a text is one token, as the library's default has it. Equal texts and rows that repeat an
    id get equal counts, a row each; null ids stay; columns other than doc_id and text are not read; an empty table gives no
    rows. A very long text is one scan of chunks, and so is a very long run without a boundary.
    """
    classes = packed_classes()

    def run(batches):
        count = load(path, classes)
        for batch in batches:
            for part in slices(batch):
                n = count([x or "" for x in part.column(1).to_pylist()])
                size = pc.cast(pc.fill_null(pc.binary_length(part.column(1)), 0), pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), size, pa.array(n, pa.int64()), pa.array(n > limit, pa.bool_())], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return documents_of(df).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents under the 50k byte-level vocabulary."""
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))
