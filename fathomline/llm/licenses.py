"""License scans: Aho-Corasick finds tags and notices, a shunting-yard parser evaluates license expressions."""

from __future__ import annotations

import functools
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_texts, table

#: Base phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: label -> (restriction from 0, anything is allowed, to 1, nothing is; names as words; identifiers). Identifiers are compared without their version.
LICENSES = {
    "public-domain": (0.0, ("public domain", "cc0", "creative commons zero", "unlicense"), ("cc0", "unlicense", "pddl")),
    "mit": (0.1, ("mit license", "mit licence", "mit", "expat license"), ("mit", "expat", "x11", "mit0")),
    "isc": (0.1, ("isc license", "isc licence"), ("isc",)),
    "bsd": (0.15, ("bsd license", "bsd licence", "bsd 2 clause", "bsd 3 clause", "bsd"), ("bsd", "0bsd")),
    "apache": (0.2, ("apache license", "apache licence", "apache 2 0", "apache"), ("apache",)),
    "cc-by": (0.2, ("cc by", "creative commons attribution"), ("ccby",)),
    "cc-by-sa": (0.45, ("cc by sa", "creative commons attribution sharealike", "creative commons attribution share alike"), ("ccbysa",)),
    "cc-by-nc": (0.6, ("cc by nc", "creative commons attribution noncommercial", "creative commons attribution non commercial"), ("ccbync", "ccbyncsa")),
    "cc-by-nd": (0.6, ("cc by nd", "creative commons attribution noderivatives"), ("ccbynd", "ccbyncnd")),
    "mpl": (0.4, ("mozilla public license", "mozilla public licence", "mpl"), ("mpl",)),
    "epl": (0.45, ("eclipse public license", "epl"), ("epl",)),
    "lgpl": (0.5, ("lesser general public license", "library general public license", "lgpl"), ("lgpl",)),
    "gpl": (0.7, ("general public license", "gnu gpl", "gpl"), ("gpl",)),
    "agpl": (0.8, ("affero general public license", "agpl"), ("agpl",)),
    "reserved": (1.0, ("all rights reserved",), ("proprietary",)),
}
#: Exceptions that may follow ``with``; they take off this share of a restriction.
EXCEPTIONS, EXCEPTION_SHARE = ("classpath exception", "gcc exception", "llvm exception", "linking exception", "font exception", "autoconf exception", "bison exception"), 0.5
#: Words before an expression in prose, and identifier tags, whose expression is the rest of their line.
LEADS = ("licensed under", "licenced under", "released under", "distributed under", "available under", "published under", "license is", "licence is", "terms of")
TAGS = ("spdx license identifier", "license expression")
#: What may stand between a lead and a name, or around one, without ending the expression.
FILLERS = {"the", "a", "an", "of", "either", "both", "terms", "version", "license", "licence", "v2", "v3", "gnu", "later", "only", "any", "public", "international", "clause"}
UNKNOWN, UNKNOWN_RESTRICTION = "other", 0.5
#: A name without a lead or a tag counts for so much of its restriction.
BARE = 0.5

#: ASCII bytes to lower case; all but digits, letters and bytes of other characters to a space.
WORD_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
TAG = regex.compile(rb"(?i)(?:spdx[^0-9a-z\x80-\xff\n]license[^0-9a-z\x80-\xff\n]identifier|license[^0-9a-z\x80-\xff\n]expression)[ \t]*[:=][ \t]*([^\r\n]*)")
TOKEN = regex.compile(rb"[()]|[0-9A-Za-z\x80-\xff][0-9A-Za-z.+\x80-\xff-]*")
VERSION = regex.compile(r"-v?\d+(?:\.\d+)*|[.+]|-(?:only|or-later|clause|international)\b")


# ---------------------------------------------------------------- expressions


@dataclass(frozen=True)
class Value:
    """What a (part of an) expression means: the labels in it and how much the reader is restricted."""

    labels: frozenset[str]
    restriction: float


#: Operators: binding strength, and their meaning. ``and`` asks for all, ``or`` leaves the choice, ``with`` grants an exception.
OPERATORS = {
    "or": (1, lambda a, b: Value(a.labels | b.labels, min(a.restriction, b.restriction))),
    "and": (2, lambda a, b: Value(a.labels | b.labels, max(a.restriction, b.restriction))),
    "with": (3, lambda a, b: Value(a.labels | b.labels, a.restriction * EXCEPTION_SHARE)),
}


class Malformed(ValueError):
    """The tokens are no expression."""


def postfix(tokens: list) -> list:
    """Shunting-yard: operands (Value), operators and parentheses in postfix order; operators of one strength bind to the left."""
    out, stack, operand = [], [], False
    for token in tokens:
        if isinstance(token, Value):
            if operand:
                raise Malformed("two operands beside each other")
            out.append(token)
            operand = True
        elif token == "(":
            if operand:
                raise Malformed("an operand before a parenthesis")
            stack.append(token)
        elif not operand:
            raise Malformed(f"nothing before {token}")
        elif token == ")":
            while stack and stack[-1] != "(":
                out.append(stack.pop())
            if not stack:
                raise Malformed("a parenthesis is not opened")
            stack.pop()
        else:
            while stack and stack[-1] != "(" and OPERATORS[stack[-1]][0] >= OPERATORS[token][0]:
                out.append(stack.pop())
            stack.append(token)
            operand = False
    if not operand:
        raise Malformed("no operand at the end")
    if "(" in stack:
        raise Malformed("a parenthesis is not closed")
    return out + stack[::-1]


def evaluate(tokens: list) -> Value:
    values = []
    for token in postfix(tokens):
        if isinstance(token, Value):
            values.append(token)
        else:
            right, left = values.pop(), values.pop()
            values.append(OPERATORS[token][1](left, right))
    return values[0]


@functools.cache
def _identifiers() -> dict[str, str]:
    return {i: label for label, (_, _, identifiers) in LICENSES.items() for i in identifiers}


def _value(label: str) -> Value:
    return Value(frozenset([label]), LICENSES[label][0] if label in LICENSES else UNKNOWN_RESTRICTION)


def identifier(name: str) -> Value:
    """The value of an identifier such as ``GPL-2.0-only`` or ``Classpath-exception-2.0``."""
    short = VERSION.sub("", name.lower()).replace("-", "")
    if short.endswith("exception"):
        return Value(frozenset(), 0.0)
    return _value(_identifiers().get(short, UNKNOWN))


def parse_tag(expression: bytes) -> Value:
    """The value of the expression after an identifier tag, whose tokens are names, parentheses and and, or, with."""
    tokens: list = []
    for token in TOKEN.findall(expression):
        word = token.decode("utf-8", "replace")
        lower = word.lower()
        tokens.append(lower if lower in OPERATORS or word in "()" else identifier(word))
    return evaluate(tokens)


# ---------------------------------------------------------------- texts


@functools.lru_cache(maxsize=1)
def automaton() -> ahocorasick.Automaton:
    """Phrases of words, a space on either side: (kind, label, words). Phrases that share their space are all found."""
    out = ahocorasick.Automaton()
    found: dict[str, list] = {}
    for phrase, label in BASE.items():
        found.setdefault(phrase, []).append(("base", label))
    for label, (_, names, _) in LICENSES.items():
        for name in names:
            found.setdefault(name, []).append(("name", label))
    for kind, phrases in (("lead", LEADS), ("tag", TAGS), ("exception", EXCEPTIONS), ("operator", tuple(OPERATORS))):
        for phrase in phrases:
            found.setdefault(phrase, []).append((kind, phrase))
    for phrase, uses in found.items():
        out.add_word(f" {phrase} ", (len(phrase) + 2, phrase.count(" ") + 1, uses))
    out.make_automaton()
    return out


@dataclass
class Scan:
    """What a text holds: its words, the base phrases' places and labels, all labels, and the restriction of its notices."""

    n_words: int
    places: list[tuple[int, str]]
    labels: set[str]
    score: float
    expressions: list[tuple[int, str, float]]


def scan(text: bytes) -> Scan:
    """Everything in one whole text.

    A place is the number of the word at which a phrase begins. A lead is followed by an expression: names, and, or, with and exceptions, with
    nothing but fillers and numbers between, as long as it goes on. A tag's expression is the rest of its line; one that does not parse counts as
    an unknown license. All notices of a text hold together, so the score is the largest restriction; names outside expressions count BARE of theirs.
    """
    words = text.translate(WORD_BYTES).split()
    joined = b" " + b" ".join(words) + b" "
    hits = list(automaton().iter(joined.decode("latin-1")))
    telling = {kind for _, (_, _, uses) in hits for kind, _ in uses} - {"operator", "exception"}
    if not telling:
        return Scan(len(words), [], set(), 0.0, [])
    spaces = np.flatnonzero(np.frombuffer(joined, np.uint8) == 0x20)
    starts = np.searchsorted(spaces, [end - size + 1 for end, (size, _, _) in hits])
    places, names, leads, others = [], {}, [], {}
    for start, (_, (_, count, uses)) in zip(starts.tolist(), hits, strict=True):
        for kind, label in uses:
            if kind == "base":
                places.append((start, label))
            elif kind == "name":
                if count > names.get(start, (0, ""))[0]:
                    names[start] = (count, label)
            elif kind == "lead":
                leads.append((start, start + count))
            elif kind != "tag":
                others[start] = (count, kind, label)
    labels = {label for _, label in places}
    # Of names that overlap, the one that begins first counts.
    kept, reach = {}, 0
    for start in sorted(names):
        if start >= reach:
            kept[start], reach = names[start], start + names[start][0]
    expressions, used = [], set()
    for start, at in leads:
        value, inside = _prose(words, at, kept, others)
        if value:
            expressions.append((start, ",".join(sorted(value.labels)), value.restriction))
            used |= inside
            labels |= value.labels
    score = max((e[2] for e in expressions), default=0.0)
    if "tag" in telling:
        marks = np.frombuffer(b" " + text.translate(WORD_BYTES), np.uint8) != 0x20
        begins = np.flatnonzero(marks[1:] & ~marks[:-1])
        for found in TAG.finditer(text):
            try:
                value = parse_tag(found[1])
            except Malformed:
                value = _value(UNKNOWN)
            expressions.append((int(np.searchsorted(begins, found.start())), ",".join(sorted(value.labels)), value.restriction))
            labels |= value.labels
            score = max(score, value.restriction)
    for start, (count, label) in kept.items():
        # One word alone, such as mit, is a name only in an expression.
        if start not in used and count > 1:
            labels.add(label)
            score = max(score, LICENSES[label][0] * (1.0 if label in BASE.values() else BARE))
    return Scan(len(words), places, labels, score, sorted(expressions))


def _prose(words: list[bytes], at: int, names: dict, others: dict) -> tuple[Value | None, set[int]]:
    """The longest expression from word ``at`` on, and the names in it: operands and operators by turns, an operator at its end left out."""
    tokens, inside = [], set()
    while at < len(words):
        operand = not tokens or not isinstance(tokens[-1], Value)
        if at in names and operand:
            count, label = names[at]
            tokens.append(_value(label))
            inside.add(at)
            at += count
        elif at in others and operand != (others[at][1] == "operator"):
            count, kind, word = others[at]
            tokens.append(word if kind == "operator" else Value(frozenset(), 0.0))
            at += count
        elif at not in names and at not in others and (words[at].isdigit() or words[at].decode("utf-8", "replace") in FILLERS):
            at += 1
        else:
            break
    if tokens and not isinstance(tokens[-1], Value):
        tokens.pop()
    return (evaluate(tokens), inside) if tokens else (None, inside)


SCANNED = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def licenses(df: DataFrame, spans: bool = False) -> DataFrame:
    """SCANNED, a row a row of ``df``; with ``spans`` also ``expressions``, the evaluated ones (word, labels, restriction).

    A null text is empty: no words, no places, empty labels, score 0. Repeated rows are scanned alike, a row each; null ids stay; places that
    overlap all count; columns other than doc_id and text are not read, so none can clash; an empty table gives no rows. Texts are read
    whole, however long; a worker holds one slice of texts and the places in one text.
    """

    def run(ids, texts):
        rows = [scan((t or "").encode("utf-8", "surrogatepass")) for t in texts]
        joined = lambda found: ",".join(sorted(found))
        at = [[p for p, _ in r.places] for r in rows]
        out = {
            "doc_id": ids,
            "n_words": pa.array([r.n_words for r in rows], pa.int64()),
            "n_base": pa.array([len(p) for p in at], pa.int64()),
            "first_word": pa.array([min(p, default=None) for p in at], pa.int64()),
            "last_word": pa.array([max(p, default=None) for p in at], pa.int64()),
            "base_labels": pa.array([joined({label for _, label in r.places}) for r in rows], pa.string()),
            "labels": pa.array([joined(r.labels) for r in rows], pa.string()),
            "score": pa.array([r.score for r in rows], pa.float64()),
        }
        if spans:
            kinds = {"words": pa.int64(), "names": pa.string(), "restrictions": pa.float64()}
            out |= {n: pa.array([[e[k] for e in r.expressions] for r in rows], pa.list_(t)) for k, (n, t) in enumerate(kinds.items())}
        return out

    if not spans:
        return map_texts(df, run, SCANNED)
    made = map_texts(df, run, SCANNED + ", words array<bigint>, names array<string>, restrictions array<double>")
    parts = F.arrays_zip("words", "names", "restrictions")
    found = F.transform(parts, lambda e: F.struct(e["words"].alias("word"), e["names"].alias("labels"), e["restrictions"].alias("restriction")))
    return made.select(*(c for c in made.columns if c not in ("words", "names", "restrictions")), found.alias("expressions"))


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases, tags and expressions of all documents."""
    return licenses(table(spark, sf_dir, "documents"))
