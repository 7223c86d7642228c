import hashlib
import itertools
import re
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fathomline.llm import dialogue
from fathomline.llm.dialogue import Chart, cheapest, damaged, edited, op12_conversation_repair, repaired

TALK = re.compile("(s?(ua)+)?")
NOTHING = hashlib.sha256(b"").hexdigest()


def enumerated(symbols):
    """The best of all edits with at most len + 4 letters: every way to delete, keep, rerole and insert, checked by the pattern."""
    best = None
    stack = [(0, "", "", 0)]
    while stack:
        at, out, audit, cost = stack.pop()
        if at == len(symbols) and TALK.fullmatch(out):
            best = min(best or (cost, audit), (cost, audit))
        if len(audit) < len(symbols) + 4:
            stack += [(at, out + x, audit + "I", cost + 3) for x in "ua"]
        if at < len(symbols):
            s = symbols[at]
            stack.append((at + 1, out, audit + "D", cost + 4))
            if s != "x":
                more = 3 * s.isupper()
                stack.append((at + 1, out + s.lower(), audit + "K", cost + more))
                stack += [(at + 1, out + x, audit + "R", cost + 3 + more) for x in "ua" if x != s.lower()]
    return best


@pytest.mark.parametrize("symbols", ["", *("".join(p) for n in (1, 2) for p in itertools.product("suaoUAx", repeat=n)), "sua", "aus", "uua", "uxa", "sSu", "oOa", "xxx", "uau", "AuA"])
def test_cheapest_edits_beside_enumeration(symbols):
    assert cheapest(symbols) == enumerated(symbols)


def by_states(symbols):
    """The same from the last row to the first, by what stands at the end of the talk so far: no chart."""
    following = {"": "su", "s": "u", "u": "a", "a": "u"}
    after = {}
    for at in range(len(symbols), -1, -1):
        here = {}
        for inserted in range(4, -1, -1):
            for last in following:
                found = [(0, "")] if at == len(symbols) and last in ("", "a") else []
                if inserted < 4:
                    found += [(c + 3, "I" + x) for n in following[last] if n != "s" for c, x in [here[n, inserted + 1]] if c < 1e9]
                if at < len(symbols):
                    s, kind = symbols[at], symbols[at].lower()
                    found.append((after[last, 0][0] + 4, "D" + after[last, 0][1]))
                    for n in following[last]:
                        if s != "x" and (n == kind or n != "s"):
                            found.append((after[n, 0][0] + 3 * (n != kind) + 3 * s.isupper(), ("K" if n == kind else "R") + after[n, 0][1]))
                here[last, inserted] = min(found, default=(1e9, ""))
        after = here
    return after["", 0]


@settings(max_examples=150, deadline=None)
@given(st.text("suaoxSUAO", max_size=70))
def test_longer_talks_and_running_hashes(symbols):
    assert cheapest(symbols) == by_states(symbols)
    names = {"s": "system", "u": "user", "a": "assistant", "o": "tool", "x": "user"}
    rows = [(names[s.lower()], f"t{i}é") for i, s in enumerate(symbols)]
    chart = Chart(hashing=True)
    for s, (role, text) in zip(symbols, rows, strict=True):
        chart.row(s, role, text)
    cost, audit, digest = chart.result()
    lines = edited(audit, rows)
    assert (cost, audit) == cheapest(symbols) and TALK.fullmatch("".join(r[0] for r, _ in lines))
    assert digest == hashlib.sha256("\n".join(f"{r}:{t}" for r, t in lines).encode()).hexdigest()


def plain(rows):
    """The report of every conversation, from rows before damage."""
    out = {}
    for conv in {r[0] for r in rows}:
        after = []
        for _, turn, role, text in (r for r in rows if r[0] == conv):
            role, text = " " if role is None else role, " " if text is None else text
            kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
            if kind:
                text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
                after += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
        after.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        turns = [t for t, _, _ in after if t is not None]
        n, symbols, seen = {"blank": 0, "duplicate": 0, "truncated": 0}, "", set()
        for _, role, text in after:
            body = re.findall("[^\x20\x09-\x0d]", text)
            fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else ""
            seen.add((role, text))
            if fault:
                n[fault] += 1
            initial = role[:1] if role[:1] in list("sua") else "o"
            symbols += "x" if fault in ("blank", "duplicate") else initial.upper() if fault else initial
        cost, audit = by_states(symbols)
        lines, source, last = [], iter(after), ""
        for letter in audit:
            due = "a" if last == "u" else "u"
            if letter == "I":
                lines.append(({"u": "user", "a": "assistant"}[due], ""))
            else:
                _, role, text = next(source)
                if letter == "D":
                    continue
                lines.append(({"u": "user", "a": "assistant"}[due] if letter == "R" else role, text))
            last = lines[-1][0][0]
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(after))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = (gaps, n["blank"], n["duplicate"], n["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in lines).encode()).hexdigest())
    return out


def reports(df):
    rows = df.collect()
    assert len({r.conv_id for r in rows}) == len(rows)
    return {r.conv_id: tuple(r)[1:] for r in rows}


SCHEMA = "conv_id long, turn long, role string, text string, copies string, kind int"


def test_query_on_the_small_tables(spark, small):
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = op12_conversation_repair(spark, small)
    assert [f"{n} {t.replace('bigint', 'long')}" for n, t in got.dtypes] == dialogue.REPORT.split(", ")
    assert reports(got) == plain(rows)


def test_nulls_ties_repeats_and_long_texts(spark):
    rows = [(c, t, r, x) for c in (1, 2, None) for t in (None, 0, 1, 1, 5, -4) for r, x in (("user", "Hi."), (None, "no role."), ("assistant", None), ("", "empty role"), ("user", "Hi."))]
    rows += [(7, t, "user" if t % 2 else "assistant", "x" * 100_000 + ".") for t in range(60)] + [(8, t, "tool", " \x1c ") for t in range(40)]
    rows += [(9, t, ("system", "user", "assistant")[t % 3], f"line {t % 400}.") for t in range(1500)]
    frame = spark.createDataFrame([(*r, "clash", 3) for r in rows], SCHEMA)
    made = damaged(frame)
    assert reports(repaired(made, F.col("copies"))) == plain(rows)
    assert op12_rows(spark, []) == {}


def op12_rows(spark, rows):
    made = damaged(spark.createDataFrame(rows, SCHEMA))
    return reports(repaired(made, F.col("copies")))


def test_a_conversation_that_is_all_dropped(spark):
    dropped = [i for i in range(200) if zlib.crc32(f"{i}:0".encode()) % 20 == 0]
    got = op12_rows(spark, [(i, 0, "user", "Hi.", "c", 1) for i in dropped])
    assert dropped and got == {i: (0, 0, 0, 0, 0, 0, "", NOTHING) for i in dropped}


def test_messages_are_the_repaired_rows(spark):
    talk = [(1, 0, "user", "a."), (1, 1, "user", "b."), (1, 2, "assistant", "c."), (1, 3, "assistant", " ")]
    row = repaired(spark.createDataFrame(talk, "conv_id long, turn long, role string, text string"), messages=True).collect()[0]
    assert row.audit == cheapest("uuax")[1]
    lines = [f"{m.role}:{m.text}" for m in row.messages]
    assert row.repaired_sha256 == hashlib.sha256("\n".join(lines).encode()).hexdigest()
