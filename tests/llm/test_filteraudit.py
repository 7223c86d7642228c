import re
from collections import Counter
from itertools import permutations

import pyarrow as pa
import pytest

from fathomline.llm import filteraudit
from fathomline.llm.filteraudit import ORDERS, audit, failures, first_failures

from . import fixtures


def plain_fails(text, smaller):
    words = re.findall("[^\x20\x09-\x0d]+", text)
    out = set()
    out |= {"A"} if len(words) < 200 else set()
    out |= {"B"} if 100 * len(set(words)) < 50 * len(words) else set()
    out |= {"C"} if 100 * len(re.findall("[A-Z]", text)) > 3 * len(text) else set()
    out |= {"D"} if re.search("[#$%&*|]", text) else set()
    return out | ({"E"} if smaller else set())


def plain(rows, labels):
    """Every order applied one filter after the other to sets of documents."""
    good, toxic = ({d for d, q, t in labels if d is not None and (q, t)[k] == 1} for k in (0, 1))
    docs = [(i, part or "", plain_fails(text or "", any(j is not None and i is not None and j < i and (u or "") == (text or "") for j, u, _ in rows))) for i, text, part in rows]
    out, shares = {}, Counter()
    for part in {d[1] for d in docs}:
        mine = [d for d in docs if d[1] == part]
        for order in map("".join, permutations("ABCDE")):
            left = mine
            for step, letter in enumerate(order, 1):
                lost = [d for d in left if letter in d[2]]
                left = [d for d in left if letter not in d[2]]
                fails = sum(letter in d[2] for d in mine)
                shares[part, letter] += len(lost)
                out[part, order, step] = [len(left), len(lost), fails - len(lost), sum(d[2] == {letter} for d in mine), sum(d[0] in good for d in lost), sum(d[0] in toxic for d in lost)]
    return {k: tuple([*v, shares[k[0], k[1][k[2] - 1]]]) for k, v in out.items()}


def rows_of(df):
    return {(r.part, r.filter_order, r.step): tuple(r[m] for m in filteraudit.MEASURES) for r in df.collect()}


LABELS = "doc_id long, quality int, toxic int, text string"


def test_lookup_table_is_the_first_failure():
    found = first_failures()
    assert found.shape == (32, 120) and len(set(ORDERS)) == 120
    for mask in range(32):
        for o, order in enumerate(ORDERS):
            steps = [s for s, letter in enumerate(order) if mask >> "ABCDE".index(letter) & 1]
            assert found[mask, o] == min(steps, default=5)


@pytest.mark.parametrize("text", ["", " \t", "a", "A b c d", "Ab \x1c c\x85d e", "x#", "é" * 3 + "A", " ".join(f"w{i}" for i in range(200)), " ".join(["w"] * 400), "A" + "é" * 32, "A" + "é" * 33, " ".join(f"w{i % 100}" for i in range(200)), " ".join(f"w{i % 99}" for i in range(200))])
def test_conditions(text):
    assert {x for k, x in enumerate("ABCD") if failures(text.encode()) >> k & 1} == plain_fails(text, False)


def test_every_row_beside_a_plain_version(spark):
    docs = fixtures.frame(spark, [(-3, " ".join(fixtures.WORDS * 40), "de", "s", 1, 7, "x"), (None, "null id", "de", "s", 1, 7, "x"), (50, None, "", "s", 0, 7, "x")])
    labels = [(0, 1, 0, "x"), (0, 0, 1, "x"), (10, 1, 1, "x"), (13, 0, None, "x"), (None, 1, 1, "x"), (12, None, 1, "x"), (999, 1, 1, "x")]
    got = rows_of(audit(docs, spark.createDataFrame(labels, LABELS)))
    assert got == plain([(r.doc_id, r.text, r.lang) for r in docs.collect()], [x[:3] for x in labels])


def test_query_on_the_small_tables(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text", "lang").collect()
    labels = spark.read.parquet(f"{small}/labels.parquet").collect()
    got = filteraudit.op11_filter_audit(spark, small)
    assert got.columns == ["part", "filter_order", "step", *filteraudit.MEASURES] and dict(got.dtypes)["step"] == "int"
    assert rows_of(got) == plain([tuple(r) for r in docs], [(r.doc_id, r.quality, r.toxic) for r in labels])


def test_no_rows_give_none_and_many_parts_are_handed_on(spark):
    labels = spark.createDataFrame([], LABELS)
    assert audit(fixtures.empty(spark), labels).collect() == []
    n = filteraudit.PARTS + 40
    batch = pa.record_batch({"part": [f"p{i % n}" for i in range(3 * n)], "mask": pa.array([i % 32 for i in range(3 * n)], pa.int32()), "good": [True] * (3 * n), "toxic": [False] * (3 * n)})
    out = pa.Table.from_batches(list(filteraudit._counted(iter([batch, batch]))))
    summed = out.group_by(["part", "filter_order", "step"]).aggregate([("removed", "sum"), ("kept", "sum")]).to_pylist()
    assert len(summed) == n * 600
    assert sum(r["removed_sum"] for r in summed if r["filter_order"] == "ABCDE") + sum(r["kept_sum"] for r in summed if (r["filter_order"], r["step"]) == ("ABCDE", 5)) == 6 * n


def test_copies_of_one_text_meet_few_partitions_evenly(spark):
    """A third of all rows is one text: its rows go to the join under keys of their own."""
    docs = spark.range(3000).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN 'hot' ELSE concat('t', id) END AS text", "'en' AS lang")
    got = rows_of(audit(docs, spark.createDataFrame([], LABELS)))
    assert got["en", "EABCD", 1][:2] == (3000 - 999, 999)
