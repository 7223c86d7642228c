"""Every query of the engine against its SQL on the smallest tables."""

import glob
import math
import os
import re

import duckdb
import pytest

from fathomline.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def oracle(small):
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for name in TABLES:
        path = f"{small}/{name}.parquet"
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{path}/*.parquet'" if os.path.isdir(path) else f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return "null"
    if isinstance(value, float):
        return f"{value:.5f}" if value != int(value) else str(int(value))
    return str(value)


def rows(columns, data):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(tuple(plain(r[i]) for i in order) for r in data)


def near(a, b):
    if a == b:
        return True
    try:
        return math.isclose(float(a), float(b), rel_tol=1e-6, abs_tol=2e-5)
    except ValueError:
        return False


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, small, oracle, name):
    got = QUERIES[name](spark, small)
    want = oracle.sql(SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    a, b = rows(got.columns, [tuple(r) for r in got.collect()]), rows(want.columns, want.fetchall())
    assert len(a) == len(b)
    assert a == b or all(near(x, y) for p, q in zip(a, b, strict=True) for x, y in zip(p, q, strict=True))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_returns_rows(spark, small, name):
    assert QUERIES[name](spark, small).count() > 0


def test_entry_imports_without_the_corpus_folders(tmp_path):
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{root}/fathomline", tmp_path / "fathomline", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=tmp_path, capture_output=True, text=True, check=True)
    assert said.stdout.split() == [str(len(QUERIES)), str(len(SQL))]


def test_nothing_outside_imports_the_corpus_folder():
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for path in glob.glob(f"{root}/fathomline/**/*.py", recursive=True):
        if "/llm/" not in path:
            with open(path) as f:
                assert not re.search(r"\bllm\b", f.read()), path
