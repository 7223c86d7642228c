"""Quantiles by narrowing against ``F.percentile`` over whole groups."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fathomline.operators import quantiles

SHARES = [0.0, 0.025, 0.5, 0.731, 0.975, 1.0]


def table(spark, draws):
    rows = [(k, None if x is None else float(x)) for k, values in draws.items() for x in values]
    return spark.createDataFrame(rows, "k string, v double").repartition(5)


def expected(df):
    return {r.k: r.q for r in df.groupBy("k").agg(F.percentile("v", F.array(*map(F.lit, SHARES))).alias("q")).collect()}


DRAW = np.random.default_rng(11)
CASES = {
    "normal": DRAW.standard_normal(3000),
    "far apart": np.exp(DRAW.uniform(-200, 200, 2000)) * DRAW.choice([-1, 1], 2000),
    "ties": DRAW.integers(0, 4, 2500) / 7,
    "one value": np.full(900, -2.5),
    "two": np.array([1e300] * 700 + [-1e300] * 701),
    "small steps": 1e9 + np.arange(1500) * 1e-7,
}


@pytest.mark.parametrize("name", CASES)
def test_same_digits(spark, name):
    df = table(spark, {"hot": CASES[name], None: list(CASES[name][:800]) + [None] * 50, "cold": [3.0, 1.0, 2.0], "none": [None, None]})
    got = {r.k: r.q for r in quantiles.exact_quantiles(df, ["k"], "v", SHARES, "q", whole=100, bins=8, few=20).collect()}
    assert got == expected(df)


def test_plans_without_a_hot_group(spark):
    df = table(spark, {"a": [1.0, 2.0], "b": [5.0]})
    got = {r.k: r.m for r in quantiles.exact_median(df, ["k"], "v", "m").collect()}
    assert got == {"a": 1.5, "b": 5.0} and quantiles.exact_median(df.limit(0), ["k"], "v", "m").collect() == []
