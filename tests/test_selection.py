"""The k-th value against sorted lists."""

import math
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from rankmill.operators.selection import kth_value, upper_medians


def order(x):
    return (math.isnan(x), 0.0 if math.isnan(x) else x)


def wanted(rows, place):
    by = {}
    for k, v in rows:
        if v is not None:
            by.setdefault(k, []).append(v)
    return {k: sorted(vs, key=order)[place(len(vs))] for k, vs in by.items() if 0 <= place(len(vs)) < len(vs)}


def found(df):
    return {r["k"]: r["out"] for r in df.collect()}


def test_the_kth_value_is_that_of_the_sorted_list(spark):
    roll = random.Random(2)
    rows = [(roll.choice(["hot"] * 6 + ["a", None]), roll.choice([None, 0.0, -1.5, roll.gauss(0, 1), roll.gauss(0, 1) * 1e300, roll.random() * 1e-300, 5e-324, float("inf"), float("-inf"), float("nan")])) for _ in range(3000)]
    rows += [("one", 7.0), ("none", None), ("near", 1.0), ("near", math.nextafter(1.0, 2)), ("near", math.nextafter(1.0, 0)), *[("copies", 3.0)] * 50, ("copies", 2.0), ("zeros", 0.0), ("zeros", -0.0)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(3)
    n = F.col("n")
    for place, of in ((F.floor(n / 2), lambda n: n // 2), (F.lit(0), lambda n: 0), (n - 1, lambda n: n - 1), (F.lit(5), lambda n: 5)):
        got, want = found(kth_value(df, ["k"], "v", place, "out")), wanted(rows, of)
        assert got.keys() == want.keys()
        assert all(got[k] == want[k] or math.isnan(got[k]) and math.isnan(want[k]) for k in want)
    assert found(upper_medians(df.limit(0), ["k"], "v", "out")) == {}


@pytest.mark.parametrize("kind,make", [("bigint", lambda i: 2**60 + i), ("decimal(38,2)", lambda i: Decimal(10) ** 30 + i)])
def test_values_beyond_what_a_double_tells_apart(spark, kind, make):
    values = [make(i * 7 % 101) for i in range(101)]
    df = spark.createDataFrame([("k", v) for v in values], f"k string, v {kind}")
    assert found(upper_medians(df, ["k"], "v", "out")) == {"k": sorted(values)[50]}


def test_one_key_with_all_rows_is_not_one_list(spark):
    df = spark.range(200_000, numPartitions=8).selectExpr("'k' AS k", "cast(hash(id) AS double) / 1000 AS v")
    plan = upper_medians(df, ["k"], "v", "out")
    assert "collect_list" not in plan._jdf.queryExecution().optimizedPlan().toString()
    assert found(plan)["k"] == sorted(r["v"] for r in df.collect())[100_000]
