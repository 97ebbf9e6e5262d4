"""Exact percentiles against sorted lists."""

import math
import random

import pytest
from pyspark.sql import functions as F

from quillmill.operators import evaluation as ev
from quillmill.operators.quantiles import exact_quantiles


def between(values, p):
    at = p * (len(values) - 1)
    low, high = values[math.floor(at)], values[math.ceil(at)]
    return low + (at - math.floor(at)) * (high - low)


@pytest.mark.parametrize("buckets", [2, 7, 64])
def test_percentiles(spark, buckets):
    """Hot, small and null groups, ties and null values, whatever the buckets."""
    r = random.Random(buckets)
    rows = [("hot", float(r.randint(0, 500))) for _ in range(3000)] + [("ties", 7.0)] * 50 + [(None, x / 3) for x in range(11)] + [("one", -1.5), ("none", None), ("two", 1.0), ("two", 4.0), ("two", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    ps = {"a": 0.0, "b": 0.5, "c": 0.95, "d": 1.0, "e": 0.333}
    got = {x["k"]: x for x in exact_quantiles(df, "v", ["k"], ps, {"r0": 0.0, "r1": 0.95, "r2": 1.0}, buckets).collect()}
    groups = {}
    for k, v in rows:
        if v is not None:
            groups.setdefault(k, []).append(v)
    assert set(got) == set(groups)
    for k, values in groups.items():
        values.sort()
        for name, p in ps.items():
            assert got[k][name] == pytest.approx(between(values, p), abs=1e-9), (k, name)
        for name, p in {"r0": 0.0, "r1": 0.95, "r2": 1.0}.items():
            assert got[k][name] == values[max(math.ceil(p * len(values)), 1) - 1]


def test_without_keys(spark):
    df = spark.range(1, 102).select(F.col("id").alias("v"))
    assert tuple(ev.summary(df, "v").first()) == (101, 51.0, 51.0, 96.0, 96.0, 101)
    assert tuple(ev.summary(df.where("v < 0"), "v").first()) == (0, None, None, None, None, None)
    assert ev.summary(df.where("v < 0").withColumn("k", F.lit(1)), "v", ["k"]).collect() == []
