"""Medians by selection equal plain medians, on skewed groups, ties and one group of all-distinct values."""

import random

import pytest
from pyspark.sql import functions as F

from factloom.operators import aggregate as aggregating
from factloom.operators import selection
from factloom.types import Table


@pytest.fixture(scope="module")
def rows(spark):
    r = random.Random(8)
    out = []
    for g, make, n in (("distinct", lambda i: float(i * 7919 % 5000), 5000), ("odd", lambda i: r.expovariate(1) ** 9 * r.choice([-1, 1]), 1501), ("halves", lambda i: float(i % 2), 1000), ("atom", lambda i: 3.25 if i % 3 else r.random(), 1200), ("one", lambda i: 5.0, 900), ("ends", lambda i: [float("-inf"), float("inf"), float("nan"), 1.0][i % 4], 800), ("few", lambda i: r.random(), 10), (None, lambda i: float(i) if i % 2 else None, 1000), ("none", lambda i: None, 3)):
        out += [(g, make(i)) for i in range(n)]
    r.shuffle(out)
    return spark.createDataFrame(out, "g string, v double").repartition(5)


def told(df):
    return sorted((str(a), str(b)) for a, b in (tuple(r) for r in df.collect()))


def test_groups_equal_the_plain_median(rows):
    want = told(rows.groupBy("g").agg(F.median("v")))
    assert told(selection.medians(rows, ["g"], "v", "m", gathered=200)) == want
    assert told(selection.medians(rows, ["g"], "v", "m")) == want


def test_one_group_of_everything(rows, spark):
    for df in (rows, rows.where("g = 'distinct'"), rows.where("g = 'halves'")):
        got = selection.medians(df, [], "v", "m", gathered=20).collect()
        assert [str(r[0]) for r in got] == [str(df.agg(F.median("v")).first()[0])]
    assert selection.medians(rows.where("false"), [], "v", "m").collect()[0][0] is None
    big = spark.range(400_001).select((F.pmod(F.col("id") * 48271, F.lit(400_009)) / 7).alias("v"))
    assert selection.medians(big, [], "v", "m").first()[0] == big.agg(F.median("v")).first()[0]


def test_aggregate_selects_medians_of_large_groups(rows, monkeypatch):
    specs = [{"op": "count", "name": "n"}, {"op": "median", "column": "v", "name": "m"}, {"op": "max", "column": "v", "name": "x"}, {"op": "median", "column": "w", "name": "mw"}]
    t = Table("t", rows.withColumn("w", F.col("v") * 2))
    for group_by in (["g"], []):
        want = aggregating.aggregate(t, specs, group_by)
        monkeypatch.setattr(selection, "GATHERED", 200)
        got = aggregating.aggregate(t, specs, group_by)
        monkeypatch.undo()
        assert got.columns == want.columns and "percentile_approx" not in want._jdf.queryExecution().analyzed().toString()
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
