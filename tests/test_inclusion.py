"""All relationships from one grouping of key values: the rows of one assessment each, whatever the number of pairs."""

import random

import pytest

from factloom.operators import inclusion, relationships
from factloom.types import Table


@pytest.fixture(scope="module")
def tables(spark):
    r = random.Random(6)
    some = lambda n, values: [r.choice(values) for _ in range(n)]
    rows = {
        "a": ("k long, s string, f double, t boolean", zip(some(90, [None, *range(30)]), some(90, ["x", "y", " x", None, "NA"]), some(90, [1.0, 2.5, -0.0, None, 7.0]), some(90, [True, False, None]), strict=True)),
        "b": ("k int, s string, f long, t boolean", zip(range(20, 45), some(25, ["x", "z", ""]), some(25, [0, 1, 7, 9]), some(25, [None, True]), strict=True)),
        "c": ("k string, s string, f double, t boolean", zip(map(str, range(10)), some(10, ["q"]), some(10, [None]), some(10, [None]), strict=True)),
        "d": ("k long, s string, f double, t boolean", []),
    }
    return {n: Table(n, spark.createDataFrame(list(v), s)) for n, (s, v) in rows.items()}


KEYS = [("k",), ("s",), ("f",), ("k", "s"), ("s", "t")]


def test_every_pair_equals_its_own_assessment(tables, monkeypatch):
    pairs = [(inclusion.Probe(a, k), inclusion.Probe(b, k)) for a in tables for b in tables if a < b for k in KEYS] + [(inclusion.Probe("a", ("k",)), inclusion.Probe("b", ("f",)))]
    facts, shared = inclusion.measure(tables, [], pairs)
    for a, b in pairs:
        want = relationships.assess(tables[a.table], tables[b.table], a.keys, b.keys).first().asDict()
        assert inclusion.assessed(facts[a], facts[b], shared[a, b]) == want, (a, b)
    monkeypatch.setattr(inclusion, "SIDE_BY_SIDE", 6)
    assert len(inclusion.parts(list(facts), pairs)) > 3
    assert inclusion.measure(tables, [], pairs) == (facts, shared)


def test_jobs_do_not_grow_with_pairs(spark, tables):
    tracker, group = spark.sparkContext.statusTracker(), "pairs"
    wide = {n: Table(n, t.df.selectExpr("k as id", *[f"cast(k as string) as c{i}" for i in range(12)])) for n, t in tables.items()}
    few = {n: Table(n, t.df.select("id", "c0")) for n, t in wide.items()}
    jobs = []
    for i, some in enumerate((few, wide)):
        spark.sparkContext.setJobGroup(f"{group}{i}", "relationships")
        found = relationships.build(spark, "d", some)
        jobs.append(len(tracker.getJobIdsForGroup(f"{group}{i}")))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(found) > 12 and jobs[1] <= jobs[0] + 2, jobs


def test_column_names(tables):
    for name in ("Animal ID", "__x--Y ", "Éa", "a.b", "ID"):
        from pyspark.sql import functions as F

        from factloom.operators.profile import normal_name

        assert tables["a"].df.sparkSession.range(1).select(normal_name(F.lit(name))).first()[0] == relationships.plain_name(name)
