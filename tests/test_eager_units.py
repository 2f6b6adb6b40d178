"""Unit aggregation below the join gives what aggregation of joined rows gives, with one shuffle of the left table."""

import itertools
import random

import pytest

from factloom.engine import Engine
from factloom.errors import QueryValidationError, Refusal
from factloom.operators import aggregate as aggregating
from factloom.operators import joins
from factloom.types import Table

FIRST = [{"op": "sum", "column": "left.x", "name": "total"}, {"op": "count", "name": "rows"}, {"op": "median", "column": "left.x", "name": "middle"}]
SECOND = [{"op": "mean", "column": "total", "name": "m"}, {"op": "sd", "column": "middle", "name": "sd"}, {"op": "max", "column": "rows", "name": "most"}]


@pytest.fixture(scope="module")
def sides(spark):
    r = random.Random(3)
    left = [(i, r.choice([None, *range(12)]), r.choice(["a", "b", None]), r.choice([None, 0.5, 1.25, 7.0]), r.choice(["u", "v"])) for i in range(400)]
    left = [(i, k, "ab"[k % 2] if k is not None and k < 9 else g, x, v) for i, k, g, x, v in left]
    right = [(k, r.choice(["p", "q", None]), r.choice([1, 2, None])) for k in range(3, 15)] + [(None, "p", 1)]
    a = Table("rows", spark.createDataFrame(left, "id long, k long, g string, x double, v string"), "id")
    return a, Table("one", spark.createDataFrame(right, "k long, h string, y long"))


def joined(sides, how):
    rows = joins.join(*sides, ["k"], ["k"], how)
    return Table("join", rows)


def told(result):
    return [sorted(map(str, (tuple(r) for r in df.select(*[f"`{c}`" for c in sorted(df.columns)]).collect()))) for df in (result.groups, result.units, result.inconsistent, result.missing)]


GROUPS = [[], ["left.g"], ["right.h"], ["left.g", "right.h"], ["right.h", "left.v"]]
UNITS = [["left.k"], ["left.k", "left.v"], ["left.k", "right.y"]]
FILTERS = [[], [{"column": "left.x", "op": "gt", "value": 0.6}], [{"column": "right.h", "op": "ne", "value": "q"}], [{"column": "right.h", "op": "is_missing"}, {"column": "left.v", "op": "eq", "value": "u"}]]


@pytest.mark.parametrize(("how", "policy"), [("inner", "exclude"), ("left", "exclude"), ("left", "refuse")])
def test_equals_aggregation_of_joined_rows(sides, how, policy):
    for group_by, unit, filters in itertools.islice(itertools.product(GROUPS, UNITS, FILTERS), 1, None, 11):
        assert joins.eager(*sides, ["k"], ["k"], group_by, filters, unit, FIRST)
        got = joins.aggregate_join(*sides, ["k"], ["k"], SECOND, group_by, filters, how, unit, FIRST, policy)
        want = aggregating.aggregate_units(joined(sides, how), SECOND, unit, FIRST, group_by, filters, policy)
        assert got.groups.columns == want.groups.columns
        assert told(got) == told(want), (group_by, unit, filters)


def test_left_table_moves_once(sides):
    got = joins.aggregate_join(*sides, ["k"], ["k"], SECOND[:1], ["right.h"], (), "inner", ["left.k"], FIRST[:1], "exclude").groups
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    join = plan.index("Join Inner")
    assert plan[join:].count("Aggregate") == 1 and "left.v" not in plan, plan  # units are reduced below the join


def test_falls_back(sides, spark):
    a, b = sides
    for group_by, filters, unit, first in ((["right.h"], [], ["left.v"], FIRST), ([], [], ["right.k"], FIRST), ([], [], ["left.k"], [{"op": "sum", "column": "right.y", "name": "total"}])):
        assert not joins.eager(a, b, ["k"], ["k"], group_by, filters, unit, first)
        got = joins.aggregate_join(a, b, ["k"], ["k"], [{"op": "mean", "column": "total", "name": "m"}], group_by, filters, "inner", unit, first, "exclude")
        want = aggregating.aggregate_units(joined(sides, "inner"), [{"op": "mean", "column": "total", "name": "m"}], unit, first, group_by, filters, "exclude")
        assert told(got) == told(want)
    twice = Table("twice", b.df.unionByName(b.df))
    with pytest.raises(QueryValidationError, match="many-to-many"):
        joins.aggregate_join(a, twice, ["k"], ["k"], SECOND, [], (), "inner", ["left.k"], FIRST)
    few = Table("few", a.df.dropDuplicates(["k"]), "id")  # one to many: right rows repeat a unit's rows, so they are joined first
    got = joins.aggregate_join(few, twice, ["k"], ["k"], SECOND, ["right.h"], (), "inner", ["left.k"], FIRST, "exclude")
    want = aggregating.aggregate_units(Table("join", joins.join(few, twice, ["k"], ["k"])), SECOND, ["left.k"], FIRST, ["right.h"], (), "exclude")
    assert told(got) == told(want)


def test_the_service_refuses_units_in_several_groups(sides, spark):
    e = Engine(spark)
    e.register("rows", sides[0].df, "id")
    e.register("one", sides[1].df)
    with pytest.raises(Refusal) as refused:
        e.aggregate_join(SECOND, left="rows", right="one", left_keys=["k"], right_keys=["k"], group_by=["left.v"], unit=["left.k"], unit_metrics=FIRST)
    assert refused.value.payload["groups"] == [] and refused.value.payload["units"]
    with pytest.raises(Refusal):
        e.aggregate("rows", [{"op": "mean", "column": "total", "name": "m"}], ["v"], unit=["k"], unit_metrics=[{"op": "sum", "column": "x", "name": "total"}])
    kept = e.aggregate("rows", [{"op": "mean", "column": "total", "name": "m"}], ["v"], unit=["k", "v"], unit_metrics=[{"op": "sum", "column": "x", "name": "total"}])
    assert kept.groups.count() == 2
