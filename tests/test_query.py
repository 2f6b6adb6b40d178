"""Filters, metrics and unit aggregation on small tables with known answers."""

import pytest

from factloom.errors import QueryLookupError, QueryValidationError, Refusal
from factloom.operators import aggregate, filters, provenance
from factloom.types import Table

#: Yields of fields over several cuts: three plots of a limed and two of an unlimed soil; one cut was lost, one plot has none.
ROWS = [
    (11, "north", 7, "limed", 4.0), (12, "north", 7, "limed", 6.5), (13, "mill", 7, "limed", 12.0), (14, "mill", 7, "limed", 3.5), (15, "weir", 8, "limed", 8.0),
    (16, "hill", 7, "bare", 1.0), (17, "hill", 7, "bare", None), (18, "pond", 8, "bare", None),
]
SCHEMA = "source_row long, plot string, month int, soil string, yield double"


@pytest.fixture(scope="module")
def table(spark):
    return Table("rows", spark.createDataFrame(ROWS, SCHEMA), "source_row")


def rows(df):
    return [r.asDict() for r in df.collect()]


def test_row_level_mean_counts_rows(table):
    got = {r["soil"]: r for r in rows(aggregate.aggregate(table, [{"op": "count"}, {"op": "mean", "column": "yield", "name": "m"}, {"op": "sd", "column": "yield", "name": "s"}], ["soil"]))}
    assert got["limed"]["count"] == 5 and got["limed"]["m"] == 6.8
    assert got["bare"]["m"] == 1.0 and got["bare"]["s"] is None and got["bare"]["s:reason"] == "sd is undefined for fewer than 2 non-missing values (n=1)"


def test_unit_level_mean_counts_units(table):
    got = aggregate.aggregate_units(table, [{"op": "mean", "column": "total", "name": "m"}, {"op": "count"}], ["plot", "month"], [{"op": "sum", "column": "yield", "name": "total"}], ["soil"])
    limed = next(r for r in rows(got.groups) if r["soil"] == "limed")
    assert (round(limed["m"], 9), limed["count"], limed["n_units"], limed["n_rows"]) == (round(34 / 3, 9), 3, 3, 5)
    bare = next(r for r in rows(got.groups) if r["soil"] == "bare")
    assert bare["total:units_null"] == 1 and bare["total:units_partial"] == 1
    audit = {r["plot"]: r for r in rows(aggregate.unit_audit(table, ["plot", "month"], ["soil"], listed=["yield"]))}
    assert audit["mill"]["source_rows"] == "13,14" and audit["mill"]["n_rows"] == 2 and audit["mill"]["yield:values"] == "12.0,3.5"


def test_inconsistent_unit_refuses_or_is_excluded(spark):
    t = Table("rows", spark.createDataFrame([*ROWS, (19, "mill", 7, "bare", 2.5)], SCHEMA), "source_row")
    ask = ([{"op": "count"}], ["plot", "month"], [{"op": "sum", "column": "yield", "name": "total"}], ["soil"])
    got = aggregate.aggregate_units(t, *ask)
    assert got.refused() and rows(got.groups) == []
    with pytest.raises(Refusal):
        aggregate.require_consistent(got)
    left = aggregate.aggregate_units(t, *ask, on_inconsistent_unit="exclude")
    assert {r["soil"]: r["n_units"] for r in rows(left.groups)} == {"limed": 2, "bare": 2}


@pytest.mark.parametrize(("values", "total"), [([0.1, 0.2], 0.3), ([1e-13] * 5, 5e-13), ([1e30], 1e30), ([2e12], 2e12), ([0.1] * 10 + [1e-13] * 5 + [1e30, -1e30], 1.0000000000005), ([1e22, 1.0, -1e22], 1.0), ([1e308], 1e308), ([1e-300], 1e-300)])
@pytest.mark.parametrize("scales", [{}, {"v": 4}, {"v": 6}])
def test_sums_neither_round_away_nor_overflow(spark, values, total, scales):
    t = Table("x", spark.createDataFrame([(v,) for v in values], "v double"), None, scales)
    assert rows(aggregate.aggregate(t, [{"op": "sum", "column": "v", "name": "s"}], reasons=False)) == [{"s": total}]


def test_sums_are_exact(spark):
    t = Table("x", spark.createDataFrame([(0.1,), (0.2,)], "v double"))
    assert rows(aggregate.aggregate(t, [{"op": "sum", "column": "v", "name": "s"}], reasons=False)) == [{"s": 0.3}]


def test_empty_table_gives_one_global_group(spark):
    t = Table("x", spark.createDataFrame([], "v double"))
    assert rows(aggregate.aggregate(t, [{"op": "count"}, {"op": "max", "column": "v", "name": "m"}])) == [{"count": 0, "m": None, "m:reason": "no non-missing values"}]


@pytest.mark.parametrize(
    ("rule", "found"),
    [
        ({"column": "yield", "op": "eq", "value": None}, [17, 18]), ({"column": "yield", "op": "ne", "value": 4}, [12, 13, 14, 15, 16, 17, 18]), ({"column": "yield", "op": "eq", "value": "4"}, []), ({"column": "yield", "op": "ne", "value": "4"}, [11, 12, 13, 14, 15, 16, 17, 18]),
        ({"column": "yield", "op": "in", "value": [8, None]}, [15, 17, 18]), ({"column": "yield", "op": "not_in", "value": [4, 8]}, [12, 13, 14, 16, 17, 18]), ({"column": "yield", "op": "not_in", "value": [12, None]}, [11, 12, 14, 15, 16]), ({"column": "yield", "op": "gt", "value": 6}, [12, 13, 15]),
        ({"column": "yield", "op": "in", "value": []}, []), ({"column": "yield", "op": "eq", "value": True}, [16]), ({"column": "soil", "op": "contains", "value": "ar"}, [16, 17, 18]), ({"column": "soil", "op": "gte", "value": "c"}, [11, 12, 13, 14, 15]), ({"column": "yield", "op": "is_missing"}, [17, 18]),
    ],
)
def test_filters(table, rule, found):
    assert [r["source_row"] for r in rows(filters.filter_rows(table, [rule]))] == found


@pytest.mark.parametrize("rule", [{"column": "yield", "op": "lt", "value": "1"}, {"column": "soil", "op": "lt", "value": 1}, {"column": "yield", "op": "contains", "value": "1"}, {"column": "yield", "op": "like", "value": "1"}, {"column": "yield", "op": "eq"}, {"column": "yield", "op": "in", "value": 1}, {"op": "eq", "value": 1}, {"column": "yield", "op": "eq", "value": 1, "x": 2}])
def test_malformed_filters(table, rule):
    with pytest.raises(QueryValidationError):
        filters.predicate(table, rule)


def test_malformed_requests(table):
    with pytest.raises(QueryLookupError):
        filters.predicate(table, {"column": "nope", "op": "is_missing"})
    for bad in ([], [{"op": "sum"}], [{"op": "count", "column": "yield"}], [{"op": "sum", "column": "soil"}], [{"op": "min", "column": "soil"}], [{"op": "count"}, {"op": "count"}], [{"op": "first", "column": "yield"}]):
        with pytest.raises(QueryValidationError):
            aggregate.aggregate(table, bad)
    for unit in ([], ["plot", "plot"]):
        with pytest.raises(QueryValidationError):
            aggregate.aggregate_units(table, [{"op": "count"}], unit)
    with pytest.raises(QueryValidationError):
        aggregate.aggregate_units(table, [{"op": "sum", "column": "yield"}], ["plot"], [{"op": "sum", "column": "yield", "name": "total"}])
    with pytest.raises(QueryValidationError):
        filters.filter_rows(table, [], limit=0)


def test_pages(table):
    assert [r["source_row"] for r in rows(filters.read_rows(table, ["yield"], 2, 3))] == [13, 14, 15]


def test_ranges_merge_over_blocks(spark):
    at = [*range(5), *range(8, 20), 31, 31, None]
    df = spark.createDataFrame([(x,) for x in at], "source_row long")
    got = sorted((r["first"], r["last"]) for r in rows(provenance.ranges(df, "source_row", block=4)))
    assert got == [(0, 4), (8, 19), (31, 31)]
    assert provenance.contributors(Table("t", df, "source_row"), df) == {"scope": "post_filter_pre_metric", "table": "t", "complete": True, "ranges": [[0, 4], [8, 19], [31, 31]], "rows": 18}
    few = provenance.contributors(Table("t", df), spark.createDataFrame([("o", 2), ("o", 2), ("o", None)], "obs string, at int"), ["obs", "at"])
    assert few["objects"] == ['{"at":2,"obs":"o"}', '{"at":null,"obs":"o"}'] and few["complete"]
