"""Contributors per group as run-length sets: the ranges, counts and caps that blocks of locators give."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from factloom.operators import provenance


def by_hand(rows, most):
    groups = {}
    for g, h, at in rows:
        groups.setdefault((g, h), set())
        if at is not None:
            groups[g, h].add(at)
    out = {}
    for key, seen in groups.items():
        found = []
        for x in sorted(seen):
            if found and found[-1][1] == x - 1:
                found[-1][1] = x
            else:
                found.append([x, x])
        if seen:
            out[key] = (len(seen), len(found), len(found) <= most, [tuple(f) for f in found] if len(found) <= most else None)
    return out


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(-20, 20), st.integers(0, 6)), max_size=40), st.sampled_from([1, 1 << 58]))
def test_merging(rows, far):
    code, first, n = (np.array([r[i] for r in rows], np.int64) for i in range(3))
    first = first * 1 + np.where(code > 1, far, 0)
    at, a, b = provenance.merged(code, first, first + n)
    got = sorted((int(code[i]), int(x), int(y)) for i, x, y in zip(at, a, b, strict=True))
    want = []
    for c in sorted(set(code.tolist())):
        seen = sorted({x for f, k, d in zip(first.tolist(), code.tolist(), n.tolist(), strict=True) if k == c for x in range(f, f + d + 1)})
        for x in seen:
            if want and want[-1][0] == c and want[-1][2] == x - 1:
                want[-1][2] = x
            else:
                want.append([c, x, x])
    assert got == [tuple(w) for w in want]


@pytest.mark.parametrize("order", ["stored", "scattered"])
def test_groups(spark, order, monkeypatch):
    r = random.Random(2)
    rows = [(r.choice(["a", "a", "b", None]), r.choice([1, 2]), i if i % 17 else None) for i in range(4000)] + [("c", 1, i) for i in range(500)] + [("d", 2, None)] + [("c", 1, 7)] * 3
    if order == "scattered":
        r.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, h long, at long").repartition(3) if order == "scattered" else spark.createDataFrame(rows, "g string, h long, at long")
    monkeypatch.setattr(provenance, "HELD_RANGES", 700)
    for most in (30, 5000):
        got = {(x["g"], x["h"]): (x["rows"], x["n_ranges"], x["complete"], None if x["ranges"] is None else [tuple(y) for y in x["ranges"]]) for x in provenance.contributions(df, "at", ["g", "h"], most).collect()}
        assert got == by_hand(rows, most)
        whole = provenance.contributions(df, "at", [], most).collect()
        want = by_hand([(0, 0, at) for *_, at in rows], most)[0, 0]
        assert [(x["rows"], x["n_ranges"], x["complete"], None if x["ranges"] is None else [tuple(y) for y in x["ranges"]]) for x in whole] == [want]


def test_one_shuffle_by_group(spark):
    seen = []
    real = provenance.written
    df = spark.range(1000).select((F.col("id") % 3).alias("g"), "id")
    try:
        provenance.written = lambda d, name: (seen.append(d._jdf.queryExecution().executedPlan().toString()), real(d, name))[1]
        provenance.contributions(df.where("g < 2"), "id", ["g"]).collect()
    finally:
        provenance.written = real
    assert len(seen) == 1 and seen[0].count("Exchange hashpartitioning") == 1 and "Window" not in seen[0]


def test_answers_carry_their_evidence(spark):
    from factloom.engine import Engine
    from factloom.errors import QueryValidationError

    e = Engine(spark)
    e.register("t", spark.createDataFrame([(1, "a", 1.0), (2, "a", None), (3, None, 3.0), (5, "b", 5.0), (6, "a", 9.0)], "at long, g string, v double"), "at")
    got = e.answer("t", [{"op": "mean", "column": "v", "name": "m"}, {"op": "count", "name": "n"}], ["g"], [{"column": "at", "op": "lt", "value": 6}])
    rows = {r["g"]: (r["m"], r["n"], r["contributing_rows"], [tuple(x) for x in r["ranges"]]) for r in got.groups.collect()}
    assert rows == {"a": (1.0, 2, 2, [(1, 2)]), None: (3.0, 1, 1, [(3, 3)]), "b": (5.0, 1, 1, [(5, 5)])}
    assert got.rows.first().asDict() == {"rows": 5, "filtered_out": 1, "in_missing_groups": 1}
    assert [(d["name"], d["op"], d["kind"], d["missing"]) for d in got.definitions] == [("m", "mean", "number", "left out"), ("n", "count", None, "counted as the metric says")]
    whole = e.answer("t", [{"op": "sum", "column": "v", "name": "s"}]).groups.first()
    assert whole["s"] == 18.0 and [tuple(x) for x in whole["ranges"]] == [(1, 3), (5, 6)]
    none = e.answer("t", [{"op": "sum", "column": "v", "name": "s"}], (), [{"column": "at", "op": "gt", "value": 99}]).groups.collect()
    assert len(none) == 1 and none[0]["s"] is None and none[0]["contributing_rows"] == 0
    e.register("u", spark.range(3))
    with pytest.raises(QueryValidationError):
        e.answer("u", [{"op": "count"}])


def test_ranges_across_blocks_of_blocks(spark, monkeypatch):
    monkeypatch.setattr(provenance, "WIDER", 3)
    r = random.Random(5)
    for density in (0.5, 0.95, 1.0):
        seen = sorted({x for x in range(-40, 400) if r.random() < density})
        want = []
        for x in seen:
            if want and want[-1][1] == x - 1:
                want[-1][1] = x
            else:
                want.append([x, x])
        df = spark.createDataFrame([(x, x % 2 if density < 1 else 0) for x in seen], "at long, g int")
        assert sorted([r["first"], r["last"]] for r in provenance.ranges(df, "at", block=4).collect()) == want
        got = sorted((r["g"], r["first"], r["last"]) for r in provenance.ranges(df, "at", ["g"], block=4).collect())
        assert sum(b - a + 1 for _, a, b in got) == len(seen) and (density < 1 or [[a, b] for _, a, b in got] == want)


def test_places_in_a_total_order(spark):
    from factloom.operators import aggregate

    df = spark.range(2000).select((F.col("id") * 7919 % 2003).alias("k"), (F.col("id") % 3).alias("v"))
    got = [(r["k"], r["place"]) for r in aggregate.placed(df, [F.col("k")]).orderBy("place").collect()]
    assert got == [(k, i + 1) for i, k in enumerate(sorted(r["k"] for r in df.collect()))]
    assert aggregate.placed(df.where("false"), [F.col("k")]).count() == 0


def test_claims_of_any_number(spark):
    from pyspark.errors import PySparkException

    from factloom.operators import evidence

    claims = [("a", "s", [{"check": "file.size", "result": "3", "source": "x"}]), ("a", "s", [{"check": "file.size", "result": "3", "source": "x"}]), ("ü", "t", [{"check": "json.shape", "result": "object", "source": "y"}, {"check": "file.checksum", "result": "", "source": ""}])]
    kind = "claim string, subject string, evidence array<struct<check:string,result:string,source:string>>"
    df = spark.createDataFrame([(c, s, [tuple(e.values()) for e in items]) for c, s, items in claims], kind)
    got = sorted(tuple(r)[:3] for r in evidence.recorded(df).collect())
    assert got == sorted(r[:3] for r in evidence.record(claims))
    for bad in ([("a", "s", [])], [("a", "s", [("none", "", "")])]):
        with pytest.raises(PySparkException, match="needs evidence"):
            evidence.recorded(spark.createDataFrame(bad, kind)).collect()
