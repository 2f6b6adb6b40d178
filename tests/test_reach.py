"""Reachability by bits along chains gives what the closure gives, on cycles, diamonds and long chains."""

import random

import pytest
from pyspark.sql import functions as F

from factloom.operators import ontology, reach


def by_hand(edges, names):
    up = {}
    for a, b in edges:
        up.setdefault(a, set()).add(b)
    out = {}
    for n in {x for e in edges for x in e if x is not None}:
        seen, todo = {n}, [n]
        while todo:
            for p in up.get(todo.pop(), ()):
                if p is not None and p not in seen:
                    seen.add(p)
                    todo.append(p)
        out[n] = seen & set(names)
    return out


def told(spark, edges, names):
    df = spark.createDataFrame(edges, "node string, parent string")
    return {r["node"]: set(r["names"]) for r in reach.named(reach.reached(df, names), names).collect()}


GRAPHS = {
    "cycle": [("a", "b"), ("b", "c"), ("c", "a"), ("d", "a"), ("e", "d"), ("c", "x"), ("f", "f")],
    "lone cycle": [("a", "b"), ("b", "c"), ("c", "a"), ("d", "a"), ("z", None)],
    "diamonds": [(f"{i}{s}", f"{i + 1}t") for i in range(6) for s in "lr"] + [(f"{i}t", f"{i}{s}") for i in range(6) for s in "lr"] + [("6t", "x")],
    "apart": [("a", "b"), ("a", "c"), ("b", "x"), ("c", "y"), ("d", "a"), ("d", "z"), ("e", "d")],
}


@pytest.mark.parametrize("name", GRAPHS)
def test_small_graphs(spark, name):
    edges = GRAPHS[name]
    names = sorted({x for e in edges for x in e if x})[::2]
    assert told(spark, edges, names) == by_hand(edges, names)


def test_random_graphs(spark):
    r = random.Random(1)
    for n, m in ((20, 24), (30, 70)):
        edges = [(f"n{r.randrange(n)}", f"n{r.randrange(n)}") for _ in range(m)]
        names = [f"n{i}" for i in range(0, n, 3)]
        assert told(spark, edges, names) == by_hand(edges, names)


def test_a_long_chain_stores_no_pairs(spark):
    n = 100_000
    edges = spark.range(n).select(F.col("id").cast("string").alias("node"), (F.col("id") + 1).cast("string").alias("parent"))
    got = reach.reached(edges, [str(n), "70000", "5"])
    assert got.count() == n + 1
    assert got.where((F.col("node").cast("long") <= 5) != (F.col("m0").bitwiseAND(F.lit(4)) != 0)).count() == 0
    assert got.where((F.col("node").cast("long") <= 70_000) != (F.col("m0").bitwiseAND(F.lit(2)) != 0)).count() == 0
    assert got.where(F.col("m0").bitwiseAND(F.lit(1)) == 0).count() == 0


def test_verdicts_equal_those_of_the_closure(spark):
    edges = spark.createDataFrame([e for g in ("cycle", "diamonds", "apart") for e in GRAPHS[g]], "node string, parent string")
    terms = edges.select(F.col("node").alias("iri")).unionAll(edges.select("parent")).distinct().select("iri", F.lit("o").alias("ontology"), F.lit("class").alias("kind"), (F.col("iri") == "d").alias("deprecated"))
    for field in (ontology.Field(branches=["x", "3t"], exclude_branches=["z"]), ontology.Field(branches=["a"], exclude_terms=["b"], kinds=["class"]), ontology.Field(ontologies=["o"], exclude_branches=["y", "c"]), ontology.Field()):
        want = {tuple(r) for r in ontology.scope(terms, ontology.closure(edges), field).collect()}
        assert {tuple(r) for r in ontology.scope_of(terms, edges, field).collect()} == want


def test_more_names_than_bits(spark):
    edges = [(f"n{i}", f"n{i + 1}") for i in range(140)]
    names = [f"n{i}" for i in range(141)]
    assert told(spark, edges, names) == by_hand(edges, names)


def test_nodes_without_children_are_taken_off_first(spark, monkeypatch):
    edges = [(str(i), str(i // 2)) for i in range(2, 128)] + [(str(i), str(i // 3)) for i in range(10, 128, 5)] + [("900", "901"), ("901", "902"), ("902", "900"), ("903", "901"), ("904", None)]
    rest, rounds = reach.peeled(spark.createDataFrame([e for e in edges if e[1]], "node string, parent string"))
    assert len(rounds) > 3 and rest.count() < 10
    assert told(spark, edges, ["3", "5", "12", "900", "127"]) == by_hand(edges, ["3", "5", "12", "900", "127"])
