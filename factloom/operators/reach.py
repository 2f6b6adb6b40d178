"""Which of some named nodes every node of a graph reaches, without the closure of the graph.

The closure of (node, parent) holds every pair, n^2 / 2 of them for a chain. A scope only asks whether a node reaches one of a few named
branches, so every node carries one bit a name, and bits are combined along paths:

0. Nodes without children are taken off, round by round, while that takes a good part of the edges; they are judged last, by their parents.
1. A node with one parent passes its bits on along the chain: pointers double, so a chain of n ends in log n rounds, at a node that has
   several parents or none. A pointer that has gone further than there are nodes has been round a cycle and has seen all of it.
2. A node of several parents keeps edges to the ends of their chains, with the bits on the way. Edges to the same end are one, so a
   diamond becomes a chain again, and the first step is repeated on what is left.
3. What is left, where parents truly lie apart, exchanges bits until none changes; then the chains are followed back.

Every table has at most as many rows as there are edges and nodes, and shrinks from round to round. Cycles need no care of their own.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written

#: Names that one column of bits holds.
BITS = 62
#: A round of peeling takes at least one edge of so many.
LEAST_SHARE = 4


def bits_of(node: Column, names: Sequence[str]) -> list[Column]:
    """Columns m0, m1, …: the bit of a node that is named."""
    out = []
    for k in range(0, max(len(names), 1), BITS):
        bit = F.lit(0).cast("long")
        for i, name in enumerate(names[k : k + BITS]):
            bit = F.when(node == name, F.lit(1 << i)).otherwise(bit)
        out.append(bit.cast("long").alias(f"m{k // BITS}"))
    return out


def joined_bits(a: str, b: str, marks: Sequence[str]) -> list[Column]:
    """The bits of two sides of a join; a side that is absent has none."""
    return [F.coalesce(F.col(f"{a}.{m}"), F.lit(0)).bitwiseOR(F.coalesce(F.col(f"{b}.{m}"), F.lit(0))).alias(m) for m in marks]


def chains(single: DataFrame, marks: Sequence[str]) -> DataFrame:
    """(node, to, bits, round): nodes of one parent with the end of their chain and the bits from the node up to before that end; ``round`` marks
    those that never end."""
    n = single.count()
    now = single.withColumn("open", F.lit(True))
    for _ in range(math.ceil(math.log2(n + 1)) + 1 if n else 0):
        a, b = now.alias("a"), now.alias("b")
        step = a.join(b, F.col("a.to") == F.col("b.node"), "left")
        on = F.col("b.node").isNotNull()
        now = written(step.select("a.node", F.when(on, F.col("b.to")).otherwise(F.col("a.to")).alias("to"), *joined_bits("a", "b", marks), on.alias("open")), "chains")
        if now.where("open").isEmpty():
            break
    return now.withColumnRenamed("open", "round")


def peeled(edges: DataFrame, small: int = 0) -> tuple[DataFrame, list[DataFrame]]:
    """(rest, rounds) of distinct edges (node, parent): every round holds the edges, with ``single`` for those of a node of one parent, of the nodes
    that no edge of the rounds after it and of the rest leads to. It ends when at most ``small`` edges are left or a round would take less
    than a quarter of them, so all rounds together handle a few times the edges, and their number grows with the logarithm of the edges."""
    degree = edges.groupBy("node").agg((F.count(F.lit(1)) == 1).alias("single"))
    rest = written(edges.join(degree, "node").select("node", "parent", "single"), "peeled")
    left, rounds = rest.count(), []
    while left > small:
        held = rest.select(F.col("parent").alias("node")).distinct().withColumn("held", F.lit(True))
        marked = written(rest.join(held, "node", "left").select("node", "parent", "single", F.col("held").isNull().alias("leaf")), "peeled")
        leaves = marked.where("leaf").count()
        if leaves * LEAST_SHARE < left:
            break
        rounds.append(marked.where("leaf").drop("leaf"))
        rest, left = marked.where("not leaf").drop("leaf"), left - leaves
    return rest.select("node", "parent"), rounds


def reached(edges: DataFrame, names: Sequence[str]) -> DataFrame:
    """(node, m0, m1, …) for all nodes of (node, parent): the bits of the names that a node is or reaches."""
    names = list(dict.fromkeys(names))
    e = edges.select(F.col("node"), F.col("parent").alias("to")).where("node is not null and parent is not null and node != parent").distinct()
    marks = [f"m{k // BITS}" for k in range(0, max(len(names), 1), BITS)]
    zero = [F.lit(0).cast("long").alias(m) for m in marks]
    rest, rounds = peeled(written(e.withColumnRenamed("to", "parent"), "reach-edges"))
    e = written(rest.select("node", F.col("parent").alias("to"), *zero), "reach-edges")
    lone = edges.select(F.col("node")).unionAll(edges.select(F.col("parent").alias("node"))).where("node is not null").distinct()
    if rounds:
        lone = lone.join(functools.reduce(DataFrame.unionByName, [r.select("node") for r in rounds]).distinct(), "node", "left_anti")
    own = written(lone.select("node", *bits_of(F.col("node"), names)), "reach-nodes")
    levels: list[DataFrame] = []
    while True:
        degree = e.groupBy("node").agg(F.count(F.lit(1)).alias("n"))
        alone = degree.where("n = 1").select("node")
        if alone.isEmpty():
            break
        # A node's own bits, and those on its only edge.
        a = e.join(alone, "node").alias("a").join(own.alias("b"), F.col("a.node") == F.col("b.node"))
        chain = written(chains(written(a.select("a.node", "a.to", *joined_bits("a", "b", marks)), "reach-single"), marks), "reach-chains")
        levels.append(chain)
        rest = e.join(alone, "node", "left_anti").alias("a").join(chain.alias("b"), F.col("a.to") == F.col("b.node"), "left")
        # A chain that never ends has shown all its bits: they go to the node, and the edge is done with.
        moved = rest.select("a.node", F.when(F.col("b.node").isNotNull() & ~F.col("b.round"), F.col("b.to")).when(F.col("b.node").isNull(), F.col("a.to")).alias("to"), *joined_bits("a", "b", marks))
        # Edges back to the node itself say nothing but their bits.
        moved = written(moved.withColumn("to", F.when(F.col("to") != F.col("node"), F.col("to"))), "reach-moved")
        gained = moved.where("to is null").groupBy("node").agg(*[F.bit_or(m).alias(m) for m in marks])
        left = own.join(chain.select("node"), "node", "left_anti").alias("a").join(gained.alias("b"), F.col("a.node") == F.col("b.node"), "left")
        own = written(left.select("a.node", *joined_bits("a", "b", marks)), "reach-nodes")
        e = written(moved.where("to is not null").groupBy("node", "to").agg(*[F.bit_or(m).alias(m) for m in marks]), "reach-edges")
    value = own
    while not e.isEmpty():
        over = e.alias("a").join(value.alias("b"), F.col("a.to") == F.col("b.node")).select("a.node", *joined_bits("a", "b", marks)).groupBy("node").agg(*[F.bit_or(m).alias(m) for m in marks])
        after = value.alias("a").join(over.alias("b"), F.col("a.node") == F.col("b.node"), "left")
        changed = F.lit(False)
        for m in marks:
            changed = changed | (F.coalesce(F.col(f"b.{m}"), F.lit(0)).bitwiseAND(F.bitwise_not(F.col(f"a.{m}"))) != 0)
        value = written(after.select("a.node", *joined_bits("a", "b", marks), changed.alias("changed")), "reach-values")
        if value.where("changed").isEmpty():
            break
        value = value.drop("changed")
    value = value.select("node", *marks)
    for chain in reversed(levels):
        # What lies beyond a chain's end; one that never ends has no more to see.
        ends = chain.alias("a").join(value.alias("b"), (F.col("a.to") == F.col("b.node")) & ~F.col("a.round"), "left")
        value = written(value.unionByName(ends.select("a.node", *joined_bits("a", "b", marks))), "reach-values")
    for taken in reversed(rounds):
        over = taken.alias("a").join(value.alias("b"), F.col("a.parent") == F.col("b.node")).groupBy("a.node").agg(*[F.bit_or(f"b.{m}").alias(m) for m in marks])
        its = over.select("node", *[bit.alias(f"own{i}") for i, bit in enumerate(bits_of(F.col("node"), names))], *marks)
        value = value.unionByName(written(its.select("node", *[F.col(m).bitwiseOR(F.col(f"own{i}")).alias(m) for i, m in enumerate(marks)]), "reach-values"))
    return value


def named(found: DataFrame, names: Sequence[str]) -> DataFrame:
    """(node, names): the names that a node is or reaches, as a list."""
    names = list(dict.fromkeys(names))
    hit = [F.when(F.col(f"m{i // BITS}").bitwiseAND(F.lit(1 << (i % BITS))) != 0, F.lit(n)) for i, n in enumerate(names)]
    return found.select("node", F.array_compact(F.array(*hit)).alias("names") if hit else F.array().cast("array<string>").alias("names"))
