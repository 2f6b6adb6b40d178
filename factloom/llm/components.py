"""Connected components of an edge table by contraction; every round is written to shared storage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def connected(edges: DataFrame) -> DataFrame:
    """(node, label) for every end of ``edges`` (a, b); the label is the smallest node of the component. Loops count as ends.

    A round sends every node to the neighbour (or itself) that comes first in an order of that round's own, replaces the ends
    of all edges by where they went, and drops loops and repeats. Nodes that nobody went to are gone, so edges shrink from
    round to round: a star ends in one round, a path loses about half its nodes, whatever the numbers of the nodes. The rounds'
    tables are then followed back to front, each of them only over the nodes that were left in its round.

    The first nodes of an order are met by many others; minima are combined before their shuffle, and the joins run between
    written tables, where adaptive execution splits a hub.
    """
    pair = lambda a, b: [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]
    now = common.materialise(edges.select(*pair("a", "b")).distinct(), "edges")
    moves: list[DataFrame] = []
    while not moves or not now.isEmpty():
        ends = now.select("a", "b").unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        order = lambda c, salt=len(moves): F.xxhash64(c, F.lit(salt))
        first = ends.groupBy(F.col("a").alias("node")).agg(F.min_by("b", order("b")).alias("near"))
        first = first.select("node", F.when(order("near") < order("node"), F.col("near")).otherwise(F.col("node")).alias("up"))
        move = common.materialise(first, "moves")
        moves.append(move)
        went = now.join(move.toDF("a", "up_a"), "a").join(move.toDF("b", "up_b"), "b").filter("up_a != up_b")
        now = common.materialise(went.select(*pair("up_a", "up_b")).distinct(), "edges")
    found = moves.pop()
    while moves:
        after = found.toDF("up", "root")
        found = moves.pop().join(after, "up", "left").select("node", F.coalesce("root", "up").alias("up"))
    found = common.materialise(found, "roots")
    least = found.groupBy("up").agg(F.min("node").alias("label"))
    return common.materialise(found.join(least, "up").select("node", "label"), "labels")
