"""Exact medians of large groups by repeated narrowing, without gathering a group's values.

The lower middle rank of a group lies in an open interval of values, at first all of them. A round makes a quantile sketch (mergeable, of
fixed size) of what lies inside, takes the two cell borders around the rank, and counts exactly what lies below, on, between and above
them. The rank is then on a border, which is the answer, or in one of the three open intervals, which is the next one; a sketch that is
wrong about ranks costs a round and no result. A round leaves a few hundredths of the values, and never the borders themselves, so
a value that fills half a group is met and left behind at once. When no more than ``GATHERED`` values are left they are sorted.

A task holds sketches and counters only; a group that is the whole table is spread over all its tasks. Groups of up to ``GATHERED``
values take the plain median in one shuffle. The number of rounds grows with the logarithm of the largest group.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written

#: Values of a group that may be gathered in one task.
GATHERED = 1 << 16
#: Cells of a sketch; its own error is a hundredth of a cell.
CELLS = 100


def same(a: DataFrame, b: DataFrame, names: Sequence[tuple[str, str]]) -> Column:
    return reduce(lambda p, q: p & q, (a[x].eqNullSafe(b[y]) for x, y in names), F.lit(True))


def has_large(df: DataFrame, keys: Sequence[str], column: str, gathered: int | None = None) -> bool:
    """Whether some group has more values than may be gathered."""
    n = F.count(F.col(f"`{column}`"))
    return not df.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(n.alias("n")).where(F.col("n") > (gathered or GATHERED)).isEmpty()


def meet(rows: DataFrame, state: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows beside the state of their group, whose keys are k0, k1, …; without keys the state is one row."""
    if not keys:
        return rows.join(F.broadcast(state), how="cross")
    return rows.join(state, same(rows, state, [(g, f"k{i}") for i, g in enumerate(keys)]))


def inside() -> Column:
    """Whether ``v`` lies in the open interval of its group; null ends are open wide, and not a number is above all numbers."""
    v = F.col("v")
    return (F.col("low").isNull() | (v > F.col("low"))) & (F.col("high").isNull() | (v < F.col("high")))


def medians(df: DataFrame, keys: Sequence[str], column: str, name: str, gathered: int | None = None) -> DataFrame:
    """(keys, name): the exact median of each group's values, null where a group has none; one row over no rows without keys."""
    gathered = gathered or GATHERED
    groups = [f"g{i}" for i in range(len(keys))]
    rows = df.select(*[F.col(f"`{k}`").alias(g) for k, g in zip(keys, groups, strict=True)], F.col(f"`{column}`").cast("double").alias("v"))
    renamed = [F.col(g).alias(k) for k, g in zip(keys, groups, strict=True)]
    n = F.col("n")
    large = rows.groupBy(*groups).agg(F.count("v").alias("n")).where(n > gathered)
    if large.isEmpty():
        return rows.groupBy(*groups).agg(F.median("v").alias("m")).select(*renamed, F.col("m").alias(name))
    state = large.select(*[F.col(g).alias(f"k{i}") for i, g in enumerate(groups)], F.floor((n - 1) / 2).alias("rank"), (n % 2 == 0).alias("even"), F.lit(0).cast("long").alias("before"), n, F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"))
    state = written(state, "large")
    out = selected(rows.where("v is not null"), groups, state, gathered)
    if keys:
        out = out.unionByName(rows.join(state, same(rows, state, [(g, f"k{i}") for i, g in enumerate(groups)]), "left_anti").groupBy(*groups).agg(F.median("v").alias("m")))
    return out.select(*renamed, F.col("m").alias(name))


def selected(rows: DataFrame, keys: Sequence[str], state: DataFrame, gathered: int) -> DataFrame:
    """(keys, m) of the groups in ``state``: rank is the lower middle one from 0, ``before`` values lie under the interval, n inside."""
    own = [f"k{i}" for i in range(len(keys))]
    found: list[DataFrame] = []
    while not state.isEmpty():
        few = state.where(F.col("n") <= gathered)
        lists = meet(rows, few, keys).where(inside()).groupBy(*own, "rank", "even", "before").agg(F.sort_array(F.collect_list("v")).alias("all"))
        found.append(lists.select(*own, "rank", "even", F.get("all", (F.col("rank") - F.col("before")).cast("int")).alias("lower")))
        state = written(narrowed(rows, keys, state.where(F.col("n") > gathered)), "narrowed")
        found.append(state.where("answer is not null").select(*own, "rank", "even", F.col("answer").alias("lower")))
        state = state.where("answer is null").drop("answer")
    lower = written(reduce(DataFrame.unionByName, found), "lower")
    # The upper middle value is the same one, or the least above it.
    v, low = F.col("v"), F.col("lower")
    next_up = meet(rows, lower.where("even"), keys).groupBy(*own, "rank", "lower").agg(F.count_if(v <= low).alias("reach"), F.min(F.when(v > low, v)).alias("above"))
    upper = next_up.select(*own, "lower", F.when(F.col("reach") > F.col("rank") + 1, low).otherwise(F.col("above")).alias("upper"))
    both = lower.where("not even").select(*own, "lower", F.col("lower").alias("upper")).unionByName(upper)
    middle = F.when(F.col("lower").eqNullSafe(F.col("upper")), F.col("lower")).otherwise(F.col("lower") * 0.5 + F.col("upper") * 0.5)
    return both.select(*[F.col(k).alias(g) for k, g in zip(own, keys, strict=True)], middle.alias("m"))


def narrowed(rows: DataFrame, keys: Sequence[str], state: DataFrame) -> DataFrame:
    """One round: the state with its next interval, or with ``answer`` where the rank lies on a border."""
    own = [f"k{i}" for i in range(len(keys))]
    held = ["rank", "even", "before", "n", "low", "high"]
    sketch = meet(rows, state, keys).where(inside()).groupBy(*own, *held).agg(F.percentile_approx("v", [i / CELLS for i in range(CELLS + 1)], 100 * CELLS).alias("q"))
    cell = F.floor((F.col("rank") - F.col("before")) * CELLS / F.col("n")).cast("int")
    borders = written(sketch.select(*own, *held, F.get("q", F.greatest(cell - 1, F.lit(0))).alias("a"), F.get("q", F.least(cell + 2, F.lit(CELLS))).alias("b")), "borders")
    v, a, b = F.col("v"), F.col("a"), F.col("b")
    counts = meet(rows, borders, keys).where(inside()).groupBy(*own, *held, "a", "b").agg(F.count_if(v < a).alias("c0"), F.count_if(v == a).alias("c1"), F.count_if((v > a) & (v < b)).alias("c2"), F.count_if((v == b) & (b > a)).alias("c3"))
    at = F.col("rank") - F.col("before")
    upto = [sum((F.col(f"c{i}") for i in range(k)), F.lit(0)) for k in range(5)]
    pick = lambda below, on_a, between, on_b, above: F.when(at < upto[1], below).when(at < upto[2], on_a).when(at < upto[3], between).when(at < upto[4], on_b).otherwise(above)
    none, start, n = F.lit(None).cast("double"), F.col("before"), F.col("n")
    return counts.select(
        *own, "rank", "even", pick(start, start, start + upto[2], start, start + upto[4]).alias("before"), pick(F.col("c0"), n, F.col("c2"), n, n - upto[4]).alias("n"),
        pick(F.col("low"), none, a, none, b).alias("low"), pick(a, none, b, none, F.col("high")).alias("high"), pick(none, a, none, b, none).alias("answer"),
    )
