"""How well many keys fit each other, by one grouping of all their values.

Every key of every table is a probe: a column or several, of rows that have it whole. All probes' values are tagged and grouped by
value once; a group holds how often each probe has the value. Everything that is asked of a probe or of a pair of them sums up over the
groups: distinct keys, greatest repetition, shared keys, size of the join. The number of jobs and of scans does not depend on the number
of pairs; each table is read once.

Counts combine before the shuffle, so a value that fills a table is one row a task. Values of kinds that cannot be equal get different
spaces and never meet.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..types import Table, kinds, missing_kind, strip

NUMBERS = ("integer", "number", "boolean")
#: Probes that one grouping counts side by side; more go into further groupings of the same kind.
SIDE_BY_SIDE = 200


@dataclasses.dataclass(frozen=True)
class Probe:
    """The keys of a table that are looked at. With ``cells`` values are read as a profile reads them: as stripped text that is not missing."""

    table: str
    keys: tuple[str, ...]
    cells: bool = False


@dataclasses.dataclass(frozen=True)
class Facts:
    """What is known of a probe: all rows, rows without a whole key, distinct keys, and the most rows of one key."""

    rows: int
    incomplete: int
    distinct: int
    most: int

    @property
    def unique(self) -> bool:
        return self.most == 1


@dataclasses.dataclass(frozen=True)
class Shared:
    """What two probes share: keys, rows of either side with such a key, and the rows of a join."""

    keys: int = 0
    left_rows: int = 0
    right_rows: int = 0
    joined_rows: int = 0


def spelt(name: str, kind: str) -> Column:
    """A key column's value as text: equal texts of one space are equal values. Numbers and booleans share a space."""
    c = F.col(f"`{name}`")
    if kind == "boolean":
        return c.cast("int").cast("string")
    if kind == "number":
        x = c.cast("double")
        return F.when(c.isNotNull(), F.when((x == F.floor(x)) & (F.abs(x) < F.lit(9e18)), x.try_cast("long").cast("string")).otherwise(x.cast("string")))
    return c.cast("string")


def probed(df: DataFrame, own: Sequence[tuple[int, Probe]]) -> DataFrame:
    """(probe, space, value) of all probes of one table by one scan; space and value are null where the key is not whole."""
    known, cells = kinds(df), []
    for at, p in own:
        if p.cells:
            token = F.col(f"`{p.keys[0]}`").cast("string")
            value, space = F.when(missing_kind(token).isin("value", "ambiguous"), strip(token)), "cells"
        elif len(p.keys) == 1:
            value, space = spelt(p.keys[0], known[p.keys[0]]), "numbers" if known[p.keys[0]] in NUMBERS else known[p.keys[0]]
        else:
            parts = [spelt(k, known[k]) for k in p.keys]
            whole = F.lit(True)
            for x in parts:
                whole = whole & x.isNotNull()
            value, space = F.when(whole, F.to_json(F.array(*parts))), ",".join("numbers" if known[k] in NUMBERS else known[k] for k in p.keys)
        cells.append(F.struct(F.lit(at).alias("probe"), F.when(value.isNotNull(), F.lit(space)).alias("space"), value.alias("value")))
    return df.select(F.explode(F.array(*cells)).alias("c")).select("c.*")


def measure(tables: Mapping[str, Table], probes: Sequence[Probe], pairs: Sequence[tuple[Probe, Probe]]) -> tuple[dict[Probe, Facts], dict[tuple[Probe, Probe], Shared]]:
    """Facts of all probes, and of all pairs what they share; one small row for each reaches the driver."""
    probes = list(dict.fromkeys([*probes, *(p for pair in pairs for p in pair)]))
    facts: dict[Probe, Facts] = {}
    shared: dict[tuple[Probe, Probe], Shared] = {}
    for some in parts(probes, list(pairs)):
        measure_together(tables, some, [(a, b) for a, b in pairs if a in some and b in some], facts, shared)
    return facts, shared


def parts(probes: list[Probe], pairs: list[tuple[Probe, Probe]]) -> list[list[Probe]]:
    """Probes in as few lists of ``SIDE_BY_SIDE`` as hold every pair together in one of them."""
    if len(probes) <= SIDE_BY_SIDE:
        return [probes]
    half = [probes[k : k + SIDE_BY_SIDE // 2] for k in range(0, len(probes), SIDE_BY_SIDE // 2)]
    place = {p: k for k, h in enumerate(half) for p in h}
    met = {(min(place[a], place[b]), max(place[a], place[b])) for a, b in pairs} | {(k, k) for k in range(len(half))}
    return [half[a] + half[b] if a != b else half[a] for a, b in sorted(met)]


def measure_together(tables: Mapping[str, Table], probes: Sequence[Probe], pairs: Sequence[tuple[Probe, Probe]], facts: dict[Probe, Facts], shared: dict[tuple[Probe, Probe], Shared]) -> None:
    place = {p: i for i, p in enumerate(probes)}
    rows = None
    for name in dict.fromkeys(p.table for p in probes):
        part = probed(tables[name].df, [(place[p], p) for p in probes if p.table == name])
        rows = part if rows is None else rows.unionAll(part)
    if rows is None:
        return
    groups = rows.groupBy("space", "value").agg(F.array(*[F.count_if(F.col("probe") == i) for i in range(len(probes))]).alias("n"))
    asked = list(dict.fromkeys([(i, i) for i in range(len(probes))] + [(place[a], place[b]) for a, b in pairs]))
    literal = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in asked])
    there = F.filter(literal, lambda p: (F.get("n", p["a"]) > 0) & (F.get("n", p["b"]) > 0))
    met = groups.select(F.col("value").isNotNull().alias("whole"), "n", F.explode(there).alias("p")).select("whole", "p.a", "p.b", F.get("n", F.col("p.a")).alias("x"), F.get("n", F.col("p.b")).alias("y"))
    found = met.groupBy("a", "b").agg(
        F.coalesce(F.sum(F.when(~F.col("whole"), F.col("x"))), F.lit(0)).alias("incomplete"), F.count_if("whole").alias("keys"), F.coalesce(F.max(F.when(F.col("whole"), F.col("x"))), F.lit(0)).alias("most"),
        *[F.coalesce(F.sum(F.when(F.col("whole"), v)), F.lit(0)).alias(k) for k, v in (("left_rows", F.col("x")), ("right_rows", F.col("y")), ("joined_rows", (F.col("x").cast("decimal(38,0)") * F.col("y")).cast("decimal(38,0)")))],
    )
    told = {(r["a"], r["b"]): r for r in found.collect()}
    for p, i in place.items():
        r = told.get((i, i))
        facts[p] = Facts(r["left_rows"] + r["incomplete"], r["incomplete"], r["keys"], r["most"]) if r else Facts(0, 0, 0, 0)
    for a, b in pairs:
        r = told.get((place[a], place[b]))
        shared[a, b] = Shared(r["keys"], r["left_rows"], r["right_rows"], int(r["joined_rows"])) if r else Shared()


def assessed(left: Facts, right: Facts, both: Shared) -> dict[str, object]:
    """The assessment of a relationship from what its sides and their pair come to."""
    cardinality = {(True, True): "one_to_one", (True, False): "one_to_many", (False, True): "many_to_one", (False, False): "many_to_many"}[left.most <= 1, right.most <= 1]
    cover = lambda n: both.keys / n if n else 0.0
    return {
        "left_rows": left.rows, "left_incomplete": left.incomplete, "left_distinct": left.distinct, "right_rows": right.rows, "right_incomplete": right.incomplete, "right_distinct": right.distinct,
        "matched_keys": both.keys, "left_coverage": cover(left.distinct), "right_coverage": cover(right.distinct), "cardinality": cardinality, "joined_rows": both.joined_rows,
    }
