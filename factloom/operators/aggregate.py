"""Grouped aggregation, and two-stage aggregation by unit of analysis."""

from __future__ import annotations

import dataclasses
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..errors import QueryValidationError, Refusal
from ..session import written
from ..types import Table
from . import filters as filtering
from . import metrics as measuring
from . import selection

MOST_SAMPLE, ROWS_A_UNIT, LISTED_UNITS = 500, 20, 100
POLICIES = ("refuse", "exclude")


def sort_text(table: Table, name: str) -> Column:
    """Groups are ordered by the text of kind and value, so 10 comes before 2 and missing groups stand among the rest."""
    tag = {"integer": "int", "number": "float", "boolean": "bool"}.get(table.kinds[name], "str")
    return F.coalesce(F.concat(F.lit(f"{tag}:"), F.col(f"`{name}`").cast("string")), F.lit("NoneType:None"))


def aggregate(table: Table, metrics: Sequence[dict], group_by: Sequence[str] = (), filters: Sequence[dict] = (), reasons: bool = True) -> DataFrame:
    """One row per group, or one row in all without groups, even over no rows. Partial sums combine before the shuffle."""
    table.require(*group_by)
    specs = measuring.validated(table, metrics)
    rows = filtering.filtered(table, filters)
    return grouped(dataclasses.replace(table, df=rows), specs, group_by, measuring.expressions(table, specs, reasons))


def grouped(table: Table, specs: Sequence[dict], group_by: Sequence[str], cols: Sequence[Column]) -> DataFrame:
    """All columns by group. Medians are selected apart where groups may be large (see ``selection``) and joined by group."""
    rows, middles = table.df, [s for s in specs if s["op"] == "median"]
    if not middles or not any(selection.has_large(rows, group_by, s["column"]) for s in middles):
        return rows.groupBy(*[F.col(f"`{g}`") for g in group_by]).agg(*cols) if group_by else rows.agg(*cols)
    apart = {s["name"] for s in middles}
    rest = [c for s, c in zip(specs, cols, strict=False) if s["name"] not in apart] + list(cols[len(specs) :])
    rest = rest or [F.count(F.lit(1)).alias("__n")]
    out = rows.groupBy(*[F.col(f"`{g}`").alias(f"__g{i}") for i, g in enumerate(group_by)]).agg(*rest) if group_by else rows.agg(*rest)
    for s in middles:
        m = selection.medians(rows, group_by, s["column"], "__m").toDF(*[f"__k{i}" for i in range(len(group_by))], s["name"])
        own = [f"__k{i}" for i in range(len(group_by))]
        out = out.join(m, selection.same(out, m, [(f"__g{i}", k) for i, k in enumerate(own)])).drop(*own) if own else out.join(m, how="cross")  # one row each
    shown = [*(s["name"] for s in specs), *(c for c in out.columns if c.endswith(":reason"))]
    return out.select(*[F.col(f"__g{i}").alias(g) for i, g in enumerate(group_by)], *[F.col(f"`{c}`") for c in shown])


def ordered(table: Table, groups: DataFrame, group_by: Sequence[str]) -> DataFrame:
    """Groups in the contract's order; for pages and reports, where the number of groups is bounded."""
    return groups.orderBy(*[sort_text(table, g) for g in group_by])


def placed(groups: DataFrame, order: Sequence[Column], name: str = "place") -> DataFrame:
    """Groups with their place from 1 in a total order: ranges of the order are numbered in many tasks, and sums of the ranges' sizes say
    where each begins."""
    keys = [c.alias(f"__o{i}") for i, c in enumerate(order)]
    own = [f"__o{i}" for i in range(len(keys))]
    parts = written(groups.select("*", *keys).repartitionByRange(*own).withColumn("__part", F.spark_partition_id()), "placed")
    before = F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))  # one row a range
    starts = parts.groupBy("__part").agg(F.count(F.lit(1)).alias("__n")).withColumn("__before", F.coalesce(before, F.lit(0)))
    inside = F.row_number().over(Window.partitionBy("__part").orderBy(*own))
    return parts.withColumn("__inside", inside).join(starts, "__part").withColumn(name, (F.col("__inside") + F.col("__before")).cast("long")).drop(*own, "__part", "__inside", "__n", "__before")


@dataclasses.dataclass(frozen=True)
class UnitResult:
    """Lazy parts of a two-stage aggregation."""

    groups: DataFrame
    units: DataFrame
    inconsistent: DataFrame
    missing: DataFrame

    def refused(self) -> bool:
        return not self.inconsistent.isEmpty()


def _checked(table: Table, unit: Sequence[str], group_by: Sequence[str], policy: str) -> None:
    if not unit:
        raise QueryValidationError("unit must be a list of columns that is not empty")
    table.require(*unit, *group_by)
    if len(set(unit)) != len(unit):
        raise QueryValidationError("unit columns must not repeat")
    if policy not in POLICIES:
        raise QueryValidationError(f"on_inconsistent_unit is one of {list(POLICIES)}")


def measured(first: Sequence[dict]) -> list[str]:
    return sorted({s["column"] for s in first if s["column"]})


def unkeyed(names: Sequence[str]) -> Column:
    out = F.lit(False)
    for u in names:
        out = out | F.col(f"`{u}`").isNull()
    return out


def reduced(table: Table, rows: DataFrame, unit: Sequence[str], group_by: Sequence[str], first: Sequence[dict]) -> DataFrame:
    """One row a unit: its columns, ``n_rows``, its metrics, how many values each measured column lacks, and the least and the greatest
    group of its rows as ``__least`` and ``__most`` (fields g0, g1, …). One shuffle by unit; rows without a whole unit stay out."""
    group = F.struct(F.lit(0).alias("_"), *[F.col(f"`{g}`").alias(f"g{i}") for i, g in enumerate(group_by)])
    return rows.where(~unkeyed(unit)).groupBy(*[F.col(f"`{u}`") for u in unit]).agg(
        F.count(F.lit(1)).alias("n_rows"), F.min(group).alias("__least"), F.max(group).alias("__most"),
        *[measuring.expression(table, s).cast("double").alias(s["name"]) for s in first],
        *[F.count_if(F.col(f"`{c}`").isNull()).alias(f"missing:{c}") for c in measured(first)],
    )


def aggregate_units(
    table: Table, metrics: Sequence[dict], unit: Sequence[str], unit_metrics: Sequence[dict] = (), group_by: Sequence[str] = (),
    filters: Sequence[dict] = (), on_inconsistent_unit: str = "refuse", reasons: bool = True, units: DataFrame | None = None,
) -> UnitResult:
    """Reduce rows to units, then summarise units per group.

    Stage one is a single shuffle by unit: it computes the unit's metrics and, from the least and the greatest group of its
    rows, whether the unit stays in one group. Stage two sums up consistent units by group. Under ``refuse`` the groups are
    empty as soon as one unit is inconsistent; the test is part of the plan, so nothing runs before the result is asked for.
    ``units`` stands in for stage one where a caller can reduce rows more cheaply (see ``joins.units_below``).
    """
    _checked(table, unit, group_by, on_inconsistent_unit)
    first = measuring.validated(table, unit_metrics, allow_empty=True)
    rows = filtering.filtered(table, filters)
    no_unit = unkeyed(unit)
    missing = rows.where(no_unit)
    by_column = measured(first)
    if units is None:
        units = reduced(table, rows, unit, group_by, first)
    good = F.col("__least").eqNullSafe(F.col("__most"))
    inconsistent = units.where(~good)
    kept = units.where(good).select(*[F.col(f"`{u}`") for u in unit], *[F.col(f"__least.g{i}").alias(f"__g{i}") for i in range(len(group_by))], "n_rows", *[F.col(f"`{s['name']}`") for s in first], *[F.col(f"`missing:{c}`") for c in by_column])
    stage_two = Table("units", kept.select(*[F.col(f"`{s['name']}`") for s in first]) if first else kept.select())
    try:
        second = measuring.validated(stage_two, metrics)
    except QueryValidationError as e:
        raise QueryValidationError(f"{e}. With a unit declared, metrics summarise units and name unit_metrics outputs: {[s['name'] for s in first]}") from e
    except KeyError as e:
        raise QueryValidationError(f"{e}. With a unit declared, metrics summarise units and name unit_metrics outputs: {[s['name'] for s in first]}") from e
    facts = []
    for s in first:
        if s["column"]:
            m = F.col(f"`missing:{s['column']}`")
            facts += [F.count_if(F.col(f"`{s['name']}`").isNull()).alias(f"{s['name']}:units_null"), F.count_if((m > 0) & (m < F.col("n_rows"))).alias(f"{s['name']}:units_partial")]
    cols = [F.count(F.lit(1)).alias("n_units"), F.sum("n_rows").alias("n_rows"), *measuring.expressions(stage_two, second, reasons), *facts]
    source = kept
    if on_inconsistent_unit == "refuse":
        # A refused request has no groups: units join the (single) row that says that there is no inconsistent one.
        source = kept.join(inconsistent.agg(F.count(F.lit(1)).alias("__bad")).where("__bad = 0"), how="cross")
    keys = [F.col(f"__g{i}").alias(g) for i, g in enumerate(group_by)]
    if keys:
        groups = source.groupBy(*keys).agg(*cols)
    else:
        groups = source.agg(*cols).where("n_units > 0")
    listed = kept.select(*[F.col(f"`{u}`") for u in unit], *[k for k, g in zip(keys, group_by, strict=True) if g not in unit], "n_rows", *[F.col(f"`{s['name']}`") for s in first], *[missing_profile(s).alias(f"{s['name']}:rows") for s in first if s["column"]])
    observed = rows.where(~no_unit).join(inconsistent.select(*[F.col(f"`{u}`") for u in unit]), list(unit), "left_semi")
    observed = observed.groupBy(*[F.col(f"`{c}`") for c in dict.fromkeys([*unit, *group_by])]).agg(F.count(F.lit(1)).alias("n_rows"))
    return UnitResult(groups, listed, observed, missing)


def missing_profile(spec: dict) -> Column:
    m = F.col(f"`missing:{spec['column']}`")
    return F.when(m == 0, "complete").when(m == F.col("n_rows"), "all_missing").otherwise("partial")


def unit_audit(table: Table, unit: Sequence[str], group_by: Sequence[str], sample: int = 50, listed: Sequence[str] = ()) -> DataFrame:
    """The first ``sample`` units of each group with their first source rows and, as text, distinct values of listed columns.

    A unit's list of rows is cut while it is gathered: rows are ranked by locator inside the unit, so none is unbounded.
    """
    if table.locator is None:
        raise QueryValidationError("an audit needs a table with a locator")
    if not 0 <= sample:
        raise QueryValidationError("unit_sample must be zero or greater")
    keys = list(dict.fromkeys([*unit, *group_by]))
    rank = F.row_number().over(Window.partitionBy(*unit).orderBy(table.locator))
    rows = table.df.dropna(subset=list(unit)).withColumn("__rank", rank)
    units = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("__rank") <= ROWS_A_UNIT, F.col(table.locator)))), lambda x: x.cast("string")), ",").alias("source_rows"),
    )
    shown = min(sample, MOST_SAMPLE)
    if group_by:
        place = F.row_number().over(Window.partitionBy(*group_by).orderBy(*unit))
        units = units.withColumn("__place", place).where(F.col("__place") <= shown).drop("__place")
    else:
        units = units.orderBy(*unit).limit(shown)
    for c in listed:
        # Values are made distinct and ranked first, so no list outgrows ROWS_A_UNIT.
        few = table.df.dropna(subset=list(unit)).select(*keys, F.col(c).cast("string").alias("__value")).where("__value is not null").distinct()
        few = few.withColumn("__k", F.row_number().over(Window.partitionBy(*keys).orderBy("__value"))).where(F.col("__k") <= ROWS_A_UNIT)
        few = few.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(F.array_join(F.array_sort(F.collect_list("__value")), ",").alias(f"{c}:values"))
        same = F.lit(True)
        for k in keys:
            same = same & F.col(f"`{k}`").eqNullSafe(F.col(f"`__{k}`"))
        units = units.join(few, same, "left").drop(*[f"__{k}" for k in keys])
    return units


def require_consistent(result: UnitResult) -> UnitResult:
    """Raise the refusal that the lazy result would show as empty groups."""
    listed = [r.asDict() for r in result.inconsistent.limit(LISTED_UNITS + 1).collect()]
    if listed:
        raise Refusal("units carry more than one combination of the group columns; a unit cannot be split across groups", units=listed[:LISTED_UNITS], truncated=len(listed) > LISTED_UNITS, groups=[])
    return result
