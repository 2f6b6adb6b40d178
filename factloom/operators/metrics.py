"""The closed registry of metrics. Every metric that can be null comes with a reason."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import QueryValidationError
from ..types import Table, is_number

COUNTING = ("count", "n_present", "n_missing", "n_distinct")
NUMERIC = ("sum", "mean", "min", "max", "median", "sd", "sem")
OPERATORS = (*COUNTING, *NUMERIC)


def validated(table: Table, specs: Sequence[dict], allow_empty: bool = False) -> list[dict]:
    """Specs {op, column, name} checked against the columns' kinds, names filled in."""
    if not isinstance(specs, list | tuple) or (not specs and not allow_empty):
        raise QueryValidationError("metrics must be a list that is not empty")
    out, names = [], set()
    for spec in specs:
        if not isinstance(spec, dict) or set(spec) - {"op", "column", "name"}:
            raise QueryValidationError(f"a metric has op, column and name only; got {spec!r}")
        op, column = spec.get("op"), spec.get("column")
        if op not in OPERATORS:
            raise QueryValidationError(f"unsupported metric {op!r}; choose from {list(OPERATORS)}")
        if (op == "count") != (column is None):
            raise QueryValidationError("count takes no column" if op == "count" else f"{op} needs a column")
        if column is not None:
            table.require(column)
            if op in NUMERIC and not is_number(table.kinds[column]):
                raise QueryValidationError(f"{op} needs a numeric column; {column!r} is {table.kinds[column]}")
        name = spec.get("name") or (op if column is None else f"{op}:{column}")
        if name in names:
            raise QueryValidationError(f"metric name {name!r} repeats")
        names.add(name)
        out.append({"op": op, "column": column, "name": name})
    return out


def expression(table: Table, spec: dict) -> Column:
    op, name = spec["op"], spec["column"]
    if op == "count":
        return F.count(F.lit(1))
    c = F.col(f"`{name}`")
    if op == "n_present":
        return F.count(c)
    if op == "n_missing":
        return F.count_if(c.isNull())
    if op == "n_distinct":
        return F.count_distinct(c)
    if op == "sum":
        return table.exact_sum(name)
    if op == "mean":
        return table.exact_sum(name) / F.count(c)
    if op in ("min", "max"):
        return (F.min if op == "min" else F.max)(c).cast("double")
    if op == "median":
        return F.median(c)
    spread = F.stddev_samp(c)
    return spread if op == "sd" else spread / F.sqrt(F.count(c))


def reason(spec: dict) -> Column | None:
    """Why the metric is null, or null; None for metrics that never are."""
    op = spec["op"]
    if op in COUNTING:
        return None
    n = F.count(F.col(f"`{spec['column']}`"))
    out = F.when(n == 0, F.lit("no non-missing values"))
    if op in ("sd", "sem"):
        out = out.when(n < 2, F.concat(F.lit(f"{op} is undefined for fewer than 2 non-missing values (n="), n.cast("string"), F.lit(")")))
    return out


def expressions(table: Table, specs: Sequence[dict], reasons: bool = True) -> list[Column]:
    out = [expression(table, s).alias(s["name"]) for s in specs]
    if reasons:
        out += [r.alias(f"{s['name']}:reason") for s in specs if (r := reason(s)) is not None]
    return out
