"""Row filters: a closed set of operators, joined by AND, strict about types and explicit about missing values."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import QueryValidationError
from ..types import Table, bounded, comparable, is_number, kind_of_value

OPERATORS = ("eq", "ne", "in", "not_in", "lt", "lte", "gt", "gte", "contains", "is_missing", "is_not_missing")
DEFAULT_ROWS, MOST_ROWS = 100, 1000


def _literal(value: object, dtype: str) -> Column:
    """Numbers and booleans meet as numbers, as 1 equals true."""
    if isinstance(value, bool) and dtype != "boolean":
        value = int(value)
    return F.lit(value)


def _subject(table: Table, name: str, value: object) -> Column:
    c, dtype = F.col(f"`{name}`"), table.kinds[name]
    return c.cast("int") if dtype == "boolean" and kind_of_value(value) in {"integer", "number"} else c


def predicate(table: Table, rule: dict) -> Column:
    """One rule {column, op, value} as an expression that is never null. Kinds that cannot be equal never match, without casting."""
    if not isinstance(rule, dict) or set(rule) - {"column", "op", "value"} or "column" not in rule or "op" not in rule:
        raise QueryValidationError(f"a filter has column, op and value only; got {rule!r}")
    name, op = rule["column"], rule["op"]
    if op not in OPERATORS:
        raise QueryValidationError(f"unsupported filter {op!r}; choose from {list(OPERATORS)}")
    table.require(name)
    c, dtype, value = F.col(f"`{name}`"), table.kinds[name], rule.get("value")
    if op in ("is_missing", "is_not_missing"):
        if "value" in rule and value is not None:
            raise QueryValidationError(f"{op} takes no value")
        return c.isNull() if op == "is_missing" else c.isNotNull()
    if "value" not in rule:
        raise QueryValidationError(f"{op} needs a value")
    if op in ("eq", "ne"):
        if value is None:
            same = c.isNull()
        elif not comparable(dtype, kind_of_value(value)):
            same = F.lit(False)
        else:
            same = _subject(table, name, value).eqNullSafe(_literal(value, dtype))
        return same if op == "eq" else ~same
    if op in ("in", "not_in"):
        if not isinstance(value, list | tuple):
            raise QueryValidationError(f"{op} needs a list")
        fitting = [v for v in value if v is not None and comparable(dtype, kind_of_value(v))]
        held = reduce(lambda a, b: a | b, (_subject(table, name, v).isin(_literal(v, dtype)) for v in fitting)) if fitting and len({kind_of_value(v) for v in fitting}) > 1 else (_subject(table, name, fitting[0]).isin([v if not (isinstance(v, bool) and dtype != "boolean") else int(v) for v in fitting]) if fitting else F.lit(False))
        inside = (c.isNotNull() & held) | (c.isNull() if None in value else F.lit(False))
        return inside if op == "in" else (c.isNull() if None not in value else F.lit(False)) | (c.isNotNull() & ~held)
    if op == "contains":
        if dtype != "string" or not isinstance(value, str):
            raise QueryValidationError(f"contains compares text; {name!r} is {dtype}")
        return c.isNotNull() & c.contains(value)
    given = kind_of_value(value)
    if not (is_number(dtype) and is_number(given)) and not (dtype == "string" and given == "string"):
        raise QueryValidationError(f"{op} cannot order {name!r} ({dtype}) against {value!r} ({given})")
    order = {"lt": c < value, "lte": c <= value, "gt": c > value, "gte": c >= value}[op]
    return c.isNotNull() & order


def conjunction(table: Table, rules: Sequence[dict]) -> Column:
    return reduce(lambda a, b: a & b, (predicate(table, r) for r in rules), F.lit(True))


def filtered(table: Table, rules: Sequence[dict]) -> DataFrame:
    return table.df.where(conjunction(table, rules)) if rules else table.df


def filter_rows(table: Table, rules: Sequence[dict], columns: Sequence[str] | None = None, limit: int = DEFAULT_ROWS) -> DataFrame:
    """The first ``limit`` matching rows in locator order (any order without a locator); the limit is part of the page contract."""
    table.require(*(columns or []))
    page = filtered(table, rules)
    shown = dict.fromkeys([*([table.locator] if table.locator else []), *(columns or table.columns)])
    if table.locator:
        page = page.orderBy(table.locator)
    return page.limit(bounded(limit, MOST_ROWS)).select(*[F.col(f"`{c}`") for c in shown])


def read_rows(table: Table, columns: Sequence[str] | None = None, offset: int = 0, limit: int = DEFAULT_ROWS) -> DataFrame:
    """A page of rows by locator order; the offset counts rows, and the same request gives the same page."""
    table.require(*(columns or []))
    bounded(offset, offset, "offset", 0)
    shown = dict.fromkeys([*([table.locator] if table.locator else []), *(columns or table.columns)])
    page = table.df.orderBy(table.locator) if table.locator else table.df
    return page.offset(offset).limit(bounded(limit, MOST_ROWS)).select(*[F.col(f"`{c}`") for c in shown])
