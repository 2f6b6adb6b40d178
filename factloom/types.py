"""The type lattice, strict comparisons and missing-value normalisation as Column expressions."""

from __future__ import annotations

import dataclasses

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .convention import DEFAULT, Convention
from .errors import QueryLookupError, QueryValidationError

# What a token must look like to count as a number, with Unicode digits, and what counts as white space.
INTEGER = r"(?U)^[+-]?\d+$"
NUMBER = r"(?U)^[+-]?(?:\d+\.\d*|\.\d+|\d+)(?:[eE][+-]?\d+)?$"
BOOLEAN = r"(?i)^(?:true|false)$"
SPACE = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def kind(data_type: T.DataType) -> str:
    """integer, number, boolean or string; other types stand apart under their own name."""
    if isinstance(data_type, WHOLE):
        return "integer"
    if isinstance(data_type, NUMERIC):
        return "number"
    if isinstance(data_type, T.BooleanType):
        return "boolean"
    if isinstance(data_type, T.StringType):
        return "string"
    return "empty" if isinstance(data_type, T.NullType) else data_type.simpleString()


def kinds(df: DataFrame) -> dict[str, str]:
    return {f.name: kind(f.dataType) for f in df.schema.fields}


def kind_of_value(value: object) -> str:
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, int):
        return "integer"
    if isinstance(value, float):
        return "number"
    return "string" if isinstance(value, str) else "null" if value is None else type(value).__name__


def is_number(name: str) -> bool:
    return name in {"integer", "number"}


def comparable(a: str, b: str) -> bool:
    """Values of these kinds can be equal: numbers and booleans among themselves, strings among strings."""
    numbers = {"integer", "number", "boolean"}
    return a == b or (a in numbers and b in numbers)


def strip(c: Column) -> Column:
    return F.regexp_replace(c, SPACE, "")


def missing_kind(c: Column, convention: Convention = DEFAULT) -> Column:
    """empty, sentinel, ambiguous or value, for a text column."""
    bare = strip(c)
    low = F.lower(bare)
    from .convention import AMBIGUOUS

    out = F.when(c.isNull() | (bare == ""), F.lit("empty"))
    if convention.tokens:
        out = out.when(low.isin(*sorted(convention.tokens)), F.lit("sentinel"))
    return out.when(low.isin(*sorted(AMBIGUOUS)), F.lit("ambiguous")).otherwise(F.lit("value"))


def normalised(c: Column, dtype: str, convention: Convention = DEFAULT) -> Column:
    """A text cell as its column's type: missing becomes null; text that is no such value raises no error but becomes null."""
    present = F.when(~missing_kind(c, convention).isin("empty", "sentinel"), c)
    bare = strip(present)
    if dtype == "integer":
        return F.when(bare.rlike(INTEGER), bare.try_cast("long"))
    if dtype == "number":
        return F.when(bare.rlike(NUMBER), bare.try_cast("double"))
    if dtype == "boolean":
        return F.when(bare.rlike(BOOLEAN), F.lower(bare) == "true")
    return present


def exact_sum(c: Column, dtype: T.DataType, scale: int = 12) -> Column:
    """The sum of a numeric column as a double, exact where decimals hold the values.

    Each value enters the first of these sums that holds it without rounding, which is tested value by value: a decimal of the
    given scale, one for small values, one for large whole ones, and a double for what is left. Nothing is rounded to the
    scale and nothing overflows; each sum leaves eleven digits for the rows. Null where no value is present.
    """
    if isinstance(dtype, T.DecimalType):
        return F.sum(c).cast("double")
    if isinstance(dtype, WHOLE):
        return F.sum(c.cast("decimal(20,0)")).cast("double")
    x = c.cast("double")
    size = F.abs(x)
    steps = [(f"decimal({18 if scale <= 6 else 38},{scale})", size < F.lit(10.0 ** ((18 if scale <= 6 else 27) - scale - 1))), ("decimal(38,26)", size < 1), ("decimal(38,0)", size < 1e27)]
    sums, left = [], F.lit(True)
    for kind, fits in steps:
        d = F.when(fits, x.try_cast(kind))
        whole = F.coalesce(d.cast("double") == x, F.lit(False))
        sums.append(F.coalesce(F.sum(F.when(left & whole, d)).cast("double"), F.lit(0.0)))
        left = left & ~whole
    sums.append(F.coalesce(F.sum(F.when(left, x)), F.lit(0.0)))
    return F.when(F.count(x) > 0, sums[3] + sums[2] + sums[1] + sums[0])


@dataclasses.dataclass(frozen=True)
class Table:
    """A named DataFrame with the column that locates its rows (``locator``; None: no provenance) and known decimal places."""

    name: str
    df: DataFrame
    locator: str | None = None
    scales: dict[str, int] = dataclasses.field(default_factory=dict)

    @property
    def columns(self) -> list[str]:
        return list(self.df.columns)

    @property
    def kinds(self) -> dict[str, str]:
        return kinds(self.df)

    def require(self, *names: str) -> None:
        unknown = [n for n in names if n not in self.columns]
        if unknown:
            raise QueryLookupError(f"unknown column(s) {unknown} in {self.name!r}; available: {self.columns}")

    def exact_sum(self, name: str) -> Column:
        return exact_sum(F.col(f"`{name}`"), self.df.schema[name].dataType, self.scales.get(name, 12))


def bounded(limit: int, most: int, name: str = "limit", least: int = 1) -> int:
    if not isinstance(limit, int) or isinstance(limit, bool) or limit < least:
        raise QueryValidationError(f"{name} must be a whole number of {least} or more")
    return min(limit, most)
