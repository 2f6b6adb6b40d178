"""Answer algebra: lookups, comparisons between tables, consistency, recorded sums, rewriting."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import QueryValidationError
from ..types import NUMBER, exact_sum


def blank(c: Column) -> Column:
    return c.isNull() | (F.trim(c.cast("string")) == "")


def exact_number(c: Column) -> Column:
    """The number a text holds; text that is no number stops the job, since a sum must not skip it."""
    text = F.trim(c.cast("string"))
    return F.when(blank(c), None).when(text.rlike(NUMBER), text.try_cast("double")).otherwise(F.raise_error(F.concat(F.lit("not a number: "), text)).cast("double"))


def predicate(name: str, op: str, value: object = None) -> Column:
    """Where-clauses with text and number duality: eq ne in not_in empty nonempty numeric not_numeric regex gt ge lt le span_ge span_lt."""
    c = F.col(f"`{name}`")
    text = F.trim(c.cast("string"))
    number = F.when(text.rlike(NUMBER), text.try_cast("double"))
    false = F.lit(False)
    if op in ("eq", "ne"):
        same = F.coalesce(number == value if isinstance(value, int | float) else text == value, false)
        return same if op == "eq" else ~same
    if op in ("in", "not_in"):
        inside = F.coalesce(text.isin(*[str(v) for v in value]), false)
        return inside if op == "in" else ~inside
    if op in ("empty", "nonempty"):
        return blank(c) if op == "empty" else ~blank(c)
    if op in ("numeric", "not_numeric"):
        return number.isNotNull() if op == "numeric" else number.isNull()
    if op == "regex":
        return F.coalesce(text.rlike(f"^(?:{value})$"), false)
    if op in ("gt", "ge", "lt", "le"):
        return F.coalesce({"gt": number > value, "ge": number >= value, "lt": number < value, "le": number <= value}[op], false)
    if op in ("span_ge", "span_lt"):
        span = r"^([0-9.]+)\s*-\s*([0-9.]+)$"
        length = F.when(text.rlike(span), F.regexp_extract(text, span, 2).try_cast("double") - F.regexp_extract(text, span, 1).try_cast("double"))
        return F.coalesce(length >= value - 1e-6 if op == "span_ge" else length < value - 1e-6, false)
    raise QueryValidationError(f"unsupported predicate {op!r}")


def cell(df: DataFrame, where: Column, column: str) -> object:
    """The one value that the condition picks; none or several is an error."""
    found = df.where(where).select(F.col(f"`{column}`")).limit(2).collect()
    if len(found) != 1:
        raise QueryValidationError(f"{'no row' if not found else 'more than one row'} for {column!r}")
    return found[0][0]


def count(df: DataFrame, column: str | None = None, distinct: bool = False) -> DataFrame:
    if column is None:
        return df.agg(F.count(F.lit(1)).alias("n"))
    c = F.when(~blank(F.col(column)), F.trim(F.col(column).cast("string")))
    return df.agg((F.count_distinct(c) if distinct else F.count(c)).alias("n"))


def total(df: DataFrame, column: str, where: Column | None = None) -> DataFrame:
    """One row: the sum of a column over the rows picked, exact in decimals. A cell that is no number, or blank, stops the job."""
    rows = df if where is None else df.where(where)
    c = F.col(f"`{column}`")
    number = F.when(blank(c), F.raise_error(F.lit(f"a blank cell in {column}")).cast("double")).otherwise(exact_number(c))
    return rows.withColumn("__v", number).agg(F.coalesce(exact_sum(F.col("__v"), T.DoubleType()), F.lit(0.0)).alias("total"))


def row_total(df: DataFrame, columns: Sequence[str], where: Column) -> float:
    """The sum of several columns of the one row that the condition picks."""
    found = df.where(where).select(*[F.when(blank(F.col(f"`{c}`")), F.raise_error(F.lit(f"a blank cell in {c}")).cast("double")).otherwise(exact_number(F.col(f"`{c}`"))).cast("decimal(38,12)").alias(c) for c in columns]).limit(2).collect()
    if len(found) != 1:
        raise QueryValidationError(f"{'no row' if not found else 'more than one row'} for the sum of {list(columns)}")
    return float(sum(found[0]))


def row_totals(df: DataFrame, columns: Sequence[str], name: str = "row_sum") -> DataFrame:
    """Every row with the exact sum of several columns; a row with a blank or a text stops the job."""
    parts = [F.when(blank(F.col(f"`{c}`")), F.raise_error(F.lit(f"a blank cell in {c}")).cast("double")).otherwise(exact_number(F.col(f"`{c}`"))).cast("decimal(28,12)") for c in columns]
    return df.withColumn(name, reduce(lambda a, b: a + b, parts).cast("double"))


def attach(df: DataFrame, other: DataFrame, left_key: Column, right_key: Column, columns: Sequence[str], rows_agree: bool = False) -> tuple[DataFrame, DataFrame]:
    """(rows with ``columns`` of the other table, rows that met no key). The other table's key must be unique; with ``rows_agree``
    it may repeat as long as its rows hold the same values. A key that does not stops the job, since nobody may choose a row."""
    held = other.select(right_key.alias("__key"), F.struct(*[F.col(f"`{c}`") for c in columns]).alias("__held")).where("__key is not null")
    one = held.groupBy("__key").agg(F.count(F.lit(1)).alias("__n"), F.min("__held").alias("__least"), F.max("__held").alias("__most"))
    differ = ~F.col("__least").eqNullSafe(F.col("__most"))
    fault = differ if rows_agree else F.col("__n") > 1
    refused = F.raise_error(F.concat(F.lit("join key is not unique: "), F.col("__key").cast("string"))).cast("boolean")
    one = one.select("__key", F.when(fault, refused).otherwise(True).alias("__found"), F.col("__least").alias("__held"))
    met = df.withColumn("__key", left_key).join(one, "__key", "left")
    plain = [F.col(f"`{c}`") for c in df.columns]
    return met.where("__found").select(*plain, *[F.col(f"__held.`{c}`").alias(c) for c in columns]), met.where("__found is null").select(*plain)


def mapped(c: Column, table: Mapping[str, object]) -> Column:
    """A declared lookup of an answer's text; one that is not listed stops the job."""
    text = F.trim(c.cast("string"))
    out = None
    for k, v in table.items():
        out = F.when(text == k, F.lit(v)) if out is None else out.when(text == k, F.lit(v))
    kind = "string" if any(isinstance(v, str) for v in table.values()) else "double"
    return out.otherwise(F.raise_error(F.concat(F.lit("no mapping for "), F.coalesce(text, F.lit("null")))).cast(kind))


def bundle(parts: Mapping[str, DataFrame]) -> DataFrame:
    """One row with a column per named answer; every part is one row of one column."""
    out = None
    for name, part in parts.items():
        one = part.toDF(name)
        out = one if out is None else out.join(one, how="cross")  # one row each
    return out


ABSTAIN = "ABSTAIN"


def abstain(evidence: Sequence[tuple[DataFrame, object]]) -> str:
    """The answer that says that the data do not decide; what it rests on is checked and not asserted."""
    for found, expected in evidence:
        got = found.first()
        if got is None or got[0] != expected:
            raise QueryValidationError(f"the evidence for an abstention no longer holds: {None if got is None else got[0]!r}, expected {expected!r}")
    return ABSTAIN


def raw_cell(sheet: DataFrame, row: int, letter: str) -> object:
    """A cell of an unparsed sheet (``row`` and one column per letter)."""
    return cell(sheet, F.col("row") == row, letter)


def raw_range(sheet: DataFrame, letter: str, first: int, last: int, regex: str | None = None) -> DataFrame:
    """Distinct non-empty values of a column of an unparsed sheet between two rows, those alone that match the whole pattern."""
    c = F.col(f"`{letter}`").cast("string")
    keep = F.col("row").between(first, last) & c.isNotNull() & (c != "")
    if regex:
        keep = keep & c.rlike(f"^(?:{regex})$")
    return sheet.where(keep).select(c.alias("value")).distinct()


def values(df: DataFrame, column: str) -> DataFrame:
    """Distinct values that are not blank, as text."""
    return df.where(~blank(F.col(column))).select(F.trim(F.col(column).cast("string")).alias("value")).distinct()


def group_count(df: DataFrame, by: Sequence[str], column: str | None = None) -> DataFrame:
    """Rows, or distinct values of a column, per group; rows with a blank key are left out."""
    rows = df
    for b in by:
        rows = rows.where(~blank(F.col(b)))
    n = F.count(F.lit(1)) if column is None else F.count_distinct(F.when(~blank(F.col(column)), F.col(column)))
    return rows.groupBy(*by).agg(n.alias("n"))


def group_stats(df: DataFrame, unit: str, by: str, value: str, reduce: str = "mean", scale: int = 6, lookup: tuple[DataFrame, str, str, Sequence[str]] | None = None) -> DataFrame:
    """n, mean, sd and sem of units per group; each unit is reduced to one number first and must stay in one group. ``lookup`` is
    (table, left key, right key, columns): those columns are attached first, and rows without a match drop out."""
    if lookup:
        other, left_key, right_key, columns = lookup
        df, _ = attach(df, other, F.col(left_key), F.col(right_key), columns)
    total = exact_sum(F.col(value), df.schema[value].dataType, scale)
    if reduce not in ("single", "sum", "mean"):
        raise QueryValidationError(f"reduce is single, sum or mean; got {reduce!r}")
    v = {"sum": total, "mean": total / F.count(value), "single": F.max(value).cast("double")}[reduce]
    units = df.where(F.col(unit).isNotNull() & F.col(by).isNotNull()).groupBy(unit).agg(v.alias("v"), F.min(by).alias("g0"), F.max(by).alias("g1"), F.count(value).alias("k"))
    fault = F.when(F.col("g0") != F.col("g1"), F.raise_error(F.lit("a unit lies in two groups")).cast("double"))
    if reduce == "single":
        fault = fault.when(F.col("k") > 1, F.raise_error(F.lit("a unit has more than one value")).cast("double"))
    units = units.withColumn("v", F.coalesce(fault, F.col("v"))).where("v is not null")
    return units.groupBy(F.col("g0").alias(by)).agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("sd"), (F.stddev_samp("v") / F.sqrt(F.count(F.lit(1)))).alias("sem"))


def repeated(df: DataFrame, key: str) -> DataFrame:
    """(key, n): keys that stand in more than one row; a comparison by that key has to say how to reduce them."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def keyed_values(df: DataFrame, key: str, value: str, reduce: str | None, name: str, scale: int = 12) -> DataFrame:
    """One value a key. Without ``reduce`` a repeated key fails the query; with it (sum or mean) a row without a number does."""
    if reduce not in (None, "sum", "mean"):
        raise QueryValidationError(f"reduce is sum or mean; got {reduce!r}")
    n, kind = F.count(F.lit(1)), df.schema[value].dataType
    if reduce:
        total = exact_sum(F.col(value), kind, scale)
        fault, v = F.count(value) < n, total if reduce == "sum" else total / F.count(value)
        why = F.lit(f"a row of this unit has no number in {value}: ")
    else:
        fault, v, why = n > 1, F.max(value), F.lit("a key repeats and no reduce is declared: ")
    text = F.coalesce(F.first(F.col(key)).cast("string"), F.lit(""))
    rows = df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("__key"))
    return rows.agg(F.when(fault, F.raise_error(F.concat(why, text)).cast(kind if not reduce else "double")).otherwise(v).alias(name), F.lit(True).alias(f"in_{name}"))


def compare(a: DataFrame, b: DataFrame, key: str, value: str, tolerance: float = 0.0, reduce: str | None = None, reduce_b: str | None = None) -> DataFrame:
    """One row: keys compared, mismatching, only in a, only in b. Each side holds one value per key, or says how its rows become one."""
    x, y = keyed_values(a, key, value, reduce, "x"), keyed_values(b, key, value, reduce_b or reduce, "y")
    both = x.join(y, "__key", "full_outer")
    differ = ~F.col("x").eqNullSafe(F.col("y")) if not tolerance else F.coalesce(F.abs(F.col("x") - F.col("y")) > tolerance, ~F.col("x").eqNullSafe(F.col("y")))
    shared = F.col("in_x").isNotNull() & F.col("in_y").isNotNull()
    return both.agg(F.count_if(shared).alias("compared"), F.count_if(shared & differ).alias("mismatches"), F.count_if(F.col("in_y").isNull()).alias("only_in_a"), F.count_if(F.col("in_x").isNull()).alias("only_in_b"))


def consistency(tables: Sequence[DataFrame], key: str, value: str) -> DataFrame:
    """Keys whose value differs somewhere among the tables, with how many values they have."""
    rows = tables[0].select(key, value)
    for t in tables[1:]:
        rows = rows.unionByName(t.select(key, value))
    return rows.where(F.col(key).isNotNull() & F.col(value).isNotNull()).groupBy(key).agg(F.count_distinct(value).alias("n_values")).where("n_values > 1")


def sum_check(df: DataFrame, recorded: Column, parts: Column, tolerance: float = 1e-9) -> DataFrame:
    """One row: rows checked, and rows whose recorded total differs from the parts."""
    known = recorded.isNotNull() & parts.isNotNull()
    return df.agg(F.count_if(known).alias("checked"), F.count_if(known & (F.abs(recorded - parts) > tolerance)).alias("mismatches"))


def set_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.subtract(b)


def transform(c: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The first rule whose pattern matches the whole text rewrites it; text that none matches becomes null."""
    text = F.trim(c.cast("string"))
    out = F.lit(None).cast("string")
    for pattern, to in reversed(rules):
        out = F.when(text.rlike(f"^(?:{pattern})$"), F.regexp_replace(text, f"^(?:{pattern})$", to)).otherwise(out)
    return out


def template(parts: Sequence[str | Column]) -> Column:
    """Text from literals and columns; null when one column is blank."""
    columns = [p for p in parts if not isinstance(p, str)]
    lack = F.lit(False)
    for c in columns:
        lack = lack | blank(c)
    return F.when(~lack, F.concat(*[F.lit(p) if isinstance(p, str) else F.trim(p.cast("string")) for p in parts]))


def _text(c: Column) -> Column:
    return F.lower(F.regexp_replace(F.trim(c.cast("string")), r"\s+", " "))


def _set(c: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(F.from_json(c, "array<string>"), _text)))


def right(rule: Column, expected: Column, given: Column, absolute: Column, relative: Column | None = None) -> Column:
    """Whether a given answer is right by its question's rule: number, integer, boolean, set, table or object, else exact text.

    Numbers may differ by ``absolute`` or ``relative`` of what is expected; sets are JSON lists; tables and objects are JSON texts
    compared as maps from field to text (a table's rows are a list of such maps)."""
    x, y = F.trim(expected.cast("string")).try_cast("double"), F.trim(given.cast("string")).try_cast("double")
    numbers = x.isNotNull() & y.isNotNull()
    limit = absolute if relative is None else F.greatest(absolute, F.abs(x) * relative)
    said = F.when(_text(given).isin("true", "yes"), True).when(_text(given).isin("false", "no"), False)
    pairs = lambda c: F.array_sort(F.transform(F.map_entries(F.from_json(c, "map<string,string>")), lambda e: F.concat_ws("=", e["key"], _text(e["value"]))))
    rows = lambda c: F.array_sort(F.transform(F.from_json(c, "array<map<string,string>>"), lambda m: F.array_join(F.array_sort(F.transform(F.map_entries(m), lambda e: F.concat_ws("=", e["key"], _text(e["value"])))), "|")))
    test = F.when(rule == "number", numbers & (F.abs(x - y) <= limit + 1e-12)).when(rule == "integer", numbers & (x == y)).when(rule == "boolean", said == (_text(expected) == "true"))
    test = test.when(rule == "set", _set(expected) == _set(given)).when(rule == "object", pairs(expected) == pairs(given)).when(rule == "table", rows(expected) == rows(given))
    return F.coalesce(test.otherwise(F.when(numbers, x == y).otherwise(_text(expected) == _text(given))), F.lit(False))


# The outcomes of a scored answer and what each is worth.
POINTS = {"correct": 1, "correct_abstention": 1, "incorrect": 0, "over_abstention": 0, "missing": 0, "confident_on_unanswerable": -1}


def outcomes(expected: DataFrame, answers: DataFrame, key: str) -> DataFrame:
    """(key, kind, outcome) over expected (key, kind, rule, expected, tolerance) and answers (key, answer); an expected or given
    answer abstains by ``ABSTAIN``."""
    both = expected.join(answers.select(key, F.col("answer").cast("string").alias("given")), key, "left")
    should, did = F.col("expected") == ABSTAIN, F.upper(F.trim("given")) == ABSTAIN
    ok = right(F.col("rule"), F.col("expected"), F.col("given"), F.coalesce("tolerance", F.lit(0.0)))
    state = F.when(F.col("given").isNull(), "missing").when(should & did, "correct_abstention").when(should, "confident_on_unanswerable").when(did, "over_abstention").when(ok, "correct").otherwise("incorrect")
    return both.select(key, "kind", state.alias("outcome"))


def points(judged: DataFrame) -> DataFrame:
    """(kind, asked, points)."""
    worth = F.lit(0)
    for outcome, n in POINTS.items():
        worth = F.when(F.col("outcome") == outcome, n).otherwise(worth)
    return judged.groupBy("kind").agg(F.count(F.lit(1)).alias("asked"), F.sum(worth).cast("long").alias("points"))


def score(expected: DataFrame, answers: DataFrame, key: str, kind: str, tolerance: float = 1e-6) -> DataFrame:
    """Per kind of question: asked, answered, right. Numbers compare within the tolerance, anything else as lower-case text."""
    a = answers.select(key, F.col("answer").cast("string").alias("given"))
    both = expected.join(a, key, "left")
    want, got = F.trim(F.col("expected").cast("string")), F.trim(F.col("given"))
    x, y = want.try_cast("double"), got.try_cast("double")
    right = F.coalesce(F.when(x.isNotNull() & y.isNotNull(), F.abs(x - y) <= tolerance).otherwise(F.lower(want) == F.lower(got)), F.lit(False))
    return both.groupBy(kind).agg(F.count(F.lit(1)).alias("asked"), F.count("given").alias("answered"), F.count_if(right).alias("right"))
