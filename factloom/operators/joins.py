"""Equi-joins on declared keys, with diagnostics from key counts, refusals, and aggregation over joined rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import QueryLookupError, QueryValidationError, Refusal
from ..types import Table, comparable
from . import aggregate as aggregating
from . import filters as filtering
from . import identity

KINDS = ("inner", "left")


def _checked(left: Table, right: Table, left_keys: Sequence[str], right_keys: Sequence[str], how: str) -> None:
    if how not in KINDS:
        raise QueryValidationError(f"a join is one of {list(KINDS)}; got {how!r}")
    checked_keys(left, right, left_keys, right_keys)


def checked_keys(left: Table, right: Table, left_keys: Sequence[str], right_keys: Sequence[str]) -> None:
    if not left_keys or len(left_keys) != len(right_keys):
        raise QueryValidationError("left_keys and right_keys must be of one length and not empty")
    left.require(*left_keys)
    right.require(*right_keys)


def _sides(left: Table, right: Table) -> tuple[DataFrame, DataFrame]:
    return left.df.select(*[F.col(f"`{c}`").alias(f"left.{c}") for c in left.df.columns]), right.df.select(*[F.col(f"`{c}`").alias(f"right.{c}") for c in right.df.columns])


def condition(left: Table, right: Table, left_keys: Sequence[str], right_keys: Sequence[str]) -> Column:
    """All keys equal. Numbers and booleans meet as numbers; text meets text only: nothing is cast to make a match."""
    parts = []
    for a, b in zip(left_keys, right_keys, strict=True):
        x, y = F.col(f"`left.{a}`"), F.col(f"`right.{b}`")
        ka, kb = left.kinds[a], right.kinds[b]
        if not comparable(ka, kb):
            return F.lit(False)
        if ka != kb and "boolean" in (ka, kb):
            x, y = x.cast("double"), y.cast("double")
        parts.append(x == y)
    return reduce(lambda p, q: p & q, parts)


def join(left: Table, right: Table, left_keys: Sequence[str], right_keys: Sequence[str], how: str = "inner", left_columns: Sequence[str] | None = None, right_columns: Sequence[str] | None = None) -> DataFrame:
    """Joined rows with columns named ``left.x`` and ``right.x``. Rows without a whole key match nothing."""
    _checked(left, right, left_keys, right_keys, how)
    a, b = _sides(left, right)
    out = a.join(b, condition(left, right, left_keys, right_keys), how)
    left.require(*(left_columns or []))
    right.require(*(right_columns or []))
    shown = [f"left.{c}" for c in left_columns or left.df.columns] + [f"right.{c}" for c in right_columns or right.df.columns]
    return out.select(*[F.col(f"`{c}`") for c in shown])


def key_counts(table: Table, keys: Sequence[str]) -> DataFrame:
    """(k0, k1, …, n) over rows with a whole key."""
    return table.df.dropna(subset=list(keys)).groupBy(*[F.col(f"`{k}`").alias(f"k{i}") for i, k in enumerate(keys)]).agg(F.count(F.lit(1)).alias("n"))


def diagnostics(left: Table, right: Table, left_keys: Sequence[str], right_keys: Sequence[str], how: str = "inner") -> DataFrame:
    """One row about the join without making it: rows, incomplete keys, distinct keys, matches, result rows, cardinality.

    Each side shuffles its keys once, as partial counts; the join of the two count tables reuses that partitioning, and the
    result is one row. The joined table itself may be far larger than both sides and is never built here.
    """
    _checked(left, right, left_keys, right_keys, how)
    l, r = key_counts(left, left_keys), key_counts(right, right_keys)
    names = [f"k{i}" for i in range(len(left_keys))]
    if not all(comparable(left.kinds[a], right.kinds[b]) for a, b in zip(left_keys, right_keys, strict=True)):
        l, r = l.withColumns({n: F.concat(F.lit("l"), F.col(n).cast("string")) for n in names}), r.withColumns({n: F.concat(F.lit("r"), F.col(n).cast("string")) for n in names})
    both = l.withColumnRenamed("n", "ln").join(r.withColumnRenamed("n", "rn"), names, "full_outer")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    facts = both.agg(
        zero(F.sum("ln")).alias("left_complete"), zero(F.sum("rn")).alias("right_complete"),
        F.count("ln").alias("left_distinct"), F.count("rn").alias("right_distinct"),
        F.count_if(F.col("ln").isNotNull() & F.col("rn").isNotNull()).alias("matched_keys"),
        zero(F.sum(F.when(F.col("rn").isNotNull(), F.col("ln")))).alias("left_matched_rows"),
        zero(F.sum(F.when(F.col("ln").isNotNull(), F.col("rn")))).alias("right_matched_rows"),
        zero(F.sum(F.col("ln") * F.col("rn"))).alias("inner_rows"),
        (F.coalesce(F.max("ln"), F.lit(0)) <= 1).alias("left_unique"), (F.coalesce(F.max("rn"), F.lit(0)) <= 1).alias("right_unique"),
    )
    rows = left.df.agg(F.count(F.lit(1)).alias("left_rows")).join(right.df.agg(F.count(F.lit(1)).alias("right_rows")), how="cross")  # one row each
    out = rows.join(facts, how="cross")
    total = F.col("inner_rows") + (F.col("left_rows") - F.col("left_matched_rows") if how == "left" else F.lit(0))
    return out.select(
        "left_rows", "right_rows", (F.col("left_rows") - F.col("left_complete")).alias("left_incomplete"), (F.col("right_rows") - F.col("right_complete")).alias("right_incomplete"),
        "left_distinct", "right_distinct", "matched_keys", "left_matched_rows", "right_matched_rows", total.alias("total_result_rows"), cardinality().alias("cardinality"),
    )


def cardinality() -> Column:
    l, r = F.col("left_unique"), F.col("right_unique")
    return F.when(l & r, "one_to_one").when(l, "one_to_many").when(r, "many_to_one").otherwise("many_to_many")


def resolved_join(
    left: Table, right: Table, left_keys: Sequence[str], right_keys: Sequence[str], how: str = "inner", crosswalk: DataFrame | None = None,
    left_key_format: str | None = None, right_key_format: str | None = None, forms_per_canonical: Sequence[str] = (), check: bool = True,
) -> DataFrame:
    """A join on resolved keys: ``left.x``, ``right.x`` and ``key.canonical_id``, ``key.mapping``, ``key.left_form``, ``key.right_form``.

    Rendered texts that hide different raw keys always refuse; a canonical id in several forms refuses unless that side is
    declared to write many (``forms_per_canonical`` names the sides). Both tests are grouped counts, run before the join.
    """
    if how not in KINDS:
        raise QueryValidationError(f"a join is one of {list(KINDS)}; got {how!r}")
    if unknown := sorted(set(forms_per_canonical) - {"left", "right"}):
        raise QueryValidationError(f"forms_per_canonical names the sides left and right; got {unknown}")
    if forms_per_canonical and crosswalk is None:
        raise QueryValidationError("several forms of an id need a crosswalk that gives ids")
    a = identity.resolve(left, left_keys, left_key_format, crosswalk)
    b = identity.resolve(right, right_keys, right_key_format, crosswalk)
    if check:
        for name, side in (("left", a), ("right", b)):
            refuse(name, "rendering collision", identity.rendering_collisions(side))
            if crosswalk is not None and name not in forms_per_canonical:
                refuse(name, "crosswalk collision", identity.crosswalk_collisions(side))
    x = a.rows.select(*[F.col(f"`{c}`").alias(f"left.{c}") for c in left.df.columns], F.col("__space").alias("ls"), F.col("__key").alias("lk"), F.col("__text").alias("key.left_form"))
    y = b.rows.select(*[F.col(f"`{c}`").alias(f"right.{c}") for c in right.df.columns], F.col("__space").alias("rs"), F.col("__key").alias("rk"), F.col("__text").alias("key.right_form"))
    out = x.join(y, (F.col("ls") == F.col("rs")) & (F.col("lk") == F.col("rk")), how)
    return out.withColumn("key.canonical_id", F.col("lk")).withColumn("key.mapping", F.col("ls")).drop("ls", "lk", "rs", "rk")


def resolved_sides(left: Table, right: Table, left_keys: Sequence[str], right_keys: Sequence[str], crosswalk: DataFrame | None = None, left_key_format: str | None = None, right_key_format: str | None = None) -> tuple[Table, Table]:
    """Both tables with their compared key in ``__space`` and ``__key``, null where a row lacks part of it."""
    a = identity.resolve(left, left_keys, left_key_format, crosswalk)
    b = identity.resolve(right, right_keys, right_key_format, crosswalk)
    return Table(left.name, a.rows), Table(right.name, b.rows)


def resolved_diagnostics(left: Table, right: Table, left_keys: Sequence[str], right_keys: Sequence[str], how: str = "inner", **resolved: object) -> DataFrame:
    """``diagnostics`` on the keys that the join compares: canonical ids and rendered texts, not the columns as they stand."""
    keep = {k: v for k, v in resolved.items() if k in ("crosswalk", "left_key_format", "right_key_format")}
    return diagnostics(*resolved_sides(left, right, left_keys, right_keys, **keep), ["__space", "__key"], ["__space", "__key"], how)


def remarks(facts: DataFrame) -> DataFrame:
    """The facts with ``replicated`` (sides whose rows the join repeats) and ``warning``, null where there is nothing to say."""
    c = F.col("cardinality")
    replicated = F.when(c == "one_to_many", "left").when(c == "many_to_one", "right").when(c == "many_to_many", "left,right")
    said = F.when(c == "many_to_many", "both sides repeat keys, so each key gives the product of its rows").when(c != "one_to_one", F.concat(F.lit("rows of the "), replicated, F.lit(" side repeat in the result; a metric over its columns counts them once per match")))
    return facts.withColumn("replicated", replicated).withColumn("warning", said)


def refuse(side: str, what: str, found: DataFrame) -> None:
    listed = [r.asDict() for r in found.limit(identity.SHOWN).collect()]
    if listed:
        raise Refusal(f"{what} on the {side} side", content_withheld=True, collisions=listed)


def page(left: Table, right: Table, left_keys: Sequence[str], right_keys: Sequence[str], rows: DataFrame, limit: int) -> DataFrame:
    """The first joined rows in the order of the left and then the right locator; left rows without a whole key come last."""
    lack = F.lit(False)
    for k in left_keys:
        lack = lack | F.col(f"`left.{k}`").isNull()
    place = [F.col(f"`{side}.{t.locator}`") for side, t in (("left", left), ("right", right)) if t.locator and f"{side}.{t.locator}" in rows.columns]
    rest = [] if len(place) == 2 else [F.col(f"`{c}`") for c in rows.columns if c.startswith(("left.", "right."))]
    return rows.orderBy(lack, *place, *rest).limit(limit)


def mapping_counts(rows: DataFrame) -> DataFrame:
    """One row about the rows that an aggregate over a resolved join used: how many compared through the crosswalk, by their own
    text or by nothing, and how many distinct keys stand behind them."""
    space = F.col("`key.mapping`")
    return rows.agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(space == "canonical").alias("canonical_rows"), F.count_if(space == "unmapped").alias("unmapped_rows"), F.count_if(space == "rendered").alias("rendered_rows"),
        F.count_if(space.isNull()).alias("keyless_rows"), F.count_distinct(F.when(space.isNotNull(), F.struct(space, F.col("`key.canonical_id`")))).alias("keys"),
    )


def split_qualified(name: str) -> tuple[str, str]:
    """``left.x``: the side is what stands before the first dot."""
    side, dot, column = name.partition(".")
    if not dot or side not in ("left", "right", "key") or not column:
        raise QueryValidationError(f"{name!r} must be qualified as left.…, right.… or key.…")
    return side, column


def unique(table: Table, keys: Sequence[str]) -> bool:
    """Whether no whole key occurs twice."""
    return key_counts(table, keys).where("n > 1").isEmpty()


def eager(left: Table, right: Table, left_keys: Sequence[str], right_keys: Sequence[str], group_by: Sequence[str], filters: Sequence[dict], unit: Sequence[str], unit_metrics: Sequence[dict]) -> bool:
    """Whether left rows can be reduced to units before they meet a right side that is unique: the unit holds all left keys, so its rows
    share one right row; units are measured on left columns; and nothing asks for the keys of a mapping."""
    named = {u.partition(".")[2] for u in unit if u.startswith("left.")}
    asked = [*group_by, *unit, *(f["column"] for f in filters)]
    alike = all(comparable(left.kinds[a], right.kinds[b]) for a, b in zip(left_keys, right_keys, strict=True))
    return alike and set(left_keys) <= named and all(split_qualified(a)[0] != "key" for a in asked) and all(split_qualified(m["column"])[0] == "left" for m in unit_metrics if m.get("column"))


def units_below(left: Table, right: Table, left_keys: Sequence[str], right_keys: Sequence[str], group_by: Sequence[str], filters: Sequence[dict], how: str, unit: Sequence[str], unit_metrics: Sequence[dict]) -> DataFrame:
    """Stage one of unit aggregation below the join: left rows are filtered and reduced to units in the one shuffle of that table, and
    units, not rows, meet the right side, by the same key. Filters on right columns hold for all rows of a unit or for none, so they
    come last; groups by right columns are the same for all its rows, so only left groups can contradict each other."""
    a, b = _sides(left, right)
    a, b = Table(left.name, a, None, {f"left.{k}": v for k, v in left.scales.items()}), Table(right.name, b)
    of = lambda side, names: [n for n in names if n.startswith(f"{side}.")]
    here = [f for f in filters if f["column"].startswith("left.")]
    there = [f for f in filters if f not in here]
    first = aggregating.measuring.validated(a, unit_metrics, allow_empty=True)
    a.require(*of("left", [*unit, *group_by]))
    b.require(*of("right", [*unit, *group_by]))
    units = aggregating.reduced(a, filtering.filtered(a, here), of("left", unit), of("left", group_by), first)
    known = dict.fromkeys([*(f"right.{k}" for k in right_keys), *of("right", [*unit, *group_by]), *(f["column"] for f in there)])
    one = filtering.filtered(b, there) if how == "inner" else b.df
    met = units.join(one.select(*[F.col(f"`{c}`") for c in known]), condition(left, right, left_keys, right_keys), how)
    if how == "left" and there:
        met = met.where(filtering.conjunction(Table("units", met), there))
    met = met.where(~aggregating.unkeyed(of("right", unit)))
    place = {g: i for i, g in enumerate(of("left", group_by))}
    whole = lambda end: F.struct(F.lit(0).alias("_"), *[F.col(f"{end}.g{place[g]}" if g in place else f"`{g}`").alias(f"g{i}") for i, g in enumerate(group_by)])
    return met.withColumns({"__least": whole("__least"), "__most": whole("__most")})


def aggregate_join(
    left: Table, right: Table, left_keys: Sequence[str], right_keys: Sequence[str], metrics: Sequence[dict], group_by: Sequence[str] = (), filters: Sequence[dict] = (),
    how: str = "inner", unit: Sequence[str] = (), unit_metrics: Sequence[dict] = (), on_inconsistent_unit: str = "refuse", reasons: bool = True, guard: bool = True, resolved: dict | None = None,
) -> DataFrame | aggregating.UnitResult:
    """Aggregate over joined rows. A many-to-many join is refused, since it would count rows more than once."""
    for name in [*group_by, *unit, *(f["column"] for f in filters), *(m["column"] for m in [*metrics, *unit_metrics] if m.get("column"))]:
        if not (unit and name in {u.get("name") or f"{u['op']}:{u['column']}" for u in unit_metrics}):
            split_qualified(name)
    one = None
    if resolved is None:
        _checked(left, right, left_keys, right_keys, how)
        below = bool(unit) and eager(left, right, left_keys, right_keys, group_by, filters, unit, unit_metrics)
        # The right side is the one that usually says what rows belong to; the left one is looked at only if the right one repeats.
        one = unique(right, right_keys) if guard or below else None
        if guard and not one and not unique(left, left_keys):
            raise QueryValidationError("both sides repeat keys; a many-to-many join would count rows more than once")
    elif guard:
        if resolved_diagnostics(left, right, left_keys, right_keys, how, **resolved).first()["cardinality"] == "many_to_many":
            raise QueryValidationError("both sides repeat keys; a many-to-many join would count rows more than once")
    rows = resolved_join(left, right, left_keys, right_keys, how, **resolved) if resolved is not None else join(left, right, left_keys, right_keys, how)
    scales = {f"left.{k}": v for k, v in left.scales.items()} | {f"right.{k}": v for k, v in right.scales.items()}
    table = Table("join", rows, None, scales)
    try:
        if unit or unit_metrics:
            units = units_below(left, right, left_keys, right_keys, group_by, filters, how, unit, unit_metrics) if one and below else None
            return aggregating.aggregate_units(table, metrics, unit, unit_metrics, group_by, filters, on_inconsistent_unit, reasons, units)
        return aggregating.aggregate(table, metrics, group_by, filters, reasons)
    except QueryLookupError as e:
        raise QueryLookupError(f"{e}") from e
