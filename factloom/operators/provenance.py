"""Which rows an answer rests on: row locators as inclusive ranges."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..errors import QueryValidationError
from ..session import written
from ..types import Table

MOST_RANGES, MOST_OBJECTS = 4096, 1024
#: Blocks of locators that are joined together before the rest is.
WIDER = 1024


def ranges(rows: DataFrame, locator: str, by: list[str] | None = None, block: int = 1 << 16) -> DataFrame:
    """Distinct whole-number locators as (first, last), per group of ``by``.

    Islands are found inside blocks of locators, which spreads one long table over many tasks. Only an island that touches an
    edge of its block can go on in the next one, so only those, at most two a block, are merged; all others are final.
    """
    by = by or []
    keys = [F.col(f"`{c}`") for c in by]
    at = rows.where(F.col(locator).isNotNull()).select(*keys, F.col(locator).cast("long").alias("__at")).distinct()
    at = at.withColumn("__block", F.floor(F.col("__at") / block))
    inside = Window.partitionBy(*by, "__block").orderBy("__at")
    islands = at.withColumn("__island", F.col("__at") - F.row_number().over(inside)).groupBy(*keys, "__block", "__island").agg(F.min("__at").alias("first"), F.max("__at").alias("last"))
    at_edge = lambda unit, size: (F.col("first") == F.col(unit) * size) | (F.col("last") == F.col(unit) * size + size - 1)
    edge = at_edge("__block", block)
    done = islands.where(~edge).select(*keys, "first", "last")
    # Edges meet inside blocks of blocks first; only what touches an edge of those meets in one window (a group).
    wide = block * WIDER
    inner = joined_ranges(islands.where(edge).select(*keys, F.floor(F.col("first") / wide).alias("__wide"), "first", "last"), [*by, "__wide"])
    # A joined range begins in its wide block and ends in it, as each of its parts does.
    outer = at_edge("__wide", wide)
    last = joined_ranges(inner.where(outer).select(*keys, "first", "last"), by)
    return done.unionByName(inner.where(~outer).select(*keys, "first", "last")).unionByName(last)


def joined_ranges(found: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, first, last): disjoint ranges, those that touch made one."""
    order = Window.partitionBy(*(by or [F.lit(0)])).orderBy("first")
    fresh = F.when(F.lag("last").over(order) + 1 == F.col("first"), 0).otherwise(1)
    runs = found.withColumn("__new", fresh).withColumn("__run", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(*[F.col(f"`{c}`") for c in by], "__run").agg(F.min("first").alias("first"), F.max("last").alias("last")).drop("__run")


#: Ranges that a task holds before it merges them and, if they are still so many, passes them on.
HELD_RANGES = 1 << 17


def merged(code: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges of each code, sorted, with those that touch or overlap made one: positions of a row of each, first, last."""
    order = np.lexsort((first, code))
    code, first, last = code[order], first[order], last[order]
    if not len(code):
        return order, first, last
    # The furthest end so far within a code: codes are spread apart so that one running maximum serves all.
    low = int(first.min())
    span = int(last.max()) - low + 3
    wide = span * int(code[-1] + 1) < 1 << 62
    if wide:
        reach = np.maximum.accumulate(code * span + (last - low))
        new = np.ones(len(code), bool)
        new[1:] = code[1:] * span + (first[1:] - low) > reach[:-1] + 1
        new[1:] |= code[1:] != code[:-1]
    else:  # locators that are too far apart for that: code by code
        new = np.ones(len(code), bool)
        end = int(last[0])
        for i in range(1, len(code)):
            new[i] = code[i] != code[i - 1] or int(first[i]) > end + 1
            end = int(last[i]) if new[i] else max(end, int(last[i]))
    at = np.flatnonzero(new)
    return order[at], first[at], np.maximum.reduceat(last, at)


def coded(keys: list[pa.Array], n: int) -> np.ndarray:
    """Equal numbers for rows of equal keys; nulls are equal."""
    code = np.zeros(n, np.int64)
    for c in keys:
        one = pc.fill_null(pc.dictionary_encode(c, null_encoding="encode").indices, 0).to_numpy(zero_copy_only=False)
        code = np.unique(code * (int(one.max(initial=0)) + 1) + one, return_inverse=True)[1]
    return code


def contributions(rows: DataFrame, locator: str, by: Sequence[str] = (), most: int = MOST_RANGES) -> DataFrame:
    """Written: (by, rows, n_ranges, complete, ranges): per group the distinct whole-number locators as run-length sets, which tasks build
    and merge before the one shuffle by group. A list of more than ``most`` ranges is not kept, but counted exactly.

    Tables are stored in the order of their locators, so a task has few ranges; one that has more than ``most`` of a group gives that group up, and
    the groups that some task gave up are counted by ``ranges`` in blocks of locators."""
    keys = list(by)
    kinds = [rows.schema[k].dataType.simpleString() for k in keys]
    shown = [F.col(f"`{k}`").alias(f"k{i}") for i, k in enumerate(keys)]
    schema = "".join(f"k{i} {t}, " for i, t in enumerate(kinds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def squeezed() -> pa.Table:
            t = pa.concat_tables(held).combine_chunks()
            code = coded([t.column(i).combine_chunks() for i in range(len(keys))], len(t))
            at, first, last = merged(code, t.column("first").to_numpy(), t.column("last").to_numpy())
            own = [t.column(i).take(pa.array(at)) for i in range(len(keys))]
            return pa.table([*own, pa.array(first), pa.array(last)], names=[*(f"k{i}" for i in range(len(keys))), "first", "last"])

        def told(t: pa.Table) -> Iterator[pa.RecordBatch]:
            code = coded([t.column(i).combine_chunks() for i in range(len(keys))], len(t))
            number = np.bincount(code, minlength=1)[code] if len(code) else code
            small = pa.array(number <= most)
            ranges = pa.StructArray.from_arrays([t.column("first").combine_chunks(), t.column("last").combine_chunks()], names=["first", "last"])
            ranges = pc.if_else(small, ranges, pa.scalar(None, ranges.type))
            first_of = np.zeros(len(code), bool)
            first_of[np.unique(code, return_index=True)[1]] = True
            kept = pa.array((number <= most) | first_of)
            out = pa.RecordBatch.from_arrays([*(t.column(i).combine_chunks() for i in range(len(keys))), ranges, pa.array(number > most)], names=[*(f"k{i}" for i in range(len(keys))), "range", "over"])
            yield out.filter(kept)

        n = 0
        for batch in batches:
            at = batch.column(len(keys))
            batch = batch.filter(at.is_valid())
            if not batch.num_rows:
                continue
            at = batch.column(len(keys))
            held.append(pa.table([*batch.columns[: len(keys)], at, at], names=[*(f"k{i}" for i in range(len(keys))), "first", "last"]))
            n += batch.num_rows
            if n > HELD_RANGES:
                held = [squeezed()]
                n = len(held[0])
                if n > HELD_RANGES // 2:
                    yield from told(held[0])
                    held, n = [], 0
        if held:
            yield from told(squeezed())

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(len(keys))
            flat = lists.flatten()
            code = np.repeat(np.arange(batch.num_rows), pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False))
            first, last = (flat.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
            at, first, last = merged(code, first, last)
            owner = code[at]
            number = np.bincount(owner, minlength=batch.num_rows)
            held = np.bincount(owner, weights=None, minlength=batch.num_rows) <= most
            total = np.zeros(batch.num_rows, np.int64)
            np.add.at(total, owner, last - first + 1)
            stay = held[owner]
            offsets = np.concatenate([[0], np.cumsum(np.where(held, number, 0))]).astype(np.int32)
            pairs = pa.StructArray.from_arrays([pa.array(first[stay]), pa.array(last[stay])], names=["first", "last"])
            ranges = pa.ListArray.from_arrays(pa.array(offsets), pairs, mask=pa.array(~held))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], pa.array(total), pa.array(number, pa.int64()), pa.array(held), ranges, batch.column(len(keys) + 1)], names=[*(f"k{i}" for i in range(len(keys))), "rows", "n_ranges", "complete", "ranges", "over"])

    kind = "struct<first:bigint,last:bigint>"
    parts = rows.select(*shown, F.col(f"`{locator}`").cast("long").alias("at")).mapInArrow(run, f"{schema}range {kind}, over boolean")
    own = [f"k{i}" for i in range(len(keys))]
    gathered = parts.groupBy(*own).agg(F.collect_list("range").alias("list"), F.coalesce(F.bool_or("over"), F.lit(False)).alias("over"))
    found = written(gathered.mapInArrow(together, f"{schema}rows long, n_ranges long, complete boolean, ranges array<{kind}>, over boolean"), "contributions")
    named = lambda df: df.select(*[F.col(k).alias(name) for k, name in zip(own, keys, strict=True)], "rows", "n_ranges", "complete", "ranges")
    over = found.where("over")
    if over.isEmpty():
        return named(found)
    # Groups whose ranges are many in some task, as where rows do not lie in order: counted in blocks, and listed if they are few after all.
    wide = rows.select(*shown, F.col(f"`{locator}`").alias("at"))
    if own:
        few = over.select(*[F.col(k).alias(f"o{i}") for i, k in enumerate(own)])
        wide = wide.join(few, reduce(lambda p, q: p & q, (F.col(k).eqNullSafe(F.col(f"o{i}")) for i, k in enumerate(own))), "left_semi")
    blocks = written(ranges(wide, "at", own), "wide-ranges")
    counts = blocks.groupBy(*own).agg(F.sum(F.col("last") - F.col("first") + 1).alias("rows"), F.count(F.lit(1)).alias("n_ranges"))
    listed = blocks.join(counts.where(F.col("n_ranges") <= most).select(*[F.col(k).alias(f"o{i}") for i, k in enumerate(own)], "n_ranges"), reduce(lambda p, q: p & q, (F.col(k).eqNullSafe(F.col(f"o{i}")) for i, k in enumerate(own)), F.lit(True)), "left_semi") if own else blocks.where(F.lit(False))
    listed = listed.groupBy(*own).agg(F.array_sort(F.collect_list(F.struct("first", "last"))).alias("ranges"))
    out = counts
    if own:
        other = listed.select(*[F.col(k).alias(f"o{i}") for i, k in enumerate(own)], "ranges")
        out = counts.join(other, reduce(lambda p, q: p & q, (F.col(k).eqNullSafe(F.col(f"o{i}")) for i, k in enumerate(own))), "left")
    else:
        n = counts.first()["n_ranges"]
        small = blocks.agg(F.array_sort(F.collect_list(F.struct("first", "last"))).alias("ranges")) if n <= most else None
        out = counts.join(small, how="cross") if small is not None else counts.withColumn("ranges", F.lit(None).cast(f"array<{kind}>"))
    out = out.withColumn("complete", F.col("n_ranges") <= most)
    return named(found.where("not over")).unionByName(named(out))


def objects(rows: DataFrame, locator: Sequence[str]) -> DataFrame:
    """(locator): distinct object locators as JSON with their fields in the order of their names, absent ones spelt null."""
    fields = [F.col(f"`{c}`") for c in sorted(locator)]
    return rows.select(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("locator")).distinct()


def capped(rows: DataFrame, locator: str, most: int = MOST_RANGES) -> DataFrame:
    """One row: how many ranges the rows make, and whether a list of ``most`` would hold them. Nothing is collected for it."""
    n = F.count(F.lit(1))
    return ranges(rows, locator).agg(n.alias("ranges"), F.coalesce(F.sum(F.col("last") - F.col("first") + 1), F.lit(0)).alias("rows"), (n <= most).alias("complete"))


def dropped(entered: DataFrame, groups: DataFrame) -> DataFrame:
    """One row: rows that entered a unit aggregation (after filters, before any metric), rows its units used, and the rows that the
    unit policy dropped."""
    used = groups.agg(F.coalesce(F.sum("n_rows"), F.lit(0)).cast("long").alias("used"))
    return entered.agg(F.count(F.lit(1)).alias("entered")).join(used, how="cross").select("entered", "used", (F.col("entered") - F.col("used")).alias("dropped"))  # one row each


def contributors(table: Table, rows: DataFrame, locator: Sequence[str] = ()) -> dict[str, object]:
    """What an answer rests on, for rows after filters and before metrics: ranges of whole-number locators, or object locators
    where ``locator`` names several columns; more than may be listed are counted and not listed."""
    about = {"scope": "post_filter_pre_metric", "table": table.name}
    if locator:
        found = [r[0] for r in objects(rows, locator).orderBy("locator").limit(MOST_OBJECTS + 1).collect()]
        if len(found) > MOST_OBJECTS:
            return {**about, "complete": False, "reason": f"more than {MOST_OBJECTS} locators", "objects": []}
        return {**about, "complete": True, "objects": found, "rows": len(found)}
    if table.locator is None:
        raise QueryValidationError(f"{table.name!r} has no locator")
    found = contributions(rows, table.locator).first()
    if found is None:
        return {**about, "complete": True, "ranges": [], "rows": 0}
    if not found["complete"]:
        return {**about, "complete": False, "reason": f"more than {MOST_RANGES} ranges", "ranges": [], "n_ranges": found["n_ranges"], "rows": found["rows"]}
    return {**about, "complete": True, "ranges": [[r["first"], r["last"]] for r in found["ranges"]], "rows": found["rows"]}
