"""Crosswalks as tables: a file of any number of forms is read in ranges, tested and joined without passing through the driver.

The rules are those of ``identity.parse_crosswalk``: the columns canonical_id and form, no cell missing or empty, no form twice. Here
each rule is a grouped test over the rows, and lines come with the records, so a refusal names the lines that it is about.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..errors import QueryValidationError
from ..session import written
from ..sources import delimited, files
from ..types import strip
from . import identity

COLUMNS = ("canonical_id", "form")


@dataclasses.dataclass(frozen=True)
class CrosswalkTable:
    """A tested crosswalk: (form, canonical_id), and the digest of the file."""

    name: str
    table: DataFrame
    sha256: str

    def rows(self, spark: SparkSession) -> DataFrame:
        return self.table


def cells_of(spark: SparkSession, path: str, name: str = "crosswalk") -> DataFrame:
    """(line, n, width, canonical_id, form) of every record below the header that is not blank; cells are stripped."""
    records = delimited.records(spark, path, delimiter=",").where(F.size("cells") > 0)
    first = records.orderBy("row").limit(1).collect()
    header = [c.strip() for c in first[0]["cells"]] if first else []
    if not set(COLUMNS) <= set(header):
        raise QueryValidationError(f"crosswalk {name!r} needs the columns canonical_id and form; it has {header}")
    cell = lambda c: strip(F.coalesce(F.get("cells", F.lit(header.index(c))), F.lit(""))).alias(c)
    return records.where(F.col("row") > first[0]["row"]).select(F.col("row").alias("line"), F.size("cells").alias("n"), F.lit(len(header)).alias("width"), *map(cell, COLUMNS))


def problems(cells: DataFrame) -> DataFrame:
    """(line, problem, form, first_line): rows that a strict reading refuses. A form's first row that is sound is the one that counts; every
    other one is named with it. Forms that stand once leave the grouping at once."""
    ragged, empty = F.col("n") != F.col("width"), (F.col("canonical_id") == "") | (F.col("form") == "")
    bad = cells.where(ragged | empty).select("line", F.when(ragged, "ragged").otherwise("empty").alias("problem"), "form", F.lit(None).cast("long").alias("first_line"))
    sound = cells.where(~ragged & ~empty)
    twice = sound.groupBy("form").agg(F.count(F.lit(1)).alias("k"), F.min(F.struct("line", "canonical_id")).alias("first")).where("k > 1").select("form", "first")
    again = sound.join(twice, "form").where(F.col("line") > F.col("first.line"))
    other = F.when(F.col("canonical_id") != F.col("first.canonical_id"), "claimed").otherwise("repeated")
    return bad.unionAll(again.select("line", other.alias("problem"), "form", F.col("first.line").alias("first_line")))


def read(spark: SparkSession, path: str, name: str) -> CrosswalkTable:
    """The crosswalk of a file, or a refusal with the number of wrong lines and the first of them."""
    cells = written(cells_of(spark, path, name), "crosswalk")
    wrong = problems(cells)
    shown = wrong.orderBy("line").limit(identity.SHOWN).collect()
    if shown:
        said = {"ragged": "another number of cells than the header", "empty": "empty canonical_id or form", "repeated": "the form already stands at line {}", "claimed": "the form already stands at line {} for another id"}
        raise QueryValidationError(f"crosswalk {name!r}: {wrong.count()} wrong line(s): " + "; ".join(f"line {r['line']}: {said[r['problem']].format(r['first_line'])}" for r in shown))
    if cells.isEmpty():
        raise QueryValidationError(f"crosswalk {name!r}: no forms")
    return CrosswalkTable(name, cells.select("form", "canonical_id"), files.digest_of(path.removeprefix("file://")))


def checked(keys: Sequence[str], key_format: str | None, mapped: bool, rendered_other: bool, forms: str = "one", side: str = "left") -> int:
    """How many values the compared key of a side has, or why the side cannot be resolved as declared."""
    if not keys:
        raise QueryValidationError(f"{side}_keys must not be empty")
    if forms not in ("one", "many"):
        raise QueryValidationError(f"{side} forms per canonical id are one or many, not {forms!r}")
    if forms == "many" and not mapped:
        raise QueryValidationError(f"several forms of an id on the {side} side need a crosswalk that gives ids")
    if len(keys) > 1 and not key_format and mapped:
        raise QueryValidationError(f"a crosswalk maps single texts; the {side} side has {len(keys)} columns and needs a key format")
    if len(keys) > 1 and not key_format and rendered_other:
        raise QueryValidationError(f"the other side renders one text; the {side} side has {len(keys)} columns and needs a key format too")
    return 1 if key_format or mapped or rendered_other else len(keys)


def mapping_facts(side: identity.Side, other: identity.Side, crosswalk: DataFrame) -> DataFrame:
    """One row about the keys of a side: rows and distinct values that the crosswalk maps or not, keys that the other side lacks, unmapped
    texts that read like a canonical id, and how many forms stand for an id.

    Rows are counted once by (space, key, text), combined before the shuffle; everything else is asked of those counts."""
    counts = written(side.rows.groupBy("__space", "__key", "__text").agg(F.count(F.lit(1)).alias("n")), "mapping")
    whole = counts.where("__space is not null")
    ids = crosswalk.select(F.col("canonical_id").alias("__text")).distinct()
    theirs = other.rows.where("__space is not null").select("__space", "__key").distinct()
    forms = whole.where("__space = 'canonical'").groupBy("__key").agg(F.count(F.lit(1)).alias("forms"))
    of = lambda s: F.col("__space") == s
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    parts = [
        counts.agg(
            zero(F.sum(F.when(of("canonical"), F.col("n")))).alias("mapped_rows"), zero(F.sum(F.when(of("unmapped"), F.col("n")))).alias("unmapped_rows"), zero(F.sum(F.when(F.col("__space").isNull(), F.col("n")))).alias("incomplete_rows"),
            F.count_if(of("canonical")).alias("mapped_distinct_values"), F.count_if(of("unmapped")).alias("unmapped_distinct_values"), F.count_if(F.col("__space").isNotNull()).alias("distinct_forms"),
            F.coalesce(F.bool_and(F.when(F.col("__space").isNotNull(), F.col("n") == 1)), F.lit(True)).alias("forms_unique"),
        ),
        forms.agg(F.count(F.lit(1)).alias("mapped_distinct_canonical_ids"), F.count_if(F.col("forms") > 1).alias("canonical_ids_with_several_forms"), zero(F.max("forms")).alias("max_forms_per_canonical_id")),
        whole.select("__space", "__key").distinct().join(theirs, ["__space", "__key"], "left_anti").agg(F.count(F.lit(1)).alias("unmatched_distinct_keys")),
        whole.where("__space = 'unmapped'").select("__text").distinct().join(ids, "__text", "left_semi").agg(F.count(F.lit(1)).alias("unmapped_equal_to_a_canonical_id")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, how="cross")  # one row each
    return out


def examples(side: identity.Side, other: identity.Side, locator: str | None = None, shown: int = identity.SHOWN) -> DataFrame:
    """(kind, text, rows, locators): the first unmapped texts and the first keys that the other side lacks, each with its first rows."""
    whole = side.rows.where("__space is not null")
    theirs = other.rows.where("__space is not null").select("__space", "__key").distinct()
    out = None
    for kind, rows, text in (("unmapped", whole.where("__space = 'unmapped'"), "__text"), ("unmatched", whole.join(theirs, ["__space", "__key"], "left_anti"), "__key")):
        few = rows.groupBy(F.col(text).alias("text")).agg(F.count(F.lit(1)).alias("rows")).orderBy("text").limit(shown)
        if locator:
            at = rows.join(few.select(F.col("text").alias(text)), text, "left_semi").select(F.col(text).alias("text"), F.col(locator).alias("at"))
            rank = F.row_number().over(Window.partitionBy("text").orderBy("at"))
            lists = at.withColumn("k", rank).where(F.col("k") <= shown).groupBy("text").agg(F.array_sort(F.collect_list("at")).alias("locators"))
            few = few.join(lists, "text")
        part = few.withColumn("kind", F.lit(kind))
        out = part if out is None else out.unionByName(part)
    return out
