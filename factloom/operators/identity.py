"""Declared identity: key formats that render several columns as one text, and crosswalks from written forms to canonical ids."""

from __future__ import annotations

import csv
import dataclasses
import hashlib
import io
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import QueryValidationError
from ..types import Table

SHOWN = 20


@dataclasses.dataclass(frozen=True)
class KeyFormat:
    """A template such as ``{cage}-{tail}``: literal text and every key column, in order."""

    template: str
    parts: tuple[tuple[str, str | None], ...]

    @property
    def adjacent(self) -> bool:
        """Whether two columns stand side by side, so that different keys can read alike."""
        return any(text == "" and i > 0 for i, (text, name) in enumerate(self.parts) if name)

    def column(self, table: Table) -> Column:
        pieces = [piece for text, name in self.parts for piece in ([F.lit(text)] if text else []) + ([as_text(table, name)] if name else [])]
        return F.concat(*pieces)


def parse_key_format(template: str, keys: Sequence[str]) -> KeyFormat:
    """Braces hold a key's name; doubled braces stand for themselves. Every key is used once at least, and no other."""
    if not isinstance(template, str) or not template:
        raise QueryValidationError("a key format is a text that is not empty")
    parts: list[tuple[str, str | None]] = []
    text, at = "", 0
    token = re.compile(r"\{\{|\}\}|\{([^{}]*)\}|[{}]")
    for m in token.finditer(template):
        text += template[at : m.start()]
        at = m.end()
        if m[0] in ("{{", "}}"):
            text += m[0][0]
        elif m[1] is None:
            raise QueryValidationError(f"unbalanced brace in key format {template!r}")
        elif m[1] not in keys:
            raise QueryValidationError(f"key format {template!r} names {m[1]!r}, which is not among the keys {list(keys)}")
        else:
            parts.append((text, m[1]))
            text = ""
    parts.append((text + template[at:], None))
    unused = [k for k in keys if k not in {name for _, name in parts}]
    if unused:
        raise QueryValidationError(f"key format {template!r} leaves out {unused}")
    return KeyFormat(template, tuple(parts))


def as_text(table: Table, name: str) -> Column:
    """A key value as it is written: whole numbers plainly, other numbers with their shortest digits and never by exponent
    between a thousandth and ten million; beyond, digits are spelt out as far as a decimal holds them."""
    c = F.col(f"`{name}`")
    if table.kinds[name] != "number":
        return c.cast("string")
    plain = c.cast("double")
    spelt = F.regexp_replace(F.regexp_replace(plain.cast("decimal(38,12)").cast("string"), r"0+$", ""), r"\.$", ".0")
    size = F.abs(plain)
    return F.when((size < 1e-3) & (size >= 1e-4) | (size >= 1e7) & (size < 1e16), spelt).otherwise(plain.cast("string"))


@dataclasses.dataclass(frozen=True)
class Crosswalk:
    name: str
    forms: dict[str, str]
    sha256: str

    def rows(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(sorted(self.forms.items()), "form string, canonical_id string")


def parse_crosswalk(content: bytes, name: str) -> Crosswalk:
    """A strict CSV of ``canonical_id,form``; forms that are empty, repeated or claimed by two ids are refused with their lines."""
    try:
        text = content.decode("utf-8-sig")
    except UnicodeDecodeError as e:
        raise QueryValidationError(f"crosswalk {name!r} is not UTF-8") from e
    reader = csv.reader(io.StringIO(text, newline=""))
    header = [h.strip() for h in next(reader, [])]
    if "canonical_id" not in header or "form" not in header:
        raise QueryValidationError(f"crosswalk {name!r} needs the columns canonical_id and form; it has {header}")
    a, b, seen, wrong = header.index("canonical_id"), header.index("form"), {}, []
    for row in reader:
        if not row:
            continue
        if len(row) != len(header):
            wrong.append(f"line {reader.line_num}: {len(row)} cells, not {len(header)}")
            continue
        canonical, form = row[a].strip(), row[b].strip()
        if not canonical or not form:
            wrong.append(f"line {reader.line_num}: empty canonical_id or form")
        elif form in seen:
            wrong.append(f"line {reader.line_num}: form {form!r} already stands at line {seen[form][1]}" + (" for another id" if seen[form][0] != canonical else ""))
        else:
            seen[form] = (canonical, reader.line_num)
    if wrong or not seen:
        raise QueryValidationError(f"crosswalk {name!r}: " + ("; ".join(wrong) or "no forms"))
    return Crosswalk(name, {f: c for f, (c, _) in seen.items()}, "sha256:" + hashlib.sha256(content).hexdigest())


@dataclasses.dataclass(frozen=True)
class Side:
    """One side of a resolved join: rows with the key's text, its resolved form and how it came about."""

    rows: DataFrame
    keys: tuple[str, ...]


def resolve(table: Table, keys: Sequence[str], key_format: str | None = None, crosswalk: DataFrame | None = None) -> Side:
    """Add ``__raw`` (the key's own values), ``__text``, ``__space`` (canonical, unmapped or rendered) and ``__key``.

    A form that the crosswalk lists becomes its canonical id; any other text stays itself in a space of its own, so an
    unmapped text never meets a canonical id by chance. A row that lacks part of its key resolves to null. The crosswalk is
    joined by key; the planner broadcasts it while its size allows.
    """
    table.require(*keys)
    if key_format is None and len(keys) != 1:
        raise QueryValidationError("several key columns need a key_format before they can be resolved as one text")
    text = parse_key_format(key_format, keys).column(table) if key_format else as_text(table, keys[0])
    raw = F.struct(*[F.col(f"`{k}`") for k in keys])
    whole = F.lit(True)
    for k in keys:
        whole = whole & F.col(f"`{k}`").isNotNull()
    rows = table.df.withColumn("__raw", F.when(whole, raw)).withColumn("__text", F.when(whole, text))
    if crosswalk is None:
        return Side(rows.withColumn("__space", F.when(whole, F.lit("rendered"))).withColumn("__key", F.col("__text")), tuple(keys))
    rows = rows.join(crosswalk.select(F.col("form").alias("__text"), F.col("canonical_id").alias("__canonical")), "__text", "left")
    space = F.when(F.col("__text").isNull(), None).when(F.col("__canonical").isNotNull(), F.lit("canonical")).otherwise(F.lit("unmapped"))
    return Side(rows.withColumn("__space", space).withColumn("__key", F.coalesce("__canonical", "__text")).drop("__canonical"), tuple(keys))


def rendering_collisions(side: Side) -> DataFrame:
    """Texts that more than one distinct raw key renders to."""
    keyed = side.rows.where("__text is not null").groupBy("__text", "__raw").agg(F.count(F.lit(1)).alias("n"))
    return keyed.groupBy("__text").agg(F.count(F.lit(1)).alias("raw_keys"), F.sum("n").alias("n_rows")).where("raw_keys > 1").withColumnRenamed("__text", "rendered")


def crosswalk_collisions(side: Side) -> DataFrame:
    """Canonical ids that a table writes in more than one form."""
    forms = side.rows.where("__space = 'canonical'").groupBy("__key", "__text").agg(F.count(F.lit(1)).alias("n"))
    return forms.groupBy("__key").agg(F.count(F.lit(1)).alias("forms"), F.sum("n").alias("n_rows")).where("forms > 1").withColumnRenamed("__key", "canonical_id")


def mapping_facts(side: Side) -> DataFrame:
    """One row: mapped, unmapped and incomplete rows, with the distinct values behind them."""
    per_text = side.rows.groupBy("__space", "__text").agg(F.count(F.lit(1)).alias("n"))
    total = lambda s: F.coalesce(F.sum(F.when(F.col("__space") == s, F.col("n"))), F.lit(0))
    return per_text.agg(
        total("canonical").alias("mapped_rows"), F.count_if(F.col("__space") == "canonical").alias("mapped_distinct"),
        total("unmapped").alias("unmapped_rows"), F.count_if(F.col("__space") == "unmapped").alias("unmapped_distinct"),
        F.coalesce(F.sum(F.when(F.col("__space").isNull(), F.col("n"))), F.lit(0)).alias("incomplete_rows"),
    )
