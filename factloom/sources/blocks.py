"""Raw records of a file or worksheet, and the tables that lie in them: one with a header found or declared, or several blocks.

A raw record is a row of ``(row, starts, cells)``: where it ends, where it starts (they differ where quoted cells hold line
breaks) and its cells in order. A table is a slice of the records by rows and by cell positions, so blocks, composed headers
and the rows above the data are ordinary filters and projections.
"""

from __future__ import annotations

import dataclasses
import re
from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..convention import DEFAULT, Convention
from ..errors import QueryValidationError
from ..types import bounded, missing_kind, strip
from . import delimited, layout, workbook

RECORDS = "row long, starts long, cells array<string>"
MOST_BLOCKS, MOST_ABOVE_ROWS, MOST_ABOVE_CELLS = 64, 100, 512
HEAD = 60
_NAME = re.compile(r"[A-Za-z0-9][A-Za-z0-9 _.()+-]*")
_COLUMNS = re.compile(r"([A-Za-z]{1,3}):([A-Za-z]{1,3})")


@dataclasses.dataclass(frozen=True)
class Block:
    """A declared table: its header rows, its last row (None: the end) and its cell positions (None: all)."""

    name: str | None
    header_row: int
    header_rows: int = 1
    last_row: int | None = None
    columns: tuple[int, int] | None = None
    fill: bool = False

    @property
    def data_row(self) -> int:
        return self.header_row + self.header_rows

    def shares_columns(self, other: Block) -> bool:
        return self.columns is None or other.columns is None or (self.columns[0] <= other.columns[1] and other.columns[0] <= self.columns[1])


def _block(where: str, d: object, named: bool) -> Block:
    allowed = {"header_row", "header_rows", "fill", "note"} | ({"name", "last_row", "columns"} if named else set())
    if not isinstance(d, Mapping) or set(d) - allowed:
        raise QueryValidationError(f"layout of {where}: a table has {sorted(allowed)} only")
    whole = lambda k, least=1: isinstance(d.get(k), int) and not isinstance(d.get(k), bool) and d[k] >= least
    if not whole("header_row") or ("header_rows" in d and not whole("header_rows")):
        raise QueryValidationError(f"layout of {where}: header_row and header_rows are whole numbers from 1")
    columns = None
    if named:
        if not isinstance(d.get("name"), str) or not _NAME.fullmatch(d["name"]):
            raise QueryValidationError(f"layout of {where}: a block needs a name that can stand after '#'")
        if not whole("last_row", d["header_row"] + d.get("header_rows", 1)):
            raise QueryValidationError(f"layout of {where}: last_row lies below the header")
        if d.get("columns") is not None:
            m = _COLUMNS.fullmatch(str(d["columns"]))
            columns = m and tuple(workbook.column_index(x.upper()) for x in m.groups())
            if not columns or columns[0] > columns[1]:
                raise QueryValidationError(f"layout of {where}: columns are like A:C")
    return Block(d.get("name"), d["header_row"], d.get("header_rows", 1), d.get("last_row"), columns, bool(d.get("fill")))


def parse_layouts(payload: object) -> dict[str, list[Block]]:
    """Blocks by table path, from ``{"layouts": {path: {header_row…} | {"blocks": […]}}}``; anything else is refused, blocks that
    share a cell too."""
    if not isinstance(payload, Mapping) or set(payload) - {"layouts", "layout_version"} or not isinstance(payload.get("layouts"), Mapping) or not payload["layouts"]:
        raise QueryValidationError("a layout declaration is an object with layouts by table path")
    out = {}
    for path, d in payload["layouts"].items():
        if isinstance(d, Mapping) and "blocks" in d:
            if set(d) - {"blocks", "note"} or not isinstance(d["blocks"], list) or not 0 < len(d["blocks"]) <= MOST_BLOCKS:
                raise QueryValidationError(f"layout of {path}: blocks is a list of 1 to {MOST_BLOCKS}")
            blocks = [_block(path, b, True) for b in d["blocks"]]
            if len({b.name for b in blocks}) < len(blocks):
                raise QueryValidationError(f"layout of {path}: block names repeat")
            for i, a in enumerate(blocks):
                for b in blocks[i + 1 :]:
                    if a.shares_columns(b) and a.header_row <= b.last_row and b.header_row <= a.last_row:
                        raise QueryValidationError(f"layout of {path}: blocks {a.name!r} and {b.name!r} overlap")
            out[path] = blocks
        else:
            out[path] = [_block(path, d, False)]
    return out


def first_row(blocks: list[Block], block: Block) -> int:
    """Just below the nearest block above that shares a column: what lies between is this block's preamble."""
    return max((b.last_row for b in blocks if b is not block and b.last_row and b.last_row < block.header_row and b.shares_columns(block)), default=0) + 1


def sheet_records(spark: SparkSession, path: str, sheet: str) -> DataFrame:
    """The rows of a worksheet, parsed by an executor as a stream; rows that the sheet leaves out are absent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows: list[tuple] = []
                for r in workbook.Workbook(at).rows(name):
                    rows.append(r)
                    if len(rows) == 2000:
                        yield packed(rows)
                        rows = []
                yield packed(rows)

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        at = pa.array([n for n, _ in rows], pa.int64())
        return pa.RecordBatch.from_arrays([at, at, pa.array([c for _, c in rows], pa.list_(pa.string()))], names=["row", "starts", "cells"])

    return spark.createDataFrame([(path, sheet)], "path string, sheet string").mapInArrow(run, RECORDS)


def file_records(spark: SparkSession, path: str, **options: str) -> DataFrame:
    return delimited.records(spark, path, **options).select("row", "starts", "cells")


@dataclasses.dataclass(frozen=True)
class Laid:
    """A table within records: its rows, the header that names its columns, and the rows above its data by position."""

    df: DataFrame
    header_row: int | None
    header_rows: int
    skipped: list[tuple[int, str]]
    columns: list[tuple[str, int]]
    source: str
    #: Rows (row, n) whose number of cells is not that of the header; their further cells have no column.
    ragged: DataFrame


def table(records: DataFrame, block: Block | None = None, blocks: list[Block] | None = None, letters: bool = False, blank_rows: bool = False) -> Laid:
    """The declared table of a block, or the one whose header the header rule finds on the head of the records. Cells to the right
    of the header get a column of their own in sheets; blank records are rows only where ``blank_rows`` says so."""
    head = [(r["row"], r["starts"], [c or "" for c in r["cells"]]) for r in records.where(F.col("starts") <= HEAD + (block.data_row if block else 0)).orderBy("starts").limit(HEAD + (block.data_row if block else 0)).collect()]
    low, high = block.columns if block and block.columns else (0, None)
    cut = lambda cells: cells[low : None if high is None else high + 1]
    if block:
        labels = [cut(c) for _, s, c in head if block.header_row <= s < block.data_row]
        if not labels:
            raise QueryValidationError(f"the declared header row {block.header_row} holds no record")
        labels = layout.compose(labels, block.fill) if len(labels) > 1 else labels[0]
        start, begin = first_row(blocks or [block], block), block.data_row
        skipped = [(s, "declared") for _, s, c in head if start <= s < block.header_row and layout.filled(cut(c))]
        at, many, source = block.header_row, block.header_rows, "declared"
    else:
        found = layout.find_header([(e, c) for e, _, c in head])
        labels = next((c for e, _, c in head if e == found.row), [])
        begin, skipped, at, many, source = (found.row or 0) + 1, found.skipped, found.row, 1, "detected" if found.confident else "first-row"
    rows = records.where(F.col("starts") >= begin)
    if block and block.last_row:
        rows = rows.where(F.col("row") <= block.last_row)
    width = len(labels)
    if high is not None:
        width = high - low + 1
    elif letters:
        width = max(width, (rows.agg(F.max(F.size("cells"))).first()[0] or 0) - low)
    names = layout.names([*labels, *[""] * (width - len(labels))][:width], letters)
    if not blank_rows:
        rows = rows.where(F.size("cells") > 0)
    cells = [F.get("cells", F.lit(low + i)).alias(n) for i, n in enumerate(names)]
    size = F.size("cells") if high is None else F.least(F.size("cells"), F.lit(high + 1))
    ragged = rows.select("row", F.greatest(size - low, F.lit(0)).alias("n")).where(F.col("n") != len(names))
    return Laid(rows.select(F.col("row").alias("_source_row"), *cells), at, many, skipped, [(n, low + i) for i, n in enumerate(names)], source, ragged)


def above(records: DataFrame, laid: Laid, convention: Convention = DEFAULT, most_rows: int = MOST_ABOVE_ROWS, most_cells: int = MOST_ABOVE_CELLS) -> DataFrame:
    """(row, role, position, letter, column, value, raw): the filled cells of skipped rows and of composed header rows, which no
    column name shows. A one-row header is visible as the names, so a clean table lists none."""
    bounded(most_rows, MOST_ABOVE_ROWS, "max_rows"), bounded(most_cells, MOST_ABOVE_CELLS, "max_cells")
    header = [laid.header_row + i for i in range(laid.header_rows)] if laid.header_rows > 1 else []
    wanted = sorted({*[r for r, _ in laid.skipped], *header})[: min(most_rows, MOST_ABOVE_ROWS)]
    cells = records.where(F.col("starts").isin(*wanted) if wanted else F.lit(False)).select("starts", F.posexplode("cells").alias("position", "raw")).where(F.col("raw").isNotNull() & (strip(F.col("raw")) != ""))
    letters = F.array(*[F.lit(layout.letter(i)) for i in range(MOST_ABOVE_CELLS)])
    names = F.create_map(*[x for n, p in laid.columns for x in (F.lit(p), F.lit(n))]) if laid.columns else F.lit(None).cast("map<int,string>")
    gone = missing_kind(F.col("raw"), convention).isin("empty", "sentinel")
    role = F.when(F.col("starts").isin(*header), "header").otherwise("skipped") if header else F.lit("skipped")
    out = cells.select(F.col("starts").alias("row"), role.alias("role"), "position", F.get(letters, F.col("position")).alias("letter"), F.try_element_at(names, F.col("position")).alias("column"), F.when(~gone, strip(F.col("raw"))).alias("value"), "raw")
    return out.orderBy("row", "position").limit(min(most_cells, MOST_ABOVE_CELLS))
