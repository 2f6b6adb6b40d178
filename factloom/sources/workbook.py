"""Worksheets of an xlsx workbook by the standard library: shared strings, inline strings, numbers, booleans and dates."""

from __future__ import annotations

import datetime
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession

from . import layout

MOST_SHEETS = 64
_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
# Number formats that stand for dates.
DATE_FORMATS = frozenset([*range(14, 23), *range(45, 48)])


class Workbook:
    def __init__(self, path: str) -> None:
        self.zip = zipfile.ZipFile(path)
        book = ElementTree.fromstring(self.zip.read("xl/workbook.xml"))
        links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(self.zip.read("xl/_rels/workbook.xml.rels"))}
        self.sheets = {}
        for s in list(book.iter(f"{_NS}sheet"))[:MOST_SHEETS]:
            target = links[s.get(_REL)].lstrip("/")
            self.sheets[s.get("name")] = (target if target.startswith("xl/") else f"xl/{target}", s.get("state", "visible"))
        have = set(self.zip.namelist())
        self.strings = []
        if "xl/sharedStrings.xml" in have:
            self.strings = ["".join(t.text or "" for t in si.iter(f"{_NS}t")) for si in ElementTree.fromstring(self.zip.read("xl/sharedStrings.xml")).iter(f"{_NS}si")]
        self.dates = self._date_styles() if "xl/styles.xml" in have else set()

    def _date_styles(self) -> set[int]:
        root = ElementTree.fromstring(self.zip.read("xl/styles.xml"))
        own = {int(f.get("numFmtId")) for f in root.iter(f"{_NS}numFmt") if re.search(r"[ymdh]", re.sub(r'"[^"]*"|\[[^\]]*\]', "", f.get("formatCode", "")).lower())}
        cells = root.find(f"{_NS}cellXfs")
        return {i for i, x in enumerate(cells if cells is not None else []) if int(x.get("numFmtId", 0)) in DATE_FORMATS | own}

    def rows(self, sheet: str) -> Iterator[tuple[int, list[str | None]]]:
        """(row number, cells as text); rows that the sheet leaves out are left out here too."""
        number = 0
        with self.zip.open(self.sheets[sheet][0]) as f:
            for _, e in ElementTree.iterparse(f):
                if e.tag != f"{_NS}row":
                    continue
                number = int(e.get("r", number + 1))
                cells: list[str | None] = []
                for c in e.iter(f"{_NS}c"):
                    at = column_index(re.match(r"[A-Z]+", c.get("r", ""))[0]) if c.get("r") else len(cells)
                    cells += [None] * (at + 1 - len(cells))
                    cells[at] = self._value(c)
                yield number, cells
                e.clear()

    def _value(self, c: ElementTree.Element) -> str | None:
        kind, v = c.get("t", "n"), c.find(f"{_NS}v")
        if kind == "inlineStr":
            return "".join(t.text or "" for t in c.iter(f"{_NS}t"))
        if v is None or v.text is None:
            return None
        if kind == "s":
            return self.strings[int(v.text)]
        if kind == "b":
            return "true" if v.text == "1" else "false"
        if kind in ("str", "e"):
            return v.text
        if int(c.get("s", 0)) in self.dates:
            at = datetime.datetime(1899, 12, 30) + datetime.timedelta(days=float(v.text))
            return at.date().isoformat() if at.time() == datetime.time() else at.isoformat(sep=" ", timespec="seconds")
        x = float(v.text)
        return str(int(x)) if x.is_integer() and abs(x) < 1e15 else repr(x)


def column_index(letters: str) -> int:
    out = 0
    for ch in letters:
        out = out * 26 + ord(ch) - 64
    return out - 1


def read_sheet(spark: SparkSession, path: str, sheet: str) -> DataFrame:
    """A worksheet as text columns beside ``_source_row``, its header found by the same rule as in delimited files. An executor
    parses it as a stream."""
    from . import blocks

    return blocks.table(blocks.sheet_records(spark, path, sheet), letters=True, blank_rows=True).df
