"""Delimited text with preambles, quoted line breaks and row locators, read in byte ranges of any number.

Spark's text source deals out byte ranges and opens them through Hadoop's file systems, so a file of any size, on any store, is read
by many tasks. A range does not know whether it begins inside quotes, so it is read twice:

1. Every range tells, for both ways in which it may begin (at a record's start, or inside quotes), how it ends and how many records end
   in it, and how many lines it has. Composed in the order of the ranges these give the true beginning of each: one short record a
   range (and a file's header) is all that reaches the driver.
2. Every range is parsed from its true beginning. A record that crosses into other ranges leaves a fragment in each, and fragments
   are put together by file and number of the record.

A row's locator is the physical line on which its record ends, counted by prefix sums over ranges. Each file has its own delimiter and
header; columns of several files meet by name. Records are those of Python's csv module: a quote opens only at the start of a cell, two
quotes inside quotes are one, ``\\n``, ``\\r\\n`` and a lone ``\\r`` end lines. Ranges are cut at ``\\n``, so a file that has only lone ``\\r``
is one range.
"""

from __future__ import annotations

import csv
import dataclasses
import io
import itertools
import json
import os
import re
import sys
from collections.abc import Iterable, Iterator
from urllib.parse import unquote

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import layout

#: Records on which header and delimiter are decided, however long they are.
HEAD_RECORDS = 61
#: Where a first range holds fewer, ranges that begin in so many bytes add to it.
HEAD_BYTES = 1 << 20
BATCH_ROWS = 2000
RECORDS = "_file string, row long, starts long, cells array<string>, header int, record long, part binary, at long"
_LONE = re.compile(rb"(?<=\r)(?!\n)")
BOM = b"\xef\xbb\xbf"


def located(path: str) -> str:
    """A path as Spark takes it: what exists here is a local file, whose name is no pattern."""
    if "://" in path or not os.path.exists(path):
        return path
    return "file://" + re.sub(r"([\\*?\[\]{}])", r"\\\1", os.path.abspath(path))


def plain(uri: str) -> str:
    """A file's name as it was given: without the scheme of local files and its escapes."""
    return re.sub(r"^file:/+", "/", unquote(uri)) if uri.startswith("file:") else uri


def marked(path: str) -> bool:
    """Whether a file begins with a byte-order mark, which readers strip and a profile reports."""
    with open(path, "rb") as f:
        return f.read(3) == BOM


def physical(line: bytes) -> list[bytes]:
    """A line up to its line feed as physical lines with their ends."""
    whole = line + b"\n"
    return [x for x in _LONE.split(whole) if x] if b"\r" in line[:-1] else [whole]


def after(line: bytes, quoted: bool, delimiter: bytes) -> bool:
    """Whether a physical line that begins inside quotes, or at a record's start, ends inside quotes."""
    at, fresh = 0, True
    while True:
        if quoted:
            at = line.find(b'"', at) + 1
            if not at:
                return True
            if line[at : at + 1] == b'"':
                at += 1
                continue
            quoted, fresh = False, False
        elif fresh and line[at : at + 1] == b'"':
            quoted, at = True, at + 1
            continue
        at = line.find(delimiter, at) + 1
        if not at:
            return False
        fresh = True


@dataclasses.dataclass
class Range:
    """What a range says of itself: for each delimiter, how it ends and how many records end in it, entered at a record's start and inside
    quotes; and the head of the file, if it is the first."""

    delimiters: tuple[str, ...]
    lines: int = 0
    size: int = 0

    def __post_init__(self) -> None:
        self.ways = {d: [[False, 0], [True, 0]] for d in self.delimiters}
        self.head: list[bytes] = []

    def add(self, lines: list[bytes], simple: list[bool], first: bool, most: int) -> None:
        """More lines of the range; a simple one has neither quote nor return, so it ends as it began."""
        self.size += sum(map(len, lines)) + len(lines)
        for alike, part in itertools.groupby(zip(simple, lines, strict=True), key=lambda x: x[0]):
            own = [line for _, line in part]
            if first and (short := most - min(w[0][1] for w in self.ways.values())) > 0:
                self.head += own[:short] if alike else own
            if alike:
                self.lines += len(own)
                for w in itertools.chain.from_iterable(self.ways.values()):
                    w[1] += 0 if w[0] else len(own)
                continue
            for line in itertools.chain.from_iterable(map(physical, own)):
                self.lines += 1
                for d, ways in self.ways.items():
                    for w in ways:
                        w[0] = after(line, w[0], d.encode())
                        w[1] += not w[0]


def runs(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int, int], list[bytes], list[bool]]]:
    """(file, start, file size), the lines of one range that stand in one batch, and which of them have neither quote nor return."""
    for batch in batches:
        if not batch.num_rows:
            continue
        starts = batch.column(1).to_pylist()
        names = batch.column(0).to_pylist()
        sizes = batch.column(2).to_pylist()
        text = batch.column(3)
        simple = pc.invert(pc.or_(pc.match_substring(text, '"'), pc.match_substring(text, "\r"))).to_pylist()
        lines = text.cast(pa.binary()).to_pylist()
        cuts = [0, *[i for i in range(1, len(lines)) if starts[i] != starts[i - 1] or names[i] != names[i - 1]], len(lines)]
        for a, b in itertools.pairwise(cuts):
            yield (names[a], starts[a], sizes[a]), lines[a:b], simple[a:b]


def without_mark(key: tuple[str, int, int], lines: list[bytes]) -> list[bytes]:
    """Lines of a file's first batch without a byte-order mark."""
    return [lines[0].removeprefix(BOM), *lines[1:]] if key[1] == 0 and lines else lines


def settle(path: str, head: list[bytes], options: dict) -> dict[str, object]:
    """Delimiter and header of a file, as declared or as found on its head."""
    text = b"\n".join(head).decode("utf-8")
    d = options.get("delimiter") or layout.delimiter(path, text) or ","
    reader = csv.reader(io.StringIO(text, newline=""), delimiter=d)
    rows = []
    for cells in reader:
        rows.append((reader.line_num, cells))
    if options.get("headerrow"):
        row, many = int(options["headerrow"]), int(options.get("headerrows", 1))
        block = [c for n, c in rows if row <= n < row + many]
        found = layout.Header(row + many - 1, layout.names(layout.compose(block, options.get("fill") == "true") if many > 1 else block[0]), [], True)
    else:
        found = layout.find_header(rows[:HEAD_RECORDS])
    return {"delimiter": d, **dataclasses.asdict(found)}


@dataclasses.dataclass(frozen=True)
class Survey:
    """The files of a reading: their headers, and where every range begins."""

    headers: dict[str, tuple[str, layout.Header]]
    begins: dict[tuple[str, int], tuple[bool, int, int]]
    #: Files whose last line has no end, by their last range.
    open_ended: frozenset[tuple[str, int]]

    @property
    def labels(self) -> list[list[str]]:
        return [list(x) for x in dict.fromkeys(tuple(h.labels) for _, h in self.headers.values())]


def lines_of(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.option("lineSep", "\n").text(located(path))
    return rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.col("_metadata.file_size").alias("size"), "value")


def told_head(key: tuple[str, int, int], r: Range, most: int, options: dict) -> str | None:
    """What a first range says of the header, or the lines that help to settle it where that range is short."""
    if key[1] == 0 and (min(w[0][1] for w in r.ways.values()) >= most or r.size >= key[2]):
        return json.dumps({"settled": settle(plain(key[0]), r.head, options)})
    return json.dumps({"lines": [x.decode("utf-8") for x in r.head]}) if key[1] < HEAD_BYTES else None


def survey(lines: DataFrame, options: dict) -> Survey:
    most = max(HEAD_RECORDS, int(options.get("headerrow") or 0) + int(options.get("headerrows") or 1) + 1)
    delimiters = (options["delimiter"],) if options.get("delimiter") else layout.DELIMITERS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        csv.field_size_limit(sys.maxsize)
        for key, parts in itertools.groupby(runs(batches), key=lambda r: r[0]):
            r, fresh = Range(delimiters), True
            for _, found, simple in parts:
                r.add(without_mark(key, found) if fresh else found, simple, key[1] < HEAD_BYTES, most)
                fresh = False
            head = told_head(key, r, most, options)
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in ((key[0], pa.string()), (key[1], pa.int64()), (key[2], pa.int64()), (r.lines, pa.int64()), (r.size, pa.int64()), (json.dumps(r.ways), pa.string()), (head, pa.string()))], names=["file", "at", "size", "n", "bytes", "ways", "head"])

    found = lines.mapInArrow(run, "file string, at long, size long, n long, bytes long, ways string, head string").collect()  # one row a range
    return composed([r.asDict() for r in found], options)


def composed(ranges: list[dict], options: dict | None = None) -> Survey:
    """The true beginning of every range: inside quotes or not, number of its first line, number of the record that it begins in."""
    headers, begins, open_ended = {}, {}, set()
    for name, own in itertools.groupby(sorted(ranges, key=lambda r: (r["file"], r["at"])), key=lambda r: r["file"]):
        quoted, line, record, size, own = False, 1, 0, 0, list(own)
        heads = [json.loads(r["head"]) for r in own if r["head"] is not None]
        h = heads[0].get("settled") or settle(plain(name), [x.encode() for part in heads for x in part["lines"]], options or {})
        headers[name] = (h["delimiter"], layout.Header(h["row"], h["labels"], [tuple(s) for s in h["skipped"]], h["confident"]))
        for r in own:
            begins[name, r["at"]] = (quoted, line, record)
            ended, n = json.loads(r["ways"])[headers[name][0]][quoted]
            quoted, line, record, size = ended, line + r["n"], record + n, size + r["bytes"]
        if size - r["size"] in (1, 1 - len(BOM)):  # the last line was given an end that the file does not have; a mark was stripped
            open_ended.add((name, r["at"]))
    return Survey(headers, begins, frozenset(open_ended))


class Feed:
    """Gives a csv reader its lines, keeps those of the record that is being read, and knows when there are no more."""

    def __init__(self, parts: Iterator[list[bytes]], quoted: bool) -> None:
        self.lines, self.quoted, self.held, self.over = (x for part in parts for line in part for x in physical(line)), quoted, [], False

    def __iter__(self) -> Iterator[str]:
        for line in self.lines:
            self.held.append(line)
            text = line.decode("utf-8")
            yield f'"{text}' if self.quoted else text  # a range that begins inside quotes
            self.quoted = False
        self.over = True


def parsed(parts: Iterator[list[bytes]], delimiter: str, begin: tuple[bool, int, int], open_ended: bool) -> Iterator[tuple[int, int, list[str] | None, int, bytes | None]]:
    """(last line, first line, cells, number, None) of records that lie in this range, (line, line, None, number, bytes) of fragments."""
    quoted, line, number = begin
    feed = Feed(parts, quoted)
    reader = csv.reader(iter(feed), delimiter=delimiter)
    for cells in reader:
        raw, feed.held = feed.held, []
        if feed.over or quoted:
            text = b"".join(raw)
            if feed.over and open_ended:
                text = text.removesuffix(b"\n")
            yield line, line, None, number, text
        else:
            yield line + len(raw) - 1, line, cells, number, None
        quoted, line, number = False, line + len(raw), number + 1


def numbered(lines: DataFrame, s: Survey, keep_all: bool, last: int) -> DataFrame:
    """Records (without those up to the header, and empty ones, unless all are kept) and fragments of all files."""
    known, labels = lines.sparkSession.sparkContext.broadcast((s.headers, s.begins, s.open_ended)), s.labels
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.int32(), pa.int64(), pa.binary(), pa.int64()]
    names = [x.strip().split(" ")[0] for x in RECORDS.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        csv.field_size_limit(sys.maxsize)
        headers, begins, open_ended = known.value
        for key, parts in itertools.groupby(runs(batches), key=lambda r: r[0]):
            name, at, _ = key
            d, header = headers[name]
            sign = labels.index(header.labels)
            found = (without_mark(key, p[1]) if i == 0 else p[1] for i, p in enumerate(parts))
            out: list[tuple] = []
            for row, first, cells, number, part in parsed(found, d, begins[name, at], (name, at) in open_ended):
                if part is None and not keep_all and (not cells or row <= (header.row or 0) or (last and row > last)):
                    continue
                out.append((plain(name), row, first, cells, sign, number, part, at))
                if len(out) == BATCH_ROWS:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    return lines.mapInArrow(run, RECORDS)


def mended(found: DataFrame, s: Survey, keep_all: bool, last: int) -> DataFrame:
    """Records that were cut by the edges of ranges, from their fragments."""
    headers, labels = {plain(n): h for n, h in s.headers.items()}, s.labels
    whole = found.where("part is not null").groupBy("_file", "record").agg(F.array_sort(F.collect_list(F.struct("at", "starts", "part"))).alias("parts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        csv.field_size_limit(sys.maxsize)
        for batch in batches:
            out: list[tuple] = []
            for name, parts in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                d, header = headers[name]
                text = b"".join(p["part"] for p in parts)
                reader = csv.reader(io.StringIO(text.decode("utf-8"), newline=""), delimiter=d)
                cells = next(reader)
                first = parts[0]["starts"]
                row = first + reader.line_num - 1
                if keep_all or (cells and row > (header.row or 0) and not (last and row > last)):
                    out.append((name, row, first, cells, labels.index(header.labels)))
            columns = list(zip(*out, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.int32()), strict=True)], names=["_file", "row", "starts", "cells", "header"])

    return whole.mapInArrow(run, "_file string, row long, starts long, cells array<string>, header int")


def _records(spark: SparkSession, path: str, options: dict, keep_all: bool) -> tuple[DataFrame, Survey]:
    lines = lines_of(spark, path)
    s = survey(lines, options)
    last = int(options.get("lastrow") or 0)
    found = numbered(lines, s, keep_all, last)
    columns = ["_file", "row", "starts", "cells", "header"]
    if all(not quoted for quoted, *_ in s.begins.values()) and not s.open_ended:
        return found.where("part is null").select(*columns), s  # no record crosses a range
    return found.where("part is null").select(*columns).unionByName(mended(found, s, keep_all, last)), s


def records(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """Every record as it stands: ``_file``, ``row`` and ``starts`` (the lines on which it ends and begins), ``cells``."""
    return _records(spark, path, options, True)[0].drop("header")


def header(spark: SparkSession, path: str, **options: str) -> tuple[str, layout.Header]:
    """Delimiter and header of one file."""
    return next(iter(survey(lines_of(spark, path), options).headers.values()))


def read(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """The rows of a file or of the files of a folder: ``_file``, ``_source_row`` and a text column for each name in any header; a file
    without a column leaves it null. Options: delimiter, headerrow, headerrows, fill, lastrow."""
    rows, s = _records(spark, path, options, False)
    names = dict.fromkeys(n for labels in s.labels for n in labels)
    cell = lambda n: F.coalesce(*[F.when(F.col("header") == k, F.get("cells", F.lit(labels.index(n)))) for k, labels in enumerate(s.labels) if n in labels])
    return rows.select("_file", F.col("row").alias("_source_row"), *[cell(n).alias(n) for n in names])


def ragged(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """(_file, width, rows, ragged, shorter, longer) per file: how many rows do not have as many cells as their header."""
    rows, s = _records(spark, path, options, False)
    width = F.coalesce(*[F.when(F.col("header") == k, len(labels)) for k, labels in enumerate(s.labels)], F.lit(0))
    n = F.size("cells")
    sizes = rows.select("_file", width.cast("long").alias("width"), n.alias("n"))
    return sizes.groupBy("_file", "width").agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("n") != F.col("width")).alias("ragged"), F.count_if(F.col("n") < F.col("width")).alias("shorter"), F.count_if(F.col("n") > F.col("width")).alias("longer"))
