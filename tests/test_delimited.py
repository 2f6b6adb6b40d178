"""Delimited text cut into byte ranges gives the rows and locators of one pass; headers per file; ragged rows."""

import csv
import io
import itertools
import json
import random

import pytest

from factloom.sources import delimited

TEXTS = [
    'id,note\n1,"two\nlines"\n\n2,"a ""q"" b"\r\n3,in"side\n"x"y,4\n5,"unclosed\nto the end',
    'a;"b\r\nc";d\r\r\n"";"""";\n";\n;\n"\n1;2\n',
    "﻿one,two\n1,2",
    '"first\n\n\ncell","x"\n' + 'plain,row\n' * 3 + '"\n"',
    "only\rreturns,\"a\rb\"\rend",
    "\n\n",
    'é,"ü\nß"\n日,本\n',
]


def by_one_pass(text, d):
    out, reader, last = [], csv.reader(io.StringIO(text, newline=""), delimiter=d), 0
    for cells in reader:
        out.append((reader.line_num, last + 1, cells))
        last = reader.line_num
    return out


def ranges_of(raw, cuts):
    """Lines by the rule of byte ranges: a range has the lines that begin after its start and not after its end."""
    edges = [0, *cuts, len(raw)]
    starts, at = [], 0
    for line in raw.split(b"\n")[: None if not raw.endswith(b"\n") else -1]:
        starts.append((at, line))
        at += len(line) + 1
    return [(a, [line for s, line in starts if (a < s or a == 0) and s <= b]) for a, b in itertools.pairwise(edges)]


def by_ranges(raw, cuts, d):
    own = [(a, lines) for a, lines in ranges_of(raw, cuts) if lines]
    simple = lambda lines: [b'"' not in x and b"\r" not in x for x in lines]
    told = []
    for a, lines in own:
        r = delimited.Range((d,))
        lines = delimited.without_mark(("f", a, 0), lines)
        for k in range(0, len(lines), 2):  # batches of two lines
            r.add(lines[k : k + 2], simple(lines[k : k + 2]), True, 61)
        told.append({"file": "f", "at": a, "size": len(raw), "n": r.lines, "bytes": r.size, "ways": json.dumps(r.ways), "head": delimited.told_head(("f", a, len(raw)), r, 61, {"delimiter": d})})
    s = delimited.composed(told, {"delimiter": d})
    out, fragments = [], {}
    for a, lines in own:
        lines = delimited.without_mark(("f", a, 0), lines)
        for row, first, cells, number, part in delimited.parsed(iter([lines[:1], lines[1:]]), d, s.begins["f", a], ("f", a) in s.open_ended):
            if part is None:
                out.append((row, first, cells))
            else:
                fragments.setdefault(number, []).append((a, first, part))
    for parts in fragments.values():
        parts.sort()
        reader = csv.reader(io.StringIO(b"".join(p for *_, p in parts).decode(), newline=""), delimiter=d)
        cells = next(reader)
        out.append((parts[0][1] + reader.line_num - 1, parts[0][1], cells))
    return sorted(out)


@pytest.mark.parametrize("text", TEXTS)
def test_every_cut_gives_the_rows_of_one_pass(text):
    raw, d = text.encode(), ";" if ";" in text else ","
    want = by_one_pass(text.removeprefix("﻿"), d)
    assert by_ranges(raw, [], d) == want
    for c in range(1, len(raw)):
        assert by_ranges(raw, [c], d) == want, c
    for cuts in itertools.combinations(range(1, len(raw)), 2):
        assert by_ranges(raw, cuts, d) == want, cuts
    assert by_ranges(raw, range(1, len(raw)), d) == want


def test_many_cuts_of_made_up_text():
    r = random.Random(2)
    for _ in range(300):
        text = "".join(r.choice(['"', '"', ",", "\n", "\r\n", "\r", "a", "b "]) for _ in range(r.randint(1, 40)))
        raw = text.encode()
        cuts = sorted(r.sample(range(1, len(raw)), min(len(raw) - 1, r.randint(0, 4)))) if len(raw) > 1 else []
        assert by_ranges(raw, cuts, ",") == by_one_pass(text, ","), (text, cuts)


@pytest.mark.parametrize("size", ["7", "64"])
def test_spark_cuts_files_anywhere(spark, tmp_path, size):
    text = "﻿Observer:,someone\nid,note,value\n" + "".join(f'{i},"note ""{i}""\nof two lines, é",{i * i}\n' if i % 3 else f"{i},,\n\n" for i in range(40)) + '99,"last\none'
    (tmp_path / "a b.csv").write_text(text, encoding="utf-8", newline="")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        df = delimited.read(spark, str(tmp_path / "a b.csv"))
        assert df.columns == ["_file", "_source_row", "id", "note", "value"] and df.rdd.getNumPartitions() > 8
        got = sorted(tuple(r) for r in df.collect())
        everything = delimited.records(spark, str(tmp_path / "a b.csv")).select("row", "starts", "cells").orderBy("starts").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    want = by_one_pass(text.removeprefix("﻿"), ",")
    pad = lambda c: (*c, *[None] * (3 - len(c)))
    assert got == sorted((str(tmp_path / "a b.csv"), row, *pad(c)) for row, _, c in want if c and row > 2)
    assert [tuple(r) for r in everything] == want


def test_each_file_has_its_own_header(spark, tmp_path):
    (tmp_path / "x.csv").write_text("a,b\n1,2\n3\n")
    (tmp_path / "y.csv").write_text("who: me,,\n\nb,a,c\n10,20,30\n11,21,31,41\n")
    (tmp_path / "z.csv").write_text("")
    df = delimited.read(spark, str(tmp_path))
    assert df.columns[2:] == ["a", "b", "c"]
    assert sorted(tuple(r)[1:] for r in df.collect()) == [(2, "1", "2", None), (3, "3", None, None), (4, "20", "10", "30"), (5, "21", "11", "31")]
    assert sorted(tuple(r)[1:] for r in delimited.ragged(spark, str(tmp_path)).collect()) == [(2, 2, 1, 1, 0), (3, 2, 1, 0, 1)]
    declared = delimited.read(spark, str(tmp_path / "y.csv"), delimiter=",", headerrow="3", lastrow="4")
    assert [tuple(r)[1:] for r in declared.collect()] == [(4, "10", "20", "30")]


def test_names_that_look_like_patterns(spark, tmp_path):
    for name in ("b[1].csv", "b1.csv", "{x,y}*?.csv"):
        (tmp_path / name).write_text(f"id,name\n1,{name[0]}{len(name)}\n")
    for name in ("b[1].csv", "b1.csv", "{x,y}*?.csv"):
        assert [tuple(r) for r in delimited.read(spark, str(tmp_path / name)).collect()] == [(str(tmp_path / name), 2, "1", f"{name[0]}{len(name)}")]


def test_a_head_longer_than_any_prefix(spark, tmp_path):
    long = "x" * 200_000
    (tmp_path / "a.csv").write_text(f'id;"{long}";last\n1;"{long},";3\n')
    df = delimited.read(spark, str(tmp_path / "a.csv"))
    assert df.columns[2:] == ["id", long, "last"] and [len(r[3]) for r in df.collect()] == [200_001]
