"""Changed files are withheld by every tool; files of any size are read in blocks; projects, keys and comparisons are kept apart."""

import hashlib
import json
import random

import pytest
from pyspark.errors import PySparkException

from factloom import dataset as datasets
from factloom.errors import QueryValidationError, Refusal
from factloom.operators import gold, intervals
from factloom.sources import behaviour, files

DECLARED = [{"left": "trials.csv", "right": "animals.csv", "left_keys": ["id"], "right_keys": ["id"]}]
COUNT = [{"op": "count", "name": "n"}]


@pytest.fixture
def held(spark, tmp_path):
    root = tmp_path / "data"
    root.mkdir()
    (root / "animals.csv").write_text("id,sex,weight\na,F,1.5\nb,M,2.5\nc,F,3.5,extra\n")
    (root / "trials.csv").write_text("id,latency\na,10\na,20\nb,30\n")
    (root / "README.md").write_text("# About\n")
    return root, datasets.ingest(spark, str(root))


def tools(d, relationship):
    e = d.engine
    return {
        "read_rows": lambda: e.read_rows("animals.csv"), "filter_rows": lambda: e.filter_rows("animals.csv", [{"column": "id", "op": "eq", "value": "a"}]),
        "aggregate": lambda: e.aggregate("animals.csv", COUNT), "units": lambda: e.aggregate("animals.csv", COUNT, unit=["id"]), "describe": lambda: e.describe_variable("animals.csv", "sex"),
        "profile": lambda: e.profile("animals.csv"), "contributors": lambda: e.contributors("animals.csv"), "join_tables": lambda: e.join_tables("trials.csv", "animals.csv", ["id"], ["id"]),
        "join_facts": lambda: e.join_facts("trials.csv", "animals.csv", ["id"], ["id"]), "aggregate_join": lambda: e.aggregate_join(COUNT, left="trials.csv", right="animals.csv", left_keys=["id"], right_keys=["id"]),
        "join_relationship": lambda: e.join_relationship(relationship), "aggregate_relationship": lambda: e.aggregate_join(COUNT, relationship), "get_relationship": lambda: d.get_relationship(relationship),
        "build_relationships": lambda: e.build_relationships(DECLARED), "inspect_file": lambda: d.inspect_file("animals.csv"), "scan": lambda: e.scan_identifiers("animals.csv", "id", "sex"),
    }


def test_every_tool_withholds_a_changed_file(spark, held):
    root, d = held
    assert "animals.csv: 1 row(s) do not have 3 fields" in d.warnings
    r = d.engine.build_relationships(DECLARED)[0]["id"]
    late = d.engine.read_rows("animals.csv")
    assert late.count() == 3 and d.verify_dataset() == {"dataset_id": d.dataset_id, "unchanged": True, "added": [], "removed": [], "changed": []}
    for name, call in tools(d, r).items():
        call(), name
    (root / "animals.csv").write_text("id,sex,weight\na,F,100\nb,M,100\nc,F,100\n")
    for name, call in tools(d, r).items():
        with pytest.raises(Refusal) as refused:
            call()
        assert refused.value.payload["content_withheld"] is True, name
    with pytest.raises(PySparkException, match="content_withheld"):  # planned before the change, run after it
        late.collect()
    assert d.engine.aggregate("trials.csv", COUNT).first()["n"] == 3
    (root / "new.txt").write_text("x")
    (root / "trials.csv").unlink()
    got = d.verify_dataset()
    assert (got["unchanged"], got["added"], got["removed"], got["changed"]) == (False, ["new.txt"], ["trials.csv"], ["animals.csv"])
    with pytest.raises(Refusal):
        d.engine.read_rows("trials.csv")


def test_files_of_any_size(spark, tmp_path):
    """A sparse file beyond two gigabytes, read in blocks; a project's keys and a compound file's stream across a block's edge."""
    size = 3 * (1 << 30) + 17
    with open(tmp_path / "big.tif", "wb") as f:
        f.write(b"II*\0")
        f.truncate(size)
    (tmp_path / "x.doc").write_bytes(b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1" + b"\0" * (files.BLOCK - 20) + "WordDocument".encode("utf-16-le") + b"\0\0")
    (tmp_path / "p.json").write_text(" " * (files.BLOCK - 10) + json.dumps({"behaviors_conf": {}, "observations": {}, "project_format_version": "7"}))
    got = {r["path"]: r for r in files.inventory(spark, str(tmp_path)).collect()}
    want = hashlib.sha256(b"II*\0")
    zeros, left = bytes(1 << 24), size - 4
    while left:
        n = min(left, len(zeros))
        want.update(zeros[:n])
        left -= n
    assert (got["big.tif"]["size"], got["big.tif"]["sha256"], got["big.tif"]["format"]) == (size, "sha256:" + want.hexdigest(), "tiff")
    assert got["x.doc"]["format"] == "doc" and got["p.json"]["format"] == "boris"


def test_projects_do_not_share_ethograms(spark):
    project = lambda kind: json.dumps({"behaviors_conf": {"0": {"code": "groom", "type": kind, "category": ""}}, "observations": {"o": {"events": [["1", "", "groom", ""], ["3", "", "groom", ""]]}}})
    p = behaviour.parsed(spark.createDataFrame([("a", project("State event")), ("b", project("Point event"))], "file string, value string"))
    got = sorted((r["file"], r["start"], r["stop"], r["outcome"]) for r in behaviour.intervals(p).collect())
    assert got == [("a", 1.0, 3.0, "paired"), ("b", 1.0, 1.0, "point"), ("b", 3.0, 3.0, "point")]


@pytest.mark.parametrize("spread", [1000, 3])
def test_long_keys_are_paired_in_blocks(spark, spread):
    r = random.Random(4)
    rows = [(r.choice(["x", "x", "x", "y", None]), r.choice([None, *range(spread)] if r.random() < 0.1 else range(spread)), i, r.choice(["STATE", "STATE", "STATE", "POINT"])) for i in range(1500)]
    rows = [(s, None if t is None else float(t), i, "STATE" if s != "y" else k) for s, t, i, k in rows]
    e = spark.createDataFrame(rows, "subject string, time double, event_index int, type string")
    whole = intervals.pair(e, ["subject"])
    cut = intervals.pair(e, ["subject"], long_rows=300)
    assert sorted(map(str, whole.collect())) == sorted(map(str, cut.collect()))
    assert "__block" in cut._jdf.queryExecution().analyzed().toString() and "__block" not in whole._jdf.queryExecution().analyzed().toString()


def test_repeated_keys_are_compared_only_when_reduced(spark):
    a = spark.createDataFrame([(1, 10.0), (1, 99.0), (2, None)], "k long, v double")
    b = spark.createDataFrame([(1, 109.0), (2, 4.0)], "k long, v double")
    assert [tuple(r) for r in gold.repeated(a, "k").collect()] == [(1, 2)] and gold.repeated(b, "k").count() == 0
    with pytest.raises(PySparkException, match="a key repeats"):
        gold.compare(a, b, "k", "v").collect()
    with pytest.raises(PySparkException, match="has no number"):
        gold.compare(a, b, "k", "v", reduce="sum").collect()
    full = a.where("v is not null")
    assert tuple(gold.compare(full, b, "k", "v", reduce="sum").first()) == (1, 0, 0, 1)
    assert tuple(gold.compare(full, b, "k", "v", reduce="mean").first()) == (1, 1, 0, 1)
    with pytest.raises(QueryValidationError):
        gold.compare(a, b, "k", "v", reduce="max")
