"""Readers, layout, profiles, intervals, identifiers, ledger."""

import json

import pytest

from factloom.convention import STRICT, custom, from_datapackage
from factloom.errors import QueryValidationError
from factloom.operators import evidence, identifiers, intervals, ontology, profile
from factloom.sources import behaviour, delimited, files, layout


def test_delimited_locators_and_preamble(spark, tmp_path):
    f = tmp_path / "a.csv"
    f.write_text('Observer:,X\nDate:,today\nid,note,value\n1,"two\nlines",3\n\n2,plain,4\n3,short\n', encoding="utf-8")
    df = delimited.read(spark, str(f))
    assert df.columns == ["_file", "_source_row", "id", "note", "value"]
    assert [(r["_source_row"], r["id"], r["note"], r["value"]) for r in df.orderBy("_source_row").collect()] == [(5, "1", "two\nlines", "3"), (7, "2", "plain", "4"), (8, "3", "short", None)]


def test_delimiter_follows_the_bytes():
    assert layout.delimiter("x.csv", "a;b;c\n1;2;3\n") == ";"
    assert layout.delimiter("x.csv", "a,b\n1,2\n") == ","
    assert layout.delimiter("x.csv", "just\none\n") == ","
    assert layout.delimiter("x.dat", "a|b\n1|2\n") == "|"


def test_column_names_and_composition():
    assert layout.names(["a", "", "a", "a.1", "a"]) == ["a", "column_2", "a.1", "a.1.1", "a.2"]
    assert layout.names(["", ""], letters=True) == ["A", "B"]
    assert layout.compose([["dose", "", ""], ["lo", "hi", "x"]], fill=True) == ["dose / lo", "dose / hi", "dose / x"]


def test_profile_splits_missing_values(spark):
    df = spark.createDataFrame([("1", "NA", "x"), ("2", "", "unknown"), (None, "7", "y"), ("3", "8.5", "y")], "id string, v string, s string")
    got = {r["name"]: r for r in profile.profile(df).collect()}
    assert (got["v"]["dtype"], got["v"]["missing"], got["v"]["missing_empty"], got["v"]["missing_sentinel"]) == ("number", 2, 1, 1)
    assert got["s"]["ambiguous"] == 1 and got["s"]["missing"] == 0 and got["id"]["unique"] and got["id"]["dtype"] == "integer"
    strict = {r["name"]: r for r in profile.profile(df, convention=STRICT).collect()}
    assert strict["v"]["missing_sentinel"] == 0 and strict["v"]["dtype"] == "string"
    assert custom([" X "]).kind("x") == "sentinel"
    assert from_datapackage({"missingValues": ["-9"]}).kind("-9") == "sentinel"


def test_toggle_pairing(spark):
    rows = [("b", "groom", t, i, "STATE") for i, t in enumerate([4.25, 0.0, 12.3, 10.1, 20.0])] + [("b", "rear", 2.0, 9, "POINT"), ("a", "groom", 1.5, 0, "STATE"), ("a", "groom", 3.0, 1, "STATE"), ("a", "odd", 1.0, 2, None)]
    got = {(r["obs"], r["behavior"], r["start"]): (r["stop"], r["duration"], r["outcome"]) for r in intervals.pair(spark.createDataFrame(rows, "obs string, behavior string, time double, event_index int, type string"), ["obs", "behavior"]).collect()}
    assert got == {("b", "groom", 0.0): (4.25, 4.25, "paired"), ("b", "groom", 10.1): (12.3, 2.2, "paired"), ("b", "groom", 20.0): (None, None, "unmatched_start"), ("b", "rear", 2.0): (2.0, 0.0, "point"), ("a", "groom", 1.5): (3.0, 1.5, "paired"), ("a", "odd", 1.0): (None, None, "unknown_type")}


def test_behaviour_project(spark, tmp_path):
    doc = {
        "project_format_version": "7.0", "behaviors_conf": {"0": {"code": "groom", "type": "State event", "category": ""}}, "subjects_conf": {},
        "observations": {"o1": {"type": "MEDIA", "date": "2024", "file": {"1": ["dir/a.mp4"], "2": []}, "media_info": {"length": {"dir/a.mp4": 60.5}}, "events": [[1.5, "", "groom", "", ""], [3.0, "", "groom", "", ""]]}, "o2": {"events": []}},
    }
    (tmp_path / "p.boris").write_text(json.dumps(doc))
    p = behaviour.projects(spark, str(tmp_path))
    assert [(r["time"], r["behavior"]) for r in behaviour.events(p).orderBy("event_index").collect()] == [(1.5, "groom"), (3.0, "groom")]
    obs = {r["observation_id"]: r for r in behaviour.observations(p).collect()}
    assert obs["o1"]["media"] == "a.mp4" and obs["o1"]["media_duration"] == 60.5 and obs["o2"]["n_events"] == 0 and obs["o2"]["media_duration"] is None
    assert files.detect("p.boris", json.dumps(doc).encode()) == ("boris", False)
    assert files.detect("x.csv", b"\x89PNG\r\n\x1a\n") == ("png", True)


def test_inventory_identity_and_drift(spark, tmp_path):
    (tmp_path / "b.csv").write_text("x\n")
    (tmp_path / "a.txt").write_text("hello")
    inv = files.inventory(spark, str(tmp_path))
    assert sorted(files.walk(str(tmp_path))) == ["a.txt", "b.csv"] == sorted(r["path"] for r in inv.collect())
    assert files.dataset_id(inv) == files.fold(inv).first()[0]
    was = spark.createDataFrame(inv.collect(), inv.schema)
    (tmp_path / "a.txt").write_text("changed")
    assert [tuple(r) for r in files.drift(was, files.inventory(spark, str(tmp_path))).collect()] == [("a.txt", "changed")]


def test_identifiers(spark):
    v = {r["value"]: (r["schemes"], r["valid"]) for r in identifiers.validate(spark.createDataFrame([("0000-0002-1825-0097",), ("0000-0002-1825-0098",), ("10.1234/abc",), ("https://ror.org/02mhbdp94",), ("nope",)], "v string"), "v").collect()}
    assert v == {"0000-0002-1825-0097": ("orcid", True), "0000-0002-1825-0098": ("orcid", False), "10.1234/abc": ("doi", True), "https://ror.org/02mhbdp94": ("ror", True), "nope": ("", False)}
    got = identifiers.scan(spark.createDataFrame([(1, "see https://doi.org/10.5/x\nhttps://a.org/b. and 10.1234/xyz")], "k int, t string"), "k", "t").collect()
    assert sorted((r["scheme"], r["value"], r["line"]) for r in got) == [("doi", "10.1234/xyz", 2), ("uri", "https://a.org/b", 2)]


def test_ledger(spark):
    item = {"check": "table.column-dtype", "result": "integer", "source": "t#a"}
    df = evidence.ledger(spark, [("c", "t", [item]), ("c", "t", [item]), ("d", "u", [item])])
    assert df.count() == 2 and evidence.query(df, subject="t", check="table.column-dtype", contains="C").count() == 1
    for bad in ([("c", "t", [])], [("c", "t", [{"check": "none"}])]):
        with pytest.raises(QueryValidationError):
            evidence.record(bad)


def test_closure_with_a_cycle(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "a")], "node string, parent string")
    got = {(r[0], r[1]) for r in ontology.closure(e).collect()}
    assert got == {(x, y) for x in "abcd" for y in "abc"}
    assert ontology.literal_error("date", "2026-02-30") == "datatype_mismatch" and ontology.literal_error("integer", 3) is None


def test_closure_of_the_whole_table(spark, tmp_path):
    from factloom.plans import catalogue

    keys = [k for k in range(1, 600) if k not in (40, 300)]
    spark.createDataFrame([(k,) for k in keys], "c_custkey long").write.parquet(f"file://{tmp_path}/customer.parquet")
    want = set()
    for k in keys:
        up = k
        while up in keys and up // 2:
            up //= 2
            want.add((str(k), str(up)))
    rows = catalogue.QUERIES["ontology_closure_whole"](spark, f"file://{tmp_path}").collect()
    assert len(rows) == len(want) and {(r["node"], r["ancestor"]) for r in rows} == want


def test_keys_of_over_two_hundred_thousand_values(spark):
    ids = spark.range(200_001)
    assert [r["unique"] for r in profile.profile(ids).collect()] == [True]
    assert [r["unique"] for r in profile.profile(ids.unionAll(ids.limit(1))).collect()] == [False]


def test_a_registry_of_over_two_hundred_thousand_subjects(spark):
    rows = spark.range(200_001).selectExpr("id as `Subject ID`", "id % 3 as arm")
    assert [r["registry"] for r in profile.is_registry(profile.profile(rows)).collect()] == [True]
    assert [r["registry"] for r in profile.is_registry(profile.profile(rows.unionAll(rows.limit(1)))).collect()] == [False]


def test_check_digits_by_a_flat_sum(spark):
    def digit(d):
        total = 0
        for x in d:
            total = (total + int(x)) * 2
        return "0123456789X"[(12 - total % 11) % 11]

    texts = [f"{i * 7_919_191_919_191:015}" for i in range(60)] + ["000000021825009", "999999999999999"]
    whole = [d + digit(d) for d in texts] + [d + digit(d).lower() for d in texts[:9]] + [d + digit(texts[0][:14] + "5") for d in texts]
    df = spark.createDataFrame([("-".join(w[i : i + 4] for i in range(0, 16, 4)), w[15].upper() == digit(w[:15])) for w in whole], "v string, want boolean")
    out = df.select("want", identifiers.orcid_valid(df["v"]).alias("valid"))
    assert out.where("valid is distinct from want").count() == 0
    assert "lambda" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_closure_of_a_tree_makes_every_pair_once(spark, monkeypatch):
    rows, real = {}, ontology.written

    def written(df, name):
        out = real(df, name)
        rows[name] = rows.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(ontology, "written", written)
    monkeypatch.setattr(ontology, "FEW_EDGES", 0)
    tree = {i: {i // 2} for i in range(2, 64)} | {70: {71}, 71: {72, 5}, 72: {70}, 80: {70, 9, 4}, 81: {80}, 90: {90}}
    edges = [(str(n), str(p)) for n, ps in tree.items() for p in ps]

    def above(n):
        seen, todo = set(), list(tree.get(n, ()))
        while todo:
            if (p := todo.pop()) not in seen:
                seen.add(p)
                todo += tree.get(p, ())
        return seen

    got = [tuple(r) for r in ontology.closure(spark.createDataFrame([*edges, ("x", None)], "node string, parent string")).collect()]
    assert sorted(got) == sorted((str(n), str(a)) for n in tree for a in above(n))
    assert rows["closure"] > 150
