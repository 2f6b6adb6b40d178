"""A directory end to end: ingest, typed tables, claims, assessment, refusal on drift; worksheets, snapshots, labels."""

import hashlib
import json
import zipfile

import pytest

from factloom import dataset
from factloom.errors import QueryLookupError, QueryValidationError, Refusal
from factloom.operators import annotations, assessment, checks
from factloom.sources import snapshot, structured, workbook


@pytest.fixture
def root(tmp_path):
    d = tmp_path / "data"
    d.mkdir()
    (d / "animals.csv").write_text("animal_id,sex,weight\n" + "".join(f"{i},{'NA' if i == 3 else 'mf'[i % 2]},{20 + i / 2}\n" for i in range(1, 9)))
    (d / "dataset_description.json").write_text(json.dumps({"BIDSVersion": "1.8", "License": "CC0", "Authors": ["A"], "DatasetDOI": "10.1234/abc", "Data": "animals.csv", "vocab": "http://purl.obolibrary.org/obo/X"}))
    return d


def test_ingest_assess_and_drift(spark, root, tmp_path):
    d = dataset.ingest(spark, str(root))
    t = d.engine.table("animals.csv")
    assert t.kinds == {"_source_row": "integer", "animal_id": "integer", "sex": "string", "weight": "number"} and d.metadata == {"dataset_description.json": "bids"}
    got = {r["sex"]: r["n"] for r in d.engine.aggregate("animals.csv", [{"op": "count", "name": "n"}], ["sex"]).collect()}
    assert got == {"m": 4, "f": 3, None: 1}
    verdicts = {r["rule"]: r["result"] for r in d.assess().collect()}
    assert verdicts == {
        "F1-PID-METADATA": "pass", "F1-PID-RESOLVABLE": "unknown", "F2-METADATA-PRESENT": "pass", "F3-METADATA-LINKS-DATA": "pass", "F4-METADATA-MACHINE-READABLE": "pass", "A1-RETRIEVAL-PROTOCOL": "unknown",
        "I1-DATA-FORMATS-OPEN": "pass", "I2-VOCABULARY-REFERENCED": "pass", "R1.1-LICENCE-DECLARED": "pass", "R1.2-PROVENANCE-DECLARED": "pass", "R1.3-COMMUNITY-STANDARD": "pass", "R1.3-MISSING-VALUES-DECLARED": "fail",
    }
    assert {r["result"]: r["n"] for r in assessment.summary(d.assess()).collect()} == {"pass": 9, "fail": 1, "unknown": 2}
    d.write(str(tmp_path / "out"))
    first = (tmp_path / "out/manifest.json").read_bytes()
    dataset.ingest(spark, str(root)).write(str(tmp_path / "again"))
    assert first == (tmp_path / "again/manifest.json").read_bytes()
    with pytest.raises(Refusal):
        d.write(str(root / "inside"))
    assert d.ledger().where("subject = 'animals.csv'").count() >= 4
    (root / "animals.csv").write_text("changed\n")
    assert [tuple(r) for r in d.drift().collect()] == [("animals.csv", "changed")]
    with pytest.raises(Refusal):
        d.inspect_file("animals.csv")
    with pytest.raises(QueryLookupError):
        d.inspect_file("none.csv")
    assert "BIDS" in d.inspect_file("dataset_description.json")["preview"]


def test_absence_is_unknown_while_something_is_unread():
    c = checks.Catalogue({"a.csv": "csv", "b.xlsb": "xlsb"}, {}, ("b.xlsb",))
    assert checks.metadata_present(c)[0] == checks.licence(c)[0] == "unknown"
    assert checks.metadata_present(checks.Catalogue({"a.csv": "csv"}))[0] == "fail"
    assert checks.formats_open(c)[0] == "fail" and checks.missing_values(None, False)[0] == "not_applicable"


def test_modes():
    assert set(dataset.tools("structured")) < set(dataset.tools("fair-rules")) < set(dataset.tools("fair-deterministic"))
    with pytest.raises(QueryLookupError):
        dataset.tools("other")


def test_documents():
    assert structured.by_name("x/README.md") == "readme" and structured.by_name("data.csv") is None
    assert structured.by_content({"@context": ["https://schema.org/"]}) == "schema-org" and structured.by_content({"name": "x"}) is None
    assert structured.by_content({"resources": [{"path": "a"}]}) == "frictionless" and structured.by_content({"titles": [1], "creators": [2]}) == "datacite"
    assert structured.shape(b'{"b": [1, {"c": 2}], "a": 1}') == {"root": "object", "keys": ["a", "b"], "items": 2, "depth": 4, "error": None}
    assert structured.shape(b"{")["root"] == "invalid"


def test_worksheets(spark, tmp_path):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    sheet = f'<worksheet {ns}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c></row><row r="3"><c r="A3" t="s"><v>1</v></c><c r="B3" t="inlineStr"><is><t>when</t></is></c><c r="C3" t="str"><v>ok</v></c></row><row r="4"><c r="A4"><v>1.5</v></c><c r="B4" s="1"><v>45292</v></c><c r="C4" t="b"><v>1</v></c></row><row r="6"><c r="A6"><v>2</v></c><c r="D6"><v>9</v></c></row></sheetData></worksheet>'
    f = tmp_path / "b.xlsx"
    with zipfile.ZipFile(f, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="S 1" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/s1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>Title</t></si><si><r><t>va</t></r><r><t>lue</t></r></si></sst>")
        z.writestr("xl/styles.xml", f'<styleSheet {ns}><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>')
        z.writestr("xl/worksheets/s1.xml", sheet)
    df = workbook.read_sheet(spark, str(f), "S 1")
    assert df.columns == ["_source_row", "value", "when", "ok", "D"]
    assert [tuple(r) for r in df.orderBy("_source_row").collect()] == [(4, "1.5", "2024-01-01", "true", None), (6, "2", None, None, "9")]


def test_snapshot_is_pinned(tmp_path):
    (tmp_path / "bodies").mkdir()
    (tmp_path / "bodies/a").write_text("hello world")
    rows = [{"id": "a", "body_path": "bodies/a", "body_sha256": hashlib.sha256(b"hello world").hexdigest()}, {"id": "b", "body_path": None}]
    (tmp_path / "snapshot.json").write_text(json.dumps({"records": rows}))
    s = snapshot.Snapshot(str(tmp_path))
    assert s.read("a", 6, 3)["text"] == "wor" and s.read("b")["text"] is None and len(s.list()) == 2
    with pytest.raises(QueryValidationError):
        s.read("a", -1)
    with pytest.raises(QueryLookupError):
        s.read("c")
    (tmp_path / "bodies/a").write_text("other")
    with pytest.raises(Refusal):
        s.read("a")


def test_labels(spark, tmp_path):
    assert annotations.label("unknown") == "insufficient_evidence" and annotations.result("partial") == "partial" and annotations.result("partial", "fail") == "fail"
    with pytest.raises(QueryValidationError):
        annotations.label("none")
    schema = "criterion string, label string, family string, variant string, status string, method string"
    rows = [("c1", "conformant", "f", "v", "approved", "human"), ("c1", "partial", "f", "v", "draft", "human"), ("c2", "partial", "f", "w", "approved", "human")]
    assert [tuple(r) for r in annotations.reference_labels(spark.createDataFrame(rows, schema), "f", "v").collect()] == [("c1", "conformant")]
    with pytest.raises(Exception, match="disagree"):
        annotations.reference_labels(spark.createDataFrame([*rows, ("c1", "partial", "f", "v", "approved", "human")], schema), "f", "v").collect()
    records = [{"annotation_id": "x", "label": "partial"}]
    annotations.write_records(records, str(tmp_path))
    with pytest.raises(QueryValidationError):
        annotations.write_records([{"annotation_id": "y"}, *records], str(tmp_path))
    assert not (tmp_path / "y.json").exists()


def test_blocks_rows_above_and_principles(spark, root):
    (root / "t.csv").write_text("day one,,\nid,dose,\na,1,\nb,2,\n,,\nday two,,\nid,score,\na,7,\n")
    layouts = {"layouts": {"t.csv": {"blocks": [{"name": "one", "header_row": 2, "last_row": 4}, {"name": "two", "header_row": 7, "last_row": 8, "columns": "A:B"}]}}}
    d = dataset.ingest(spark, str(root), layouts=layouts)
    assert [(r["_source_row"], r["id"], r["score"]) for r in d.engine.table("t.csv#two").df.collect()] == [(8, "a", 7)]
    seen = d.inspect_table("t.csv#two", include_rows_above_data=True)
    assert seen["rows_above_data_available"] == 1 and [(r["row"], r["role"], r["value"]) for r in seen["rows_above_data"]] == [(6, "skipped", "day two")]
    assert d.get_evidence("t.csv#one", "layout.block").count() == 1 and d.get_provenance()["declared_layouts"] == {"t.csv#one": 2, "t.csv#two": 7}
    assert d.dataset_inventory()["files"] == 3 and [f["path"] for f in d.list_files("*.csv")] == ["animals.csv", "t.csv"]
    assert d.get_metadata()[0]["convention"] == "bids" and d.resolve_identifier("10.1234/ABC").count() == 1 and d.validate_identifier("10.1234/abc")["valid"]
    assert all(p["verdict"] == "unknown" for p in d.assess_fair_principles()) and d.run_fair_check("R1.1-LICENCE-DECLARED")["result"] == "pass"
    assert "R1.3-MISSING-VALUES-DECLARED" in [p["rule"] for p in d.get_fair_recommendations() if p["result"] == "fail"]
    made = d.annotations()
    assert len({a["annotation_id"] for a in made}) == len(made) == 12
    for bad in ({"layouts": {"none.csv": {"header_row": 1}}}, {"layouts": {"t.csv": {"blocks": [{"name": "a", "header_row": 1, "last_row": 4}, {"name": "b", "header_row": 3, "last_row": 8}]}}}, {"layouts": {}}):
        with pytest.raises(QueryValidationError):
            dataset.ingest(spark, str(root), layouts=bad)
    with pytest.raises(Refusal):
        d.probe_publication("https://example.org")


def test_event_shape_refuses_events(spark, tmp_path):
    doc = {"project_format_version": "7", "behaviors_conf": {"0": {"code": "groom", "type": "State event", "category": ""}}, "observations": {"o": {"events": [[1.5, "s", "groom", ""], [3.0, "s", "groom", ""]]}}}
    (tmp_path / "good.boris").write_text(json.dumps(doc))
    doc["observations"]["o"]["events"].append(["soon", "s", "groom"])
    (tmp_path / "odd.boris").write_text(json.dumps(doc))
    (tmp_path / "link.csv").symlink_to(tmp_path / "good.boris")
    d = dataset.ingest(spark, str(tmp_path))
    assert [(r["start"], r["stop"]) for r in d.engine.table("good.boris#intervals").df.collect()] == [(1.5, 3.0)]
    assert "odd.boris#events" not in d.engine.list_tables() and "odd.boris#ethogram" in d.engine.list_tables()
    assert any("another shape" in w for w in d.warnings) and "link.csv: left out (link)" in d.warnings
