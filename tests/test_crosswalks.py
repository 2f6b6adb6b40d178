"""Crosswalks as tables refuse what the strict reader refuses, with the same lines; full mapping facts; resolver widths."""

import pytest

from factloom.engine import Engine
from factloom.errors import QueryValidationError
from factloom.operators import crosswalks, identity, joins

GOOD = "note,canonical_id,form\n,a1, A-1 \n,a1,A 1\n\n,b2,B-2\n"
WRONG = "canonical_id,form\na1,A-1\n,B\nb2,\nc3,C,more\nb2,A-1\na1,A-1\n\"d\n4\",D\nd5,D\n"


def test_equals_the_strict_reader(spark, tmp_path):
    (tmp_path / "good.csv").write_text(GOOD)
    got = crosswalks.read(spark, str(tmp_path / "good.csv"), "good")
    want = identity.parse_crosswalk(GOOD.encode(), "good")
    assert {tuple(r) for r in got.rows(spark).select("form", "canonical_id").collect()} == set(want.forms.items()) and got.sha256 == want.sha256


def test_refusals_name_lines(spark, tmp_path):
    (tmp_path / "wrong.csv").write_text(WRONG)
    found = crosswalks.problems(crosswalks.cells_of(spark, str(tmp_path / "wrong.csv"))).orderBy("line").collect()
    assert [(r["line"], r["problem"], r["first_line"]) for r in found] == [(3, "empty", None), (4, "empty", None), (5, "ragged", None), (6, "claimed", 2), (7, "repeated", 2), (10, "claimed", 9)]
    with pytest.raises(QueryValidationError, match="6 wrong line.*line 6: the form already stands at line 2 for another id"):
        crosswalks.read(spark, str(tmp_path / "wrong.csv"), "wrong")
    with pytest.raises(QueryValidationError) as strict:
        identity.parse_crosswalk(WRONG.encode(), "wrong")
    assert all(f"line {r['line']}:" in str(strict.value) for r in found)
    for text in ("canonical_id,other\n1,2\n", "canonical_id,form\n", ""):
        (tmp_path / "w.csv").write_text(text)
        with pytest.raises(QueryValidationError):
            crosswalks.read(spark, str(tmp_path / "w.csv"), "w")


def test_facts_and_joins_through_the_service(spark, tmp_path):
    (tmp_path / "good.csv").write_text(GOOD)
    e = Engine(spark)
    e.register("left", spark.createDataFrame([(1, "A-1"), (2, "A 1"), (3, "a1"), (4, None), (5, "zz"), (6, "zz"), (7, "B-2")], "id long, form string"), "id")
    e.register("right", spark.createDataFrame([("A-1",), ("zz",)], "form string"))
    e.register_crosswalk_file("good", str(tmp_path / "good.csv"))
    got = e.mapping_facts("left", ["form"], "good", "right", ["form"]).first().asDict()
    assert got == {
        "mapped_rows": 3, "unmapped_rows": 3, "incomplete_rows": 1, "mapped_distinct_values": 3, "unmapped_distinct_values": 2, "distinct_forms": 5, "forms_unique": False, "mapped_distinct_canonical_ids": 2,
        "canonical_ids_with_several_forms": 1, "max_forms_per_canonical_id": 2, "unmatched_distinct_keys": 2, "unmapped_equal_to_a_canonical_id": 1,
    }
    forms = e.crosswalk("good")
    sides = [identity.resolve(e.table(t), ["form"], None, forms) for t in ("left", "right")]
    shown = {(r["kind"], r["text"]): (r["rows"], r["locators"]) for r in crosswalks.examples(*sides, "id").collect()}
    assert shown == {("unmapped", "a1"): (1, [3]), ("unmapped", "zz"): (2, [5, 6]), ("unmatched", "a1"): (1, [3]), ("unmatched", "b2"): (1, [7])}
    page = e.join_tables("left", "right", ["form"], ["form"], crosswalk="good", forms_per_canonical=["left"])
    assert page.total_result_rows == 4
    found = e.build_relationships([{"left": "left", "right": "right", "left_keys": ["form"], "right_keys": ["form"], "crosswalk": "good", "forms_per_canonical": ["left"]}])
    assert found[0]["matched_keys"] == 2 and found[0]["status"] == "declared"


def test_widths():
    assert crosswalks.checked(["a", "b"], None, False, False) == 2 and crosswalks.checked(["a", "b"], "{a}-{b}", False, False) == 1
    assert crosswalks.checked(["a"], None, True, False) == 1 and crosswalks.checked(["a"], None, False, True) == 1
    for bad in (([], None, False, False), (["a", "b"], None, True, False), (["a", "b"], None, False, True), (["a"], None, False, False, "many"), (["a"], None, True, False, "few")):
        with pytest.raises(QueryValidationError):
            crosswalks.checked(*bad)


def test_sides_that_write_many_forms(spark):
    from factloom.types import Table

    t = Table("t", spark.createDataFrame([("x",)], "k string"))
    for forms in (["left"], ["middle"]):
        with pytest.raises(QueryValidationError):
            joins.resolved_join(t, t, ["k"], ["k"], forms_per_canonical=forms)
