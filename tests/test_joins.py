"""Joins, declared identity, relationships."""

import pytest

from factloom.engine import Engine
from factloom.errors import QueryLookupError, QueryValidationError, Refusal
from factloom.operators import identity, joins
from factloom.types import Table

CROSSWALK = b"canonical_id,form,note\nZ-7_L,Z-7-L,\nZ-7_L,Z7-L,\nZ-7_R,Z-7-R,\nZ-7_R,Z7-R,\nZ-8_L,Z-8-L,\nZ-8_L,Z8-L,\n"


@pytest.fixture(scope="module")
def engine(spark):
    e = Engine(spark)
    e.register("registry", spark.createDataFrame([("Z-7", "L", "ctrl"), ("Z-7", "R", "test"), ("Z-8", "L", "test"), ("Z-9", "L", "ctrl")], "cage string, tail string, grp string"))
    e.register("sessions", spark.createDataFrame([("Z7-L", 1, 3.5), ("Z7-L", 2, 4.0), ("Z7-R", 1, 2.0), ("Z8-L", 1, 1.5), ("Q5-X", 1, 9.9)], "animal string, session int, score double"))
    e.register_crosswalk("cw", CROSSWALK)
    return e


def test_crosswalk_join(engine):
    got = engine.join_tables("registry", "sessions", ["cage", "tail"], ["animal"], crosswalk="cw", left_key_format="{cage}-{tail}").rows.collect()
    assert sorted((r["key.canonical_id"], r["right.session"]) for r in got) == [("Z-7_L", 1), ("Z-7_L", 2), ("Z-7_R", 1), ("Z-8_L", 1)]
    facts = identity.mapping_facts(identity.resolve(engine.table("sessions"), ["animal"], crosswalk=engine.crosswalk("cw"))).first()
    assert (facts["mapped_rows"], facts["mapped_distinct"], facts["unmapped_rows"]) == (4, 3, 1)


def test_several_forms_refuse_unless_declared(spark, engine):
    e = Engine(spark)
    e.register("registry", engine.table("registry").df)
    e.register("scoring", spark.createDataFrame([("Z7-L", 10), ("Z7-L", 20), ("Z-7-L", 30), ("Z8-L", 4)], "obs string, dur int"))
    e.register_crosswalk("cw", CROSSWALK)
    ask = {"crosswalk": "cw", "left_key_format": "{cage}-{tail}"}
    with pytest.raises(Refusal):
        e.join_tables("registry", "scoring", ["cage", "tail"], ["obs"], **ask)
    assert e.join_tables("registry", "scoring", ["cage", "tail"], ["obs"], forms_per_canonical=["right"], **ask).rows.count() == 4


def test_rendering_collision_always_refuses(spark):
    t = Table("t", spark.createDataFrame([("1", "11"), ("11", "1")], "a string, b string"))
    with pytest.raises(Refusal):
        joins.resolved_join(t, t, ["a", "b"], ["a", "b"], left_key_format="{a}{b}", right_key_format="{a}{b}")


def test_many_to_many(spark):
    t = Table("t", spark.createDataFrame([("A", 1), ("A", 2), (None, 3)], "id string, v int"))
    assert joins.join(t, t, ["id"], ["id"]).count() == 4
    d = joins.diagnostics(t, t, ["id"], ["id"], "left").first()
    assert (d["cardinality"], d["total_result_rows"], d["left_incomplete"]) == ("many_to_many", 5, 1)
    assert joins.join(t, t, ["id"], ["id"], "left").count() == 5
    with pytest.raises(QueryValidationError):
        joins.aggregate_join(t, t, ["id"], ["id"], [{"op": "count"}])


def test_text_never_meets_numbers(spark):
    a, b = Table("a", spark.createDataFrame([(7,)], "k int")), Table("b", spark.createDataFrame([("7",)], "k string"))
    assert joins.join(a, b, ["k"], ["k"]).count() == 0
    assert joins.diagnostics(a, b, ["k"], ["k"]).first()["matched_keys"] == 0
    c = Table("c", spark.createDataFrame([(7.0, True)], "k double, b boolean"))
    assert joins.join(a, c, ["k"], ["k"]).count() == 1
    one = Table("one", spark.createDataFrame([(1,)], "k int"))
    assert joins.join(one, c, ["k"], ["b"]).count() == 1


def test_key_formats():
    f = identity.parse_key_format("{{{a}}}-{b}", ["a", "b"])
    assert f.parts == (("{", "a"), ("}-", "b"), ("", None)) and not f.adjacent
    assert identity.parse_key_format("{a}{b}", ["a", "b"]).adjacent
    for bad, keys in (("{a}", ["a", "b"]), ("{c}", ["a"]), ("{a", ["a"]), ("", ["a"])):
        with pytest.raises(QueryValidationError):
            identity.parse_key_format(bad, keys)


def test_numbers_render_without_exponents(spark):
    t = Table("t", spark.createDataFrame([(7.0,), (12345678.5,), (0.0005,)], "k double"))
    assert [r[0] for r in t.df.select(identity.as_text(t, "k")).collect()] == ["7.0", "12345678.5", "0.0005"]


@pytest.mark.parametrize("content", [b"canonical_id,form\nA,x\nB,x\n", b"canonical_id,form\nA,\n", b"id,form\nA,x\n", b"canonical_id,form\n", b"canonical_id,form\nA,x,y\n"])
def test_crosswalk_files_are_strict(content):
    with pytest.raises(QueryValidationError):
        identity.parse_crosswalk(content, "c")


def test_relationships(engine, spark):
    e = Engine(spark)
    e.register("animals", spark.createDataFrame([(1, "KO"), (2, "WT"), (3, "WT")], "animal_id int, genotype string"))
    e.register("obs", spark.createDataFrame([(1, 1.0), (1, 2.0), (2, 3.0), (None, 1.0)], "`Animal ID` int, latency double"))
    found = e.build_relationships()
    assert [(r["left"], r["right"], r["status"], r["cardinality"], r["joined_rows"]) for r in found] == [("animals", "obs", "candidate", "one_to_many", 3)]
    with pytest.raises(QueryValidationError):
        e.join_relationship(found[0]["id"])
    d = {"left": "animals", "right": "obs", "left_keys": ["animal_id"], "right_keys": ["Animal ID"], "expected_cardinality": "one_to_many"}
    declared = e.build_relationships([d])
    assert declared[0]["id"] == found[0]["id"] and declared[0]["status"] == "declared"
    got = e.aggregate_join([{"op": "mean", "column": "right.latency", "name": "m"}], declared[0]["id"], group_by=["left.genotype"], reasons=False)
    assert {r["left.genotype"]: r["m"] for r in got.collect()} == {"KO": 1.5, "WT": 3.0}
    assert e.build_relationships([d | {"expected_cardinality": "one_to_one"}])[0]["status"] == "rejected"
    with pytest.raises(QueryLookupError):
        e.get_relationship("rel_none")
    with pytest.raises(QueryLookupError):
        e.table("none")


def test_many_to_many_is_refused_on_resolved_keys_too(spark):
    t = Table("t", spark.createDataFrame([("A", 1), ("A", 2), (None, 3)], "id string, v int"))
    with pytest.raises(QueryValidationError):
        joins.aggregate_join(t, t, ["id"], ["id"], [{"op": "count"}], resolved={"left_key_format": "k{id}", "right_key_format": "k{id}"})
    facts = joins.resolved_diagnostics(t, t, ["id"], ["id"], left_key_format="k{id}", right_key_format="k{id}").first()
    assert (facts["cardinality"], facts["total_result_rows"]) == ("many_to_many", 4)


def test_pages_are_ordered_and_say_what_they_leave_out(spark):
    e = Engine(spark)
    e.register("a", spark.createDataFrame([(3, "x"), (1, None), (2, "y"), (4, "x")], "at int, k string"), "at")
    e.register("b", spark.createDataFrame([(9, "x"), (8, "y"), (7, "x")], "at int, k string"), "at")
    page = e.join_tables("a", "b", ["k"], ["k"], "left", limit=4)
    assert [(r["left.at"], r["right.at"]) for r in page.rows.collect()] == [(2, 8), (3, 7), (3, 9), (4, 7)]
    assert page.total_result_rows == 6 and page.truncated and "both sides repeat" in page.warning
    assert [(r["left.at"], r["right.at"]) for r in e.join_tables("a", "b", ["k"], ["k"], "left").rows.collect()][-1] == (1, None)


def test_relationships_over_a_crosswalk(engine):
    d = {"left": "registry", "right": "sessions", "left_keys": ["cage", "tail"], "right_keys": ["animal"], "crosswalk": "cw", "left_key_format": "{cage}-{tail}", "expected_cardinality": "one_to_many"}
    e = Engine(engine.spark)
    e.register("registry", engine.table("registry").df)
    e.register("sessions", engine.table("sessions").df)
    e.register_crosswalk("cw", CROSSWALK)
    found = e.build_relationships([d, d | {"crosswalk": "none"}])[0]
    assert found["status"] == "declared" and found["cardinality"] == "one_to_many" and len(e.skipped) == 1
    assert e.join_relationship(found["id"]).total_result_rows == 4
    got = e.aggregate_join([{"op": "count", "name": "n"}], found["id"], group_by=["key.canonical_id"], reasons=False)
    assert {r["key.canonical_id"]: r["n"] for r in got.collect()} == {"Z-7_L": 2, "Z-7_R": 1, "Z-8_L": 1}
    e.register_crosswalk("cw", CROSSWALK + b"Z-9_L,Z9-L,\n")
    with pytest.raises(Refusal):
        e.join_relationship(found["id"])
    for bad in ({"left": "registry"}, d | {"status": "guess"}, d | {"expected_cardinality": "some"}):
        with pytest.raises(QueryValidationError):
            e.build_relationships([bad])
