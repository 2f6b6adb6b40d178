"""Search by an index of tokens gives the scan's terms, scores and ties for every query."""

import random

import pytest

from factloom.errors import QueryValidationError
from factloom.operators import ontology

WORDS = ["steel", "brass", "large", "small", "anodised", "promo", "x1", "bolt", "nutHouse", "µ", "the"]


@pytest.fixture(scope="module")
def tables(spark):
    r = random.Random(9)
    some = lambda n: " ".join(r.choices(WORDS, weights=[1, 2, 9, 9, 1, 3, 1, 2, 1, 1, 30], k=n))
    terms = [(f"t{i:03}", some(r.randint(1, 4)).title() if i % 3 else some(2), [some(2) for _ in range(r.randint(0, 2))] if i % 5 else None, some(3) if i % 4 else None) for i in range(150)] + [("t900", "µ", None, None), ("t901", None, ["The  Bolt"], "steel")]
    queries = [some(r.randint(1, 5)) for _ in range(60)] + ["", "µ", " The  bolt ", "nothing here", "nutHouse", "LARGE the", "??"]
    schema = "iri string, label string, synonyms array<string>, definition string"
    return spark.createDataFrame(terms, schema), queries, spark.createDataFrame(list(enumerate(queries)), "qid long, query string")


@pytest.mark.parametrize("k", [1, 4])
def test_equals_the_scan(tables, k):
    terms, queries, asked = tables
    got = {}
    for r in ontology.search_many(terms, asked, k).orderBy("qid", "rank").collect():
        got.setdefault(r["qid"], []).append((r["iri"], r["score"], r["match"]))
    for i, text in list(enumerate(queries))[:: 1 if k == 4 else 7]:
        assert got.get(i, []) == [tuple(r) for r in ontology.search(terms, text, k).collect()], text


def test_scope(tables):
    terms, queries, asked = tables
    inside = terms.where("iri < 't075'")
    got = {(r["qid"], r["iri"]) for r in ontology.search_many(terms, asked, 5, inside).collect()}
    assert got == {(r["qid"], r["iri"]) for r in ontology.search_many(inside, asked, 5).collect()} and all(i < "t075" for _, i in got)
    outside = {r["qid"]: r["out_of_scope_matches"] for r in ontology.out_of_scope(terms, asked, inside).collect()}
    others = terms.where("iri >= 't075'")
    for i in (0, 7, 60, 61, 62, 63, 65):
        assert outside[i] == ontology.search(others, queries[i], 50).count() or outside[i] > 50
    with pytest.raises(QueryValidationError):
        ontology.search_many(terms, asked, 0)


def stored(monkeypatch):
    """Rows of every table that an operator stores, by its name."""
    sizes, real = {}, ontology.written

    def written(df, name):
        out = real(df, name)
        sizes[name] = max(sizes.get(name, 0), out.count())
        return out

    monkeypatch.setattr(ontology, "written", written)
    return sizes


def copies(spark):
    terms = spark.range(300).selectExpr("concat('t', lpad(id, 3, '0')) as iri", "if(id % 2 = 0, 'steel bolt', 'brass') as label", "cast(null as array<string>) as synonyms", "'the part' as definition")
    return terms, spark.range(200).selectExpr("id as qid", "if(id % 4 = 0, 'the bolt', 'Brass') as query")


def test_copies_outside_the_scope_are_counted_without_pairs(spark, monkeypatch):
    terms, asked = copies(spark)
    sizes = stored(monkeypatch)
    got = {(r["qid"] % 4 == 0, r["out_of_scope_matches"]) for r in ontology.out_of_scope(terms, asked, terms.where("iri < 't100'")).collect()}
    assert got == {(True, 200), (False, 100)} and sizes["classes"] == 2 and sizes["begun"] == 2


def test_copies_are_searched_once(spark, monkeypatch):
    terms, asked = copies(spark)
    sizes = stored(monkeypatch)
    got = [tuple(r) for r in ontology.search_many(terms, asked, 3).where("qid in (4, 5)").orderBy("qid", "rank").select("qid", "iri", "match").collect()]
    assert got == [(4, f"t00{i}", "token_overlap") for i in (0, 2, 4)] + [(5, f"t00{i}", "exact_label") for i in (1, 3, 5)]
    assert sizes["terms"] == 2 and sizes["asks"] == 2 and sizes["candidates"] <= 4
