"""The pipeline's stages keep what they must and drop what they must."""

import pathlib

import pytest

import corpus_pipeline
from factloom.llm import decontamination, toxicity_grammar
from factloom.llm.common import table

DATA = pathlib.Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def kept(spark):
    if not DATA.exists():
        pytest.skip("no tables")
    docs, out = table(spark, str(DATA), "documents"), []
    for _, stage in corpus_pipeline.STAGES:
        done = stage(spark, docs, str(DATA)).cache()
        out.append((docs, done))
        docs = done
    return out


def test_stages(spark, kept):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "leaks", "secrets", "packing"]
    for before, after in kept[:-1]:
        assert after.columns == before.columns
    for before, after in kept[:3]:
        assert after.subtract(before).count() == 0 and 0 < after.count() <= before.count()
    before, after = kept[0]
    rejected = toxicity_grammar.score(before, table(spark, str(DATA), "labels")).where("predicted = 1").count()
    assert before.count() - after.count() == rejected
    before, after = kept[2]
    leaky = decontamination.contaminated(before, table(spark, str(DATA), "benchmark")).select("doc_id").distinct()
    assert {r[0] for r in before.select("doc_id").collect()} - {r[0] for r in after.select("doc_id").collect()} == {r[0] for r in leaky.collect()}
    before, after = kept[3]
    assert before.count() == after.count()
    texts, packed = kept[4]
    assert packed.select("doc_id").distinct().count() == texts.count()


def test_stages_take_nulls_repeats_long_texts_and_clashing_names(spark):
    """Columns named like those that the stages make; nulls in every column; repeated, empty and very long rows."""
    if not DATA.exists():
        pytest.skip("no tables")
    names = ["score", "predicted", "held_out", "node", "made", "made_", "row", "key", "words", "item", "label", "cuts", "__node", "__text", "__key"]
    texts = [None, "", "a b c", "plain words " * 20_000, "x " + "Ab1" + "xY9" * 9 + " token=abcdefgh12", "twice the same text here now", "twice the same text here now"]
    rows = [(None if i % 3 == 2 else 900_000 + i, t, None, None, None, *[str(i)] * len(names)) for i, t in enumerate(texts)] + [(None,) * (5 + len(names))]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in names)
    docs = spark.createDataFrame(rows, schema)
    for name, stage in corpus_pipeline.STAGES:
        empty = stage(spark, docs.where("false"), str(DATA))
        assert empty.count() == 0, name
        got = stage(spark, docs, str(DATA))
        if name == "packing":
            assert got.where("length <= 0").count() == 0
            continue
        assert got.columns == docs.columns, name
        kept = sorted(map(str, (tuple(r) for r in got.collect())))
        if name == "near_duplicates":
            assert len(kept) == len(rows) - 1
        elif name != "secrets":
            assert kept == sorted(map(str, rows)), name
        else:
            assert len(kept) == len(rows) and sum("<SECRET>" in k for k in kept) == 1
