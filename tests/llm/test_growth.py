"""Work and memory that must not grow with the square of a group, a list or a word."""

import re
import time

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from factloom.llm import common, decontamination, jaccard_join, maxent_lm, packing, quality_classifier, secret_scan, shingles, toxicity_grammar
from factloom.llm.queries import tokenizer_path


def test_a_shared_phrase_makes_no_pairs(spark):
    """Many texts and many items share one six-word phrase; no item is covered, and its seeds stay out of the join."""
    phrase = "all rights reserved by their owners"
    met = {}
    for n in (100, 200):
        docs = spark.createDataFrame([(i, " ".join(f"d{i}w{k}" for k in range(30)) + f" {phrase}") for i in range(n)], "doc_id long, text string")
        items = spark.createDataFrame([(i, f"{phrase} " + " ".join(f"i{i}w{k}" for k in range(30))) for i in range(n)], "item_id long, text string")
        made = decontamination.items_of(items)
        rows, mark = decontamination.marked(docs, made, every=False)
        seeds = rows.select(F.explode(f"{mark}.seeds").alias("seed"))
        met[n] = seeds.join(decontamination.rare_seeds(seeds, made, 0.6), "seed").count()
        assert decontamination.contaminated(docs, items).count() == 0
    assert met[200] <= 2 * max(met[100], 1)


def test_a_covered_item_is_found_among_common_phrases(spark):
    """The phrase is most of some items; those are still found wherever they are covered."""
    phrase = "all rights reserved by their owners and heirs"
    texts = [f"x{i} y{i} {phrase} z{i}" for i in range(40)] + [f"a b c d e f g h i j k l {phrase}", "a b c d e f g h i j k l"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    items = spark.createDataFrame([(1, phrase), (2, f"a b c d e f g h i j k l {phrase}"), (3, f"{phrase} q r s t u v w x y z 1 2 3 4 5")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.contaminated(docs, items).collect()}
    assert got == {(i, 1) for i in range(41)} | {(40, 2), (41, 2)}


def test_spans_take_time_in_proportion(spark):
    took = {}
    for n in (4000, 16000, 4000, 16000):
        text = " ".join(f"{i:032x}" for i in range(n))
        df = spark.createDataFrame([(text,)], "text string").select(F.size(secret_scan.found_in(F.col("text"))).alias("n"))
        began = time.time()
        assert df.first()["n"] == n
        took[n] = time.time() - began
    assert took[16000] < 9 * max(took[4000], 0.3), took


def test_many_spans_are_cut(spark):
    n = 3000
    text = " ".join(f"token={'a' * 8}{i}" for i in range(n)) + " end"
    docs = spark.createDataFrame([(1, text, "en", "s")], "doc_id long, text string, lang string, source string")
    assert secret_scan.redact(docs).first()["text"] == "<SECRET> " * n + "end"


def test_values_spread_over_repositories_are_copied(spark):
    value = "Zz9" + "qW3" * 8
    rows = [(i, f"own {value} here", f"l{i}", "s0") for i in range(secret_scan.MAX_REPOS)] + [(90, "own Ab1" + "xY9" * 9 + " here", "l0", "s0")]
    got = {r["doc_id"]: r for r in secret_scan.digest(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert got[0]["spans"] == "" and got[0]["n_copied"] == 1 and got[90]["n_live"] == 1
    few = spark.createDataFrame(rows[1:], "doc_id long, text string, lang string, source string")
    assert {r["n_live"] for r in secret_scan.digest(few).collect()} == {1}


def test_words_without_end_are_not_remembered():
    """A text without white space is one word; no cache keeps it."""
    words = [bytes([97 + i]) * 100_000 for i in range(9)]
    tables = (shingles.WordHash(), maxent_lm.Packed({}, {}), quality_classifier.WordSums(np.zeros(1 << 22, np.float32)))
    for table in tables:
        assert len({table[w] for w in words[:2] + [b"short"]}) >= 1
        assert set(table) <= {b"short"}
    symbols = toxicity_grammar.Symbols({})
    assert symbols["x" * 100_000 + "."] == symbols["y."] and set(symbols) == {"y."}
    ids = packing.WordIds(tokenizer_path())
    texts = [w.decode() + " short" for w in words]
    assert [len(x) > 2 for x in ids.encode(texts)] == [True] * len(texts)
    assert max(map(len, ids.known)) <= packing.CACHED_BYTES


def kept_by_arrow(spark):
    """The most MB that a worker's Arrow allocator holds without using them."""

    def held(batches):
        size = lambda: sum(map(int, re.findall(r"Pss_Anon:\s+(\d+)", open("/proc/self/smaps_rollup").read())))
        for _ in batches:
            pass
        before = size()
        pa.default_memory_pool().release_unused()
        yield pa.RecordBatch.from_arrays([pa.array([(before - size()) // 1024])], names=["mb"])

    return spark.range(16, numPartitions=16).mapInArrow(held, "mb long").agg(F.max("mb")).first()[0]


def test_workers_keep_no_memory_of_a_stage(spark):
    """A worker serves the stages after its own; what its texts took in Arrow is given back when its task ends."""
    kept_by_arrow(spark)  # what earlier tests left
    words = F.transform(F.sequence(F.lit(0), F.lit(299)), lambda k: F.concat(F.lit("w"), F.conv(F.abs(F.xxhash64("id", k)).cast("string"), 10, 36)))
    docs = spark.range(16_000, numPartitions=4).select(F.col("id").alias("doc_id"), F.array_join(words, " ").alias("text"))
    docs = common.materialise(docs, "texts")
    packing.tokens(docs, tokenizer_path())
    assert kept_by_arrow(spark) < 32
    rows, edges, _ = jaccard_join.survey(docs, 5, jaccard_join.Similarity(80, 100))
    assert rows.count() == 16_000
    assert kept_by_arrow(spark) < 32


def test_slices_hold_the_same_rows():
    table = pa.table({"a": list(range(600)), "b": [None, "x", ""] * 200})
    cut = list(common.slices(iter(table.to_batches())))
    assert max(b.num_rows for b in cut) <= common.ROWS_A_TIME and pa.Table.from_batches(cut).equals(table)
    assert [b.num_rows for b in common.lean(lambda batches: batches)(iter(cut))] == [b.num_rows for b in cut]
