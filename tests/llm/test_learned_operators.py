"""Classifier, grammar, language model, joins and search: held-out accuracy, brute force, edge cases."""

import collections
import math
import pathlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from factloom.llm import components, graph_search, jaccard_join, labelled, maxent_lm, quality_classifier, shingles, toxicity_grammar
from factloom.llm.common import table

DATA = pathlib.Path("/root/testdata/sf0.01")
ODD = [(None, "null id"), (900_001, None), (900_002, ""), (900_003, "w " * 30_000), (900_004, "twice"), (900_004, "twice")]


@pytest.fixture(scope="module")
def corpus(spark):
    if not DATA.exists():
        pytest.skip("no tables")
    docs = table(spark, str(DATA), "documents").select("doc_id", "text")
    return docs.unionByName(spark.createDataFrame(ODD, docs.schema)), table(spark, str(DATA), "labels")


def held_out(spark, scored, labels, label):
    rows = scored.join(labels, "doc_id").where("held_out").select("score", "predicted", label).collect()
    return np.mean([r["predicted"] == r[label] for r in rows])


def test_quality_held_out(spark, corpus):
    docs, labels = corpus
    got = quality_classifier.score(docs, labels).cache()
    assert got.count() == docs.count() and got.where("score < 0 or score > 1 or predicted is null").count() == 0
    assert got.where("doc_id is not null").where("held_out != (crc32(cast(doc_id as string)) % 4 = 2)").count() == 0
    assert held_out(spark, got, labels, "quality") >= 0.95


def test_toxicity_held_out(spark, corpus):
    docs, labels = corpus
    got = toxicity_grammar.score(docs, labels)
    assert got.count() == docs.count()
    assert held_out(spark, got, labels, "toxic") >= 0.9


def test_models_without_labels(spark, corpus):
    docs, labels = corpus
    few = docs.limit(5)
    assert {r["score"] for r in quality_classifier.score(few, labels.where("false")).collect()} == {0.5}
    assert {r["score"] for r in toxicity_grammar.score(few, labels.where("false")).collect()} == {0.5}
    assert quality_classifier.score(docs.where("false"), labels).count() == 0
    assert toxicity_grammar.score(docs.where("false"), labels).count() == 0 and toxicity_grammar.accepted(docs.where("false"), labels).count() == 0
    more = few.selectExpr("*", "'x' as score", "1 as label", "2 as held_out")
    assert toxicity_grammar.score(more, labels).count() == quality_classifier.score(more, labels).count() == 5 == toxicity_grammar.accepted(more, labels.where("false")).count()


def test_grammar_scores_clauses():
    symbols = toxicity_grammar.Symbols({"idiot": 4})
    state = lambda text: [toxicity_grammar.STATES[s] for s in toxicity_grammar.clauses(symbols, text)]
    assert state("you are an idiot.") == [(4, 2, 2, 1, 0)]
    assert state("you are not an idiot.") == [(4, 1, 2, 1, 0)]
    assert state("they said idiot, hello") == [(4, 2, 1, 0, 0)] or state("they said idiot, hello") == [(4, 2, 1, 1, 0)]
    assert state("nothing here. you.") == []
    assert [s[4] for s in state("I will kill you")] == [1]
    assert len(state("idiot, idiot")) == 1 and sum(toxicity_grammar.clauses(symbols, "idiot, idiot").values()) == 2


def test_language_model_counts(spark, corpus):
    docs, _ = corpus
    got = maxent_lm.score(docs, top=500).collect()
    assert len(got) == docs.count()
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    rows = [(r["doc_id"], (r["text"] or "").encode().lower().split() + [b""]) for r in docs.collect()]
    counts = collections.Counter(w for i, words in rows if not held(i) for w in words)
    n, v = sum(counts.values()), len(counts)
    want = collections.defaultdict(list)
    for i, words in rows:
        want[i].append((len(words), sum(counts[w] > 0 for w in words), round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in words), 4)))
    for r in got:
        assert r["held_out"] == held(r["doc_id"]) and r["train_tokens"] == n
        assert (r["n_tokens"], r["n_known"], round(r["base_score"], 4)) in want[r["doc_id"]]
    test = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in test) > sum(r["base_score"] for r in test)


@pytest.mark.parametrize("top", [10, 20])
def test_language_model_counts_an_infrequent_end_token(spark, top):
    """20 words of one count step: with ``top`` 10 not even that step fits, with 20 the end token's step does not."""
    texts = {i: " ".join(f"w{k}" for k in range(20) for _ in range(5)) for i in range(12)} | {50: "w1 unseen", 51: None}
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    words = {i: (t or "").encode().split() + [b""] for i, t in texts.items()}
    counts = collections.Counter(w for i, ws in words.items() if not held(i) for w in ws)
    n, v = sum(counts.values()), len(counts)
    got = maxent_lm.score(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), top=top).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(texts)
    for r in got:
        ws = words[r["doc_id"]]
        assert r["n_known"] == sum(counts[w] > 0 for w in ws)
        assert round(r["base_score"], 6) == round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws), 6)


def test_language_model_is_a_distribution():
    rng = np.random.default_rng(1)
    weights = tuple(rng.normal(0, 1, shape).astype(np.float32) for shape in maxent_lm.SHAPES)
    lexicon = maxent_lm.Lexicon([(b"a", 3), (b"b", 2)], [b"a"])
    total = 0.0
    for c in range(maxent_lm.CLASSES * maxent_lm.WIDTH):
        t = maxent_lm.Tokens(*lexicon.packed([[b"b", b"zz", b"a"]]))
        t.place[:] = c
        total += np.exp(maxent_lm.log_probability(weights, t))
    assert np.allclose(total, 1, atol=1e-5)


def test_language_model_equals_brute_force(spark):
    """The model part by plain loops from the same weights: two softmaxes, then the share of a shared place."""
    rng = np.random.default_rng(2)
    weights = tuple(rng.normal(0, 1, shape).astype(np.float32) for shape in maxent_lm.SHAPES)
    lexicon = maxent_lm.Lexicon([(b"a", 3), (b"b", 2)], [b"a"])
    docs = [[b"b", b"zz", b"a", b"a"], [], [b"a"]]
    t = maxent_lm.Tokens(*lexicon.packed(docs))
    got = maxent_lm.log_probability(weights, t)
    assert t.size.tolist() == [5, 1, 2] and len(got) == 8
    for depth in (0, 1):
        rows, told = t.level(depth, 0)
        for i in range(8):
            x = sum(weights[depth][r[i]].astype(float) for r in rows)
            got[i] -= x[told[i]] - np.log(np.exp(x).sum())
    assert np.allclose(got, 0, atol=1e-5)
    # Features see the two words before, and nothing across a document's start.
    first, _ = t.level(0, 0)
    assert (first[:, 0] == first[:, 5]).all() and (first[:, 5] == first[:, 6]).all() and not (first[:, 3] == first[:, 4]).all()


def test_language_model_learns_context(spark):
    """Words that follow each other for sure are told far better than by their frequency."""
    texts = [(i, " ".join(["left right up down"] * 20)) for i in range(200)]
    got = maxent_lm.score(spark.createDataFrame(texts, "doc_id long, text string").selectExpr("*", "1 as word", "2 as n", "'x' as row")).where("held_out").collect()
    assert got and all(r["score"] > r["base_score"] / 2 for r in got)


def test_language_model_looks_equal_words_up_once(monkeypatch):
    """A batch's words are split in Arrow, as ``words_of`` splits them, and only different ones are looked up; none is remembered."""
    texts = ["", " ", "one", " one\tTwo\x0b\x0cone\r\n", "\u00c9t\u00e9 a\x1cb\u00a0c \u2003 d\x85e\x00", "x" * 70 + " One", *["one two"] * 500, ""]
    want = [shingles.words_of(t) for t in texts]
    array = pa.array(["sliced off", *texts])[1:]
    words, size = maxent_lm.split(array)
    assert words.to_pylist() == [w for ws in want for w in ws] and size.tolist() == [len(ws) for ws in want]
    lexicon = maxent_lm.Lexicon([(b"one", 9), (b"two", 8), (b"", 7)], [b"one"])
    asked = []
    monkeypatch.setattr(maxent_lm.Packed, "of", lambda self, ws, of=maxent_lm.Packed.of: asked.extend(ws) or of(self, ws))
    flat, size = lexicon.encoded(words, size)
    assert sorted(asked) == sorted({w for ws in want for w in ws}) and set(lexicon.known) == {b"one", b"two", b""}
    rank, place = {b"one": 0, b"two": 1, b"": 2}, {b"one": 1, b"": 0}
    number = lambda w: zlib.crc32(w) << 28 | place.get(w, maxent_lm.suffix_place(w)) << 20 | rank.get(w, maxent_lm.RARE)
    assert flat.tolist() == [number(w) for ws in want for w in [*ws, b""]] and size.tolist() == [len(ws) + 1 for ws in want]


def test_language_model_adds_a_long_segment_in_a_few_steps(monkeypatch):
    """Rows of equal features are added all at once: a frequent feature takes no step of its own."""
    rng = np.random.default_rng(3)
    lens = np.concatenate([[1, 5000, 15, 16, 17], rng.integers(1, 400, 300), [256, 257, 1]])
    p, first = rng.normal(0, 1, (700, 16)), np.cumsum(lens) - lens
    order = rng.integers(0, len(p), lens.sum())
    taken = []
    monkeypatch.setattr(np, "take", lambda *a, take=np.take, **b: taken.append(1) or take(*a, **b))
    got = maxent_lm.bucket_sums(p, order, first)
    assert 0 < len(taken) < 100
    assert np.allclose(got, [p[order[a : a + n]].sum(0) for a, n in zip(first, lens, strict=True)])


def test_language_model_counts_in_parts(spark, corpus, monkeypatch):
    docs = corpus[0].select("text").where("text is not null").repartition(3)
    want = collections.Counter(w for r in docs.collect() for w in [*shingles.words_of(r["text"]), b""])
    for held in (1, 1_000_000):
        monkeypatch.setattr(maxent_lm, "HELD_COUNTS", held)
        assert {bytes(r["word"]): r["n"] for r in maxent_lm.counted(docs).collect()} == want


def test_language_model_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert maxent_lm.score(empty).count() == 0
    only = [i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2][:2]
    got = maxent_lm.score(spark.createDataFrame([(i, "some words") for i in only], "doc_id long, text string")).collect()
    assert {(r["train_tokens"], r["n_known"], round(r["base_score"], 6)) for r in got} == {(0, 0, 0.0)}


def near_copies():
    rng = random.Random(3)
    vocab, texts = [f"w{i}" for i in range(3000)], []
    for _ in range(40):
        base = [rng.choice(vocab) for _ in range(rng.choice([1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60, 150, 400]))]
        for _ in range(rng.choice([1, 2, 5, 12])):
            t = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3]) * max(1, len(base) // 100)):
                k, how = rng.randrange(len(t)), rng.random()
                if how < 0.5:
                    t[k] = rng.choice(vocab)
                elif how < 0.75:
                    t.insert(k, rng.choice(vocab))
                elif len(t) > 1:
                    del t[k]
            texts.append(" ".join(t))
    base = [rng.choice(vocab) for _ in range(120)]
    for _ in range(200):
        t = list(base)
        for _ in range(rng.choice([0, 1, 2, 3, 4, 5])):
            t[rng.randrange(120)] = rng.choice(vocab)
        texts.append(" ".join(t))
    return [*texts, "", "", None, "A b", "a B", "a  b\n"]


@pytest.mark.parametrize(("n", "num", "den"), [(4, 85, 100), (5, 80, 100)])
def test_jaccard_join_equals_brute_force(spark, monkeypatch, n, num, den):
    monkeypatch.setattr(jaccard_join, "LEAF", 24)
    monkeypatch.setattr(jaccard_join, "AREA_DOCS", 8)
    monkeypatch.setattr(jaccard_join, "GROUP_DOCS", 64)
    texts = near_copies()
    ids = random.Random(1).sample(range(10_000), len(texts))
    df = spark.createDataFrame([(i, t, 0, 1) for i, t in zip(ids, texts, strict=True)], "doc_id long, text string, node int, area int").repartition(4)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["n_links"]) for r in jaccard_join.components(df, n, num, den).collect()}
    sets = {}
    for i, t in zip(ids, texts, strict=True):
        w = (t or "").lower().split()
        sets[i] = {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()
    up, links = {i: i for i in ids}, dict.fromkeys(ids, 0)

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            i = len(sets[a] & sets[b])
            if sets[a] and sets[b] and den * i >= num * (len(sets[a]) + len(sets[b]) - i):
                links[a], links[b] = links[a] + 1, links[b] + 1
                p, q = root(a), root(b)
                up[max(p, q)] = min(p, q)
    assert got == {i: (len(sets[i]), root(i), links[i]) for i in ids}
    kept = jaccard_join.deduplicate(df, n, num, den)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == {i for i in ids if root(i) == i}


def test_voronoi_regions_lose_no_link():
    rng = np.random.default_rng(2)
    base = [rng.choice(1 << 40, 60).astype(np.uint64) for _ in range(12)]
    sets = []
    for b in base:
        for _ in range(12):
            s = b.copy()
            s[rng.integers(0, 60, rng.integers(0, 9))] = rng.choice(1 << 40, 1)
            sets.append(np.unique(s))
    sim, copies = jaccard_join.Similarity(85, 100), np.ones(len(sets), np.int64)
    whole, cut, sure = jaccard_join.Forest(copies), jaccard_join.Forest(copies), jaccard_join.Forest(copies, None, jaccard_join.centre_gaps(sets))
    jaccard_join.compare(sets, np.arange(len(sets)), None, sim, sure)
    jaccard_join.compare(sets, np.arange(len(sets)), None, sim, whole)
    old = jaccard_join.LEAF
    jaccard_join.LEAF = 16
    try:
        jaccard_join.join_area(sets, np.arange(len(sets)), sim, cut)
    finally:
        jaccard_join.LEAF = old
    assert (whole.links == cut.links).all() and whole.links.sum() > 0 and (whole.links == sure.links).all()
    assert [whole.root(k) for k in range(len(sets))] == [cut.root(k) for k in range(len(sets))] == [sure.root(k) for k in range(len(sets))]


def test_close_groups_are_linked_by_their_centre():
    """Near copies of one set: gaps to the centre decide most pairs, and the rest agrees with comparing all."""
    rng = np.random.default_rng(9)
    base, sets = rng.choice(1 << 60, 300).astype(np.uint64), []
    for _ in range(500):
        s = base.copy()
        k = rng.integers(0, 40)
        s[rng.integers(0, 300, k)] = rng.choice(1 << 60, k)
        sets.append(np.unique(s))
    sim, copies, every = jaccard_join.Similarity(80, 100), rng.integers(1, 4, 500), np.arange(500)
    whole, sure = jaccard_join.Forest(copies), jaccard_join.Forest(copies, None, jaccard_join.centre_gaps(sets))
    jaccard_join.compare(sets, every, None, sim, whole)
    jaccard_join.compare(sets, every, None, sim, sure)
    assert (whole.links == sure.links).all() and [whole.root(k) for k in range(500)] == [sure.root(k) for k in range(500)]
    assert (np.add.outer(sure.gap, sure.gap) <= 0.2).mean() > 0.3


@pytest.mark.parametrize("all_listed", [False, True])
def test_every_component_keeps_one_document(spark, monkeypatch, all_listed):
    """Components of null ids only, one id on several texts, and unlinked rows that the filter's false positives send to be judged."""
    a, c, x, y, alone, other = (" ".join(f"{k}{i}" for i in range(60)) for k in "acxyzu")
    rows = [(5, a), (7, a + " end"), (5, c), (9, c + " end"), (None, x), (None, x), (None, y), (None, y + " end"), (None, alone), (5, other), (None, c), (None, "")]
    if all_listed:
        monkeypatch.setattr(jaccard_join, "node_filter", lambda placed: np.full(jaccard_join.FILTER_BITS >> 6, (1 << 64) - 1, np.uint64))
    kept = sorted(map(str, map(tuple, jaccard_join.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect())))
    want = [[(5, a), (5, c), (None, x), least, (None, alone), (5, other), (None, "")] for least in ((None, y), (None, y + " end"))]
    assert kept in [sorted(map(str, w)) for w in want]


def test_jaccard_of_nothing(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard_join.components(df).count() == 0 and jaccard_join.deduplicate(df).count() == 0


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7)], "a long, b long")
    got = {r["node"]: r["label"] for r in components.connected(edges).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}


def test_graph_search_recall_and_ties(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(0, 1, (20, 16))
    vectors = [(int(i), (centres[i % 20] + rng.normal(0, 0.3, 16)).tolist()) for i in range(1500)]
    same = [0.5] * 16
    vectors += [(5000 + i, same) for i in range(200)] + [(9000, None), (9100, [0.0] * 16), (9200, [float("nan")] * 16), (9300, [1.0] * 4), (9400, []), (9500, [1.0, None] * 8), (0, vectors[0][1])]
    df = spark.createDataFrame([(i, v, 1) for i, v in vectors], "vec_id long, embedding array<double>, rank int").repartition(4)
    got = collections.defaultdict(list)
    for r in graph_search.search(df, shard=400).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
        assert r["rank"] == len(got[r["query_id"]])
    base = {i: np.array(v) for i, v in vectors if v and len(v) == 16 and None not in v and np.isfinite(v).all() and np.any(v)}
    hit = total = 0
    for q in (i for i in base if i % 100 == 0):
        want = sorted((float(np.sqrt(((base[q] - v) ** 2).sum())), i) for i, v in base.items() if i != q)[:10]
        hit += len({i for _, i in want} & {i for i, _ in got[q]})
        total += 10
        for i, s in got[q]:
            assert math.isclose(s, float(np.sqrt(((base[q] - base[i]) ** 2).sum())), abs_tol=1e-12)
    assert hit / total >= 0.9
    assert [i for i, _ in got[5000]] == list(range(5001, 5011)) and [i for i, _ in got[5100]] == list(range(5000, 5010))
    assert not {9000, 9100, 9200, 9400, 9500} & set(got) and 9300 not in got
    assert graph_search.search(df.where("false")).count() == 0 and graph_search.search(df.where("vec_id = 100")).count() == 0


@pytest.mark.parametrize("sizes", [(1e20,), (1e-20,), (1e20, 1e-20), (1e20, 1.0, 1e-20)])
def test_graph_search_at_any_magnitude(spark, sizes):
    rng = np.random.default_rng(6)
    vectors = {i: rng.normal(0, 1, 8) * sizes[i % len(sizes)] for i in range(600)}
    df = spark.createDataFrame([(i, v.tolist()) for i, v in vectors.items()], "vec_id long, embedding array<double>")
    got = collections.defaultdict(list)
    for r in graph_search.search(df, shard=200).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    hit = 0
    for q in range(0, 600, 100):
        want = sorted((float(np.sqrt(((vectors[q] - v) ** 2).sum())), i) for i, v in vectors.items() if i != q)[:10]
        assert len(got[q]) == 10
        far = want[-1][0]
        hit += sum(s <= far for _, s in got[q])
    assert hit / 60 >= 0.9
    assert graph_search.search(df.where("vec_id < 8")).count() == 7


def test_graph_search_recall_on_embeddings(spark):
    if not DATA.exists():
        pytest.skip("no tables")
    df = table(spark, str(DATA), "embeddings")
    base = {r["vec_id"]: np.array(r["embedding"], float) for r in df.collect()}
    got = collections.defaultdict(set)
    for r in graph_search.search(df, shard=1000).collect():
        got[r["query_id"]].add(r["vec_id"])
    ids, matrix = np.array(list(base)), np.array(list(base.values()))
    hits = []
    for q in ids[ids % 100 == 0].tolist():
        gap = np.sqrt(((matrix - base[q]) ** 2).sum(1))
        gap[ids == q] = np.inf
        hits.append(len(set(ids[np.lexsort((ids, gap))[:10]].tolist()) & got[q]) / 10)
    assert np.mean(hits) >= 0.9


def test_repeated_labelled_ids_do_not_pass_the_bound(spark):
    docs = spark.createDataFrame([(1, f"text {i}") for i in range(500)] + [(i, "other") for i in range(2, 60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(60)] + [(1, 0)] * 3, "doc_id long, quality int")
    got = labelled.sample(docs, labels, "quality", 10).collect()
    assert len(got) == 10
    everything = {r["doc_id"]: r for r in labelled.sample(docs, labels, "quality", 1000).collect()}
    assert everything[1]["text"] == "text 0" and everything[1]["label"] == 0 and all(zlib.crc32(str(i).encode()) % 4 != 2 for i in everything)


def test_sets_that_share_half_a_digest_stay_apart(spark, monkeypatch):
    """All low halves are made equal: nodes then come from the other half, and nothing is merged."""
    real = jaccard_join.xxhash.xxh3_128_intdigest
    docs = spark.createDataFrame([(i, " ".join(f"{k}{j}" for j in range(30))) for i, k in enumerate("abcabd")], "doc_id long, text string")
    want = {(r["doc_id"], r["component_id"], r["n_links"]) for r in jaccard_join.components(docs).collect()}
    assert {c for _, c, _ in want} == {0, 1, 2, 5}
    table = np.arange(3, dtype=np.uint64)
    low = jaccard_join.node_of(table)
    assert jaccard_join.node_of(table, frozenset([low])) == real(table.tobytes()) >> 65 != low
    rows, shared = jaccard_join.sets(docs, 4)
    assert not shared and rows.columns == ["doc_id", "n_shingles", "node"]
    nodes = {r["doc_id"]: r["node"] for r in rows.collect()}
    again, _ = jaccard_join.sets(docs, 4, frozenset([nodes[0]]))
    moved = {r["doc_id"]: r["node"] for r in again.collect()}
    assert moved[0] == moved[3] != nodes[0] and all(moved[i] == nodes[i] for i in (1, 2, 4, 5))


def test_quality_score_equals_brute_force():
    """The collapsed table gives what the mean of all vectors gives: every word's and gram's number, and one for each repeated word."""
    table = np.random.default_rng(3).normal(0, 1, quality_classifier.BUCKETS).astype(np.float32)
    for text in ("the the cat sat", "é", "one", "", None, "a a a a", "word " * 500):
        words = (text or "").encode().split()
        numbers = [float(table[b]) for w in words for b in quality_classifier.buckets(w)]
        numbers += [float(table[quality_classifier.buckets(quality_classifier.AGAIN)[0]]) for a, b in zip(words, words[1:], strict=False) if a == b]
        want = 1 / (1 + math.exp(-(np.mean(numbers) if numbers else 0.0) - 0.25))
        assert math.isclose(quality_classifier.score_text(quality_classifier.WordSums(table), 0.25, text), want, abs_tol=1e-6)


def test_grammar_equals_its_machines():
    """The composed table walks as the machines do side by side; clauses and scores follow from plain loops."""
    machines, rng = toxicity_grammar.components(), random.Random(5)
    vocabulary = {"idiot": 4, "silly": 2, "fool*": 3}
    symbols = toxicity_grammar.Symbols(vocabulary)
    words = ["idiot", "silly", "foolish", "you", "not", "said", "kill", "plain", "well,", "idiot.", "you!"]
    weights = [rng.uniform(-1, 1) for _ in range(13)]
    for _ in range(300):
        text = "\n".join(" ".join(rng.choice(words) for _ in range(rng.randrange(0, 9))) for _ in range(rng.randrange(1, 4)))
        want = collections.Counter()
        for line in text.split("\n"):
            state = [0] * len(machines)
            for w in [*line.split(), "."]:
                symbol = 0 if w == "." else symbols[w]
                state = [m.step(x, symbol & 15) for m, x in zip(machines, state, strict=True)]
                if w == "." or symbol & toxicity_grammar.CLOSE:
                    want[tuple(state)] += 1
                    state = [0] * len(machines)
        want = {s: n for s, n in want.items() if s[0] or s[4]}
        found = toxicity_grammar.clauses(symbols, text)
        assert {toxicity_grammar.STATES[s]: n for s, n in found.items()} == want
        values = toxicity_grammar.features(found)
        logit = sum(a * b for a, b in zip(values, weights, strict=False))
        assert math.isclose(toxicity_grammar.score_text(symbols, weights[: len(values)], text or " "), 1 / (1 + math.exp(-logit)), abs_tol=1e-9)
