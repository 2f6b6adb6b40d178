"""Line dedup, periodic runs, divergence of sources: brute force and edge cases."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from factloom.llm import divergence_audit, line_dedup, periodic_runs

LINE = "A line that many documents of this corpus share, %d times over"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, back int, term string, digest string, kind string, p int"
CLASH = (1, 2, "clash", None, None, 3)


def documents():
    many = "\n".join(LINE % i for i in range(3))
    texts = [None, "", "\n", "short\nshort\nshort", many, many.upper() + "\nown line of a document that nobody else in here has", " \t" + LINE % 1 + " \r\n" + LINE % 1, LINE % 1 + "\n" + "é" * 39 + "\n" + "é" * 40,
             "é" * 40 + "\n" + LINE % 2, "é" * 40, "É" * 40, "é" * 40 + "\n" + LINE % 0, "é" * 40 + " ", "x " * 30_000 + "\n" + LINE % 1, LINE % 1, LINE % 1]
    rows = [(i, t) for i, t in enumerate(texts)] + [(14, LINE % 1), (14, LINE % 1 + "\n" + LINE % 0), (None, LINE % 1), (None, None), (13, "é" * 40 + "\n" + LINE % 2 + "\n" + LINE % 0)]
    return [(i, t, "en", "s", *CLASH) for i, t in rows]


def lines_by_hand(rows, min_chars=40, min_docs=5):
    key = lambda line: "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))
    holds = defaultdict(set)
    for i, text, *_ in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= min_chars:
                holds[key(line)].add(-(1 << 63) if i is None else i)
    out = []
    for i, text, *_ in rows:
        lines = (text or "").split("\n")
        own = -(1 << 63) if i is None else i
        stay = [x for x in lines if len(holds.get(key(x), ())) < min_docs or own == max(holds[key(x)])]
        out.append((i, len(lines), len(lines) - len(stay), hashlib.sha256("\n".join(stay).encode()).hexdigest(), "\n".join(stay)))
    return out


def test_lines_equal_brute_force(spark):
    rows = documents()
    docs = spark.createDataFrame(rows, SCHEMA)
    want = lines_by_hand(rows)
    assert sum(w[2] for w in want) > 10
    got = line_dedup.digest(docs)
    assert got.columns == ["doc_id", "n_lines", "n_dropped", "kept_sha256"]
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(str(w[:4]) for w in want)
    assert sorted(map(str, (tuple(r) for r in line_dedup.kept(docs).collect()))) == sorted(str((w[0], w[4])) for w in want)
    maps = line_dedup.bitmaps(docs)
    for m in maps.collect():
        bits = np.unpackbits(np.frombuffer(zlib.decompress(m["keep"]), np.uint8), count=m["n_lines"])
        assert m["n_dropped"] == (bits == 0).sum() > 0
    assert line_dedup.digest(docs.where("false")).count() == 0


def test_one_line_cut_into_many_ranges(spark):
    """A line of two thirds of all rows lies in many partitions, with ids repeated at their edges."""
    rows = [(i // 3, f"{LINE % 7}\nown line number {i} of this corpus, long enough to be looked at" if i % 3 else f"pairs of lines {i // 200} that a few documents of the corpus share") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(16)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = line_dedup.digest(docs).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(str(w[:4]) for w in lines_by_hand(rows))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 4), st.integers(0, 9), st.integers(0, 3)), max_size=60), st.lists(st.integers(1, 9), min_size=1), st.integers(2, 4))
def test_stream_decides_like_groups(records, cuts, min_docs):
    """Sorted records in batches and partitions of any size; open rows follow what the first documents of their runs say."""
    rows = sorted({(h, 0, back, 7, 9, pos) for h, back, pos in records})
    batches, at = [], 0
    for k in range(len(rows)):
        if at >= len(rows):
            break
        size = cuts[k % len(cuts)]
        batches.append(rows[at : at + size])
        at += size
    partitions = [batches[k : k + 3] for k in range(0, len(batches), 3)]
    told = []
    for part in partitions:
        made = (pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*b, strict=True), line_dedup.KINDS, strict=True)], names=list(line_dedup.NAMES)) for b in part)
        for out in line_dedup.stream(min_docs)(made):
            told += zip(*(c.to_pylist() for c in out.columns), strict=True)
    seen = defaultdict(set)
    for kind, h, _, back, *_ in told:
        if kind == line_dedup.SEEN:
            seen[h].add(back)
    got = {r[1:] for r in told if r[0] == line_dedup.DROPPED}
    got |= {r[1:] for r in told if r[0] == line_dedup.OPEN and len(seen[r[1]]) >= min_docs and r[3] != min(seen[r[1]])}
    backs = defaultdict(set)
    for r in rows:
        backs[r[0]].add(r[2])
    assert got == {r for r in rows if len(backs[r[0]]) >= min_docs and r[2] != min(backs[r[0]])}


def runs_by_hand(w, least, power):
    out = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, power * q):
                out.setdefault((i, j - i + q), q)
            i = max(j, i) + 1
    return sorted((i, n, q) for (i, n), q in out.items())


words = st.lists(st.integers(0, 3), max_size=40)
periodic = st.builds(lambda a, b, k, c: a + b * k + c, words, st.lists(st.integers(0, 3), max_size=6), st.integers(0, 9), words)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(words, periodic), max_size=5), st.sampled_from([(6, 4), (2, 2), (3, 3), (1, 5)]))
def test_runs_equal_brute_force(texts, rule):
    sizes = np.array([len(w) for w in texts], np.int64)
    got = periodic_runs.find(np.array([x for w in texts for x in w], np.int64), sizes, *rule)
    want, start = [], 0
    for w in texts:
        want += [(a + start, n, q) for a, n, q in runs_by_hand(w, *rule)]
        start += len(w)
    assert [tuple(r) for r in got.tolist()] == want


def test_run_digest(spark):
    texts = [None, "", " \t\n", "a", "a a a a a", "a a a a a a", "x " + "a b " * 6 + "y", "a b c " * 5 + "d " * 7, "Ü ü " * 4, "w" * 5000 + " v " * 6, " ".join(f"w{i % 500}" for i in range(2100))]
    texts += [" ".join(f"t{(7 * i) % 61}" for i in range(40 + k)) for k in range(40)]
    rows = [(i, t, "en", "s", *CLASH) for i, t in enumerate(texts)] + [(6, texts[6], "en", "s", *CLASH), (None, texts[7], None, None, *CLASH)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = {(r["doc_id"], r["collapsed_sha256"]): r for r in periodic_runs.digest(docs).collect()}
    n_planted = 0
    for i, text, *_ in rows:
        w = (text or "").split()
        h = zlib.crc32(b"" if i is None else str(i).encode())
        if h % 10 == 0 and w:
            a, g = h // 10 % len(w), h // 10
            p = 1 + (len(w) - a) // (3 + g % 8)
            w = [w[j if j < a else a + (j - a) % p] for j in range(len(w))]
            n_planted += 1
        found = runs_by_hand(w, 6, 4)
        gone = {j for a, n, q in found for j in range(a + q, a + n)}
        left = hashlib.sha256(" ".join(x for j, x in enumerate(w) if j not in gone).encode()).hexdigest()
        r = got[i, left]
        top = min(found, key=lambda f: (-f[1], f[0], f[2])) if found else (None,) * 3
        assert (r["n_runs"], r["start"], r["length"], r["period"]) == (len(found), *top)
        assert r["exponent_milli"] == (1000 * top[1] // top[2] if found else None)
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{a},{n},{q}\n" for a, n, q in found).encode()).hexdigest()
    assert n_planted >= 3
    assert periodic_runs.digest(docs.where("false")).count() == 0 == periodic_runs.runs(docs.where("false")).count()
    plain = {(r["doc_id"], r["start"], r["length"], r["period"]) for r in periodic_runs.runs(docs).collect()}
    assert {(6, 1, 12, 2), (8, 0, 8, 2), (9, 1, 6, 1), (10, 0, 2100, 500)} <= plain and not any(i in (0, 1, 2, 3, 4) for i, *_ in plain)
    short = {r["doc_id"]: r["text"] for r in periodic_runs.collapse(docs).collect()}
    assert short[6] == "x a b y" and short[5] == "a" and short[0] == "" and short[10] == " ".join(f"w{i}" for i in range(500))


def test_long_text_of_one_word_is_quick():
    n = 300_000
    assert periodic_runs.find(np.zeros(n, np.int64), np.array([n])).tolist() == [[0, n, 1]]


def audit_by_hand(rows, min_docs, top):
    terms = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    uses, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for _, text, lang, source, *_ in rows:
        found = ["".join(c.lower() if "A" <= c <= "Z" else c for c in t) for t in terms.findall(text or "")]
        uses[lang or "", source or ""].update(found)
        docs[lang or ""].update(set(found))
        groups[lang or ""].add(source or "")
    out = []
    f = lambda p, q: (p - q) * (p - q) // (p + q)
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= min_docs]
        share = lambda c: {t: 1 + 10**9 * (c[t] + 2) // (sum(c[x] for x in kept) + 2 * len(kept)) for t in kept}
        own = {s: share(uses[lang, s]) for s in sources}
        q = share(sum((uses[lang, s] for s in sources), Counter()))
        for s in sources:
            pair = [(-sum(f(own[s][t], own[o][t]) for t in kept), o.encode(), o) for o in sources - {s}]
            term = [(-f(own[s][t], q[t]), t.encode(), t) for t in kept if uses[lang, s][t] > 0 and own[s][t] > q[t]]
            for part, found in (("pair", sorted(pair)), ("term", sorted(term)[:top])):
                out += [(lang, s, part, item, -v, k + 1) for k, (v, _, item) in enumerate(found)]
    return out


@pytest.mark.parametrize("min_docs", [2, 3, 50])
def test_divergence_equals_brute_force(spark, min_docs):
    some = np.random.default_rng(5)
    vocabulary = ["the", "The", "of", "ſun", "Straße", "naïve", "x1y", "don't", "日本語", "a_b", *(f"w{chr(97 + i)}" for i in range(20))]
    rows = [(i, " ".join(some.choice(vocabulary[: 5 + 3 * int(k)], 30)), ["en", "de", None][int(some.integers(3))], f"s{k}", *CLASH) for i, k in enumerate(some.integers(0, 6, 80))]
    rows += [(None, None, None, None, *CLASH), (1, "", "fr", "alone", *CLASH), (2, "123 !", "xx", "a", *CLASH), (3, None, "xx", "b", *CLASH), rows[0], rows[0], (9, "the " * 5000, "en", "S0", *CLASH)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = divergence_audit.audit(docs, min_docs)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(tuple(r) for r in got.collect()) == sorted(audit_by_hand(rows, min_docs, 10))
    assert divergence_audit.audit(docs.where("false")).count() == 0


def test_counts_are_the_same_however_often_a_task_passes_them_on(spark, monkeypatch):
    batch = pa.RecordBatch.from_arrays([pa.array(["en"] * 3000), pa.array([f"s{i % 3}" for i in range(3000)]), pa.array([f"w{chr(97 + i % 26)} common" for i in range(3000)])], names=["lang", "source", "text"])

    def summed():
        out = Counter()
        for b in divergence_audit.counter(iter([batch])):
            for lang, source, term, uses, docs in zip(*(c.to_pylist() for c in b.columns), strict=True):
                out[lang, source, term, "uses"] += uses
                out[lang, source, term, "docs"] += docs
        return out

    whole = summed()
    monkeypatch.setattr(divergence_audit, "HELD_TERMS", 5)
    assert summed() == whole and whole["en", "s1", "common", "docs"] == 1000
