"""Toxicity by a weighted grammar of composed finite-state transducers.

Words become symbols: insult terminals of four strengths, threat, target, negation and reported speech, each perhaps with
a clause end. One small transducer per notion reads the symbols of a clause; their product is one table, and the state
that it reaches at a clause's end is what the clause says: how strong an insult, whether negated, reported, aimed at
someone, joined by a threat. A document's score is a logistic function of how many clauses say what, so single words do
not decide by themselves; the clause they stand in does.

The insult terminals (whole words and word stems) and the weights are learned on a bounded sample of labelled documents
(``SAMPLE``) outside the held-out fold. A term counts by the distinct words it follows, so a passage copied many times
supports its words once.

Scale: fitting costs the same at every size. Scoring is one pass over whole texts, with no shuffle; a bounded cache maps
words to symbols.

Defined cases: null text is empty; an empty text gets the score of no matched clause; rows that repeat each get a score;
with labels of one kind only the score is that kind's smoothed share; only the text is read for a score; labels that repeat
an id take their mean, and of documents that repeat a labelled id the least text is learned from; an empty table gives an
empty result; extra columns are ignored by ``score`` and kept by ``accepted``.
"""

from __future__ import annotations

import itertools
import math
import pickle
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, labelled

SAMPLE = 8000
THRESHOLD = 0.3
CACHED_WORDS = 400_000
#: Longer words are not remembered, so a worker's memory is bounded in bytes.
CACHED_BYTES = 64
# The closed word classes of the grammar, in the languages of the corpus.
TARGETS = frozenset("you your you're he she him her they them tu toi vous votre ton du dich dein ihr ihn sie usted tú tu ustedes ellos".split())
NEGATIONS = frozenset("not no never don't isn't aren't won't pas jamais ne nicht kein keine nie nunca jamás tampoco".split())
REPORTS = frozenset("said says say claims claimed reported quoted wrote dit disait affirme sagte sagt behauptet dijo dice afirma".split())
THREATS = frozenset("kill hurt die destroy attack beat punish tuer frapper mourir töten schlagen sterben matar golpear morir".split())
#: Symbols: 0 nothing, 1-4 insult by strength, then these. CLOSE is added where a clause ends.
THREAT, TARGET, NEGATION, REPORT, CLOSE = 5, 6, 7, 8, 16
STEMS = (4, 5, 6, 7)
_STRIP = re.compile(r"^\W+|\W+$")
_ENDS = (".", ",", ";", ":", "!", "?", "…")


class Machine:
    """A small transducer: from (state, symbol) to a state; what it says is the state it ends a clause in."""

    def __init__(self, states: int, arcs: dict[tuple[int, int], int]) -> None:
        self.states, self.arcs = states, arcs

    def step(self, state: int, symbol: int) -> int:
        return self.arcs.get((state, symbol), state)


def components() -> list[Machine]:
    flag = lambda symbol: Machine(2, {(0, symbol): 1})
    insult = Machine(5, {(s, k): max(s, k) for s in range(5) for k in range(1, 5)})
    # Negation and report only count where they come before the insult; an insult first closes the machine (state 2).
    before = lambda symbol: Machine(3, {(0, symbol): 1} | {(0, k): 2 for k in range(1, 5)})
    return [insult, before(NEGATION), before(REPORT), flag(TARGET), flag(THREAT)]


def compose(machines: list[Machine]) -> tuple[list[tuple[int, ...]], list[list[int]]]:
    """The product machine: its states as tuples, and next state by state and symbol."""
    states = list(itertools.product(*[range(m.states) for m in machines]))
    number = {s: i for i, s in enumerate(states)}
    table = [[number[tuple(m.step(x, a) for m, x in zip(machines, s, strict=True))] for a in range(CLOSE)] for s in states]
    return states, table


STATES, TABLE = compose(components())
SAYING = [i for i, s in enumerate(STATES) if s[0] or s[4]]


def stripped(word: str) -> str:
    return _STRIP.sub("", word)


class Symbols(dict):
    """Maps a lower-case white-space word to its symbol; ``terms`` gives the strength of words and stems."""

    def __init__(self, terms: dict[str, int]) -> None:
        self.terms = terms

    def __missing__(self, word: str) -> int:
        bare = stripped(word)
        at = self.terms.get(bare, 0) or max((self.terms.get(bare[:n] + "*", 0) for n in STEMS if len(bare) >= n), default=0)
        at = at or (THREAT if bare in THREATS else TARGET if bare in TARGETS else NEGATION if bare in NEGATIONS else REPORT if bare in REPORTS else 0)
        v = at + (CLOSE if word.endswith(_ENDS) else 0)
        if len(word) <= CACHED_BYTES:
            if len(self) > CACHED_WORDS:
                self.clear()
            self[word] = v
        return v


_PLAIN = bytes([0])
_HOT = re.compile(b"[\x01-\x05\x11-\x15]")


def clauses(symbols: Symbols, text: str) -> Counter:
    """How many clauses end in each state that says something."""
    out: Counter = Counter()
    for line in text.lower().split("\n"):
        code = bytes(map(symbols.__getitem__, line.split()))
        if not _HOT.search(code):
            continue
        state = 0
        for c in code.translate(None, _PLAIN):
            state = TABLE[state][c & 15]
            if c & CLOSE:
                out[state] += 1
                state = 0
        out[state] += 1
    return Counter({s: n for s, n in out.items() if STATES[s][0] or STATES[s][4]})


def features(found: Counter) -> list[float]:
    """Clause counts by what they say: strengths apart, then negated, reported, aimed and threatening ones."""
    count = lambda test: math.log1p(sum(n for s, n in found.items() if test(STATES[s])))
    out = [count(lambda s, k=k: s[0] >= k and s[1] != 1 and s[2] != 1) for k in range(1, 5)]
    out += [float(any(STATES[s][0] >= k for s in found)) for k in range(1, 5)]
    return [*out, *(count(lambda s, i=i: s[0] > 0 and s[i] == 1) for i in (1, 2, 3)), count(lambda s: s[4] == 1), 1.0]


def terms_of(labels: list[int], texts: list[str]) -> dict[str, int]:
    """Insult terminals and their strengths: words and stems (written with a star) that toxic documents hold in many contexts."""
    share = (sum(labels) + 1) / (len(labels) + 2)
    bare: dict[str, str] = {}

    def split(text: str) -> list[str]:
        out = []
        for w in text.lower().split():
            if w not in bare:
                bare[w] = stripped(w)
            out.append(bare[w])
        return out

    def forms(word: str) -> list[str]:
        return [word] + [word[:n] + "*" for n in STEMS if len(word) > n] if word and not word[0].isdigit() else []

    toxic, clean = Counter(), Counter()
    for y, text in zip(labels, texts, strict=True):
        (toxic if y else clean).update({f for w in set(split(text)) for f in forms(w)})
    hopeful = {f for f, a in toxic.items() if a >= 4 and a / (a + clean[f]) >= max(0.5, 2 * share)}
    del toxic
    seen: dict[str, tuple[set, set]] = defaultdict(lambda: (set(), set()))
    for i, (y, text) in enumerate(zip(labels, texts, strict=True)):
        words = split(text)
        for w, last in zip(words, ["", *words], strict=False):
            for f in forms(w):
                if f in hopeful:
                    seen[f][0 if y else 1].add(last if y else (i, last))
    found = {}
    for f, (a, b) in seen.items():
        # The chance that so many contexts of a neutral term are toxic ones, in bits; the least bits allow for the many terms tried.
        n, p = len(a) + len(b), (len(a) + 0.1) / (len(a) + len(b) + 0.2)
        bits = n * (p * math.log2(p / share) + (1 - p) * math.log2(max(1 - p, 1e-9) / (1 - share)))
        if p >= 0.7 and bits >= 16:
            found[f] = 4 if p >= 0.97 and bits >= 40 else 3 if p >= 0.9 and bits >= 28 else 2 if p >= 0.85 else 1
    # A longer form adds nothing to a stem that is found.
    return {f: k for f, k in found.items() if not any(f[:n] + "*" in found for n in STEMS if n < len(f.rstrip("*")))}


def learn(labels: list[int], texts: list[str]) -> bytes:
    if len(set(labels)) < 2:
        p = (sum(labels) + 1) / (len(labels) + 2)
        return pickle.dumps(({}, [0.0] * 12 + [math.log(p / (1 - p))]))
    terms = terms_of(labels, texts)
    symbols = Symbols(terms)
    x = np.array([features(clauses(symbols, t)) for t in texts])
    y, w = np.array(labels, float), np.zeros(x.shape[1])
    for _ in range(30):  # Newton steps of a ridge-penalised logistic regression
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + 0.5 * w
        h = (x * (p * (1 - p))[:, None]).T @ x + 0.5 * np.eye(len(w))
        w = w - np.linalg.solve(h, g)
    return pickle.dumps((terms, w.tolist()))


def score_text(symbols: Symbols, weights: list[float], text: str | None) -> float:
    logit = sum(a * b for a, b in zip(features(clauses(symbols, text)), weights, strict=True)) if text else weights[-1]
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, logit))))


def score(docs: DataFrame, labels: DataFrame, label: str = "toxic", threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    model = docs.sparkSession.sparkContext.broadcast(labelled.fit(labelled.sample(docs, labels, label, sample), learn))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (common.fold("doc_id", labelled.FOLDS) == labelled.HELD).alias("held_out"), common.text_of().alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, weights = pickle.loads(model.value)
        symbols = Symbols(terms)
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                b = batch.slice(k, 512)
                scores = [score_text(symbols, weights, t.as_py()) for t in b.column(2)]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32())], names=["doc_id", "held_out", "score", "predicted"])

    return rows.mapInArrow(common.lean(run), "doc_id long, held_out boolean, score double, predicted int")


def accepted(docs: DataFrame, labels: DataFrame, label: str = "toxic", threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """The documents whose score stays below the threshold; all of them where the labels taught no term, since nothing then tells
    documents apart. Columns pass as they are, whatever their names."""
    model = docs.sparkSession.sparkContext.broadcast(labelled.fit(labelled.sample(docs, labels, label, sample), learn))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, weights = pickle.loads(model.value)
        symbols = Symbols(terms)
        for batch in common.slices(batches):
            yield batch.filter(pa.array([score_text(symbols, weights, t.as_py()) < threshold for t in batch.column(at)], pa.bool_())) if terms else batch

    return docs.mapInArrow(common.lean(run), docs.schema)
