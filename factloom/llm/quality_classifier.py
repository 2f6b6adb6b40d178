"""Quality classifier with supervised subword embeddings.

A document is the mean of the learned vectors of its words and of their character n-grams, hashed into a table; a softmax
layer gives the score. Vectors and layer are trained together by stochastic gradient descent in numpy on a bounded sample
of labelled documents (``labelled.SAMPLE``) outside the held-out fold.

With two classes the softmax sees a vector only through its product with the difference of the two output rows, so a
trained model is kept as one number per bucket: scoring adds those numbers over the text and divides by their count,
which is the same value as the mean vector's. A cache of bounded size keeps each word's sum.

Scale: fitting costs the same at every size. Scoring is one pass over whole texts, with no shuffle.

Defined cases: null text is empty; an empty text gets the score of the bias alone; rows that repeat each get a score; no
labels give 0.5 everywhere; only the text is read for a score; labels that repeat an id take their mean, and of documents
that repeat a labelled id the least text is learned from; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
import operator
import pickle
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, labelled

BUCKETS = 1 << 18
DIM = 16
GRAMS = (3, 4, 5)
#: So many minibatches are seen, at every size: a small sample is gone through more often.
STEPS, BATCH, RATE = 250, 64, 2.0
THRESHOLD = 0.7
CACHED_WORDS = 400_000
#: Longer words are not remembered, so a worker's memory is bounded in bytes.
CACHED_BYTES = 64
#: Stands for a word that repeats the one before it.
AGAIN = b"\x00again"


def buckets(word: bytes) -> list[int]:
    """The buckets of the word itself and of its character n-grams."""
    out = [zlib.crc32(word) & (BUCKETS - 1)]
    if word is AGAIN or word == AGAIN:
        return out
    s = f"<{word.decode()}>"
    for n in GRAMS:
        out += [zlib.crc32(s[i : i + n].encode(), n) & (BUCKETS - 1) for i in range(len(s) - n + 1)]
    return out


def words_of(text: str) -> list[bytes]:
    return text.encode().split()


def learn(labels: list[int], texts: list[str]) -> bytes:
    """Train; gives the table collapsed to one number per bucket, and the bias."""
    if len(set(labels)) < 2:
        p = (sum(labels) + 1) / (len(labels) + 2)
        return pickle.dumps((np.zeros(BUCKETS, np.float32), math.log(p / (1 - p))))
    known: dict[bytes, int] = {}
    grams: list[np.ndarray] = []
    rows: list[tuple[np.ndarray, np.ndarray]] = []
    for text in texts:
        words = words_of(text)
        counts = Counter(words)
        if same := sum(map(operator.eq, words, words[1:])):
            counts[AGAIN] = same
        for w in counts:
            if w not in known:
                known[w] = len(grams)
                grams.append(np.array(buckets(w), np.int32))
        rows.append((np.array([known[w] for w in counts], np.int32), np.array(list(counts.values()), np.float32)))
    size = np.array([len(g) for g in grams], np.float32)
    first = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
    flat = np.concatenate(grams)
    y = np.array(labels, np.float32)
    rng = np.random.default_rng(7)
    table = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    out, bias = np.zeros(DIM, np.float32), np.float32(0)
    out[:] = rng.normal(0, 0.1, DIM)
    epochs, step = -(-STEPS // -(-len(rows) // BATCH)), 0
    steps = epochs * -(-len(rows) // BATCH)
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for k in range(0, len(order), BATCH):
            docs = order[k : k + BATCH]
            ids = np.concatenate([rows[d][0] for d in docs])
            weight = np.concatenate([rows[d][1] for d in docs])
            of = np.repeat(np.arange(len(docs)), [len(rows[d][0]) for d in docs])
            used, back = np.unique(ids, return_inverse=True)
            lens = size[used].astype(np.int64)
            index = flat[np.repeat(first[used] - np.cumsum(lens) + lens, lens) + np.arange(lens.sum())]
            value = table[index] @ out
            per_word = np.add.reduceat(value, np.concatenate([[0], np.cumsum(lens)[:-1]])) if len(lens) else np.zeros(0)
            n = np.maximum(np.bincount(of, weight * size[ids], len(docs)), 1)
            logit = np.bincount(of, weight * per_word[back], len(docs)) / n + bias if len(ids) else np.full(len(docs), bias)
            err = (1 / (1 + np.exp(-logit)) - y[docs]) / len(docs)
            share = np.bincount(back, weight * (err / n)[of], len(used)) if len(ids) else np.zeros(0)
            pull = np.bincount(index, np.repeat(share, lens), BUCKETS).astype(np.float32)
            hit = np.flatnonzero(pull)
            pull = pull[hit]
            rate = np.float32(RATE * 32 * (1 - step / steps))
            step += 1
            grad = pull @ table[hit]
            table[hit] -= rate * pull[:, None] * out[None, :]
            out -= rate * grad
            bias -= np.float32(RATE * (1 - step / steps) * err.sum())
    return pickle.dumps(((table @ out).astype(np.float32), float(bias)))


class WordSums(dict):
    """Maps a word to (sum of its buckets' numbers) + (count of them) i."""

    def __init__(self, table: np.ndarray) -> None:
        self.table = table

    def __missing__(self, word: bytes) -> complex:
        at = buckets(word)
        v = complex(float(self.table[at].sum()), len(at))
        if len(word) <= CACHED_BYTES:
            if len(self) > CACHED_WORDS:
                self.clear()
            self[word] = v
        return v


def score_text(sums: WordSums, bias: float, text: str | None) -> float:
    words = words_of(text) if text else []
    same = sum(map(operator.eq, words, words[1:]))
    total = sum(map(sums.__getitem__, words), 0j) + same * sums[AGAIN]
    logit = (total.real / total.imag if total.imag else 0.0) + bias
    return 1 / (1 + math.exp(-max(-500.0, min(500.0, logit))))


def score(docs: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = THRESHOLD, sample: int = labelled.SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    model = docs.sparkSession.sparkContext.broadcast(labelled.fit(labelled.sample(docs, labels, label, sample), learn))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, bias = pickle.loads(model.value)
        sums = WordSums(table)
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                b = batch.slice(k, 512)
                scores = [score_text(sums, bias, t.as_py()) for t in b.column(2)]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32())], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (common.fold("doc_id", labelled.FOLDS) == labelled.HELD).alias("held_out"), common.text_of().alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
