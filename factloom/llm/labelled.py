"""A bounded, documented sample of labelled texts, and a place to fit a model on it: one task on an executor."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: The fold that learning never sees: crc32 of the id modulo FOLDS.
FOLDS, HELD = 4, 2
#: The most labelled documents that a fit reads; the smallest hashes of their ids choose them.
SAMPLE = 4000


def sample(docs: DataFrame, labels: DataFrame, label: str, rows: int = SAMPLE) -> DataFrame:
    """(doc_id, label, text) of at most ``rows`` labelled documents outside the held-out fold, one row an id: labels that repeat
    an id take their mean, and of documents that repeat an id the least text is learned from."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("double").alias("label"))
    known = known.filter(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & (common.fold("doc_id", FOLDS) != HELD)).groupBy("doc_id").agg(F.avg("label").alias("label"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)  # at most ``rows`` narrow rows: a proven bound for the broadcast
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_of().alias("text")).join(F.broadcast(chosen), "doc_id")
    return texts.groupBy("doc_id").agg(F.max((F.col("label") >= 0.5).cast("int")).alias("label"), F.min("text").alias("text"))


def fit(rows: DataFrame, learn: Callable[[list[int], list[str]], bytes]) -> bytes:
    """Run ``learn`` over the sample in one executor task; the driver receives the model's bytes. Rows are put in id order first."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, labels, texts = [], [], []
        for b in batches:
            ids += b.column(0).to_pylist()
            labels += b.column(1).to_pylist()
            texts += b.column(2).to_pylist()
        order = sorted(range(len(ids)), key=lambda i: (ids[i], texts[i]))
        yield pa.RecordBatch.from_arrays([pa.array([learn([labels[i] for i in order], [texts[i] for i in order])], pa.binary())], names=["model"])

    model = rows.repartition(1).mapInArrow(common.lean(task), "model binary").first()
    return bytes(model[0]) if model else learn([], [])  # an empty table may plan no task at all
