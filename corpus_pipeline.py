"""The corpus pipeline: toxicity, near duplicates, benchmark leaks, secrets, packing.

Each stage works on all that its predecessor kept. Filters keep clean documents and their columns unchanged; the secret
stage cuts secrets out of texts and counts their characters anew; the last stage returns the packed pieces.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import decontamination, jaccard_join, packing, secret_scan, toxicity_grammar
from factloom.llm.queries import tokenizer_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the grammar rejects go; columns and order of the others stay as they are.

    A null or empty text scores as an empty one and stays; rows that repeat an id or a text are judged each for itself and alike; equal
    scores at the threshold are rejected alike; a null id is never learned from; an empty table stays empty, and labels that teach nothing reject nothing.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity_grammar.accepted(docs, labels)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked documents stays, the one with the smallest id.

    Texts without words (null, empty) link with nothing and all stay; rows with equal texts are one group; of several texts that share the
    smallest id, or of null ids only, the one of the smallest set digest stays; an empty table stays empty; other columns pass unchanged.
    """
    return jaccard_join.deduplicate(docs, n=5, num=80, den=100)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go.

    A text that covers an item by exactly the threshold goes. Null and empty texts hold nothing and stay, as do all documents beside an empty
    benchmark; null and empty items are held by nothing; equal rows go or stay together, whatever their ids; an empty table stays empty.
    """
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are cut out of the texts that hold them, and their characters counted anew; no row goes.

    Null and empty texts pass as they are; of spans that overlap the earlier one is cut whole, then what is left of the later; equal rows are cut alike; a null
    source or language counts as an empty one; an empty table stays empty.
    """
    clean = secret_scan.redact(docs)
    if "n_chars" not in docs.columns:
        return clean
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of fixed length.

    A null or empty text holds the closing id alone; equal rows are packed as often as they stand; the order of documents is that of the
    partitions, so no two pieces tie for a place; an empty table gives no pieces.
    """
    return packing.pack(docs, tokenizer_path())


STAGES: list[tuple[str, Stage]] = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("leaks", leaks), ("secrets", secrets), ("packing", pack)]
#: Learned weights, set similarity over components and a tokenizer are beyond SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factloom.llm.common import materialise

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
