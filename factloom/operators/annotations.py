"""Assessments as annotation records, and curated labels back as answers."""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import QueryValidationError

# The label of each result.
LABELS = {"pass": "conformant", "fail": "non_conformant", "partial": "partial", "unknown": "insufficient_evidence", "not_applicable": "not_applicable"}
RESULTS = {v: k for k, v in LABELS.items()}


def label(result: str) -> str:
    if result not in LABELS:
        raise QueryValidationError(f"no label for result {result!r}; known: {sorted(LABELS)}")
    return LABELS[result]


def result(label_: str, partial_as: str | None = None) -> str:
    if label_ not in RESULTS:
        raise QueryValidationError(f"unknown label {label_!r}; known: {sorted(RESULTS)}")
    if label_ == "partial" and partial_as is not None:
        if partial_as not in ("pass", "fail", "unknown"):
            raise QueryValidationError(f"partial_as is pass, fail or unknown; got {partial_as!r}")
        return partial_as
    return RESULTS[label_]


def label_column(c: Column) -> Column:
    """``label`` as an expression; a result without a label stops the job."""
    out = None
    for k, v in LABELS.items():
        out = F.when(c == k, v) if out is None else out.when(c == k, v)
    return out.otherwise(F.raise_error(F.concat(F.lit("no label for result "), F.coalesce(c, F.lit("null")))))


def record(dataset: str, criterion: str, result_: str, rationale: str, evidence: Sequence[Mapping] = (), family: str = "fair", variant: str = "local") -> dict[str, object]:
    """A proposed annotation: a label with its reason and evidence, under an id that its content gives. It is a proposal until
    somebody approves it."""
    body = {"dataset_id": dataset, "criterion": criterion, "label": label(result_), "rationale": rationale, "evidence": [dict(e) for e in evidence], "family": family, "variant": variant}
    text = json.dumps(body, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    return {"annotation_id": "ann_" + hashlib.sha256(text.encode()).hexdigest()[:20], **body, "status": "proposed", "method": "agent_proposal"}


def repeated_ids(records: DataFrame, key: str = "annotation_id") -> DataFrame:
    return records.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def write_records(records: Sequence[Mapping], folder: str, overwrite: bool = False) -> list[str]:
    """One JSON file a record, all or none: ids must be unique, and existing files stay unless ``overwrite``."""
    ids = [r["annotation_id"] for r in records]
    if len(set(ids)) != len(ids):
        raise QueryValidationError("annotation ids repeat")
    paths = [os.path.join(folder, f"{i}.json") for i in ids]
    present = [p for p in paths if os.path.exists(p)]
    if present and not overwrite:
        raise QueryValidationError(f"files exist already: {present}")
    body = [json.dumps(r, indent=2, ensure_ascii=False, sort_keys=True) + "\n" for r in records]
    os.makedirs(folder, exist_ok=True)
    for p, text in zip(paths, body, strict=True):
        with open(p + ".part", "w", encoding="utf-8") as f:
            f.write(text)
    for p in paths:
        os.replace(p + ".part", p)
    return paths


def reference_labels(records: DataFrame, family: str, variant: str) -> DataFrame:
    """(criterion, label) of approved curated records; (criterion, labels) that disagree or come from an agent stop the job.

    ``records`` has criterion, label, family, variant, status and method.
    """
    kept = records.where((F.col("status") == "approved") & (F.col("family") == family) & (F.col("variant") == variant))
    one = kept.groupBy("criterion").agg(F.count_distinct("label").alias("k"), F.max("label").alias("label"), F.bool_or(F.col("method") == "agent_proposal").alias("agent"))
    bad = F.when(F.col("agent"), F.raise_error(F.lit("an approved record is an agent's proposal")).cast("string")).when(F.col("k") > 1, F.raise_error(F.concat(F.lit("approved records disagree on "), F.col("criterion"))).cast("string"))
    return one.select("criterion", F.coalesce(bad, F.col("label")).alias("label"))
