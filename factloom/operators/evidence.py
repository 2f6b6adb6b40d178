"""The ledger: claims with the evidence they rest on, addressed by their content."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import QueryValidationError

# The checks that may stand as evidence.
CHECKS = frozenset([
    "file.checksum", "file.size", "file.format-detection", "dataset.file-count", "dataset.identity", "convention.missing-values",
    "table.row-count", "table.column-list", "table.column-dtype", "table.missing-value-count", "table.missing-empty-count",
    "table.missing-sentinel-count", "table.ambiguous-token-count", "table.header-layout", "layout.declaration", "layout.block",
    "workbook.row-count", "workbook.missing-value-count", "workbook.unprofiled", "workbook.reader-unavailable", "json.shape",
    "boris.unprofiled", "boris.interval-pairing", "metadata.file-convention", "metadata.content-signature", "metadata.candidate",
    "identifier.detected",
])
SCHEMA = "claim_id string, claim string, subject string, evidence array<struct<check:string,result:string,source:string>>"


def claim_id(claim: str, subject: str, evidence: Sequence[Mapping]) -> str:
    text = json.dumps({"claim": claim, "subject": subject, "evidence": list(evidence)}, sort_keys=True, separators=(",", ":"), default=str)
    return "clm_" + hashlib.sha256(text.encode()).hexdigest()[:16]


def record(claims: Iterable[tuple[str, str, Sequence[Mapping]]]) -> list[tuple]:
    """Rows of the ledger; a claim without evidence or with an unknown check is refused, a repeated one is kept once."""
    out: dict[str, tuple] = {}
    for claim, subject, evidence in claims:
        if not evidence:
            raise QueryValidationError(f"a claim needs evidence: {claim!r}")
        unknown = [e.get("check") for e in evidence if e.get("check") not in CHECKS]
        if unknown:
            raise QueryValidationError(f"unknown check(s) {unknown}")
        key = claim_id(claim, subject, evidence)
        out.setdefault(key, (key, claim, subject, [(e["check"], str(e.get("result", "")), str(e.get("source", ""))) for e in evidence]))
    return list(out.values())


def ledger(spark: SparkSession, claims: Iterable[tuple[str, str, Sequence[Mapping]]]) -> DataFrame:
    return spark.createDataFrame(record(claims), SCHEMA).orderBy("subject", "claim_id")


def recorded(claims: DataFrame) -> DataFrame:
    """``record`` for any number of claims: rows (claim, subject, evidence) of structs (check, result, source), whose results are text. The
    query fails where a claim has no evidence or names an unknown check; a repeated one is kept once."""
    parts = claims.select("claim", "subject", F.transform("evidence", lambda e: F.struct(e["check"].alias("check"), F.coalesce(e["result"].cast("string"), F.lit("")).alias("result"), F.coalesce(e["source"].cast("string"), F.lit("")).alias("source"))).alias("evidence"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            for r in rows:
                if not r["evidence"] or any(e["check"] not in CHECKS for e in r["evidence"]):
                    raise ValueError(f"a claim needs evidence by known checks: {r['claim']!r}")
            ids = [claim_id(r["claim"], r["subject"], r["evidence"]) for r in rows]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), *batch.columns], names=["claim_id", *batch.schema.names])

    return parts.mapInArrow(run, SCHEMA).dropDuplicates(["claim_id"])


def query(claims: DataFrame, subject: str | None = None, check: str | None = None, contains: str | None = None) -> DataFrame:
    """Claims that meet all conditions given."""
    if subject is not None:
        claims = claims.where(F.col("subject") == subject)
    if check is not None:
        claims = claims.where(F.exists("evidence", lambda e: e["check"] == check))
    if contains:
        claims = claims.where(F.lower("claim").contains(contains.lower()))
    return claims


def table_claims(table: str, columns: Sequence[Mapping], sheet: bool = False) -> list[tuple[str, str, list[dict]]]:
    """What a table's profile lets one claim: its rows, its columns, and per column its type and what it lacks, by cause."""
    item = lambda check, result, source=table: [{"check": check, "result": result, "source": source}]
    rows, missing = ("workbook.row-count", "workbook.missing-value-count") if sheet else ("table.row-count", "table.missing-value-count")
    out = [(f"{table} has {columns[0]['rows'] if columns else 0} data rows", table, item(rows, columns[0]["rows"] if columns else 0))]
    out.append((f"{table} has the columns {', '.join(r['name'] for r in columns)}", table, item("table.column-list", [r["name"] for r in columns])))
    for r in columns:
        source = f"{table}#{r['name']}"
        out.append((f"column {r['name']} of {table} holds {r['dtype']} values", table, item("table.column-dtype", r["dtype"], source)))
        out.append((f"column {r['name']} of {table} lacks {r['missing']} of {r['rows']} values", table, item(missing, r["missing"], source)))
        for check, field in (("table.missing-empty-count", "missing_empty"), ("table.missing-sentinel-count", "missing_sentinel"), ("table.ambiguous-token-count", "ambiguous")):
            if r[field]:
                out.append((f"column {r['name']} of {table}: {r[field]} cells under {check}", table, item(check, r[field], source)))
    return out


def claims_of(profiled: DataFrame, table: str) -> DataFrame:
    """(claim, subject, check, result) per column of a profile, as rows of a DataFrame: the ledger of a wide table without a driver loop."""
    said = lambda check, result, *text: F.struct(F.concat(*text).alias("claim"), F.lit(table).alias("subject"), F.lit(check).alias("check"), result.cast("string").alias("result"))
    name, of = F.col("name"), F.lit(f" of {table} ")
    kinds = [said("table.column-dtype", F.col("dtype"), F.lit("column "), name, of, F.lit("holds "), F.col("dtype"), F.lit(" values"))]
    kinds += [said("table.missing-value-count", F.col("missing"), F.lit("column "), name, of, F.lit("lacks "), F.col("missing").cast("string"), F.lit(" values"))]
    return profiled.select(F.explode(F.array(*kinds)).alias("c")).select("c.*")
