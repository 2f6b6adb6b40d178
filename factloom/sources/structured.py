"""JSON documents: their shape, and whether a file is dataset metadata by its name or by a standard it declares."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# File names of metadata conventions, and markers of standards in a document's @context.
NAMES = (
    (r"ro-crate-metadata\.(jsonl?d?|json)", "ro-crate"), (r"datapackage\.json", "frictionless"), (r"dataset_description\.json", "bids"), (r"participants\.(tsv|json)", "bids"), (r"[isa]_.*\.txt", "isa-tab"),
    (r"codemeta\.json", "codemeta"), (r"datacite\.(json|xml)", "datacite"), (r"metadata\.(json|yaml|yml|xml)", "generic"), (r"readme(\.md|\.txt|\.rst)?", "readme"), (r"licen[sc]e(\.md|\.txt)?", "license"), (r"changelog(\.md|\.txt)?", "changelog"),
)
MARKERS = (("w3id.org/ro/crate", "ro-crate"), ("doi.org/10.5063/schema/codemeta", "codemeta"), ("schema.org", "schema-org"), ("purl.org/dc/", "dublin-core"))
STANDARDS = frozenset({"ro-crate", "frictionless", "bids", "isa-tab", "codemeta", "datacite"})
LISTED_KEYS = 200


def parsed(raw: bytes) -> tuple[object, str | None]:
    """(document, error)."""
    try:
        return json.loads(raw.decode("utf-8-sig")), None
    except (UnicodeDecodeError, ValueError) as e:
        return None, str(e)


def depth(node: object) -> int:
    """Levels of a document; an explicit stack, so deep nesting cannot exhaust the interpreter's."""
    most, todo = 1, [(node, 1)]
    while todo:
        x, level = todo.pop()
        most = max(most, level)
        todo += [(v, level + 1) for v in (x.values() if isinstance(x, dict) else x if isinstance(x, list) else ())]
    return most


def shape(raw: bytes) -> dict[str, object]:
    """Root type, sorted keys (cut at ``LISTED_KEYS``), items, depth, or why it cannot be parsed."""
    document, error = parsed(raw)
    if error is not None:
        return {"root": "invalid", "keys": [], "items": None, "depth": 0, "error": error}
    if isinstance(document, dict):
        return {"root": "object", "keys": sorted(document)[:LISTED_KEYS], "items": len(document), "depth": depth(document), "error": None}
    if isinstance(document, list):
        return {"root": "array", "keys": [], "items": len(document), "depth": depth(document), "error": None}
    return {"root": type(document).__name__, "keys": [], "items": None, "depth": 1, "error": None}


def shapes(docs: DataFrame, key: str, column: str) -> DataFrame:
    """(key, root, keys, items, depth, error) of each JSON text, in one Arrow pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shape((t or "").encode()) for t in batch.column(1).to_pylist()]
            kinds = {"root": pa.string(), "keys": pa.list_(pa.string()), "items": pa.int64(), "depth": pa.int32(), "error": pa.string()}
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([f[k] for f in found], t) for k, t in kinds.items()]], names=[key, *kinds])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, F.col(column).cast("string").alias("text")).mapInArrow(run, f"`{key}` {kind}, root string, keys array<string>, items long, depth int, error string")


def name_column(path: Column) -> Column:
    """``by_name`` as an expression."""
    name = F.lower(F.element_at(F.split(path, "/"), -1))
    out = None
    for rx, convention in NAMES:
        out = F.when(name.rlike(f"^(?:{rx})$"), convention) if out is None else out.when(name.rlike(f"^(?:{rx})$"), convention)
    return out


def content_standards(docs: DataFrame, key: str, column: str) -> DataFrame:
    """(key, standard): the standard that each JSON text itself declares, or null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [by_content(parsed((t or "").encode())[0]) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], names=[key, "standard"])

    return docs.select(key, F.col(column).cast("string").alias("text")).mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, standard string")


def by_name(path: str) -> str | None:
    """The metadata convention that a file's name follows."""
    name = path.rsplit("/", 1)[-1].lower()
    return next((c for rx, c in NAMES if re.fullmatch(rx, name)), None)


def texts(node: object) -> Iterator[str]:
    if isinstance(node, str):
        yield node.lower()
    elif isinstance(node, dict | list):
        for v in node.values() if isinstance(node, dict) else node:
            yield from texts(v)


def by_content(document: object) -> str | None:
    """The standard that a JSON document itself declares; plausible keys alone are not enough."""
    if not isinstance(document, dict):
        return None
    low = {k.lower(): v for k, v in document.items()}
    context = list(texts(low.get("@context")))
    for marker, name in MARKERS:
        if any(marker in c for c in context):
            return name
    if isinstance(low.get("bidsversion"), str):
        return "bids"
    resources = low.get("resources")
    if isinstance(resources, list) and resources and all(isinstance(r, dict) for r in resources) and any({"path", "data"} & set(r) for r in resources):
        return "frictionless"
    kinds = low.get("types")
    if isinstance(kinds, dict) and any(k.lower() == "resourcetypegeneral" for k in kinds):
        return "datacite"
    if all(isinstance(low.get(k), list) and low.get(k) for k in ("titles", "creators")):
        return "datacite"
    return None
