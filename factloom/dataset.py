"""A directory as a dataset: ingest into files, tables, metadata and claims; then assess it and serve it.

Listing and layout decisions are driver work on file heads; hashing, reading and profiling run on the executors.
"""

from __future__ import annotations

import dataclasses
import json
import os
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import convention as conventions
from .engine import Engine
from .errors import QueryLookupError, QueryValidationError, Refusal
from .operators import annotations, assessment, checks, evidence, identifiers, principles, profile
from .sources import behaviour, blocks, delimited, files, structured, workbook
from .types import normalised

MOST_PREVIEW = 262_144
TEXTUAL = frozenset(["json", "jsonld", "xml", "yaml", "turtle", "ntriples", "rdfxml", "markdown", "text", "csv", "tsv", "boris"])
# The tools of each mode; a FAIR mode holds all of the mode before it.
CORE_TOOLS = (
    "dataset_inventory", "list_files", "inspect_file", "inspect_table", "list_tables", "read_rows", "filter_rows", "aggregate", "describe_variable", "join_tables",
    "list_relationships", "get_relationship", "join_relationship", "aggregate_join", "get_metadata", "get_evidence", "get_provenance", "resolve_identifier",
)
RULE_TOOLS = ("get_fair_indicator", "list_fair_rules", "list_fair_principles", "get_fair_principle")
CHECK_TOOLS = ("run_fair_check", "validate_identifier", "assess_fair_principles", "get_fair_recommendations", "plan_fair_publication")
MODES = {"raw": ("list_files", "inspect_file"), "structured": CORE_TOOLS, "fair-rules": CORE_TOOLS + RULE_TOOLS, "fair-deterministic": CORE_TOOLS + RULE_TOOLS + CHECK_TOOLS}


def tools(mode: str) -> tuple[str, ...]:
    if mode not in MODES:
        raise QueryLookupError(f"unknown mode {mode!r}; available: {sorted(MODES)}")
    return MODES[mode]


@dataclasses.dataclass
class Dataset:
    root: str
    files: list[dict]
    dataset_id: str
    convention: conventions.Convention
    engine: Engine
    metadata: dict[str, str]
    unread: tuple[str, ...]
    claims: list[tuple]
    warnings: list[str]
    profiles: dict[str, list[dict]]
    spark: SparkSession
    laid: dict[str, blocks.Laid] = dataclasses.field(default_factory=dict)
    records: dict[str, DataFrame] = dataclasses.field(default_factory=dict)

    def path(self, name: str) -> str:
        if name not in {f["path"] for f in self.files}:
            raise QueryLookupError(f"unknown file {name!r}; available: {[f['path'] for f in self.files]}")
        return os.path.join(self.root, name)

    def verify_file(self, name: str) -> bool:
        """Whether a file still has the bytes that were ingested."""
        try:
            return files.digest_of(self.path(name)) == next(x["sha256"] for x in self.files if x["path"] == name)
        except OSError:
            return False

    def require_unchanged(self, name: str) -> None:
        if not self.verify_file(name):
            raise Refusal(f"{name!r} has changed since it was ingested", content_withheld=True)

    def gated(self, name: str, df: DataFrame) -> DataFrame:
        """The rows of a file for a scan: refused if the file has changed, and tested once more by the scan's own plan when it runs."""
        self.require_unchanged(name)
        sha256 = next(x["sha256"] for x in self.files if x["path"] == name)
        return df.join(F.broadcast(files.gate(self.spark, self.path(name), sha256)), how="cross")  # one row or none

    def verify_dataset(self) -> dict[str, object]:
        """Whether the folder still is the dataset that was ingested, and which files were added, removed or changed."""
        found = {r["path"]: r["change"] for r in self.drift().orderBy("path").collect()}
        return {"dataset_id": self.dataset_id, "unchanged": not found, **{k: [p for p, c in found.items() if c == k] for k in ("added", "removed", "changed")}}

    def drift(self) -> DataFrame:
        then = self.spark.createDataFrame([(f["path"], f["sha256"]) for f in self.files], "path string, sha256 string")
        return files.drift(then, files.inventory(self.spark, self.root))

    def inspect_file(self, name: str, preview_bytes: int = 4096) -> dict[str, object]:
        self.require_unchanged(name)
        with open(self.path(name), "rb") as f:
            head = f.read(min(preview_bytes, MOST_PREVIEW))
        return {**next(x for x in self.files if x["path"] == name), "preview": head.decode("utf-8", "replace")}

    def texts(self) -> dict[str, str]:
        out = {}
        for p in self.metadata:
            self.require_unchanged(p)
            with open(self.path(p), encoding="utf-8-sig", errors="strict") as f:
                out[p] = f.read()
        return out

    def identifiers(self) -> DataFrame:
        rows = [(p, t) for p, t in self.texts().items()]
        return identifiers.scan(self.spark.createDataFrame(rows, "source string, text string"), "source", "text")

    def ledger(self) -> DataFrame:
        return self.spark.createDataFrame(self.claims, evidence.SCHEMA)

    def assess(self) -> DataFrame:
        tokens: dict[str, int] | None = None
        for name, columns in self.profiles.items():
            tokens = (tokens or {}) | {f"{name}#{r['name']}": r["missing_sentinel"] + r["ambiguous"] for r in columns}
        c = checks.Catalogue({f["path"]: f["format"] for f in self.files}, self.metadata, self.unread, self.texts())
        return assessment.run(self.spark, checks.rules(c, tokens, self.convention.source == "datapackage.json"))

    # Catalogue
    def dataset_inventory(self) -> dict[str, object]:
        kinds = sorted({f["format"] for f in self.files})
        return {"dataset_id": self.dataset_id, "files": len(self.files), "bytes": sum(f["size"] for f in self.files), "formats": {k: sum(f["format"] == k for f in self.files) for k in kinds}, "tables": self.engine.list_tables(), "metadata_files": sorted(self.metadata), "warnings": self.warnings}

    def list_files(self, pattern: str = "*", format: str | None = None) -> list[dict]:
        import fnmatch

        return [f for f in self.files if fnmatch.fnmatch(f["path"], pattern) and (format is None or f["format"] == format)]

    def inspect_table(self, name: str, include_rows_above_data: bool = False, max_rows: int = 20, max_cells: int = blocks.MOST_ABOVE_CELLS) -> dict[str, object]:
        """A table's profile and layout; on demand the cells of the rows above its data, from the file as it was ingested."""
        if name not in self.profiles:
            raise QueryLookupError(f"unknown table {name!r}; available: {sorted(self.profiles)}")
        laid = self.laid.get(name)
        out: dict[str, object] = {"table": name, "columns": self.profiles[name]}
        if laid:
            n = len(laid.skipped) + (laid.header_rows if laid.header_rows > 1 else 0)
            out |= {"header_row": laid.header_row, "header_rows": laid.header_rows, "header_source": laid.source, "skipped_rows": laid.skipped, "positions": laid.columns, "rows_above_data_available": n}
            if include_rows_above_data:
                self.require_unchanged(name.split("#", 1)[0])
                out["rows_above_data"] = [r.asDict() for r in blocks.above(self.records[name], laid, self.convention, max_rows, max_cells).collect()]
        return out

    # Evidence and metadata
    def get_metadata(self) -> list[dict[str, object]]:
        """Recognised metadata as it stands; a file that has changed is named and its text withheld."""
        out = []
        for p, kind in sorted(self.metadata.items()):
            if not self.verify_file(p):
                out.append({"path": p, "convention": kind, "content_withheld": True})
                continue
            with open(self.path(p), encoding="utf-8-sig", errors="replace") as f:
                out.append({"path": p, "convention": kind, "text": f.read()})
        return out

    def get_provenance(self) -> dict[str, object]:
        """What was ingested and how: identity, files with their digests, convention, and the layouts that were declared."""
        declared = {n: l.header_row for n, l in self.laid.items() if l.source == "declared"}
        return {"dataset_id": self.dataset_id, "inputs": [{"path": f["path"], "sha256": f["sha256"]} for f in self.files], "missing_value_convention": self.convention.as_dict(), "declared_layouts": declared, "unread": sorted(self.unread)}

    def get_evidence(self, subject: str | None = None, check: str | None = None, contains: str | None = None) -> DataFrame:
        return evidence.query(self.ledger(), subject, check, contains).orderBy("subject", "claim_id")

    def resolve_identifier(self, value: str, crosswalk: str | None = None) -> DataFrame:
        return identifiers.resolve(self.identifiers(), value, self.engine.crosswalk(crosswalk))

    def validate_identifier(self, value: str) -> dict[str, object]:
        return identifiers.validate(self.spark.createDataFrame([(value,)], "value string"), "value").first().asDict()

    def get_relationship(self, relationship_id: str) -> dict:
        """A relationship, or a refusal where a file behind one of its tables has changed since it was assessed."""
        r = self.engine.get_relationship(relationship_id)
        for side in ("left", "right"):
            if (name := r[side].split("#", 1)[0]) in {f["path"] for f in self.files}:
                self.require_unchanged(name)
        return r

    def annotations(self) -> list[dict]:
        """The assessment as proposed annotations."""
        return [annotations.record(self.dataset_id, r["rule"], r["result"], r["rationale"]) for r in self.assess().collect()]

    def probe_publication(self, url: str) -> dict:
        """Asking a live server is not this engine's work; the answer that another tool has kept may be brought as evidence."""
        raise Refusal("a live probe needs the network, which this engine never uses", url=url)

    # Rules and principles
    def results(self) -> dict[str, str]:
        return {r["rule"]: r["result"] for r in self.assess().collect()}

    def list_fair_rules(self) -> list[str]:
        return list(principles.FIXES)

    def run_fair_check(self, rule: str) -> dict[str, str]:
        if rule not in principles.FIXES:
            raise QueryLookupError(f"unknown rule {rule!r}; available: {list(principles.FIXES)}")
        return self.assess().where(F.col("rule") == rule).first().asDict()

    def get_fair_indicator(self, rule: str) -> dict[str, object]:
        if rule not in principles.FIXES:
            raise QueryLookupError(f"unknown rule {rule!r}; available: {list(principles.FIXES)}")
        return {"rule": rule, "principles": [n for n, (_, rules, _) in principles.ITEMS.items() if rule in rules], "remedy": principles.FIXES[rule]}

    def list_fair_principles(self) -> list[dict]:
        return [principles.principle(n) for n in principles.ITEMS]

    def get_fair_principle(self, name: str) -> dict:
        return principles.principle(name)

    def assess_fair_principles(self, name: str | None = None) -> list[dict]:
        return principles.assess(self.results(), [name] if name else tuple(principles.ITEMS))

    def get_fair_recommendations(self) -> list[dict]:
        return principles.recommendations(self.results())

    def plan_fair_publication(self) -> list[dict]:
        return principles.publication_plan(self.results())

    def manifest(self) -> dict[str, object]:
        """No times and no absolute paths: equal bytes give an equal manifest."""
        return {
            "dataset_id": self.dataset_id, "files": self.files, "missing_value_convention": self.convention.as_dict(), "tables": {n: self.profiles.get(n, []) for n in self.engine.list_tables()},
            "metadata_files": [{"path": p, "convention": k} for p, k in sorted(self.metadata.items())], "warnings": self.warnings, "relationships": [r["id"] for r in self.engine.list_relationships()],
        }

    def report(self) -> str:
        """The inventory and the assessment as Markdown."""
        lines = [f"# Dataset {self.dataset_id}", "", "| file | format | bytes |", "|-|-|-|", *[f"| {f['path']} | {f['format']} | {f['size']} |" for f in self.files], "", "| rule | result | why |", "|-|-|-|"]
        return "\n".join([*lines, *[f"| {r['rule']} | {r['result']} | {r['rationale']} |" for r in self.assess().collect()]]) + "\n"

    def write(self, folder: str) -> None:
        """manifest, provenance, evidence, relationships and assessment as JSON, the report as Markdown, and the ledger as Parquet; the
        folder must lie outside the dataset."""
        if os.path.commonpath([os.path.realpath(folder), os.path.realpath(self.root)]) == os.path.realpath(self.root):
            raise Refusal("outputs must lie outside the dataset")
        os.makedirs(folder, exist_ok=True)
        claims = sorted(({"claim_id": c[0], "claim": c[1], "subject": c[2], "evidence": [dict(zip(("check", "result", "source"), e, strict=True)) for e in c[3]]} for c in self.claims), key=lambda c: (c["subject"], c["claim_id"]))
        payloads = {
            "manifest.json": self.manifest(), "provenance.json": self.get_provenance(), "evidence.json": {"dataset_id": self.dataset_id, "claims": claims},
            "relationships.json": {"dataset_id": self.dataset_id, "relationships": self.engine.list_relationships()}, "assessment.json": {"dataset_id": self.dataset_id, "results": [r.asDict() for r in self.assess().collect()]},
        }
        for name, payload in payloads.items():
            with open(os.path.join(folder, name), "w", encoding="utf-8") as f:
                json.dump(payload, f, indent=2, ensure_ascii=False)
                f.write("\n")
        with open(os.path.join(folder, "report.md"), "w", encoding="utf-8") as f:
            f.write(self.report())
        self.ledger().write.mode("overwrite").parquet(f"file://{os.path.abspath(folder)}/ledger.parquet")


def typed(df: DataFrame, columns: Sequence[dict], convention: conventions.Convention) -> DataFrame:
    """Text columns cast to their profiled kinds; locators stay."""
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.startswith("_")], *[normalised(F.col(f"`{r['name']}`"), r["dtype"], convention).alias(r["name"]) for r in columns])


def ingest(spark: SparkSession, root: str, convention: conventions.Convention | None = None, excludes: Sequence[str] = (), layouts: object = None) -> Dataset:
    """Inventory, recognise, profile and register everything below ``root``. ``layouts`` declares where tables lie (see
    ``blocks.parse_layouts``); a declaration that fits no table is refused before anything is registered."""
    declared = blocks.parse_layouts(layouts) if layouts is not None else {}
    listed = [r.asDict() for r in files.inventory(spark, root).orderBy("path").collect() if not any(x in r["path"].split("/") for x in excludes)]
    unreadable, listed = [f["path"] for f in listed if f["sha256"] is None], [f for f in listed if f["sha256"] is not None]
    identity = files.dataset_id(spark.createDataFrame([(f["path"], f["sha256"]) for f in listed], "path string, sha256 string")) if listed else "sha256:" + files.hashlib.sha256(b"").hexdigest()
    sheets = {f["path"]: list(workbook.Workbook(os.path.join(root, f["path"])).sheets) for f in listed if f["format"] == "xlsx"}
    there = {f["path"] for f in listed if f["format"] in ("csv", "tsv")} | {f"{p}#{s}" for p, names in sheets.items() for s in names}
    if lost := sorted(set(declared) - there):
        raise QueryValidationError(f"declared layouts fit no table: {lost}; available: {sorted(there)}")
    if convention is None and any(f["path"] == "datapackage.json" for f in listed):
        with open(os.path.join(root, "datapackage.json"), "rb") as f:
            document, _ = structured.parsed(f.read())
        convention = conventions.from_datapackage(document) if isinstance(document, dict) else None
    convention = convention or conventions.DEFAULT
    engine, metadata, unread, claims = Engine(spark, identity, convention), {}, [], []
    warnings = [f"{p}: left out ({why})" for p, why in files.skipped(root)] + [f"{p}: cannot be read" for p in unreadable]
    profiles: dict[str, list[dict]] = {}
    laid: dict[str, blocks.Laid] = {}
    held: dict[str, DataFrame] = {}
    opened: list[Dataset] = []  # the dataset whose tables these are, once it is made

    def register(name: str, df: DataFrame, locator: str | None = None) -> None:
        file = name.split("#", 1)[0]
        engine.register(name, df, locator, gate=lambda rows: opened[0].gated(file, rows) if opened else rows)

    item = lambda check, result, source: [{"check": check, "result": result, "source": source}]

    def table(name: str, records: DataFrame, sheet: bool = False) -> None:
        """Lay the declared or found tables over the records, profile their text as it stands, register them with their kinds."""
        for block in declared.get(name, [None]):
            key = f"{name}#{block.name}" if block and block.name else name
            one = blocks.table(records, block, declared.get(name), letters=sheet, blank_rows=sheet)
            names = [c for c, _ in one.columns]
            profiles[key] = [r.asDict() for r in profile.profile(one.df.select(*[F.col(f"`{c}`") for c in names]), names, convention).orderBy("position").collect()] if names else []
            laid[key], held[key] = one, records
            if not sheet and (odd := one.ragged.count()):
                warnings.append(f"{key}: {odd} row(s) do not have {len(names)} fields")
            register(key, typed(one.df, profiles[key], convention), "_source_row")
            claims.extend(evidence.table_claims(key, profiles[key], sheet))
            claims.append((f"the header of {key} is {one.source} at row {one.header_row}", key, item("layout.block" if block and block.name else "layout.declaration" if block else "table.header-layout", one.header_row, key)))

    claims.append((f"the dataset holds {len(listed)} files", "dataset", item("dataset.file-count", len(listed), ".")))
    claims.append((f"the dataset is {identity}", "dataset", item("dataset.identity", identity, ".")))
    claims.append((f"missing values follow {convention.name}", "dataset", item("convention.missing-values", convention.name, convention.source)))
    for f in listed:
        path, kind, full = f["path"], f["format"], os.path.join(root, f["path"])
        claims.append((f"{path} has format {kind}", path, item("file.format-detection", kind, path)))
        claims.append((f"{path} has {f['size']} bytes", path, item("file.size", f["size"], path) + item("file.checksum", f["sha256"], path)))
        if f["conflict"]:
            warnings.append(f"{path}: the name and the bytes name different formats")
        document = None
        if kind in ("json", "jsonld"):
            with open(full, "rb") as g:
                raw = g.read()
            document, _ = structured.parsed(raw)
            shape = structured.shape(raw)
            claims.append((f"{path} is a JSON {shape['root']} of depth {shape['depth']}", path, item("json.shape", shape["root"], path)))
        if name := structured.by_name(path):
            metadata[path] = name
            claims.append((f"{path} is named by the convention {name}", path, item("metadata.file-convention", name, path)))
        elif found := structured.by_content(document):
            metadata[path] = found
            claims.append((f"{path} declares the standard {found}", path, item("metadata.content-signature", found, path)))
        if kind in ("csv", "tsv") and path not in metadata:
            if delimited.marked(full):
                warnings.append(f"{path}: a byte-order mark was stripped")
            table(path, blocks.file_records(spark, full))
        elif kind == "xlsx":
            for sheet in sheets[path]:
                table(f"{path}#{sheet}", blocks.sheet_records(spark, full, sheet), sheet=True)
        elif kind in ("xls", "xlsb", "ods"):
            unread.append(path)
            claims.append((f"no reader takes {path}", path, item("workbook.reader-unavailable", kind, path)))
        elif kind == "boris":
            p = behaviour.projects(spark, f"file://{os.path.abspath(full)}")
            register(f"{path}#observations", behaviour.observations(p).drop("file"))
            register(f"{path}#ethogram", behaviour.ethogram(p).drop("file"))
            if all(r["sound"] for r in behaviour.well_formed(p).collect()):
                register(f"{path}#events", behaviour.events(p).drop("file"))
                register(f"{path}#intervals", behaviour.intervals(p).drop("file"))
                claims.append((f"events of {path} are paired into intervals", path, item("boris.interval-pairing", "paired", path)))
            else:
                warnings.append(f"{path}: some events have another shape, so neither events nor intervals are read")
                claims.append((f"events of {path} are not profiled", path, item("boris.unprofiled", "event shape", path)))
    opened.append(Dataset(os.path.abspath(root), listed, identity, convention, engine, metadata, tuple(unread), evidence.record(claims), warnings, profiles, spark, laid, held))
    return opened[0]
