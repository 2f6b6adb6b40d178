"""The service surface: named tables and the operations over them, one method per tool.

Page sizes are part of the contract and are kept. There are no caps on scanned rows: those protect a single process, and
here every scan is distributed and complete.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .convention import DEFAULT, Convention
from .errors import QueryLookupError, QueryValidationError, Refusal
from .operators import aggregate as aggregating
from .operators import filters as filtering
from .operators import metrics as measuring
from .operators import crosswalks, identifiers, identity, joins, ontology, profile, provenance, relationships, selection
from .types import Table


@dataclasses.dataclass(frozen=True)
class JoinPage:
    """A page of a join: its rows, the facts of the whole join, and whether rows were left out."""

    rows: DataFrame
    facts: dict
    total_result_rows: int
    truncated: bool
    warning: str | None


@dataclasses.dataclass(frozen=True)
class Answer:
    """Groups with their metrics and, per group, what they rest on (``contributing_rows``, ``n_ranges``, ``complete``, ``ranges``); what each
    metric is; and how many rows entered, were left out by filters, and lack the group's columns."""

    groups: DataFrame
    definitions: list[dict]
    rows: DataFrame


class Engine:
    def __init__(self, spark: SparkSession, dataset: str = "dataset", convention: Convention = DEFAULT) -> None:
        self.spark, self.dataset, self.convention = spark, dataset, convention
        self._tables: dict[str, Table] = {}
        self._gates: dict[str, Callable[[DataFrame], DataFrame]] = {}
        self._crosswalks: dict[str, identity.Crosswalk | crosswalks.CrosswalkTable] = {}
        self._relationships: dict[str, dict] = {}

    # Catalogue
    def register(self, name: str, df: DataFrame, locator: str | None = None, scales: Mapping[str, int] | None = None, gate: Callable[[DataFrame], DataFrame] | None = None) -> Table:
        """``gate`` is asked whenever the table is read; it refuses, or gives the rows to read."""
        self._tables[name] = Table(name, df, locator, dict(scales or {}))
        self._gates.pop(name, None)
        if gate:
            self._gates[name] = gate
        return self._tables[name]

    def register_crosswalk(self, name: str, content: bytes) -> identity.Crosswalk:
        self._crosswalks[name] = identity.parse_crosswalk(content, name)
        return self._crosswalks[name]

    def register_crosswalk_file(self, name: str, path: str) -> crosswalks.CrosswalkTable:
        """A crosswalk of any size: its forms are tested and kept as a table."""
        self._crosswalks[name] = crosswalks.read(self.spark, path, name)
        return self._crosswalks[name]

    def mapping_facts(self, table: str, keys: Sequence[str], crosswalk: str, other: str, other_keys: Sequence[str], key_format: str | None = None, other_key_format: str | None = None) -> DataFrame:
        """What a crosswalk does to the keys of a table that meets another one."""
        crosswalks.checked(keys, key_format, True, bool(other_key_format))
        crosswalks.checked(other_keys, other_key_format, True, bool(key_format), side="right")
        forms = self.crosswalk(crosswalk)
        return crosswalks.mapping_facts(identity.resolve(self.table(table), keys, key_format, forms), identity.resolve(self.table(other), other_keys, other_key_format, forms), forms)

    def list_tables(self) -> list[str]:
        return sorted(self._tables)

    def table(self, name: str) -> Table:
        if name not in self._tables:
            raise QueryLookupError(f"unknown table {name!r}; available: {self.list_tables()}")
        t = self._tables[name]
        return dataclasses.replace(t, df=self._gates[name](t.df)) if name in self._gates else t

    def crosswalk(self, name: str | None) -> DataFrame | None:
        if name is None:
            return None
        if name not in self._crosswalks:
            raise QueryLookupError(f"unknown crosswalk {name!r}; available: {sorted(self._crosswalks)}")
        return self._crosswalks[name].rows(self.spark)

    # Rows
    def read_rows(self, table: str, columns: Sequence[str] | None = None, offset: int = 0, limit: int = 100) -> DataFrame:
        return filtering.read_rows(self.table(table), columns, offset, limit)

    def filter_rows(self, table: str, filters: Sequence[dict], columns: Sequence[str] | None = None, limit: int = 100) -> DataFrame:
        return filtering.filter_rows(self.table(table), filters, columns, limit)

    # Aggregation
    def aggregate(self, table: str, metrics: Sequence[dict], group_by: Sequence[str] = (), filters: Sequence[dict] = (), unit: Sequence[str] = (), unit_metrics: Sequence[dict] = (), on_inconsistent_unit: str = "refuse") -> DataFrame | aggregating.UnitResult:
        if unit_metrics and not unit:
            raise QueryValidationError("unit_metrics need a unit")
        if unit:
            return self._consistent(aggregating.aggregate_units(self.table(table), metrics, unit, unit_metrics, group_by, filters, on_inconsistent_unit), on_inconsistent_unit)
        return aggregating.aggregate(self.table(table), metrics, group_by, filters)

    def _consistent(self, result: aggregating.UnitResult, policy: str) -> aggregating.UnitResult:
        """Under ``refuse`` a unit in several groups is an error that names it, not an answer without groups."""
        return aggregating.require_consistent(result) if policy == "refuse" else result

    def answer(self, table: str, metrics: Sequence[dict], group_by: Sequence[str] = (), filters: Sequence[dict] = ()) -> Answer:
        """An aggregate together with its evidence. Metrics and contributors are each one shuffle by group and meet by that key."""
        t = self.table(table)
        if t.locator is None:
            raise QueryValidationError(f"{table!r} has no locator, so no answer over it can be traced")
        specs = measuring.validated(t, metrics)
        groups = aggregating.aggregate(t, metrics, group_by, filters)
        rows = filtering.filtered(t, filters)
        found = provenance.contributions(rows, t.locator, group_by).withColumnRenamed("rows", "contributing_rows")
        own = [f"__k{i}" for i in range(len(group_by))]
        found = found.toDF(*own, *found.columns[len(own) :])
        if own:
            groups = groups.join(found, selection.same(groups, found, list(zip(group_by, own, strict=True))), "left").drop(*own)
        else:
            groups = groups.join(found, how="left")  # one row each
        numeric = {s["name"]: s["op"] in measuring.NUMERIC for s in specs}
        definitions = [{**s, "kind": t.kinds[s["column"]] if s["column"] else None, "missing": "left out" if numeric[s["name"]] else "counted as the metric says"} for s in specs]
        lacking = aggregating.unkeyed(group_by)
        entered = filtering.conjunction(t, filters)
        counts = t.df.agg(F.count(F.lit(1)).alias("rows"), F.count_if(~entered).alias("filtered_out"), F.count_if(entered & lacking).alias("in_missing_groups"))
        return Answer(groups, definitions, counts)

    def describe_variable(self, table: str, column: str) -> DataFrame:
        return profile.describe(self.table(table), column)

    def profile(self, table: str) -> DataFrame:
        t = self.table(table)
        return profile.profile(t.df, t.columns, self.convention)

    def contributors(self, table: str, filters: Sequence[dict] = ()) -> dict[str, object]:
        t = self.table(table)
        return provenance.contributors(t, filtering.filtered(t, filters))

    # Joins
    def _resolved(self, crosswalk: str | None = None, left_key_format: str | None = None, right_key_format: str | None = None, forms_per_canonical: Sequence[str] = ()) -> dict | None:
        if not (crosswalk or left_key_format or right_key_format):
            return None
        return {"crosswalk": self.crosswalk(crosswalk), "left_key_format": left_key_format, "right_key_format": right_key_format, "forms_per_canonical": forms_per_canonical}

    def join_tables(self, left: str, right: str, left_keys: Sequence[str], right_keys: Sequence[str], how: str = "inner", left_columns: Sequence[str] | None = None, right_columns: Sequence[str] | None = None, limit: int = 100, **mapping: object) -> JoinPage:
        """A page of joined rows in a fixed order, and what the whole join comes to."""
        from .types import bounded

        n, resolved = bounded(limit, filtering.MOST_ROWS), self._resolved(**mapping)
        a, b = self.table(left), self.table(right)
        if resolved:
            rows = joins.resolved_join(a, b, left_keys, right_keys, how, **resolved)
        else:
            rows = joins.join(a, b, left_keys, right_keys, how)
        shown = [f"left.{c}" for c in left_columns or a.columns] + [f"right.{c}" for c in right_columns or b.columns] + [c for c in rows.columns if c.startswith("key.")]
        a.require(*(left_columns or []))
        b.require(*(right_columns or []))
        facts = joins.remarks(self.join_facts(left, right, left_keys, right_keys, how, **mapping)).first().asDict()
        page = joins.page(a, b, left_keys, right_keys, rows, n).select(*[F.col(f"`{c}`") for c in shown])
        return JoinPage(page, facts, facts["total_result_rows"], facts["total_result_rows"] > n, facts["warning"])

    def join_facts(self, left: str, right: str, left_keys: Sequence[str], right_keys: Sequence[str], how: str = "inner", **mapping: object) -> DataFrame:
        resolved = self._resolved(**mapping)
        if resolved is None:
            return joins.diagnostics(self.table(left), self.table(right), left_keys, right_keys, how)
        return joins.resolved_diagnostics(self.table(left), self.table(right), left_keys, right_keys, how, **resolved)

    def aggregate_join(self, metrics: Sequence[dict], relationship_id: str | None = None, left: str | None = None, right: str | None = None, left_keys: Sequence[str] | None = None, right_keys: Sequence[str] | None = None, crosswalk: str | None = None, left_key_format: str | None = None, right_key_format: str | None = None, forms_per_canonical: Sequence[str] = (), **options: object) -> DataFrame | aggregating.UnitResult:
        mapping = {"crosswalk": crosswalk, "left_key_format": left_key_format, "right_key_format": right_key_format, "forms_per_canonical": forms_per_canonical}
        if relationship_id is not None:
            if any(x for x in (left, right, left_keys, right_keys, *mapping.values())):
                raise QueryValidationError("a relationship id stands instead of tables, keys and mappings, not beside them")
            r = self._usable(relationship_id)
            left, right, left_keys, right_keys, mapping = r["left"], r["right"], r["left_keys"], r["right_keys"], r.get("mapping") or {}
        if not (left and right and left_keys and right_keys):
            raise QueryValidationError("aggregate_join needs two tables and their keys")
        out = joins.aggregate_join(self.table(left), self.table(right), left_keys, right_keys, metrics, resolved=self._resolved(**mapping), **options)
        return self._consistent(out, str(options.get("on_inconsistent_unit", "refuse"))) if isinstance(out, aggregating.UnitResult) else out

    # Relationships
    def build_relationships(self, declarations: Sequence[Mapping] = ()) -> list[dict]:
        """Assess declarations and candidates. A declaration that names something unknown or is refused by its data goes to
        ``skipped`` with the reason; the others are built."""
        self.skipped: list[dict] = []
        good = []
        for i, d in enumerate(declarations):
            try:
                relationships.checked(d, i)
                self.table(d["left"]).require(*d["left_keys"])
                self.table(d["right"]).require(*d["right_keys"])
                self.crosswalk(d.get("crosswalk"))
                good.append(d)
            except QueryLookupError as e:
                self.skipped.append({"declaration": dict(d), "reason": str(e)})
        found = relationships.build(self.spark, self.dataset, {n: self.table(n) for n in self._tables}, good, self._crosswalks, self.skipped)
        self._relationships = {r["id"]: r for r in found}
        return found

    def list_relationships(self, status: str | None = None) -> list[dict]:
        return [r for r in self._relationships.values() if status is None or r["status"] == status]

    def get_relationship(self, relationship_id: str) -> dict:
        if relationship_id not in self._relationships:
            raise QueryLookupError(f"unknown relationship {relationship_id!r}; available: {sorted(self._relationships)}")
        return self._relationships[relationship_id]

    def _usable(self, relationship_id: str) -> dict:
        """A relationship that may be joined: declared or deterministic, over tables and a crosswalk that have not changed since."""
        r = self.get_relationship(relationship_id)
        if r["status"] not in ("declared", "deterministic"):
            raise QueryValidationError(f"relationship {relationship_id} is {r['status']}; only declared or deterministic ones join")
        mapping = r.get("mapping") or {}
        if name := mapping.get("crosswalk"):
            if name not in self._crosswalks or self._crosswalks[name].sha256 != r["crosswalk_sha256"]:
                raise Refusal(f"crosswalk {name!r} is not the one that relationship {relationship_id} was assessed with", content_withheld=True)
        return r

    def join_relationship(self, relationship_id: str, how: str = "inner", limit: int = 100) -> JoinPage:
        r = self._usable(relationship_id)
        return self.join_tables(r["left"], r["right"], r["left_keys"], r["right_keys"], how, limit=limit, **(r.get("mapping") or {}))

    # Text and terms
    def scan_identifiers(self, table: str, key: str, text: str) -> DataFrame:
        return identifiers.scan(self.table(table).df, key, text)

    def search_terms(self, terms: DataFrame, query: str, top_k: int = 5) -> DataFrame:
        return ontology.search(terms, query, top_k)
