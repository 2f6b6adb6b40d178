"""Relationships between tables: candidates by column names, assessment by key counts, status and stable ids."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..errors import QueryValidationError
from ..types import Table
from . import identity, inclusion, joins
from .profile import SUBJECT_NAMES

CARDINALITIES = ("one_to_one", "one_to_many", "many_to_one", "many_to_many")
EXAMPLES = 10


def plain_name(name: str) -> str:
    """``normal_name`` of a column that is at hand."""
    return re.sub(r"[^a-z0-9]+", "_", name.lower()).strip("_")


def named_once(table: Table) -> dict[str, str]:
    """normalised name: column; names that two columns of the table share drop out."""
    names = [plain_name(c) for c in table.columns]
    return {n: c for n, c in zip(names, table.columns, strict=True) if names.count(n) == 1}


def name_pairs(tables: Mapping[str, Table]) -> list[tuple[str, str, str, str, str]]:
    """(left, right, left_key, right_key, normal) of all columns of two tables that share a normalised name; from the schemas alone."""
    names = {t: named_once(table) for t, table in sorted(tables.items())}
    return [(a, b, names[a][n], names[b][n], n) for a in names for b in names if a < b for n in names[a] if n in names[b]]


def column_facts(tables: Mapping[str, Table]) -> DataFrame:
    """(table, name, normal, unique) over all tables; names that two columns of a table share once normalised drop out. One grouping
    of the values of all columns tells which are unique."""
    spark = next(iter(tables.values())).df.sparkSession
    probes = {(t, n): inclusion.Probe(t, (c,), True) for t, table in tables.items() for n, c in named_once(table).items()}
    facts, _ = inclusion.measure(tables, list(probes.values()), [])
    return spark.createDataFrame([(t, p.keys[0], n, facts[p].unique) for (t, n), p in probes.items()], "table string, name string, normal string, unique boolean")


def candidates(facts: DataFrame) -> DataFrame:
    """(left, right, left_key, right_key, normal): tables that share a normalised column name which names subjects or is unique on a side."""
    a = facts.select(F.col("table").alias("left"), F.col("name").alias("left_key"), "normal", F.col("unique").alias("lu"))
    b = facts.select(F.col("table").alias("right"), F.col("name").alias("right_key"), "normal", F.col("unique").alias("ru"))
    pairs = a.join(b, "normal").where(F.col("left") < F.col("right"))
    return pairs.where(F.col("normal").isin(*sorted(SUBJECT_NAMES)) | F.col("lu") | F.col("ru")).select("left", "right", "left_key", "right_key", "normal")


def assess(left: Table, right: Table, left_keys: Sequence[str], right_keys: Sequence[str]) -> DataFrame:
    """One row: both sides' rows, whole and partial keys, distinct keys, coverage, cardinality and the size of the join."""
    d = joins.diagnostics(left, right, left_keys, right_keys)
    cover = lambda n: F.when(F.col(n) > 0, F.col("matched_keys") / F.col(n)).otherwise(0.0)
    return d.select(
        "left_rows", "left_incomplete", "left_distinct", "right_rows", "right_incomplete", "right_distinct", "matched_keys",
        cover("left_distinct").alias("left_coverage"), cover("right_distinct").alias("right_coverage"), "cardinality", F.col("total_result_rows").alias("joined_rows"),
    )


def status(facts: Mapping[str, object], declared: str = "candidate", expected: str | None = None, collisions: int = 0) -> tuple[str, list[str]]:
    """The status that the counts leave: a declared relationship without overlap, with another cardinality or with collisions is rejected."""
    if expected is not None and expected not in CARDINALITIES:
        raise QueryValidationError(f"expected cardinality is one of {list(CARDINALITIES)}")
    why = []
    if declared != "candidate" and not facts["matched_keys"]:
        why.append("no complete key value occurs on both sides")
    if expected is not None and facts["cardinality"] != expected:
        why.append(f"observed cardinality is {facts['cardinality']}, expected {expected}")
    if declared != "candidate" and collisions:
        why.append(f"{collisions} key(s) collide")
    return ("rejected", why) if why else (declared, why)


def status_column(declared: str, expected: str | None = None):  # noqa: ANN201 - a Column
    """``status`` over a row of ``assess``."""
    bad = F.lit(False)
    if declared != "candidate":
        bad = bad | (F.col("matched_keys") == 0)
    if expected:
        bad = bad | (F.col("cardinality") != expected)
    return F.when(bad, "rejected").otherwise(declared)


def examples(left: Table, right: Table, left_keys: Sequence[str], right_keys: Sequence[str], limit: int = EXAMPLES) -> DataFrame:
    """The first shared keys in order with their row counts on both sides and, where a side has a locator, its first rows."""
    names = [f"k{i}" for i in range(len(left_keys))]
    l, r = joins.key_counts(left, left_keys), joins.key_counts(right, right_keys)
    out = l.withColumnRenamed("n", "left_rows").join(r.withColumnRenamed("n", "right_rows"), names).orderBy(*names).limit(limit)
    for side, t, keys in (("left", left, left_keys), ("right", right, right_keys)):
        if t.locator:
            # Only the few shown keys are looked up; their rows are ranked, so no list is longer than EXAMPLES.
            rows = t.df.select(*[F.col(f"`{k}`").alias(n) for k, n in zip(keys, names, strict=True)], F.col(t.locator).alias("at")).join(out.select(*names), names, "left_semi")
            rank = F.row_number().over(Window.partitionBy(*names).orderBy("at"))
            lists = rows.withColumn("rank", rank).where(F.col("rank") <= EXAMPLES).groupBy(*names).agg(F.array_sort(F.collect_list("at")).alias(f"{side}_locators"))
            out = out.join(lists, names, "left")
    return out


def relationship_id(dataset: str, left: str, right: str, left_keys: Sequence[str], right_keys: Sequence[str], mapping: Mapping | None = None) -> str:
    """rel_ and the digest of the canonical description; equal descriptions get equal ids."""
    about = {"dataset_id": dataset, "left": {"table": left, "keys": list(left_keys)}, "right": {"table": right, "keys": list(right_keys)}}
    if mapping:
        about["mapping"] = dict(mapping)
    text = json.dumps(about, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    return "rel_" + hashlib.sha256(text.encode()).hexdigest()[:20]


# What a declaration may hold, and what it must.
OPTIONAL = frozenset({"status", "expected_cardinality", "crosswalk", "left_key_format", "right_key_format", "forms_per_canonical"})
REQUIRED = frozenset({"left", "right", "left_keys", "right_keys"})


def checked(d: Mapping, i: int) -> Mapping:
    """A declaration of the right shape, or an error that names it."""
    unknown = set(d) - OPTIONAL - REQUIRED
    lists = all(isinstance(d.get(k), list | tuple) and d.get(k) and all(isinstance(x, str) for x in d[k]) for k in ("left_keys", "right_keys"))
    if unknown or not REQUIRED <= set(d) or not lists:
        raise QueryValidationError(f"declaration {i} is malformed: {sorted(unknown) or 'tables or keys are missing'}")
    if d.get("status", "declared") not in ("declared", "deterministic"):
        raise QueryValidationError(f"declaration {i} has status {d['status']!r}; it is declared or deterministic")
    if d.get("expected_cardinality") is not None and d["expected_cardinality"] not in CARDINALITIES:
        raise QueryValidationError(f"declaration {i}: expected cardinality is one of {list(CARDINALITIES)}")
    if len(d["left_keys"]) != len(d["right_keys"]) and not (d.get("left_key_format") or d.get("right_key_format")):
        raise QueryValidationError(f"declaration {i}: both sides need as many keys, or a key format")
    return d


def mapping_of(d: Mapping) -> dict:
    """What makes the compared key of a declaration other than its columns."""
    return {k: d[k] for k in ("crosswalk", "left_key_format", "right_key_format", "forms_per_canonical") if d.get(k)}


def collisions(left: Table, right: Table, d: Mapping, crosswalk: DataFrame | None) -> int:
    """Keys that refuse a join of the declaration, as counted by ``identity``."""
    n = 0
    for name, t in (("left", left), ("right", right)):
        side = identity.resolve(t, d[f"{name}_keys"], d.get(f"{name}_key_format"), crosswalk)
        n += identity.rendering_collisions(side).count()
        if crosswalk is not None and name not in d.get("forms_per_canonical", ()):
            n += identity.crosswalk_collisions(side).count()
    return n


def build(spark: SparkSession, dataset: str, tables: Mapping[str, Table], declarations: Sequence[Mapping] = (), crosswalks: Mapping[str, identity.Crosswalk] | None = None, skipped: list[dict] | None = None) -> list[dict]:
    """Declared relationships first, then candidates with overlap; a candidate of a declared pair is left out. The number of
    relationships is that of table pairs, so the records are driver-side; all of them are assessed by one grouping of key values
    (``inclusion``). Only keys that a mapping makes are tested for collisions one by one."""
    sides, asked = dict(tables), []
    for i, d in enumerate(declarations):
        checked(d, i)
        left, right, mapping = tables[d["left"]], tables[d["right"]], mapping_of(d)
        walk = (crosswalks or {}).get(mapping.get("crosswalk"))
        rows = walk.rows(spark) if walk else None
        try:
            if mapping:
                compared = joins.resolved_sides(left, right, d["left_keys"], d["right_keys"], rows, d.get("left_key_format"), d.get("right_key_format"))
                probes = []
                for side, t in zip(("left", "right"), compared, strict=True):
                    sides[f"{side} of {i}"] = t
                    probes.append(inclusion.Probe(f"{side} of {i}", ("__space", "__key")))
            else:
                joins.checked_keys(left, right, d["left_keys"], d["right_keys"])
                probes = [inclusion.Probe(d["left"], tuple(d["left_keys"])), inclusion.Probe(d["right"], tuple(d["right_keys"]))]
        except QueryValidationError as e:
            if skipped is None:
                raise
            skipped.append({"declaration": dict(d), "reason": str(e)})
            continue
        asked.append((d, mapping, walk, tuple(probes)))
    named = [(*c, *(inclusion.Probe(t, (k,), cells) for cells in (False, True) for t, k in ((c[0], c[2]), (c[1], c[3])))) for c in name_pairs(tables)]
    unique = [p for c in named if c[4] not in SUBJECT_NAMES for p in c[7:]]
    facts, shared = inclusion.measure(sides, unique, [p for *_, p in asked] + [(c[5], c[6]) for c in named])
    out, seen = [], set()
    for d, mapping, walk, (a, b) in asked:
        about = inclusion.assessed(facts[a], facts[b], shared[a, b])
        bad = collisions(tables[d["left"]], tables[d["right"]], d, walk.rows(spark) if walk else None) if mapping else 0
        state, why = status(about, d.get("status", "declared"), d.get("expected_cardinality"), bad)
        rid = relationship_id(dataset, d["left"], d["right"], d["left_keys"], d["right_keys"], mapping | ({"crosswalk_sha256": walk.sha256} if walk else {}))
        seen.add(rid)
        out.append({"id": rid, "status": state, "rejection_reasons": why, "mapping": mapping, "crosswalk_sha256": walk.sha256 if walk else None, **{k: d[k] for k in ("left", "right", "left_keys", "right_keys")}, **about})
    for left, right, left_key, right_key, normal, a, b, *own in sorted(named, key=lambda c: (c[0], c[1], c[4])):
        rid = relationship_id(dataset, left, right, [left_key], [right_key])
        if rid in seen or not shared[a, b].keys or not (normal in SUBJECT_NAMES or any(facts[p].unique for p in own)):
            continue
        out.append({"id": rid, "status": "candidate", "rejection_reasons": [], "mapping": {}, "crosswalk_sha256": None, "left": left, "right": right, "left_keys": [left_key], "right_keys": [right_key], **inclusion.assessed(facts[a], facts[b], shared[a, b])})
    return out
