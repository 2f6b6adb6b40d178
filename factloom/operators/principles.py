"""The fifteen FAIR principle items: what local rules tell about each, what evidence is still asked for, and what to do next.

A narrow local rule never decides a principle: a pass is a signal, a failure is a gap, and the verdict stays unknown until all
evidence is at hand. Nothing here uses the network.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession

from ..errors import QueryLookupError

# The items with the local rules that bear on them and the kinds of evidence that they ask for, in order.
ITEMS: dict[str, tuple[str, tuple[str, ...], tuple[str, ...]]] = {
    "F1": ("Is the dataset named by an identifier that is unique and lasts?", ("F1-PID-METADATA", "F1-PID-RESOLVABLE"), ("local", "external_document", "live_publication")),
    "F2": ("Do metadata describe the data richly?", ("F2-METADATA-PRESENT",), ("local", "local", "validator_report")),
    "F3": ("Do metadata name the data that they describe?", ("F3-METADATA-LINKS-DATA",), ("local", "local", "local")),
    "F4": ("Can a search service index the metadata?", ("F4-METADATA-MACHINE-READABLE",), ("external_document", "live_publication", "live_publication")),
    "A1": ("Can the data be had by their identifier over a standard protocol?", ("A1-RETRIEVAL-PROTOCOL",), ("local", "live_publication", "live_publication")),
    "A1.1": ("Is that protocol open and free to implement?", (), ("live_publication", "external_document", "external_document")),
    "A1.2": ("Can the protocol ask who is there, where that is needed?", (), ("reviewed_assertion", "external_document", "live_publication")),
    "A2": ("Do metadata outlast the data?", (), ("external_document", "live_publication", "live_publication")),
    "I1": ("Is knowledge written in a shared and formal language?", ("I1-DATA-FORMATS-OPEN",), ("external_document", "local", "validator_report")),
    "I2": ("Are the vocabularies in use FAIR themselves?", ("I2-VOCABULARY-REFERENCED",), ("local", "live_publication", "external_document", "validator_report")),
    "I3": ("Are references to other data qualified?", (), ("local", "local", "validator_report")),
    "R1": ("Are attributes many and accurate enough for reuse?", (), ("reviewed_assertion", "local", "reviewed_assertion")),
    "R1.1": ("Is a clear licence given?", ("R1.1-LICENCE-DECLARED",), ("live_publication", "local", "reviewed_assertion")),
    "R1.2": ("Is the origin of the data told?", ("R1.2-PROVENANCE-DECLARED",), ("local", "local", "local", "reviewed_assertion")),
    "R1.3": ("Do data follow the standards of their community?", ("R1.3-COMMUNITY-STANDARD", "R1.3-MISSING-VALUES-DECLARED"), ("reviewed_assertion", "validator_report", "reviewed_assertion")),
}
#: What mends the failure of each rule.
FIXES = {
    "F1-PID-METADATA": "write the identifier that was assigned to this dataset into a metadata field of its own",
    "F1-PID-RESOLVABLE": "resolve the identifier from outside and keep the answer as evidence",
    "F2-METADATA-PRESENT": "add a metadata file by a convention that is recognised, and ingest again",
    "F3-METADATA-LINKS-DATA": "name every data file in the metadata",
    "F4-METADATA-MACHINE-READABLE": "give the metadata in a structured format as well",
    "A1-RETRIEVAL-PROTOCOL": "retrieve the dataset by its identifier and keep the exchange as evidence",
    "I1-DATA-FORMATS-OPEN": "offer the data in an open format beside the present one",
    "I2-VOCABULARY-REFERENCED": "use terms of a vocabulary by their identifiers",
    "R1.1-LICENCE-DECLARED": "have the rights holder state a licence in the metadata",
    "R1.2-PROVENANCE-DECLARED": "state who made the data, and from what",
    "R1.3-COMMUNITY-STANDARD": "choose a standard of the field and follow it",
    "R1.3-MISSING-VALUES-DECLARED": "ask the owner what the tokens mean and declare the convention",
}


def principle(name: str) -> dict[str, object]:
    if name not in ITEMS:
        raise QueryLookupError(f"unknown principle {name!r}; available: {list(ITEMS)}")
    question, rules, evidence = ITEMS[name]
    return {"id": name, "question": question, "local_rules": list(rules), "evidence_plan": [{"requirement": i, "kind": k} for i, k in enumerate(evidence)]}


def assess(results: Mapping[str, str], names: Sequence[str] = tuple(ITEMS)) -> list[dict[str, object]]:
    """Per item: the results of its local rules, a verdict that stays unknown, and an action for every gap."""
    out = []
    for name in names:
        item = principle(name)
        local = {r: results[r] for r in item["local_rules"] if r in results}
        actions = [{"kind": "fix", "rule": r, "action": FIXES[r]} for r, v in local.items() if v in ("fail", "unknown")]
        actions += [{"kind": "evidence", "rule": None, "action": f"bring evidence of kind {e['kind']} for requirement {e['requirement']}"} for e in item["evidence_plan"] if e["kind"] != "local"]
        out.append({"principle": name, "verdict": "unknown", "local": local, "signals": sum(v == "pass" for v in local.values()), "gaps": sum(v == "fail" for v in local.values()), "actions": actions})
    return out


def table(spark: SparkSession, results: Mapping[str, str]) -> DataFrame:
    """(principle, verdict, signals, gaps, actions) as rows."""
    return spark.createDataFrame([(a["principle"], a["verdict"], a["signals"], a["gaps"], len(a["actions"])) for a in assess(results)], "principle string, verdict string, signals int, gaps int, actions int")


def recommendations(results: Mapping[str, str]) -> list[dict[str, str]]:
    """What to mend, failures before what is unknown, each in the order of the rules."""
    rank = {"fail": 0, "unknown": 1}
    return [{"rule": r, "result": results[r], "action": FIXES[r]} for r in sorted((r for r in FIXES if results.get(r) in rank), key=lambda r: (rank[results[r]], list(FIXES).index(r)))]


def publication_plan(results: Mapping[str, str]) -> list[dict[str, object]]:
    """Steps to a publication in order; a step is blocked while a rule it rests on has not passed."""
    needs = (
        ("describe", ("F2-METADATA-PRESENT", "F3-METADATA-LINKS-DATA", "R1.2-PROVENANCE-DECLARED")), ("license", ("R1.1-LICENCE-DECLARED",)),
        ("standardise", ("I1-DATA-FORMATS-OPEN", "R1.3-COMMUNITY-STANDARD", "R1.3-MISSING-VALUES-DECLARED")), ("identify", ("F1-PID-METADATA",)), ("deposit", ("F4-METADATA-MACHINE-READABLE",)), ("verify", ("F1-PID-RESOLVABLE", "A1-RETRIEVAL-PROTOCOL")),
    )
    return [{"step": s, "rests_on": list(r), "blocked_by": [x for x in r if results.get(x) not in ("pass", "not_applicable")]} for s, r in needs]
