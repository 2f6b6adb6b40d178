"""Rule checks over the catalogue of a dataset: each gives pass, fail, unknown or not_applicable, with a reason."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RESULTS = ("pass", "fail", "unknown", "not_applicable")
# Formats that count as open and as closed; any other format is unclassified.
OPEN_FORMATS = frozenset(["csv", "tsv", "json", "jsonld", "xml", "yaml", "turtle", "ntriples", "rdfxml", "markdown", "text", "png", "jpeg", "tiff", "pdf", "zip", "gzip", "parquet", "hdf5", "nwb", "nifti", "edf", "sqlite", "ods", "boris"])
CLOSED_FORMATS = frozenset(["matlab", "xlsx", "xls", "xlsb"])


def format_openness(files: DataFrame) -> DataFrame:
    """One row (result, detail) over (path, format, role): closed formats fail, unclassified ones leave it unknown."""
    data = files.where("role = 'data'")
    closed, open_ = F.col("format").isin(*sorted(CLOSED_FORMATS)), F.col("format").isin(*sorted(OPEN_FORMATS))
    facts = data.agg(F.count(F.lit(1)).alias("n"), F.count_if(closed).alias("closed"), F.count_if(~closed & ~open_).alias("other"), F.array_join(F.array_sort(F.collect_set(F.when(~open_, F.col("format")))), ",").alias("detail"))
    return facts.select(F.when(F.col("n") == 0, "not_applicable").when(F.col("closed") > 0, "fail").when(F.col("other") > 0, "unknown").otherwise("pass").alias("result"), "detail")


def missing_values_declared(profiles: DataFrame, declared: bool) -> DataFrame:
    """One row over column profiles: tokens that read like absence ask for a declared convention."""
    tokens = F.coalesce(F.sum(F.col("missing_sentinel") + F.col("ambiguous")), F.lit(0))
    state = F.when(F.count(F.lit(1)) == 0, "not_applicable").when(tokens == 0, "not_applicable").when(F.lit(declared), "pass").otherwise("fail")
    return profiles.agg(state.alias("result"), tokens.cast("long").alias("tokens"))


def declared_keys(document: object, names: frozenset[str]) -> list[tuple[str, object]]:
    """Every (path, value) in a JSON document whose key is one of the names and whose value says something."""
    out: list[tuple[str, object]] = []

    def says(v: object) -> bool:
        return any(says(x) for x in (v.values() if isinstance(v, dict) else v)) if isinstance(v, dict | list) else bool(str(v).strip()) and v is not None and str(v).strip().lower() not in {"none", "null", "n/a", "na", "unknown", "tbd", "todo"}

    def walk(node: object, at: str) -> None:
        if isinstance(node, dict):
            for k, v in node.items():
                if k.lower() in names and says(v):
                    out.append((f"{at}/{k}", v))
                walk(v, f"{at}/{k}")
        elif isinstance(node, list):
            for i, v in enumerate(node):
                walk(v, f"{at}/{i}")

    walk(document, "")
    return out


def run(spark: SparkSession, rules: Sequence[tuple[str, Callable[[], tuple[str, str]] | None]]) -> DataFrame:
    """(rule, result, rationale): a rule without a check stays unknown and in the denominator; other results are refused."""
    rows = []
    for name, check in rules:
        result, why = check() if check else ("unknown", "no check is implemented for this rule")
        if result not in RESULTS:
            raise ValueError(f"rule {name!r} gave {result!r}")
        if result != "pass" and not why:
            raise ValueError(f"rule {name!r} gave {result!r} without a reason")
        rows.append((name, result, why))
    return spark.createDataFrame(rows, "rule string, result string, rationale string")


def summary(results: DataFrame) -> DataFrame:
    return results.groupBy("result").agg(F.count(F.lit(1)).alias("n"))


def agreement(gold: DataFrame, verdicts: DataFrame, key: str = "rule") -> DataFrame:
    """One row: rules judged by both, agreeing, and verdicts that claim more than an unknown gold allows."""
    both = gold.select(key, F.col("result").alias("want")).join(verdicts.select(key, F.col("result").alias("got")), key, "left")
    return both.agg(F.count(F.lit(1)).alias("rules"), F.count("got").alias("judged"), F.count_if(F.col("want") == F.col("got")).alias("agree"), F.count_if((F.col("want") == "unknown") & F.col("got").isin("pass", "fail")).alias("overclaimed"))
