"""URL filter by host-suffix and path-prefix expressions, in DataFrame expressions only.

A URL is expanded into every host suffix (whole labels) joined to every path prefix whose length some rule has. Each
expression meets the rules in an equi-join on a short hash prefix; the full digest then confirms the hit, and the longest
rule gives the verdict. Rules are a table, so a block list may grow: the join is by key, and the planner broadcasts the
rules only while their measured size allows it.

Scale: the pages are scanned once for id and url. The number of expressions per URL is bounded by its labels times the
distinct prefix lengths of the rules (a small set, aggregated from the rules). Only expressions meet rules in the join; hits
and rows are combined per URL before the one shuffle that follows, so neither a hot rule nor pages without any gather in a task.

Defined cases: a null url, or one without ``://``, has an empty host and path and gets the default verdict; repeated rows
give as many result rows; an empty path fits no rule, since every rule's path begins with ``/``; an empty rule table
leaves every verdict at the default; extra columns are ignored; of equally long rules the smaller text wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The rules of the query (verdict, host, path).
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
#: Characters of the hex digest that the join compares.
SHORT = 8
DEFAULT = "allow"


def host_of(url: Column) -> Column:
    at = F.locate("://", url)
    rest = F.substring(url, at + 3, F.length(url))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    return F.when(at > 0, F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise(F.lit(""))


def path_of(url: Column) -> Column:
    at = F.locate("://", url)
    rest = F.substring(url, at + 3, F.length(url))
    return F.when(at > 0, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)).otherwise(F.lit(""))


def rule_table(spark: SparkSession, rules: tuple = RULES) -> DataFrame:
    """The rules as literal rows, whose size the planner knows."""
    quoted = ["(" + ", ".join("'" + str(x).replace("\\", "\\\\").replace("'", "\\'") + "'" for x in rule) + ")" for rule in rules]
    return spark.sql(f"select * from values {', '.join(quoted)} as t(verdict, host, path)")


def _keyed(rules: DataFrame) -> DataFrame:
    text = F.concat("host", "path")
    full = F.sha2(text, 256)
    return rules.select(F.substring(full, 1, SHORT).alias("short"), full.alias("full"), text.alias("rule"), F.col("verdict").alias("rule_verdict"))


def judge(pages: DataFrame, rules: DataFrame, default: str = DEFAULT) -> DataFrame:
    """page_id, host, path, rule (null if none fits) and verdict, one row per row of ``pages``."""
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    split = pages.select(F.col("page_id").cast("long").alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    lengths = [r["n"] for r in rules.select(F.length("path").alias("n")).distinct().collect()]  # bounded by the longest path a rule has
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = F.array(*[F.when(F.length("path") >= n, F.substring(F.col("path"), 1, n)) for n in sorted(lengths)]) if lengths else F.array().cast("array<string>")
    pairs = F.flatten(F.transform(suffixes, lambda s: F.transform(F.array_compact(prefixes), lambda p: F.concat(s, p))))
    rows = split.select("page_id", "host", "path", F.explode(pairs).alias("text"))
    rows = rows.withColumn("digest", F.sha2("text", 256)).withColumn("short", F.substring("digest", 1, SHORT))
    met = rows.join(_keyed(rules), "short").filter(F.col("full") == F.col("digest"))
    hits = met.select("page_id", "host", "path", F.lit(0).alias("times"), F.struct(F.length("rule").alias("n"), F.col("rule"), F.col("rule_verdict")).alias("best"))
    # Each row also stands for itself, outside the join: that counts repeated rows and keeps rows that no rule fits.
    own = split.select("page_id", "host", "path", F.lit(1).alias("times"), F.lit(None).cast(hits.schema["best"].dataType).alias("best"))
    per_page = hits.unionByName(own).groupBy("page_id", "host", "path").agg(F.sum("times").alias("times"), F.max("best").alias("best"))
    return per_page.withColumn("_", F.explode(F.expr("sequence(1L, times)"))).select(
        "page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.rule_verdict", F.lit(default)).alias("verdict")
    )
