"""Persistent identifiers in texts: scanning line by line, and validation of single values."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..types import strip

# The form of each scheme, without anchors.
SCHEMES = {
    "doi": r"10\.\d{4,9}/[-._;()/:A-Za-z0-9]+",
    "orcid": r"\d{4}-\d{4}-\d{4}-\d{3}[\dX]",
    "rrid": r"RRID:\s*[A-Za-z_]+:[A-Za-z0-9_.\-]+",
    "ror": r"https?://ror\.org/0[0-9a-hjkmnp-tv-z]{6}\d{2}",
    "uri": r"""https?://[^\s"'<>)\]]+""",
}


def scan(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, scheme, value, line): each identifier of a document once, at its first line. One pass, one shuffle of hits only."""
    lines = docs.select(F.col(key), F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), r"\r\n|\n|\r")).alias("at", "row"))
    likely = lines.where(F.col("row").rlike(r"10\.\d{4}|\d{4}-\d{4}-|RRID:|https?://"))

    def of(scheme: str, rx: str) -> Column:
        whole = F.regexp_extract_all("row", F.lit(r"\b" + rx + ("" if scheme == "uri" else r"\b")), F.lit(0))
        return F.transform(whole, lambda v: F.struct(F.lit(scheme).alias("scheme"), F.rtrim(v, F.lit(".,;")).alias("value")))

    hits = F.concat(*[of(s, rx) for s, rx in SCHEMES.items()])
    found = likely.select(key, (F.col("at") + 1).cast("long").alias("line"), F.explode(hits).alias("hit")).select(key, "hit.scheme", "hit.value", "line")
    specific = F.col("value").contains("doi.org/") | F.col("value").startswith("https://ror.org/")
    return found.where(~((F.col("scheme") == "uri") & specific)).groupBy(key, "scheme", "value").agg(F.min("line").alias("line"))


def orcid_valid(c: Column) -> Column:
    """The ISO 7064 mod 11-2 check digit, as a flat sum: a lambda would be interpreted digit by digit."""
    digits = F.replace(c, F.lit("-"))
    total = functools.reduce(operator.add, [F.substring(digits, i, 1).cast("int") * pow(2, 16 - i, 11) for i in range(1, 16)])
    want = (12 - total % 11) % 11
    return F.when(want == 10, F.lit("X")).otherwise(want.cast("string")) == F.upper(F.substring(digits, 16, 1))


def validate(values: DataFrame, column: str) -> DataFrame:
    """(value, schemes, valid): the schemes a value has the form of, the bare URI giving way, and an ORCID's check digit."""
    v = strip(F.col(column))
    is_scheme = {s: v.rlike(f"^{rx}$") for s, rx in SCHEMES.items()}
    other = is_scheme["doi"] | is_scheme["orcid"] | is_scheme["rrid"] | is_scheme["ror"]
    named = F.concat_ws(",", *[F.when(t & (~other if s == "uri" else F.lit(True)), F.lit(s)) for s, t in is_scheme.items()])
    valid = F.when(is_scheme["orcid"], orcid_valid(v)).otherwise(named != "")
    return values.select(v.alias("value"), named.alias("schemes"), valid.alias("valid"))


def resolve(found: DataFrame, value: str, crosswalk: DataFrame | None = None) -> DataFrame:
    """(where, kind, value): where an identifier occurs, in any case, and the crosswalk's canonical id or forms that are exactly it."""
    asked = value.strip()
    out = found.where(F.lower("value") == asked.lower()).select(F.col("source").cast("string").alias("where"), F.lit("occurrence").alias("kind"), "value")
    if crosswalk is not None:
        form = crosswalk.where(F.col("form") == asked).select(F.col("canonical_id").alias("where"), F.lit("form").alias("kind"), F.col("form").alias("value"))
        own = crosswalk.where(F.col("canonical_id") == asked).select(F.col("form").alias("where"), F.lit("canonical").alias("kind"), F.col("canonical_id").alias("value"))
        out = out.unionByName(form).unionByName(own)
    return out
