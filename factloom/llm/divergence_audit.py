"""Divergence of sources within a language, by inclusion and exclusion over the supports of their term counts.

Every (language, source) group has a smoothed share for every kept term of its language, also for terms it never uses. A pair of
groups is compared over all kept terms, but most of them occur in one of the two or in neither. So the sum is taken apart:

* terms in neither group: one constant, times their number;
* terms in one group: priced from the group's histogram (how many terms occur how often), as the other side is constant there;
* terms in both: a join of the postings (term, group, count) corrects what the first two sums got wrong.

With z for "count zero", V kept terms and H the histogram without zero, a pair (s, t) has
``V f(z,z) + sum_c H_s(c) [f(c,z) - f(z,z)] + sum_c H_t(c) [f(z,c) - f(z,z)] + sum_both [f(a,b) - f(a,z) - f(z,b) + f(z,z)]``.
No step is as large as terms times pairs unless every group uses every term.

Counting combines twice before its one shuffle: inside a document in C, and inside a task in tables of a bounded number of entries and
bytes. That shuffle goes by (language, term), so a hot source is spread over all terms; the later sums by group combine first. The
join of postings goes by (language, term) too, its rows are summed by pair as they arise, and between written tables adaptive execution
splits a term that very many sources share. Top terms are cut to ten a task before they move.

All figures are integers; the one product that can leave 64 bits (10^9 times a count) is a decimal. Recovery: postings and groups are
written tables.

Defined cases: null text, language or source is the empty text; a group without terms has its own rows all the same; a language
without kept terms has V = 0 and pairs of value 0; repeated rows and repeated or null ids are documents of their own; equal values rank
by the item's UTF-8 bytes; an empty table gives no rows; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

#: A term is kept in a language where so many documents of the language hold it.
MIN_DOCS = 10
#: Ranks of the part ``term``.
TOP = 10
SCALE = 1_000_000_000
#: Entries and bytes of terms that a task counts before it passes its counts on.
HELD_TERMS, HELD_BYTES = 400_000, 1 << 25
#: Letters stay (A-Z become a-z), and so does every byte of a character beyond ASCII; all else ends a term.
LETTERS = bytes(c | 0x20 if 0x41 <= c <= 0x5A else c if 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))
#: Stands for the group itself among its terms, which are never empty.
GROUP = ""


def counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, text) in; (lang, source, term, occurrences, documents) of this task out, and a row for each group."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def out() -> Iterator[pa.RecordBatch]:
        for (lang, source), (uses, docs) in held.items():
            terms = list(uses)
            for k in range(0, len(terms), 1 << 16):
                part = terms[k : k + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.repeat(lang, len(part)), pa.repeat(source, len(part)), pa.array(part, pa.binary()).cast(pa.string()), pa.array([uses[t] for t in part], pa.int64()), pa.array([docs[t] for t in part], pa.int64())], names=["lang", "source", "term", "uses", "docs"])
        held.clear()

    for batch in batches:
        for k in range(0, batch.num_rows, 1024):
            piece = batch.slice(k, 1024)
            for lang, source, text in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist(), piece.column(2).cast(pa.binary()), strict=True):
                uses, docs = held.get((lang, source)) or held.setdefault((lang, source), (Counter({GROUP.encode(): 0}), Counter({GROUP.encode(): 0})))
                words = text.as_py().translate(LETTERS).split()
                uses.update(words)
                docs.update(set(words))
            if sum(len(u) for u, _ in held.values()) > HELD_TERMS or sum(sum(map(len, u)) for u, _ in held.values()) > HELD_BYTES:
                yield from out()
    yield from out()


def postings(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """Written: lang, term, source, uses, lang_uses, first (true for one source of each term); the row of the empty term stands for
    the group. One shuffle, by language and term."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    parts = docs.select(text("lang").alias("lang"), text("source").alias("source"), text("text").alias("text")).mapInArrow(counter, "lang string, source string, term string, uses long, docs long")
    sums = parts.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("uses").alias("uses"), F.sum("docs").alias("docs"))
    term = Window.partitionBy("lang", "term")
    whole = sums.withColumns({"lang_docs": F.sum("docs").over(term), "lang_uses": F.sum("uses").over(term), "least": F.min("source").over(term)})
    rows = whole.filter((F.col("lang_docs") >= min_docs) | (F.col("term") == GROUP))
    return common.materialise(rows.select("lang", "term", "source", "uses", "lang_uses", (F.col("source") == F.col("least")).alias("first")), "postings")


def share(uses: Column, total: Column, kept: Column) -> Column:
    """1 + floor(10^9 (uses + 2) / (total + 2 kept)), null where nothing is kept."""
    return F.when(kept > 0, 1 + F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * (uses + 2).cast("decimal(20,0)"), (total + 2 * kept).cast("decimal(20,0)")))


def apart(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)); both are at most 10^9 + 1, so squares stay within 64 bits."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def groups_of(rows: DataFrame) -> DataFrame:
    """Written: lang, source, total, kept, lang_total, zero (the share of a term that the group does not use)."""
    totals = rows.groupBy("lang", "source").agg(F.sum("uses").alias("total"))
    langs = rows.filter(F.col("first") & (F.col("term") != GROUP)).groupBy("lang").agg(F.count("*").alias("kept"), F.sum("lang_uses").alias("lang_total"))
    known = totals.join(langs, "lang", "left").fillna(0, ["kept", "lang_total"])
    return common.materialise(known.withColumn("zero", share(F.lit(0), F.col("total"), F.col("kept"))), "groups")


def pairs(priced: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value) for every ordered pair of sources of a language."""
    s = groups.select("lang", F.col("source").alias("a"), F.col("zero").alias("za"), "kept")
    t = groups.select("lang", F.col("source").alias("b"), F.col("zero").alias("zb"))
    each = common.materialise(s.join(t, "lang").filter("a != b"), "pairs")  # as many rows as the result has
    zz = apart(F.col("za"), F.col("zb"))
    one = priced.groupBy("lang", F.col("source").alias("a"), "p").agg(F.count("*").alias("terms"))
    single = each.join(one, ["lang", "a"]).groupBy("lang", "a", "b").agg(F.sum(F.col("terms") * (apart(F.col("p"), F.col("zb")) - zz)).alias("single"))
    left = priced.select("lang", "term", F.col("source").alias("a"), F.col("p").alias("pa"), F.col("zero").alias("za"))
    right = priced.select("lang", "term", F.col("source").alias("b"), F.col("p").alias("pb"), F.col("zero").alias("zb"))
    wrong = apart(F.col("pa"), F.col("pb")) - apart(F.col("pa"), F.col("zb")) - apart(F.col("za"), F.col("pb")) + zz
    both = left.join(right, ["lang", "term"]).filter("a < b").groupBy("lang", "a", "b").agg(F.sum(wrong).alias("both"))
    turned = single.select("lang", F.col("a").alias("b"), F.col("b").alias("a"), F.col("single").alias("other"))
    mirrored = both.unionAll(both.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "both"))
    parts = each.join(single, ["lang", "a", "b"], "left").join(turned, ["lang", "a", "b"], "left").join(mirrored, ["lang", "a", "b"], "left")
    value = sum((F.coalesce(F.col(c), F.lit(0)) for c in ("single", "other", "both")), F.coalesce(F.col("kept") * zz, F.lit(0)))
    return parts.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), value.cast("long").alias("value"))


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank: for every group all other sources of its language by divergence (``pair``), and the
    terms that set it apart most from its language (``term``)."""
    rows = postings(docs, min_docs)
    groups = groups_of(rows)
    priced = rows.filter((F.col("term") != GROUP) & (F.col("uses") > 0)).join(groups, ["lang", "source"])
    priced = common.materialise(priced.select("lang", "term", "source", "zero", share(F.col("uses"), F.col("total"), F.col("kept")).alias("p"), share(F.col("lang_uses"), F.col("lang_total"), F.col("kept")).alias("q")), "priced")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    terms = priced.filter("p > q").select("lang", "source", F.col("term").alias("item"), apart(F.col("p"), F.col("q")).alias("value"))
    ranked = [(part, found.withColumn("rank", F.row_number().over(order))) for part, found in (("pair", pairs(priced, groups)), ("term", terms))]
    ranked[1] = ("term", ranked[1][1].filter(F.col("rank") <= top))
    out = [found.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank") for part, found in ranked]
    return out[0].unionAll(out[1])
