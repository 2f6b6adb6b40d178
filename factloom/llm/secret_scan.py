"""Secret scan by corpus-wide ownership frequency, in DataFrame expressions only.

Every document is scanned for three fixed kinds of secret and for one wider kind of candidate (a long token that mixes
letters and digits). The hash of every candidate value is counted over the whole corpus by distinct repositories and
distinct owners: values copied by many owners, or by few over many repositories, are examples; others look live. Owner-specific
wider candidates join the fixed spans; widely copied ones do not.

Scale: the corpus is scanned once and leaves only hashes and offsets. Counting runs in three aggregations of falling
grain (hash+owner+repository, hash+owner, hash), each combined before its shuffle, so a value that a third of the corpus
holds sends one row per task. The join back to occurrences is a plain equi-join of two written tables, so adaptive
execution splits a hot hash. Redaction moves no text but those with wide candidates.

Defined cases: null text is empty (no spans, digest of the empty string); a null owner or repository counts as the empty
one; repeated rows each keep their own result row; an empty table gives an empty result; extra columns are ignored by
``digest`` and kept by ``redact``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

# The kinds in the order that breaks ties, with the group that holds the value and its least length.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: The last two match whole runs, so a bound inside the pattern finds what a run of any length and a test of its length find.
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
KINDS = (("assign", ASSIGN, 2, 8), ("access", ACCESS, 0, 16), ("hex", HEX, 0, 32))
#: The wider candidates: runs of 20 and more token characters; letters in both cases and a digit are asked for.
WIDE = ("live", r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}", 0, 20)
#: From so many distinct owners on, a value counts as widely copied.
MAX_OWNERS = 3
#: From so many distinct repositories on it does too, even where one owner keeps them all.
MAX_REPOS = 6
#: Items that one fold goes over.
TOGETHER = 256

_SPAN = "array<struct<start:int,kind:int,end:int,hash:binary>>"


def _along(items: Column, kind: str, step: Callable[[Column, Column], tuple[Column, Column]], finish: Callable[[Column, Column], Column]) -> Column:
    """``step`` takes a position and an item and gives the next position and an array of outputs; ``finish`` gets the last position
    and all outputs. Folds of ``TOGETHER`` items each, and a fold over those: an array that grows by one at a time would be copied as
    often as it has elements."""
    state = lambda at, out: F.struct(at.alias("at"), out.alias("out"))

    def inner(s: Column, x: Column) -> Column:
        at, made = step(s["at"], x)
        return state(at, F.concat(s["out"], made))

    def outer(s: Column, part: Column) -> Column:
        return F.aggregate(part, state(s["at"], F.array().cast(kind)), inner, lambda r: state(r["at"], F.concat(s["out"], F.array(r["out"]))))

    parts = F.transform(F.sequence(F.lit(0), F.greatest(F.floor((F.size(items) - 1) / TOGETHER).cast("int"), F.lit(0))), lambda k: F.slice(items, k * TOGETHER + 1, TOGETHER))
    return F.aggregate(parts, state(F.lit(0), F.array().cast(f"array<{kind}>")), outer, lambda s: finish(s["at"], F.flatten(s["out"])))


def _spans(text: Column, order: int, pattern: str, group: int, least: int) -> Column:
    """All leftmost non-overlapping matches whose value is long enough, as (start, kind, end, hash of the value).

    The pieces between matches and the matches alternate, so running lengths give every offset in code points.
    """
    rx = F.lit(pattern)
    whole, value = F.regexp_extract_all(text, rx, F.lit(0)), F.regexp_extract_all(text, rx, F.lit(group))
    cut = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), whole.alias("hit"), value.alias("value"))

    def step(at: Column, x: Column) -> tuple[Column, Column]:
        start = at + F.length(x["gap"])
        end = start + F.coalesce(F.length(x["hit"]), F.lit(0))
        span = F.struct(start.alias("start"), F.lit(order).alias("kind"), end.alias("end"), F.unhex(F.sha2(x["value"], 256)).alias("hash"))
        keep = x["hit"].isNotNull() & (F.length(x["value"]) >= least)
        return end, F.when(keep, F.array(span).cast(_SPAN)).otherwise(F.array().cast(_SPAN))

    return F.when(text.rlike(pattern), _along(cut, _SPAN, step, lambda at, out: out)).otherwise(F.array().cast(_SPAN))


def _wide(text: Column, base: Column) -> Column:
    """Wider candidates that mix cases and digits and touch no base span."""
    name, pattern, group, least = WIDE
    mixed = r"^(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])"
    found = _spans(text, len(KINDS), pattern, group, least)
    piece = lambda s: F.substring(text, s["start"] + 1, s["end"] - s["start"])
    free = lambda s: ~F.exists(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    return F.when(F.size(found) > 0, F.filter(found, lambda s: piece(s).rlike(mixed) & free(s))).otherwise(found)


def held_by(docs: DataFrame, repo: str, owner: str, sub_repo: str | None) -> tuple[Column, Column]:
    """Owner and repository of a document; columns that are absent count as empty."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    own = blank(owner) if owner in docs.columns else F.lit("")
    return own, F.concat_ws("/", *[blank(c) for c in (repo, sub_repo) if c and c in docs.columns])


def found_in(text: Column) -> Column:
    """All base spans of a text in order, kinds as they break ties."""
    return F.array_sort(F.concat(*[_spans(text, i, p, g, n) for i, (_, p, g, n) in enumerate(KINDS)]))


def candidates(docs: DataFrame, repo: str = "source", owner: str = "source", sub_repo: str | None = "lang") -> DataFrame:
    """One row per document: row, doc_id, owner, repo, base and wide spans with value hashes. Texts are left behind."""
    own, rep = held_by(docs, repo, owner, sub_repo)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), own.alias("owner"), rep.alias("repo"), common.text_of().alias("text"))
    rows = rows.withColumn("base", found_in(F.col("text"))).withColumn("wide", _wide(F.col("text"), F.col("base"))).drop("text")
    return rows.withColumn("row", F.monotonically_increasing_id())


def ownership(occurrences: DataFrame) -> DataFrame:
    """Per value hash: distinct repositories, distinct owners, occurrences; from rows (hash, owner, repo)."""
    return (
        occurrences.groupBy("hash", "owner", "repo").agg(F.count(F.lit(1)).alias("n"))
        .groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("repos"), F.sum("n").alias("n"))
        .groupBy("hash").agg(F.sum("repos").alias("repos"), F.count(F.lit(1)).alias("owners"), F.sum("n").alias("n"))
    )


def looks_live(max_owners: int, max_repos: int) -> Column:
    """Whether a value of ``ownership`` is specific to its owner: few owners hold it, and it is not spread over many repositories."""
    return (F.col("owners") < max_owners) & (F.col("repos") < max_repos)


def scan(docs: DataFrame, repo: str = "source", owner: str = "source", sub_repo: str | None = "lang", max_owners: int = MAX_OWNERS, max_repos: int = MAX_REPOS) -> DataFrame:
    """One row per document with its base spans, its owner-specific wider spans, and how many values look live or copied."""
    rows = common.materialise(candidates(docs, repo, owner, sub_repo), "secrets")
    occurrences = rows.select("row", "owner", "repo", F.explode(F.concat("base", "wide")).alias("s")).select("row", "owner", "repo", "s.*")
    counts = common.materialise(ownership(occurrences), "owners")
    placed = occurrences.select("row", "start", "kind", "end", "hash").join(counts, "hash")
    live = looks_live(max_owners, max_repos)
    wide = live & (F.col("kind") == len(KINDS))
    judged = placed.groupBy("row").agg(
        F.sort_array(F.collect_list(F.when(wide, F.struct("start", "kind", "end")))).alias("added"),
        F.count_if(live).alias("n_live"), F.count_if(~live).alias("n_copied"), F.max("owners").alias("most_owners"),
    )
    bare = F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    out = rows.select("row", "doc_id", bare.alias("base")).join(judged, "row", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    return out.select(
        "doc_id", "base", F.array_sort(F.concat("base", F.coalesce("added", none))).alias("all_spans"),
        zero("n_live").alias("n_live"), zero("n_copied").alias("n_copied"), zero("most_owners").alias("most_owners"),
    )


def written(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    names = F.array(*[F.lit(k) for k, *_ in (*KINDS, WIDE)])
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])))


def digest(docs: DataFrame) -> DataFrame:
    """The query's result: counts by kind, the digest of the base spans, and all spans."""
    n = lambda i: F.size(F.filter("base", lambda s: s["kind"] == i)).cast("long")
    return scan(docs).select(
        "doc_id", *[n(i).alias(f"n_{k}") for i, (k, *_) in enumerate(KINDS)], F.sha2(written(F.col("base")), 256).alias("base_sha256"),
        written(F.col("all_spans")).alias("spans"), "n_live", "n_copied",
    )


def _cut(text: Column, spans: Column, mark: str) -> Column:
    """The text with each span replaced; of overlapping spans the part that the earlier one left over goes too."""

    def step(at: Column, s: Column) -> tuple[Column, Column]:
        gap = F.substring(text, at + 1, F.greatest(s["start"] - at, F.lit(0)))
        return F.greatest(at, s["end"]), F.when(s["start"] >= at, F.array(gap, F.lit(mark))).otherwise(F.array().cast("array<string>"))

    return F.when(F.size(spans) == 0, text).otherwise(_along(spans, "array<string>", step, lambda at, out: F.concat(F.array_join(out, ""), F.substring(text, at + 1, F.length(text)))))


def redact(docs: DataFrame, mark: str = "<SECRET>", repo: str = "source", owner: str = "source", sub_repo: str | None = "lang", max_owners: int = MAX_OWNERS, max_repos: int = MAX_REPOS) -> DataFrame:
    """The documents with every span of ``scan`` replaced by ``mark``; columns and clean documents pass unchanged.

    Spans are written beside their document, under a row number of that table. Base spans are cut where they stand; only
    documents with wide candidates move, to meet the counts of their values by row number.
    """
    about = common.fresh(docs.columns)
    own, rep = held_by(docs, repo, owner, sub_repo)
    text = common.text_of()
    found = docs.withColumn(about, F.struct(own.alias("owner"), rep.alias("repo"), found_in(text).alias("base")))
    found = found.withColumn(about, F.struct(F.col(f"{about}.*"), _wide(text, F.col(f"{about}.base")).alias("wide"), F.monotonically_increasing_id().alias("row")))
    found = common.materialise(found, "marked")
    values = found.select(F.col(f"{about}.*"))
    counts = common.materialise(ownership(values.select("owner", "repo", F.explode(F.concat("base", "wide")).alias("s")).select(F.col("s.hash").alias("hash"), "owner", "repo")).select("hash", "owners", "repos"), "owners")
    wide = values.filter(F.size("wide") > 0).select("row", F.explode("wide").alias("s")).select("row", "s", F.col("s.hash").alias("hash"))
    added = wide.join(counts.filter(looks_live(max_owners, max_repos)), "hash").groupBy("row").agg(F.collect_list("s").alias("added"))
    base = F.col(f"{about}.base")
    shown = lambda spans: [_cut(F.col("text"), spans, mark).alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns]
    plain = found.filter(F.size(f"{about}.wide") == 0).select(*shown(base))
    row = common.fresh([*docs.columns, about])
    more = common.fresh([*docs.columns, about, row])
    moved = found.filter(F.size(f"{about}.wide") > 0).withColumn(row, F.col(f"{about}.row")).join(added.toDF(row, more), row, "left")
    moved = moved.select(*shown(F.array_sort(F.concat(base, F.coalesce(F.col(more), F.array().cast(_SPAN))))))
    return plain.unionByName(moved)
