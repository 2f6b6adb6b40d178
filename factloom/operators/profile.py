"""Column profiles by one full scan: kinds, missing values apart by cause, distinct values, free text, uniqueness, registries."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..convention import DEFAULT, Convention
from ..types import BOOLEAN, INTEGER, NUMBER, Table, is_number, missing_kind, strip

LISTED = 25
LONG_TEXT, PROSE_WORDS = 40, 4
# Column names that denote the individual a row is about.
SUBJECT_NAMES = frozenset(
    ["id", "ids", "animal", "animal_id", "animal_number", "subject", "subject_id", "participant", "participant_id", "mouse", "mouse_id", "rat", "rat_id", "individual", "individual_id", "specimen", "specimen_id", "donor", "donor_id", "sample", "sample_id"]
)


def normal_name(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), r"[^a-z0-9]+", "_"), r"^_+|_+$", "")


def long_form(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(position, name, token): every cell of the columns as text, by one scan and no shuffle."""
    columns = list(columns or df.columns)
    cells = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(c).alias("name"), F.col(f"`{c}`").cast("string").alias("token")) for i, c in enumerate(columns)])
    return df.select(F.explode(cells).alias("cell")).select("cell.*")


def token_counts(df: DataFrame, columns: Sequence[str] | None = None, convention: Convention = DEFAULT) -> DataFrame:
    """(position, name, value, kind, n): how often each stripped token occurs. Counts combine before the shuffle."""
    cells = long_form(df, columns)
    return cells.groupBy("position", "name", strip(F.col("token")).alias("value"), missing_kind(F.col("token"), convention).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def word_count(value: Column) -> Column:
    """Words of at least two letters."""
    return F.size(F.filter(F.split(value, r"(?U)\s+"), lambda t: F.length(F.regexp_replace(t, r"[^\p{L}]", "")) >= 2))


def dtype_of(all_whole: Column, all_number: Column, all_boolean: Column, values: Column) -> Column:
    return F.when(values == 0, "empty").when(all_whole, "integer").when(all_number, "number").when(all_boolean, "boolean").otherwise("string")


def profile(df: DataFrame, columns: Sequence[str] | None = None, convention: Convention = DEFAULT) -> DataFrame:
    """One row per column: rows, values, missing by cause, dtype, exact distinct count and the free-text rule's facts."""
    counts = token_counts(df, columns, convention)
    value = F.col("kind").isin("value", "ambiguous")
    n = F.col("n")
    total = lambda test: F.coalesce(F.sum(F.when(test, n)), F.lit(0)).cast("long")
    every = lambda rx: F.coalesce(F.bool_and(F.when(value, F.col("value").rlike(rx))), F.lit(True))
    words = word_count(F.col("value"))
    prose = F.coalesce(F.bool_or(F.when(value, (words >= PROSE_WORDS) | (F.length("value") > LONG_TEXT))), F.lit(False))
    rare = F.coalesce(F.bool_or(F.when(value, (words >= 2) & (n == 1))), F.lit(False))
    out = counts.groupBy("position", "name").agg(
        F.sum("n").cast("long").alias("rows"), total(value).alias("n_values"),
        total(F.col("kind") == "empty").alias("missing_empty"), total(F.col("kind") == "sentinel").alias("missing_sentinel"), total(F.col("kind") == "ambiguous").alias("ambiguous"),
        F.count_if(value).alias("n_distinct"),
        dtype_of(every(INTEGER), every(NUMBER), every(BOOLEAN), total(value)).alias("dtype"), prose.alias("prose"), rare.alias("unrepeated"),
    )
    out = out.withColumn("missing", F.col("missing_empty") + F.col("missing_sentinel"))
    text = (F.col("dtype") == "string") & (F.col("n_distinct") <= LISTED)
    withheld = F.when(text & F.col("prose"), "prose").when(text & F.col("unrepeated"), "unrepeated-words")
    subject = normal_name(F.col("name")).isin(*sorted(SUBJECT_NAMES))
    unique = F.when(subject, F.col("n_distinct") == F.col("n_values"))
    return out.withColumn("withheld", withheld).withColumn("subject_name", subject).withColumn("unique", unique).drop("prose", "unrepeated")


def facts(df: DataFrame, columns: Sequence[str] | None = None, convention: Convention = DEFAULT) -> DataFrame:
    """(position, name, rows, n_values, missing_empty, missing_sentinel, ambiguous, missing, dtype) in one wide aggregate: a
    single scan, nothing exploded, and one row of partial counts per task."""
    columns = list(columns or df.columns)
    out, cells = [], []
    for i, c in enumerate(columns):
        token = F.col(f"`{c}`").cast("string")
        # Stripped and classified once a cell; every count below reads the two.
        cells += [strip(token).alias(f"bare{i}"), missing_kind(token, convention).alias(f"kind{i}")]
        kind, bare = F.col(f"kind{i}"), F.col(f"bare{i}")
        value = kind.isin("value", "ambiguous")
        every = lambda rx, bare=bare, value=value: F.coalesce(F.bool_and(F.when(value, bare.rlike(rx))), F.lit(True))
        n = F.count_if(value)
        out.append(F.struct(
            F.lit(i).alias("position"), F.lit(c).alias("name"), F.count(F.lit(1)).alias("rows"), n.alias("n_values"), F.count_if(kind == "empty").alias("missing_empty"),
            F.count_if(kind == "sentinel").alias("missing_sentinel"), F.count_if(kind == "ambiguous").alias("ambiguous"), dtype_of(every(INTEGER), every(NUMBER), every(BOOLEAN), n).alias("dtype"),
        ))
    wide = df.select(*cells).agg(F.array(*out).alias("facts")).select(F.explode("facts").alias("f")).select("f.*")
    return wide.withColumn("missing", F.col("missing_empty") + F.col("missing_sentinel"))


def bounded_values(df: DataFrame, columns: Sequence[str], convention: Convention = DEFAULT, listed: int = LISTED) -> DataFrame:
    """(position, name, value, n, over): values with their counts for columns of few values, by one pass. A task gives up on a
    column as soon as it has seen more than ``listed`` values and says so by ``over``, so high-cardinality columns never move."""
    bare = [F.when(missing_kind(F.col(f"`{c}`").cast("string"), convention).isin("value", "ambiguous"), strip(F.col(f"`{c}`").cast("string"))).alias(f"c{i}") for i, c in enumerate(columns)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict | None] = [{} for _ in columns]
        for batch in batches:
            for i, seen in enumerate(held):
                if seen is None:
                    continue
                for x in pc.value_counts(batch.column(i).drop_null()).to_pylist():
                    seen[x["values"]] = seen.get(x["values"], 0) + x["counts"]
                    if len(seen) > listed:
                        held[i] = None
                        break
        rows = [(i, v, n, False) for i, seen in enumerate(held) if seen is not None for v, n in seen.items()] + [(i, None, 0, True) for i, seen in enumerate(held) if seen is None]
        kinds = (pa.int32(), pa.string(), pa.int64(), pa.bool_())
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["position", "value", "n", "over"])

    few = df.select(*bare).mapInArrow(run, "position int, value string, n long, over boolean").groupBy("position", "value").agg(F.sum("n").alias("n"), F.bool_or("over").alias("over"))
    names = F.array(*[F.lit(c) for c in columns])
    return few.withColumn("name", F.get(names, F.col("position")))


def distinct_values(df: DataFrame, columns: Sequence[str] | None = None, convention: Convention = DEFAULT) -> DataFrame:
    """(name, value, n) for columns with at most ``LISTED`` distinct values whose list the free-text rule does not withhold.

    The rule applies to text only; what a column of few values holds is decided on those values."""
    few = bounded_values(df, list(columns or df.columns), convention)
    by = Window.partitionBy("position")  # at most LISTED rows a task and column
    words, every = word_count(F.col("value")), lambda rx: F.bool_and(F.col("value").rlike(rx)).over(by)
    text = ~(every(INTEGER) | every(NUMBER) | every(BOOLEAN))
    withheld = F.bool_or((words >= PROSE_WORDS) | (F.length("value") > LONG_TEXT)).over(by) | F.bool_or((words >= 2) & (F.col("n") == 1)).over(by)
    kept = few.select("name", "value", "n", (F.bool_or("over").over(by) | (F.count("value").over(by) > LISTED) | (text & withheld)).alias("no"))
    return kept.where("not no").select("name", "value", "n")


def token_maps(df: DataFrame, columns: Sequence[str] | None = None, convention: Convention = DEFAULT) -> DataFrame:
    """(name, kind, token, n): the tokens that read as absence, sentinel or ambiguous, and how often. Their number is that of the
    convention's tokens, whatever the table's size."""
    cells = token_counts(df, columns, convention).where(F.col("kind").isin("sentinel", "ambiguous"))
    return cells.groupBy("name", "kind", F.col("value").alias("token")).agg(F.sum("n").alias("n"))


def distinct_bound(table: Table, column: str, listed: int = LISTED) -> DataFrame:
    """(exact, bound): the distinct count, or above the list's length the bound that one pass in row order would give:
    the list's length and one, and every cell after the value that overran the list."""
    cells = table.df.select(F.col(table.locator).alias("at"), strip(F.col(f"`{column}`").cast("string")).alias("v")).where(missing_kind(F.col("v")).isin("value", "ambiguous"))
    firsts = cells.groupBy("v").agg(F.min("at").alias("at")).orderBy("at").limit(listed + 1)
    edge = firsts.agg(F.max("at").alias("edge"), F.count(F.lit(1)).alias("k"))
    after = cells.join(edge, how="cross").agg(F.count_if(F.col("at") > F.col("edge")).alias("after"), F.first("k").alias("k"))
    return after.select((F.col("k") <= listed).alias("exact"), F.when(F.col("k") <= listed, F.col("k")).otherwise(listed + 1 + F.col("after")).alias("bound"))


def is_registry(profiled: DataFrame) -> DataFrame:
    """One row: whether the profiled table reads as a registry of subjects, by counts alone."""
    subject = F.col("subject_name")
    other = ~subject
    return profiled.agg(
        (
            (F.max("rows") >= 4) & (F.count_if(subject) == 1) & (F.count_if(subject & F.col("unique") & (F.col("missing") == 0)) == 1)
            & F.coalesce(F.bool_and(F.when(other, F.col("n_distinct") * 2 <= F.col("rows"))), F.lit(False)) & (F.count_if(other & (F.col("n_distinct") >= 2)) >= 1)
        ).alias("registry")
    )


def describe(table: Table, column: str) -> DataFrame:
    """One row: rows, present, missing and, for numbers, least, greatest and mean."""
    table.require(column)
    c = F.col(f"`{column}`")
    out = [F.count(F.lit(1)).alias("count"), F.count(c).alias("non_missing"), F.count_if(c.isNull()).alias("n_missing")]
    if is_number(table.kinds[column]):
        out += [F.min(c).cast("double").alias("min"), F.max(c).cast("double").alias("max"), (table.exact_sum(column) / F.count(c)).alias("mean")]
    return table.df.agg(*out)
