"""Event logs to intervals by toggle pairing."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


#: Keys of more rows are cut into blocks of time, by so many cuts.
LONG_ROWS, CUTS = 1 << 17, 255


def ethogram(definitions: DataFrame, within: Sequence[str] = ()) -> DataFrame:
    """(within, code, type, category, conflict): definitions that contradict each other leave the code untyped. ``within`` keeps projects
    apart, whose definitions say nothing of each other's codes."""
    packed = F.struct(F.col("type"), F.col("category"))
    kinds = definitions.groupBy(*within, "code").agg(F.count_distinct(packed).alias("kinds"), F.max(packed).alias("one"))
    return kinds.select(*within, "code", F.when(F.col("kinds") == 1, F.col("one.type")).alias("type"), F.when(F.col("kinds") == 1, F.col("one.category")).alias("category"), (F.col("kinds") > 1).alias("conflict"))


def ranked(events: DataFrame, keys: Sequence[str], time: str, index: str) -> DataFrame:
    """Events with ``__rank`` in their key's order and the next event's ``__stop`` and ``__stop_index``. One shuffle by key."""
    order = Window.partitionBy(*keys).orderBy(time, index)
    return events.withColumn("__rank", F.row_number().over(order)).withColumn("__stop", F.lead(F.col(time)).over(order)).withColumn("__stop_index", F.lead(F.col(index)).over(order))


def ranked_in_blocks(events: DataFrame, keys: Sequence[str], time: str, index: str, long_keys: DataFrame, cuts: Sequence[float]) -> DataFrame:
    """The same, where long keys are cut into blocks of time that lie in many tasks. A block tells its number of events and its first one;
    sums of the numbers before a block say where ranks begin in it, and only its last event looks into the next block."""
    same = lambda a, b, names: reduce(lambda p, q: p & q, (a[x].eqNullSafe(b[y]) for x, y in names))
    longs = long_keys.select(*[F.col(f"`{k}`").alias(f"__k{i}") for i, k in enumerate(keys)], F.lit(True).alias("__long"))
    met = events.join(longs, same(events, longs, [(k, f"__k{i}") for i, k in enumerate(keys)]), "left")
    before = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < F.col(time)))  # null times come first
    rows = met.withColumn("__block", F.when(F.col("__long") & F.col(time).isNotNull(), before + 1).otherwise(0)).drop("__long", *longs.columns)
    inside = ranked(rows, [*keys, "__block"], time, index)
    blocks = rows.groupBy(*keys, "__block").agg(F.count(F.lit(1)).alias("__n"), F.min(F.struct(F.col(time).alias("t"), F.col(index).alias("i"))).alias("__first"))
    order = Window.partitionBy(*keys).orderBy("__block")
    edges = blocks.withColumn("__before", F.coalesce(F.sum("__n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("__next", F.lead("__first").over(order))
    edges = edges.select(*[F.col(f"`{k}`").alias(f"__k{i}") for i, k in enumerate(keys)], F.col("__block").alias("__b"), "__n", "__before", "__next")
    out = inside.join(edges, same(inside, edges, [*((k, f"__k{i}") for i, k in enumerate(keys)), ("__block", "__b")]))
    last = F.col("__rank") == F.col("__n")
    return out.withColumns({"__stop": F.when(last, F.col("__next.t")).otherwise(F.col("__stop")), "__stop_index": F.when(last, F.col("__next.i")).otherwise(F.col("__stop_index")), "__rank": F.col("__rank") + F.col("__before")})


def pair(events: DataFrame, keys: Sequence[str], time: str = "time", index: str = "event_index", kind: str = "type", scale: int = 6, long_rows: int = LONG_ROWS) -> DataFrame:
    """Per key in order of (time, index): odd events of state behaviours start and even ones stop; points have length zero;
    a last odd start stays open (``unmatched_start``); untyped behaviours give ``unknown_type``. Durations are decimal.

    One shuffle by key, unless some key has more than ``long_rows`` events: those are ranked in blocks of time.
    """
    long_keys = events.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > long_rows).drop("__n")
    if long_keys.isEmpty():
        at = ranked(events, keys, time, index)
    else:
        cuts = events.agg(F.percentile_approx(F.col(time).cast("double"), [k / (CUTS + 1) for k in range(1, CUTS + 1)], 100 * CUTS)).first()[0]
        at = ranked_in_blocks(events, keys, time, index, long_keys, sorted(set(cuts or [])))
    state = F.upper(F.col(kind)).startswith("STATE")
    point = F.upper(F.col(kind)).startswith("POINT")
    kept = at.where(~F.coalesce(state, F.lit(False)) | (F.col("__rank") % 2 == 1))
    stop = F.when(state, F.col("__stop")).when(point, F.col(time))
    outcome = F.when(point, "point").when(state & F.col("__stop").isNotNull(), "paired").when(state, "unmatched_start").otherwise("unknown_type")
    exact = lambda c: c.cast(f"decimal(38,{scale})")
    return kept.select(*keys, F.col(time).alias("start"), stop.alias("stop"), F.col(index).alias("start_index"), F.when(state, F.col("__stop_index")).when(point, F.col(index)).alias("stop_index"), (exact(stop) - exact(F.col(time))).cast("double").alias("duration"), outcome.alias("outcome"))


def observations(events: DataFrame, by: str, time: str = "time") -> DataFrame:
    """Per observation: events, first and last time."""
    return events.groupBy(by).agg(F.count(F.lit(1)).alias("n_events"), F.min(time).alias("first_time"), F.max(time).alias("last_time"))


def media_duration(media: DataFrame, by: str) -> DataFrame:
    """Total media length per observation; null as soon as one file's length is missing."""
    return media.groupBy(by).agg(F.when(F.bool_or(F.col("length").isNull()), None).otherwise(F.sum("length")).alias("media_duration"), F.array_join(F.array_sort(F.collect_list("name")), " | ").alias("media"))
