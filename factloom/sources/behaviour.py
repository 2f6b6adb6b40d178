"""Behaviour projects: JSON files of timed events, as events, ethogram and observation tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import intervals as pairing

SHAPE = (
    "behaviors_conf map<string,struct<code:string,type:string,category:string>>, "
    "observations map<string,struct<type:string,date:string,file:map<string,array<string>>,media_info:struct<length:map<string,double>>,events:array<array<string>>>>"
)


def projects(spark: SparkSession, path: str) -> DataFrame:
    """(file, project): one row a file, parsed once."""
    return parsed(spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), "value"))


def parsed(texts: DataFrame) -> DataFrame:
    """(file, project) from rows (file, value)."""
    return texts.select("file", F.from_json("value", SHAPE).alias("project"))


def ethogram(p: DataFrame) -> DataFrame:
    return p.select("file", F.explode(F.map_values("project.behaviors_conf")).alias("b")).select("file", "b.code", "b.type", "b.category")


def events(p: DataFrame) -> DataFrame:
    """(file, observation_id, event_index, time, subject, behavior, modifiers): one row per event; the index counts in file order."""
    per = p.select("file", F.explode("project.observations").alias("observation_id", "o"))
    rows = per.select("file", "observation_id", F.posexplode("o.events").alias("event_index", "e"))
    cell = lambda i: F.get("e", F.lit(i))
    return rows.select("file", "observation_id", (F.col("event_index") + 1).alias("event_index"), cell(0).try_cast("double").alias("time"), cell(1).alias("subject"), cell(2).alias("behavior"), cell(3).alias("modifiers"))


def observations(p: DataFrame) -> DataFrame:
    """(file, observation_id, n_events, media, media_duration): the duration of the first player's files, null if one is unknown."""
    per = p.select("file", F.explode("project.observations").alias("observation_id", "o"))
    first = F.coalesce(F.get(F.map_values("o.file"), F.lit(0)), F.array().cast("array<string>"))
    lengths = F.transform(first, lambda f: F.try_element_at("o.media_info.length", f))
    total = F.when((F.size(lengths) == 0) | F.exists(lengths, lambda x: x.isNull()), None).otherwise(F.aggregate(lengths, F.lit(0.0), lambda a, x: a + x))
    media = F.array_join(F.transform(first, lambda f: F.regexp_replace(f, r"^.*[/\\]", "")), " | ")
    return per.select("file", "observation_id", F.coalesce(F.size("o.events"), F.lit(0)).alias("n_events"), media.alias("media"), total.alias("media_duration"))


def well_formed(p: DataFrame) -> DataFrame:
    """(file, sound): whether the project could be read at all and every event has a time, a subject and a behaviour."""
    e = events(p).withColumn("ok", F.col("time").isNotNull() & F.col("subject").isNotNull() & F.col("behavior").isNotNull())
    seen = e.groupBy("file").agg(F.bool_and("ok").alias("ok"))
    return p.join(seen, "file", "left").select("file", (F.col("project").isNotNull() & F.col("project.observations").isNotNull() & F.coalesce("ok", F.lit(True))).alias("sound"))


def intervals(p: DataFrame) -> DataFrame:
    """(file, observation_id, subject, behavior, modifiers, start, stop, …): events paired per observation, subject, behaviour and
    modifiers; a code whose definitions contradict each other within its project is untyped. Projects do not share ethograms."""
    kinds = pairing.ethogram(ethogram(p), ["file"]).select("file", F.col("code").alias("behavior"), "type", "category")
    typed = events(p).join(kinds, ["file", "behavior"], "left")
    return pairing.pair(typed, ["file", "observation_id", "subject", "behavior", "modifiers"])
