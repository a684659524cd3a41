"""Incremental maintenance of doc sets.

A refresh compares fingerprints and heads with records and updates the registry. As a stream, outcome
files arrive in a folder and the registry state is kept by (scope, name) with the last outcome applied.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import catalog

HOOK_LIMIT = 3


def dispatch(kind: Column, interactive: bool, update: bool, due: Column) -> Column:
    """What a refresh does with an entry: rebuild, update, check, or skip inside the interval."""
    remote = F.lit("update") if interactive and update else F.lit("check") if interactive else F.when(due, "check").otherwise("skip")
    return F.when(kind == "path", "rebuild").otherwise(remote)


def hook_plan(registry: DataFrame, records: DataFrame, folder: str, now: Column) -> DataFrame:
    """name, scope, action of eligible entries; of changed local ones only the oldest few are rebuilt."""
    rows = registry.join(records, "skill_path").select(registry["name"], registry["scope"], "skill_path", "source", "last_refresh", "check_interval_hours", "changed")
    rows = rows.filter(catalog.hook_eligible(F.col("scope"), F.col("skill_path"), folder))
    action = dispatch(F.col("source.type"), False, False, catalog.stale(F.col("last_refresh"), F.col("check_interval_hours"), now))
    rows = rows.withColumn("action", action)
    first = catalog.oldest(rows.filter("action = 'rebuild' AND changed"), HOOK_LIMIT).select("scope", "name", F.lit(True).alias("_first"))
    rows = rows.join(first, ["scope", "name"], "left")
    return rows.select("scope", "name", F.when(F.col("action") != "rebuild", F.col("action")).when(F.col("_first"), "rebuild").when(F.col("changed"), "postponed").otherwise("unchanged").alias("action"))


def outcome_stream(spark: SparkSession, folder: str, sink: Callable[[DataFrame, int], None], checkpoint: str):
    """Starts a stream over JSON outcome files that processes what is there and stops.

    ``sink`` gets each batch reduced to the last outcome by (scope, name); the engine's checkpoint makes it exactly once
    for sinks that are idempotent by batch number."""
    schema = "scope string, name string, status string, at timestamp"

    def batch(df: DataFrame, number: int) -> None:
        last = df.groupBy("scope", "name").agg(F.max_by("status", "at").alias("status"), F.max("at").alias("at"))
        sink(last, number)

    stream = spark.readStream.schema(schema).json(folder)
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def outcome_counts(spark: SparkSession, folder: str) -> DataFrame:
    """A streaming frame: outcomes by status in hourly windows, late ones up to an hour."""
    stream = spark.readStream.schema("scope string, name string, status string, at timestamp").json(folder)
    return stream.withWatermark("at", "1 hour").groupBy(F.window("at", "1 hour"), "status").agg(F.count(F.lit(1)).alias("n"))
