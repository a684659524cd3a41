"""The registry as the state of a keyed stream.

Refresh outcomes arrive as files; each meets its entry in the registry by a join, and ``transformWithState`` keeps an entry's row by (scope, name)
from its first outcome on: entries of which nothing is said cost no state. An outcome counts once and in order of its time: one that is not later than the last applied is a repetition or late, and
changes nothing. The watermark is the time of arrival, so no outcome is dropped for another entry's being ahead. Every applied outcome sets
a timer for the end of the check interval; when the watermark passes it, the entry is reported as due. Changed rows are written a folder a batch, so a restart from the checkpoint overwrites what it had begun.

Outcomes without a key, status or time say nothing. Outcomes for entries that aren't registered change nothing. What the
registry says counts until an entry's first outcome, then the state does. State lives in RocksDB under the checkpoint, which belongs in the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import UTC, datetime, timedelta

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quire.runtime import ship_code

KEY = ["scope", "name"]
OUTCOMES = "scope string, name string, status string, at timestamp"
ENTRY = "skill_path string, last_check timestamp, update_available boolean, applied_at timestamp"
CHANGES = f"scope string, name string, {ENTRY}, due boolean"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def applied(entry: tuple, outcomes: list[tuple[datetime, str]]) -> tuple[tuple, bool]:
    """(skill_path, last_check, update_available, applied_at) after outcomes in order of time, and whether any counted.

    The rules of ``catalog.apply_outcomes``: skipped changes nothing, stale only the check time."""
    path, checked, flag, last = entry
    counted = False
    for at, status in sorted(outcomes):
        if last is not None and at <= last:
            continue
        last, counted = at, True
        if status != "skipped":
            checked = at
            flag = flag if status == "stale" else status == "update-available"
    return (path, checked, flag, last), counted


def _naive(at: datetime | None) -> datetime | None:
    """Timestamps as UTC without a zone, however they come out of the state."""
    return at if at is None or at.tzinfo is None else at.astimezone(UTC).replace(tzinfo=None)


class Entries(StatefulProcessor):
    """One registry entry's state."""

    def __init__(self, interval_hours: float):
        self.interval = timedelta(hours=interval_hours)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entry = handle.getValueState("entry", ENTRY)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: ANN001, N802, N803
        outcomes, first = [], None
        for r in rows:
            first = first or (r.skill_path, r.last_check, r.update_available, r.applied_at)
            outcomes.append((_naive(r.at), r.status))
        known = self.entry.get()
        before = known or first
        entry, counted = applied((before[0], _naive(before[1]), before[2], _naive(before[3])), outcomes)
        if counted:
            self.entry.update(entry)
            for timer in list(self.handle.listTimers()) if known else ():
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(int((entry[3].replace(tzinfo=UTC) + self.interval).timestamp() * 1000))
            yield Row(**dict(zip(("scope", "name"), key, strict=True)), **dict(zip(("skill_path", "last_check", "update_available", "applied_at"), entry, strict=True)), due=False)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: ANN001, N802, N803
        entry = self.entry.get()
        yield Row(**dict(zip(("scope", "name"), key, strict=True)), skill_path=entry[0], last_check=_naive(entry[1]), update_available=entry[2], applied_at=_naive(entry[3]), due=True)

    def close(self) -> None:
        pass


def telling(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each entry's outcomes, those that decide what ``applied`` makes of all of them whatever the state: the last, the last not skipped and the last that sets the flag.

    Of one moment's outcomes the first by status counts. All outcomes of an entry come to one call, which holds its partition of a batch."""
    held = list(batches)
    if held:
        rows = pa.Table.from_batches(held).to_pandas().sort_values(["at", "status"]).drop_duplicates([*KEY, "at"])
        kinds = rows, rows[rows["status"] != "skipped"], rows[~rows["status"].isin(["skipped", "stale"])]
        kept = pd.concat([k.drop_duplicates(KEY, keep="last") for k in kinds]).drop_duplicates()
        yield from pa.Table.from_pandas(kept, held[0].schema, preserve_index=False).to_batches(max_chunksize=10_000)


def changes(outcomes: DataFrame, registry: DataFrame, interval_hours: float = 24) -> DataFrame:
    """A streaming frame of changed entries, from streaming outcomes and the registry that entries begin with."""
    spark = outcomes.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    ship_code(spark)
    known = [c for c in ("applied_at",) if c in registry.columns]
    first = registry.select("scope", "name", "skill_path", "last_check", "update_available", *(known or [F.lit(None).cast("timestamp").alias("applied_at")]))
    rows = outcomes.filter("scope IS NOT NULL AND name IS NOT NULL AND status IS NOT NULL AND at IS NOT NULL")
    rows = rows.select("scope", "name", "status", "at").repartition(*KEY).mapInArrow(telling, OUTCOMES)  # Python state functions take a row at a time
    rows = rows.select("*", F.current_timestamp().alias("arrived")).withWatermark("arrived", "0 seconds").join(first, ["scope", "name"])
    return rows.groupBy("scope", "name").transformWithState(Entries(interval_hours), CHANGES, "update", "eventTime")


def follow(outcomes: DataFrame, registry: DataFrame, out: str, checkpoint: str, interval_hours: float = 24):  # noqa: ANN201
    """Runs the stream over what has arrived and stops; returns the query. Changed rows go to ``out``, a folder a batch."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream = changes(outcomes, registry, interval_hours).writeStream.outputMode("update").foreachBatch(write)
    query = stream.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def outcome_files(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of outcomes from JSON files in a folder."""
    return spark.readStream.schema(OUTCOMES).json(folder)


def current(registry: DataFrame, out: str) -> DataFrame:
    """The registry with the last change of every entry, and ``due``."""
    spark = registry.sparkSession
    rows = spark.read.schema(f"{CHANGES}, batch long").parquet(out)
    last = rows.groupBy("scope", "name").agg(F.max_by(F.struct("last_check", "update_available", "due"), F.struct("applied_at", "due")).alias("now"))
    joined = registry.join(last, ["scope", "name"], "left")
    pick = lambda c: F.when(F.col("now").isNotNull(), F.col(f"now.{c}")).otherwise(registry[c]).alias(c)
    return joined.select("scope", "name", "skill_path", pick("last_check"), pick("update_available"), F.coalesce("now.due", F.lit(False)).alias("due"))
