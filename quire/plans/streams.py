"""Queries that run as streams over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.plans import catalogs as c
from quire.runtime import materialize, shared_path
from quire.streaming import registry as keyed

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
#: What an event says of the customer's doc set, by the remainder of its number.
STATUSES = ("update-available", "unchanged", "stale", "skipped", "regenerated")


@c.registers(QUERIES, ORACLES)(f"""WITH {c.REGISTRY_SQL}, o AS (SELECT CASE WHEN user_id % 3 = 0 THEN 'project' ELSE 'personal' END AS scope, 'set-' || CAST(user_id AS VARCHAR) AS name, ts AS moment,
  min(list_extract({list(STATUSES)}, CAST(event_id % 5 AS INTEGER) + 1)) AS status FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL GROUP BY user_id, ts),
l AS (SELECT scope, name, max(moment) FILTER (status <> 'skipped') AS checked, arg_max(status, moment) FILTER (status NOT IN ('skipped', 'stale')) AS said FROM o GROUP BY scope, name)
SELECT g.scope, g.name, coalesce(checked, last_check) AS last_check, CASE WHEN said IS NULL THEN update_available ELSE said = 'update-available' END AS update_available FROM registry g LEFT JOIN l USING (scope, name)""")
def inc_state_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registry after a keyed stream over the events, as outcomes of the customers' doc sets."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    events = spark.readStream.schema(schema).parquet(f"{sf_dir}/event[s].parquet")  # a pattern, as streams take no single file
    status = F.element_at(F.array(*[F.lit(s) for s in STATUSES]), (F.col("event_id") % 5 + 1).cast("int"))
    scope = F.when(F.col("user_id") % 3 == 0, "project").otherwise("personal")
    outcomes = events.select(scope.alias("scope"), F.concat(F.lit("set-"), F.col("user_id").cast("string")).alias("name"), status.alias("status"), F.col("ts").cast("timestamp").alias("at"))
    own = materialize(c.registry(spark, sf_dir), "registry")
    out = shared_path(spark, "changes")
    keyed.follow(outcomes, own, out, shared_path(spark, "checkpoint"))
    return keyed.current(own, out).select("scope", "name", "last_check", "update_available")
