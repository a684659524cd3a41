"""Mixing sources to target weights by capped water-filling.

Sources share a word budget by weight; a source is clamped at a maximum number of epochs and the excess
goes to the others in proportion until none is above. A source's epochs then become whole repetitions of
all its documents and a fractional one: documents in seeded order until the running words come nearest.

Defined results: null text has size 0 and null source is a source of its own, last in order; a document
of size 0 takes 0 words; with no words at all every target is 0; rows that repeat a doc_id are documents
of their own, hashed and so ordered together; equal hashes fall back to doc_id and size; empty tables give empty
results; extra columns are ignored. Only scalars reach the driver, whatever the number of sources.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm._ranks import hash32, nth_of, ranked, running
from quire.runtime import materialize, spread

WEIGHTS, SHARE, MAX_EPOCHS, SEED = (5.0, 2.0, 1.0), 1.5, 2.0, 20261126
WORD = r"[^\x20\x09-\x0D]+"


def water_fill(sources: DataFrame, share: float, max_epochs: float) -> DataFrame:
    """Adds ``target`` to rows with ``source_size`` and ``weight``. The level only rises, so a clamped source stays clamped."""
    cap = F.col("source_size") * F.lit(max_epochs)
    total, weight = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0.0))).first()
    left, free = share * total, weight
    while free:
        above = F.lit(left) * F.col("weight") / F.lit(free) > cap
        clamped, kept = sources.agg(F.coalesce(F.sum(F.when(above, cap)), F.lit(0.0)), F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0.0))).first()
        if (share * total - clamped, kept) == (left, free):
            break
        left, free = share * total - clamped, kept
    fair = F.lit(left) * F.col("weight") / F.lit(free or 1.0)
    return sources.withColumn("target", F.when((fair > cap) | F.lit(not free), cap).otherwise(fair))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, max_epochs: float = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """doc_id, size, source, source_size, target, times, taken for every row; weights repeat over the ordered sources."""
    sizes = docs.select("doc_id", "source", F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long").alias("size"))
    sizes = materialize(sizes.withColumn("h", hash32(seed, "doc_id")), "sizes")
    sources = ranked(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), [F.col("source").asc_nulls_last()], "place")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    sources = materialize(sources.withColumn("weight", weight), "sources")
    filled = materialize(water_fill(sources, share, max_epochs), "targets").withColumnRenamed("source", "_source")
    rows = running(sizes, "source", "h", ["doc_id", "size"], F.col("size"), "before")
    rows = rows.join(filled, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    epochs = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rows = rows.withColumns({"whole": F.floor(epochs), "part": F.col("target") - F.floor(epochs) * F.col("source_size")})
    times = F.col("whole") + F.when((F.col("before") + F.col("size") / 2 <= F.col("part")) & (F.col("part") > 0), 1).otherwise(0)
    return rows.withColumn("times", times.cast("long")).select("doc_id", "size", "source", "source_size", "target", "times", (F.col("times") * F.col("size")).alias("taken"))


def repeat(docs: DataFrame, **options: float) -> DataFrame:
    """The mix itself: rows of ``docs`` as often as the mix takes them.

    Rows that repeat doc_id, source and size share the copies planned for them: each takes the whole part, and the first
    of them, in any order, one more until the plan's number is met."""
    plan = mix(docs, **options)
    plan = plan.groupBy(F.col("doc_id").alias("__quire_id"), F.col("source").alias("__quire_source"), F.col("size").alias("__quire_size")).agg(F.sum("times").alias("__quire_all"), F.count(F.lit(1)).alias("__quire_rows"))
    plan = materialize(plan.filter("__quire_all > 0"), "plan")
    size = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long")
    out = docs.join(plan, F.col("doc_id").eqNullSafe(F.col("__quire_id")) & F.col("source").eqNullSafe(F.col("__quire_source")) & (size == F.col("__quire_size")))
    whole = F.floor(F.col("__quire_all") / F.col("__quire_rows"))
    if plan.filter("__quire_rows > 1").isEmpty():
        out = out.withColumn("__quire_times", F.col("__quire_all"))
    else:
        single = out.filter("__quire_rows = 1").withColumn("__quire_times", F.col("__quire_all"))
        shared = nth_of(out.filter("__quire_rows > 1"), ["__quire_id", "__quire_source", "__quire_size"], "__quire_nth")
        more = F.col("__quire_nth") <= F.col("__quire_all") - whole * F.col("__quire_rows")
        out = single.unionByName(shared.withColumn("__quire_times", whole + more.cast("long")).drop("__quire_nth"))
    copies = F.explode(F.array_repeat(F.lit(1), F.col("__quire_times").cast("int")))
    return out.withColumn("__quire_copy", copies).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")))
    return out.select("doc_id", "size", "source_size", "target", "taken")


SQL = rf"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
                  CAST(('0x' || substr(md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8)) AS BIGINT) AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, 2.0::DOUBLE * source_size AS cap, [5.0::DOUBLE, 2.0, 1.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight,
             1.5::DOUBLE * sum(source_size) OVER () AS budget FROM s),
o AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS caps,
             sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS free FROM w),
c AS (SELECT *, (budget - caps) * weight / free > cap AS clamped FROM o),
f AS (SELECT *, budget - coalesce(sum(cap) FILTER (clamped) OVER (), 0) AS pool, sum(weight) FILTER (NOT clamped) OVER () AS open FROM c),
t AS (SELECT source, source_size, CASE WHEN clamped THEN cap ELSE pool * weight / open END AS target FROM f),
j AS (SELECT d.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END AS whole,
             coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST((whole + CASE WHEN target - whole * source_size > 0 AND before + size / 2.0 <= target - whole * source_size THEN 1 ELSE 0 END) * size AS BIGINT) AS taken
FROM j
"""
