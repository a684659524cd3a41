"""Exact deduplication by a log-structured merge index of text digests, in DataFrame functions only.

Texts are equal when identical after deleting every ASCII white-space character. Ingested rows become *runs*, each of
memtables: a task sorts its memtable by digest and flushes it. Compaction takes all waiting runs into the level in one pass: they
are merged by digest, and entries whose digest the level's filter, a bitmap of its digests, does not hold are new and are appended
as they are; only the others are merged with the level's entries that the runs' filter holds. An entry is a digest, the winner (most code points in the original text, then smallest doc_id) and
the number of members. Digests with more than one member are hits; rows that a filter of the hits lets through have their
whole texts grouped byte by byte, and a digest that covers several texts is split.

Entries with one member are groups of their own and join nothing. Rows of hits join their entries: digests that hold
more than 1 / ``HEADS`` of all rows, of which there are fewer than ``HEADS``, by a broadcast, the others by a shuffle, so no
key's rows fill a task.

Defined results: a null text counts as empty; a null doc_id loses to any other and ``keep_id`` is null
only if all ids of the group are; of rows that repeat doc_id and length exactly one is kept; an empty
table gives an empty result; extra columns are ignored. Every text is read whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm._ranks import nth_of
from quire.runtime import materialize, shared_path, spread

SPACES = " \t\n\x0b\x0c\r"
#: Positions of a filter: 16 for each digest, this many at most (16 MiB as bitmaps). Beyond it
#: a filter only lets more rows through; what is behind it stays exact.
MAX_FILTER_BITS = 1 << 27
BITMAP_BITS = 32768
RUNS, HEADS = 4, 10_000


def squeezed(text: Column) -> Column:
    """The text without ASCII white space; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), SPACES, "")


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def _winner() -> Column:
    """Smallest struct wins: longest text, ids before nulls, smallest id, then one of the rows that repeat both."""
    return F.struct((-F.col("n_chars")).alias("neg"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "batch", "row_no")


class Filter:
    """Bitmaps of digests: a row for ``BITMAP_BITS`` positions, sized by the number of digests, bounded by MAX_FILTER_BITS."""

    def __init__(self, digests: DataFrame, n: int):
        self.bits = min(MAX_FILTER_BITS, max(BITMAP_BITS, 1 << (16 * n).bit_length()))
        block, bit = self._where(F.col("digest"))
        self.maps = digests.select(block.alias("__quire_block"), bit.cast("long").alias("bit")).groupBy("__quire_block").agg(F.expr("bitmap_construct_agg(bit)").alias("__quire_bitmap"))

    def _where(self, digest: Column) -> tuple[Column, Column]:
        at = F.pmod(F.xxhash64(digest), F.lit(self.bits))
        return F.floor(at / BITMAP_BITS).cast("int"), F.pmod(at, F.lit(BITMAP_BITS)).cast("int")

    def probe(self, rows: DataFrame, digest: str = "digest") -> DataFrame:
        """Adds ``__quire_held``: false where the filter rules the digest out. The bitmaps are broadcast, 16 MiB at most."""
        block, bit = self._where(F.col(digest))
        bit_set = F.expr("cast(conv(hex(substring(__quire_bitmap, __quire_bit div 8 + 1, 1)), 16, 10) as int) & shiftleft(1, __quire_bit % 8) <> 0")
        found = rows.withColumns({"__quire_block": block, "__quire_bit": bit}).join(F.broadcast(self.maps), "__quire_block", "left")
        return found.withColumn("__quire_held", F.coalesce(bit_set, F.lit(False))).drop("__quire_block", "__quire_bit", "__quire_bitmap")


class LsmDedupIndex:
    """An index in a shared folder: ``runs/`` holds what was ingested, ``level/`` the parts that compaction made of it."""

    def __init__(self, spark: SparkSession, path: str | None = None, digest: Callable[[Column], Column] = sha256):
        self.spark, self.digest = spark, digest
        self.path = path or shared_path(spark, "lsm")
        self.batches = self.passes = 0
        self.runs: list[str] = []
        self.waiting: list[str] = []  # runs that the level doesn't hold yet
        self.parts: list[str] = []  # parts of the level, with no digest in two of them
        self.entries = 0

    def _level(self) -> DataFrame:
        return self.spark.read.schema(ENTRIES).parquet(*self.parts) if self.parts else self.spark.createDataFrame([], ENTRIES)

    def ingest(self, docs: DataFrame, runs: int = 1) -> None:
        """Flush each task's rows, sorted by digest, to one of ``runs`` runs."""
        batch, self.batches = self.batches, self.batches + 1
        path = f"{self.path}/runs/{batch}"
        (
            docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
            .select("doc_id", F.length("text").cast("long").alias("n_chars"), self.digest(squeezed(F.col("text"))).alias("digest"))
            .withColumn("row_no", F.monotonically_increasing_id())
            .withColumns({"batch": F.lit(batch), "run": F.spark_partition_id() % runs})
            .sortWithinPartitions("run", "digest")
            .write.partitionBy("run")
            .parquet(path)
        )
        found = self.spark.read.schema(f"{ROWS}, run int").parquet(path).select("run").distinct().collect()  # ``runs`` numbers at most
        new = [f"{path}/run={r['run']}" for r in sorted(found)]
        self.runs, self.waiting = self.runs + new, self.waiting + new

    def _write(self, entries: DataFrame, name: str) -> str:
        part = f"{self.path}/level/{name}"
        entries.sortWithinPartitions("digest").write.parquet(part)
        return part

    def compact(self) -> None:
        """Take the waiting runs into the level, all of them in one pass. Map-side combining keeps hot digests small."""
        if not self.waiting:
            return
        merge = [F.min("best").alias("best"), F.sum("members").alias("members")]
        waiting, self.waiting, self.passes = self.waiting, [], self.passes + 1
        name = f"{self.passes}"
        rows = self.spark.read.schema(ROWS).parquet(*waiting).select("digest", _winner().alias("best"), F.lit(1).cast("long").alias("members"))
        new = rows.groupBy("digest").agg(*merge)
        if not self.parts:
            self.parts = [self._write(new, name)]
            self.entries = self._level().count()
            return
        new = materialize(new, "run")
        n_new, level = new.count(), self._level()
        old = Filter(level, self.entries).probe(new)
        fresh = old.filter("NOT __quire_held").drop("__quire_held")
        met = Filter(old.filter("__quire_held"), n_new).probe(level)
        merged = old.filter("__quire_held").drop("__quire_held").unionByName(met.filter("__quire_held").drop("__quire_held")).groupBy("digest").agg(*merge)
        rest = met.filter("NOT __quire_held").drop("__quire_held")
        self.parts = [self._write(x, f"{name}-{kind}") for x, kind in ((rest, "rest"), (merged, "merged"), (fresh, "fresh"))]
        self.entries = self._level().count()

    def rows(self) -> DataFrame:
        return self.spark.read.schema(ROWS).parquet(*self.runs) if self.runs else self.spark.createDataFrame([], ROWS)

    def compacted(self) -> DataFrame:
        self.compact()
        return self._level()

    def hits(self) -> tuple[DataFrame, Filter]:
        """Entries with more than one member, and their filter."""
        hits = materialize(self.compacted().filter("members > 1"), "hits")
        return hits, Filter(hits, hits.count())

    def _texts(self, docs: DataFrame) -> DataFrame:
        raw = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("raw"))
        return raw.select("doc_id", F.length("raw").cast("long").alias("n_chars"), squeezed(F.col("raw")).alias("text"))

    def verified(self, docs: DataFrame, hits: Filter) -> DataFrame:
        """(digest, text, members) of every hit, grouped by its bytes; rows that the filter rules out move nowhere."""
        texts = hits.probe(self._texts(docs).withColumn("digest", self.digest(F.col("text")))).filter("__quire_held")
        return texts.groupBy("digest", "text").agg(F.count(F.lit(1)).alias("members"))

    def groups(self, docs: DataFrame, *more: str) -> DataFrame:
        """Every ingested row with its group, and ``more`` of its own columns. ``docs`` must be what was ingested."""
        level = self.compacted()
        hits, by_hit = self.hits()
        classes = self.verified(docs, by_hit).groupBy("digest").agg(F.count(F.lit(1)).alias("texts"))
        if not classes.filter("texts > 1").isEmpty():
            return self._split(docs, *more)
        one = level.filter("members = 1").select(
            F.col("best.doc_id").alias("doc_id"), F.col("best.doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.col("digest").alias("text_sha256"),
            *[{"n_chars": -F.col("best.neg")}[c].alias(c) for c in more],
        )
        rows = by_hit.probe(self.rows()).filter("__quire_held").drop("__quire_held")
        joined = _with_heads(rows, hits, "digest", self.rows().count())
        return one.unionByName(joined.select("doc_id", F.col("best.doc_id").alias("keep_id"), F.col("members").alias("group_size"), _is_best().alias("kept"), F.col("digest").alias("text_sha256"), *more))

    def _split(self, docs: DataFrame, *more: str) -> DataFrame:
        """A digest that covers several texts: regroup by the texts themselves, with the full hash of each."""
        rows = materialize(self._texts(docs).withColumns({"batch": F.lit(0), "row_no": F.monotonically_increasing_id()}), "texts")
        best = materialize(rows.groupBy("text").agg(F.min(_winner()).alias("best"), F.count(F.lit(1)).alias("members")), "classes")
        joined = _with_heads(rows, best, "text", rows.count())
        return joined.select("doc_id", F.col("best.doc_id").alias("keep_id"), F.col("members").alias("group_size"), _is_best().alias("kept"), sha256(F.col("text")).alias("text_sha256"), *more)


ROWS = "doc_id long, n_chars long, digest string, row_no long, batch int"
ENTRIES = "digest string, best struct<neg: long, no_id: boolean, doc_id: long, batch: int, row_no: long>, members long"


def _is_best() -> Column:
    return (F.col("row_no") == F.col("best.row_no")) & (F.col("batch") == F.col("best.batch"))


def _with_heads(rows: DataFrame, entries: DataFrame, key: str, n_rows: int) -> DataFrame:
    """Rows with their entry: entries with more than 1 / HEADS of the rows are fewer than HEADS and are broadcast."""
    hot = F.col("members") * HEADS > n_rows
    heads = entries.filter(hot).select(key, F.lit(True).alias("__quire_hot"))
    marked = rows.join(F.broadcast(heads), key, "left")
    own = marked.filter("__quire_hot").drop("__quire_hot").join(F.broadcast(entries.filter(hot)), key)
    return own.unionByName(marked.filter("__quire_hot IS NULL").drop("__quire_hot").join(entries.filter(~hot), key))


def exact_groups(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of ``docs``."""
    index = LsmDedupIndex(docs.sparkSession)
    index.ingest(docs, RUNS)
    return index.groups(docs)


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, one a group. Of rows that repeat doc_id, length and squeezed text any one stays.

    Rows that the filter of the hits rules out stay where they are; only the others' texts move, to meet the rows to drop."""
    index = LsmDedupIndex(docs.sparkSession)
    index.ingest(docs, RUNS)
    keys = ["__quire_id", "__quire_sha", "__quire_n"]
    groups = index.groups(docs, "n_chars").filter("group_size > 1")
    groups = materialize(groups.select(F.col("doc_id").alias(keys[0]), F.col("text_sha256").alias(keys[1]), F.col("n_chars").alias(keys[2]), "kept"), "groups")
    pairs = groups.groupBy(*keys).agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("n"))
    pairs = materialize(pairs.select(*[F.col(k).alias(f"{k}2") for k in keys], "kept", "n"), "pairs")
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"{k}2"))
    rows = docs.withColumns({keys[0]: F.col("doc_id"), keys[1]: sha256(squeezed(F.col("text"))), keys[2]: F.length(F.coalesce("text", F.lit(""))).cast("long")})
    rows = index.hits()[1].probe(rows, keys[1])
    out = rows.filter("__quire_held").join(pairs.filter("NOT kept"), same, "left_anti")
    if not pairs.filter("kept AND n > 1").isEmpty():
        repeated = nth_of(out.join(pairs.filter("kept AND n > 1"), same, "left_semi"), keys, "__quire_nth").filter("__quire_nth = 1").drop("__quire_nth")
        out = out.join(pairs.filter("kept AND n > 1"), same, "left_anti").unionByName(repeated)
    return rows.filter("NOT __quire_held").select(*docs.columns).unionByName(out.select(*docs.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")))


SQL = r"""
WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS n,
                  sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS h FROM documents),
r AS (SELECT doc_id, h, count(*) OVER (PARTITION BY h) AS group_size,
             row_number() OVER w AS rn, first_value(doc_id) OVER w AS keep_id
      FROM t WINDOW w AS (PARTITION BY h ORDER BY n DESC, doc_id ASC NULLS LAST))
SELECT doc_id, keep_id, group_size, rn = 1 AS kept, h AS text_sha256 FROM r
"""
