"""Order of documents and fingerprints of file sets."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import numeric_prefix
from quire.runtime import ship_code


def doc_order(position: Column, name: Column, path: Column) -> list[Column]:
    """Sort keys within a folder: finite position, numeric prefix, then names and paths in English collation."""
    finite = F.when(~F.isnan(position) & (F.abs(position) != float("inf")), position)
    prefix = numeric_prefix(name)
    english = lambda c: F.collate(F.lower(c), "en")
    return [finite.isNull(), finite, prefix.isNull(), prefix, english(name), english(path), name, path]


def ranked_within_folder(files: DataFrame) -> DataFrame:
    """Adds ``folder``, ``file_name`` and ``place`` (from 1) among the files of a folder."""
    rows = files.withColumns({"folder": F.regexp_replace("rel_path", "/?[^/]*\\z", ""), "file_name": F.element_at(F.split("rel_path", "/", -1), -1)})
    order = Window.partitionBy("doc_set", "folder").orderBy(*doc_order(F.col("sidebar_position"), F.col("file_name"), F.col("rel_path")))
    return rows.withColumn("place", F.row_number().over(order))


def depth_first(files: DataFrame) -> DataFrame:
    """Adds ``file_ord``: files and child folders interleave in order, depth first. Needs doc_set, rel_path, sidebar_position.

    Every segment of a path gets a rank among its siblings; the array of ranks is the sort key."""
    parts = F.split("rel_path", "/", -1)
    rows = files.withColumn("_parts", parts).select("*", F.posexplode("_parts").alias("_at", "_name"))
    rows = rows.withColumns({
        "_up": F.array_join(F.slice("_parts", F.lit(1), F.col("_at")), "/"),
        "_path": F.array_join(F.slice("_parts", F.lit(1), F.col("_at") + 1), "/"),
        "_position": F.when(F.col("_at") == F.size("_parts") - 1, F.col("sidebar_position")),
    })
    siblings = rows.select("doc_set", "_up", "_path", "_name", "_position").distinct()
    order = Window.partitionBy("doc_set", "_up").orderBy(*doc_order(F.col("_position"), F.col("_name"), F.col("_path")))
    ranks = siblings.select("doc_set", "_path", F.row_number().over(order).alias("_rank"))
    keys = rows.join(ranks, ["doc_set", "_path"]).groupBy("doc_set", "rel_path").agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_rank"))), lambda s: s["_rank"]).alias("sort_key"))
    out = files.drop("file_ord").join(keys, ["doc_set", "rel_path"])
    return out.withColumn("file_ord", F.row_number().over(Window.partitionBy("doc_set").orderBy("sort_key"))).drop("sort_key")


def fileset_hash(files: DataFrame, version: int, budget: int, include_large: bool) -> DataFrame:
    """doc_set, source_hash: SHA-256 over length-prefixed paths and contents in path order, then the parameters.

    Files stream past one digest in order; a task holds a batch of them, not a doc set."""
    framed = lambda data: len(data).to_bytes(4, "big") + data
    tail = b"".join(framed(str(x).encode()) for x in (version, budget, str(include_large).lower()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, digest, done = None, None, []
        for batch in batches:
            for doc_set, path, content in zip(*(batch.column(i) for i in range(3)), strict=True):
                if digest is None or doc_set.as_py() != name:
                    if digest is not None:
                        done.append((name, digest))
                    name, digest = doc_set.as_py(), hashlib.sha256()
                for text in (path, content):
                    digest.update(framed((text.as_py() or "").encode("utf-8", "surrogatepass")))
        if digest is not None:
            done.append((name, digest))
        for _, own in done:
            own.update(tail)
        yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in done], pa.string()), pa.array([f"sha256:{d.hexdigest()}" for _, d in done], pa.string())], names=["doc_set", "source_hash"])

    ship_code(files.sparkSession)
    ordered = files.select("doc_set", "rel_path", "content", "file_ord").repartition("doc_set").sortWithinPartitions("doc_set", "rel_path", "file_ord")
    return ordered.mapInArrow(run, "doc_set string, source_hash string")


def caps(files: DataFrame, most_files: int = 5000, most_bytes: int = 104857600) -> DataFrame:
    """doc_set, n_files, n_bytes, within_caps (both bounds inclusive)."""
    sums = files.groupBy("doc_set").agg(F.count(F.lit(1)).alias("n_files"), F.sum(F.octet_length("content").cast("long")).alias("n_bytes"))
    return sums.withColumn("within_caps", (F.col("n_files") <= most_files) & (F.col("n_bytes") <= most_bytes))
