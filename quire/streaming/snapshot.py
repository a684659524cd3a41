"""A source that remembers what it has read.

A table keeps path, length, modification time and digest of every file of a folder; a stream over ``quire_documents`` brings it up to
date by what is new, changed or gone since the last listing, so an unchanged source costs a listing and no file is opened. Digests are of a document's content
as it is sliced, null for files that aren't used (drafts, empty and too large ones). Folder digests make a Merkle tree of the
table: equal roots mean equal doc sets, and where roots differ the tree leads to the folders that do.

Files whose length and time are the same count as unchanged, as for any tool that goes by them. All state lies below one
folder that all executors see; a batch overwrites what a lost run of it had written.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import markdown as md
from quire.functions.text import js_trim
from quire.sources import files, folders

TABLE = "rel_path string, length long, modified timestamp, digest string, gone boolean, batch long"


def content_digest(raw: Column, length: Column, include_large: bool, frontmatter=files.any_frontmatter) -> Column:
    """sha256 of the content that slicing would use; null where it uses none."""
    body = md.strip_mdx(md.frontmatter_body(raw))
    used = files.size_guard(length, include_large) & files.published(frontmatter(raw)["draft"])
    return F.when(used & (js_trim(body) != ""), F.sha2(body, 256))


def folder_digests(table: DataFrame) -> DataFrame:
    """folder, digest of every folder of (rel_path, digest), '' for the root: sha256 over kinds, names and digests of what it holds, in order of names."""
    nodes = table.select(F.col("rel_path").alias("path"), F.lit("file").alias("kind"), "digest").withColumn("depth", F.size(F.split("path", "/", -1)))
    deepest = nodes.agg(F.max("depth")).first()[0] or 1
    out = None
    for depth in range(deepest, 0, -1):
        own = nodes.filter(F.col("depth") == depth)
        above = F.when(F.lit(depth) == 1, F.lit("")).otherwise(F.regexp_replace("path", "/[^/]*\\z", ""))
        lines = F.array_sort(F.collect_list(F.struct(F.element_at(F.split("path", "/", -1), -1).alias("name"), "kind", "digest")))
        text = F.to_json(lines)
        made = own.groupBy(above.alias("folder")).agg(F.sha2(text, 256).alias("digest"))
        out = made if out is None else out.unionByName(made)
        nodes = nodes.filter(F.col("depth") < depth).unionByName(made.filter("folder <> ''").select(F.col("folder").alias("path"), F.lit("folder").alias("kind"), "digest", F.lit(depth - 1).alias("depth")))
    return out


class Snapshot:
    """The remembered state of one folder, below ``state``."""

    def __init__(self, spark: SparkSession, root: str, state: str, include_large: bool = False, frontmatter=files.any_frontmatter):
        self.spark, self.root, self.state = spark, root, state.rstrip("/")
        self.include_large, self.frontmatter = include_large, frontmatter

    def update(self) -> int:
        """Reads what is new or changed and takes it in; returns how many files were opened."""
        folders.register(self.spark)
        opened: list[int] = []

        def take(batch: DataFrame, number: int) -> None:
            digest = content_digest(F.decode("content", "UTF-8"), F.col("length"), self.include_large, self.frontmatter)
            rows = batch.select("rel_path", "length", "modified", F.when(F.col("content").isNotNull(), digest).alias("digest"), F.col("content").isNull().alias("gone"))
            path = f"{self.state}/files/batch={number}"
            rows.write.mode("overwrite").parquet(path)
            opened.append(self.spark.read.parquet(path).filter("NOT gone").count())

        stream = self.spark.readStream.format("quire_documents").option("snapshots", f"{self.state}/listings").load(self.root)
        query = stream.writeStream.foreachBatch(take).option("checkpointLocation", f"{self.state}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
        return sum(opened)

    def table(self) -> DataFrame:
        """rel_path, length, modified, digest of the files that are there now."""
        rows = self.spark.read.schema(TABLE).parquet(f"{self.state}/files")
        last = rows.groupBy("rel_path").agg(F.max_by(F.struct("length", "modified", "digest", "gone"), "batch").alias("now"))
        return last.select("rel_path", "now.*").filter("NOT gone").drop("gone")

    def documents(self) -> DataFrame:
        """rel_path, digest of the doc set: the files a project is sliced from, under the paths they have in it."""
        used = self.table().filter("digest IS NOT NULL").select(F.lit("docs").alias("doc_set"), "rel_path", "digest")
        return files.discover(used).select("rel_path", "digest")

    def tree(self) -> DataFrame:
        return folder_digests(self.documents())

    def root_digest(self, version: int, budget: int) -> str | None:
        """Changes exactly when the doc set's fingerprint does; None if it has no document."""
        root = self.tree().filter("folder = ''").first()
        return root and hashlib.sha256(f"{version}:{budget}:{self.include_large}:{root['digest']}".encode()).hexdigest()


def changed_folders(before: DataFrame, after: DataFrame) -> DataFrame:
    """folder of every folder whose digest differs between two trees, or that only one of them has."""
    old = before.select("folder", F.col("digest").alias("_was"))
    return after.join(old, "folder", "full").filter(~F.col("digest").eqNullSafe(F.col("_was"))).select("folder")
