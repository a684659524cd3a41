"""Document folders as DataFrames.

Local folders are read by the data source ``quire_documents``, other stores by Spark's binary source; predicates on names and sizes run
before a file's bytes are touched. Symbolic links, which only local folders have, are never followed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions import markdown as md
from quire.functions.text import js_trim
from quire.operators.order import caps, depth_first
from quire.runtime import materialize
from quire.sources import folders, repositories

MOST_BYTES, CERTAIN = 1 << 20, 2
#: Names with a meaning.
DOC_FOLDERS = ("docs", "documentation", "doc")
GLOB = "*.{[mM][dD],[mM][dD][xX],[mM][aA][rR][kK][dD][oO][wW][nN]}"
EXTENSION, README = "(?i)\\.(md|mdx|markdown)\\z", "(?i)^readme\\.(md|mdx|markdown)\\z"
PLAIN_EXTENSION = r"(?i)\.(md|mdx|markdown)$"
CHANGELOG, LICENSE = "(?i)^changelog\\.md\\z", "(?i)^license"


class EmptyFileSet(ValueError):
    """No usable Markdown file was found."""

    def __init__(self, searched: list[str]):
        super().__init__(f"no usable Markdown files; searched: {', '.join(searched)}")
        self.searched = searched


class LinkedSource(ValueError):
    """The source is a symbolic link."""


class SourceTooLarge(ValueError):
    """A doc set exceeds its caps."""


def usable_name(name: Column) -> Column:
    return name.rlike(EXTENSION) & ~name.rlike(CHANGELOG) & ~name.rlike(LICENSE)


def walkable(path: Column) -> Column:
    """No segment is hidden or a package folder."""
    return F.forall(F.split(path, "/", -1), lambda s: ~s.startswith(".") & (s != "node_modules"))


def size_guard(size: Column, include_large: bool, most: int = MOST_BYTES) -> Column:
    return (size <= most) | F.lit(include_large)


def published(draft: Column) -> Column:
    return ~F.coalesce(draft, F.lit(False))


def yaml_frontmatter(block: Column) -> Column:
    """General YAML blocks by an Arrow function; raises on invalid YAML. Null blocks have no fields."""

    @F.pandas_udf("title string, sidebar_position double, draft boolean")
    def parse(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        import yaml

        class Loader(yaml.SafeLoader):
            """Only true and false are booleans."""

        Loader.yaml_implicit_resolvers = {
            first: [(tag, own) for tag, own in pairs if tag != "tag:yaml.org,2002:bool" or first in "tTfF"] for first, pairs in yaml.SafeLoader.yaml_implicit_resolvers.items()
        }

        def one(block: str | None) -> tuple:
            data = yaml.load(block + "\n", Loader) if block else None  # noqa: S506
            data = data if isinstance(data, dict) else {}
            number = lambda x: float(x) if isinstance(x, int | float) and not isinstance(x, bool) else None
            nested = data.get("sidebar")
            position = number(data.get("sidebar_position"))
            if position is None and isinstance(nested, dict):
                position = number(nested.get("order"))
            title, draft = data.get("title"), data.get("draft")
            return title if isinstance(title, str) else None, position, draft if isinstance(draft, bool) else None

        for batch in batches:
            yield pd.DataFrame([one(b) for b in batch], columns=["title", "sidebar_position", "draft"]).astype({"sidebar_position": "float64"})

    return parse(block)


def any_frontmatter(raw: Column) -> Column:
    """struct<title, sidebar_position, draft>: flat blocks natively, others as YAML where PyYAML is installed."""
    try:
        import yaml  # noqa: F401
    except ImportError:
        return md.frontmatter(raw)
    block = md.frontmatter_block(raw)
    general = yaml_frontmatter(F.when(~md.flat_block(block), block))
    native = md.frontmatter(raw)
    flat = md.flat_block(block)
    return F.struct(*[F.when(flat, native[c]).otherwise(general[c]).alias(c) for c in ("title", "sidebar_position", "draft")])


def process(files: DataFrame, include_large: bool = False, frontmatter=any_frontmatter) -> DataFrame:
    """Raw files (rel_path, raw, size_bytes, ...) to documents: size guard, YAML block, drafts, component syntax, empties."""
    kept = files.filter(size_guard(F.col("size_bytes"), include_large)).withColumn("_front", frontmatter(F.col("raw")))
    kept = kept.filter(published(F.col("_front.draft")))
    body = F.array(md.strip_mdx(md.frontmatter_body(F.col("raw"))))
    # exploding an array of one or none keeps the filter from computing the body a second time
    rows = kept.select("*", "_front.title", "_front.sidebar_position", "_front.draft", F.explode(F.filter(body, lambda c: js_trim(c) != "")).alias("content"))
    return rows.drop("_front", "raw")


def discover(files: DataFrame) -> DataFrame:
    """A project's usable files: its README first, then the first documentation folder with any, else all others.

    ``files`` has doc_set and rel_path of processed files; adds ``rank`` (0: README) and keeps paths relative to the folder."""
    first = F.substring_index("rel_path", "/", 1)
    rank = F.lit(9)
    for n, folder in reversed([*enumerate(DOC_FOLDERS, 1)]):
        rank = F.when((first == folder) & F.contains("rel_path", F.lit("/")), n).otherwise(rank)
    top_readme = F.col("rel_path").rlike(README) & ~F.contains("rel_path", F.lit("/"))
    by_set = Window.partitionBy("doc_set")
    rows = files.withColumn("_readme", F.when(top_readme, F.col("rel_path")))
    rows = rows.withColumn("_readme", F.min("_readme").over(by_set)).withColumn("rank", F.when(F.col("rel_path").eqNullSafe(F.col("_readme")), 0).otherwise(rank))
    best = F.min(F.when(F.col("rank") > 0, F.col("rank"))).over(by_set)
    rows = rows.withColumn("_best", best).filter((F.col("rank") == 0) | (F.col("rank") == F.col("_best")))
    inside = F.when((F.col("rank") > 0) & (F.col("rank") < 9), F.regexp_replace("rel_path", "^[^/]*/", "")).otherwise(F.col("rel_path"))
    return rows.withColumn("rel_path", inside).drop("_readme", "_best")


def _documents(spark: SparkSession, path: str, doc_set: str, include_large: bool, frontmatter) -> DataFrame:  # noqa: ANN001
    """The documents of a folder, in no order.

    A local folder is listed by ``quire_documents``, which skips links, hidden and package folders as it goes; stores without links by Spark's binary source."""
    root = path.rstrip("/")
    if folders.local_folder(root) is not None:
        folders.register(spark)
        limit = {} if include_large else {"most_bytes": str(MOST_BYTES)}
        rows = spark.read.format("quire_documents").options(**limit).load(root)
    else:
        found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", GLOB).load(root)
        rows = found.withColumn("rel_path", F.regexp_replace(F.substring_index("path", root, -1), "^/+", ""))
        rows = rows.withColumn("name", F.element_at(F.split("rel_path", "/", -1), -1)).filter(walkable(F.col("rel_path")) & size_guard(F.col("length"), include_large))
    rows = rows.filter(usable_name(F.col("name")))
    rows = rows.select(F.lit(doc_set).alias("doc_set"), "rel_path", F.col("length").alias("size_bytes"), F.decode("content", "UTF-8").alias("raw"))
    return process(rows, include_large, frontmatter)


def _ordered(documents: DataFrame, order) -> DataFrame:  # noqa: ANN001
    """Documents as ``order`` places them by path and position. They are written once; only their names are sorted, contents are joined."""
    written = materialize(documents.withColumn("_own", F.col("rel_path")), "documents")
    places = order(written.select("doc_set", "rel_path", "sidebar_position", "_own"))
    return written.drop("rel_path").join(places.select("doc_set", "_own", "rel_path", "file_ord"), ["doc_set", "_own"]).select(*documents.columns, "file_ord")


def scan_folder(spark: SparkSession, path: str, doc_set: str = "docs", include_large: bool = False, frontmatter=any_frontmatter) -> DataFrame:
    """The documents of a folder in order: doc_set, file_ord, rel_path, title, sidebar_position, draft, content."""
    return _ordered(_documents(spark, path, doc_set, include_large, frontmatter), depth_first)


def _project(documents: DataFrame, path: str) -> DataFrame:
    def order(names: DataFrame) -> DataFrame:
        chosen = discover(names)
        return chosen.filter("rank = 0").withColumn("file_ord", F.lit(0)).unionByName(depth_first(chosen.filter("rank > 0")))

    out = _ordered(documents, order)
    if out.isEmpty():
        raise EmptyFileSet([*(f"{path}/{folder}" for folder in DOC_FOLDERS), path])
    return out


def scan_project(spark: SparkSession, path: str, doc_set: str = "docs", include_large: bool = False, frontmatter=any_frontmatter) -> DataFrame:
    """README first, then the documentation folder or the rest of the project; raises if nothing is usable."""
    return _project(_documents(spark, path, doc_set, include_large, frontmatter), path)


def scan_file(spark: SparkSession, path: str, doc_set: str = "docs", include_large: bool = False, frontmatter=any_frontmatter) -> DataFrame:
    """One Markdown file; raises if it is filtered out."""
    rows = spark.read.format("binaryFile").load(path)
    rows = rows.select(F.lit(doc_set).alias("doc_set"), F.element_at(F.split("path", "/", -1), -1).alias("rel_path"), F.col("length").alias("size_bytes"), F.decode("content", "UTF-8").alias("raw"))
    out = process(rows, include_large, frontmatter).withColumn("file_ord", F.lit(1))
    if out.isEmpty():
        raise EmptyFileSet([path])
    return out


def scan_local(spark: SparkSession, path: str, doc_set: str = "docs", **options) -> DataFrame:
    """A local source: a file is itself, a folder a project; a symbolic link is refused."""
    where = Path(path)
    if where.is_symlink():
        raise LinkedSource(f"{path} is a symbolic link; name the folder it leads to")
    if not where.exists():
        raise FileNotFoundError(path)
    resolved = str(where.resolve())
    return scan_file(spark, resolved, doc_set, **options) if where.is_file() else scan_project(spark, resolved, doc_set, **options)


def scan_objects(spark: SparkSession, clone: repositories.Clone, subpath: str | None, doc_set: str = "docs", include_large: bool = False, frontmatter=any_frontmatter, most_files: int = 5000, most_bytes: int = 104857600) -> DataFrame:
    """The documents of a commit, from the listing of its objects: what can't be sliced is never fetched, and what is too large never read.

    Names decide which files are wanted and their number is checked before a blob is fetched, their sizes before one is read. At that point
    it isn't known which of them are drafts, so only what exceeds a cap ``CERTAIN`` times is refused there; ``within_caps`` counts documents exactly."""
    listed, single = clone.files(subpath)
    wanted = [o for o in listed if re.search(PLAIN_EXTENSION, o.path.rsplit("/", 1)[-1])]
    names = spark.createDataFrame([(o.path, o.oid) for o in wanted], "rel_path string, oid string")
    names = names.filter(walkable(F.col("rel_path")) & usable_name(F.element_at(F.split("rel_path", "/", -1), -1)))
    objects = {r["rel_path"]: r["oid"] for r in names.collect()}
    if len(objects) > CERTAIN * most_files:
        raise SourceTooLarge(f"{doc_set} has {len(objects)} files; the cap is {most_files}")
    sizes = clone.fetch(sorted(set(objects.values())))
    rows = [(path, oid, sizes[oid]) for path, oid in objects.items() if include_large or sizes[oid] <= MOST_BYTES]
    if sum(size for _, _, size in rows) > CERTAIN * most_bytes:
        raise SourceTooLarge(f"{doc_set} has {sum(size for _, _, size in rows)} bytes; the cap is {most_bytes}")
    raw = repositories.read_objects(spark.createDataFrame(rows, "rel_path string, oid string, size_bytes long"), clone)
    documents = process(raw.select(F.lit(doc_set).alias("doc_set"), "rel_path", "size_bytes", F.decode("content", "UTF-8").alias("raw")), include_large, frontmatter)
    if single:
        out = documents.withColumn("file_ord", F.lit(1))
        if out.isEmpty():
            raise EmptyFileSet([subpath or clone.url])
        return out
    return _project(documents, subpath or clone.url)


def within_caps(files: DataFrame, most_files: int = 5000, most_bytes: int = 104857600) -> DataFrame:
    """The same files; raises if a doc set exceeds its caps."""
    over = caps(files, most_files, most_bytes).filter("NOT within_caps").first()
    if over:
        raise SourceTooLarge(f"{over['doc_set']} has {over['n_files']} files of {over['n_bytes']} bytes; the caps are {most_files} and {most_bytes}")
    return files
