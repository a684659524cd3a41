"""Document folders as a data source of Spark.

``spark.read.format("quire_documents").load(path)`` has a row a file: rel_path, name, length, modified, content. Folders are its partitions: the
driver lists only the first levels, until there are enough folders to go round, and tasks list the rest. Links are never followed, hidden
and package folders never entered, while listing, so neither the driver nor the plan grows with what is left out. Options push size and place
into the listing: files that fail them aren't opened, and folders that can't hold wanted paths aren't entered. (Spark's own push-down of filters to Python sources
isn't used: in 4.1 a frame that was filtered once keeps the pushed filters for its next, unfiltered use.)

As a stream it remembers what it has seen in snapshots, listings of path, length and modification time. A batch has the files that are new
or changed since the last snapshot, and a row with null content for each that is gone; nothing else is opened.

Options: ``path``; ``names`` (a regular expression, Markdown files by default); ``most_bytes``; ``below`` (a prefix of paths); ``content`` (``false`` leaves it null and opens nothing);
``partitions`` (how many folders are enough, 64); ``snapshots`` (a folder, for streams); ``files_per_task`` (for streams, 200).
Folders must be visible to all executors at the same path.
"""

from __future__ import annotations

import json
import os
import re
import stat
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import datasource as ds

SCHEMA = "rel_path string, name string, length long, modified timestamp, content binary"
NAMES = r"(?i)\.(md|mdx|markdown)$"
PACKAGES = "node_modules"
@dataclass(frozen=True)
class Found:
    """A file as listed."""

    rel_path: str
    name: str
    length: int
    modified: int  # nanoseconds


@dataclass
class Listing:
    """Which files below a root are wanted."""

    root: str
    names: str = NAMES
    most_bytes: int | None = None
    below: str = ""

    def wanted(self, found: Found) -> bool:
        return (self.most_bytes is None or found.length <= self.most_bytes) and found.rel_path.startswith(self.below)

    def enters(self, folder: str) -> bool:
        """Whether a folder may hold wanted paths."""
        return f"{folder}/".startswith(self.below) or self.below.startswith(f"{folder}/")

    def folder(self, relative: str) -> tuple[list[str], list[Found]]:
        """(subfolders to enter, wanted files) of one folder."""
        folders, files = [], []
        pattern = re.compile(self.names)
        with os.scandir(os.path.join(self.root, relative) if relative else self.root) as entries:
            for entry in entries:
                if entry.name.startswith(".") or entry.is_symlink():
                    continue
                path = f"{relative}/{entry.name}" if relative else entry.name
                if entry.is_dir(follow_symlinks=False):
                    if entry.name != PACKAGES and self.enters(path):
                        folders.append(path)
                elif entry.is_file(follow_symlinks=False) and pattern.search(entry.name):
                    about = entry.stat(follow_symlinks=False)
                    found = Found(path, entry.name, about.st_size, about.st_mtime_ns)
                    if self.wanted(found):
                        files.append(found)
        return sorted(folders), sorted(files, key=lambda f: f.rel_path)

    def tree(self, relative: str) -> Iterator[Found]:
        waiting = [relative]
        while waiting:
            folders, files = self.folder(waiting.pop())
            yield from files
            waiting += reversed(folders)

    def read(self, found: Found) -> bytes | None:
        """A file's bytes; None if it is gone or has become a link."""
        try:
            handle = os.open(os.path.join(self.root, found.rel_path), os.O_RDONLY | getattr(os, "O_NOFOLLOW", 0))
        except OSError:
            return None
        with os.fdopen(handle, "rb") as file:
            return file.read() if stat.S_ISREG(os.fstat(handle).st_mode) else None


def _time(nanoseconds: int) -> datetime:
    return datetime.fromtimestamp(nanoseconds // 1000 / 1_000_000, UTC)


class Folders(ds.InputPartition):
    """A folder's own files, or all below it."""

    def __init__(self, relative: str, deep: bool):
        self.relative, self.deep = relative, deep


class Files(ds.InputPartition):
    """Files to read, and paths that are gone."""

    def __init__(self, files: list[Found], gone: list[str]):
        self.files, self.gone = files, gone


class FolderReader(ds.DataSourceReader):
    def __init__(self, listing: Listing, content: bool, enough: int):
        self.listing, self.content, self.enough = listing, content, enough

    def partitions(self) -> list[ds.InputPartition]:
        level, out = [""], []
        while level and len(level) < self.enough:
            below = []
            for relative in level:
                folders, files = self.listing.folder(relative)
                below += folders
                if files:
                    out.append(Folders(relative, deep=False))
            level = below
        return out + [Folders(relative, deep=True) for relative in level]

    def read(self, partition: Folders | None) -> Iterator[tuple]:
        if partition is None:  # what Spark passes where there are no partitions
            return
        found = self.listing.tree(partition.relative) if partition.deep else self.listing.folder(partition.relative)[1]
        for file in found:
            data = self.listing.read(file) if self.content else None
            if data is not None or not self.content:
                yield file.rel_path, file.name, file.length, _time(file.modified), data


class FolderStream(ds.DataSourceStreamReader):
    """Offsets are numbers of snapshots."""

    def __init__(self, listing: Listing, snapshots: str, files_per_task: int):
        self.listing, self.folder, self.size = listing, Path(snapshots), files_per_task

    def _snapshot(self, number: int) -> dict[str, Found]:
        if not number:
            return {}
        return {x[0]: Found(*x) for x in json.loads((self.folder / f"{number}.json").read_text())}

    def _last(self) -> int:
        return max((int(p.stem) for p in self.folder.glob("*.json")), default=0)

    def initialOffset(self) -> dict:  # noqa: N802
        return {"snapshot": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        last = self._last()
        now = {f.rel_path: f for f in self.listing.tree("")}
        if now != self._snapshot(last) or not last:
            last += 1
            self.folder.mkdir(parents=True, exist_ok=True)
            fresh = self.folder / f".{last}"
            fresh.write_text(json.dumps([[f.rel_path, f.name, f.length, f.modified] for f in now.values()]))
            os.replace(fresh, self.folder / f"{last}.json")
        return {"snapshot": last}

    def partitions(self, start: dict, end: dict) -> list[ds.InputPartition]:
        before, now = self._snapshot(start["snapshot"]), self._snapshot(end["snapshot"])
        changed = sorted((f for p, f in now.items() if before.get(p) != f), key=lambda f: f.rel_path)
        parts = [Files(changed[i : i + self.size], []) for i in range(0, len(changed), self.size)]
        gone = sorted(before.keys() - now.keys())
        return parts + [Files([], gone)] if gone or not parts else parts

    def read(self, partition: Files) -> Iterator[tuple]:
        for file in partition.files:
            yield file.rel_path, file.name, file.length, _time(file.modified), self.listing.read(file)
        for path in partition.gone:
            yield path, path.rsplit("/", 1)[-1], None, None, None

    def commit(self, end: dict) -> None:
        """Snapshots before the committed one are needed no more, but for the last, which a restart may begin from."""
        for path in self.folder.glob("*.json"):
            if int(path.stem) < end["snapshot"] - 1:
                path.unlink(missing_ok=True)


class DocumentFolder(ds.DataSource):
    @classmethod
    def name(cls) -> str:
        return "quire_documents"

    def schema(self) -> str:
        return SCHEMA

    def _listing(self) -> Listing:
        root = local_folder(self.options["path"])
        if root is None:
            raise ValueError(f"{self.options['path']} isn't a local folder")
        most = self.options.get("most_bytes")
        return Listing(root, self.options.get("names", NAMES), int(most) if most else None, self.options.get("below", ""))

    def reader(self, schema) -> FolderReader:  # noqa: ANN001
        return FolderReader(self._listing(), self.options.get("content", "true").lower() != "false", int(self.options.get("partitions", 64)))

    def streamReader(self, schema) -> FolderStream:  # noqa: ANN001, N802
        return FolderStream(self._listing(), local_folder(self.options["snapshots"]) or self.options["snapshots"], int(self.options.get("files_per_task", 200)))


def local_folder(path: str) -> str | None:
    """The plain path of a local one; None for other stores."""
    plain = re.sub("^file:(//)?(?=/)", "", path)
    return None if "://" in plain else plain


def register(spark: SparkSession) -> None:
    """Makes the source known to a session."""
    from quire.runtime import ship_code

    ship_code(spark)
    spark.dataSource.register(DocumentFolder)
