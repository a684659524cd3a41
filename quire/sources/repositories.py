"""Remote repositories by the git command, with an injectable runner.

A repository is cloned without its blobs. The listing of a commit's tree says which blobs are wanted; only those are fetched, in one
request for many, and tasks read them through ``cat-file --batch``. The clone lies in the shared folder while it lasts."""

from __future__ import annotations

import contextlib
import os
import re
import subprocess
import tempfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from quire.runtime import materialize, shared_dir, ship_code

TIMEOUT_SECONDS, SHA, FETCH = 120, "[0-9a-f]{40}", 500
SAFE = ["-c", "protocol.ext.allow=never", "-c", "protocol.file.allow=never", "-c", "core.symlinks=false", "-c", "submodule.recurse=false"]
Runner = Callable[[list[str], str | None], tuple[int, str, str]]


class RepositoryError(RuntimeError):
    """A git call failed."""


def environment() -> dict[str, str]:
    """A minimal environment: the path alone, no prompts or password helpers, no configuration of system or user, no large-file filters."""
    keep = {k: os.environ[k] for k in ("PATH",) if k in os.environ}
    return keep | {"GIT_TERMINAL_PROMPT": "0", "GIT_ASKPASS": "", "GIT_CONFIG_NOSYSTEM": "1", "GIT_LFS_SKIP_SMUDGE": "1"}


def run_git(arguments: list[str], folder: str | None = None) -> tuple[int, str, str]:
    """(exit code, output, errors); a timeout or a missing command is a non-zero code."""
    try:
        done = subprocess.run(["git", *arguments], cwd=folder, env=environment(), capture_output=True, text=True, timeout=TIMEOUT_SECONDS)
    except subprocess.TimeoutExpired:
        return 124, "", "timed out"
    except FileNotFoundError as missing:
        return 127, "", str(missing)
    return done.returncode, done.stdout, done.stderr


def _checked(run: Runner, arguments: list[str], folder: str | None = None) -> str:
    code, out, errors = run(arguments, folder)
    if code:
        raise RepositoryError(f"git {next(a for a in arguments if a not in SAFE)} failed ({code}): {errors.strip()[:500]}")
    return out


def head_of(url: str, ref: str | None, run: Runner = run_git) -> str:
    """The commit a ref points to."""
    out = _checked(run, ["ls-remote", "--", url, ref or "HEAD"])
    first = out.split("\n", 1)[0].split("\t")[0].strip()
    if not re.fullmatch(SHA, first):
        raise RepositoryError(f"no commit for {ref or 'HEAD'} of {url}")
    return first


@dataclass(frozen=True)
class Listed:
    """A file of a commit's tree."""

    path: str
    oid: str


@dataclass
class Clone:
    """A bare clone without blobs at one commit."""

    url: str
    sha: str
    folder: str
    run: Runner

    def files(self, subpath: str | None) -> tuple[list[Listed], bool]:
        """(regular files at or below a path of the tree, relative to it; whether the path is itself a file). Links and submodules aren't files."""
        where = "/".join(p for p in (subpath or "").split("/") if p not in ("", "."))
        if ".." in where.split("/"):
            raise RepositoryError(f"{subpath} leaves the repository")
        out = _checked(self.run, [*SAFE, "ls-tree", "-r", "-z", "--full-tree", self.sha, *(["--", where] if where else [])], self.folder)
        found = []
        for line in filter(None, out.split("\0")):
            about, path = line.split("\t", 1)
            mode, kind, oid = about.split(" ")[:3]
            if kind == "blob" and mode in ("100644", "100755", "100664"):
                found.append(Listed(path, oid))
        if not found:
            raise RepositoryError(f"{subpath or 'the commit'} has no files")
        if len(found) == 1 and found[0].path == where:
            return [Listed(where.rsplit("/", 1)[-1], found[0].oid)], True
        return [Listed(f.path.removeprefix(f"{where}/") if where else f.path, f.oid) for f in found], False

    def fetch(self, oids: list[str]) -> dict[str, int]:
        """Fetches blobs, many in a request, and returns their sizes."""
        for i in range(0, len(oids), FETCH):
            _checked(self.run, [*SAFE, "-c", "fetch.negotiationAlgorithm=noop", "fetch", "--no-tags", "--no-write-fetch-head", "--no-recurse-submodules", "--filter=blob:none", "origin", *oids[i : i + FETCH]], self.folder)
        out = _checked(self.run, [*SAFE, "cat-file", "--batch-check=%(objectname) %(objectsize)", "--batch-all-objects"], self.folder)
        sizes = {oid: int(size) for oid, size in (line.split(" ") for line in out.splitlines())}
        missing = [oid for oid in oids if oid not in sizes]
        if missing:
            raise RepositoryError(f"{len(missing)} objects of {self.url} weren't sent")
        return sizes


@contextlib.contextmanager
def cloned(spark: SparkSession, url: str, sha: str, run: Runner = run_git) -> Iterator[Clone]:
    """A shallow clone without blobs at a commit; always removed. No helper protocols, local remotes, links or submodules.

    It lies in the shared folder if that is a local path to all executors, else in the driver's temporary folder, and then blobs are read there."""
    if not re.fullmatch(SHA, sha):
        raise RepositoryError(f"{sha!r} isn't a commit's hash")
    shared = shared_dir(spark)
    parent = re.sub("^file:(//)?(?=/)", "", shared)
    with tempfile.TemporaryDirectory(prefix="quire-clone-", dir=None if "://" in parent else _made(parent)) as folder:
        _checked(run, [*SAFE, "clone", "--bare", "--depth", "1", "--filter=blob:none", "--no-recurse-submodules", "--", url, folder])
        _checked(run, [*SAFE, "fetch", "--depth", "1", "--filter=blob:none", "--no-recurse-submodules", "--", "origin", sha], folder)
        yield Clone(url, sha, folder, run)


def _made(folder: str) -> str:
    os.makedirs(folder, exist_ok=True)
    return folder


def blobs(folder: str, oids: list[str]) -> Iterator[bytes]:
    """Contents of fetched objects, by one process for all of them."""
    process = subprocess.Popen(["git", *SAFE, "cat-file", "--batch"], cwd=folder, env=environment(), stdin=subprocess.PIPE, stdout=subprocess.PIPE)
    try:
        for oid in oids:
            process.stdin.write(f"{oid}\n".encode())
            process.stdin.flush()
            head = process.stdout.readline().split()
            if len(head) != 3 or head[1] != b"blob":
                raise RepositoryError(f"{oid} isn't a blob that is here")
            size = int(head[2])
            yield process.stdout.read(size + 1)[:size]
    finally:
        process.stdin.close()
        process.stdout.close()
        process.kill()
        process.wait()


def read_objects(objects: DataFrame, clone: Clone) -> DataFrame:
    """Adds ``content`` to rows of (rel_path, oid, size_bytes). The result is written down, as the clone goes."""
    spark, folder = objects.sparkSession, clone.folder
    shared = folder.startswith(re.sub("^file:(//)?(?=/)", "", shared_dir(spark)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            oids = batch.column("oid").to_pylist()
            for i, data in enumerate(blobs(folder, oids)):
                yield pa.RecordBatch.from_arrays([*(c.slice(i, 1) for c in batch.columns), pa.array([data], pa.binary())], names=[*batch.schema.names, "content"])

    schema = "rel_path string, oid string, size_bytes long, content binary"
    if shared:
        ship_code(spark)
        rows = objects.repartition(min(64, max(1, spark.sparkContext.defaultParallelism))).mapInArrow(run, schema)
    else:
        found = objects.collect()
        rows = spark.createDataFrame([(*r, data) for r, data in zip(found, blobs(folder, [r["oid"] for r in found]), strict=True)], schema)
    return materialize(rows, "blobs")
