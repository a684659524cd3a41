"""Doc sets from source to disk: slice, add, refresh, list, doctor, remove.

A source is a local path or a repository URL. Slicing is DataFrames throughout; what reaches the driver is one doc set's generated
files, bounded by its caps, and the registry, a row for each doc set.
"""

from __future__ import annotations

import contextlib
import hashlib
import os
import threading
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import UTC, datetime
from pathlib import Path

from pyspark import InheritableThread
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.text import slug
from quire.operators import catalog, order, plan, render, scan, tree
from quire.runtime import materialize
from quire.sources import files, repositories, store, urls
from quire.streaming import refresh as policy
from quire.streaming.snapshot import Snapshot

ENGINE_VERSION, SLICER_VERSION, CHECK_INTERVAL_HOURS, HOOK_TIMEOUT_SECONDS = "1.0.0", 1, 24, 20
DOC_SET, SOURCE_TYPE = "docs", store.SOURCE


@dataclass
class Sliced:
    """A doc set on its way to disk; ``source`` is what its record says of it."""

    source: dict
    tracked_ref: str | None
    pinned_sha: str | None
    title: str
    label: str
    name: str
    description: str
    source_hash: str
    files: DataFrame
    tree: tree.Tree
    plan: DataFrame
    emitted: DataFrame
    findings: DataFrame

    def preview(self) -> list[str]:
        """Name, description, planned files and findings, as lines."""
        named = self.plan.withColumn("doc_set", F.lit(self.name))
        rows = catalog.preview(named, self.findings.withColumn("doc_set", F.lit(self.name)), F.lit(self.description))
        return [r["line"] for r in rows.orderBy("at").collect()]

    def oversized(self) -> list[str]:
        return [r["relative_path"] for r in self.plan.filter("oversized OR oversized_index").orderBy("oversized_index", "emit_ord").collect()]


class TimedOut(TimeoutError):
    """A step took longer than it may."""


class Step:
    """Work with a time limit. What it publishes, it publishes in time: after the limit ``publishing`` raises, and what has begun is waited for."""

    def __init__(self) -> None:
        self._lock = threading.Lock()
        self._late = self._published = False

    @contextlib.contextmanager
    def publishing(self) -> Iterator[None]:
        with self._lock:
            if self._late:
                raise TimedOut("too late to publish")
            yield
            self._published = True

    def end(self) -> bool:
        """The limit is reached; whether something was published before."""
        with self._lock:
            self._late = True
            return self._published


def limited(spark: SparkSession, seconds: float, work: Callable):
    """What ``work``, called with its step, returns. After ``seconds`` its jobs, and those it would still start, are cancelled and it counts as failed,
    unless it has published: then what is left of it is waited for."""
    got: list = []
    step, group = Step(), f"quire-{os.urandom(6).hex()}"

    def run() -> None:
        spark.sparkContext.setJobGroup(group, "limited", interruptOnCancel=True)
        try:
            got.append((True, work(step)))
        except Exception as error:  # noqa: BLE001 - handed on to the caller
            got.append((False, error))

    thread = InheritableThread(target=run, daemon=True)
    thread.start()
    thread.join(seconds)
    if not got:
        if step.end():
            thread.join()
        else:
            spark.sparkContext._jsc.sc().cancelJobGroupAndFutureJobs(group)
            raise TimedOut(f"took longer than {seconds} seconds")
    fine, value = got[0]
    if fine:
        return value
    raise value


def parse_source(spark: SparkSession, text: str) -> tuple[dict, str | None]:
    """(source, ref): a repository where the text is an allowed URL, else a local path."""
    one = spark.createDataFrame([(text,)], "raw string")
    found = one.select(urls.parse_repository_url(F.col("raw")).alias("p"), catalog.local_kind(F.col("raw")).alias("kind")).first()
    if found["p"]:
        return {"type": "github", "url": found["p"]["url"], "subpath": found["p"]["subpath"]}, found["p"]["ref"]
    return {"type": "path", "path": os.path.abspath(text), "kind": found["kind"]}, None


def read_doc_set(
    spark: SparkSession, source: dict, pinned_sha: str | None = None, include_large: bool = False, most_files: int = 5000, most_bytes: int = 104857600, run: repositories.Runner = repositories.run_git
) -> DataFrame:
    """The documents of a source, within its caps. A clone is read while it lasts."""
    if source["type"] == "path":
        return files.within_caps(files.scan_local(spark, source["path"], DOC_SET, include_large=include_large), most_files, most_bytes)
    sha = pinned_sha or repositories.head_of(source["url"], None, run)
    with repositories.cloned(spark, source["url"], sha, run) as clone:
        found = files.scan_objects(spark, clone, source.get("subpath"), DOC_SET, include_large, most_files=most_files, most_bytes=most_bytes)
        return materialize(files.within_caps(found, most_files, most_bytes), "clone")


def _labels(spark: SparkSession, source: dict) -> tuple[str, str, str]:
    """(title, label, name) of a source."""
    row = spark.createDataFrame([(source,)], f"source {SOURCE_TYPE}")
    title = catalog.title(F.col("source"))
    return tuple(row.select(title.alias("t"), catalog.source_label(F.col("source")).alias("l"), slug(title).alias("n")).first())


def _build(spark: SparkSession, found: DataFrame, root_name: str, budget: int) -> tuple[tree.Tree, DataFrame]:
    sized = tree.sized_tree(found, root_name)
    return sized, materialize(plan.plan_emission(sized.nodes, budget), "plan")


def slice_docs(
    spark: SparkSession, source: str, budget: int = plan.BUDGET, name: str | None = None, description: str | None = None, include_large: bool = False, run: repositories.Runner = repositories.run_git, **limits: int
) -> Sliced:
    """Reads, plans, renders and scans a source; writes nothing. ``limits``: most_files, most_bytes."""
    parsed, ref = parse_source(spark, source)
    sha = repositories.head_of(parsed["url"], ref, run) if parsed["type"] == "github" else None
    found = materialize(read_doc_set(spark, parsed, sha, include_large, run=run, **limits), "files")
    title, label, default = _labels(spark, parsed)
    sized, planned = _build(spark, found, title, budget)
    name = name or default
    if description is None:
        top = sized.nodes.filter(F.size("path") > 0).filter(F.size("parent_path") == 0).orderBy("path").select("name")
        names = [r["name"] for r in top.collect()]
        one = spark.createDataFrame([(title, label, names)], "t string, l string, n array<string>")
        description = one.select(catalog.default_description(F.col("t"), F.col("l"), F.col("n"))).first()[0]
    emitted = materialize(render.render(planned, sized, F.lit(name), F.lit(description), F.lit(label)), "emitted")
    digest = order.fileset_hash(found, SLICER_VERSION, budget, include_large).first()["source_hash"]
    return Sliced(parsed, (ref or "HEAD") if sha else None, sha, title, label, name, description, digest, found, sized, planned, emitted, scan.scan(emitted))


def _written(record: dict) -> dict:
    """A record as its file has it, from the row it was read into."""
    kept = {k: v for k, v in record.items() if k not in ("skill_path", "violations") and not (k == "oversized" and not v)}
    return kept | {"source": {k: record["source"].get(k) for k in store.SOURCE_TYPES[record["source"]["type"]]}, "token_budget": int(record["token_budget"])}


class Refused(RuntimeError):
    """A safety check stopped an operation; nothing was changed."""


@dataclass
class Library:
    """Doc sets under ``home`` (personal) and ``project``, with one registry."""

    spark: SparkSession
    home: Path
    project: Path
    folder: str = ".skills"
    run: repositories.Runner = repositories.run_git
    now: Callable[[], datetime] = lambda: datetime.now(UTC)
    hook_seconds: float = HOOK_TIMEOUT_SECONDS  # for each step of a startup hook's run
    snapshots: str | None = None  # a folder all executors see: unchanged local folders are then known by their listing

    def __post_init__(self) -> None:
        self.home, self.project = Path(self.home).resolve(), Path(self.project).resolve()

    @property
    def registry_path(self) -> Path:
        return self.home / ".quire" / "registry.json"

    def roots(self) -> dict[str, Path]:
        return {"personal": self.home / self.folder, "project": self.project / self.folder}

    def path_of(self, scope: str, name: str) -> Path:
        if not self.spark.createDataFrame([(name,)], "n string").select(catalog.valid_name(F.col("n"))).first()[0]:
            raise Refused(f"{name!r} isn't a valid name: lower-case letters, digits and hyphens, 64 at most")
        return self.roots()[scope] / name

    def registry(self) -> DataFrame:
        return store.load_registry(self.spark, self.registry_path)

    def record(self, path: Path) -> dict | None:
        """The record of a doc set if it is there and valid."""
        file = path / store.RECORD_FILE
        if not file.is_file():
            return None
        raw = self.spark.createDataFrame([(str(path), file.read_text(encoding="utf-8"))], "skill_path string, json string")
        row = store.parse_records(raw).first()
        return None if row["violations"] else row.asDict(recursive=True)

    def records(self) -> DataFrame:
        """skill_path and the record's columns of all registered doc sets that have a file of that name."""
        rows = []
        for entry in self.registry().collect():
            file = Path(entry["skill_path"]) / store.RECORD_FILE
            if file.is_file():
                rows.append((entry["skill_path"], file.read_text(encoding="utf-8")))
        return store.parse_records(self.spark.createDataFrame(rows, "skill_path string, json string")).filter("size(violations) = 0").drop("violations")

    def _write(self, path: Path, emitted: DataFrame, record: dict, step: Step | None = None) -> dict:
        generated = [(r["relative_path"], r["content"]) for r in emitted.orderBy("emit_ord").collect()]  # one doc set, within its caps
        record = record | {"last_refresh": self.now().isoformat(), "generated_files": [*(p for p, _ in generated), store.RECORD_FILE]}
        record = {k: v for k, v in record.items() if k != "oversized" or v}
        text = store.checked_record(self.spark, record)
        with (step or Step()).publishing():
            store.write_tree(path, iter([*generated, (store.RECORD_FILE, text)]))
        return record

    def add(
        self, source: str, scope: str = "personal", name: str | None = None, description: str | None = None, budget: int = plan.BUDGET, include_large: bool = False,
        force: bool = False, accept_findings: bool = False, hook: bool = True, **limits: int,
    ) -> tuple[Path, Sliced]:
        """Slices a source and writes it, its record, its registry entry and, where wanted, the startup hook.

        Findings stop it unless accepted; a doc set of another source under the same name unless forced."""
        sliced = slice_docs(self.spark, source, budget, name, description, include_large, self.run, **limits)
        path = self.path_of(scope, sliced.name)
        if not accept_findings and not sliced.findings.isEmpty():
            raise Refused("suspicious lines in the generated files; look at the preview and accept them to go on")
        there = self.record(path)
        if there and not force and not self._same_source(there["source"], sliced.source):
            raise Refused(f"another source already has the name {sliced.name!r} ({scope}); force to replace it")
        record = {
            "engine_version": ENGINE_VERSION, "slicer_version": SLICER_VERSION, "name": sliced.name, "source": sliced.source, "tracked_ref": sliced.tracked_ref, "pinned_sha": sliced.pinned_sha,
            "source_hash": sliced.source_hash, "token_budget": budget, "include_large": include_large, "check_interval_hours": CHECK_INTERVAL_HOURS, "oversized": sliced.oversized(),
        }
        self._write(path, sliced.emitted, record)
        entry = [(sliced.name, str(path), scope, self.now(), False)]
        store.update_registry(self.spark, self.registry_path, lambda known: catalog.upsert(known, self.spark.createDataFrame(entry, store.REGISTRY_SCHEMA)))
        if hook:
            self.install_hook(scope)
        return path, sliced

    def _same_source(self, a: dict, b: dict) -> bool:
        keys = ("type", "url", "subpath", "path", "kind")
        row = self.spark.createDataFrame([tuple({k: s.get(k) for k in keys} for s in (a, b))], f"a {SOURCE_TYPE}, b {SOURCE_TYPE}")
        return bool(row.select(catalog.sources_match(F.col("a"), F.col("b"))).first()[0])

    def settings_path(self, scope: str) -> Path:
        return (self.home if scope == "personal" else self.project) / ".quire" / "settings.json"

    def install_hook(self, scope: str = "personal") -> bool:
        return store.install_hook(self.settings_path(scope))

    def regenerate(self, entry: dict, record: dict, found: DataFrame, source_hash: str, sha: str | None, step: Step | None = None) -> None:
        """Plans, renders and writes a doc set anew under its record's settings; past a step's limit nothing is written."""
        label = _labels(self.spark, record["source"])[1]
        found = materialize(found, "files")
        sized, planned = _build(self.spark, found, record["name"], int(record["token_budget"]))
        description = f"Reference documentation for {record['name']}, sliced from {label}."
        emitted = render.render(planned, sized, F.lit(record["name"]), F.lit(description), F.lit(label))
        self._write(Path(entry["skill_path"]), emitted, _written(record) | {"source_hash": source_hash, "pinned_sha": sha}, step)

    def _fingerprint(self, record: dict, sha: str | None = None) -> tuple[DataFrame, str]:
        found = materialize(read_doc_set(self.spark, record["source"], sha, record["include_large"], run=self.run), "files")
        return found, order.fileset_hash(found, SLICER_VERSION, int(record["token_budget"]), record["include_large"]).first()["source_hash"]

    def _snapshot(self, record: dict) -> Snapshot | None:
        """The snapshot of a local folder, if snapshots are kept."""
        if not self.snapshots or record["source"]["type"] != "path" or record["source"]["kind"] == "file":
            return None
        key = hashlib.sha256(f"{record['source']['path']}\0{record['include_large']}".encode()).hexdigest()[:32]
        return Snapshot(self.spark, record["source"]["path"], f"{self.snapshots.rstrip('/')}/{key}", record["include_large"])

    def _root(self, record: dict) -> str | None:
        """The root digest of a local folder's snapshot, brought up to date; only new and changed files are read."""
        snapshot = self._snapshot(record)
        if snapshot is None or not Path(record["source"]["path"]).is_dir():
            return None
        snapshot.update()
        return snapshot.root_digest(SLICER_VERSION, int(record["token_budget"]))

    def _known_root(self, entry: dict) -> Path:
        return self.home / ".quire" / "roots" / hashlib.sha256(entry["skill_path"].encode()).hexdigest()[:32]

    def _unread(self, entry: dict, record: dict) -> tuple[bool, str | None]:
        """(whether the snapshot knows that nothing changed since the record's fingerprint was taken, the root digest)."""
        root = self._root(record)
        if root is None:
            return False, None
        known = self._known_root(entry)
        return known.is_file() and known.read_text() == f"{record['source_hash']} {root}", root

    def _keep_root(self, entry: dict, source_hash: str, root: str | None) -> None:
        if root is not None:
            store.write_atomic(self._known_root(entry), f"{source_hash} {root}")

    def evaluate_local(self, entry: dict, record: dict) -> tuple[str, DataFrame | None, str | None, str | None]:
        """(stale, unchanged or changed, the files and their fingerprint where they were read, the root digest where there is one)."""
        try:
            unread, root = self._unread(entry, record)
            if unread:
                return "unchanged", None, None, root
            found, now = self._fingerprint(record)
        except Exception:  # noqa: BLE001 - whatever is wrong with the source, the doc set is stale
            return "stale", None, None, None
        if now == record["source_hash"]:
            self._keep_root(entry, now, root)
            return "unchanged", found, now, root
        return "changed", found, now, root

    def rebuild_local(self, entry: dict, record: dict, evaluated: tuple, step: Step | None = None) -> str:
        _, found, now, root = evaluated
        if found is None:
            found, now = self._fingerprint(record)
        self.regenerate(entry, record, found, now, record["pinned_sha"], step)
        self._keep_root(entry, now, root)
        return "regenerated"

    def refresh_local(self, entry: dict, record: dict, force: bool = False) -> str:
        evaluated = self.evaluate_local(entry, record)
        if evaluated[0] == "stale" or (evaluated[0] == "unchanged" and not force):
            return evaluated[0]
        return self.rebuild_local(entry, record, evaluated)

    def refresh_remote(self, entry: dict, record: dict, update: bool = False, step: Step | None = None) -> str:
        """Compares heads, and with ``update`` reads the head's files and pins it. A moved head without it leaves the record as it is."""
        try:
            sha = repositories.head_of(record["source"]["url"], record["tracked_ref"], self.run)
            found, now = self._fingerprint(record, sha) if update else (None, None)
        except Exception:  # noqa: BLE001 - as above
            return "stale"
        if update:
            self.regenerate(entry, record, found, now, sha)
            return "regenerated"
        if sha != record["pinned_sha"]:
            return "update-available"
        text = store.checked_record(self.spark, _written(record) | {"last_refresh": self.now().isoformat()})
        with (step or Step()).publishing():
            store.write_atomic(Path(entry["skill_path"]) / store.RECORD_FILE, text)
        return "unchanged"

    def refresh(self, name: str | None = None, update: bool = False, force: bool = False, hook: bool = False) -> dict[tuple[str, str], str]:
        """status by (scope, name): unchanged, regenerated, update-available, stale or skipped; applied to the registry.

        As a startup hook: only eligible entries, remote ones only when their interval is over, of changed local ones the oldest few. Each step (evaluation, rebuild) has
        a time limit of its own; an entry that fails or is late is stale, and the others go on."""
        entries = [r.asDict() for r in self.registry().collect() if name in (None, r["name"])]
        records = {r["skill_path"]: r.asDict(recursive=True) for r in self.records().collect()}
        out = self._hook_run(entries, records) if hook else {}
        if not hook:
            for entry in entries:
                record = records.get(entry["skill_path"])
                if record is None:
                    out[entry["scope"], entry["name"]] = "stale"
                else:
                    local = record["source"]["type"] == "path"
                    out[entry["scope"], entry["name"]] = self.refresh_local(entry, record, force) if local else self.refresh_remote(entry, record, update)
        if out:
            outcomes = self.spark.createDataFrame([(*k, s) for k, s in out.items()], "scope string, name string, status string")
            store.update_registry(self.spark, self.registry_path, lambda known: catalog.apply_outcomes(known, outcomes, F.lit(self.now())).select(*known.columns))
        return out

    def _hook_run(self, entries: list[dict], records: dict[str, dict]) -> dict[tuple[str, str], str]:
        registry, known = self.registry(), self.records().drop("name")
        plan_rows = policy.hook_plan(registry, known.withColumn("changed", F.lit(False)), str(self.project), F.lit(self.now()))
        wanted = {(r["scope"], r["name"]): r["action"] for r in plan_rows.collect()}  # local ones are to be evaluated first
        out: dict[tuple[str, str], str] = {}
        pending: dict[tuple[str, str], tuple[dict, dict, tuple]] = {}
        for entry in entries:
            key, record = (entry["scope"], entry["name"]), records.get(entry["skill_path"])
            if record is None:
                out[key] = "stale"
            elif wanted.get(key) in (None, "skip"):
                out[key] = "skipped"
            elif record["source"]["type"] != "path":
                out[key] = self._limited(lambda step, e=entry, r=record: self.refresh_remote(e, r, step=step)) or "stale"
            else:
                evaluated = self._limited(lambda _, e=entry, r=record: self.evaluate_local(e, r))
                out[key] = evaluated[0] if evaluated else "stale"
                if out[key] == "changed":
                    pending[key] = (entry, record, evaluated)
        if pending:
            rows = self.spark.createDataFrame([(*key, r["last_refresh"]) for key, (_, r, _) in pending.items()], "scope string, name string, last_refresh timestamp")
            first = {(r["scope"], r["name"]) for r in catalog.oldest(rows, policy.HOOK_LIMIT).collect()}
            for key, (entry, record, evaluated) in pending.items():
                rebuilt = key in first and self._limited(lambda step, e=entry, r=record, x=evaluated: self.rebuild_local(e, r, x, step))
                out[key] = (rebuilt or "stale") if key in first else "skipped"
        return out

    def _limited(self, work: Callable):
        """What a step returns; None where it failed or was late. One entry's failure stops no other."""
        try:
            return limited(self.spark, self.hook_seconds, work)
        except Exception:  # noqa: BLE001 - as above
            return None

    def listing(self) -> list[str]:
        """The registry as a table of text."""
        rows = catalog.listing(self.registry(), self.records().drop("name"), F.lit(self.now()))
        columns = ["name", "source", "scope", "pinned", "last_refresh", "staleness", "update_available"]
        return [r["line"] for r in catalog.table_lines(rows, columns, ["name", "scope"]).orderBy("line_no").collect()]

    def doctor(self) -> list[tuple[str, str, str]]:
        """Rebuilds the registry from the records on disk; returns (change, scope, name)."""
        rows = [(str(f.parent), f.read_text(encoding="utf-8")) for root in self.roots().values() if root.is_dir() for f in sorted(root.glob(f"*/{store.RECORD_FILE}")) if not f.parent.is_symlink()]
        records = store.parse_records(self.spark.createDataFrame(rows, "skill_path string, json string"))
        fresh = materialize(store.rebuild_registry(records, str(self.roots()["personal"]), self.now()), "registry")
        changes = sorted(map(tuple, catalog.registry_diff(self.registry(), fresh).collect()))
        store.save_registry(fresh, self.registry_path)
        return changes

    def remove(self, name: str, scope: str | None = None, force: bool = False) -> int:
        """Deletes a doc set's recorded files and its entry; returns how many files. Foreign files refuse it unless forced, and stay."""
        found = [r for r in self.registry().collect() if r["name"] == name and scope in (None, r["scope"])]
        if len(found) != 1:
            raise Refused(f"{len(found)} doc sets are named {name!r}" + ("; say which scope" if found else ""))
        path = Path(found[0]["skill_path"])
        if path.parent not in self.roots().values():
            raise Refused(f"{path} isn't managed here")
        if path.is_symlink() or not path.is_dir():
            raise Refused(f"{path} is a link or isn't there")
        record = self.record(path)
        if record is None:
            raise Refused(f"{path} has no valid record")
        inside = [p for p in path.rglob("*") if p.is_symlink() or not p.is_dir()]
        if any(p.is_symlink() for p in inside):
            raise Refused(f"links inside {path}")
        disk = self.spark.createDataFrame([(str(path), str(p.relative_to(path))) for p in inside], "skill_path string, relative_path string")
        recorded = self.spark.createDataFrame([(str(path), p) for p in record["generated_files"]], disk.schema)
        foreign = sorted(r["relative_path"] for r in catalog.foreign_files(disk, recorded).collect())
        if foreign and not force:
            raise Refused(f"foreign files in {path}: {', '.join(foreign)}; force to delete only the recorded ones")
        gone = store.delete_tracked(path, record["generated_files"])
        keys = self.spark.createDataFrame([(found[0]["scope"], name)], "scope string, name string")
        store.update_registry(self.spark, self.registry_path, lambda known: catalog.drop_entries(known, keys))
        return len(record["generated_files"]) - len(gone)
