"""Files of generated doc sets: records, the registry and transactional writes, on the driver's file system.

What is written here is small (a record, a registry, one doc set's tree); corpora go through Spark's writers.
"""

from __future__ import annotations

import contextlib
import json
import os
import re
import shutil
import tempfile
import time
from collections.abc import Callable, Iterator
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators.catalog import violations

RECORD_FILE = "record.json"
SOURCE = "struct<type: string, url: string, subpath: string, path: string, kind: string>"
RECORD_SCHEMA = (
    f"engine_version string, slicer_version int, name string, source {SOURCE}"
    ", tracked_ref string, pinned_sha string, source_hash string, token_budget double, include_large boolean,"
    " check_interval_hours double, last_refresh timestamp, generated_files array<string>, oversized array<string>"
)
REGISTRY_SCHEMA = "name string, skill_path string, scope string, last_check timestamp, update_available boolean"
STALE_LOCK_SECONDS, KEPT_REVISIONS = 600, 10
HOOK_COMMAND = "quire refresh --hook"


#: What JSON type each key of a record has; a slash separates types that are both allowed, ? marks a key that may be missing.
RECORD_TYPES = {
    "engine_version": "string", "slicer_version": "integer", "name": "string", "source": "object", "tracked_ref": "string/null", "pinned_sha": "string/null", "source_hash": "string",
    "token_budget": "integer", "include_large": "boolean", "check_interval_hours": "integer/number", "last_refresh": "string", "generated_files": "strings", "oversized": "strings?",
}
SOURCE_TYPES = {"github": {"type": "string", "url": "string", "subpath": "string/null"}, "path": {"type": "string", "path": "string", "kind": "string"}}
OFFSET_TIME = "^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}(:[0-9]{2}([.][0-9]+)?)?(Z|[+-][0-9]{2}:?[0-9]{2})\\z"


def _bound(value: str, name: str, use: str) -> str:
    """SQL that computes a value once and names it: what an expression names again is evaluated again."""
    return f"get(transform(array({value}), {name} -> {use}), 0)"


#: The JSON type of a variant ``__v``; null where there is no value at all. SQL text, as hundreds of small calls would cost seconds to build.
KIND_SQL = _bound("schema_of_variant(__v)", "__t", """CASE WHEN __t = 'VOID' THEN 'null' WHEN __t = 'STRING' THEN 'string' WHEN __t = 'BOOLEAN' THEN 'boolean' WHEN __t LIKE 'OBJECT%' THEN 'object'
  WHEN __t LIKE 'ARRAY%' THEN IF(forall(try_variant_get(__v, '$', 'array<variant>'), x -> schema_of_variant(x) = 'STRING'), 'strings', 'array')
  WHEN __t IN ('BIGINT', 'DOUBLE', 'FLOAT') OR __t LIKE 'DECIMAL%' THEN IF(try_variant_get(__v, '$', 'decimal(38, 18)') = floor(try_variant_get(__v, '$', 'decimal(38, 18)')), 'integer', 'number') END""")


def _typed(value: str, types: dict[str, str]) -> str:
    """SQL for whether every key of a variant has a type it may have."""
    tests = []
    for key, allowed in types.items():
        kind = _bound(f"try_variant_get({value}, '$.{key}', 'variant')", "__v", KIND_SQL)
        names = ", ".join(f"'{a}'" for a in allowed.rstrip("?").split("/"))
        tests.append(f"coalesce(({kind}) IN ({names}), {str(allowed.endswith('?')).lower()})")
    return " AND ".join(tests)


def _only(json: str, keys: list[str]) -> str:
    names = ", ".join(f"'{k}'" for k in keys)
    return f"size(array_except(coalesce(json_object_keys({json}), cast(array() AS array<string>)), array({names}))) = 0"


def _checks() -> str:
    value, source = "__whole", "__source"
    text = lambda path: f"try_variant_get({value}, '$.{path}', 'string')"
    by_type = lambda github, path: f"CASE {text('source.type')} WHEN 'github' THEN {github} WHEN 'path' THEN {path} END"
    checks = {
        "unknown_keys": _only("__json", [*RECORD_TYPES]),
        "types": _typed(value, RECORD_TYPES),
        "source_keys": by_type(*(_only(f"to_json({source})", [*SOURCE_TYPES[t]]) for t in ("github", "path"))),
        "source_types": by_type(*(f"{_typed(source, SOURCE_TYPES[t])} AND {text(f'source.{key}')} <> ''" for t, key in (("github", "url"), ("path", "path")))),
        "source_kind": f"coalesce({text('source.type')} <> 'path', true) OR coalesce({text('source.kind')} IN ('file', 'folder', 'project'), false)",
        "offset": f"{text('last_refresh')} RLIKE r'{OFFSET_TIME}'",
    }
    failed = ", ".join(f"IF(coalesce({check}, false), NULL, '{name}')" for name, check in checks.items())
    checked = f"IF(coalesce(schema_of_variant({value}) LIKE 'OBJECT%', false), array_compact(array({failed})), array('unreadable'))"
    return _bound("try_parse_json(__json)", value, _bound(f"try_variant_get({value}, '$.source', 'variant')", source, checked))


def structure(rows: DataFrame, json: Column, name: str) -> DataFrame:
    """Adds the structural checks that JSON records fail: unreadable, unknown_keys, types, source_keys, source_types, source_kind, offset."""
    return rows.withColumn("__json", json).withColumn(name, F.expr(_checks())).drop("__json")


def parse_records(raw: DataFrame) -> DataFrame:
    """Records from (skill_path, json) with the checks they fail, of structure and of values. Unknown keys are refused at every level: records decide deletions."""
    rows = structure(raw, F.col("json"), "_structure").select("skill_path", F.from_json("json", RECORD_SCHEMA).alias("r"), "_structure")
    rows = violations(rows.select("skill_path", "r.*", "_structure"))
    unreadable = F.array_contains("_structure", "unreadable")
    return rows.withColumn("violations", F.when(unreadable, F.col("_structure")).otherwise(F.concat("violations", "_structure"))).drop("_structure")


def read_records(spark: SparkSession, pattern: str) -> DataFrame:
    """Records of all folders a glob names."""
    raw = spark.read.format("binaryFile").load(pattern)
    return parse_records(raw.select(F.regexp_replace("path", "/[^/]*\\z", "").alias("skill_path"), F.decode("content", "UTF-8").alias("json")))


def rebuild_registry(records: DataFrame, personal_root: str, now) -> DataFrame:
    """A registry from valid records found one level below the managed roots."""
    scope = F.when(F.regexp_replace("skill_path", "/[^/]*\\z", "").endswith(personal_root), "personal").otherwise("project")
    valid = records.filter(F.size("violations") == 0)
    return valid.select("name", "skill_path", scope.alias("scope"), F.lit(now).cast("timestamp").alias("last_check"), F.lit(False).alias("update_available"))


def write_atomic(path: Path, text: str) -> None:
    """Temporary sibling, then rename."""
    path.parent.mkdir(parents=True, exist_ok=True)
    handle, name = tempfile.mkstemp(dir=path.parent, prefix=f".{path.name}.")
    with os.fdopen(handle, "w", encoding="utf-8") as file:
        file.write(text)
    os.replace(name, path)


def _abandoned(path: Path, stale_seconds: float) -> bool:
    """By the time in the lock's payload, or the file's own where that isn't readable."""
    since = path.stat().st_mtime
    with contextlib.suppress(ValueError, TypeError, KeyError):
        payload = json.loads(path.read_text(encoding="utf-8"))
        if all(isinstance(payload[k], int | float) for k in ("pid", "timestamp")):
            since = payload["timestamp"] / 1000
    return time.time() - since >= stale_seconds


@contextlib.contextmanager
def lock(path: Path, stale_seconds: float = STALE_LOCK_SECONDS, wait_seconds: float = 5) -> Iterator[None]:
    """An advisory lock file with its holder and time; an abandoned one is taken over by renaming it away first."""
    path.parent.mkdir(parents=True, exist_ok=True)
    until = time.time() + wait_seconds
    while True:
        try:
            with os.fdopen(os.open(path, os.O_CREAT | os.O_EXCL | os.O_WRONLY), "w") as file:
                json.dump({"pid": os.getpid(), "timestamp": int(time.time() * 1000)}, file)
            break
        except FileExistsError:
            with contextlib.suppress(FileNotFoundError):
                if _abandoned(path, stale_seconds):
                    claim = path.with_suffix(f".stale-{os.getpid()}-{time.time_ns()}")
                    os.rename(path, claim)
                    claim.unlink(missing_ok=True)
                    continue
            if time.time() >= until:
                raise TimeoutError(f"{path} is held") from None
            time.sleep(0.02)
    try:
        yield
    finally:
        path.unlink(missing_ok=True)


ENTRY_KEYS = {"name", "skill_path", "scope", "last_check", "update_available"}


def _revisions(path: Path) -> dict[int, Path]:
    """Committed revisions of a registry beside its file; the newest few are kept."""
    found = (re.fullmatch(rf"{re.escape(path.stem)}\.([0-9]{{10}})\.json", p.name) for p in path.parent.glob(f"{path.stem}.*.json"))
    return {int(m[1]): path.with_name(m[0]) for m in found if m}


def _entries(path: Path) -> tuple[int, list[dict]]:
    """(revision, entries) of one file; raises where it isn't a registry."""
    data = json.loads(path.read_text(encoding="utf-8"))
    rows, revision = data["entries"], data.get("revision", 0)
    if not isinstance(revision, int) or not all(isinstance(r, dict) and set(r) == ENTRY_KEYS for r in rows):
        raise ValueError("unexpected entry")
    return revision, rows


def read_registry(path: Path) -> tuple[int, list[dict]]:
    """(revision, entries), the newest there is: of the file or of a revision that its writer had no time to copy there.

    Missing gives an empty registry; a corrupt file is set aside, and the newest readable revision counts."""
    while True:
        with contextlib.suppress(FileNotFoundError):
            revisions = _revisions(path)
            best = (max(revisions, default=0), [])
            for revision in sorted(revisions, reverse=True):
                with contextlib.suppress(ValueError, KeyError, TypeError):
                    best = (best[0], _entries(revisions[revision])[1])
                    break
            if path.exists():
                try:
                    own = _entries(path)
                    best = own if own[0] >= best[0] else best
                except (ValueError, KeyError, TypeError):
                    os.replace(path, path.with_suffix(f".corrupt-{time.time_ns()}"))
            return best


def registry_frame(spark: SparkSession, rows: list[dict]) -> DataFrame:
    text = spark.createDataFrame([(json.dumps(r),) for r in rows], "j string")
    return text.select(F.from_json("j", REGISTRY_SCHEMA).alias("r")).select("r.*")


def load_registry(spark: SparkSession, path: Path) -> DataFrame:
    return registry_frame(spark, read_registry(path)[1])


class Overtaken(RuntimeError):
    """Another writer committed the revision first."""


def commit_registry(rows: list[dict], path: Path, revision: int) -> None:
    """Writes revision ``revision + 1``, which only one writer can create, then copies it to the registry's file."""
    path.parent.mkdir(parents=True, exist_ok=True)
    text = json.dumps({"version": 1, "revision": revision + 1, "entries": rows}, indent=2)
    handle, name = tempfile.mkstemp(dir=path.parent, prefix=f".{path.name}.")
    with os.fdopen(handle, "w", encoding="utf-8") as file:
        file.write(text)
    try:
        os.link(name, path.with_name(f"{path.stem}.{revision + 1:010d}.json"))
    except FileExistsError:
        raise Overtaken(f"revision {revision + 1} of {path} is another's") from None
    finally:
        os.unlink(name)
    with lock(path.with_suffix(".lock")):
        newest, entries = read_registry(path)
        write_atomic(path, json.dumps({"version": 1, "revision": newest, "entries": entries}, indent=2))
        for old, file in _revisions(path).items():
            if old < newest - KEPT_REVISIONS:
                file.unlink(missing_ok=True)


def update_registry(spark: SparkSession, path: Path, change: Callable[[DataFrame], DataFrame], tries: int = 20) -> None:
    """Commits ``change`` of the registry; where another writer came first, of what that one left.

    A registry is a driver-sized table by nature: a row an installed doc set."""
    for _ in range(tries):
        revision, rows = read_registry(path)
        changed = change(registry_frame(spark, rows))
        done = [json.loads(x) for (x,) in changed.select(F.to_json(F.struct(*changed.columns), {"ignoreNullFields": "false"})).collect()]
        try:
            return commit_registry(done, path, revision)
        except Overtaken:
            continue
    raise TimeoutError(f"{path} changes too often")


def save_registry(registry: DataFrame, path: Path) -> None:
    """Replaces the whole registry."""
    update_registry(registry.sparkSession, path, lambda _: registry)


class InvalidRecord(ValueError):
    """A record fails its checks."""


def record_text(record: dict) -> str:
    return json.dumps(record, indent=2, default=str) + "\n"


def checked_record(spark: SparkSession, record: dict) -> str:
    """The JSON of a valid record; raises with the names of the checks that fail."""
    text = record_text(record)
    failed = parse_records(spark.createDataFrame([("", text)], "skill_path string, json string")).first()["violations"]
    if failed:
        raise InvalidRecord(f"record of {record.get('name')!r} fails: {', '.join(failed)}")
    return text


def write_record(folder: Path, record: dict, spark: SparkSession | None = None) -> None:
    """Writes a record; with a session only if it is valid."""
    write_atomic(folder / RECORD_FILE, checked_record(spark, record) if spark else record_text(record))


class UnreadableSettings(ValueError):
    """A settings file isn't a JSON object; it is left alone."""


def read_settings(path: Path) -> dict | None:
    """A settings file's object; None if there is no file."""
    if not path.exists():
        return None
    try:
        found = json.loads(path.read_text(encoding="utf-8"))
    except ValueError as bad:
        raise UnreadableSettings(str(path)) from bad
    if not isinstance(found, dict):
        raise UnreadableSettings(str(path))
    return found


def has_hook(settings: dict | None) -> bool:
    """Whether a startup entry runs the refresh command."""
    hooks = (settings or {}).get("hooks")
    entries = hooks.get("SessionStart") if isinstance(hooks, dict) else None
    lists = [e["hooks"] for e in entries if isinstance(e, dict) and isinstance(e.get("hooks"), list)] if isinstance(entries, list) else []
    return any(isinstance(h, dict) and h.get("command") == HOOK_COMMAND for own in lists for h in own)


def install_hook(path: Path) -> bool:
    """Adds the startup entry behind all that is there, atomically; False if it is there already."""
    settings = read_settings(path) or {}
    if has_hook(settings):
        return False
    hooks = settings.get("hooks") if isinstance(settings.get("hooks"), dict) else {}
    entries = hooks.get("SessionStart") if isinstance(hooks.get("SessionStart"), list) else []
    entry = {"matcher": "startup", "hooks": [{"type": "command", "command": HOOK_COMMAND, "timeout": 60}]}
    write_atomic(path, json.dumps(settings | {"hooks": hooks | {"SessionStart": [*entries, entry]}}, indent=2) + "\n")
    return True


def write_tree(folder: Path, files: Iterator[tuple[str, str]], owned: Callable[[Path], bool] | None = None) -> None:
    """Replaces a doc set's folder by a new tree in two renames; the old one comes back if the second fails.

    Paths must stay inside the folder; an existing folder must hold a record, or satisfy ``owned``."""
    owned = owned or (lambda f: (f / RECORD_FILE).exists())
    if folder.exists() and not owned(folder):
        raise PermissionError(f"{folder} isn't managed here")
    folder.parent.mkdir(parents=True, exist_ok=True)
    fresh = Path(tempfile.mkdtemp(dir=folder.parent, prefix=f".{folder.name}.new-"))
    try:
        for name, content in files:
            target = (fresh / name).resolve()
            if not target.is_relative_to(fresh.resolve()) or target == fresh.resolve():
                raise ValueError(f"{name} leaves the folder")
            target.parent.mkdir(parents=True, exist_ok=True)
            target.write_text(content, encoding="utf-8")
        old = folder.parent / f".{folder.name}.old-{time.time_ns()}"
        if folder.exists():
            os.rename(folder, old)
        try:
            os.rename(fresh, folder)
        except OSError:
            if old.exists():
                os.rename(old, folder)
            raise
        shutil.rmtree(old, ignore_errors=True)
    finally:
        shutil.rmtree(fresh, ignore_errors=True)


def delete_tracked(folder: Path, recorded: list[str]) -> list[str]:
    """Deletes recorded files, then folders left empty; returns what was already gone."""
    missing = []
    for name in recorded:
        target = folder / name
        if not target.resolve().is_relative_to(folder.resolve()):
            raise ValueError(f"{name} leaves the folder")
        if target.is_file() and not target.is_symlink():
            target.unlink()
        else:
            missing.append(name)
    for current, _, _ in sorted(os.walk(folder), key=lambda x: -len(x[0])):
        with contextlib.suppress(OSError):
            os.rmdir(current)
    return missing
