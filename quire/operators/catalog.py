"""Catalog of generated doc sets: records, registry, listing, reconciliation, removal, refresh decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.markdown import estimate_tokens
from quire.functions.text import cap, humanize

KEY = ["scope", "name"]
NAME, SEMVER, SHA, HASH = "^[a-z0-9][a-z0-9-]*\\z", "^[0-9]+\\.[0-9]+\\.[0-9]+(-[0-9A-Za-z.-]+)?\\z", "^[0-9a-f]{40}\\z", "^sha256:[0-9a-f]{64}\\z"
LEAST_BUDGET, MOST_BUDGET, DESCRIPTION = 500, 100_000, 1024
#: Folder names that count as documentation folders.
DOC_FOLDERS = ("docs", "documentation", "doc")


def valid_name(name: Column) -> Column:
    return name.rlike(NAME) & (F.length(name) <= 64)


def valid_entry() -> Column:
    """Whether a registry row may be kept: a valid name, a known scope, a path, and a flag that is set or not."""
    return valid_name(F.col("name")) & F.col("scope").isin("personal", "project") & (F.col("skill_path") != "") & F.col("update_available").isNotNull()


def valid_budget(budget: Column) -> Column:
    return (budget == F.floor(budget)) & budget.between(LEAST_BUDGET, MOST_BUDGET)


def valid_generated_path(path: Column) -> Column:
    absolute = path.startswith("/") | path.startswith("\\\\") | path.rlike("^[a-zA-Z]:[\\\\/]")
    return (path != "") & ~absolute & ~F.exists(F.split(path, "[\\\\/]", -1), lambda s: s == "..")


def contained(path: Column, folder: Column) -> Column:
    return (path == folder) | path.startswith(F.concat(folder, F.lit("/")))


def managed_path(path: Column, roots: list[str]) -> Column:
    """The parent folder equals an allowed root exactly."""
    return F.regexp_replace(path, "/[^/]*\\z", "").isin(*roots)


def violations(records: DataFrame) -> DataFrame:
    """Adds ``violations``: the names of the checks a record fails."""
    source = F.col("source")
    https = (source["type"] != "github") | (F.try_parse_url(source["url"], F.lit("PROTOCOL")).eqNullSafe("https") & F.try_parse_url(source["url"], F.lit("HOST")).eqNullSafe("github.com"))
    checks = {
        "engine_version": F.col("engine_version").rlike(SEMVER),
        "slicer_version": F.col("slicer_version") > 0,
        "name": valid_name(F.col("name")),
        "source": source["type"].isin("github", "path") & https,
        "pinned_sha": F.col("pinned_sha").isNull() | F.col("pinned_sha").rlike(SHA),
        "source_hash": F.col("source_hash").rlike(HASH),
        "token_budget": valid_budget(F.col("token_budget")),
        "check_interval_hours": F.col("check_interval_hours") >= 0,
        "last_refresh": F.col("last_refresh").isNotNull(),
        "generated_files": (F.size("generated_files") > 0) & F.forall("generated_files", valid_generated_path),
    }
    failed = [F.when(~F.coalesce(check, F.lit(False)), name) for name, check in checks.items()]
    return records.withColumn("violations", F.array_compact(F.array(*failed)))


def expected_path(scope: Column, name: Column, home: str, project: str, folder: str = ".skills") -> Column:
    return F.concat(F.when(scope == "personal", home).otherwise(project), F.lit(f"/{folder}/"), name)


def source_label(source: Column) -> Column:
    return F.when(source["type"] == "path", source["path"]).when(F.coalesce(source["subpath"], F.lit("")) != "", F.concat_ws("/", source["url"], source["subpath"])).otherwise(source["url"])


def short_source_label(source: Column) -> Column:
    return F.when(source["type"] == "path", source["path"]).otherwise(F.regexp_replace(source_label(source), "^https://", ""))


def pinned_label(source: Column, ref: Column, sha: Column) -> Column:
    pinned = F.concat(F.coalesce(ref, F.lit("HEAD")), F.lit("@"), F.coalesce(F.left(sha, F.lit(7)), F.lit("unknown")))
    return F.when(source["type"] == "github", pinned).otherwise("local")


def local_kind(path: Column) -> Column:
    base = F.lower(F.element_at(F.split(path, "/", -1), -1))
    return F.when(path.rlike("(?i)\\.(md|mdx|markdown)\\z"), "file").when(base.isin(*DOC_FOLDERS), "folder").otherwise("project")


def title(source: Column) -> Column:
    repo = F.regexp_replace(F.element_at(F.split(source["url"], "/", -1), -1), "(?i)\\.git\\z", "")
    base = F.element_at(F.split(source["path"], "/", -1), -1)
    local = F.when(source["kind"] == "file", F.regexp_replace(base, "\\.[^.]+\\z", "")).otherwise(base)
    return humanize(F.when(source["type"] == "github", repo).otherwise(local))


def default_description(title_: Column, label: Column, names: Column) -> Column:
    covers = F.when(F.size(names) > 0, F.concat(F.lit(" Covers: "), F.array_join(names, ", "), F.lit("."))).otherwise("")
    return cap(F.concat(F.lit("Reference documentation for "), title_, F.lit(", sliced from "), label, F.lit("."), covers), DESCRIPTION)


def sources_match(a: Column, b: Column) -> Column:
    github = a["url"].eqNullSafe(b["url"]) & a["subpath"].eqNullSafe(b["subpath"])
    path = a["path"].eqNullSafe(b["path"]) & a["kind"].eqNullSafe(b["kind"])
    return (a["type"] == b["type"]) & F.when(a["type"] == "github", github).otherwise(path)


def elapsed_hours(since: Column, now: Column) -> Column:
    return F.timestamp_diff("MILLISECOND", since, now) / F.lit(3600000.0)


def stale(last_refresh: Column, interval_hours: Column, now: Column) -> Column:
    return elapsed_hours(last_refresh, now) >= interval_hours


def hook_eligible(scope: Column, path: Column, folder: str) -> Column:
    """Personal entries always; others at or below the folder."""
    return (scope == "personal") | contained(path, F.lit(folder))


def listing(registry: DataFrame, records: DataFrame, now: Column) -> DataFrame:
    """A row an entry; entries without a readable record say so."""
    rows = registry.join(records.withColumn("_found", F.lit(True)), "skill_path", "left")
    found = F.col("_found").isNotNull()
    unless = lambda c: F.when(found, c).otherwise("unreadable")
    return rows.select(
        registry["name"].alias("name"),
        unless(short_source_label(F.col("source"))).alias("source"),
        registry["scope"].alias("scope"),
        unless(pinned_label(F.col("source"), F.col("tracked_ref"), F.col("pinned_sha"))).alias("pinned"),
        unless(F.date_format("last_refresh", "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("last_refresh"),
        unless(F.when(stale(F.col("last_refresh"), F.col("check_interval_hours"), now), "stale").otherwise("fresh")).alias("staleness"),
        F.when(F.col("update_available"), "yes").otherwise("no").alias("update_available"),
    )


def table_lines(rows: DataFrame, columns: list[str], order: list[str]) -> DataFrame:
    """line_no, line: the header (0) and rows padded to the widest cell of each column, without trailing blanks.

    Listings are for reading, so all of them are numbered by one window; the rows are the registry's."""
    widths = rows.agg(*[F.greatest(F.max(F.length(c)), F.lit(len(c))).alias(c) for c in columns]).first()
    named = rows.select(*columns, F.row_number().over(Window.orderBy(*order)).alias("line_no"))
    header = rows.sparkSession.range(1).select(*[F.lit(c.upper().replace("_", " ")).alias(c) for c in columns], F.lit(0).alias("line_no"))
    padded = [F.rpad(c, widths[c] or len(c), " ") for c in columns]
    return header.unionByName(named).select("line_no", F.rtrim(F.concat_ws("  ", *padded)).alias("line"))


def description_tokens(descriptions: DataFrame) -> DataFrame:
    return descriptions.agg(F.sum(estimate_tokens(F.col("description"))).alias("tokens"))


def lock_stale(content: Column, modified_ms: Column, now_ms: Column, limit_ms: int = 600_000) -> Column:
    """Whether a lock file is abandoned: by the time in its payload, or by the file's own where that isn't one."""
    payload = F.from_json(content, "pid double, timestamp double")
    since = F.when(payload["pid"].isNotNull() & payload["timestamp"].isNotNull(), payload["timestamp"]).otherwise(modified_ms)
    return now_ms - since >= limit_ms


def has_hook(session_start: Column, command: str) -> Column:
    """Whether any entry of an array of startup entries has the command among its hooks."""
    return F.coalesce(F.exists(session_start, lambda e: F.coalesce(F.exists(e["hooks"], lambda h: h["command"].eqNullSafe(F.lit(command))), F.lit(False))), F.lit(False))


def preview(plan: DataFrame, findings: DataFrame, description: Column) -> DataFrame:
    """doc_set, at, line: what a user sees before files are written. ``description`` may use doc_set."""
    sets = plan.select("doc_set").distinct()
    n_findings = findings.groupBy("doc_set").agg(F.count(F.lit(1)).alias("n"))
    place = lambda part, *keys: F.array(F.lit(part).cast("string"), *[F.lpad(k.cast("string"), 10, "0") if kind else k for k, kind in keys]).alias("at")
    head = sets.select("doc_set", F.explode(F.array(F.concat(F.lit("0Skill name: "), "doc_set"), F.concat(F.lit("1Description: "), description), F.lit("2Sections:"))).alias("x"))
    rows = head.select("doc_set", F.array(F.substring("x", 1, 1)).alias("at"), F.substr(F.col("x"), F.lit(2)).alias("line"))
    rows = rows.unionByName(plan.select("doc_set", place(3, (F.col("emit_ord"), True)), F.concat(F.lit("  "), "relative_path").alias("line")))
    rows = rows.unionByName(n_findings.select("doc_set", place(4), F.concat(F.lit("Injection scan flagged "), F.col("n").cast("string"), F.lit(" finding(s):")).alias("line")))
    found = F.concat(F.lit("  "), F.col("relative_path"), F.lit(":"), F.col("line").cast("string"), F.lit(" ["), F.col("pattern"), F.lit("] "), F.col("excerpt"))
    return rows.unionByName(findings.select("doc_set", place(5, (F.col("relative_path"), False), (F.col("line"), True), (F.col("pattern"), False)), found.alias("line")))


def registry_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """change (added, removed, updated), scope, name: keys on one side, or on both with other paths."""
    cell = lambda change: [F.lit(change).alias("change"), *KEY]
    added = after.join(before, KEY, "left_anti").select(*cell("added"))
    removed = before.join(after, KEY, "left_anti").select(*cell("removed"))
    moved = after.join(before.select(*KEY, F.col("skill_path").alias("_old")), KEY).filter(F.col("skill_path") != F.col("_old")).select(*cell("updated"))
    return added.unionByName(removed).unionByName(moved)


def upsert(registry: DataFrame, entries: DataFrame) -> DataFrame:
    return registry.join(entries, KEY, "left_anti").unionByName(entries)


def drop_entries(registry: DataFrame, keys: DataFrame) -> DataFrame:
    return registry.join(keys, KEY, "left_anti")


def foreign_files(on_disk: DataFrame, recorded: DataFrame) -> DataFrame:
    """Files on disk that no record lists."""
    return on_disk.join(recorded, ["skill_path", "relative_path"], "left_anti")


def tracked_files(on_disk: DataFrame, recorded: DataFrame) -> DataFrame:
    """Recorded files that are on disk."""
    return recorded.join(on_disk, ["skill_path", "relative_path"], "left_semi")


def collisions(records: DataFrame, wanted: DataFrame) -> DataFrame:
    """Wanted doc sets whose path holds a record of another source."""
    have = records.select("skill_path", F.col("source").alias("_have"))
    return wanted.join(have, "skill_path").filter(~sources_match(F.col("_have"), F.col("source"))).select("skill_path", "name")


def apply_outcomes(registry: DataFrame, outcomes: DataFrame, now: Column) -> DataFrame:
    """Refresh outcomes by (scope, name): skipped changes nothing, stale only the check time."""
    rows = registry.join(outcomes.select(*KEY, "status"), KEY, "left")
    touched = F.col("status").isNotNull() & (F.col("status") != "skipped")
    flag = F.when(touched & (F.col("status") != "stale"), F.col("status") == "update-available").otherwise(F.col("update_available"))
    return rows.withColumns({"update_available": flag, "last_check": F.when(touched, now).otherwise(F.col("last_check"))}).drop("status")


def apply_hook_lines(registry: DataFrame, lines: DataFrame, now: Column) -> DataFrame:
    """Lines of a hook run by name only: upstream updates set the flag, regeneration clears it; updates win."""
    updated, regenerated = "^\\w+: (.+) has upstream updates;", "^\\w+: (.+) regenerated \\(source changed\\)\\z"
    said = lines.select(F.when(F.col("line").rlike(updated), F.regexp_extract("line", updated, 1)).otherwise(F.regexp_extract("line", regenerated, 1)).alias("name"), F.col("line").rlike(updated).alias("_update"))
    said = said.filter("name <> ''").groupBy("name").agg(F.max("_update").alias("_update"))
    rows = registry.join(said, "name", "left")
    return rows.withColumns({"update_available": F.coalesce("_update", "update_available"), "last_check": F.when(F.col("_update").isNotNull(), now).otherwise(F.col("last_check"))}).drop("_update")


def by_age(pending: DataFrame) -> DataFrame:
    """Adds ``place``, from 1 for the entry that was refreshed longest ago. The registry's own rows, so one window numbers them."""
    return pending.withColumn("place", F.row_number().over(Window.orderBy(F.col("last_refresh").asc_nulls_first(), *KEY)))


def oldest(pending: DataFrame, n: int = 3) -> DataFrame:
    """The n entries that were refreshed longest ago."""
    return pending.orderBy(F.col("last_refresh").asc_nulls_first(), *KEY).limit(n)


def local_status(records: DataFrame, fresh: DataFrame) -> DataFrame:
    """status of local doc sets by fingerprint: unchanged, changed, or stale where the source is gone."""
    rows = records.join(fresh.select("doc_set", F.col("source_hash").alias("_now")), "doc_set", "left")
    return rows.select("doc_set", F.when(F.col("_now").isNull(), "stale").when(F.col("_now") == F.col("source_hash"), "unchanged").otherwise("changed").alias("status"))


def remote_status(records: DataFrame, heads: DataFrame) -> DataFrame:
    """status of repository doc sets: unchanged, update-available, or stale where the ref has no head."""
    rows = records.join(heads.select("url", F.coalesce("ref", F.lit("HEAD")).alias("_ref"), "sha"), (records["url"] == heads["url"]) & (F.coalesce(records["tracked_ref"], F.lit("HEAD")) == F.col("_ref")), "left")
    return rows.select("name", F.when(F.col("sha").isNull(), "stale").when(F.col("sha").eqNullSafe(F.col("pinned_sha")), "unchanged").otherwise("update-available").alias("status"))
