"""Catalog, URL, registry and refresh queries over tables derived from suppliers, customers, orders and pages.

A customer with an order is a doc set: its record comes from its orders, its registry entry from the
customer row. The SQL derives the same tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import catalog as cat
from quire.sources import files, urls
from quire.streaming import refresh

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
NOW = "TIMESTAMP '1998-01-01 00:00:00'"


def registers(queries: dict, oracles: dict[str, str]):
    """A decorator that puts a query and its SQL into a module's tables."""

    def query(sql: str | None = None):
        def add(function):
            queries[function.__name__] = function
            if sql:
                oracles[function.__name__] = sql
            return function

        return add

    return query


query = registers(QUERIES, ORACLES)


def now() -> F.Column:
    return F.expr(NOW)


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An entry a customer; every third is a project's."""
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet")
    scope = F.when(F.col("c_custkey") % 3 == 0, "project").otherwise("personal")
    name = F.concat(F.lit("set-"), F.col("c_custkey").cast("string"))
    return customer.select(
        name.alias("name"),
        cat.expected_path(scope, name, "/home/u", "/work/p").alias("skill_path"),
        scope.alias("scope"),
        F.when(F.col("c_custkey") % 4 > 0, F.timestamp_add("DAY", F.col("c_custkey").cast("int") % 50, F.expr("TIMESTAMP '1997-01-01 00:00:00'"))).alias("last_check"),
        (F.col("c_acctbal") > 5000).alias("update_available"),
    )


REGISTRY_SQL = """registry AS (SELECT 'set-' || CAST(c_custkey AS VARCHAR) AS name,
  CASE WHEN c_custkey % 3 = 0 THEN '/work/p' ELSE '/home/u' END || '/.skills/set-' || CAST(c_custkey AS VARCHAR) AS skill_path,
  CASE WHEN c_custkey % 3 = 0 THEN 'project' ELSE 'personal' END AS scope,
  CASE WHEN c_custkey % 4 > 0 THEN TIMESTAMP '1997-01-01 00:00:00' + to_days(CAST(c_custkey % 50 AS INTEGER)) END AS last_check,
  c_acctbal > 5000 AS update_available FROM customer)"""


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record a customer with orders: half remote, half local."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy("o_custkey").agg(F.max("o_orderdate").alias("last"), F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("k"))
    key = F.col("o_custkey")
    remote = key % 2 == 0
    name = F.concat(F.lit("set-"), key.cast("string"))
    text = F.col("k").cast("string")
    source = F.struct(
        F.when(remote, "github").otherwise("path").alias("type"),
        F.when(remote, F.concat(F.lit("https://github.com/org/repo_"), text, F.lit(".git"))).alias("url"),
        F.when(remote & (key % 10 == 0), "docs/api").alias("subpath"),
        F.when(~remote, F.concat(F.lit("/data/"), F.when(key % 5 == 0, "docs").when(key % 5 == 1, F.concat(F.lit("my-file_"), text, F.lit(".md"))).otherwise(F.concat(F.lit("proj_"), text)))).alias("path"),
        F.when(~remote, F.when(key % 5 == 0, "folder").when(key % 5 == 1, "file").otherwise("project")).alias("kind"),
    )
    return orders.select(
        F.lit("1.2.3").alias("engine_version"),
        F.lit(1).alias("slicer_version"),
        name.alias("name"),
        cat.expected_path(F.when(key % 3 == 0, "project").otherwise("personal"), name, "/home/u", "/work/p").alias("skill_path"),
        source.alias("source"),
        F.when(remote & (key % 4 == 0), "main").alias("tracked_ref"),
        F.when(remote & (key % 8 > 0), F.sha1(text)).alias("pinned_sha"),
        F.concat(F.lit("sha256:"), F.sha2(text, 256)).alias("source_hash"),
        (F.col("n") * 60 + key % 7 / F.lit(7.0) * F.when(key % 7 == 3, 1).otherwise(0)).alias("token_budget"),
        (key % 2 == 1).alias("include_large"),
        (F.col("n") * 24.0).alias("check_interval_hours"),
        F.col("last").cast("timestamp").alias("last_refresh"),
        F.array(F.lit("SKILL.md"), F.concat(F.when(key % 11 == 0, "../").when(key % 13 == 0, "/").otherwise("resources/"), text, F.lit(".md"))).alias("generated_files"),
    )


RECORDS_SQL = """ord AS (SELECT o_custkey AS c, max(o_orderdate) AS last, count(*) AS n, min(o_orderkey) AS k FROM orders GROUP BY o_custkey),
records AS (SELECT 'set-' || CAST(c AS VARCHAR) AS name, CASE WHEN c % 3 = 0 THEN '/work/p' ELSE '/home/u' END || '/.skills/set-' || CAST(c AS VARCHAR) AS skill_path,
  CASE WHEN c % 2 = 0 THEN 'github' ELSE 'path' END AS type, CASE WHEN c % 2 = 0 THEN 'https://github.com/org/repo_' || CAST(k AS VARCHAR) || '.git' END AS url,
  CASE WHEN c % 10 = 0 THEN 'docs/api' END AS subpath,
  CASE WHEN c % 2 = 1 THEN '/data/' || CASE WHEN c % 5 = 0 THEN 'docs' WHEN c % 5 = 1 THEN 'my-file_' || CAST(k AS VARCHAR) || '.md' ELSE 'proj_' || CAST(k AS VARCHAR) END END AS path,
  CASE WHEN c % 2 = 1 THEN CASE WHEN c % 5 = 0 THEN 'folder' WHEN c % 5 = 1 THEN 'file' ELSE 'project' END END AS kind,
  CASE WHEN c % 4 = 0 THEN 'main' END AS tracked_ref, CASE WHEN c % 2 = 0 AND c % 8 > 0 THEN sha1(CAST(k AS VARCHAR)) END AS pinned_sha,
  'sha256:' || sha256(CAST(k AS VARCHAR)) AS source_hash, n * 60 + CASE WHEN c % 7 = 3 THEN 3 / 7.0::DOUBLE ELSE 0 END AS token_budget, n * 24.0::DOUBLE AS check_interval_hours,
  last AS last_refresh, c, k, n, CASE WHEN c % 11 = 0 THEN '../' WHEN c % 13 = 0 THEN '/' ELSE 'resources/' END || CAST(k AS VARCHAR) || '.md' AS generated FROM ord)"""
BOTH_SQL = f"WITH {REGISTRY_SQL}, {RECORDS_SQL}"
LABEL_SQL = "CASE WHEN type = 'path' THEN path ELSE url || CASE WHEN subpath IS NULL THEN '' ELSE '/' || subpath END END"


@query(f"WITH {RECORDS_SQL} SELECT name, {LABEL_SQL} AS label, regexp_replace({LABEL_SQL}, '^https://', '') AS short_label FROM records")
def c_source_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records(spark, sf_dir).select("name", cat.source_label(F.col("source")).alias("label"), cat.short_source_label(F.col("source")).alias("short_label"))


@query(f"WITH {RECORDS_SQL} SELECT name, regexp_replace({LABEL_SQL}, '^https://', '') AS short_label FROM records")
def c_short_source_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records(spark, sf_dir).select("name", cat.short_source_label(F.col("source")).alias("short_label"))


@query(f"WITH {RECORDS_SQL} SELECT name, CASE WHEN type = 'github' THEN coalesce(tracked_ref, 'HEAD') || '@' || coalesce(left(pinned_sha, 7), 'unknown') ELSE 'local' END AS pinned FROM records")
def c_pinned_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records(spark, sf_dir).select("name", cat.pinned_label(F.col("source"), F.col("tracked_ref"), F.col("pinned_sha")).alias("pinned"))


@query(f"WITH {RECORDS_SQL} SELECT name, kind FROM records WHERE type = 'path'")
def c_local_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records(spark, sf_dir).filter("source.type = 'path'").select("name", cat.local_kind(F.col("source.path")).alias("kind"))


TITLE_SQL = "CASE WHEN type = 'github' THEN 'repo ' || CAST(k AS VARCHAR) WHEN kind = 'folder' THEN 'docs' WHEN kind = 'file' THEN 'my file ' || CAST(k AS VARCHAR) ELSE 'proj ' || CAST(k AS VARCHAR) END"


@query(f"WITH {RECORDS_SQL} SELECT name, {TITLE_SQL} AS title FROM records")
def c_derive_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records(spark, sf_dir).select("name", cat.title(F.col("source")).alias("title"))


@query(f"WITH {RECORDS_SQL} SELECT name, substr('Reference documentation for ' || {TITLE_SQL} || ', sliced from ' || {LABEL_SQL} || '. Covers: SKILL.md, ' || generated || '.', 1, 1024) AS description FROM records")
def c_default_description(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records(spark, sf_dir).select("name", cat.default_description(cat.title(F.col("source")), cat.source_label(F.col("source")), F.col("generated_files")).alias("description"))


@query(f"WITH {RECORDS_SQL} SELECT CAST(sum(ceil(length('Reference documentation for ' || {TITLE_SQL} || ', sliced from ' || {LABEL_SQL} || '. Covers: SKILL.md, ' || generated || '.') / 4.0)) AS BIGINT) AS tokens FROM records")
def a_description_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cat.description_tokens(c_default_description(spark, sf_dir))


@query(f"WITH {REGISTRY_SQL} SELECT name, scope, skill_path FROM registry")
def c_expected_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry(spark, sf_dir).select("name", "scope", cat.expected_path(F.col("scope"), F.col("name"), "/home/u", "/work/p").alias("skill_path"))


@query(f"WITH {REGISTRY_SQL} SELECT name, scope = 'personal' AS managed, skill_path LIKE '/work/p/%' AS contained FROM registry")
def p_managed_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry(spark, sf_dir).select("name", cat.managed_path(F.col("skill_path"), ["/home/u/.skills"]).alias("managed"), cat.contained(F.col("skill_path"), F.lit("/work/p")).alias("contained"))


VIOLATIONS_SQL = """SELECT name, array_to_string(list_filter([
  CASE WHEN NOT (token_budget = floor(token_budget) AND token_budget BETWEEN 500 AND 100000) THEN 'token_budget' END,
  CASE WHEN c % 11 = 0 OR c % 13 = 0 THEN 'generated_files' END], lambda x: x IS NOT NULL), ',') AS violations FROM records"""


BROKEN_SQL = f"""WITH {RECORDS_SQL}, broken AS (SELECT name AS was, c % 11 = 0 AS up, c % 13 = 0 AS absolute, token_budget, k,
  CASE c % 14 WHEN 0 THEN '1.2' WHEN 10 THEN '1.2.3-rc.1' WHEN 11 THEN 'v1.2.3' ELSE '1.2.3' END AS engine_version, CASE WHEN c % 14 = 1 THEN 0 ELSE 1 END AS slicer_version, CASE WHEN c % 14 = 2 THEN upper(name) ELSE name END AS name,
  CASE WHEN c % 14 = 3 THEN 'svn' ELSE type END AS type, CASE WHEN c % 14 = 4 THEN replace(url, 'https:', 'http:') WHEN c % 14 = 12 THEN replace(url, 'github.com', 'github.com.evil.org') ELSE url END AS url,
  CASE WHEN c % 14 = 5 THEN 'xyz' WHEN c % 14 = 13 THEN upper(pinned_sha) ELSE pinned_sha END AS pinned_sha, CASE WHEN c % 14 = 6 THEN 'sha256:1' ELSE source_hash END AS source_hash,
  CASE WHEN c % 14 = 7 THEN -1 ELSE check_interval_hours END AS hours, CASE WHEN c % 14 = 8 THEN NULL ELSE last_refresh END AS last_refresh, CASE WHEN c % 14 = 9 THEN [] ELSE ['SKILL.md', generated] END AS files FROM records)
SELECT was AS name, array_to_string(list_filter([
  CASE WHEN NOT regexp_full_match(engine_version, '\\d+[.]\\d+[.]\\d+(-[0-9A-Za-z.-]+)?') THEN 'engine_version' END, CASE WHEN slicer_version < 1 THEN 'slicer_version' END,
  CASE WHEN NOT regexp_full_match(name, '[a-z0-9][a-z0-9-]*') OR length(name) > 64 THEN 'name' END,
  CASE WHEN NOT (type = 'path' OR type = 'github' AND starts_with(url, 'https://github.com/')) THEN 'source' END,
  CASE WHEN pinned_sha IS NOT NULL AND NOT regexp_full_match(pinned_sha, '[0-9a-f]{{40}}') THEN 'pinned_sha' END, CASE WHEN NOT regexp_full_match(source_hash, 'sha256:[0-9a-f]{{64}}') THEN 'source_hash' END,
  CASE WHEN token_budget <> floor(token_budget) OR token_budget < 500 OR token_budget > 100000 THEN 'token_budget' END, CASE WHEN hours < 0 THEN 'check_interval_hours' END, CASE WHEN last_refresh IS NULL THEN 'last_refresh' END,
  CASE WHEN len(files) = 0 OR len(list_filter(files, lambda f: f = '' OR starts_with(f, '/') OR list_contains(str_split(f, '/'), '..'))) > 0 THEN 'generated_files' END], lambda x: x IS NOT NULL), ',') AS violations FROM broken"""


def _broken(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records each of whose checks fails somewhere; ``was`` keeps the name."""
    rows = records(spark, sf_dir).withColumn("was", F.col("name"))
    key = F.substring("name", 5, 20).cast("long") % 14
    when = lambda n, value, column: F.when(key == n, value).otherwise(column)
    s = F.col("source")
    url = F.when(key == 4, F.replace(s["url"], F.lit("https:"), F.lit("http:"))).when(key == 12, F.replace(s["url"], F.lit("github.com"), F.lit("github.com.evil.org"))).otherwise(s["url"])
    return rows.withColumns({
        "engine_version": F.when(key == 0, "1.2").when(key == 10, "1.2.3-rc.1").when(key == 11, "v1.2.3").otherwise(F.col("engine_version")),
        "slicer_version": when(1, F.lit(0), F.col("slicer_version")),
        "name": when(2, F.upper("name"), F.col("name")),
        "source": F.struct(when(3, F.lit("svn"), s["type"]).alias("type"), url.alias("url"), s["subpath"].alias("subpath"), s["path"].alias("path"), s["kind"].alias("kind")),
        "pinned_sha": F.when(key == 5, "xyz").when(key == 13, F.upper("pinned_sha")).otherwise(F.col("pinned_sha")),
        "source_hash": when(6, F.lit("sha256:1"), F.col("source_hash")),
        "check_interval_hours": when(7, F.lit(-1.0), F.col("check_interval_hours")),
        "last_refresh": when(8, F.lit(None), F.col("last_refresh")),
        "generated_files": when(9, F.array().cast("array<string>"), F.col("generated_files")),
    })


@query(BROKEN_SQL)
def p_record_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cat.violations(_broken(spark, sf_dir)).select(F.col("was").alias("name"), F.array_join("violations", ",").alias("violations"))


@query(f"""WITH {RECORDS_SQL}, p AS (SELECT name, unnest([generated, '', 'a/../b', '..', 'a..b/c', 'C:' || chr(92) || 'x', chr(92) || chr(92) || 'host', 'a' || chr(92) || '..' || chr(92) || 'b', 'ok/' || CAST(k AS VARCHAR) || '.md']) AS path FROM records)
SELECT name, path, path <> '' AND NOT starts_with(path, '/') AND NOT starts_with(path, chr(92) || chr(92)) AND NOT (ascii(lower(path)) BETWEEN 97 AND 122 AND substr(path, 2, 1) = ':' AND substr(path, 3, 1) IN ('/', chr(92)))
  AND NOT list_contains(str_split(replace(path, chr(92), '/'), '/'), '..') AS ok FROM p""")  # fmt: skip
def p_generated_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = [F.element_at("generated_files", -1), *[F.lit(x) for x in ("", "a/../b", "..", "a..b/c", "C:\\x", "\\\\host", "a\\..\\b")], F.concat(F.lit("ok/"), F.regexp_extract(F.element_at("generated_files", -1), "([0-9]+)[.]md", 1), F.lit(".md"))]
    return records(spark, sf_dir).select("name", F.explode(F.array(*own)).alias("path")).select("name", "path", cat.valid_generated_path(F.col("path")).alias("ok"))


@query(f"WITH {RECORDS_SQL} SELECT name, token_budget = floor(token_budget) AND token_budget BETWEEN 500 AND 100000 AS ok FROM records")
def p_token_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records(spark, sf_dir).select("name", cat.valid_budget(F.col("token_budget")).alias("ok"))


@query("""WITH n AS (SELECT c_custkey, CASE c_custkey % 8 WHEN 0 THEN c_name WHEN 1 THEN '' WHEN 2 THEN '-' || CAST(c_custkey AS VARCHAR) WHEN 3 THEN repeat('a', CAST(c_custkey % 130 AS INTEGER)) WHEN 4 THEN 'a b' WHEN 5 THEN 'é' || CAST(c_custkey AS VARCHAR)
  WHEN 6 THEN CAST(c_custkey AS VARCHAR) || '-' || chr(10) ELSE lower(replace(c_name, '#', '-')) END AS name FROM customer)
SELECT c_custkey, name, regexp_full_match(name, '[a-z0-9][a-z0-9-]*') AND length(name) <= 64 AS ok FROM n""")  # fmt: skip
def p_valid_skill_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' names, and names of other shapes and lengths."""
    key, number, name = F.col("c_custkey"), F.col("c_custkey").cast("string"), F.col("c_name")
    made = [name, F.lit(""), F.concat(F.lit("-"), number), F.repeat(F.lit("a"), (key % 130).cast("int")), F.lit("a b"), F.concat(F.lit("é"), number), F.concat(number, F.lit("-\n")), F.lower(F.replace(name, F.lit("#"), F.lit("-")))]
    chosen = F.element_at(F.array(*made), (key % 8 + 1).cast("int"))
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", chosen.alias("name"), cat.valid_name(chosen).alias("ok"))


STALE_SQL = f"epoch_ms({NOW}) - epoch_ms(last_refresh)"


@query(f"WITH {RECORDS_SQL} SELECT name, ({STALE_SQL}) / 3600000.0::DOUBLE AS hours, ({STALE_SQL}) / 3600000.0::DOUBLE >= check_interval_hours AS stale FROM records")
def p_interval_elapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records(spark, sf_dir).select("name", cat.elapsed_hours(F.col("last_refresh"), now()).cast("double").alias("hours"), cat.stale(F.col("last_refresh"), F.col("check_interval_hours"), now()).alias("stale"))


@query(f"WITH {REGISTRY_SQL} SELECT name, scope FROM registry WHERE scope = 'personal' OR skill_path LIKE '/work/p/%'")
def p_hook_eligible(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry(spark, sf_dir).filter(cat.hook_eligible(F.col("scope"), F.col("skill_path"), "/work/p")).select("name", "scope")


LISTING_SQL = f"""{BOTH_SQL}, listing AS (SELECT g.name, coalesce(regexp_replace({LABEL_SQL}, '^https://', ''), 'unreadable') AS source, g.scope,
  CASE WHEN r.name IS NULL THEN 'unreadable' WHEN type = 'github' THEN coalesce(tracked_ref, 'HEAD') || '@' || coalesce(left(pinned_sha, 7), 'unknown') ELSE 'local' END AS pinned,
  coalesce(strftime(last_refresh, '%Y-%m-%dT%H:%M:%SZ'), 'unreadable') AS last_refresh,
  CASE WHEN r.name IS NULL THEN 'unreadable' WHEN ({STALE_SQL}) / 3600000.0 >= check_interval_hours THEN 'stale' ELSE 'fresh' END AS staleness,
  CASE WHEN update_available THEN 'yes' ELSE 'no' END AS update_available FROM registry g LEFT JOIN records r ON g.skill_path = r.skill_path)"""
COLUMNS = ["name", "source", "scope", "pinned", "last_refresh", "staleness", "update_available"]


@query(f"{LISTING_SQL} SELECT * FROM listing")
def j_registry_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cat.listing(registry(spark, sf_dir), records(spark, sf_dir).drop("name"), now())


@query(f"{LISTING_SQL}, w AS (SELECT " + ", ".join(f"greatest(max(length({c})), {len(c)}) AS w_{c}" for c in COLUMNS) + " FROM listing) SELECT * FROM w")
def a_column_widths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return j_registry_record(spark, sf_dir).agg(*[F.greatest(F.max(F.length(c)), F.lit(len(c))).cast("long").alias(f"w_{c}") for c in COLUMNS])


@query(f"""{LISTING_SQL}, every AS (SELECT *, CAST(row_number() OVER (ORDER BY name, scope) AS INTEGER) AS line_no FROM listing
  UNION ALL SELECT {", ".join(f"'{c.upper().replace('_', ' ')}'" for c in COLUMNS)}, 0),
w AS (SELECT {", ".join(f"max(length({c})) AS w_{c}" for c in COLUMNS)} FROM every)
SELECT line_no, rtrim({" || '  ' || ".join(f"rpad({c}, CAST(w_{c} AS INTEGER), ' ')" for c in COLUMNS)}) AS line FROM every, w""")  # fmt: skip
def c_table_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cat.table_lines(j_registry_record(spark, sf_dir), COLUMNS, ["name", "scope"])


AFTER_SQL = """after AS (SELECT name, CASE WHEN c_custkey % 6 = 0 THEN skill_path || '-moved' ELSE skill_path END AS skill_path, scope
  FROM registry JOIN customer ON name = 'set-' || CAST(c_custkey AS VARCHAR) WHERE c_custkey % 7 > 0
  UNION ALL SELECT 'new-' || CAST(s_suppkey AS VARCHAR), '/home/u/.skills/new', 'personal' FROM supplier),
before AS (SELECT name, skill_path, scope FROM registry)"""


def _after(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.regexp_extract("name", "([0-9]+)", 1).cast("long")
    moved = F.when(key % 6 == 0, F.concat("skill_path", F.lit("-moved"))).otherwise(F.col("skill_path"))
    kept = registry(spark, sf_dir).filter(key % 7 > 0).select("name", moved.alias("skill_path"), "scope")
    supplier = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    return kept.unionByName(supplier.select(F.concat(F.lit("new-"), F.col("s_suppkey").cast("string")).alias("name"), F.lit("/home/u/.skills/new").alias("skill_path"), F.lit("personal").alias("scope")))


DIFF_SQL = f"""WITH {REGISTRY_SQL}, {AFTER_SQL}, diff AS (
  SELECT 'added' AS change, scope, name FROM after a WHERE NOT EXISTS (SELECT 1 FROM before b WHERE b.scope = a.scope AND b.name = a.name)
  UNION ALL SELECT 'removed', scope, name FROM before b WHERE NOT EXISTS (SELECT 1 FROM after a WHERE b.scope = a.scope AND b.name = a.name)
  UNION ALL SELECT 'updated', a.scope, a.name FROM after a JOIN before b ON a.scope = b.scope AND a.name = b.name WHERE a.skill_path <> b.skill_path)"""


def _diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cat.registry_diff(registry(spark, sf_dir).select("name", "skill_path", "scope"), _after(spark, sf_dir))


@query(f"{DIFF_SQL} SELECT scope, name FROM diff WHERE change = 'added'")
def j_doctor_added(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _diff(spark, sf_dir).filter("change = 'added'").select("scope", "name")


@query(f"{DIFF_SQL} SELECT scope, name FROM diff WHERE change = 'removed'")
def j_doctor_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _diff(spark, sf_dir).filter("change = 'removed'").select("scope", "name")


@query(f"{DIFF_SQL} SELECT scope, name FROM diff WHERE change = 'updated'")
def j_doctor_updated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _diff(spark, sf_dir).filter("change = 'updated'").select("scope", "name")


@query(f"{DIFF_SQL} SELECT change, count(*) AS n FROM diff GROUP BY change")
def a_change_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _diff(spark, sf_dir).groupBy("change").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {REGISTRY_SQL}, {AFTER_SQL} SELECT name, scope, skill_path FROM after UNION ALL SELECT name, scope, skill_path FROM before b WHERE NOT EXISTS (SELECT 1 FROM after a WHERE a.scope = b.scope AND a.name = b.name)")
def j_upsert_entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cat.upsert(registry(spark, sf_dir).select("name", "scope", "skill_path"), _after(spark, sf_dir).select("name", "scope", "skill_path"))


@query(f"WITH {REGISTRY_SQL} SELECT name, scope FROM registry WHERE scope = 'personal'")
def set_manifest_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = registry(spark, sf_dir).select("name", "scope")
    return cat.drop_entries(rows, rows.filter("scope = 'project'"))


def _disk(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Files on disk from lineitem, recorded files from orders' line 1 and 2."""
    line = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    on_disk = line.select(F.col("l_orderkey").cast("string").alias("skill_path"), F.concat(F.lit("f"), F.col("l_linenumber").cast("string")).alias("relative_path")).distinct()
    recorded = orders.select(F.col("o_orderkey").cast("string").alias("skill_path"), F.explode(F.array(F.lit("f1"), F.lit("f2"))).alias("relative_path"))
    return on_disk, recorded


DISK_SQL = """WITH disk AS (SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS skill_path, 'f' || CAST(l_linenumber AS VARCHAR) AS relative_path FROM lineitem),
rec AS (SELECT CAST(o_orderkey AS VARCHAR) AS skill_path, unnest(['f1', 'f2']) AS relative_path FROM orders)"""


@query(f"{DISK_SQL} SELECT skill_path, relative_path FROM disk EXCEPT SELECT skill_path, relative_path FROM rec")
def set_foreign_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cat.foreign_files(*_disk(spark, sf_dir))


@query(f"{DISK_SQL} SELECT skill_path, relative_path FROM disk INTERSECT SELECT skill_path, relative_path FROM rec")
def set_missing_tracked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cat.tracked_files(*_disk(spark, sf_dir))


@query(f"WITH {RECORDS_SQL} SELECT name, 'SKILL.md' AS relative_path FROM records UNION ALL SELECT name, generated FROM records UNION ALL SELECT name, 'record.json' FROM records")
def set_generated_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = records(spark, sf_dir)
    return rows.select("name", F.explode("generated_files").alias("relative_path")).unionByName(rows.select("name", F.lit("record.json").alias("relative_path")))


OUTCOMES_SQL = "outcomes AS (SELECT scope, name, CASE CAST(substr(name, 5) AS BIGINT) % 6 WHEN 0 THEN 'skipped' WHEN 1 THEN 'stale' WHEN 2 THEN 'update-available' WHEN 3 THEN 'unchanged' WHEN 4 THEN 'regenerated' END AS status FROM registry WHERE CAST(substr(name, 5) AS BIGINT) % 6 < 5)"


@query(f"""WITH {REGISTRY_SQL}, {OUTCOMES_SQL} SELECT g.scope, g.name, CASE WHEN status IN ('update-available', 'unchanged', 'regenerated') THEN status = 'update-available' ELSE update_available END AS update_available,
  CASE WHEN status IS NULL OR status = 'skipped' THEN last_check ELSE {NOW} END AS last_check FROM registry g LEFT JOIN outcomes o ON g.scope = o.scope AND g.name = o.name""")  # fmt: skip
def j_outcome_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = registry(spark, sf_dir)
    key = F.substring("name", 5, 20).cast("long") % 6
    status = F.element_at(F.array(*[F.lit(s) for s in ("skipped", "stale", "update-available", "unchanged", "regenerated")]), (key + 1).cast("int"))
    outcomes = rows.filter(key < 5).select("scope", "name", status.alias("status"))
    return cat.apply_outcomes(rows, outcomes, now().cast("timestamp")).select("scope", "name", "update_available", "last_check")


@query(f"""WITH {REGISTRY_SQL}, said AS (SELECT 'set-' || CAST(s_suppkey AS VARCHAR) AS name, s_suppkey % 2 = 0 AS up FROM supplier)
SELECT g.scope, g.name, coalesce(up, update_available) AS update_available FROM registry g LEFT JOIN said USING (name)""")  # fmt: skip
def j_hook_lines_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    supplier = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    name = F.concat(F.lit("tool: set-"), F.col("s_suppkey").cast("string"))
    lines = supplier.select(F.when(F.col("s_suppkey") % 2 == 0, F.concat(name, F.lit(" has upstream updates; run refresh"))).otherwise(F.concat(name, F.lit(" regenerated (source changed)"))).alias("line"))
    return cat.apply_hook_lines(registry(spark, sf_dir), lines, now().cast("timestamp")).select("scope", "name", "update_available")


@query(f"""WITH {RECORDS_SQL}, wanted AS (SELECT skill_path, name, CASE WHEN c % 5 = 2 THEN subpath || 'x' ELSE subpath END AS s2, CASE WHEN c % 5 = 3 THEN path || 'x' ELSE path END AS p2, c FROM records)
SELECT w.skill_path, w.name FROM wanted w JOIN records r USING (skill_path) WHERE s2 IS DISTINCT FROM subpath OR p2 IS DISTINCT FROM path""")  # fmt: skip
def j_collision(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = records(spark, sf_dir)
    key = F.substring("name", 5, 20).cast("long") % 5
    s = F.col("source")
    other = F.struct(s["type"].alias("type"), s["url"].alias("url"), F.when(key == 2, F.concat(s["subpath"], F.lit("x"))).otherwise(s["subpath"]).alias("subpath"), F.when(key == 3, F.concat(s["path"], F.lit("x"))).otherwise(s["path"]).alias("path"), s["kind"].alias("kind"))
    return cat.collisions(rows, rows.select("skill_path", "name", other.alias("source")))


@query(f"WITH {RECORDS_SQL} SELECT name, last_refresh FROM records WHERE type = 'path' ORDER BY last_refresh, name LIMIT 3")
def w_oldest_three(spark: SparkSession, sf_dir: str) -> DataFrame:
    pending = records(spark, sf_dir).filter("source.type = 'path'").withColumn("scope", F.lit(""))
    return cat.oldest(pending).select("name", "last_refresh")


@query(f"WITH {RECORDS_SQL}, heads AS (SELECT url, CASE WHEN c % 8 = 2 THEN sha1('moved') ELSE sha1(CAST(k AS VARCHAR)) END AS sha, tracked_ref FROM records WHERE type = 'github' AND c % 16 > 0) SELECT r.name, CASE WHEN h.sha IS NULL THEN 'stale' WHEN h.sha = r.pinned_sha THEN 'unchanged' ELSE 'update-available' END AS status FROM records r LEFT JOIN heads h ON h.url = r.url WHERE r.type = 'github'")
def inc_remote_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = records(spark, sf_dir).filter("source.type = 'github'").withColumn("url", F.col("source.url"))
    key = F.substring("name", 5, 20).cast("long")
    own = F.regexp_extract("url", "repo_([0-9]+)", 1)
    heads = rows.filter(key % 16 > 0).select("url", F.col("tracked_ref").alias("ref"), F.when(key % 8 == 2, F.sha1(F.lit("moved"))).otherwise(F.sha1(own)).alias("sha"))
    return cat.remote_status(rows, heads)


@query(f"""WITH {RECORDS_SQL} SELECT name, CASE WHEN type = 'path' THEN 'rebuild' WHEN ({STALE_SQL}) / 3600000.0 >= check_interval_hours THEN 'check' ELSE 'skip' END AS action FROM records""")
def inc_remote_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    due = cat.stale(F.col("last_refresh"), F.col("check_interval_hours"), now())
    return records(spark, sf_dir).select("name", refresh.dispatch(F.col("source.type"), False, False, due).alias("action"))


@query(f"""{BOTH_SQL}, el AS (SELECT g.scope, g.name, r.*EXCLUDE (name), r.c % 2 = 1 AND r.n % 2 = 0 AS changed FROM registry g JOIN records r ON g.skill_path = r.skill_path),
old AS (SELECT scope, name FROM el WHERE type = 'path' AND changed ORDER BY last_refresh, scope, name LIMIT 3)
SELECT e.scope, e.name, CASE WHEN type <> 'path' THEN CASE WHEN ({STALE_SQL}) / 3600000.0 >= check_interval_hours THEN 'check' ELSE 'skip' END
  WHEN o.name IS NOT NULL THEN 'rebuild' WHEN changed THEN 'postponed' ELSE 'unchanged' END AS action FROM el e LEFT JOIN old o ON o.scope = e.scope AND o.name = e.name""")  # fmt: skip
def inc_hook_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = records(spark, sf_dir).drop("name")
    changed = (F.col("source.type") == "path") & ((F.col("check_interval_hours") / 24) % 2 == 0)
    return refresh.hook_plan(registry(spark, sf_dir), rows.withColumn("changed", changed), "/work/p", now())


@query("""WITH p AS (SELECT page_id, 'https://github.com/' || regexp_extract(url, '://([^/]+)', 1) || '/' || replace(regexp_extract(url, '://[^/]+/([^?#]*)', 1), '/', '.') || CASE page_id % 6 WHEN 0 THEN '' WHEN 1 THEN '.git'
  WHEN 2 THEN '/tree/main/docs/a' WHEN 3 THEN '/blob/v1.0/README.md' WHEN 4 THEN '/tree/..' ELSE '?x=1' END AS raw FROM pages)
SELECT page_id, CASE WHEN page_id % 6 < 4 THEN regexp_extract(raw, '^(https://github[.]com/[^/]+/[^/]+?)(?:[.]git)?(?:/.*)?$', 1) || '.git' END AS url,
  CASE page_id % 6 WHEN 2 THEN 'main' WHEN 3 THEN 'v1.0' END AS ref, CASE page_id % 6 WHEN 2 THEN 'docs/a' WHEN 3 THEN 'README.md' END AS subpath FROM p""")  # fmt: skip
def src_github_url_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    tail = F.element_at(F.array(*[F.lit(x) for x in ("", ".git", "/tree/main/docs/a", "/blob/v1.0/README.md", "/tree/..", "?x=1")]), (F.col("page_id") % 6 + 1).cast("int"))
    repo = F.replace(F.regexp_extract("url", "://[^/]+/([^?#]*)", 1), F.lit("/"), F.lit("."))
    raw = F.concat(F.lit("https://github.com/"), F.regexp_extract("url", "://([^/]+)", 1), F.lit("/"), repo, tail)
    return pages.select("page_id", urls.parse_repository_url(raw).alias("p")).select("page_id", "p.url", "p.ref", "p.subpath")


PORT_SQL = "CASE page_id % 5 WHEN 0 THEN regexp_replace(url, '^(https?://[^/]+)', '\\1:8443') WHEN 1 THEN regexp_replace(url, '^(https?://)', '\\1u:9@') WHEN 2 THEN regexp_replace(url, '^(https?://[^/]+)', '\\1:443') WHEN 3 THEN url || ':80' ELSE url END"


@query(f"SELECT page_id, coalesce(regexp_matches(split_part(regexp_extract(u, '^[^:]*://([^/?#]*)', 1), '@', -1), ':[0-9]+$'), FALSE) AS port FROM (SELECT page_id, {PORT_SQL} AS u FROM pages)")
def p_explicit_port(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URLs with ports, with credentials that look like one, and with a port's look in the path."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    put = lambda pattern, text: F.regexp_replace("url", pattern, text)
    url = F.element_at(F.array(put("^(https?://[^/]+)", "$1:8443"), put("^(https?://)", "$1u:9@"), put("^(https?://[^/]+)", "$1:443"), F.concat("url", F.lit(":80")), F.col("url")), (F.col("page_id") % 5 + 1).cast("int"))
    return pages.select("page_id", urls.explicit_port(url).alias("port"))


FILES_SQL = """tree AS (SELECT doc_id, 'set-' || CAST(doc_id // 10 AS VARCHAR) AS doc_set, CASE doc_id % 10 WHEN 0 THEN 'README.md' WHEN 1 THEN CASE WHEN doc_id // 10 % 3 > 0 THEN 'docs/a.md' ELSE 'guide/a.md' END WHEN 2 THEN 'documentation/b.mdx' WHEN 3 THEN '.git/c.md'
  WHEN 4 THEN 'node_modules/d.md' WHEN 5 THEN 'LICENSE.md' WHEN 6 THEN 'CHANGELOG.md' WHEN 7 THEN CASE WHEN doc_id // 10 % 3 > 0 THEN 'docs/sub/e.markdown' ELSE 'guide/e.markdown' END WHEN 8 THEN 'x/f.txt' ELSE 'g.MD' END AS rel_path FROM documents)"""


def _tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("README.md", "docs/a.md", "documentation/b.mdx", ".git/c.md", "node_modules/d.md", "LICENSE.md", "CHANGELOG.md", "docs/sub/e.markdown", "x/f.txt", "g.MD")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    name = F.element_at(F.array(*[F.lit(n) for n in names]), (F.col("doc_id") % 10 + 1).cast("int"))
    without_docs = F.expr("doc_id div 10 % 3 = 0")  # a third of the sets have no docs folder
    name = F.when(without_docs & (F.col("doc_id") % 10 == 1), "guide/a.md").when(without_docs & (F.col("doc_id") % 10 == 7), "guide/e.markdown").otherwise(name)
    return docs.select("doc_id", F.concat(F.lit("set-"), F.expr("doc_id div 10").cast("string")).alias("doc_set"), name.alias("rel_path"))


def _usable(rows: DataFrame) -> DataFrame:
    return rows.filter(files.walkable(F.col("rel_path")) & files.usable_name(F.element_at(F.split("rel_path", "/", -1), -1)))


@query(f"WITH {FILES_SQL} SELECT doc_id, rel_path FROM tree WHERE doc_id % 10 IN (0, 1, 2, 7, 9)")
def src_recursive_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _usable(_tree(spark, sf_dir)).select("doc_id", "rel_path")


@query(f"WITH {FILES_SQL} SELECT doc_id, regexp_matches(rel_path, '(?i)[.](md|mdx|markdown)$') AND doc_id % 10 NOT IN (5, 6) AS usable FROM tree")
def src_ext_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tree(spark, sf_dir).select("doc_id", files.usable_name(F.element_at(F.split("rel_path", "/", -1), -1)).alias("usable"))


DISCOVER_SQL = f"""WITH {FILES_SQL}, ok AS (SELECT *, CASE WHEN doc_id % 10 = 0 THEN 0 WHEN starts_with(rel_path, 'docs/') THEN 1 WHEN starts_with(rel_path, 'documentation/') THEN 2 ELSE 9 END AS rank FROM tree WHERE doc_id % 10 IN (0, 1, 2, 7, 9)),
best AS (SELECT doc_set, min(rank) AS b FROM ok WHERE rank > 0 GROUP BY doc_set)
SELECT doc_id, doc_set, CAST(rank AS INTEGER) AS rank, regexp_replace(rel_path, '^(docs|documentation)/', '') AS rel_path FROM ok LEFT JOIN best USING (doc_set) WHERE rank = 0 OR rank = b"""


@query(DISCOVER_SQL)
def src_project_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.discover(_usable(_tree(spark, sf_dir))).select("doc_id", "doc_set", "rank", "rel_path")


@query(f"SELECT doc_id, doc_set FROM ({DISCOVER_SQL}) WHERE rank = 0")
def src_find_readme(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src_project_discovery(spark, sf_dir).filter("rank = 0").select("doc_id", "doc_set")


@query(f"SELECT doc_set, rel_path, CAST(row_number() OVER (PARTITION BY doc_set ORDER BY rank > 0, lower(rel_path)) AS INTEGER) AS file_ord FROM ({DISCOVER_SQL})")
def set_readme_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    rows = src_project_discovery(spark, sf_dir)
    order = Window.partitionBy("doc_set").orderBy(F.col("rank") > 0, F.lower("rel_path"))
    return rows.select("doc_set", "rel_path", F.row_number().over(order).alias("file_ord"))
