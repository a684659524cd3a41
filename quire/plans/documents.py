"""Queries over the derived Markdown corpus: text, sections, trees, order, detectors, plans, rendering."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import markdown as md
from quire.functions import text as tx
from quire.operators import order, scan, tree
from quire.sources.corpus import CORPUS_SQL, LINES_SQL, corpus, raw_documents

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def add(function):
        key = name or function.__name__
        QUERIES[key] = function
        if sql:
            ORACLES[key] = sql
        return function

    return add


def path_text(column: str = "path") -> F.Column:
    return F.array_join(F.transform(column, lambda x: x.cast("string")), ".")


TRIM = r"'^[\s\x{00A0}\x{FEFF}]+|[\s\x{00A0}\x{FEFF}]+$', '', 'g'"
SEGMENTS_SQL = f"""WITH {CORPUS_SQL}, {LINES_SQL},
seg AS (SELECT doc_id, before AS seg, max(before % 2) AS code, CAST(ceil((sum(length(line)) + count(*) - 1) / (CASE WHEN max(before % 2) = 1 THEN 3.0 ELSE 4.0 END)) AS BIGINT) AS n
        FROM lines WHERE NOT fence GROUP BY doc_id, before
        UNION ALL SELECT doc_id, -1, 0, CAST(sum(ceil(length(t) / 4.0)) AS BIGINT) FROM lines WHERE fence GROUP BY doc_id),
tokens AS (SELECT doc_id, CAST(sum(n) AS BIGINT) AS tokens FROM seg GROUP BY doc_id)"""


@query(SEGMENTS_SQL + " SELECT doc_id, tokens FROM tokens")
def md_estimate_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark, sf_dir).select("doc_id", md.estimate_tokens(F.col("content")).alias("tokens"))


@query(SEGMENTS_SQL + " SELECT c.doc_set, CAST(sum(t.tokens) AS BIGINT) AS tokens, count(*) AS n_files FROM corpus c JOIN tokens t USING (doc_id) GROUP BY c.doc_set")
def a_segment_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark, sf_dir).groupBy("doc_set").agg(F.sum(md.estimate_tokens(F.col("content"))).alias("tokens"), F.count(F.lit(1)).alias("n_files"))


@query(f"""WITH {CORPUS_SQL} SELECT doc_set, count(*) AS n_files, CAST(sum(octet_length(encode(content))) AS BIGINT) AS n_bytes,
           count(*) <= 50 AND sum(octet_length(encode(content))) <= 100000 AS within_caps FROM corpus GROUP BY doc_set""")  # fmt: skip
def src_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order.caps(corpus(spark, sf_dir), 50, 100_000)


@query(f"WITH {CORPUS_SQL} SELECT CAST(sum(octet_length(encode(content))) AS BIGINT) AS n_bytes, count(*) AS n_files FROM corpus")
def a_fileset_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark, sf_dir).agg(F.sum(F.octet_length("content").cast("long")).alias("n_bytes"), F.count(F.lit(1)).alias("n_files"))


SUMMARY_SQL = f"""WITH {CORPUS_SQL}, {LINES_SQL},
kept AS (SELECT * FROM lines WHERE before % 2 = 0),
para AS (SELECT *, sum((t = '')::INT) OVER (PARTITION BY doc_id ORDER BY line_no) AS p FROM kept),
text_of AS (SELECT doc_id, p, first(t ORDER BY line_no) AS head, string_agg(t, ' ' ORDER BY line_no) AS joined FROM para WHERE t <> '' GROUP BY doc_id, p),
prose AS (SELECT doc_id, first(joined ORDER BY p) AS s FROM text_of
          WHERE NOT starts_with(head, '```') AND NOT regexp_matches(head, '^(#{{1,6}}(\\s|$)|[|>]|[-*+]\\s|[0-9]+\\.\\s)') GROUP BY doc_id),
cut AS (SELECT doc_id, CASE WHEN length(s) <= 120 THEN s WHEN strpos(substr(s, 1, 121), ' ') = 0 THEN substr(s, 1, 120)
        ELSE substr(s, 1, 121 - strpos(reverse(substr(s, 1, 121)), ' ')) END AS s FROM prose)"""


@query(SUMMARY_SQL + " SELECT c.doc_id, coalesce(s, '') AS summary FROM corpus c LEFT JOIN cut USING (doc_id)")
def md_first_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark, sf_dir).select("doc_id", md.first_summary(F.col("content")).alias("summary"))


@query(SUMMARY_SQL + " SELECT c.doc_id, s AS paragraph FROM corpus c LEFT JOIN prose USING (doc_id)")
def k_first_paragraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark, sf_dir).select("doc_id", md.first_paragraph(F.col("content")).alias("paragraph"))


BLANKS_SQL = "replace(replace(coalesce(text, ''), ' ', chr(10)), ',', chr(10) || chr(10))"


@query(f"SELECT doc_id, regexp_replace(regexp_replace({BLANKS_SQL}, '\\n{{2,}}', chr(10) || chr(10), 'g'), '^\\n+|\\n+$', '', 'g') AS collapsed FROM documents")
def w_blank_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of blank lines in texts whose blanks and commas are line feeds."""
    text = F.replace(F.replace(F.coalesce("text", F.lit("")), F.lit(" "), F.lit("\n")), F.lit(","), F.lit("\n\n"))
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", md.collapse_blanks(text).alias("collapsed"))


@query(f"""WITH {CORPUS_SQL}, {LINES_SQL} SELECT doc_id, CAST(line_no AS INTEGER) AS line_no FROM lines
           WHERE regexp_matches(t, '^(#{{1,6}}(\\s|$)|[|>]|[-*+]\\s|[0-9]+\\.\\s)')""")  # fmt: skip
def p_non_prose(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = corpus(spark, sf_dir).select("doc_id", F.posexplode(F.split("content", "\n", -1)).alias("line_no", "line"))
    t = tx.js_trim(F.col("line"))
    return rows.filter(t.rlike(md.NON_PROSE) & ~t.startswith("```")).select("doc_id", "line_no")


@query("""SELECT doc_id, CASE WHEN length(s) <= 40 THEN s WHEN strpos(substr(s, 1, 41), ' ') = 0 THEN substr(s, 1, 40)
          ELSE substr(s, 1, 41 - strpos(reverse(substr(s, 1, 41)), ' ')) END AS cut FROM (SELECT doc_id, coalesce(text, '') AS s FROM documents)""")  # fmt: skip
def md_truncate_word(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", tx.truncate_word(F.coalesce("text", F.lit("")), 40).alias("cut"))


@query(r"SELECT p_partkey, trim(regexp_replace(replace(p_name, ' ', '_-_'), '[-_]+', ' ', 'g')) AS title FROM part")
def md_humanize(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    return part.select("p_partkey", tx.humanize(F.replace("p_name", F.lit(" "), F.lit("_-_"))).alias("title"))


@query(f"WITH {CORPUS_SQL} SELECT doc_id, regexp_replace(regexp_extract(rel_path, '([^/]*)$', 1), '\\.[^.]+$', '') AS base FROM corpus")
def md_file_base_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark, sf_dir).select("doc_id", tx.base_name(F.col("rel_path")).alias("base"))


@query("""SELECT o_orderkey, CAST(nullif(regexp_extract(f, '^([0-9]+)(?:[-_.]|$)', 1), '') AS DOUBLE) AS prefix
          FROM (SELECT o_orderkey, o_orderpriority || '.md' AS f FROM orders)""")  # fmt: skip
def md_numeric_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return orders.select("o_orderkey", tx.numeric_prefix(F.concat("o_orderpriority", F.lit(".md"))).alias("prefix"))


@query("SELECT doc_id, substr(t, 1, 64) AS slug_cap, substr(t, 1, 120) AS summary_cap, substr(t, 1, 200) AS excerpt_cap, substr(t, 1, 1024) AS description_cap, substr(t, 1, 7) AS sha_cap FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)")
def k_text_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.coalesce("text", F.lit(""))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", *[tx.cap(t, n).alias(c) for c, n in (("slug_cap", 64), ("summary_cap", 120), ("excerpt_cap", 200), ("description_cap", 1024), ("sha_cap", 7))])


SLUG_SQL = "CASE WHEN {s} IN ('', 'con', 'prn', 'aux', 'nul') OR regexp_matches({s}, '^(com|lpt)[1-9]$') THEN 'section' ELSE {s} END"


def slug_sql(column: str) -> str:
    return SLUG_SQL.format(s=f"regexp_replace(substr(regexp_replace(regexp_replace(lower({column}), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 64), '-+$', '')")


HEADS_SQL = f"""WITH RECURSIVE {CORPUS_SQL}, {LINES_SQL},
heads0 AS (SELECT *, NOT fence AND before % 2 = 0 AND regexp_matches(t, '^#{{1,6}}[\\s]+[^\\s]') AS is_head FROM lines),
heads1 AS (SELECT *, CAST(sum(is_head::INT) OVER (PARTITION BY doc_id ORDER BY line_no) AS INTEGER) AS ord FROM heads0),
sec AS (SELECT doc_set, file_ord, doc_id, ord, max(CASE WHEN is_head THEN length(regexp_extract(t, '^(#+)', 1)) ELSE 0 END) AS level,
          max(CASE WHEN is_head THEN regexp_replace(regexp_replace(t, '^#+[\\s]+', ''), {TRIM}) END) AS name,
          coalesce(regexp_replace(string_agg(line, chr(10) ORDER BY line_no) FILTER (NOT is_head), {TRIM}), '') AS body
        FROM heads1 GROUP BY ALL),
sec0 AS (SELECT c.doc_set, c.file_ord, c.doc_id, 0 AS ord, 0 AS level, CAST(NULL AS VARCHAR) AS name, coalesce(s.body, '') AS body FROM corpus c LEFT JOIN sec s ON s.doc_id = c.doc_id AND s.ord = 0
         UNION ALL SELECT doc_set, file_ord, doc_id, ord, level, name, body FROM sec WHERE ord > 0),
par AS (SELECT a.doc_id, a.ord, max(b.ord) AS parent FROM sec0 a LEFT JOIN sec0 b ON a.doc_id = b.doc_id AND b.ord > 0 AND b.ord < a.ord AND b.level < a.level WHERE a.ord > 0 GROUP BY ALL)"""


@query(HEADS_SQL + " SELECT doc_set, file_ord, ord, CAST(level AS INTEGER) AS level, name, body FROM sec0")
def t_parse_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.headings(corpus(spark, sf_dir))


@query(HEADS_SQL + " SELECT s.doc_set, s.file_ord, s.ord, p.parent FROM sec0 s JOIN par p USING (doc_id, ord)")
def w_heading_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.heading_paths(corpus(spark, sf_dir)).select("doc_set", "file_ord", "ord", "parent")


@query(HEADS_SQL + ", up AS (SELECT doc_id, parent AS ord, count(*) AS n FROM par WHERE parent IS NOT NULL GROUP BY ALL) SELECT s.doc_set, s.file_ord, s.ord, coalesce(n, 0) AS n_children FROM sec0 s LEFT JOIN up USING (doc_id, ord) WHERE s.ord > 0")
def t_nest_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many headings nest directly in each heading."""
    return tree.heading_paths(corpus(spark, sf_dir)).select("doc_set", "file_ord", "ord", "n_children")


@query(HEADS_SQL + " SELECT a.doc_set, a.file_ord, a.ord, a.name, b.name AS parent_name FROM sec0 a JOIN par p USING (doc_id, ord) JOIN sec0 b ON b.doc_id = a.doc_id AND b.ord = p.parent")
def j_heading_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings joined with the heading that encloses them."""
    rows = tree.heading_paths(corpus(spark, sf_dir))
    up = rows.select("doc_set", "file_ord", F.col("ord").alias("parent"), F.col("name").alias("parent_name"))
    return rows.join(up, ["doc_set", "file_ord", "parent"]).select("doc_set", "file_ord", "ord", "name", "parent_name")


NAMES_SQL = HEADS_SQL + f""",
h1 AS (SELECT doc_id, first(name ORDER BY ord) AS h1 FROM sec0 WHERE level = 1 GROUP BY doc_id),
named AS (SELECT c.*, h1, coalesce(nullif(trim(title), ''), nullif(h1, ''), regexp_replace(regexp_extract(rel_path, '([^/]*)$', 1), '\\.[^.]+$', '')) AS name FROM corpus c LEFT JOIN h1 USING (doc_id))"""


@query(NAMES_SQL + " SELECT doc_id, name FROM named")
def md_file_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.file_names(corpus(spark, sf_dir)).select("doc_id", "name")


@query(NAMES_SQL + " SELECT doc_id, h1 FROM named WHERE h1 IS NOT NULL")
def w_first_h1(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tree.headings(corpus(spark, sf_dir).withColumn("file_ord", F.col("doc_id"))).filter("level = 1")
    return rows.groupBy(F.col("file_ord").alias("doc_id")).agg(F.min_by("name", "ord").alias("h1"))


@query(f"WITH {CORPUS_SQL} SELECT doc_set, regexp_extract(rel_path, '^(.*)/', 1) AS folder, min(file_ord) AS first_ord, CAST(1 AS INTEGER) AS depth FROM corpus GROUP BY ALL")
def w_first_seen_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.folders(corpus(spark, sf_dir))


@query(f"WITH {CORPUS_SQL}, f AS (SELECT *, regexp_extract(rel_path, '^(.*)/', 1) AS folder FROM corpus) SELECT doc_set, file_ord, folder, min(file_ord) OVER (PARTITION BY doc_set, folder) AS first_ord FROM f")
def j_folder_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files joined with the folder they are in."""
    docs = corpus(spark, sf_dir).select("doc_set", "file_ord", "rel_path")
    return docs.withColumn("folder", tx.directory(F.col("rel_path"))).join(tree.folders(docs), ["doc_set", "folder"]).select("doc_set", "file_ord", "folder", "first_ord")


TREE_SQL = NAMES_SQL + """,
first_of AS (SELECT doc_set, regexp_extract(rel_path, '^(.*)/', 1) AS folder, min(file_ord) AS f FROM corpus GROUP BY ALL),
homes AS (SELECT n.doc_set, n.doc_id, n.name, f.folder, f.f, CAST(f.f AS VARCHAR) || '.' || CAST(n.file_ord AS VARCHAR) AS path FROM named n JOIN first_of f ON f.doc_set = n.doc_set AND f.folder = regexp_extract(n.rel_path, '^(.*)/', 1)),
chain AS (SELECT h.doc_set, p.doc_id, p.ord, h.path || '.' || CAST(p.ord AS VARCHAR) AS path, h.path AS up FROM par p JOIN homes h USING (doc_id) WHERE p.parent IS NULL
          UNION ALL SELECT c.doc_set, p.doc_id, p.ord, c.path || '.' || CAST(p.ord AS VARCHAR), c.path FROM par p JOIN chain c ON c.doc_id = p.doc_id AND c.ord = p.parent),
nodes AS (SELECT DISTINCT doc_set, '' AS path, CAST(NULL AS VARCHAR) AS up, 'root' AS kind, 'Docs' AS name, '' AS body FROM corpus
          UNION ALL SELECT doc_set, CAST(f AS VARCHAR), '', 'folder', trim(regexp_replace(folder, '[-_]+', ' ', 'g')), '' FROM first_of
          UNION ALL SELECT h.doc_set, h.path, CAST(h.f AS VARCHAR), 'file', h.name, s.body FROM homes h JOIN sec0 s ON s.doc_id = h.doc_id AND s.ord = 0
          UNION ALL SELECT c.doc_set, c.path, c.up, 'heading', s.name, s.body FROM chain c JOIN sec0 s USING (doc_id, ord))"""


@query(TREE_SQL + " SELECT doc_set, path, kind, name, body FROM nodes")
def t_build_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.build_tree(corpus(spark, sf_dir)).withColumn("path", path_text())


COLLAPSE_SQL = TREE_SQL + """,
kids AS (SELECT doc_set, up AS path, count(*) AS n FROM nodes WHERE up IS NOT NULL GROUP BY ALL),
gone AS (SELECT n.doc_set, n.path FROM nodes n JOIN kids k USING (doc_set, path) WHERE n.path <> '' AND n.body = '' AND k.n = 1),
kept AS (SELECT n.* FROM nodes n ANTI JOIN gone g USING (doc_set, path)),
climb AS (SELECT doc_set, path, up FROM kept UNION ALL SELECT c.doc_set, c.path, n.up FROM climb c JOIN gone g ON g.doc_set = c.doc_set AND g.path = c.up JOIN nodes n ON n.doc_set = c.doc_set AND n.path = c.up),
above AS (SELECT c.doc_set, c.path, c.up FROM climb c ANTI JOIN gone g ON g.doc_set = c.doc_set AND g.path = c.up),
slim AS (SELECT k.doc_set, k.path, a.up AS parent_path, k.kind, k.name, k.body FROM kept k JOIN above a USING (doc_set, path))"""


@query(COLLAPSE_SQL + " SELECT doc_set, path, parent_path, kind, name FROM slim")
def t_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tree.collapsed(tree.parse(corpus(spark, sf_dir)))
    return rows.select("doc_set", path_text().alias("path"), path_text("parent_path").alias("parent_path"), "kind", "name")


SIZED_SQL = COLLAPSE_SQL + """,
body_lines AS (SELECT doc_set, path, unnest(str_split(body, chr(10))) AS line, generate_subscripts(str_split(body, chr(10)), 1) AS i FROM slim WHERE body <> ''),
body_fences AS (SELECT *, starts_with(trim(line), '```') AS fence FROM body_lines),
body_parts AS (SELECT *, coalesce(sum(fence::INT) OVER (PARTITION BY doc_set, path ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS part FROM body_fences),
body_sizes AS (SELECT doc_set, path, ceil((sum(length(line)) + count(*) - 1) / (CASE WHEN part % 2 = 1 THEN 3.0 ELSE 4.0 END)) AS n FROM body_parts WHERE NOT fence GROUP BY doc_set, path, part
               UNION ALL SELECT doc_set, path, ceil(length(trim(line)) / 4.0) FROM body_parts WHERE fence),
own AS (SELECT s.doc_set, s.path, CAST(coalesce(sum(b.n), 0) AS BIGINT) AS own_tokens FROM slim s LEFT JOIN body_sizes b USING (doc_set, path) GROUP BY ALL),
ups AS (SELECT doc_set, path AS at, path FROM slim UNION ALL SELECT u.doc_set, u.at, s.parent_path FROM ups u JOIN slim s ON s.doc_set = u.doc_set AND s.path = u.path WHERE s.parent_path IS NOT NULL),
sized AS (SELECT u.doc_set, u.path, CAST(sum(o.own_tokens) AS BIGINT) AS subtree_tokens FROM ups u JOIN own o ON o.doc_set = u.doc_set AND o.path = u.at GROUP BY ALL)"""


@query(SIZED_SQL + " SELECT doc_set, path, own_tokens, subtree_tokens FROM own JOIN sized USING (doc_set, path)")
def a_subtree_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.sized_tree(corpus(spark, sf_dir)).nodes.select("doc_set", path_text().alias("path"), "own_tokens", "subtree_tokens")


@query(SIZED_SQL + " SELECT doc_set, path, own_tokens FROM own")
def t_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of the nodes' own texts, counted from the texts themselves."""
    rows = tree.sized_tree(corpus(spark, sf_dir)).with_bodies()
    return rows.select("doc_set", path_text().alias("path"), md.estimate_tokens(F.col("body")).alias("own_tokens"))


@query(SIZED_SQL + """, depths AS (SELECT doc_set, path, 0 AS depth FROM slim WHERE path = '' UNION ALL SELECT s.doc_set, s.path, d.depth + 1 FROM depths d JOIN slim s ON s.doc_set = d.doc_set AND s.parent_path = d.path)
SELECT s.doc_set, s.path, s.parent_path, s.kind, s.name, s.body, CAST(d.depth AS INTEGER) AS depth, z.subtree_tokens FROM slim s JOIN sized z USING (doc_set, path) JOIN depths d USING (doc_set, path)""")
def t_build_sized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole sized tree with its texts."""
    rows = tree.sized_tree(corpus(spark, sf_dir)).with_bodies()
    return rows.select("doc_set", path_text().alias("path"), path_text("parent_path").alias("parent_path"), "kind", "name", "body", "depth", "subtree_tokens")


@query(f"SELECT p_partkey, {slug_sql('p_name')} AS slug FROM part")
def md_slug(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", tx.slug(F.col("p_name")).alias("slug"))


@query(f"""WITH s AS (SELECT p_partkey, p_brand, {slug_sql('p_type')} AS base FROM part)
           SELECT p_partkey, base || CASE WHEN row_number() OVER w = 1 THEN '' ELSE '-' || CAST(row_number() OVER w AS VARCHAR) END AS slug
           FROM s WINDOW w AS (PARTITION BY p_brand, base ORDER BY p_partkey)""")  # fmt: skip
def w_slug_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_brand", tx.slug(F.col("p_type")).alias("base"))
    nth = F.row_number().over(Window.partitionBy("p_brand", "base").orderBy("p_partkey"))
    return part.withColumn("slug", F.concat("base", F.when(nth == 1, "").otherwise(F.concat(F.lit("-"), nth.cast("string"))))).select("p_partkey", "slug")


@query("SELECT doc_id, '\"' || replace(replace(replace(t, chr(92), chr(92) || chr(92)), '\"', chr(92) || '\"'), chr(10), chr(92) || 'n') || '\"' AS scalar FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)")
def r_yaml_scalar(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", tx.yaml_scalar(F.coalesce("text", F.lit(""))).alias("scalar"))


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tree.headings(corpus(spark, sf_dir).withColumn("file_ord", F.col("doc_id"))).filter("ord > 0")
    return rows.select(F.col("file_ord").alias("doc_id"), "ord", F.concat("name", F.lit(" [x] (y) a\\b")).alias("name"))


NAMES_WITH_MARKS = HEADS_SQL + ", marked AS (SELECT doc_id, ord, name || ' [x] (y) a' || chr(92) || 'b' AS name FROM sec0 WHERE ord > 0)"


@query(NAMES_WITH_MARKS + " SELECT doc_id, ord, replace(replace(replace(name, chr(92), chr(92) || chr(92)), '[', chr(92) || '['), ']', chr(92) || ']') AS link_text FROM marked")
def r_escape_link_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _names(spark, sf_dir).select("doc_id", "ord", tx.escape_link_text(F.col("name")).alias("link_text"))


@query(NAMES_WITH_MARKS + " SELECT doc_id, ord, replace(replace(replace(name, '(', '%28'), ')', '%29'), ' ', '%20') AS target FROM marked")
def r_escape_link_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _names(spark, sf_dir).select("doc_id", "ord", tx.escape_link_target(F.col("name")).alias("target"))


@query(f"WITH {CORPUS_SQL} SELECT doc_id, regexp_extract(rel_path, '([^/]*)$', 1) AS link FROM corpus")
def r_relative_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = corpus(spark, sf_dir)
    return df.select("doc_id", tx.relative_link(F.concat(tx.directory(F.col("rel_path")), F.lit("/index.md")), F.col("rel_path")).alias("link"))


@query(f"""WITH {CORPUS_SQL}, x AS (SELECT doc_set, rel_path, file_ord, unhex(lpad(printf('%X', octet_length(encode(rel_path))), 8, '0')) || encode(rel_path) || unhex(lpad(printf('%X', octet_length(encode(content))), 8, '0')) || encode(content) AS c FROM corpus),
y AS (SELECT doc_set, string_agg(hex(c), '' ORDER BY rel_path) AS h FROM x GROUP BY doc_set)
SELECT doc_set, 'sha256:' || sha256(unhex(h || '000000013100000004' || hex(encode('4000')) || '00000005' || hex(encode('false')))) AS source_hash FROM y""")  # fmt: skip
def a_fileset_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order.fileset_hash(corpus(spark, sf_dir), 1, 4000, False)


@query(f"WITH {CORPUS_SQL} SELECT doc_set, doc_id, CAST(row_number() OVER (PARTITION BY doc_set ORDER BY rel_path, file_ord) AS INTEGER) AS place FROM corpus")
def s_hash_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    return corpus(spark, sf_dir).select("doc_set", "doc_id", F.row_number().over(Window.partitionBy("doc_set").orderBy("rel_path", "file_ord")).alias("place"))


@query(f"""WITH {CORPUS_SQL} SELECT doc_set, doc_id, CAST(row_number() OVER (PARTITION BY doc_set, regexp_extract(rel_path, '^(.*)/', 1) ORDER BY sidebar_position NULLS LAST,
           CAST(regexp_extract(rel_path, '/([0-9]+)[.]md$', 1) AS DOUBLE), rel_path) AS INTEGER) AS place FROM corpus""")  # fmt: skip
def s_doc_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order.ranked_within_folder(corpus(spark, sf_dir)).select("doc_set", "doc_id", "place")


@query(f"""WITH {CORPUS_SQL}, f AS (SELECT *, regexp_extract(rel_path, '^(.*)/', 1) AS folder FROM corpus)
SELECT doc_set, doc_id, CAST(row_number() OVER (PARTITION BY doc_set ORDER BY folder, sidebar_position NULLS LAST, CAST(regexp_extract(rel_path, '/([0-9]+)[.]md$', 1) AS DOUBLE), rel_path) AS INTEGER) AS file_ord FROM f""")  # fmt: skip
def s_dfs_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order.depth_first(corpus(spark, sf_dir)).select("doc_set", "doc_id", "file_ord")


FENCED_SQL = f"""WITH {CORPUS_SQL}, {LINES_SQL},
run AS (SELECT *, starts_with(t, '~~~') AS tilde FROM lines),
run2 AS (SELECT *, coalesce(sum(tilde::INT) OVER (PARTITION BY doc_id ORDER BY line_no), 0) % 2 = 1 AS in_tilde FROM run),
st AS (SELECT *, CAST(line_no + 1 AS INTEGER) AS line_at, (before + fence::INT) % 2 = 1 OR in_tilde AS in_fence FROM run2)"""


@query(FENCED_SQL + " SELECT doc_set, rel_path AS relative_path, line_at AS line_no, in_fence FROM st JOIN (SELECT doc_id, rel_path FROM corpus) USING (doc_id)")
def scan_fence_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.fenced_lines(corpus(spark, sf_dir).withColumnRenamed("rel_path", "relative_path")).select("doc_set", "relative_path", "line_no", "in_fence")


SHELL_SQL = r"\|\s*(sudo\s+)?(sh|bash|zsh|dash|ksh|fish)\b"
FINDINGS_SQL = FENCED_SQL + f""",
found AS (SELECT doc_id, line_at AS line, t, unnest(list_filter([
  CASE WHEN {" OR ".join(f"contains(lower(line), '{p}')" for p in scan.PHRASES)} THEN 'instruction-override' END,
  CASE WHEN NOT in_fence AND regexp_matches(t, '(?i)^(system|assistant|user):') THEN 'role-marker' END,
  CASE WHEN NOT in_fence AND regexp_matches(line, '(?i)\\b(always|every time)\\b') AND regexp_matches(line, '(?i)\\b(this skill|before responding|before answering)\\b') THEN 'always-invoke' END,
  CASE WHEN regexp_matches(line, '(?i)\\b(curl|wget)\\b.*{SHELL_SQL}') THEN 'curl-pipe-shell' END,
  CASE WHEN regexp_matches(line, '(?i)base64\\s+(-d|--decode)\\b.*{SHELL_SQL}') THEN 'base64-decode' END,
  CASE WHEN in_fence AND fence AND lower(trim(substr(t, 4))) IN ('tool', 'function', 'tool_call', 'json tool') THEN 'tool-call-fence' END,
  CASE WHEN in_fence AND NOT fence AND contains(line, '"name": "') AND before = (SELECT max(l2.before) FROM lines l2 WHERE l2.doc_id = st.doc_id AND contains(l2.line, '"arguments":')) THEN 'tool-call-fence' END
  ], lambda x: x IS NOT NULL)) AS pattern FROM st)
SELECT c.doc_set, c.rel_path AS relative_path, f.line, f.pattern, substr(f.t, 1, 200) AS excerpt FROM found f JOIN corpus c USING (doc_id)"""


@query(FINDINGS_SQL)
def scan_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.scan(corpus(spark, sf_dir).withColumnRenamed("rel_path", "relative_path"))


def _detector(key: str, pattern: str) -> None:
    @query(f"SELECT * FROM ({FINDINGS_SQL}) WHERE pattern = '{pattern}'", name=key)
    def detector(spark: SparkSession, sf_dir: str) -> DataFrame:
        return scan_all(spark, sf_dir).filter(F.col("pattern") == pattern)


for _key, _pattern in (("scan_override", "instruction-override"), ("scan_role", "role-marker"), ("scan_always", "always-invoke"), ("scan_curl", "curl-pipe-shell"), ("scan_base64", "base64-decode")):
    _detector(_key, _pattern)


def _by_rule(spark: SparkSession, sf_dir: str, rule: str) -> DataFrame:
    rows = scan.findings(scan.fenced_lines(corpus(spark, sf_dir).withColumnRenamed("rel_path", "relative_path")))
    return rows.filter(F.col("rule") == rule).drop("rule")


TOOL_SQL = "SELECT c.doc_set, c.rel_path AS relative_path, s.line_at AS line, 'tool-call-fence' AS pattern, substr(s.t, 1, 200) AS excerpt FROM st s JOIN corpus c USING (doc_id) WHERE "


@query(FENCED_SQL + " " + TOOL_SQL + "s.in_fence AND s.fence AND lower(trim(substr(s.t, 4))) IN ('tool', 'function', 'tool_call', 'json tool')")
def scan_tool_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by_rule(spark, sf_dir, "tool-info")


@query(FENCED_SQL + """, args AS (SELECT DISTINCT doc_id, before FROM lines WHERE contains(line, '"arguments":') AND NOT fence) """ + TOOL_SQL + """s.in_fence AND NOT s.fence AND contains(s.line, '"name": "') AND EXISTS (SELECT 1 FROM args a WHERE a.doc_id = s.doc_id AND a.before = s.before)""")
def scan_tool_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by_rule(spark, sf_dir, "tool-json")


@query(f"SELECT pattern, count(*) AS n FROM ({FINDINGS_SQL}) GROUP BY pattern")
def a_finding_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_all(spark, sf_dir).groupBy("pattern").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT DISTINCT relative_path, line, excerpt FROM ({FINDINGS_SQL})")
def scan_excerpt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_all(spark, sf_dir).select("relative_path", "line", "excerpt").distinct()


@query(f"WITH {CORPUS_SQL} SELECT doc_id, trim(title) AS title, sidebar_position, CASE WHEN draft THEN TRUE END AS draft FROM corpus")
def md_frontmatter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_documents(spark, sf_dir).select("doc_id", md.frontmatter(F.col("raw")).alias("f")).select("doc_id", "f.*")


STRIP_SQL = f"""WITH {CORPUS_SQL}, {LINES_SQL},
tag AS (SELECT *, regexp_extract(t, '^<([A-Za-z][A-Za-z0-9_.-]*)', 1) AS el FROM lines),
ev AS (SELECT doc_id, line_no, CASE
    WHEN before % 2 = 1 THEN [['V', line]]
    WHEN fence THEN [['C', line]]
    WHEN t = '' OR t = '</TabItem>' THEN [['P', '']]
    WHEN regexp_matches(t, '^import\\s.*[''"]') OR regexp_matches(t, '^export\\s+(?:default|const|let|var|function|async|class|\\{{)') OR t = ':::' THEN []
    WHEN regexp_matches(t, '^:::\\S') THEN [['C', '**' || upper(substr(trim(substr(t, 4)), 1, 1)) || substr(trim(substr(t, 4)), 2) || ':**']]
    WHEN regexp_matches(t, '^<TabItem\\b[^>]*>.*</TabItem>$') AND regexp_matches(t, 'label=["'']') THEN [['C', '**' || regexp_extract(t, 'label=["'']([^"'']*)["'']', 1) || ':**'], ['P', ''], ['C', regexp_extract(t, '^<TabItem\\b[^>]*>(.*)</TabItem>$', 1)], ['P', '']]
    WHEN regexp_matches(t, '^<TabItem\\b[^>]*>$') AND regexp_matches(t, 'label=["'']') THEN [['C', '**' || regexp_extract(t, 'label=["'']([^"'']*)["'']', 1) || ':**'], ['P', '']]
    WHEN regexp_matches(t, '^<TabItem\\b[^>]*>$') THEN []
    WHEN el <> '' AND regexp_matches(t, '^<[A-Za-z][A-Za-z0-9_.-]*(?:\\s[^>]*)?/>$') THEN [['C', '[unrendered component: ' || el || ']']]
    WHEN el <> '' AND regexp_matches(t, '^<[A-Za-z][A-Za-z0-9_.-]*(?:\\s[^>]*)?>') AND ends_with(t, '</' || el || '>') THEN [['C', regexp_replace(regexp_replace(t, '^<[^>]*>', ''), '</[^<>]*>$', '')]]
    WHEN el <> '' AND regexp_matches(t, '^<[A-Za-z][A-Za-z0-9_.-]*(?:\\s[^>]*)?>$') THEN []
    WHEN regexp_matches(t, '^</[A-Za-z][A-Za-z0-9_.-]*>$') THEN []
    ELSE [['C', line]] END AS evs FROM tag),
flat AS (SELECT doc_id, line_no, unnest(evs) AS e, generate_subscripts(evs, 1) AS i FROM ev WHERE len(evs) > 0),
seq AS (SELECT doc_id, e[1] AS k, e[2] AS s, row_number() OVER (PARTITION BY doc_id ORDER BY line_no, i) AS n FROM flat),
marks AS (SELECT *, max(CASE WHEN k = 'C' THEN n END) OVER b AS last_c, max(CASE WHEN k = 'P' THEN n END) OVER b AS last_p FROM seq
          WINDOW b AS (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
made AS (SELECT doc_id, string_agg(CASE WHEN k = 'C' AND last_c IS NOT NULL AND last_p > last_c THEN chr(10) || s ELSE s END, chr(10) ORDER BY n) AS stripped FROM marks WHERE k <> 'P' GROUP BY doc_id)"""


@query(STRIP_SQL + " SELECT c.doc_id, coalesce(m.stripped, '') AS stripped FROM corpus c LEFT JOIN made m USING (doc_id)")
def md_strip_mdx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark, sf_dir).select("doc_id", md.strip_mdx(F.col("content")).alias("stripped"))


@query(STRIP_SQL + " SELECT c.rel_path, c.doc_set, trim(c.title) AS title, c.sidebar_position, m.stripped AS content FROM corpus c JOIN made m USING (doc_id) WHERE NOT c.draft AND trim(m.stripped) <> ''")
def src_process_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.sources.files import process

    rows = process(raw_documents(spark, sf_dir).drop("title", "sidebar_position", "draft", "content").withColumn("size_bytes", F.octet_length("raw")), include_large=True)
    return rows.select("rel_path", "doc_set", "title", "sidebar_position", "content")


@query(f"WITH {CORPUS_SQL} SELECT doc_set, rel_path FROM corpus WHERE octet_length(encode(content)) <= 4096")
def src_size_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.sources.files import size_guard

    return corpus(spark, sf_dir).filter(size_guard(F.octet_length("content"), False, 4096)).select("doc_set", "rel_path")


@query(f"WITH {CORPUS_SQL} SELECT doc_set, rel_path FROM corpus WHERE NOT draft")
def src_draft_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.sources.files import published

    return corpus(spark, sf_dir).filter(published(F.col("draft"))).select("doc_set", "rel_path")
