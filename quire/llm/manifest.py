"""Merkle manifest of a dataset: every row a leaf, a tree a language, a root over all, and an inclusion proof a row.

A leaf is the sha256 of the row's fields, each ``-`` if null, else ``length:value`` with the length in UTF-8 bytes. Digests
are hex text all the way up. Leaves of a group ascend by key; ``fanout`` consecutive nodes become the hash of their concatenation, the last run
may be shorter and even a single node is hashed, until one node is left, the group's subroot. Subroots in the order of groups
give the root by the same rule.

Spark ranks the leaves (range partitions and their sizes) and deals them out in aligned blocks of ``fanout ** LEVELS`` leaves,
so no group, however hot, meets in one task. In a task a block is one contiguous numpy matrix of 64-byte rows: a level is the
matrix reshaped by the fanout and hashed row by row, and siblings are found by index arithmetic on it. The block's
top goes to the next round as a leaf among block tops, a ``fanout ** LEVELS``-th as many; the last rounds work on a row a group, and then on one node. Proofs come back
down the same way: a block is given its own proof once and extends it for each node in it.

Defined results: rows that repeat all fields are leaves of their own, side by side; a null key sorts first, a null group is
a group of its own that sorts first, an empty string is another one; rows that share a key are ordered by their digests;
an empty table gives an empty result; a single row's leaf is its subroot and the root; extra columns are ignored. Texts are read whole, by
Spark's own functions, once.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm._ranks import ranked
from quire.runtime import materialize, ship_code, spread

FANOUT, LEVELS = 2, 12
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def field_digest(*values: Column) -> Column:
    """sha256 of fields, each with its length in UTF-8 bytes; a null is ``-``."""
    parts = [F.coalesce(F.concat(F.octet_length(v.cast("string")).cast("string"), F.lit(":"), v.cast("string")), F.lit("-")) for v in values]
    return F.sha2(F.concat(*parts), 256)


def hash_rows(data: bytes, width: int) -> list[str]:
    view = memoryview(data)
    return [hashlib.sha256(view[i : i + width]).hexdigest() for i in range(0, len(data), width)]


def as_matrix(digests: list[str]) -> np.ndarray:
    return np.frombuffer("".join(digests).encode("ascii"), dtype=np.uint8).reshape(-1, 64)


def depth(n: int, fanout: int) -> int:
    """Levels above ``n`` nodes until one is left."""
    out = 0
    while n > 1:
        n, out = -(-n // fanout), out + 1
    return out


def level_up(nodes: np.ndarray, fanout: int) -> np.ndarray:
    """The next level: whole runs are one reshape, the last run may be shorter."""
    full = len(nodes) // fanout * fanout
    made = hash_rows(nodes[:full].reshape(-1, fanout * 64).tobytes(), fanout * 64)
    if full < len(nodes):
        made.append(hashlib.sha256(nodes[full:].tobytes()).hexdigest())
    return as_matrix(made)


def levels_of(nodes: np.ndarray, levels: int, fanout: int) -> list[np.ndarray]:
    """The block's nodes, level by level; the last has one row."""
    out = [nodes]
    for _ in range(levels):
        out.append(level_up(out[-1], fanout))
    return out


def siblings(levels: list[np.ndarray], fanout: int) -> list[list[tuple[bytes, bytes]]]:
    """For every node of the lowest level and every level: the siblings to its left and those to its right."""
    n = len(levels[0])
    at, out = np.arange(n), [[] for _ in range(n)]
    for nodes in levels[:-1]:
        first = at // fanout * fanout
        last = np.minimum(first + fanout, len(nodes))
        flat = nodes.tobytes()
        for i, (a, p, b) in enumerate(zip((first * 64).tolist(), (at * 64).tolist(), (last * 64).tolist(), strict=True)):
            out[i].append((flat[a:p], flat[p + 64 : b]))
        at //= fanout
    return out


def fold(leaf: bytes, path: list[tuple[bytes, bytes]]) -> bytes:
    """The root that a leaf and its siblings give."""
    for left, right in path:
        leaf = hashlib.sha256(left + leaf + right).hexdigest().encode("ascii")
    return leaf


def _packed(path: list[tuple[bytes, bytes]]) -> bytes:
    """A path as bytes: for each level the numbers of left and right siblings, and those."""
    return b"".join(len(a + b).to_bytes(4, "big") + len(a).to_bytes(4, "big") + a + b for a, b in path)


def _unpacked(data: bytes) -> list[tuple[bytes, bytes]]:
    out, i = [], 0
    while i < len(data):
        size, a = int.from_bytes(data[i : i + 4], "big"), int.from_bytes(data[i + 4 : i + 8], "big")
        out.append((data[i + 8 : i + 8 + a], data[i + 8 + a : i + 8 + size]))
        i += 8 + size
    return out


NODES = "grp long, at long, n long, leaf string"
PATHS = "grp long, at long, path binary, subroot string"
PROVED = "doc_id long, leaf string, subroot string, proof_sha256 string, folded_root string"


def _block_levels(nodes: pa.Table, fanout: int, levels: int) -> list[np.ndarray]:
    return levels_of(as_matrix(nodes["leaf"].to_pylist()), min(levels, depth(nodes["n"][0].as_py(), fanout)), fanout)


def _block(fanout: int, levels: int) -> Column:
    return F.floor(F.col("at") / fanout**levels).cast("long").alias("block")


def round_up(nodes: DataFrame, fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """(grp, at, n, leaf) of the block tops of (grp, at, n, leaf); a group of one block gives its subroot."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("at")
        top, n = _block_levels(table, fanout, levels)[-1], table["n"][0].as_py()
        row = (table["grp"][0].as_py(), table["block"][0].as_py(), -(-n // fanout**levels), top[0].tobytes().decode("ascii"))
        return pa.table([pa.array([x]) for x in row], names=["grp", "at", "n", "leaf"])

    return nodes.select("grp", "at", "n", "leaf", _block(fanout, levels)).groupBy("grp", "block").applyInArrow(run, NODES)


def _meet(nodes: DataFrame, above: DataFrame, fanout: int, levels: int):  # noqa: ANN202
    """Nodes by block, with the block's own row of the round above."""
    return nodes.withColumn("block", _block(fanout, levels)).groupBy("grp", "block").cogroup(above.withColumnRenamed("at", "block").groupBy("grp", "block"))


def round_down(nodes: DataFrame, above: DataFrame, fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """The proof of every node, from the proofs of the blocks' tops."""

    def run(own: pa.Table, top: pa.Table) -> pa.Table:
        own = own.sort_by("at")
        rest, subroot = top["path"][0].as_py(), top["subroot"][0].as_py()
        paths = [_packed(p) + rest for p in siblings(_block_levels(own, fanout, levels), fanout)]
        return pa.table([own["grp"], own["at"], pa.array(paths, pa.binary()), pa.array([subroot] * len(paths), pa.string())], names=["grp", "at", "path", "subroot"])

    return _meet(nodes, above, fanout, levels).applyInArrow(run, PATHS)


def prove(leaves: DataFrame, above: DataFrame, fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """For every leaf the digest of its proof, and the root folded from the leaf that is shown and its siblings."""

    def run(own: pa.Table, top: pa.Table) -> pa.Table:
        own = own.sort_by("at")
        rest, subroot = _unpacked(top["path"][0].as_py()), top["subroot"][0].as_py()
        proofs, roots = [], []
        for path, leaf, shown in zip(siblings(_block_levels(own, fanout, levels), fanout), own["leaf"].to_pylist(), own["shown"].to_pylist(), strict=True):
            path = path + rest
            proofs.append(hashlib.sha256(b"".join(a + b for a, b in path)).hexdigest())
            roots.append(fold((shown or leaf).encode("ascii"), path).decode("ascii"))
        return pa.table([own["doc_id"], own["leaf"], *(pa.array(x, pa.string()) for x in ([subroot] * len(roots), proofs, roots))], names=["doc_id", "leaf", "subroot", "proof_sha256", "folded_root"])

    return _meet(leaves, above, fanout, levels).applyInArrow(run, PROVED)


def climb(nodes: DataFrame, most: int, fanout: int, levels: int) -> list[DataFrame]:
    """Rounds of nodes until every group has one; ``most`` is the size of the largest group."""
    rounds = [nodes]
    while most > 1 or len(rounds) == 1:
        rounds.append(materialize(round_up(rounds[-1], fanout, levels), "round"))
        most = -(-most // fanout**levels)
    return rounds


def build(leaves: DataFrame, fanout: int = FANOUT, levels: int = LEVELS) -> tuple[DataFrame, str | None]:
    """(doc_id, leaf, subroot, proof_sha256, folded_root of every row; the root) of rows doc_id, grp, leaf, shown.

    ``shown`` is the leaf a reader presents, null where it is the stored one; ``grp`` may be null."""
    ship_code(leaves.sparkSession)
    rows = materialize(leaves.select(F.col("doc_id").cast("long"), "grp", "leaf", "shown", F.monotonically_increasing_id().alias("__quire_row")), "leaves")
    rows = ranked(rows, [F.col("grp").asc_nulls_first(), F.col("doc_id").asc_nulls_first(), F.col("leaf"), F.col("__quire_row")], "rank")
    rows = materialize(rows.drop("__quire_row"), "ranked")
    groups = materialize(rows.groupBy("grp").agg(F.min("rank").alias("start"), F.count(F.lit(1)).alias("n")), "groups")  # in this order a group is named by its first rank
    named = groups.select(F.col("grp").alias("name"), "start", "n")
    rows = rows.join(named, F.col("grp").eqNullSafe(F.col("name"))).select("doc_id", F.col("start").alias("grp"), (F.col("rank") - F.col("start")).alias("at"), "n", "leaf", "shown")
    count, most = groups.agg(F.count(F.lit(1)), F.max("n")).first()
    rounds = climb(rows, most or 0, fanout, levels)
    subroots = ranked(rounds[-1].select("grp", F.col("leaf").alias("subroot")), [F.col("grp")], "at")
    subroots = materialize(subroots.select("grp", "at", "subroot"), "subroots")
    tops = climb(subroots.select(F.lit(0).cast("long").alias("grp"), "at", F.lit(count).cast("long").alias("n"), F.col("subroot").alias("leaf")), count, fanout, levels)
    root = tops[-1].first()
    above = tops[-1].select("grp", "at", F.lit(b"").alias("path"), F.lit("").alias("subroot"))
    for nodes in reversed(tops[:-1]):
        above = materialize(round_down(nodes, above, fanout, levels), "proofs")
    above = above.select("at", "path").join(subroots, "at").select("grp", F.lit(0).cast("long").alias("at"), "path", "subroot")
    for nodes in reversed(rounds[1:-1]):
        above = materialize(round_down(nodes, above, fanout, levels), "proofs")
    return prove(rows, above, fanout, levels), root and root["leaf"]


def manifest(docs: DataFrame, fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every row; rows chosen by the audit show a tampered leaf."""
    fields = [F.col(c) for c in FIELDS]
    audited = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.lit(False))
    tampered = [F.col(c) + F.when(audited, 1).otherwise(0) if c == "n_chars" else F.col(c) for c in FIELDS]
    leaf, shown = field_digest(*fields), field_digest(*tampered)
    proved, root = build(docs.select("doc_id", F.col("lang").alias("grp"), leaf.alias("leaf"), F.when(audited, shown).alias("shown")), fanout, levels)
    return proved.withColumn("root", F.lit(root).cast("string")).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select(*FIELDS)))


SQL = r"""
WITH RECURSIVE b AS (
    SELECT doc_id, lang, list_reduce([4294967295] || flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: list_transform(range(8), lambda i: (ascii(c) >> i::INT) & 1)))::BIGINT[],
               lambda a, x: xor(a >> 1, CASE WHEN xor(a, x) & 1 = 1 THEN 3988292384 ELSE 0 END)) AS crc,
           coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS f,
           n_chars, coalesce(strlen(text) || ':' || text, '-') AS g FROM documents),
leaves AS (SELECT doc_id, lang, sha256(f || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') || g) AS leaf,
                  CASE WHEN coalesce(xor(crc, 4294967295) % 7 = 0, false) THEN sha256(f || coalesce(strlen((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1), '-') || g) END AS shown FROM b),
l AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY lang) AS n, coalesce('1' || lang, '0') AS grp FROM leaves),
up AS (SELECT grp, 0 AS level, idx, n, leaf AS h FROM l
       UNION ALL SELECT grp, level + 1, idx // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY idx)) FROM up WHERE n > 1 GROUP BY grp, level, n, idx // 2),
sub AS (SELECT grp, h AS subroot, row_number() OVER (ORDER BY grp) - 1 AS idx, count(*) OVER () AS n FROM up WHERE n = 1),
top AS (SELECT 0 AS level, idx, n, subroot AS h FROM sub
        UNION ALL SELECT level + 1, idx // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY idx)) FROM top WHERE n > 1 GROUP BY level, n, idx // 2),
fold AS (SELECT grp, idx AS own, 0 AS level, idx, n, coalesce(shown, leaf) AS h, '' AS proof FROM l
         UNION ALL SELECT f.grp, f.own, f.level + 1, f.idx // 2, (f.n + 1) // 2, sha256(CASE WHEN f.idx % 2 = 1 THEN s.h || f.h ELSE f.h || coalesce(s.h, '') END), f.proof || coalesce(s.h, '')
         FROM fold f LEFT JOIN up s ON s.grp = f.grp AND s.level = f.level AND s.idx = xor(f.idx, 1) WHERE f.n > 1),
fold2 AS (SELECT fold.grp, own, 0 AS level, sub.idx, sub.n, h, proof FROM fold JOIN sub USING (grp) WHERE fold.n = 1
          UNION ALL SELECT f.grp, f.own, f.level + 1, f.idx // 2, (f.n + 1) // 2, sha256(CASE WHEN f.idx % 2 = 1 THEN s.h || f.h ELSE f.h || coalesce(s.h, '') END), f.proof || coalesce(s.h, '')
          FROM fold2 f LEFT JOIN top s ON s.level = f.level AND s.idx = xor(f.idx, 1) WHERE f.n > 1),
r AS (SELECT h AS root FROM top WHERE n = 1)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, f.h AS folded_root, f.h = root AS verified
FROM l JOIN sub USING (grp) JOIN fold2 f ON f.grp = l.grp AND f.own = l.idx AND f.n = 1 JOIN r ON true
"""
