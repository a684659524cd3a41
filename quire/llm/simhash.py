"""SimHash near-duplicate groups with pigeonring candidate filtering.

A fingerprint has 64 bits over the XXH64 hashes (seed 42) of all word shingles of the whole text. Two
fingerprints link at ``RADIUS`` or fewer differing bits. The bits lie on a ring of ``SEGMENTS`` segments:
if two fingerprints link, then from some segment on every chain of n consecutive segments holds at most
n * RADIUS / SEGMENTS differences. With 5 segments and radius 2 these budgets are 0, 0, 1, 1, 2: the
first two segments agree, which makes the bucket key, and the longer chains prune before the Hamming check.

Only distinct fingerprints meet in buckets, and a bucket yields a spanning forest, never its pairs.
Buckets over ``SPLIT`` rows are dealt out again by thirds of their remaining bits (two linked fingerprints
agree in at least one third), and inside a task a bucket over ``PAIRWISE`` rows looks up the few hundred
allowed flips of each row instead of comparing rows, so work stays linear in rows. Components come from
alternating large-star and small-star steps over written tables.

Defined results: null or blank text has fingerprint zero, linked like any other; shorter texts than a
shingle hash as one; a null doc_id takes part but names a component only if all ids in it are null; rows
that repeat a doc_id are rows of their own; empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm._ranks import nth_of
from quire.runtime import materialize, release, ship_code, spread

SHINGLE, SEED, RADIUS, SEGMENTS = 3, 42, 2, 5
SPLIT, PAIRWISE, BLOCK = 1000, 1500, 65536
#: First bit and width of each segment, from the lowest bit on.
BOUNDS = [(0, 13), (13, 13), (26, 13), (39, 13), (52, 12)]


def fingerprint(text: str | None, width: int = SHINGLE) -> int:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII letters and white space only
    if not words:
        return 0
    shingles = (b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1)))
    counts, n = np.zeros(64, dtype=np.int64), 0
    while True:  # blocks: a very long text never holds all its hashes at once
        block = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in islice(shingles, BLOCK)), dtype="<u8")
        if not len(block):
            break
        counts += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(block)
    return sum(1 << int(b) for b in np.flatnonzero(2 * counts > n))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long) and text_hash of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = np.fromiter((fingerprint(x.as_py()) for x in batch.column(1)), dtype=np.uint64, count=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got.view(np.int64)), batch.column(2)], names=["doc_id", "fp", "text_hash"])

    ship_code(docs.sparkSession)
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_hash")).mapInArrow(run, "doc_id long, fp long, text_hash long")


def _mask(first: int, width: int) -> int:
    return ((1 << width) - 1) << first


def _chain_masks(start: int) -> list[tuple[np.uint64, int]]:
    """(bits, budget) of every chain from a segment on."""
    out, mask = [], 0
    for n in range(1, SEGMENTS + 1):
        mask |= _mask(*BOUNDS[(start + n - 1) % SEGMENTS])
        out.append((np.uint64(mask), n * RADIUS // SEGMENTS))
    return out


CHAINS = [_chain_masks(i) for i in range(SEGMENTS)]


def _flips(start: int) -> np.ndarray:
    """All differences that pass every chain from a segment on."""
    free = [b for b in range(64) if not int(CHAINS[start][1][0]) >> b & 1]
    masks = [1 << b for b in free] + [1 << a | 1 << b for i, a in enumerate(free) for b in free[:i]]
    x = np.array(masks, dtype=np.uint64)
    return x[_passes(x, np.full(len(x), start))]


def _passes(x: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Which differences stay within the budgets of all chains from their start."""
    ok = np.ones(len(x), dtype=bool)
    for n in range(SEGMENTS):
        bits = np.array([CHAINS[s][n][0] for s in range(SEGMENTS)], dtype=np.uint64)[start]
        ok &= np.bitwise_count(x & bits) <= CHAINS[0][n][1]
    return ok


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component) for all nodes but those smallest ones, from edges."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[u], root[v])
        new = root.copy()
        np.minimum.at(new, root[u], low)
        np.minimum.at(new, root[v], low)
        new = new[new]
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, root):
            break
        root = new
    moved = root != np.arange(len(nodes))
    return nodes[moved], nodes[root[moved]]


def _bucket_edges(keys: np.ndarray, starts: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links within runs of equal keys."""
    left, right = [], []
    edge = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    sizes = np.diff(np.append(edge, len(keys)))
    small = np.repeat(sizes <= PAIRWISE, sizes)
    most = int(sizes[sizes <= PAIRWISE].max(initial=1))
    live = np.flatnonzero(small)
    for step in range(1, most):
        live = live[live + step < len(keys)]
        live = live[keys[live] == keys[live + step]]
        if not len(live):
            break
        x = fps[live] ^ fps[live + step]
        hit = live[_passes(x, starts[live])]
        left.append(fps[hit])
        right.append(fps[hit + step])
    for at in np.flatnonzero(sizes > PAIRWISE):
        own = np.sort(fps[edge[at] : edge[at] + sizes[at]])
        for flip in _flips(int(starts[edge[at]])):
            to = own ^ flip
            pos = np.minimum(np.searchsorted(own, to), len(own) - 1)
            hit = (own[pos] == to) & (own < to)
            left.append(own[hit])
            right.append(to[hit])
    empty = np.empty(0, dtype=np.uint64)
    return np.concatenate([empty, *left]), np.concatenate([empty, *right])


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, start, fp) sorted by key; a bucket may span batches."""
    held: list[tuple[np.ndarray, ...]] = []

    def out(keys: np.ndarray, starts: np.ndarray, fps: np.ndarray) -> Iterator[pa.RecordBatch]:
        a, b = _bucket_edges(keys, starts, fps)
        if len(a):
            a, b = forest(a.view(np.int64), b.view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        key, start, fp = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        held.append((key, start.astype(np.int64), fp.view(np.uint64)))
        if key[0] != key[-1]:
            keys, starts, fps = (np.concatenate(x) for x in zip(*held, strict=True))
            cut = int(np.searchsorted(keys == keys[-1], True))
            yield from out(keys[:cut], starts[:cut], fps[:cut])
            held = [(keys[cut:], starts[cut:], fps[cut:])]
    if held:
        yield from out(*(np.concatenate(x) for x in zip(*held, strict=True)))


def _segment(i: int) -> F.Column:
    first, width = BOUNDS[i % SEGMENTS]
    return F.shiftrightunsigned("fp", first).bitwiseAND(F.lit((1 << width) - 1))


def links(distinct: DataFrame) -> DataFrame:
    """(a, b): edges between distinct fingerprints with the same components as all links.

    Keys are longs: 3 bits of start, 2 of part (0: the whole bucket), 26 of two segments, 13 of a third."""
    ship_code(distinct.sparkSession)
    keys = [F.struct(F.lit(i).alias("start"), _key(F.lit(i), 0, _segment(i) * 8192 + _segment(i + 1), F.lit(0)).alias("key")) for i in range(SEGMENTS)]
    rows = distinct.select("fp", F.explode(F.array(*keys)).alias("k")).select("fp", "k.start", "k.key")
    heavy = rows.groupBy("key").count().filter(F.col("count") > SPLIT).select("key", F.lit(True).alias("heavy"))
    rows = rows.join(heavy, "key", "left")
    parts = [F.col("key") + _key(F.lit(0), j + 1, F.lit(0), _ahead(j + 2)) for j in range(3)]
    rows = rows.select(F.explode(F.when(F.col("heavy"), F.array(*parts)).otherwise(F.array("key"))).alias("key"), "start", "fp")
    dealt = rows.repartition("key").sortWithinPartitions("key", "fp")
    return dealt.mapInArrow(_links, "a long, b long")


def _key(start: F.Column, part: int, pair: F.Column, third: F.Column) -> F.Column:
    return F.shiftleft(start.cast("long"), 58) + F.lit(part << 56) + F.shiftleft(pair.cast("long"), 13) + third.cast("long")


def _ahead(n: int) -> F.Column:
    """The segment n places after a row's start."""
    out = _segment(n)
    for s in range(1, SEGMENTS):
        out = F.when(F.col("start") == s, _segment(s + n)).otherwise(out)
    return out


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of each component, for all nodes that have edges."""
    both = lambda e: e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = materialize(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = None
    while True:
        old, sides = edges, both(edges)
        low = sides.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("low"))
        low = materialize(low, "large-star")
        large = sides.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).filter("a <> b").distinct()
        large = materialize(large, "large")
        least = materialize(large.groupBy("a").agg(F.min("b").alias("low")), "small-star")
        small = large.join(least, "a").filter("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
        edges = materialize(small.unionByName(least.select("a", F.col("low").alias("b"))).filter("a <> b").distinct(), "edges")
        release(old, low, large, least)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if now == seen:
            return edges.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "node")
        seen = now


def groups(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, fp, root, component_id for every row."""
    rows = materialize(fingerprints(docs), "fingerprints")
    nodes = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    roots = components(links(nodes.select("fp")))
    named = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    named = materialize(named, "roots")
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    label = materialize(named.select("fp", "root").join(least, "root").select("fp", "root", "component_id"), "labels")
    return rows.join(label, "fp")


def near_groups(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 lowercase hex digits), component_id for every row."""
    return groups(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_per_group(docs: DataFrame) -> DataFrame:
    """One row of ``docs`` for each component: smallest doc_id, then any text; of fully repeated rows one.

    Texts move once, to the chosen (doc_id, hash); only if such pairs repeat are they ranked as well."""
    rows = materialize(groups(docs), "groups")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")).alias("head")
    heads = rows.groupBy("root").agg(first).select(F.col("head.doc_id").alias("__quire_head"), F.col("head.text_hash").alias("__quire_hash"))
    heads = materialize(heads.distinct(), "heads")
    out = docs.withColumn("__quire_own", F.xxhash64("text")).join(heads, F.col("doc_id").eqNullSafe(F.col("__quire_head")) & (F.col("__quire_own") == F.col("__quire_hash")))
    if not rows.groupBy("doc_id", "text_hash").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty():
        out = nth_of(out, ["__quire_head", "__quire_hash"], "__quire_n").filter("__quire_n = 1")
    return out.select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")))


SQL = None
