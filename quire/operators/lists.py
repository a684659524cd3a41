"""Next-fit packing of ordered lists of any length, as tables: no list is held by one task.

A list is a running sum of its lines' lengths, and a bucket that starts at one place of it ends at the last line that
still fits: each place has a jump pointer to the next start. The sum is cut into blocks. Inside a block the pointers
are followed to the place where a chain leaves it; between blocks those pairs are doubled by joins, so a list of n blocks
takes log2 n steps. Blocks then number their own lines from the place where the chain enters.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from itertools import pairwise

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import js_len
from quire.runtime import materialize, release, ship_code

BLOCK_UNITS = 1 << 17  # UTF-16 units of text a block spans, and so the most lines it can hold


def _same(left: list[str], right: list[str]) -> Column:
    return reduce(lambda a, b: a & b, (F.col(x).eqNullSafe(F.col(y)) for x, y in zip(left, right, strict=True)))


def running_sum(rows: DataFrame, keys: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """Adds ``name``: the sum of ``value`` over a list's rows before this one.

    Rows are range partitioned by list and place, so a long list lies in many partitions; their sums are added up first, a row for each list and
    partition that holds some of it. ``order`` must tell a list's rows apart. Null keys are a list."""
    part = rows.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    part = materialize(part.withColumns({"__quire_part": F.spark_partition_id(), "__quire_value": value.cast("long")}), "running")
    before = lambda over, by: F.coalesce(F.sum("__quire_value").over(Window.partitionBy(*over).orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = part.groupBy(*keys, "__quire_part").agg(F.sum("__quire_value").alias("__quire_value"))
    other = [f"__quire_k{i}" for i in range(len(keys))]
    bases = sums.select(*(F.col(k).alias(o) for k, o in zip(keys, other, strict=True)), F.col("__quire_part").alias("__quire_p"), before(keys, ["__quire_part"]).alias("__quire_base"))
    inside = part.withColumn(name, before([*keys, "__quire_part"], order))
    joined = inside.join(bases, _same([*keys, "__quire_part"], [*other, "__quire_p"]))
    return joined.withColumn(name, F.col(name) + F.col("__quire_base")).drop(*other, "__quire_p", "__quire_base", "__quire_part", "__quire_value")


def _pointers(at: np.ndarray, ends: np.ndarray, room: int) -> np.ndarray:
    """Where the bucket that starts at each line ends: after the last line that fits, or after a line too long for any."""
    last = np.searchsorted(ends, at + room + 1, side="right") - 1
    return np.maximum(ends, np.where(last >= 0, ends[last], 0))


def _blocks(shard: pd.DataFrame) -> Iterator[dict]:
    """The columns of each block of a shard, in order."""
    rows = shard.sort_values(["list_id", "block", "at"])
    same = (rows["list_id"].to_numpy()[1:] == rows["list_id"].to_numpy()[:-1]) & (np.diff(rows["block"].to_numpy()) == 0)
    edges = [0, *(np.flatnonzero(~same) + 1).tolist(), len(rows)]
    columns = {c: rows[c].to_numpy() for c in rows.columns}
    for start, end in pairwise(edges):
        yield {c: v[start:end] for c, v in columns.items()}


def _leaving(block: dict, room: int, units: int) -> dict:
    """For each line of a block at which a chain may enter it: where that chain leaves, and after how many buckets."""
    own = block["own"]
    at, first = block["at"][own], block["block"][0] * units
    leave = _pointers(block["at"], block["ends"], room)[own]
    target = np.searchsorted(at, leave).tolist()
    count = np.ones(len(at), dtype=np.int64)
    for i in range(len(at) - 1, -1, -1):
        if target[i] < len(at):
            leave[i], count[i] = leave[target[i]], count[target[i]] + 1
    enters = at <= (first + room + 1 if first else 0)
    enters[:1] = True
    return {"list_id": block["list_id"][own][enters], "at": at[enters], "to": leave[enters], "n": count[enters]}


def _numbered(block: dict, room: int) -> dict:
    """Bucket numbers of a block's lines: those before the place where the chain enters belong to the bucket before."""
    at = block["at"]
    jump = np.searchsorted(at, _pointers(at, block["ends"], room)).tolist()
    starts = np.zeros(len(at), dtype=np.int64)
    i = int(np.searchsorted(at, block["enters"][0]))
    while i < len(at):
        starts[i] = 1
        i = jump[i]
    return {"list_id": block["list_id"], "at": at, "bucket": (block["bucket"][0] - 1 + np.cumsum(starts)).astype(np.int32)}


def _each_block(rows: DataFrame, shards: int, function: Callable[[dict], dict], schema: str) -> DataFrame:
    """``function`` of every block. Blocks of short lists share a group, so that a group holds about as much as a long list's block."""

    def run(shard: pd.DataFrame) -> pd.DataFrame:
        found = [function(block) for block in _blocks(shard)]
        return pd.DataFrame({c: np.concatenate([f[c] for f in found]) for c in found[0]})

    return rows.withColumn("shard", F.pmod(F.xxhash64("list_id", "block"), F.lit(shards))).groupBy("shard").applyInPandas(lambda g: run(g.drop(columns="shard")), schema)


def next_fit(rows: DataFrame, keys: list[str], order: list[str], line: Column, budget: int, name: str = "bucket", units: int = BLOCK_UNITS) -> DataFrame:
    """Adds ``name``: the bucket, from 1, of every line of each list (rows that share ``keys``, by ``order``).

    A bucket's lines, joined by line breaks, cost at most ``budget`` tokens of four units; a line that costs more has its own. A null line is empty.
    Lines are charged as prose: one with line breaks of its own opens no fence here. Lists may be empty tables, null keys are a list."""
    room = 4 * budget
    if units <= 2 * (room + 2):
        raise ValueError(f"blocks of {units} units are too small for buckets of {room}")
    ship_code(rows.sparkSession)
    length = js_len(F.coalesce(line, F.lit("")))
    placed = running_sum(rows.withColumn("__quire_n", length + 1), keys, order, F.col("__quire_n"), "__quire_at")
    ident = F.sha2(F.to_json(F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)])), 256)
    placed = materialize(placed.withColumn("__quire_list", ident), "placed")
    slim = placed.select(F.col("__quire_list").alias("list_id"), F.col("__quire_at").alias("at"), (F.col("__quire_at") + F.col("__quire_n")).alias("ends"), F.floor(F.col("__quire_at") / units).alias("block"))
    most, total = slim.agg(F.coalesce(F.max("block"), F.lit(0)), F.coalesce(F.sum(F.col("ends") - F.col("at")), F.lit(0))).first()
    shards = 1 + total // units
    entered = slim.filter("at = 0").select("list_id", F.col("at").alias("enters"), F.lit(1).cast("long").alias("bucket"))
    made = []
    if most:
        early = F.col("at") - F.col("block") * units <= room + 1
        where = F.when(early & (F.col("block") > 0), F.array(F.struct(F.col("block").alias("b"), F.lit(True).alias("own")), F.struct((F.col("block") - 1).alias("b"), F.lit(False).alias("own"))))
        where = F.explode(F.coalesce(where, F.array(F.struct(F.col("block").alias("b"), F.lit(True).alias("own")))))
        around = slim.withColumn("w", where).select("list_id", "at", "ends", F.col("w.b").alias("block"), F.col("w.own").alias("own"))
        jumps = materialize(_each_block(around, shards, lambda b: _leaving(b, room, units), "list_id string, at long, to long, n long"), "jumps")
        entered, made = materialize(entered, "entered"), [jumps]
        for _ in range(int(most).bit_length()):  # after k steps a list's first 2^k entries are known, and jumps lead 2^k blocks on
            on = jumps.select(F.col("list_id").alias("l"), F.col("at").alias("a"), "to", "n")
            further = entered.join(on, (F.col("list_id") == F.col("l")) & (F.col("enters") == F.col("a"))).select("list_id", F.col("to").alias("enters"), (F.col("bucket") + F.col("n")).alias("bucket"))
            made.append(entered)
            entered = materialize(entered.unionByName(further), "entered")
            two = jumps.alias("j").join(on.alias("o"), F.expr("j.list_id = o.l AND j.to = o.a")).select("j.list_id", "j.at", F.col("o.to").alias("to"), (F.col("j.n") + F.col("o.n")).alias("n"))
            jumps = materialize(two, "jumps")
            made.append(jumps)
    # the end of a list is a place too, in the block of its last lines; the first place in a block is where its chain enters
    gates = entered.groupBy(F.col("list_id").alias("l"), F.floor(F.col("enters") / units).alias("b")).agg(F.min("enters").alias("enters"), F.min("bucket").alias("bucket"))
    ready = slim.join(gates, (F.col("list_id") == F.col("l")) & (F.col("block") == F.col("b"))).drop("l", "b")
    numbers = materialize(_each_block(ready, shards, lambda b: _numbered(b, room), "list_id string, at long, bucket int"), "numbers")
    release(*made)
    numbers = numbers.select(F.col("list_id").alias("__quire_l"), F.col("at").alias("__quire_a"), F.col("bucket").alias("__quire_bucket"))
    out = placed.join(numbers, (F.col("__quire_list") == F.col("__quire_l")) & (F.col("__quire_at") == F.col("__quire_a")))
    return out.withColumn(name, F.col("__quire_bucket")).drop("__quire_l", "__quire_a", "__quire_bucket", "__quire_list", "__quire_at", "__quire_n")


def _bucketed(level: DataFrame, keys: list[str], budget: int) -> DataFrame:
    """The entries of a level (keys, place, name, link, ...) with their buckets, and how many buckets and lines their list has."""
    line = F.concat(F.lit("- ["), F.coalesce("name", F.lit("")), F.lit("]("), "link", F.lit(")"))
    packed = materialize(next_fit(level, keys, ["place"], line, budget), "level")
    sizes = packed.groupBy(*keys).agg(F.max("bucket").alias("__quire_buckets"), F.count(F.lit(1)).alias("__quire_lines"))
    other = [f"__quire_k{i}" for i in range(len(keys))]
    sizes = sizes.select(*(F.col(k).alias(o) for k, o in zip(keys, other, strict=True)), "__quire_buckets", "__quire_lines")
    return packed.join(sizes, _same(keys, other)).drop(*other)


def _groups(rows: DataFrame, keys: list[str]) -> DataFrame:
    """A group for each bucket: keys, place, name, link, links."""
    ends = F.struct("place", F.coalesce("name", F.lit("")).alias("name"))
    groups = rows.groupBy(*keys, F.col("bucket").alias("place")).agg(F.min(ends)["name"].alias("first"), F.max(ends)["name"].alias("last"), F.transform(F.array_sort(F.collect_list(F.struct("place", "link"))), lambda s: s["link"]).alias("links"))
    name = F.when(F.col("first") == F.col("last"), F.col("first")).otherwise(F.concat("first", F.lit(" – "), "last"))
    return groups.select(*keys, "place", name.alias("name"), F.format_string("group-%d/index.md", "place").alias("link"), "links")


def _level(entries: DataFrame, keys: list[str], order: str) -> DataFrame:
    return entries.select(*keys, F.col(order).alias("place"), "name", F.concat("slug", F.lit(".md")).alias("link"), F.lit(None).cast("array<string>").alias("links"))


def _slug() -> Column:
    return F.regexp_replace("link", "/index\\.md\\z", "").alias("slug")


def first_groups(entries: DataFrame, keys: list[str], order: str, budget: int) -> DataFrame:
    """keys, place, name, slug, links: the groups that each list's flat entries are packed into, whether or not their own table fits; none where one bucket holds the list."""
    rows = _bucketed(_level(entries, keys, order), keys, budget).filter("__quire_buckets > 1")
    return _groups(rows, keys).select(*keys, F.col("place").cast("long").alias("place"), "name", _slug(), "links")


def grouped_lists(entries: DataFrame, keys: list[str], order: str, budget: int) -> DataFrame:
    """keys, place, name, slug, links: the top groups that each list of flat entries (name, slug) needs; none where its table fits.

    All lists are packed level by level: groups of a level are the lines of the next, until a table fits or packing gains nothing. A group's links are those
    of its own lines, at most a bucket of them. Two neighbouring buckets hold more than a budget together, so levels grow with the logarithm of a list."""
    level = _level(entries, keys, order)
    settled = []
    while True:
        rows = _bucketed(level, keys, budget)
        done = (F.col("__quire_buckets") == 1) | (F.col("__quire_buckets") == F.col("__quire_lines"))
        settled.append(rows.filter(done & F.col("links").isNotNull()).select(*keys, F.col("place").cast("long").alias("place"), "name", _slug(), "links"))
        open_rows = rows.filter(~done)
        if open_rows.isEmpty():
            return reduce(DataFrame.unionByName, settled)
        level = _groups(open_rows, keys)
