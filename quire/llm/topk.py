"""Exact top-k search by inner product over a bit-sliced index.

Every attribute of a vector is quantised to floor(scale * x) and kept, for a block of rows, as bitmaps: one
for each bit, a bit for each row. A query adds the slices of all attributes, shifted by the bits of its own
component (complemented where that is negative), with carry-save adders on whole bitmaps; the sums come
out as slices too. The top rows are selected from the most significant slice downward; rows still tied at
the boundary are resolved by their smaller identifier, and scores of the selected rows are exact integers.

Rows are dealt into blocks of ``BLOCK``; the index of a block is built once and written to the shared folder, as are
the queries in blocks of ``QUERY_BLOCK``. The pairs of block numbers are dealt out by groups of row blocks and ``QUERY_GROUP`` query blocks: a task loads an index,
streams query blocks past it and goes on to the next, so no vector is shuffled more than once. It keeps each query's k best over all its row blocks, skips blocks
that can't reach the last of them, and yields k rows a query at the end. Row blocks form as many groups as tasks need work, of ``ROW_GROUP`` at most. Defined results: vectors that are null or hold null, NaN or infinite
components take no part; a vector meets only vectors of its own length; a query with fewer than k
candidates gets all; rows that repeat a vec_id are candidates of their own, a query skips only its own row;
a null vec_id is never a query and sorts last among ties; empty tables give empty results. Quantised
components and scores must fit 64-bit integers.
"""

from __future__ import annotations

import io
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.runtime import materialize, open_store, shared_path, ship_code, spread

K, SCALE, BLOCK, QUERY_BLOCK, QUERY_GROUP, ROW_GROUP = 20, 64.0, 4096, 1024, 64, 64


class BitSlicedIndex:
    """Bit slices of the columns of an integer matrix; a row is a bit."""

    FIELDS = ("rows", "low", "bits", "first", "slices", "alive")

    def __init__(self, rows: np.ndarray):
        self.rows, self.n = rows, len(rows)
        self.low = rows.min(axis=0)
        shifted = (rows - self.low).astype(np.uint64)
        self.bits = np.array([int(x).bit_length() for x in shifted.max(axis=0)])
        self.words = -(-self.n // 64)
        self.first = np.concatenate([[0], np.cumsum(self.bits)])
        slices = np.zeros((int(self.first[-1]), self.words * 8), dtype=np.uint8)
        for d, count in enumerate(self.bits):
            for i in range(count):
                packed = np.packbits((shifted[:, d] >> np.uint64(i) & np.uint64(1)).astype(np.uint8), bitorder="little")
                slices[self.first[d] + i, : len(packed)] = packed
        plain = slices.view(np.uint64)
        self.slices = np.concatenate([plain, ~plain])  # the second half: complements, for negative weights
        alive = np.zeros(self.words * 8, dtype=np.uint8)
        packed = np.packbits(np.ones(self.n, dtype=np.uint8), bitorder="little")
        alive[: len(packed)] = packed
        self.alive = alive.view(np.uint64)

    def arrays(self) -> dict[str, np.ndarray]:
        """What an index is made of, for writing; complements are made again on reading."""
        return {name: getattr(self, name) for name in self.FIELDS} | {"slices": self.slices[: len(self.slices) // 2]}

    @classmethod
    def of(cls, arrays: dict[str, np.ndarray]) -> BitSlicedIndex:
        out = cls.__new__(cls)
        for name in cls.FIELDS:
            setattr(out, name, arrays[name])
        out.n, out.words = len(out.rows), -(-len(out.rows) // 64)
        out.slices = np.concatenate([out.slices, ~out.slices])
        return out

    def add(self, query: np.ndarray) -> list[np.ndarray]:
        """Slices, from the lowest, of the inner products up to a constant that all rows share."""
        levels: dict[int, list[int]] = {}
        half = len(self.slices) // 2
        for d, weight in enumerate(query.tolist()):
            base, size = int(self.first[d]) + (half if weight < 0 else 0), abs(weight)
            for j in range(size.bit_length()):
                if size >> j & 1:
                    for i in range(int(self.bits[d])):
                        levels.setdefault(i + j, []).append(base + i)
        out, carried, level = [], np.empty((0, self.words), dtype=np.uint64), 0
        top = max(levels, default=-1)
        while level <= top or len(carried):
            held = np.concatenate([self.slices[levels.get(level, [])], carried])
            carries = []
            while len(held) >= 3:  # three bitmaps of a weight become one, and one of the next weight
                third = len(held) // 3
                a, b, c = held[:third], held[third : 2 * third], held[2 * third : 3 * third]
                either = a ^ b
                carries.append((a & b) | (either & c))
                held = np.concatenate([either ^ c, held[3 * third :]])
            if len(held) == 2:
                carries.append(held[:1] & held[1:])
                held = held[:1] ^ held[1:]
            out.append(held[0] if len(held) else np.zeros(self.words, dtype=np.uint64))
            carried = np.concatenate(carries) if carries else carried[:0]
            level += 1
        return out

    def bounds(self, queries: np.ndarray) -> list[float]:
        """No row's score with a query exceeds its bound, rounding included; floats, since a bound may not fit where all scores do."""
        wide = queries.astype(np.float64)
        most = np.maximum(wide * self.rows.max(axis=0), wide * self.low)
        return (most.sum(axis=1) + 1e-9 * np.abs(most).sum(axis=1) + 1).tolist()

    def top(self, query: np.ndarray, k: int, skip: int | None = None) -> np.ndarray:
        """Places of the k best rows (all, if fewer); ties go to the first place."""
        tied = self.alive.copy()
        if skip is not None:
            tied[skip // 64] &= ~(np.uint64(1) << np.uint64(skip % 64))
        sure = np.zeros_like(tied)
        for bitmap in reversed(self.add(query)):
            more = sure | (tied & bitmap)
            count = int(np.bitwise_count(more).sum())
            if count > k:
                tied &= bitmap
            else:
                sure, tied = more, tied & ~bitmap
                if count == k:
                    tied[:] = 0
                    break
        places = np.flatnonzero(np.unpackbits(sure.view(np.uint8), bitorder="little"))
        rest = np.flatnonzero(np.unpackbits(tied.view(np.uint8), bitorder="little"))
        return np.concatenate([places, rest[: k - len(places)]])


def quantised(vector: Column, scale: float) -> Column:
    """floor(scale * x) of every component as long; null unless all are finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.when(vector.isNotNull() & finite, F.transform(vector, lambda x: F.floor(F.lit(scale) * x.cast("double"))))


def _grouped(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[tuple[tuple, pa.Table]]:
    """Runs of rows with equal keys, which may span batches."""
    held: list[pa.RecordBatch] = []
    key = None
    for batch in batches:
        values = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.any([v[1:] != v[:-1] for v in values], axis=0)
        cuts = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if a == b:
                continue
            own = tuple(int(v[a]) for v in values)
            if held and own != key:
                yield key, pa.Table.from_batches(held).combine_chunks()
                held = []
            key = own
            held.append(batch.slice(a, b - a))
    if held:
        yield key, pa.Table.from_batches(held).combine_chunks()


def _write_blocks(root: str, indexed: bool):
    """Writes each block's index, or its queries, as a file of its own; a retried task leaves a file that no row names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = open_store(root)
        store.create_dir(folder, recursive=True)
        for (dim, block), table in _grouped(batches, "dim", "block"):
            values = table.column("v").combine_chunks().flatten().to_numpy().reshape(table.num_rows, dim)
            ids = table.column("vec_id")
            known = ids.is_valid().to_numpy()
            arrays = BitSlicedIndex(values).arrays() if indexed else {"rows": values}
            buffer, name = io.BytesIO(), f"{uuid.uuid4().hex}.npz"
            np.savez(buffer, ids=ids.fill_null(0).to_numpy(), known=known, numbers=table.column("row_no").to_numpy(), **arrays)
            with store.open_output_stream(f"{folder}/{name}", compression=None) as file:
                file.write(buffer.getvalue())
            yield pa.RecordBatch.from_arrays([pa.array([dim], pa.int64()), pa.array([block], pa.int64()), pa.array([name])], names=["dim", "block", "file"])

    return run


def _load(root: str, name: str) -> dict[str, np.ndarray]:
    store, folder = open_store(root)
    with store.open_input_stream(f"{folder}/{name}", compression=None) as file:
        return dict(np.load(io.BytesIO(file.read())))


class Best:
    """The k best candidates so far of each query of a block, over all row blocks that passed."""

    def __init__(self, asked: dict[str, np.ndarray], k: int):
        self.k, n = k, len(asked["rows"])
        self.numbers, self.query_ids = asked["numbers"], pa.array(asked["ids"], mask=~asked["known"])
        self.scores, self.ids = np.zeros((n, k), dtype=np.int64), np.zeros((n, k), dtype=np.int64)
        self.known, self.sizes = np.zeros((n, k), dtype=bool), np.zeros(n, dtype=np.int64)

    def hopeless(self, i: int, bound: float) -> bool:
        """Whether no row of a block whose scores don't exceed ``bound`` can enter; one that ties still may, by its id."""
        return self.k <= 0 or (self.sizes[i] == self.k and bound < int(self.scores[i, -1]))

    def add(self, i: int, scores: np.ndarray, ids: np.ndarray, known: np.ndarray) -> None:
        n = self.sizes[i]
        scores, ids, known = (np.concatenate([own[i, :n], new]) for own, new in ((self.scores, scores), (self.ids, ids), (self.known, known)))
        first = np.lexsort((ids, ~known, -scores))[: self.k]
        self.sizes[i] = len(first)
        for own, new in ((self.scores, scores), (self.ids, ids), (self.known, known)):
            own[i, : len(first)] = new[first]

    def rows(self) -> pa.RecordBatch:
        here = np.arange(self.k) < self.sizes[:, None]
        of = np.repeat(np.arange(len(self.sizes)), self.sizes)
        columns = [pa.array(self.numbers[of], pa.int64()), self.query_ids.take(pa.array(of)), pa.array(self.ids[here], mask=~self.known[here]), pa.array(self.scores[here], pa.int64())]
        return pa.RecordBatch.from_arrays(columns, names=["query_no", "query_id", "vec_id", "score"])


def _search(root: str, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, index, data = None, None, {}
        part, best = None, {}
        for batch in batches:
            for rows, queries, of in zip(*(batch.column(c).to_pylist() for c in ("rows", "queries", "part")), strict=True):
                if of != part:
                    yield from (b.rows() for b in best.values())
                    part, best = of, {}
                if rows != held:
                    held, data = rows, _load(root, rows)
                    index = BitSlicedIndex.of(data)
                    place = {int(n): i for i, n in enumerate(data["numbers"])}
                asked = _load(root, queries)
                if queries not in best:
                    best[queries] = Best(asked, k)
                own = best[queries]
                for i, (vector, number, bound) in enumerate(zip(asked["rows"], asked["numbers"].tolist(), index.bounds(asked["rows"]), strict=True)):
                    if not own.hopeless(i, bound):
                        found = index.top(vector, k, place.get(number))
                        own.add(i, index.rows[found] @ vector, data["ids"][found], data["known"][found])
        yield from (b.rows() for b in best.values())

    return run


def write_index(rows: DataFrame, root: str, size: int, indexed: bool) -> DataFrame:
    """(dim, block, file) of the blocks of about ``size`` rows, at least eight for tables that fill a thousand rows each."""
    sizes = rows.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).select(F.col("dim").alias("_dim"), F.greatest(F.ceil(F.col("n") / size), F.least(F.lit(8 if indexed else 1), F.ceil(F.col("n") / 1024))).alias("blocks"))
    placed = rows.join(sizes, F.col("dim") == F.col("_dim")).withColumn("block", F.pmod(F.xxhash64("row_no", "blocks"), F.col("blocks")))
    dealt = placed.select("dim", "block", "vec_id", "row_no", "v").repartition("dim", "block").sortWithinPartitions("dim", "block", F.col("vec_id").asc_nulls_last(), "row_no")
    return materialize(dealt.mapInArrow(_write_blocks(root, indexed), "dim long, block long, file string"), "blocks")


def search(vectors: DataFrame, is_query: Column, k: int = K, scale: float = SCALE) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows for each query among all rows but its own.

    ``vectors`` has vec_id and embedding; ``is_query`` may use its columns."""
    ship_code(vectors.sparkSession)
    root = shared_path(vectors.sparkSession, "slices")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.coalesce(is_query, F.lit(False)).alias("is_query"), quantised(F.col("embedding"), scale).alias("v"))
    rows = rows.filter("v is not null and size(v) > 0").withColumns({"row_no": F.monotonically_increasing_id(), "dim": F.size("v")})
    rows = materialize(rows, "vectors")
    index = write_index(rows, root, BLOCK, True).select("dim", F.col("block").alias("r"), F.col("file").alias("rows"))
    asked = write_index(rows.filter("is_query"), root, QUERY_BLOCK, False).select("dim", F.col("block").alias("q"), F.col("file").alias("queries"))
    context = vectors.sparkSession.sparkContext
    tasks = max(4 * context.defaultParallelism, int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    asked = asked.withColumn("query_group", F.floor(F.col("q") / QUERY_GROUP))
    counts = index.groupBy("dim").agg((F.max("r") + 1).alias("row_blocks")).join(asked.groupBy("dim").agg((F.max("query_group") + 1).alias("query_groups")), "dim")
    wanted = F.greatest(F.ceil(tasks / F.col("query_groups")), F.ceil(F.col("row_blocks") / ROW_GROUP))
    index = index.join(counts.select("dim", "row_blocks", F.least("row_blocks", wanted).alias("groups")), "dim")
    index = index.select("dim", "r", "rows", F.floor(F.col("r") * F.col("groups") / F.col("row_blocks")).alias("row_group"))
    pairs = index.join(asked, "dim").withColumn("part", F.concat_ws(":", "dim", "row_group", "query_group"))  # numbers of blocks, not rows
    pairs = pairs.repartition(tasks, "part").sortWithinPartitions("part", "r", "q")
    found = pairs.mapInArrow(_search(root, k), "query_no long, query_id long, vec_id long, score long")
    order = Window.partitionBy("query_no").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last())
    best = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return best.select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(spread(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")), F.col("vec_id") % 20 == 0)


SQL = """
WITH e AS (SELECT vec_id, row_number() OVER () AS row_no, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
           FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, q.row_no, c.vec_id,
             CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
      FROM e q JOIN e c ON q.vec_id % 20 = 0 AND c.row_no <> q.row_no AND len(c.v) = len(q.v)),
r AS (SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY row_no ORDER BY score DESC, vec_id NULLS LAST) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20
"""
