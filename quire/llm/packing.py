"""Packing token sequences by cutting-stock column generation.

A document's ids (byte-level BPE, then the end id 1) are cut at multiples of the capacity: full chunks are
sequences of their own, the rest is an item. Items fall into length classes of ``UNIT`` tokens (rounded
up), so the histogram that reaches the driver has capacity / UNIT numbers however many documents there
are. A linear program over patterns of classes is solved by column generation: a revised simplex holds
the restricted master, an unbounded knapsack by dynamic programming prices new patterns. Patterns rounded
down cover almost everything; what rounding leaves is filled first-fit decreasing, again on counts. Items
are ranked within their class and take the slots of the patterns in order.

Defined results: null and empty texts are the end id alone; added tokens of the tokenizer's file get their ids
inside texts, as the tokenizers library gives them; rows that repeat a doc_id are documents of their own; empty tables
give empty results; extra columns are ignored. Ids equal those of the tokenizers library, which also encodes the texts
that the faster encoder can't (runs of ``LONG_BLANK`` white-space characters or more); they are computed once, from whole texts.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import tiktoken
import tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.llm._ranks import hash32, running
from quire.runtime import materialize, ship_code, spread

CAPACITY, UNIT, END_ID, SEED = 2048, 16, 1, 5
LONG_BLANK = 100_000
BLANKS = re.compile(r"\s+")


@cache
def encoder(path: str, pattern: str) -> tiktoken.Encoding:
    """The byte-level BPE of a tokenizers JSON file; its ids are in order of merging, so they serve as ranks."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shown = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
    with open(path, encoding="utf-8") as file:
        model = json.load(file)
    special = {token["content"]: token["id"] for token in model["added_tokens"]}
    ranks = {bytes(shown[c] for c in token): i for token, i in model["model"]["vocab"].items() if token not in special}
    return tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)


@cache
def plain_encoder(path: str) -> tokenizers.Tokenizer:
    return tokenizers.Tokenizer.from_file(path)


def ids_of(text: str, path: str, pattern: str) -> list[int]:
    """The ids of the tokenizers library, without special tokens. The faster encoder's stack overflows on very long blank runs."""
    if len(text) >= LONG_BLANK and max(map(len, BLANKS.findall(text)), default=0) >= LONG_BLANK:
        return plain_encoder(path).encode(text, add_special_tokens=False).ids
    return encoder(path, pattern).encode(text, allowed_special="all")


def pieces(docs: DataFrame, tokenizer: str, pattern: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens: documents cut at multiples of the capacity."""
    schema = pa.schema([(c, pa.int64()) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.array([*ids_of(text.as_py() or "", tokenizer, pattern), END_ID], dtype="<u4")
                for at in range(0, len(ids), capacity):
                    cut = ids[at : at + capacity]
                    out.append((doc_id, at, len(cut), zlib.crc32(cut.tobytes()), len(ids)))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else [[]] * 5)], schema=schema)

    ship_code(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def price(values: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable pattern: unbounded knapsack by dynamic programming."""
    best, taken = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for room in range(1, capacity + 1):
        n = int(np.searchsorted(sizes, room, side="right"))
        best[room] = best[room - 1]
        if n:
            got = best[room - sizes[:n]] + values[:n]
            top = int(got.argmax())
            if got[top] > best[room] + 1e-12:
                best[room], taken[room] = got[top], top
    pattern, room = np.zeros(len(sizes), dtype=np.int64), capacity
    while room > 0:
        if taken[room] < 0:
            room -= 1
        else:
            pattern[taken[room]] += 1
            room -= sizes[taken[room]]
    return float(best[capacity]), pattern


def column_generation(sizes: np.ndarray, demand: np.ndarray, capacity: int, limit: int = 5000) -> tuple[np.ndarray, np.ndarray]:
    """(patterns, uses): a basic solution of the linear program that covers the demand with fewest sequences.

    Drift of the updated inverse costs optimality only: what rounded patterns don't cover is filled on counts."""
    basis = np.diag(capacity // sizes).astype(float)
    inverse, uses = np.diag(1 / (capacity // sizes)), demand / (capacity // sizes)
    for _ in range(limit):
        duals = inverse.sum(axis=0)  # every pattern costs one sequence
        value, pattern = price(duals, sizes, capacity)
        if value <= 1 + 1e-9:
            break
        column = inverse @ pattern
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where(column > 1e-9, uses / column, np.inf)
        out = int(ratio.argmin())
        pivot = inverse[out] / column[out]
        uses = uses - column * ratio[out]
        inverse = inverse - np.outer(column, pivot)
        inverse[out], uses[out], basis[:, out] = pivot, ratio[out], pattern
    return np.rint(basis.T).astype(np.int64), np.maximum(uses, 0)


def plan_patterns(counts: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """(pattern, number of sequences) that hold every item of a histogram by class; patterns are {class: items}."""
    classes = sorted(k for k, n in counts.items() if n)
    if not classes:
        return []
    sizes, left = np.array(classes), np.array([counts[k] for k in classes])
    out: list[tuple[dict[int, int], int]] = []

    def use(pattern: np.ndarray, times: int) -> None:
        nonlocal left
        out.append(({int(sizes[i]): int(pattern[i]) for i in np.flatnonzero(pattern)}, times))
        left = np.maximum(left - pattern * times, 0)

    patterns, uses = column_generation(sizes, left.astype(float), capacity)
    for pattern, times in zip(patterns, np.floor(uses + 1e-9).astype(np.int64), strict=True):
        if times:
            use(pattern, int(times))
    while left.any():  # what rounding left: largest first
        pattern, room = np.zeros(len(sizes), dtype=np.int64), capacity
        for i in range(len(sizes) - 1, -1, -1):
            pattern[i] = min(left[i], room // sizes[i])
            room -= pattern[i] * sizes[i]
        with np.errstate(divide="ignore"):
            use(pattern, max(1, int((left[pattern > 0] // pattern[pattern > 0]).min())))
    return out


def slots(plan: list[tuple[dict[int, int], int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Sorted (class << 40 | first rank), first sequence and items a sequence of every run of slots, and the number of sequences."""
    filled: dict[int, int] = {}
    rows, sequence = [], 0
    for pattern, times in plan:
        for size, items in pattern.items():
            rows.append((size << 40 | filled.get(size, 0), sequence, items))
            filled[size] = filled.get(size, 0) + items * times
        sequence += times
    rows.sort()
    return (*(np.array([r[i] for r in rows], dtype=np.int64) for i in range(3)), sequence)


def pack(docs: DataFrame, tokenizer: str, pattern: str, capacity: int = CAPACITY, unit: int = UNIT) -> DataFrame:
    """A row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    size_class = F.when(F.col("length") == capacity, 0).otherwise(F.ceil(F.col("length") / unit)).cast("long")
    cut = pieces(docs, tokenizer, pattern, capacity).withColumns({"class": size_class, "h": hash32(SEED, "doc_id", "start")})
    cut = materialize(cut, "pieces")
    counts = {r["class"]: r["n"] for r in cut.groupBy("class").agg(F.count(F.lit(1)).alias("n")).collect()}  # capacity / unit rows at most
    counts.pop(0, None)
    first, sequence, items, used = slots(plan_patterns(counts, capacity // unit))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, rank = batch.column("class").to_numpy(), batch.column("rank").to_numpy()
            key = size << 40 | rank
            at = np.maximum(np.searchsorted(first, key, side="right") - 1, 0)
            found = sequence[at] + (key - first[at]) // items[at] if len(first) else np.zeros(len(key), dtype=np.int64)
            yield batch.append_column("sequence_id", pa.array(np.where(size == 0, used + rank, found)))

    rows = running(cut, "class", "h", ["doc_id", "start", "ids_crc32", "length"], F.lit(1), "rank").withColumn("rank", F.col("rank").cast("long"))
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "class", "rank"]
    placed = rows.select(*columns).mapInArrow(assign, ", ".join(f"{c} long" for c in [*columns, "sequence_id"]))
    before = Window.partitionBy("sequence_id").orderBy(F.desc("class"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", F.coalesce(F.sum("length").over(before), F.lit(0)).alias("offset"))


def pack_default(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_default(spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")))


SQL = None
