"""Removal of repeated byte strings by a logarithmic family of sparse suffix arrays.

A byte goes if a string of ``WINDOW`` bytes that covers it also starts in a document with a smaller id. Texts are UTF-8 bytes,
strings never cross documents, and all strings are judged on the input.

*Passages.* Every window has an anchor, the leftmost smallest hash of the ``ANCHOR``-byte strings in it: it depends on the window
alone, so equal windows have equal anchors. Neighbouring windows with the same anchor form a passage (at most 2 * WINDOW - ANCHOR
bytes), and whatever can be equal meets where its anchor's shard is. Anchors that only one block of documents holds, once,
are left out first: tasks exchange packed hashes, which cost a third of a byte for a byte of text.

*Family.* Passages come in batches by ascending document id. In every shard a batch is sorted by the suffixes that start at its anchors, a
suffix array with a place for each distinct passage, and merge-scanned against each level of the family: passages that a level
holds take over what is known of them; where anchors meet and passages differ, the windows of both are sorted and
the first document of every window is read off. The batch then becomes a level, and levels of equal size are
merged, as in a binary counter, so an entry is rewritten a logarithmic number of times. Levels are tables in the shared folder.

*Texts* are written once in blocks (files) to the shared folder; tasks that work on a block read its file. Rows that move
are packed: one a block and shard. A hot passage counts once a block, wherever and however often it occurs.

Defined results: a null text counts as empty; a null doc_id is larger than any other, and not larger than another null; rows that share a
doc_id have no smaller one among them, so they keep what they share; texts under ``WINDOW`` bytes lose nothing; an empty table
gives an empty result; extra columns are ignored. No cap, whatever the length of a text or the number of copies.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.runtime import discard, materialize, open_store, shared_path, ship_code, spread

WINDOW, ANCHOR, BATCHES = 50, 20, 4
SLICE, BLOCK = 1 << 19, 1 << 25  # bytes hashed at a time; bytes of texts whose passages are packed together
SORTED = 1 << 20  # bytes of passages whose windows are sorted at a time; more only for one anchor
SHARD_BYTES = 1 << 26  # of text, at least as many shards as shuffle partitions
LAST = np.iinfo(np.int64).max
U = np.uint64
#: Odd multipliers of the hash of 1, 2, 4, ... bytes.
MULTIPLIERS = [U(x) for x in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F)]
LETTERS = np.random.default_rng(50).integers(1, 1 << 63, 256, dtype=U)


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads all bits of hashes over all bits."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def window_hashes(data: np.ndarray, width: int) -> np.ndarray:
    """Polynomial hashes of all strings of ``width`` bytes, by doubling."""
    n = len(data) - width + 1
    power, have, done, out = LETTERS[data], 1, 0, None
    for multiplier in MULTIPLIERS:
        if width & have:
            part = power[done : done + n]
            out = part.copy() if out is None else out * multiplier + part
            done += have
        if have * 2 > width:
            break
        power = power[:-have] * multiplier + power[have:]
        have *= 2
    return mixed(out)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    have = 1
    while have * 2 <= width:
        values = np.minimum(values[:-have], values[have:])
        have *= 2
    return np.minimum(values[: len(values) - (width - have)], values[width - have :])


def anchored(data: np.ndarray, lengths: np.ndarray, window: int = WINDOW, anchor: int = ANCHOR) -> tuple[np.ndarray, ...]:
    """Passages of joined documents: (document, start, windows, anchor's place, its hash); starts and places are in ``data``."""
    none = np.empty(0, dtype=np.int64)
    if len(data) < window:
        return none, none, none, none, none.view(U)
    hashes = window_hashes(data, anchor)
    order = (hashes & U(0xFFFFFFFF00000000)) | np.arange(len(hashes), dtype=U)
    at = (sliding_min(order, window - anchor + 1) & U(0xFFFFFFFF)).astype(np.int64)
    counts = np.maximum(lengths - window + 1, 0)
    if not counts.any():
        return none, none, none, none, none.view(U)
    starts = np.cumsum(lengths) - lengths
    document = np.repeat(np.arange(len(lengths)), counts)
    place = np.arange(len(document)) - np.repeat(np.cumsum(counts) - counts, counts) + starts[document]
    own = at[place]
    first = np.flatnonzero(np.append(True, (own[1:] != own[:-1]) | (document[1:] != document[:-1])))
    sizes = np.diff(np.append(first, len(own)))
    return document[first], place[first], sizes, own[first], mixed(hashes[own[first]])


class Slice:
    """Some documents as one byte array, and their passages."""

    def __init__(self, ids: list[int | None], texts: list[bytes], window: int, anchor: int):
        self.ids, self.texts = ids, texts
        self.lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        self.order = np.fromiter((LAST if i is None else i for i in ids), dtype=np.int64, count=len(ids))
        self.data = np.frombuffer(b"".join(texts), dtype=np.uint8)
        self.document, self.start, self.windows, self.at, self.hash = anchored(self.data, self.lengths, window, anchor)


def slices(rows: Iterator[tuple[int | None, bytes]], window: int, anchor: int) -> Iterator[Slice]:
    ids, texts, size = [], [], 0
    for doc_id, text in rows:
        ids.append(doc_id)
        texts.append(text)
        size += len(text)
        if size >= SLICE:
            yield Slice(ids, texts, window, anchor)
            ids, texts, size = [], [], 0
    if ids:
        yield Slice(ids, texts, window, anchor)


def blocks(path: str, window: int, anchor: int) -> Iterator[tuple[int, list[Slice]]]:
    """Numbered blocks of a file of texts; a file gives the same blocks whenever it is read."""
    store, name = open_store(path)

    def rows() -> Iterator[tuple[int | None, bytes]]:
        with store.open_input_file(name) as f:
            for batch in pq.ParquetFile(f).iter_batches(batch_size=256, columns=["doc_id", "text"]):
                ids, texts = batch.column("doc_id"), batch.column("text").cast(pa.binary())
                for i in range(batch.num_rows):
                    yield ids[i].as_py(), texts[i].as_py()

    held, size, number = [], 0, 0
    for one in slices(rows(), window, anchor):
        held.append(one)
        size += len(one.data)
        if size >= BLOCK:
            yield number, held
            held, size, number = [], 0, number + 1
    if held:
        yield number, held


def packed(**columns: pa.Array) -> bytes:
    batch = pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpacked(data: bytes) -> pa.RecordBatch:
    return next(iter(pa.ipc.open_stream(pa.py_buffer(data))))


def runs_of(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first places, sizes) of runs of equal values."""
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.empty(0, dtype=np.int64)
    return first, np.diff(np.append(first, len(keys)))


# ---- which anchors more than one document may hold

HASHES = "shard int, file string, hashes binary"


def anchor_hashes(texts: DataFrame, shards: int, window: int, anchor: int) -> DataFrame:
    """For every batch of a file and every shard: the anchors' hashes as 6 bytes, those that occur twice in it first, and how many they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in dict.fromkeys(batch.column(0).to_pylist()):
                own = batch.filter(pa.compute.equal(batch.column(0), file))
                texts = (x.as_py() for x in own.column(1).cast(pa.binary()))
                found = [np.empty(0, dtype=U), *(s.hash for s in slices(((None, t) for t in texts), window, anchor))]
                hashes, counts = np.unique(np.concatenate(found), return_counts=True)
                shard = (hashes % U(shards)).astype(np.int32)
                order = np.lexsort((counts == 1, shard))
                hashes, shard, twice = hashes[order], shard[order], counts[order] > 1
                out: list[list] = [[], [], []]
                for i, n in zip(*runs_of(shard), strict=True):
                    six = (hashes[i : i + n] >> U(16)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
                    out[0].append(int(shard[i]))
                    out[1].append(file)
                    out[2].append(int(twice[i : i + n].sum()).to_bytes(8, "little") + six.tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), pa.array(out[1], pa.string()), pa.array(out[2], pa.binary())], names=["shard", "file", "hashes"])

    return texts.select("file", "text").mapInArrow(run, HASHES)


def _six(data: bytes) -> np.ndarray:
    wide = np.zeros((len(data) // 6, 8), dtype=np.uint8)
    wide[:, :6] = np.frombuffer(data, dtype=np.uint8).reshape(-1, 6)
    return wide.view("<u8").ravel()


def shared_anchors(hashes: DataFrame) -> DataFrame:
    """For every file and shard: its anchors' hashes that occur twice anywhere."""

    def run(table: pa.Table) -> pa.Table:
        blobs = table["hashes"].to_pylist()
        own = [_six(b[8:]) for b in blobs]
        all_hashes, counts = np.unique(np.concatenate(own), return_counts=True)
        twice = [h[: int.from_bytes(b[:8], "little")] for h, b in zip(own, blobs, strict=True)]
        keep = np.union1d(all_hashes[counts > 1], np.concatenate(twice))
        kept = [h[np.isin(h, keep, assume_unique=True)] for h in own]
        rows = [(f, h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()) for f, h in zip(table["file"].to_pylist(), kept, strict=True) if len(h)]
        return pa.table([pa.array([table["shard"][0].as_py()] * len(rows), pa.int32()), pa.array([f for f, _ in rows], pa.string()), pa.array([h for _, h in rows], pa.binary())], names=["shard", "file", "hashes"])

    return hashes.groupBy("shard").applyInArrow(run, HASHES)


class Shared:
    """Membership of anchors' hashes in what ``shared_anchors`` gave for a file."""

    def __init__(self, table: pa.Table, shards: int):
        parts = {}
        for shard, data in zip(table["shard"].to_pylist(), table["hashes"].to_pylist(), strict=True):
            if data:
                parts.setdefault(shard, []).append(_six(data))
        self.of = {k: np.unique(np.concatenate(v)) for k, v in parts.items()}
        self.shards = shards

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        out = np.zeros(len(hashes), dtype=bool)
        shard = (hashes % U(self.shards)).astype(np.int64)
        order = np.argsort(shard, kind="stable")
        for i, n in zip(*runs_of(shard[order]), strict=True):
            own = self.of.get(int(shard[order[i]]))
            if own is not None:
                want = hashes[order[i : i + n]] >> U(16)
                at = np.minimum(np.searchsorted(own, want), len(own) - 1)
                out[order[i : i + n]] = own[at] == want
        return out


# ---- passages of a block

PASSAGES = "batch int, shard int, file string, block int, passages binary"


def gathered(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> pa.BinaryArray:
    """Strings of ``data`` that may overlap."""
    ends = np.cumsum(length)
    at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - length), length)
    offsets = np.concatenate(([0], ends)).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(length), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data[at]))])


def bounds_of(texts: pa.BinaryArray) -> np.ndarray:
    """Where texts begin in their buffer, and where the last ends."""
    if not len(texts):
        return np.zeros(1, dtype=np.int64)
    return np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)


def joined(arrays: list[pa.BinaryArray]) -> pa.BinaryArray:
    return pa.concat_arrays(arrays) if arrays else pa.array([], pa.binary())


def numbered(texts: pa.BinaryArray) -> tuple[np.ndarray, pa.BinaryArray, np.ndarray]:
    """(number of every text, the distinct ones in order of occurrence, where each occurs first)."""
    found = texts.dictionary_encode()
    number = found.indices.to_numpy().astype(np.int64)
    first = np.empty(len(found.dictionary), dtype=np.int64)
    first[number[::-1]] = np.arange(len(number))[::-1]
    return number, found.dictionary, first


def least_of(number: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    out = np.full(n, LAST)
    np.minimum.at(out, number, values)
    return out


def occurrences(held: list[Slice], shared: Shared | None, window: int) -> tuple[list[np.ndarray], pa.BinaryArray]:
    """Which passages of each slice may repeat, and the bytes of all of them."""
    rows = [np.flatnonzero(shared.holds(one.hash)) if shared else np.arange(len(one.hash)) for one in held]
    texts = [gathered(one.data, one.start[r], one.windows[r] + (window - 1)) for one, r in zip(held, rows, strict=True)]
    return rows, joined(texts)


def document_ids(one: Slice, rows: np.ndarray) -> np.ndarray:
    return one.order[one.document[rows]]


def block_passages(held: list[Slice], shared: Shared | None, window: int) -> tuple[pa.BinaryArray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct passages of a block in order of occurrence: bytes, anchor's place in them, its hash, smallest document id."""
    rows, texts = occurrences(held, shared, window)
    number, distinct, first = numbered(texts)
    every = lambda f, kind: np.concatenate([np.empty(0, dtype=kind), *(f(one, r) for one, r in zip(held, rows, strict=True))])
    offset = every(lambda one, r: one.at[r] - one.start[r], np.int64)
    return distinct, offset[first], every(lambda one, r: one.hash[r], U)[first], least_of(number, every(document_ids, np.int64), len(distinct))


def passages(hits: DataFrame, shards: int, bounds: list[int], window: int, anchor: int) -> DataFrame:
    """Packed passages by batch and shard, from the files' shared anchors; a batch ends where the next bound begins."""

    def run(table: pa.Table) -> pa.Table:
        out: list[list] = [[], [], [], [], []]
        shared, file = Shared(table, shards), table["file"][0].as_py()
        for number, held in blocks(file, window, anchor) if shared.of else ():
            found, offset, hashes, least = block_passages(held, shared, window)
            batch, shard = np.searchsorted(np.array(bounds, dtype=np.int64), least, side="right"), (hashes % U(shards)).astype(np.int64)
            order = np.lexsort((shard, batch))
            texts = found.take(pa.array(order))
            for i, n in zip(*runs_of((batch * shards + shard)[order]), strict=True):
                rows = order[i : i + n]
                blob = packed(text=texts.slice(i, n), offset=pa.array(offset[rows].astype(np.uint16)), least=pa.array(least[rows]), number=pa.array(rows.astype(np.int32)))
                for column, value in zip(out, (int(batch[rows[0]]), int(shard[rows[0]]), file, number, blob), strict=True):
                    column.append(value)
        return pa.table([pa.array(x, k) for x, k in zip(out, (pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.binary()), strict=True)], names=["batch", "shard", "file", "block", "passages"])

    return hits.groupBy("file").applyInArrow(run, PASSAGES)


# ---- the family

LEVEL = "shard int, packed binary"
OUT = "shard int, kind string, file string, block int, packed binary"


class Level:
    """Distinct passages, sorted by the suffixes at their anchors: texts, anchors' places, and the first document of their windows.

    ``first`` has it where it is the same for all windows; ``mixed`` has the others' first documents, window by window."""

    def __init__(self, text: pa.BinaryArray, offset: np.ndarray, first: np.ndarray, mixed: dict[int, np.ndarray]):
        self.text, self.offset, self.first, self.mixed = text, offset, first, mixed

    @property
    def sizes(self) -> np.ndarray:
        return np.diff(bounds_of(self.text))

    def suffixes(self) -> pa.BinaryArray:
        """Every passage from its anchor on, then what is before it."""
        size, begin = self.sizes, bounds_of(self.text)[:-1]
        ends = np.cumsum(size)
        at = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - size, size)
        turned = np.repeat(begin, size) + (at + np.repeat(self.offset, size)) % np.repeat(size, size)
        data = np.frombuffer(self.text.buffers()[2] or b"", dtype=np.uint8)
        return pa.BinaryArray.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(np.concatenate(([0], ends)).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data[turned]))])

    def anchors(self, width: int) -> np.ndarray:
        begin = bounds_of(self.text)[:-1] + self.offset
        data = np.frombuffer(self.text.buffers()[2] or b"", dtype=np.uint8)
        return np.ascontiguousarray(data[begin[:, None] + np.arange(width)]).view(f"S{width}").ravel() if len(begin) else np.empty(0, dtype=f"S{width}")

    def windows(self, i: int, window: int) -> np.ndarray:
        return self.mixed[i] if i in self.mixed else np.full(len(self.text[i].as_buffer()) - window + 1, self.first[i])

    def taken(self, order: np.ndarray) -> Level:
        mixed = {}
        if self.mixed:
            place = np.full(len(self.offset), -1)
            place[order] = np.arange(len(order))
            mixed = {int(place[i]): x for i, x in self.mixed.items() if place[i] >= 0}
        return Level(self.text.take(pa.array(order)), self.offset[order], self.first[order], mixed)

    @classmethod
    def sorted(cls, levels: list[Level]) -> Level:
        """One suffix array of several that share no passage."""
        begin = np.cumsum([0, *(len(x.offset) for x in levels)])
        mixed = {int(b) + i: x for b, level in zip(begin, levels, strict=False) for i, x in level.mixed.items()}
        none = np.empty(0, dtype=np.int64)
        whole = cls(joined([x.text for x in levels]), np.concatenate([none, *(x.offset for x in levels)]), np.concatenate([none, *(x.first for x in levels)]), mixed)
        return whole.taken(pa.compute.sort_indices(whole.suffixes()).to_numpy().astype(np.int64))

    def pack(self) -> bytes:
        at = sorted(self.mixed)
        lists = pa.array([self.mixed.get(i) for i in range(len(self.offset))], pa.list_(pa.int64())) if at else pa.nulls(len(self.offset), pa.list_(pa.int64()))
        return packed(text=self.text, offset=pa.array(self.offset.astype(np.uint16)), first=pa.array(self.first), mixed=lists)

    @classmethod
    def unpack(cls, data: bytes) -> Level:
        batch = unpacked(data)
        lists = batch.column("mixed")
        mixed = {int(i): lists[int(i)].values.to_numpy() for i in np.flatnonzero(lists.is_valid().to_numpy(zero_copy_only=False))}
        return cls(batch.column("text"), batch.column("offset").to_numpy().astype(np.int64), batch.column("first").to_numpy().astype(np.int64), mixed)


def first_documents(text: list[bytes], least: list[np.ndarray], window: int) -> list[np.ndarray]:
    """For passages that share anchors: the first document of each of their windows, over all of them."""
    sizes = np.array([len(t) - window + 1 for t in text])
    data = np.frombuffer(b"".join(text), dtype=np.uint8)
    begin = np.cumsum(sizes + window - 1) - (sizes + window - 1)
    place = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(begin, sizes)
    suffixes = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data, window)[place]).view(f"S{window}").ravel()
    order = np.argsort(suffixes)
    known = np.concatenate(least)
    first, counts = runs_of(suffixes[order])
    out = np.empty_like(known)
    out[order] = np.repeat(np.minimum.reduceat(known[order], first), counts)
    return np.split(out, np.cumsum(sizes)[:-1])


def ingest_shard(batch: list[pa.RecordBatch], levels: list[Level], window: int, anchor: int) -> tuple[Level, Level, np.ndarray]:
    """(the batch's passages that no level has, as a level; all its distinct passages, with what is known of them; the distinct number of every row of the batch)."""
    column = lambda name: np.concatenate([np.empty(0, dtype=np.int64), *(p.column(name).to_numpy().astype(np.int64) for p in batch)])
    number, text, at = numbered(joined([p.column("text") for p in batch]))
    every = Level(text, column("offset")[at], least_of(number, column("least"), len(text)), {})
    fresh = np.ones(len(text), dtype=bool)
    for level in levels:  # nothing later can come before what a level knows of a passage
        place = pa.compute.index_in(text, value_set=level.text).fill_null(-1).to_numpy().astype(np.int64)
        hit = np.flatnonzero(place >= 0)
        fresh[hit] = False
        every.first[hit] = level.first[place[hit]]
        if level.mixed:
            every.mixed.update({int(i): level.mixed[int(p)] for i, p in zip(hit, place[hit], strict=True) if int(p) in level.mixed})
    new = np.flatnonzero(fresh)
    order = new[pa.compute.sort_indices(every.taken(new).suffixes()).to_numpy().astype(np.int64)]
    own = every.taken(order)
    # merge scan: runs of equal anchors in the batch, with the levels' places of the same anchors
    keys = own.anchors(anchor)
    first, counts = runs_of(keys)
    spans = []
    for level in levels:
        held = level.anchors(anchor)
        spans.append((level, np.searchsorted(held, keys[first], side="left"), np.searchsorted(held, keys[first], side="right")))
    met = counts > 1
    for _, low, high in spans:
        met |= high > low
    group_text, group_least, mine, size = [], [], [], 0

    def settle() -> None:
        if mine:
            found = first_documents(group_text, group_least, window)
            for there, i in mine:
                own.mixed[i] = found[there]
        group_text.clear(), group_least.clear(), mine.clear()

    for g in np.flatnonzero(met):
        before = len(group_text)
        for i in range(first[g], first[g] + counts[g]):
            mine.append((len(group_text), i))
            group_text.append(own.text[i].as_py())
            group_least.append(own.windows(i, window))
        for level, low, high in spans:
            for i in range(low[g], high[g]):
                group_text.append(level.text[i].as_py())
                group_least.append(level.windows(i, window))
        size += sum(map(len, group_text[before:]))
        if size > SORTED:
            settle()
            size = 0
    settle()
    every.mixed.update({int(order[i]): x for i, x in own.mixed.items()})
    return own, every, number


def as_runs(known: Level, number: np.ndarray, own: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(passage's number, windows, first document): runs of windows with the same first document. ``number`` places the pack's rows in ``known``."""
    apart = np.isin(number, np.fromiter(known.mixed, dtype=np.int64, count=len(known.mixed)))
    plain = number[~apart]
    out = [(own[~apart], known.sizes[plain] - window + 1, known.first[plain])]
    for row, i in zip(own[apart].tolist(), number[apart].tolist(), strict=True):
        first, counts = runs_of(known.mixed[i])
        out.append((np.full(len(first), row), counts, known.mixed[i][first]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


class SuffixFamily:
    """A family in a shared folder. Batches are ingested in ascending order of their documents.

    Levels of equal size are merged by the ingestion after the one that made them equal, in the same tasks that scan them."""

    def __init__(self, spark: SparkSession, path: str | None = None, window: int = WINDOW, anchor: int = ANCHOR):
        self.spark, self.window, self.anchor = spark, window, anchor
        self.path = path or shared_path(spark, "suffixes")
        self.batches, self.levels = 0, []  # (height, table), the oldest first; a level of height h holds 2 ** h batches

    def _due(self) -> tuple[list[int], int]:
        """(which levels are to be merged, the height of what they make): as in a binary counter."""
        heights = [h for h, _ in self.levels]
        due, height = [], None
        while len(heights) > 1 and heights[-1] == heights[-2]:
            due = due or [len(heights) - 1]
            height = heights.pop() + 1
            heights[-1] = height
            due.insert(0, len(heights) - 1)
        return due, height

    def ingest(self, batch: DataFrame) -> DataFrame:
        """(file, block, packed): for every passage of the batch the first documents of its windows. The batch joins the family."""
        window, anchor = self.window, self.anchor
        due, height = self._due()
        levels = self.spark.createDataFrame([], "shard int, place int, entries binary")
        for place, (_, path) in enumerate(self.levels):
            levels = levels.unionByName(self.spark.read.schema(LEVEL).parquet(path).select("shard", F.lit(place).alias("place"), F.col("packed").alias("entries")))

        def run(new: pa.Table, old: pa.Table) -> pa.Table:
            held = {p: Level.unpack(e) for p, e in zip(old["place"].to_pylist(), old["entries"].to_pylist(), strict=True)}
            packs = [unpacked(x) for x in new["passages"].to_pylist()]
            shard = (new if new.num_rows else old)["shard"][0].as_py()
            own, known, number = ingest_shard(packs, [*held.values()], window, anchor)
            rows = [("level", None, None, own.pack())] if len(own.offset) else []
            if due and (merged := [held[p] for p in due if p in held]):
                rows.append(("merged", None, None, Level.sorted(merged).pack()))
            begin = 0
            for file, block, pack in zip(new["file"].to_pylist(), new["block"].to_pylist(), packs, strict=True):
                numbers, windows, document = as_runs(known, number[begin : begin + len(pack)], pack.column("number").to_numpy(), window)
                begin += len(pack)
                rows.append(("first", file, block, packed(number=pa.array(numbers.astype(np.int32)), windows=pa.array(windows.astype(np.uint16)), document=pa.array(document))))
            columns = list(zip(*[(shard, *r) for r in rows], strict=True)) or [[]] * 5
            return pa.table([pa.array(x, k) for x, k in zip(columns, (pa.int32(), pa.string(), pa.string(), pa.int32(), pa.binary()), strict=True)], names=["shard", "kind", "file", "block", "packed"])

        ship_code(self.spark)
        made = batch.select("shard", "file", "block", "passages").groupBy("shard").cogroup(levels.groupBy("shard")).applyInArrow(run, OUT)
        path = f"{self.path}/{self.batches}"
        made.write.partitionBy("kind").parquet(path)
        self.batches += 1
        table = self.spark.read.schema(OUT).option("basePath", path).parquet(path)
        if due:
            discard(*[self.levels[p][1] for p in due])
            self.levels[due[0] :] = [(height, self._part(table, path, "merged"))]
        self.levels.append((0, self._part(table, path, "level")))
        return table.filter("kind = 'first'").select("file", "block", "packed")

    def _part(self, table: DataFrame, path: str, kind: str) -> str:
        """The folder of a kind of rows, made where there are none."""
        part = f"{path}/kind={kind}"
        if table.filter(F.col("kind") == kind).isEmpty():
            self.spark.createDataFrame([], LEVEL).write.mode("overwrite").parquet(part)
        return part


# ---- what goes

SPANS = "doc_id long, n_bytes long, spans array<struct<start: long, length: long>>, kept binary"


def removed(one: Slice, rows: np.ndarray, numbers: np.ndarray, runs: tuple[np.ndarray, ...], window: int) -> np.ndarray:
    """A mask of the slice's bytes that go; ``runs``: for each number the first run, runs, their first windows, sizes and documents."""
    begin, count, at, size, document = runs
    n = count[numbers]
    which = np.repeat(begin[numbers], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    own = np.repeat(rows, n)
    goes = document[which] < document_ids(one, own)
    start = one.start[own[goes]] + at[which[goes]]
    end = start + size[which[goes]] + (window - 1)
    delta = np.bincount(start, minlength=len(one.data) + 1) - np.bincount(end, minlength=len(one.data) + 1)
    return np.cumsum(delta[:-1]) > 0


def _block_runs(packs: list[pa.RecordBatch], n: int) -> tuple[np.ndarray, ...]:
    column = lambda name: np.concatenate([np.empty(0, dtype=np.int64), *(p.column(name).to_numpy().astype(np.int64) for p in packs)])
    number, size, document = (column(x) for x in ("number", "windows", "document"))
    order = np.argsort(number, kind="stable")
    number, size, document = number[order], size[order], document[order]
    count = np.bincount(number, minlength=n)
    begin = np.cumsum(count) - count
    total = np.cumsum(size) - size
    return begin, count, total - total[begin[number]] if len(number) else total, size, document


def cut(rows: DataFrame, shards: int, window: int, anchor: int) -> DataFrame:
    """For rows (file, shard, block, data), of shared anchors and of first documents by file: spans and kept bytes of its documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        file = table["file"][0].as_py()
        anchors = table.filter(pa.compute.is_valid(table["shard"]))
        shared = Shared(pa.table({"shard": anchors["shard"], "hashes": anchors["data"]}), shards)
        firsts: dict[int, list[bytes]] = {}
        for block, data in zip(table["block"].to_pylist(), table["data"].to_pylist(), strict=True):
            if block is not None:
                firsts.setdefault(block, []).append(data)
        for block, held in blocks(file, window, anchor):
            rows, texts = occurrences(held, shared, window)
            numbers, distinct, _ = numbered(texts)
            runs = _block_runs([unpacked(x) for x in firsts.pop(block, [])], len(distinct))
            for one, own, number in zip(held, rows, np.split(numbers, np.cumsum([len(r) for r in rows])[:-1]), strict=True):
                yield _cut_slice(one, removed(one, own, number, runs, window))

    return rows.groupBy("file").applyInArrow(run, SPANS)


def _cut_slice(one: Slice, gone: np.ndarray) -> pa.RecordBatch:
    ends = np.cumsum(one.lengths)
    begins = ends - one.lengths
    # runs of bytes that go, cut where documents end
    edge = np.flatnonzero(np.diff(np.concatenate(([0], gone.view(np.int8), [0]))))
    a, b = edge[::2], edge[1::2]
    document = np.searchsorted(ends, a, side="right")
    pieces = np.searchsorted(ends, b, side="left") - document + 1
    at = np.repeat(np.arange(len(a)), pieces)
    document = document[at] + np.arange(len(at)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    start, stop = np.maximum(a[at], begins[document]), np.minimum(b[at], ends[document])
    whole = stop > start  # documents without bytes lie between others
    document, start, stop = document[whole], start[whole], stop[whole]
    counts = np.bincount(document, minlength=len(one.ids))
    offsets = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
    spans = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(start - begins[document]), pa.array(stop - start)], names=["start", "length"]))
    lost = np.bincount(document, weights=stop - start, minlength=len(one.ids)).astype(np.int64)
    kept = pa.BinaryArray.from_buffers(pa.binary(), len(one.ids), [None, pa.py_buffer(np.concatenate(([0], np.cumsum(one.lengths - lost))).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(one.data[~gone]))])
    return pa.RecordBatch.from_arrays([pa.array(one.ids, pa.int64()), pa.array(one.lengths), spans, kept], names=["doc_id", "n_bytes", "spans", "kept"])


def remove_repeats(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, batches: int = BATCHES) -> DataFrame:
    """doc_id, n_bytes, spans that go, kept bytes of every row of ``docs``."""
    spark = docs.sparkSession
    ship_code(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    texts = materialize(texts, "texts", compression="zstd").withColumn("file", F.input_file_name())
    files = materialize(texts.groupBy("file").agg(F.sum(F.octet_length("text")).alias("size")), "files")
    n_files, size = files.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    wide = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shards, tasks = max(wide, -(-size // SHARD_BYTES)), max(wide, n_files)
    parts = [i / batches for i in range(1, batches)]
    bounds = sorted(set(texts.agg(F.percentile_approx("doc_id", parts, 1000)).first()[0] or [])) if parts else []
    hits = materialize(shared_anchors(anchor_hashes(texts, shards, window, anchor)), "anchors")
    path = shared_path(spark, "passages")
    passages(hits.repartition(tasks, "file"), shards, bounds, window, anchor).write.partitionBy("batch").parquet(path)
    family, firsts = SuffixFamily(spark, window=window, anchor=anchor), []
    packs = spark.read.schema(PASSAGES).parquet(path)
    for batch in range(len(bounds) + 1):
        firsts.append(family.ingest(packs.filter(F.col("batch") == batch)))
    null = F.lit(None)
    rows = files.select("file", null.cast("int").alias("shard"), null.cast("int").alias("block"), null.cast("binary").alias("data"))
    rows = rows.unionByName(hits.select("file", "shard", null.cast("int").alias("block"), F.col("hashes").alias("data")))
    for first in firsts:
        rows = rows.unionByName(first.select("file", null.cast("int").alias("shard"), "block", F.col("packed").alias("data")))
    return cut(rows.repartition(tasks, "file"), shards, window, anchor)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")))
    n_removed = F.aggregate("spans", F.lit(0).cast("long"), lambda total, span: total + span["length"])
    return found.select("doc_id", "n_bytes", n_removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


SQL = r"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
x AS (SELECT r, doc_id, hex(encode(text)) AS h, strlen(text) AS n FROM t),
b AS (SELECT r, doc_id, unnest(range(n)) AS i, unnest(regexp_extract_all(h, '..')) AS byte FROM x),
b2 AS (SELECT *, byte || lead(byte) OVER (PARTITION BY r ORDER BY i) AS s2 FROM b),
b4 AS (SELECT *, s2 || lead(s2, 2) OVER (PARTITION BY r ORDER BY i) AS s4 FROM b2),
b8 AS (SELECT *, s4 || lead(s4, 4) OVER (PARTITION BY r ORDER BY i) AS s8 FROM b4),
b16 AS (SELECT *, s8 || lead(s8, 8) OVER (PARTITION BY r ORDER BY i) AS s16 FROM b8),
b24 AS (SELECT *, s16 || lead(s8, 16) OVER (PARTITION BY r ORDER BY i) AS s24 FROM b16),
w AS (SELECT r, doc_id, i, byte, s24 || lead(s24, 24) OVER (PARTITION BY r ORDER BY i) || lead(s2, 48) OVER (PARTITION BY r ORDER BY i) AS s FROM b24),
m AS (SELECT s, min(doc_id) AS least FROM w WHERE s IS NOT NULL GROUP BY s),
g AS (SELECT r, i, byte, coalesce(least < coalesce(doc_id, 9223372036854775807), false) AS starts FROM w LEFT JOIN m USING (s)),
c AS (SELECT r, i, byte, max(starts) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone FROM g),
d AS (SELECT r, i, byte, gone, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY r ORDER BY i), false) AS span FROM c),
k AS (SELECT r, count(*) FILTER (gone) AS n_removed, count(*) FILTER (span) AS n_spans, coalesce(string_agg(byte, '' ORDER BY i) FILTER (NOT gone), '') AS kept FROM d GROUP BY r)
SELECT doc_id, n::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM x LEFT JOIN k USING (r)
"""
