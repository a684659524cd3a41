"""WARC archives with revisit records, found again through a two-level capture index.

Records are gzip members in archives that tasks write to a shared folder, behind a warcinfo record each; of records with
equal payloads the one with the smallest page_id is a response, the others are revisits that refer to it. The index has two
levels: capture lines sorted by reversed-host URL key in compressed blocks of ``BLOCK_LINES``, and a
sparse directory with the first and last key of every block, sorted, in a file for each range of keys. What is known of a directory
file without reading it is its range of keys and how many entries it has: a row for each index task, small enough to send around.
A look-up bisects those rows, then the directory file by range reads of single entries, reads the blocks that can hold the key,
bisects their lines and range-reads the records. ``read`` is this look-up for many URLs at once: sorted keys walk
the directory together, and a block is read once a task.

Archives get unique names and count only if the task that wrote them ends well, so a lost executor leaves
nothing wrong behind. Defined results: null html is an empty payload, null url an empty key; a null
page_id never is a response unless no equal payload has an id; rows that repeat page_id and payload get
the same kind of record, and rows that repeat a page_id records of the same name; empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.exact_dedup import HEADS
from quire.runtime import materialize, open_store, shared_path, ship_code, spread

ARCHIVE_BYTES, BLOCK_LINES, MIN_REVISIT_BYTES, DATE = 256 << 20, 3000, 0, "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CAPTURE = "key string, page_id long, path string, at long, size long"


def url_key(url: str | None) -> str:
    """Reversed-host key: https://www.example.net/a?b -> net,example,www)/a?b. Without fragment, blanks quoted."""
    text = (url or "").split("#", 1)[0].strip()
    try:
        parts = urlsplit(text)
        host, port = parts.hostname or "", parts.port
    except ValueError:
        return "".join(f"%{b:02X}" if b <= 32 or b > 126 else chr(b) for b in text.encode())
    if not host:
        key = text
    else:
        key = ",".join(reversed(host.split("."))) + (f":{port}" if port and port not in (80, 443) else "") + ")" + (parts.path or "/")
        key += f"?{parts.query}" if parts.query else ""
    return "".join(f"%{b:02X}" if b <= 32 or b > 126 else chr(b) for b in key.encode("utf-8", "surrogatepass"))


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One gzip member."""
    name = lambda i: f"<urn:page:{'none' if i is None else i}>"
    target = "".join(c if c > " " else f"%{ord(c):02X}" for c in url or "")
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if revisit else head + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {name(page_id)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {target}"]
    lines.append(f"WARC-Payload-Digest: sha1:{payload_digest(payload)}")
    lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {name(refers_to)}"] if revisit else []
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n") + pack.flush()


def info(name: str) -> bytes:
    """The first record of an archive."""
    block = b"software: quire\r\nformat: WARC File Format 1.1\r\n"
    lines = ["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: <urn:archive:{name}>", f"WARC-Date: {DATE}", f"WARC-Filename: {name}", "Content-Type: application/warc-fields", f"Content-Length: {len(block)}"]
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + pack.flush()


def parse(member: bytes) -> dict:
    """What a record says; a response's payload is checked against its digest."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not lines[0].startswith("WARC/1."):
        raise ValueError(f"no WARC record: {lines[0][:40]!r}")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    number = lambda x: None if x is None or x == "<urn:page:none>" else int(x.removeprefix("<urn:page:").rstrip(">"))
    digest, kind = fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"]
    if kind == "response" and payload_digest(payload) != digest:
        raise ValueError(f"payload of {fields['WARC-Record-ID']} doesn't match its digest")
    length = len(payload) if kind == "response" else int(http.rpartition(b"Content-Length: ")[2])
    return {"page_id": number(fields["WARC-Record-ID"]), "url": fields["WARC-Target-URI"], "payload": payload, "payload_bytes": length, "payload_digest": digest, "record_type": kind, "refers_to": number(fields.get("WARC-Refers-To"))}


def _archives(root: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = open_store(root)
        store.create_dir(folder, recursive=True)
        out, name, at = None, "", 0
        for batch in batches:
            rows = []
            for page_id, url, html, refers_to, revisit in zip(*(batch.column(c) for c in ("page_id", "url", "html", "refers_to", "revisit")), strict=True):
                if out is None or at >= ARCHIVE_BYTES:
                    if out is not None:
                        out.close()
                    name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = store.open_output_stream(f"{folder}/{name}", compression=None)
                    head = info(name)
                    out.write(head)
                    at = len(head)
                member = record(page_id.as_py(), url.as_py(), (html.as_py() or "").encode("utf-8", "surrogatepass"), refers_to.as_py(), revisit.as_py())
                out.write(member)
                rows.append((url_key(url.as_py()), page_id.as_py(), name, at, len(member)))
                at += len(member)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["key", "page_id", "path", "at", "size"])
        if out is not None:
            out.close()

    return run


def _blocks(root: str):
    """Writes a task's sorted capture lines as compressed blocks and its part of the directory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = open_store(root)
        store.create_dir(folder, recursive=True)
        name, at, out, held = uuid.uuid4().hex, 0, None, []
        entries: list[bytes] = []
        ends: list[str] = []

        def flush() -> None:
            nonlocal at, out, held
            if held:
                out = out or store.open_output_stream(f"{folder}/{name}.cdx.z", compression=None)
                block = zlib.compress("\n".join(held).encode())
                out.write(block)
                keys = held[0].split(" ", 1)[0], held[-1].split(" ", 1)[0]
                entries.append(f"{keys[0]} {keys[1]} {at} {len(block)}".encode())
                ends[:] = [ends[0] if ends else keys[0], keys[1]]
                at, held = at + len(block), []

        for batch in batches:
            for key, page_id, path, start, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.append(f"{key} {'-' if page_id is None else page_id} {path} {start} {size}")
                if len(held) == BLOCK_LINES:
                    flush()
        flush()
        if out is not None:
            out.close()
            places = [0]
            with store.open_output_stream(f"{folder}/{name}.dir", compression=None) as file:
                for entry in entries:
                    file.write(entry)
                    places.append(places[-1] + len(entry))
                file.write(struct.pack(f"<{len(places)}Q", *places))
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (ends[0], ends[1], name, len(entries), places[-1])], names=["first_key", "last_key", "name", "entries", "bytes"])

    return run


class Directory:
    """The sparse directory: ranges of keys in memory, entries in files that are searched by range reads."""

    def __init__(self, store: fs.FileSystem, folder: str, ranges: list[tuple[str, str, str, int, int]]):
        self.store, self.folder, self.ranges = store, folder, sorted(ranges)
        self.lasts = [r[1] for r in self.ranges]
        self.name, self.file, self.reads = None, None, 0
        self.held: tuple[str, int] | None = None
        self.lines: list[str] = []

    def _entry(self, part: tuple, i: int) -> tuple[str, str, int, int]:
        """(first key, last key, place and size of the block) of entry ``i``: two range reads."""
        _, _, name, _, end = part
        if name != self.name:
            self.close()
            self.name, self.file = name, self.store.open_input_file(f"{self.folder}/{name}.dir")
        a, b = struct.unpack("<2Q", self.file.read_at(16, end + 8 * i))
        first, last, at, size = self.file.read_at(b - a, a).decode().split(" ")
        self.reads += 1
        return first, last, int(at), int(size)

    def close(self) -> None:
        if self.file is not None:
            self.file.close()
            self.name = self.file = None

    def _block(self, name: str, at: int, size: int) -> list[str]:
        if self.held != (name, at):
            with self.store.open_input_file(f"{self.folder}/{name}.cdx.z") as file:
                self.lines, self.held = zlib.decompress(file.read_at(size, at)).decode().split("\n"), (name, at)
            self.keys = [x.split(" ", 1)[0] for x in self.lines]
        return self.lines

    def parts(self, key: str) -> list[int]:
        """Which ranges can hold a key; a hot key fills several."""
        first = bisect_left(self.lasts, key)
        last = first
        while last < len(self.ranges) and self.ranges[last][0] <= key:
            last += 1
        return [*range(first, last)]

    def find(self, key: str, only: int | None = None) -> Iterator[list[str]]:
        """The capture lines of a key, split, from all ranges or one."""
        for part in (self.ranges[i] for i in (self.parts(key) if only is None else [only])):
            low = bisect_left(range(part[3]), key, key=lambda i, p=part: self._entry(p, i)[1])
            for i in range(low, part[3]):
                first, _, at, size = self._entry(part, i)
                if first > key:
                    break
                lines = self._block(part[2], at, size)
                for line in lines[bisect_left(self.keys, key) : bisect_right(self.keys, key)]:
                    yield line.split(" ")


def by_heat(rows: DataFrame, copies: DataFrame, n_rows: int) -> tuple[DataFrame, DataFrame]:
    """Rows with the page their payload refers to, if any: those of hot payloads, which stay where they are, and the others, which move by digest.

    Payloads that more than 1 / HEADS of the rows hold are fewer than HEADS and are broadcast, so a digest that moves holds a small share of the rows."""
    hot = F.col("n") * HEADS > n_rows
    heads = F.broadcast(copies.filter(hot).select("digest", "refers_to", F.lit(True).alias("hot")))
    marked = rows.join(heads, "digest", "left")
    others = marked.filter("hot IS NULL").drop("refers_to", "hot").join(copies.filter(~hot).drop("n"), "digest", "left")
    return marked.filter("hot").drop("hot"), others


class CaptureIndex:
    """The archives and both index levels under ``root``."""

    def __init__(self, spark: SparkSession, root: str, directory: DataFrame):
        self.spark, self.root, self.directory = spark, root, directory

    @classmethod
    def write(cls, pages: DataFrame, root: str | None = None, min_bytes: int = MIN_REVISIT_BYTES) -> CaptureIndex:
        spark = pages.sparkSession
        ship_code(spark)
        root = root or shared_path(spark, "warc")
        text = F.coalesce(F.col("html").cast("string"), F.lit(""))
        rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), text.alias("html"), F.sha1(text.cast("binary")).alias("digest"), F.octet_length(text).alias("bytes"))
        copies = rows.filter(F.col("bytes") >= min_bytes).groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).filter("n > 1")
        copies = materialize(copies, "copies")
        hot, others = by_heat(rows, copies, pages.count())
        rows = hot.unionByName(others)
        revisit = F.col("refers_to").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("refers_to"))
        captures = rows.select("page_id", "url", "html", "refers_to", revisit.alias("revisit")).mapInArrow(_archives(f"{root}/archives"), CAPTURE)
        captures = materialize(captures, "captures")
        ordered = captures.repartitionByRange("key", "page_id", "path", "at").sortWithinPartitions("key", "page_id", "path", "at")
        directory = ordered.mapInArrow(_blocks(f"{root}/index"), "first_key string, last_key string, name string, entries long, bytes long")
        return cls(spark, root, materialize(directory, "directory"))

    def ranges(self) -> list[tuple[str, str, str, int, int]]:
        """A row for each index task."""
        return [tuple(r) for r in self.directory.collect()]

    def captures(self, urls: DataFrame) -> DataFrame:
        """The capture lines of the URLs in column ``url``, found through the directory; a URL key counts once."""
        ranges, root = self.ranges(), f"{self.root}/index"

        def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_arrays([pa.array([url_key(x.as_py()) for x in batch.column(0)], pa.string())], names=["key"])

        def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            directory = Directory(*open_store(root), ranges)
            for batch in batches:
                found = [(key, part) for key in batch.column(0).to_pylist() for part in directory.parts(key)]
                yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.int64())], names=["key", "part"])

        def lines(found: list[list[str]]) -> pa.RecordBatch:
            key, page_id, path, at, size = zip(*found, strict=True)
            ids = pa.array([None if x == "-" else int(x) for x in page_id], pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(key), ids, pa.array(path), pa.array(map(int, at), pa.int64()), pa.array(map(int, size), pa.int64())], names=["key", "page_id", "path", "at", "size"])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            directory, found = Directory(*open_store(root), ranges), []
            for batch in batches:
                for key, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    for line in directory.find(key, part):
                        found.append(line)
                        if len(found) == BLOCK_LINES:
                            yield lines(found)
                            found = []
            if found:
                yield lines(found)
            directory.close()

        asked = urls.select(F.col("url").cast("string").alias("url")).mapInArrow(keys, "key string").distinct().mapInArrow(places, "key string, part long")
        return asked.repartitionByRange("part", "key").sortWithinPartitions("part", "key").mapInArrow(run, CAPTURE)

    def read(self, urls: DataFrame, payload: bool = False) -> DataFrame:
        """The records of the URLs: page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload (null unless asked for)."""
        root = f"{self.root}/archives"

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            store, folder = open_store(root)
            name, file = None, None
            for batch in batches:
                rows = []
                for path, at, size in zip(*(batch.column(c).to_pylist() for c in ("path", "at", "size")), strict=True):
                    if path != name:
                        if file is not None:
                            file.close()
                        name, file = path, store.open_input_file(f"{folder}/{path}")
                    rows.append(parse(file.read_at(size, at)))
                if rows:
                    columns = [("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]
                    data = [pa.array([r[c] for r in rows], t) for c, t in columns]
                    data.append(pa.array([r["payload"] if payload else None for r in rows], pa.binary()))
                    yield pa.RecordBatch.from_arrays(data, names=[*(c for c, _ in columns), "payload"])
            if file is not None:
                file.close()

        ranges = self.captures(urls).withColumn("slice", F.floor(F.col("at") / (4 << 20)))
        dealt = ranges.repartition("path", "slice").sortWithinPartitions("path", "at")
        return dealt.select("path", "at", "size").mapInArrow(run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")

    def lookup(self, url: str) -> list[dict]:
        """The records of one URL, found on the driver."""
        directory = Directory(*open_store(f"{self.root}/index"), self.ranges())
        archives, place = open_store(f"{self.root}/archives")
        out = []
        for _, _, name, start, length in directory.find(url_key(url)):
            with archives.open_input_file(f"{place}/{name}") as file:
                out.append(parse(file.read_at(int(length), int(start))))
        directory.close()
        return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    index = CaptureIndex.write(spread(pages.select("page_id", "url", "html")))
    return index.read(pages.select("url")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first_id, CAST(CAST(unhex(h) AS BIT) AS VARCHAR) AS bits FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1
           + 16 * CAST(substr(bits, 5 * i + 1, 1) AS INTEGER) + 8 * CAST(substr(bits, 5 * i + 2, 1) AS INTEGER)
           + 4 * CAST(substr(bits, 5 * i + 3, 1) AS INTEGER) + 2 * CAST(substr(bits, 5 * i + 4, 1) AS INTEGER)
           + CAST(substr(bits, 5 * i + 5, 1) AS INTEGER) AS BIGINT), 1)), '') AS payload_digest,
       CASE WHEN first_id IS NULL OR page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first_id IS NULL OR page_id = first_id THEN NULL ELSE first_id END AS refers_to
FROM f
"""
