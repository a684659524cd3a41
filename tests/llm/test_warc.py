import base64
import hashlib

from quire.llm import warc as m

SCHEMA = "page_id long, url string, html string, digest string, key string, at long"
ROWS = [
    (3, "https://www.example.net/b?x=1#f", "<p>same</p>"), (1, "http://example.net:80/b", "<p>same</p>"), (2, "https://a.example.org/", "<p>öther</p>"), (4, None, None), (9, "", ""),
    (5, "https://Example.net/b", "x" * 300_000), (6, "not a url", "<p>same</p>"), (6, "not a url", "<p>same</p>"), (None, "https://n.example/", "<p>same</p>"), (7, "https://[bad/", "\r\n\r\nWARC/1.1"),
]


def frame(spark, rows=None):
    return spark.createDataFrame([(*r, "d", "k", 1) for r in (ROWS if rows is None else rows)], SCHEMA)


def brute():
    first = {}
    for i, _, h in ROWS:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    out = []
    for i, _, h in ROWS:
        data = (h or "").encode()
        head = first.get(h or "")
        again = head is not None and i != head
        out.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response", head if again else None))
    return out


def test_records_survive_the_round_trip(spark):
    index = m.CaptureIndex.write(frame(spark))
    got = [tuple(r) for r in index.read(frame(spark)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()]
    assert sorted(got, key=str) == sorted(brute(), key=str)
    full = {r.page_id: bytes(r.payload) for r in index.read(frame(spark), payload=True).filter("record_type = 'response'").collect()}
    assert full[5] == b"x" * 300_000 and full[7] == b"\r\n\r\nWARC/1.1" and full[2] == "<p>öther</p>".encode()


def test_a_hot_payload_stays_where_it_is(spark, monkeypatch):
    """A payload that half of the pages hold crosses no exchange, those that few share meet by digest."""
    monkeypatch.setattr(m, "HEADS", 4)
    rows = [(i, f"https://h.example/{i}", "<p>half</p>" if i % 2 else f"<p>{i % 50}</p>" if i % 3 else f"<p>own {i}</p>") for i in range(400)]
    index = m.CaptureIndex.write(frame(spark, rows))
    first = {}
    for i, _, html in rows:
        first.setdefault(html, i)
    got = {r.page_id: r.refers_to for r in index.read(frame(spark, rows)).collect()}
    assert got == {i: None if first[html] == i else first[html] for i, _, html in rows} and len(set(got.values())) > 10
    own = frame(spark, rows).select("page_id", "html", m.F.sha1(m.F.col("html").cast("binary")).alias("digest"))
    copies = own.groupBy("digest").agg(m.F.min("page_id").alias("refers_to"), m.F.count(m.F.lit(1)).alias("n")).filter("n > 1")
    written = spark.createDataFrame(copies.collect(), copies.schema)
    hot, others = m.by_heat(own, written, len(rows))
    assert hot.count() == 200 and others.count() == 200 and {r.refers_to for r in hot.collect()} == {1}
    assert "Exchange hashpartitioning" not in hot._jdf.queryExecution().executedPlan().toString()


def test_lookup_bisects_directory_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(m, "BLOCK_LINES", 3)
    rows = [(i, f"https://h{i % 7}.example.com/p{i // 3}", f"<p>{i}</p>") for i in range(60)]
    index = m.CaptureIndex.write(frame(spark, rows))
    assert sum(r.entries for r in index.directory.collect()) >= 20
    for url in {u for _, u, _ in rows}:
        assert sorted(r["page_id"] for r in index.lookup(url)) == sorted(i for i, u, _ in rows if u == url)
    assert index.lookup("https://absent.example.com/") == []


def test_directory_is_bisected_by_range_reads(spark, monkeypatch):
    monkeypatch.setattr(m, "BLOCK_LINES", 2)
    rows = [(i, f"https://h.example.com/p{i:04d}", "x") for i in range(600)] + [(1000 + i, "https://h.example.com/hot", str(i)) for i in range(9)]
    index = m.CaptureIndex.write(frame(spark, rows).coalesce(1))
    directory = m.Directory(*m.open_store(f"{index.root}/index"), index.ranges())
    entries = sum(r[3] for r in index.ranges())
    assert entries >= 300
    for i in (0, 123, 599):
        directory.reads = 0
        assert [int(x[1]) for x in directory.find(m.url_key(f"https://h.example.com/p{i:04d}"))] == [i]
        assert directory.reads <= 2 * entries.bit_length()
    assert sorted(int(x[1]) for x in directory.find(m.url_key("https://h.example.com/hot"))) == [*range(1000, 1009)]
    assert sorted(r.page_id for r in index.captures(frame(spark, rows[590:605])).collect()) == [*range(590, 600), *range(1000, 1009)]


def test_archives_rotate(spark, monkeypatch):
    monkeypatch.setattr(m, "ARCHIVE_BYTES", 500)
    rows = [(i, f"https://e.example/{i}", hashlib.sha256(str(i).encode()).hexdigest() * 4) for i in range(40)]
    index = m.CaptureIndex.write(frame(spark, rows).coalesce(1))
    assert index.read(frame(spark, rows)).count() == 40 and index.captures(frame(spark, rows)).select("path").distinct().count() > 5


def test_small_payloads_may_stay_responses(spark):
    got = m.CaptureIndex.write(frame(spark), min_bytes=12).read(frame(spark)).collect()
    assert {r.record_type for r in got} == {"response"}


def test_keys_sort_by_reversed_host():
    assert m.url_key("https://WWW.Example.net:443/A b?q#f") == "net,example,www)/A%20b?q"
    assert m.url_key("http://e.org:8080") == "org,e:8080)/" and m.url_key(None) == ""


def test_empty(spark):
    index = m.CaptureIndex.write(frame(spark, []))
    assert index.read(frame(spark, [])).count() == 0 and index.lookup("https://x.example/") == []
