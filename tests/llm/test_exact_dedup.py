import hashlib
import re

from pyspark.sql import functions as F

from quire.llm import exact_dedup as m
from tests.llm.helpers import CLASHING, DOCS, corpus, wide


def brute(rows):
    groups = {}
    for row in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", row[1] or ""), []).append(row)
    out = []
    for text, own in groups.items():
        order = sorted(own, key=lambda r: (-len(r[1] or ""), r[0] is None, r[0] or 0))
        out += [(r[0], order[0][0], len(own), i == 0, hashlib.sha256(text.encode()).hexdigest()) for i, r in enumerate(order)]
    return out


def test_matches_brute_force(spark):
    rows = corpus()
    got = m.exact_groups(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(brute(rows), key=str)


def test_colliding_digests_are_split_by_bytes(spark):
    rows = corpus(2)
    docs = spark.createDataFrame(rows, DOCS)
    index = m.LsmDedupIndex(spark, digest=lambda text: F.substring(F.sha2(text, 256), 1, 1))
    index.ingest(docs)
    got = [tuple(r) for r in index.groups(docs).collect()]
    assert sorted(got, key=str) == sorted(brute(rows), key=str)


def test_splitting_keeps_one_of_repeated_rows(spark):
    index = m.LsmDedupIndex(spark, digest=lambda text: F.lit("same"))
    docs = spark.createDataFrame([(1, "aa", "en", "s", 0), (1, "aa", "en", "s", 0), (2, "b", "en", "s", 0)], DOCS)
    index.ingest(docs)
    assert sorted((r.doc_id, r.group_size, r.kept) for r in index.groups(docs).collect()) == [(1, 2, False), (1, 2, True), (2, 1, True)]


def test_runs_of_several_batches_compact_to_one_level(spark):
    rows = corpus(3)
    docs = spark.createDataFrame(rows, DOCS)
    index = m.LsmDedupIndex(spark)
    for part in range(3):
        index.ingest(docs.filter(F.coalesce(F.col("doc_id"), F.lit(0)) % 3 == part))
        if part < 2:
            index.compact()  # the next one merges this level with one run
    got = [tuple(r) for r in index.groups(docs).collect()]
    assert sorted(got, key=str) == sorted(brute(rows), key=str)


def test_runs_meet_the_level_through_filters(spark):
    """Entries that no filter holds are appended, the others merged; no digest is in two parts."""
    rows = corpus(4)
    docs = spark.createDataFrame(rows, DOCS).repartition(6)
    index = m.LsmDedupIndex(spark)
    first = F.coalesce(F.col("doc_id"), F.lit(0)) % 2 == 0
    index.ingest(docs.filter(first), 2)
    index.compact()
    index.ingest(docs.filter(~first), 3)
    assert len(index.waiting) == 3 and len(index.parts) == 1
    index.compact()  # all that wait in one pass
    assert not index.waiting and len(index.runs) == 5
    parts = {p.rsplit("-", 1)[1]: spark.read.schema(m.ENTRIES).parquet(p) for p in index.parts}
    assert set(parts) == {"rest", "merged", "fresh"} and parts["fresh"].count() and parts["merged"].count()
    level = index.compacted()
    assert level.count() == level.select("digest").distinct().count() and level.agg(F.sum("members")).first()[0] == len(rows)
    assert sorted(map(tuple, index.groups(docs).collect()), key=str) == sorted(brute(rows), key=str)
    probed = m.Filter(level, level.count()).probe(spark.createDataFrame([(f"{i:064x}",) for i in range(500)], "digest string"))
    assert probed.filter("__quire_held").count() < 100 and m.Filter(level, level.count()).probe(level).filter("NOT __quire_held").count() == 0


def test_hot_digests_are_broadcast_and_others_joined(spark, monkeypatch):
    monkeypatch.setattr(m, "HEADS", 8)
    rows = [(i, "hot text", "en", "s", 0) for i in range(50)] + [(100 + i, f"pair {i // 2}", "en", "s", 0) for i in range(20)] + [(200, "alone", "en", "s", 0)]
    got = m.exact_groups(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(brute(rows), key=str)


def test_drop_copies_keeps_one_row_a_group_and_all_columns(spark):
    rows = wide(corpus())
    docs = spark.createDataFrame(rows, CLASHING)
    out = m.drop_copies(docs)
    assert out.columns == docs.columns
    texts = [re.sub(r"[\x20\x09-\x0D]", "", r.text or "") for r in out.collect()]
    assert len(texts) == len(set(texts)) == len({re.sub(r"[\x20\x09-\x0D]", "", r[1] or "") for r in rows})
    kept = {(r[0], r[4]) for r in brute(rows) if r[3]}
    assert {(r.doc_id, hashlib.sha256(re.sub(r"[\x20\x09-\x0D]", "", r.text or "").encode()).hexdigest()) for r in out.collect()} == kept


def test_empty(spark):
    assert m.exact_groups(spark.createDataFrame([], DOCS)).collect() == []
