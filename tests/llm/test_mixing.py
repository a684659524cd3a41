import hashlib
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from quire.llm import mixing as m
from tests.llm.helpers import CLASHING, DOCS, corpus, wide


def brute(rows):
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    clamped, left, free = {}, 1.5 * sum(sizes.values()), float(sum(weight.values()))
    while True:
        new = {s for s in names if s not in clamped and left * weight[s] / free > 2 * sizes[s]} if free else set()
        if not new:
            break
        clamped |= {s: 2 * sizes[s] for s in new}
        left, free = 1.5 * sum(sizes.values()) - sum(clamped.values()), float(sum(weight[s] for s in names if s not in clamped))
    targets = {s: clamped.get(s, left * weight[s] / free if free else 0) for s in names}
    return sizes, targets


def test_targets_and_takes(spark):
    rows = corpus()
    sizes, targets = brute(rows)
    got = m.mix(spark.createDataFrame(rows, DOCS)).collect()
    assert len(got) == len(rows)
    taken, largest = defaultdict(int), defaultdict(int)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(targets[r.source])
        assert 0 <= r.taken <= 2 * r["size"]
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r["size"])
    for s, t in targets.items():
        assert abs(taken[s] - t) <= largest[s]


def test_reruns_agree_and_ranges_do_not_matter(spark, monkeypatch):
    docs = spark.createDataFrame(corpus(4), DOCS)
    first = sorted(map(tuple, m.mix(docs).collect()), key=str)
    monkeypatch.setattr("quire.llm._ranks.BUCKET_ROWS", 3)
    monkeypatch.setattr("quire.llm._ranks.FAN_OUT", 2)
    assert sorted(map(tuple, m.mix(docs.repartition(7)).collect()), key=str) == first


def test_hash_is_md5():
    assert int(hashlib.md5(f"{m.SEED}:5".encode()).hexdigest()[:8], 16) >= 0


def test_repeat_gives_rows_as_often_as_planned(spark):
    docs = spark.createDataFrame(wide(corpus()), CLASHING)
    plan = {(r.doc_id, r.source, r["size"]): r.n for r in m.mix(docs).groupBy("doc_id", "source", "size").agg(F.sum("times").alias("n")).collect() if r.n}
    out = m.repeat(docs)
    assert out.columns == docs.columns
    size = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(m.WORD)).alias("words")
    assert {(r.doc_id, r.source, r.words): r["count"] for r in out.groupBy("doc_id", "source", size).count().collect()} == plan


def test_repeated_rows_share_their_copies(spark):
    docs = spark.createDataFrame([(1, "a b c", "en", "s", 0)] * 9 + [(2, "d e", "en", "t", 0)], DOCS).repartition(3)
    plan = m.mix(docs).groupBy("doc_id").agg(F.sum("times").alias("n")).collect()
    assert {r.doc_id: r.n for r in plan} == {r.doc_id: r["count"] for r in m.repeat(docs).groupBy("doc_id").count().collect()}


def test_empty_and_wordless(spark):
    assert m.mix(spark.createDataFrame([], DOCS)).collect() == []
    got = m.mix(spark.createDataFrame([(1, None, "en", "a", 0), (2, "", "en", None, 0)], DOCS)).collect()
    assert {(r["size"], r.target, r.taken) for r in got} == {(0, 0.0, 0)}
