import random
import re

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from quire.llm import simhash as m
from tests.llm.helpers import CLASHING, DOCS, corpus, wide, words


def brute_fingerprint(text):
    low = re.sub("[A-Z]", lambda c: c[0].lower(), text or "")
    own = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not own:
        return 0
    shingles = [" ".join(own[i : i + 3]) for i in range(max(1, len(own) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_long_texts_count_every_shingle():
    for seed in range(8):
        text = words(random.Random(seed), m.BLOCK + 2 + seed * 600)  # from one block to the next, and beyond
        assert m.fingerprint(text) == brute_fingerprint(text)


def brute_components(fps):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(fps):
        for j in range(i):
            if (a ^ fps[j]).bit_count() <= 2:
                root[find(i)] = find(j)
    return [find(i) for i in range(len(fps))]


def check(spark, rows):
    got = m.groups(spark.createDataFrame(rows, DOCS)).collect()
    fps = [brute_fingerprint(r[1]) for r in rows]
    comp = brute_components(fps)
    least = {}
    for row, c in zip(rows, comp, strict=True):
        ids = [x for x in (least.get(c), row[0]) if x is not None]
        least[c] = min(ids, default=None)
    want = sorted(((r[0], f"{f:016x}", least[c]) for r, f, c in zip(rows, fps, comp, strict=True)), key=str)
    assert sorted(((r.doc_id, f"{r.fp & (2**64 - 1):016x}", r.component_id) for r in got), key=str) == want


def test_matches_brute_force(spark):
    check(spark, corpus())


def test_large_ball_of_near_copies_splits_and_stays_whole(spark, monkeypatch):
    monkeypatch.setattr(m, "SPLIT", 40)
    rng = random.Random(5)
    base = words(rng, 60).split()
    rows = []
    for i in range(400):
        own = list(base)
        own[rng.randrange(60)] = words(rng, 1)
        rows.append((i, " ".join(own), "en", "s", 0))
    check(spark, rows)


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2**64 - 1), st.lists(st.integers(0, 63), min_size=0, max_size=2, unique=True))
def test_every_link_passes_the_chains_from_some_segment(a, bits):
    x = np.array([sum(1 << b for b in bits)], dtype=np.uint64)
    assert any(m._passes(x, np.array([s]))[0] for s in range(m.SEGMENTS))


def test_both_ways_through_a_bucket_find_the_same(monkeypatch):
    rng = np.random.default_rng(0)
    core = int(rng.integers(0, 2**62))
    fps = np.unique(np.array([core ^ sum(1 << int(b) for b in rng.choice(np.arange(26, 64), 3, replace=False)) for _ in range(400)], dtype=np.uint64))
    keys, starts = np.zeros(len(fps), dtype=np.int64), np.zeros(len(fps), dtype=np.int64)
    pairs = set(zip(*(x.tolist() for x in m._bucket_edges(keys, starts, fps)), strict=True))
    monkeypatch.setattr(m, "PAIRWISE", 10)
    flips = set(zip(*(x.tolist() for x in m._bucket_edges(keys, starts, fps)), strict=True))
    assert {frozenset(p) for p in pairs} == {frozenset(p) for p in flips} and pairs


def test_one_per_group(spark):
    docs = spark.createDataFrame(wide(corpus()), CLASHING)
    out = m.one_per_group(docs)
    assert out.columns == docs.columns
    want = m.groups(docs).select("root").distinct().count()
    assert out.count() == want


def test_empty(spark):
    assert m.near_groups(spark.createDataFrame([], DOCS)).collect() == []
