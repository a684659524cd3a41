import math
import random

import numpy as np
from pyspark.sql import functions as F

from quire.llm import topk as m

SCHEMA = "vec_id long, embedding array<float>, label int, score long, dim int"


def brute(rows, k=20):
    own = []
    for at, (i, v, *_) in enumerate(rows):
        if v and all(x is not None and math.isfinite(x) for x in v):
            own.append((at, i, [math.floor(64 * float(np.float32(x))) for x in v]))
    out = []
    for at, i, q in own:
        if i is not None and i % 20 == 0:
            scored = [(-sum(a * b for a, b in zip(q, v, strict=True)), j is None, j or 0, j) for b, j, v in own if b != at and len(v) == len(q)]
            out += [(i, n, j, -s) for n, (s, _, _, j) in enumerate(sorted(scored)[:k], 1)]
    return out


def test_matches_brute_force(spark):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 0.2) for _ in range(8)], 0, 0, 0) for i in range(130)]
    rows += [(1000 + i, rows[20][1], 0, 0, 0) for i in range(60)]  # ties
    rows += [(40, rows[5][1], 0, 0, 0), (None, rows[6][1], 0, 0, 0), (60, None, 0, 0, 0), (80, [None] * 8, 0, 0, 0), (100, [float("nan")] * 8, 0, 0, 0), (120, [float("inf")] * 8, 0, 0, 0)]
    rows += [(140 + 20 * i, [0.5, -0.25, 1.0], 0, 0, 0) for i in range(3)] + [(160, [], 0, 0, 0)]
    got = m.search(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 20 == 0).collect()
    assert sorted(map(tuple, got), key=str) == sorted(brute(rows), key=str)


def test_sums_of_slices_are_exact():
    rng = np.random.default_rng(0)
    rows = rng.integers(-50, 50, (300, 12))
    index = m.BitSlicedIndex(rows)
    for _ in range(20):
        q = rng.integers(-40, 40, 12)
        sums = sum((np.unpackbits(b.view(np.uint8), bitorder="little")[:300].astype(np.int64) << i for i, b in enumerate(index.add(q))), np.zeros(300, dtype=np.int64))
        assert len(set((sums - rows @ q).tolist())) == 1
        best = index.top(q, 7, skip=3)
        order = sorted((i for i in range(300) if i != 3), key=lambda i: (-int(rows[i] @ q), i))[:7]
        assert sorted(best.tolist()) == sorted(order)


def test_empty(spark):
    assert m.search(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 20 == 0).collect() == []


def test_an_index_is_built_once_for_each_row_block(spark, monkeypatch):
    """Blocks of rows and of queries are written once each, however many pairs of them are searched."""
    monkeypatch.setattr(m, "BLOCK", 16)
    monkeypatch.setattr(m, "QUERY_BLOCK", 2)
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=4)]) for i in range(90)]
    made = []
    write = m.write_index
    monkeypatch.setattr(m, "write_index", lambda *a: made.append(write(*a)) or made[-1])
    got = m.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 5 == 0, 3).collect()
    index, asked = (x.collect() for x in made)
    assert len(index) == len({r.block for r in index}) == 6 and len(asked) == len({r.block for r in asked}) > 5
    v = {i: np.floor(64 * np.array(x)).astype(int) for i, x in rows}
    for q in range(0, 90, 5):
        want = sorted(((-int(v[q] @ v[i]), i) for i in v if i != q))[:3]
        assert [(-r.score, r.vec_id) for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q] == want


def test_candidates_do_not_grow_with_the_row_blocks_of_a_task(spark, monkeypatch):
    """A task yields k rows a query, whether its row blocks are one or many; ties across blocks go to the smaller id."""
    rng = np.random.default_rng(5)
    rows = rng.integers(-9, 9, (64, 4))
    rows[40:] = rows[:24]
    root = m.shared_path(spark, "slices")
    frame = spark.createDataFrame([(i, bool(i % 8 == 0), [int(x) for x in v], i, 4) for i, v in enumerate(rows)], "vec_id long, is_query boolean, v array<long>, row_no long, dim int")
    index, asked = m.write_index(frame, root, 8, True).collect(), m.write_index(frame.filter("is_query"), root, 100, False).collect()
    assert len(index) > 4 and len(asked) == 1
    batch = m.pa.RecordBatch.from_arrays([m.pa.array([r.file for r in index]), m.pa.array([asked[0].file] * len(index)), m.pa.array(["0"] * len(index))], names=["rows", "queries", "part"])
    found = [r for b in m._search(root, 5)(iter([batch])) for r in b.to_pylist()]
    assert len(found) == 8 * 5
    for q in range(0, 64, 8):
        want = sorted((-int(rows[q] @ rows[i]), i) for i in range(64) if i != q)[:5]
        assert sorted((-r["score"], r["vec_id"]) for r in found if r["query_id"] == q) == want


def test_bounds_hold():
    rng = np.random.default_rng(1)
    rows, queries = rng.integers(-50, 50, (100, 6)), rng.integers(-50, 50, (9, 6))
    assert (np.array(m.BitSlicedIndex(rows).bounds(queries)) >= (rows @ queries.T).max(axis=0)).all()
