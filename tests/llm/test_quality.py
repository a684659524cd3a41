import random
import zlib

import numpy as np

from quire.llm import quality as m
from tests.llm.helpers import CLASHING, DOCS, corpus, wide, words

LABELS = "doc_id long, quality int, toxic int"


def labelled(seed=1, n=1200):
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        good = i % 5 > 0
        text = words(rng, rng.randint(30, 120)).capitalize() + "."
        if not good:
            text = rng.choice([lambda t: t.upper().replace(" ", "!! "), lambda t: t.replace(" ", "### "), lambda t: (t.split()[0] + " ") * 60, lambda t: t.replace(" ", " | ")])(text)
        docs.append((i, text, "en", "s", 0))
        if i % 2:
            labels.append((i, int(good), 0))
    return docs, labels


def test_held_out_accuracy_and_contract(spark):
    docs, labels = labelled()
    rows = docs + [(5000, None, None, None, None), (5001, "", "en", "s", 0), (None, "Plain words.", "en", "s", 0), docs[3]]
    got = m.quality(spark.createDataFrame(wide(rows), CLASHING), spark.createDataFrame([*labels, (None, 1, 0), (9999, None, 0), labels[0]], LABELS)).collect()
    assert len(got) == len(rows)
    truth = {i: q for i, q, _ in labels}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.95 * len(held)
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2 if r.doc_id is not None else False)


def test_negatives_are_not_used(spark):
    docs, labels = labelled(2, 400)
    frame = spark.createDataFrame(docs, DOCS)
    a, b = ({r.doc_id: round(r.score, 9) for r in m.quality(frame, spark.createDataFrame(x, LABELS)).collect()} for x in (labels, [r for r in labels if r[1]]))
    assert a == b


def test_class_prior_of_a_mixture():
    rng = np.random.default_rng(0)
    positive = rng.normal(2, 1, 4000)
    for share in (0.3, 0.6, 0.9):
        u = np.concatenate([rng.normal(2, 1, int(8000 * share)), rng.normal(-4, 1, int(8000 * (1 - share)))])
        passed = (u >= m.thresholds(positive)[:, None]).sum(axis=1)
        assert abs(m.class_prior(positive, passed, len(u)) - share) < 0.06


def test_counts_cover_all_rows_and_reruns_agree(spark):
    docs, labels = labelled(3, 300)
    frame = spark.createDataFrame(docs, DOCS)
    rows = m.described(frame)
    x = np.array([m.statistics(t) for _, t, *_ in docs])
    mean, scale = m.moments(rows)
    assert np.allclose(mean, x.mean(axis=0), rtol=1e-6) and np.allclose(scale, np.maximum(x.std(axis=0), 1e-3), rtol=1e-6)
    bounds = np.quantile(x[:, 0], [0.1, 0.5, 0.9])
    passed, n = m.passing(rows.repartition(5), lambda v: v[:, 0], bounds)
    assert n == 300 and passed.tolist() == (x[:, 0] >= bounds[:, None]).sum(axis=1).tolist()
    marks = spark.createDataFrame(labels, LABELS)
    a, b = ({r.doc_id: r.score for r in m.quality(f, marks).collect()} for f in (frame, frame.repartition(7)))
    assert a == b


def test_without_positives_and_empty(spark):
    got = m.quality(spark.createDataFrame(corpus(), DOCS), spark.createDataFrame([(1, 0, 0)], LABELS)).collect()
    assert {r.score for r in got} == {0.5} and len(got) == len(corpus())
    assert m.quality(spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)).collect() == []


def test_statistics_of_odd_texts():
    for text in (None, "", " \n", "a", "\n\n", "x" * 100_000, "é ß 日本"):
        assert len(m.statistics(text)) == m.N_FEATURES and np.isfinite(m.statistics(text)).all()
