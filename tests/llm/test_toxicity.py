import random
import zlib

import numpy as np
import pytest

from quire.llm import toxicity as m
from tests.llm.helpers import CLASHING, DOCS, corpus, wide, words

LABELS = "doc_id long, quality int, toxic int"


def labelled(seed=1, n=900):
    """Toxic documents hold words with a stem or an insult that clean ones never hold."""
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        toxic = i % 6 == 0
        own = words(rng, rng.randint(20, 80)).split()
        if toxic:
            for _ in range(3):
                own.insert(rng.randrange(len(own)), rng.choice(["zorkab", "zorkina", "zorky", "idiot"]))
        docs.append((i, " ".join(own), "en", "s", 0))
        labels.append((i, 1, int(toxic)))
    return docs, labels


def test_held_out_accuracy_and_contract(spark):
    docs, labels = labelled()
    rows = docs + [(5000, None, None, None, None), (5001, "", "en", "s", 0), (None, "plain words", "en", "s", 0), docs[3]]
    got = m.toxicity(spark.createDataFrame(wide(rows), CLASHING), spark.createDataFrame([*labels, (None, 1, 1), (9999, 1, None), labels[0]], LABELS)).collect()
    assert len(got) == len(rows)
    truth = {i: t for i, _, t in labels}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1 if r.doc_id is not None else False)


def test_labels_of_held_out_rows_do_not_matter(spark):
    docs, labels = labelled(2, 300)
    flipped = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 3 == 1 else t) for i, q, t in labels]
    frame = spark.createDataFrame(docs, DOCS)
    a, b = ({r.doc_id: r.score for r in m.toxicity(frame, spark.createDataFrame(x, LABELS)).collect()} for x in (labels, flipped))
    assert a == pytest.approx(b)


def best(text, lexicon=None):
    return m.features(m.tokens_of(text), lexicon or m.Lexicon({}))[0]


def total(text):
    return sum(m.clause_scores(m.tokens_of(text), m.Lexicon({}))[0])


def test_context_changes_a_clause_weight():
    plain, targeted, negated, reported = best("the idiot went"), best("you are an idiot"), best("that is not an idiot"), best('the book said "idiot" twice')
    assert targeted > plain > negated and plain > reported
    assert best("i will kill you") > best("i will see you") == 0
    assert best("not. an idiot went") == plain  # negation ends with its clause
    assert best("du bist ein trottel") > best("das ist kein trottel") and best("je vais te tuer") > 0 < best("eres una basura, dijo")


@pytest.mark.parametrize(
    ("plain", "reported"),
    [
        ("you are an idiot", "he said: you are an idiot"),
        ("you idiot", "she wrote, you idiot"),
        ("you idiot, you moron", '"you idiot, you moron," he said'),
        ("you idiot. you moron", '"well. you idiot. you moron," he said'),
    ],
)
def test_reported_speech_lasts_across_clauses(plain, reported):
    assert best(reported) < best(plain) and total(reported) < total(plain)


def test_reported_speech_ends():
    assert best("he said so. you idiot") == best("you idiot")
    assert best('an open " quotation\nyou idiot') == best("you idiot")


def test_only_matched_clauses_count():
    """Words weigh by their clause: a negated and reported insult is worth nothing, and clauses without a match only lengthen the text."""
    none, both = (m.features(m.tokens_of(t), m.Lexicon({})) for t in ("a plain clause", 'this says "not idiot"'))
    assert both[:-2] == none[:-2] == [0.0] * (m.N_FEATURES - 2)
    assert best("that idiot's car") == m.SEED_WEIGHT
    one, two = (m.clause_scores(m.tokens_of(t), m.Lexicon({})) for t in ("you idiot, fine", "fine, you idiot"))
    assert one == two and one[1] == 2 and len(one[0]) == 1


def test_composed_machine_equals_its_transducers_run_apart():
    rng = random.Random(4)
    parts = (m.INSULT, m.THREAT, m.TARGET, m.NEGATION, m.REPORTED)
    for _ in range(200):
        text = [rng.choice("IVWYNRQO,./") for _ in range(rng.randint(0, 60))]
        alone = [0.0] * len(text)
        for part in parts:
            state = 0
            for i, symbol in enumerate(text):
                state, weight = part.step(state, symbol)
                alone[i] += weight
        machine, state = m.Grammar(parts), 0
        for i, symbol in enumerate(text):
            state, weight = machine.arc(state, symbol)
            assert weight == pytest.approx(alone[i])


def test_reruns_agree(spark):
    docs, labels = labelled(8, 200)
    frame, marks = spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)
    a, b = ({r.doc_id: r.score for r in m.toxicity(f, marks).collect()} for f in (frame, frame.repartition(7)))
    assert a == b


def test_stems_count_once_each_and_long_texts_are_read_to_the_end():
    assert m.stems_of("Zorkab zorkab") == {"=zorkab", "zor", "zork", "zorka", "zorkab"}
    assert best("a " * 200_000 + "idiot") == m.SEED_WEIGHT


def test_untrained_empty_and_single_class(spark):
    assert m.toxicity(spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)).collect() == []
    got = m.toxicity(spark.createDataFrame([(1, "you idiot, you moron", "en", "s", 0), (2, "fine", "en", "s", 0)], DOCS), spark.createDataFrame([(2, 1, 0)], LABELS)).collect()
    scores = {r.doc_id: r.score for r in got}
    assert scores[1] > scores[2]


def test_drop_toxic_keeps_clean_rows_and_columns(spark):
    docs, labels = labelled(3)
    frame = spark.createDataFrame(wide(docs), CLASHING)
    out = m.drop_toxic(frame, spark.createDataFrame(labels, LABELS))
    assert out.columns == frame.columns
    kept = {r.doc_id for r in out.collect()}
    clean = {i for i, _, t in labels if not t}
    assert len(clean - kept) <= 2 and len(kept - clean) <= 6


def test_corpus_with_odd_rows_is_scored_whole(spark):
    rows = corpus()
    assert m.score(spark.createDataFrame(rows, DOCS), m.untrained()).count() == len(rows)


def test_logistic_fit():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, m.N_FEATURES))
    y = (x[:, 0] > 0).astype(float)
    assert ((m.fit_logistic(x, y).score(x) > 0.5) == y).mean() > 0.97
