import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from quire.llm import repeats
from tests.llm.helpers import CLASHING, DOCS, corpus, wide


def expected(rows, window=50):
    """Marks bytes window by window, from a table of all strings."""
    texts = [(r[0], (r[1] or "").encode()) for r in rows]
    least = {}
    for doc_id, text in texts:
        for i in range(len(text) - window + 1):
            s, d = text[i : i + window], repeats.LAST if doc_id is None else doc_id
            least[s] = min(d, least.get(s, d))
    out = []
    for doc_id, text in texts:
        gone = np.zeros(len(text) + 1, dtype=bool)
        for i in range(len(text) - window + 1):
            if least[text[i : i + window]] < (repeats.LAST if doc_id is None else doc_id):
                gone[i : i + window] = True
        edge = np.flatnonzero(np.diff(np.concatenate(([0], gone.view(np.int8)))))
        spans = [(int(a), int(b - a)) for a, b in zip(edge[::2], edge[1::2], strict=True)]
        out.append((doc_id, len(text), spans, bytes(b for b, g in zip(text, gone, strict=False) if not g)))
    return sorted(out, key=str)


def found(df):
    return sorted(((r.doc_id, r.n_bytes, [(s.start, s.length) for s in r.spans], bytes(r.kept)) for r in df.collect()), key=str)


def sentences(seed=5, n=120):
    """Documents cut from few passages at odd places, with copies, shared heads and tails, and multi-byte letters."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 7)))
    pool = [" ".join(word() for _ in range(60)) for _ in range(12)]
    head = "The quick brown fox jumps over the lazy dog again. "
    rows = []
    for i in range(n):
        parts = []
        for _ in range(rng.randint(0, 4)):
            p = rng.choice(pool)
            a = rng.randrange(len(p))
            parts += [p[a : a + rng.randint(1, 200)], " ".join(word() for _ in range(rng.randint(0, 30)))]
        rows.append((rng.randrange(n), (head if i % 3 == 0 else "") + " ".join(parts), "en", "s", 0))
    return rows


def test_matches_all_strings(spark):
    rows = sentences() + corpus(n=20)
    assert found(repeats.remove_repeats(spark.createDataFrame(rows, DOCS))) == expected(rows)


def test_other_sizes_and_batches(spark):
    rows = sentences(9, 60)
    for window, anchor, batches in ((24, 8, 1), (24, 24, 7)):
        assert found(repeats.remove_repeats(spark.createDataFrame(rows, DOCS), window, anchor, batches)) == expected(rows, window)


def test_periodic_and_long_texts(spark):
    rng = random.Random(2)
    long = "".join(rng.choice("abcdefgh \n") for _ in range(1_200_000))
    rows = [(3, "a" * 5000, "en", "s", 0), (1, "a" * 60, "en", "s", 0), (2, "ab" * 400, "en", "s", 0), (4, "ba" * 300 + "\0" * 120, "en", "s", 0), (5, "\0" * 60, "en", "s", 0)]
    rows += [(10, long, "en", "s", 0), (11, "x" + long[600_000:900_000], "en", "s", 0), (6, long[100:149] + "|" + long[500:550], "en", "s", 0)]
    got = {r.doc_id: r for r in repeats.remove_repeats(spark.createDataFrame(rows, DOCS)).collect()}
    want = {r[0]: r for r in expected(rows)}
    assert {k: ([(s.start, s.length) for s in r.spans], bytes(r.kept)) for k, r in got.items()} == {k: r[2:] for k, r in want.items()}


def test_query_columns_with_clashes(spark):
    rows = sentences(4, 30)
    names = CLASHING + ", file string, shard int, block int, kept string, spans int"
    got = repeats.remove_repeats(spark.createDataFrame([(*r, "f", 1, 2, "k", 3) for r in wide(rows)], names))
    assert got.columns == ["doc_id", "n_bytes", "spans", "kept"] and found(got) == expected(rows)


def test_empty_table(spark):
    assert repeats.remove_repeats(spark.createDataFrame([], DOCS)).count() == 0


def test_levels_are_merged_as_in_a_binary_counter(spark):
    family = repeats.SuffixFamily(spark)
    for i in range(5):
        texts = [f"{i} " + "".join(random.Random(j).choice("abcdefg ") for _ in range(200)) for j in range(i + 2)]
        table = spark.createDataFrame([(0, 0, "f", i, pack(texts, i))], repeats.PASSAGES)
        assert family.ingest(table).count() == 1
        assert [h for h, _ in family.levels] == [[0], [0, 0], [1, 0], [1, 0, 0], [2, 0]][i]


def pack(texts, doc_id):
    import pyarrow as pa

    one = repeats.Slice([doc_id] * len(texts), [t.encode() for t in texts], 50, 20)
    found, offset, _, least = repeats.block_passages([one], None, 50)
    return repeats.packed(text=found, offset=pa.array(offset.astype(np.uint16)), least=pa.array(least), number=pa.array(np.arange(len(found), dtype=np.int32)))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab", max_size=60), max_size=6), st.integers(4, 12), st.integers(1, 12))
def test_every_window_has_one_passage_and_its_own_anchor(texts, window, anchor):
    anchor = min(anchor, window)
    data = [t.encode() for t in texts]
    one = repeats.Slice(list(range(len(data))), data, window, anchor)
    anchors, seen = {}, set()
    begin = np.cumsum(one.lengths) - one.lengths
    for d, start, n, at in zip(one.document, one.start, one.windows, one.at, strict=True):
        for p in range(start, start + n):
            assert begin[d] <= p and p + window <= begin[d] + one.lengths[d] and p <= at <= p + window - anchor
            assert anchors.setdefault(one.data[p : p + window].tobytes(), at - p) == at - p  # of the content alone
            seen.add(p)
    assert len(seen) == sum(max(0, len(t) - window + 1) for t in data)
