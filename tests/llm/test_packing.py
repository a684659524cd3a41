import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from quire.llm import packing as m
from tests.llm.helpers import CLASHING, DOCS, corpus, wide


def test_pieces_cover_every_id_once_in_full_sequences(spark):
    rows = wide(corpus())
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {}
    for r in rows:
        ids.setdefault(r[0], []).append(np.array([*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 1], dtype="<u4"))
    got = m.pack_default(spark.createDataFrame(rows, CLASHING)).collect()
    assert sum(r.length for r in got) == sum(len(x) for own in ids.values() for x in own)
    for r in got:
        assert any(len(x) == r.doc_tokens and zlib.crc32(x[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for x in ids[r.doc_id])
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= m.CAPACITY
    assert len(sequences) <= sum(r.length for r in got) / m.CAPACITY + 4


def test_added_tokens_inside_texts_get_their_ids(spark):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>\n\n y", "<|endoftext", "<|ENDOFTEXT|> é <|endoftext|>日本  ", "<|endoftext|>" + "word " * 3000 + "<|endoftext|>"]
    code = m.encoder(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    want = [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert [code.encode(t, allowed_special="all") for t in texts] == want
    got = m.pack_default(spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], DOCS)).collect()
    for r in got:
        ids = np.array([*want[r.doc_id], 1], dtype="<u4")
        assert r.doc_tokens == len(ids) and zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32


def test_very_long_words_and_blanks_are_encoded_whole(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    texts = [" " * 1_000_000, "\n" * 400_000 + "x", "ab" * 500_000, "a " + " " * 99_999 + "b", " " * 100_000, "y" + "\t " * 60_000 + "<|endoftext|>"]
    for text in texts:
        assert m.ids_of(text, path, public_tokenizers.PATTERN) == tokenizer.encode(text, add_special_tokens=False).ids
    got = m.pack_default(spark.createDataFrame([(0, texts[0], "en", "s", 0)], DOCS)).collect()
    assert sum(r.length for r in got) == 1_000_001


def test_linear_program_reaches_the_material_bound():
    rng = np.random.default_rng(1)
    counts = {int(k): int(v) for k, v in zip(*np.unique(rng.integers(1, 65, 3000), return_counts=True), strict=True)}
    plan = m.plan_patterns(counts, 64)
    assert all(sum(k * n for k, n in p.items()) <= 64 for p, _ in plan)
    held = {k: sum(p.get(k, 0) * t for p, t in plan) for k in counts}
    assert all(held[k] >= n for k, n in counts.items())
    assert sum(t for _, t in plan) <= 1.03 * sum(k * n for k, n in counts.items()) / 64 + 2


def test_knapsack_prices_exactly():
    value, pattern = m.price(np.array([0.3, 0.5, 0.61]), np.array([3, 5, 6]), 11)
    assert round(value, 9) == 1.11 and pattern.tolist() == [0, 1, 1]


def test_empty(spark):
    assert m.pack_default(spark.createDataFrame([], DOCS)).collect() == []
