import hashlib
import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from quire.llm import fill_middle as fim
from tests.llm.helpers import CLASHING, DOCS, corpus, wide

UNITS = re.compile(r"[^\n]*\n|[^\n]+")


def height_ok(rope) -> bool:
    if isinstance(rope, fim.Leaf):
        return rope.n_chars == sum(map(len, rope.units)) and len(rope.units) <= fim.LEAF_UNITS
    left, right = rope.left, rope.right
    counts = rope.n_units == left.n_units + right.n_units and rope.n_chars == left.n_chars + right.n_chars
    return counts and abs(left.height - right.height) <= 2 and rope.height == max(left.height, right.height) + 1 and height_ok(left) and height_ok(right)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab\n\r é😀<", max_size=400), st.integers(0, 500), st.integers(0, 500))
def test_ropes_split_and_join(text, a, b):
    rope, units = fim.rope_of(text), UNITS.findall(text)
    assert fim.text_of(rope) == text and rope.n_units == len(units) and rope.n_chars == len(text)
    for split, items in ((fim.split_units, units), (fim.split_chars, list(text))):
        left, right = split(rope, a)
        assert fim.text_of(left) == "".join(items[:a]) and fim.text_of(right) == "".join(items[a:])
        joined = fim.concat(right, left)
        assert fim.text_of(joined) == "".join(items[a:] + items[:a]) and height_ok(joined)
    for form in ("psm", "spm"):
        n = len(units)
        out, prefix, middle = fim.rearrange(rope, a % (n + 1), b % (n + 1), form)
        i, j = sorted((a % (n + 1), b % (n + 1)))
        p, m, s = "".join(units[:i]), "".join(units[i:j]), "".join(units[j:])
        assert (prefix, middle) == (len(p), len(m))
        assert fim.text_of(out) == (f"<P>{p}<S>{s}<M>{m}" if form == "psm" else f"<S>{s}<P>{p}<M>{m}")
        assert fim.restore(fim.text_of(out), form) == text


def test_long_chains_of_edits_stay_balanced():
    rng, rope, units = random.Random(3), fim.rope_of("".join(f"{i}\n" for i in range(5000))), [f"{i}\n" for i in range(5000)]
    for _ in range(300):
        a, b = sorted((rng.randrange(5001), rng.randrange(5001)))
        head, tail = fim.split_units(rope, b)
        first, mid = fim.split_units(head, a)
        rope, units = fim.concat(fim.concat(tail, first), mid), units[b:] + units[:a] + units[a:b]
    assert fim.text_of(rope) == "".join(units) and rope.height < 40


def expected(rows):
    out = []
    for r in rows:
        text, digest = r[1] or "", hashlib.sha256(f"7:{'' if r[0] is None else r[0]}".encode()).hexdigest()
        h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
        units = UNITS.findall(text)
        n = len(units)
        a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
        p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
        form = "plain" if not text or re.search("<[PSM]>", text) else "spm" if h[3] % 100 < 50 else "psm"
        output = {"plain": text, "psm": f"<P>{p}<S>{s}<M>{m}", "spm": f"<S>{s}<P>{p}<M>{m}"}[form]
        out.append((r[0], n, form, *((None, None) if form == "plain" else (len(p), len(m))), output, text))
    return sorted(out, key=str)


ODD = [(1, "no end"), (2, "a\n\n\nb\n"), (3, "\n"), (4, "x <S> y\n"), (5, "<"), (6, "a\r\nb c\x0bd\n"), (7, "<P"), (8, "<\nP>\n<S\n>"), (9, "é😀\n" * 3000), (9, "same id"), (None, "null id\nb\n")]


def test_matches_plain_slices(spark):
    rows = corpus() + [(*r, "en", "s", 0) for r in ODD] + [(1000, "".join(f"{i} words\n" for i in range(200_000)), "en", "s", 0)]
    got = fim.transform(spark.createDataFrame(rows, DOCS)).select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output", "restored")
    assert sorted(map(tuple, got.collect()), key=str) == expected(rows)


def test_clashing_columns_and_rates(spark):
    names = CLASHING + ", form string, output long, h1 int, __quire_x int"
    rows = [(*r, "f", 1, 2, 3) for r in wide(corpus())]
    got = fim.transform(spark.createDataFrame(rows, names), fim_rate=0)
    assert got.columns == [c for c in spark.createDataFrame(rows, names).columns if c not in ("form", "output")] + ["n", "form", "prefix_chars", "middle_chars", "output", "restored"]
    assert {(r.form, r.output == (r.text or ""), r.h1, r["__quire_x"]) for r in got.collect()} == {("plain", True, 2, 3)}
    forms = {r.form for r in fim.transform(spark.createDataFrame(rows, names), spm_rate=0).select("form").collect()}
    assert forms == {"plain", "psm"}


def test_empty_table(spark):
    assert fim.transform(spark.createDataFrame([], DOCS)).count() == 0
