import random
import re

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns whose names clash with what operators call their own.
CLASHING = DOCS + ", score double, label int, rank long, _n int, fp long, key string, size long, digest string, _held string, _block int, _bit int, _part int, _here int, _hot int, _base int, _p int, _k0 int"


def words(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n))


def corpus(seed: int = 1, n: int = 60) -> list[tuple]:
    """Rows with nulls, blanks, copies that differ in white space, near copies, a long text and repeated rows."""
    rng = random.Random(seed)
    rows = [(i, words(rng, rng.randint(1, 120)), "en", f"s{i % 4}", 0) for i in range(n)]
    rows += [(n + i, re.sub(" ", rng.choice(["  ", "\t", "\n"]), rows[i % 7][1]), "en", "s0", 0) for i in range(20)]
    base = words(rng, 300)
    rows += [(200 + i, base + " " + words(rng, 1), "en", "s1", 0) for i in range(30)]
    rows += [(300, None, None, None, None), (301, "", "en", "s2", 0), (302, " \n\t", "en", None, 0), (None, "alone", "en", "s3", 0), (None, rows[0][1], "en", "s3", 0)]
    rows += [(400, words(rng, 30_000), "en", "s2", 0), rows[3], rows[3], (401, "ÄÖ é  日本 ", "de", "s1", 0), (402, "x y z\x1c", "de", "s1", 0)]
    return rows


def wide(rows: list[tuple]) -> list[tuple]:
    return [(*r, 0.5, 1, 7, 3, 9, "k", 11, "d", "held", 1, 2, 3, 4, 5, 6, 7, 8) for r in rows]
