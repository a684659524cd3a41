import hashlib
import zlib

import pytest

from quire.llm import manifest
from tests.llm.helpers import CLASHING, DOCS, corpus, wide


def sha(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(value) -> str:
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def expected(rows: list[tuple], fanout: int = 2) -> list[tuple]:
    """The manifest by plain recursion over whole lists."""
    leaf = lambda r, more=0: sha(*map(field, (r[0], r[3], r[2], None if r[4] is None else r[4] + more, r[1])))
    order = lambda x: (x is not None, x.encode() if isinstance(x, str) else x or 0)
    groups = {}
    for r in sorted(rows, key=lambda r: (order(r[2]), order(r[0]), leaf(r))):
        groups.setdefault(r[2], []).append(r)

    def tree(nodes: list[str]) -> list[list[str]]:
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([sha(*out[-1][i : i + fanout]) for i in range(0, len(out[-1]), fanout)])
        return out

    def path(levels: list[list[str]], i: int) -> list[tuple[list[str], list[str]]]:
        out = []
        for nodes in levels[:-1]:
            first = i // fanout * fanout
            out.append((nodes[first:i], nodes[i + 1 : first + fanout]))
            i //= fanout
        return out

    trees = [tree([leaf(r) for r in g]) for g in groups.values()]
    top = tree([t[-1][0] for t in trees])
    out = []
    for k, (group, levels) in enumerate(zip(groups.values(), trees, strict=True)):
        for i, r in enumerate(group):
            steps = path(levels, i) + path(top, k)
            at = leaf(r, 1 if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 else 0)
            for a, b in steps:
                at = sha(*a, at, *b)
            out.append((r[0], leaf(r), levels[-1][0], top[-1][0], sha(*(x for a, b in steps for x in a + b)), at, at == top[-1][0]))
    return out


COLUMNS = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def check(df, rows, fanout=2):
    assert df.columns == list(COLUMNS)
    assert sorted(map(tuple, df.collect()), key=str) == sorted(expected(rows, fanout), key=str)


ODD = [(i, f"t{i}", "en", "s", i) for i in range(70)] + [(5, "é", None, None, 3), (6, None, None, "s", None), (7, "", "", "", 0), (14, "x", "de", "s", None), (None, "n", "de", "s", 1), (8, "r", "de", "s", 1), (8, "r", "de", "s", 1), (8, "q", "de", "s", 1)]


@pytest.mark.parametrize(("fanout", "levels"), [(2, 12), (2, 1), (2, 3), (3, 2), (5, 1)])
def test_matches_recursion(spark, fanout, levels):
    check(manifest.manifest(spark.createDataFrame(ODD, DOCS), fanout, levels), ODD, fanout)


def test_odd_rows_and_clashing_columns(spark):
    rows = corpus()
    check(manifest.manifest(spark.createDataFrame(wide(rows), CLASHING)), rows)
    names = DOCS + ", leaf string, grp string, at long, n long, rank long, shown string, block int, root string"
    check(manifest.manifest(spark.createDataFrame([(*r, "x", "y", 1, 2, 3, "z", 4, "w") for r in ODD], names)), ODD)


@pytest.mark.parametrize("n", [0, 1, 2, 3])
def test_small_tables(spark, n):
    rows = [(1 + i, "a", None, None, None) for i in range(n)]
    check(manifest.manifest(spark.createDataFrame(rows, DOCS)), rows)


def test_tampered_rows_fail_and_only_they(spark):
    got = manifest.manifest(spark.createDataFrame(ODD, DOCS)).collect()
    numbers = {r[0]: r[4] for r in ODD}
    for row in got:
        hit = row.doc_id is not None and zlib.crc32(str(row.doc_id).encode()) % 7 == 0 and numbers[row.doc_id] is not None
        assert row.verified is not hit


def test_paths_survive_packing():
    path = [(b"a" * 64, b""), (b"", b"b" * 128), (b"", b""), (b"c" * 64, b"d" * 64 * 300)]
    assert manifest._unpacked(manifest._packed(path)) == path
