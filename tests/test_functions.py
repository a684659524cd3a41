"""Literal cases of the text primitives."""

import random

import pytest
from pyspark.sql import functions as F

from quire.functions import markdown as md
from quire.functions import text as tx

FENCE = "```"


def values(spark, rows, column):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, s string")
    return [r[1] for r in df.select("i", column(F.col("s")).alias("v")).orderBy("i").collect()]


@pytest.mark.parametrize(
    ("column", "cases"),
    [
        (tx.slug, {"First Steps": "first-steps", "x／y": "x-y", "?!?": "section", "CON": "section", "com7": "section", "x" * 80: "x" * 64, "Ünï cödé": "n-c-d", "①②": "12", "a" * 63 + "-b": "a" * 63}),
        (tx.humanize, {"my-file_name": "my file name", "--a--": "a", "": ""}),
        (tx.base_name, {"a/b/c.md": "c", "c.tar.gz": "c.tar", ".md": "", "a/b": "b"}),
        (tx.numeric_prefix, {"01-intro.md": 1.0, "2": 2.0, "3x": None, "x3": None, "12.md": 12.0}),
        (tx.js_trim, {"﻿ a b \n": "a b", " x　": "x", "": ""}),
        (tx.js_len, {"a😀": 3, "é": 1, "": 0}),
        (tx.truncate_word, {"short": "short", "w" * 130: "w" * 120, "a " * 80: ("a " * 60).rstrip()}),
        (tx.yaml_scalar, {'say "x"\\\n': '"say \\"x\\"\\\\\\n"'}),
        (tx.escape_link_text, {"a[b]\\": "a\\[b\\]\\\\"}),
        (tx.escape_link_target, {"a (b).md": "a%20%28b%29.md"}),
        (
            md.estimate_tokens,
            {"": 0, "abcd": 1, "abcde": 2, f"Hello\n{FENCE}\ncode\n{FENCE}": 2 + 1 + 2 + 1, f"{FENCE}js\n\n{FENCE}": 2 + 0 + 1, f"{FENCE}\nabcdefg": 1 + 3, f"a\n{FENCE}\n{FENCE}\nb": 1 + 1 + 1 + 1, "\n\n": 1, f"  {FENCE}x  ": 1},
        ),
        (
            md.first_summary,
            {
                "# Top\n\nSome words here.": "Some words here.", "": "", "- a\n- b\n\ntext\nmore": "text more", f"{FENCE}\ncode\n\nmore\n{FENCE}\n\nafter": "after", "> q\n\n| t |\n\n1. x": "",
                f"para\n{FENCE}\ncode\n{FENCE}\nrest": f"para {FENCE} rest", "#tag is prose": "#tag is prose", "  indented  \n": "indented",
            },
        ),
        (
            md.strip_mdx,
            {
                "import Y from 'y';\n\nWords": "Words", "import this is prose": "import this is prose", "export const a = 1;\nx": "x", ":::note\nbody\n:::": "**Note:**\nbody", "::::": "**::**",
                "<Tabs>\n<TabItem label=\"A\">\nx\n</TabItem>\n<TabItem label='B'>y</TabItem>\n</Tabs>": "**A:**\n\nx\n\n**B:**\n\ny", "<Card a='1' />": "[unrendered component: Card]", "<b>bold</b>": "bold", "<b></b>\nx": "\nx",
                f"{FENCE}\nimport a from 'b'\n\n\n{FENCE}\n\n\nend\n\n": f"{FENCE}\nimport a from 'b'\n\n\n{FENCE}\n\nend", "a\n\n\n\nb": "a\n\nb", "<div>\ntext\n</div>": "text", f"\n{FENCE}\nopen\n\n": f"{FENCE}\nopen\n\n",
            },
        ),
    ],
)
def test_cases(spark, column, cases):
    assert dict(zip(cases, values(spark, list(cases), column), strict=True)) == cases


def test_sections(spark):
    body = f"pre\n# One\ntext\n{FENCE}\n# not\n{FENCE}\n### Deep\n##\n####### seven\n## Two  \nend\n"
    got = values(spark, [body], md.sections)[0]
    assert [(s.level, s.name, s.body) for s in got] == [(0, None, "pre"), (1, "One", f"text\n{FENCE}\n# not\n{FENCE}"), (3, "Deep", "##\n####### seven"), (2, "Two", "end")]


def test_frontmatter(spark):
    cases = {
        "---\ntitle: Hi there\nsidebar_position: 1.5\ndraft: true\n---\nbody": ("Hi there", 1.5, True), "---\ntitle: 42\ndraft: yes\n---\n": (None, None, None), '---\ntitle: "42"\n---\n': ("42", None, None),
        "---\nsidebar:\n  label: x\n  order: -3\n---\nb": (None, -3.0, None), "---\nsidebar_position: 2\nsidebar:\n  order: 9\n---\n": (None, 2.0, None), "no block": (None, None, None),
    }
    got = values(spark, list(cases), md.frontmatter)
    assert [tuple(g) for g in got] == list(cases.values())
    assert values(spark, list(cases)[:1], md.frontmatter_body) == ["body"]


def test_nulls(spark):
    for column in (md.estimate_tokens, md.strip_mdx, tx.slug, tx.js_trim):
        assert values(spark, [None], column) == [None]


def test_a_paragraph_that_begins_with_a_line_of_hashes_is_no_prose(spark):
    df = spark.createDataFrame([("##\nnext line\n\nprose here",), ("###\nalone",), ("#tag\nis prose",)], "body string")
    assert [r[0] for r in df.select(md.first_summary(F.col("body"))).collect()] == ["prose here", "", "#tag is prose"]


def test_sections_keep_every_character_and_see_fences(spark):
    """Sections are told apart by lines; characters that once marked them inside an expression are text."""
    body = "pre﷐﷑\n ## One﷒ \nx\n```\n# code\n```\n#\n####### seven\n# Two\n"
    got = spark.createDataFrame([(body,)], "body string").select(F.inline(md.sections(F.col("body")))).collect()
    assert [tuple(r) for r in got] == [(0, 0, None, "pre﷐﷑"), (1, 2, "One﷒", "x\n```\n# code\n```\n#\n####### seven"), (2, 1, "Two", "")]


def test_records_are_parsed_once(spark):
    from quire.sources import store

    assert store._checks().count("try_parse_json") == 1
    rows = spark.createDataFrame([("{",), ("[]",), ("{}",), ('{"source":{"type":"path","path":"/d","kind":"odd"}}',)], "json string")
    failed = [r[0] for r in store.structure(rows, F.col("json"), "failed").select("failed").collect()]
    assert failed == [["unreadable"], ["unreadable"], ["types", "source_keys", "source_types", "offset"], ["types", "source_kind", "offset"]]


def test_summaries_of_long_bodies(spark):
    """What a body begins with gives the same summary as all of it, wherever the beginning is cut; and the rest isn't searched."""
    rng = random.Random(5)
    piece = lambda: rng.choice(["word " * rng.randint(1, 60), "9" * rng.randint(100, 1100) + rng.choice(["", ". x"]), "", "", " \t", FENCE, f"  {FENCE}py", "# Head", "| a |", "- item", "😀é" * rng.randint(1, 90), "1. one"])
    bodies = ["\n".join(piece() for _ in range(rng.randint(1, 40))) for _ in range(300)]
    bodies += ["x" * n + f"\n{FENCE}\ncode\n{FENCE}\nrest of it " * 40 for n in range(1015, 1030)] + [" " * n + "a b " * 90 for n in range(1000, 1030)] + ["9" * n + ". no prose\n\nprose" for n in (110, 120, 125, 1020, 1030)]
    whole = values(spark, bodies, lambda s: tx.truncate_word(F.coalesce(md.first_paragraph(s), F.lit(""))))
    assert values(spark, bodies, md.first_summary) == whole
    assert sum(len(b) > md.HEAD for b in bodies) > 200
