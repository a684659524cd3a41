"""Markdown analysis of whole bodies, row by row in the JVM.

Three backticks at the start of a trimmed line toggle a fence. A body is therefore split at its fence
lines: parts with even index are prose, odd ones are code. That takes no window and no shuffle; work is
linear in the text. U+FDD3 to U+FDD5 (noncharacters) serve as marks inside expressions.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions.arrays import bound, folded
from quire.functions.text import WS_CHARS, WS_LINE, js_len, js_trim, truncate_word

FENCE_LINE = f"(?:^|\\n)[{WS_LINE}]*```[^\\n]*(?=\\n|\\z)"
NEXT_FENCE = f"\\n[{WS_LINE}]*```[^\\n]*"  # the same in a text behind a line feed
HEADING = f"^#{{1,6}}[{WS_LINE}]+[^{WS_LINE}]"  # of a line without white space before it
NON_PROSE = "^(?:#{1,6}(?:[ \\t\\n]|\\z)|[|>]|[-*+][ \\t]|[0-9]+\\.[ \\t]|```)"  # of a paragraph: a line of hashes alone ends with its line
SUMMARY, HEAD = 120, 1024  # characters of a summary; those of a body that it is looked for in first
EMPTY, BREAK = "﷓", "﷔"


def prose_and_code(body: Column) -> Column:
    """Text between fence lines; all but the first part begin with a line feed unless empty."""
    return F.split(body, FENCE_LINE, -1)


def fence_lines(body: Column) -> Column:
    return F.regexp_extract_all(body, F.lit(FENCE_LINE), F.lit(0))


def _pieces(body: Column) -> Column:
    """array<struct<p, f, o>>: a part, the fence line after it and the one before it.

    Zipped up front: inside a lambda the fence lines would be searched again for every part."""
    fences = fence_lines(body)
    return F.arrays_zip(prose_and_code(body).alias("p"), fences.alias("f"), F.concat(F.array(F.lit("")), fences).alias("o"))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + x)


def estimate_tokens(body: Column) -> Column:
    """Four characters a token in prose, three in code, rounded up for each part and each fence line."""
    behind = F.concat(F.lit("\n"), body)
    part = lambda p, i: F.when(p == "", F.lit(0)).otherwise(F.ceil((js_len(p) - 1) / F.when(i % 2 == 0, 4).otherwise(3))).cast("long")
    fences = F.transform(F.regexp_extract_all(behind, F.lit(NEXT_FENCE), F.lit(0)), lambda f: F.ceil(js_len(js_trim(f)) / 4).cast("long"))
    fenced = _sum(F.transform(F.split(behind, NEXT_FENCE, -1), part)) + _sum(fences)
    return F.when(F.contains(body, F.lit("```")), fenced).otherwise(F.ceil(js_len(body) / 4).cast("long"))


def without_code(body: Column) -> Column:
    """Prose and the lines that open fences."""
    keep = lambda z, i: F.when(i % 2 == 0, F.concat(z["p"], F.coalesce(z["f"], F.lit("")))).otherwise("")
    return F.when(F.contains(body, F.lit("```")), F.array_join(F.transform(_pieces(body), keep), "")).otherwise(body)


def collapse_blanks(text: Column) -> Column:
    """Runs of blank lines as one, none at the ends."""
    return F.regexp_replace(F.regexp_replace(text, "\\n{2,}", "\n\n"), "^\\n+|\\n+\\z", "")


def first_paragraph(body: Column) -> Column:
    """The first prose paragraph on one line; null without one."""
    lines = F.transform(F.split(without_code(body), "\\n", -1), js_trim)
    paragraphs = F.split(F.regexp_replace(F.array_join(lines, "\n"), "^\\n+|\\n+\\z", ""), "\\n{2,}", -1)
    prose = F.filter(paragraphs, lambda p: (p != "") & ~p.rlike(NON_PROSE))
    return F.replace(F.get(prose, F.lit(0)), F.lit("\n"), F.lit(" "))


def first_summary(body: Column) -> Column:
    """The first prose paragraph, cut at a word near 120 characters.

    A body's first ``HEAD`` characters decide if the paragraph that they give is long enough: all before it is whole, and what is cut off is its end.
    Only one that begins with many digits may be no prose (an item of a list) for what comes later."""
    long = lambda p: (F.length(p) > SUMMARY + 2) & ~p.rlike(f"^[0-9]{{{SUMMARY - 1}}}")
    whole = lambda p: F.when((F.length(body) <= HEAD) | long(p), p).otherwise(first_paragraph(body))
    paragraph = bound(first_paragraph(F.substring(body, 1, HEAD)), whole)
    return F.coalesce(bound(paragraph, lambda p: truncate_word(p, SUMMARY)), F.lit(""))


def sections(body: Column) -> Column:
    """array<struct<ord, level, name, body>>; ord 0 is the preamble (level 0), headings count from 1.

    Lines are told apart by their first characters; a fold over the few that open or close a fence or look like headings leaves the headings."""
    return bound(F.split(body, "\n", -1), lambda lines: bound(_heading_lines(lines), lambda heads: _between(lines, heads)))


def outline(body: Column) -> Column:
    """array<struct<ord, level, name>>: the headings of ``sections`` without the texts below them."""

    def heads(lines: Column) -> Column:
        return F.transform(_heading_lines(lines), lambda h, i: F.struct((i + 1).cast("int").alias("ord"), h["level"].alias("level"), _heading_name(F.get(lines, h["at"])).alias("name")))

    return bound(F.split(body, "\n", -1), heads)


def _heading_name(line: Column) -> Column:
    return js_trim(F.ltrim(F.ltrim(line, F.lit(WS_CHARS)), F.lit("#")))


def _heading_lines(lines: Column) -> Column:
    """array<struct<at, level>>: the heading lines outside fences (from 0), in order; a level 0 marks fence lines meanwhile."""

    def mark(line: Column, i: Column) -> Column:
        level = lambda t: F.length(t) - F.length(F.ltrim(t, F.lit("#")))
        told = lambda t: F.when(F.startswith(t, F.lit("```")), F.struct(i.alias("at"), F.lit(0).alias("level"))).when(F.startswith(t, F.lit("#")) & t.rlike(HEADING), F.struct(i.alias("at"), level(t).alias("level")))
        return bound(F.ltrim(line, F.lit(WS_CHARS)), told)

    def step(inside: Column, own: Column) -> tuple[Column, Column]:
        fence = own["level"] == 0
        return F.when(~fence & ~inside, own), F.when(fence, ~inside).otherwise(inside)

    return F.filter(folded(F.filter(F.transform(lines, mark), lambda m: m.isNotNull()), F.lit(False), step), lambda m: m.isNotNull())


def _between(lines: Column, heads: Column) -> Column:
    """The sections that begin at heading lines, and the preamble."""
    begins = F.concat(F.array(F.struct(F.lit(-1).alias("at"), F.lit(0).alias("level"))), heads)
    ends = F.concat(F.transform(heads, lambda h: h["at"]), F.array(F.size(lines)))

    def section(z: Column, i: Column) -> Column:
        name = _heading_name(F.get(lines, z["b"]["at"]))
        own = F.slice(lines, z["b"]["at"] + 2, z["e"] - z["b"]["at"] - 1)
        return F.struct(i.cast("int").alias("ord"), z["b"]["level"].alias("level"), F.when(i > 0, name).alias("name"), js_trim(F.array_join(own, "\n")).alias("body"))

    return F.transform(F.arrays_zip(begins.alias("b"), ends.alias("e")), section)


def _label(attributes: Column) -> Column:
    pattern = "label=[\"']([^\"']*)[\"']"
    return F.when(attributes.rlike(pattern), F.regexp_extract(attributes, pattern, 1))


def _plain_line(line: Column, t: Column) -> Column:
    """A prose line (and its trimmed form) without component syntax: null drops it, '' is a pending blank, EMPTY an empty line of content."""
    tag = "[A-Za-z][A-Za-z0-9_.-]*"
    said = lambda c: F.when(c == "", EMPTY).otherwise(c)
    admonition = js_trim(F.regexp_extract(t, "^:::(.*)\\z", 1))
    inline, opened = "^<TabItem\\b([^>]*)>(.*)</TabItem>\\z", "^<TabItem\\b([^>]*)>\\z"
    label_in, label_open = _label(F.regexp_extract(t, inline, 1)), _label(F.regexp_extract(t, opened, 1))
    bold = lambda c: F.concat(F.lit("**"), c, F.lit(":**"))
    pair = f"^<({tag})(?:\\s[^>]*)?>(.*)</\\1>\\z"
    return (
        F.when(t == "", "")
        .when(~F.substring(t, 1, 1).isin("<", ":", "i", "e"), line)
        .when(t.rlike("^import\\s.*['\"]") | t.rlike("^export\\s+(?:default|const|let|var|function|async|class|\\{)") | (t == ":::"), F.lit(None))
        .when(t.rlike("^:::\\S"), bold(F.concat(F.upper(F.substring(admonition, 1, 1)), F.substring(admonition, 2, 1 << 30))))
        .when(t.rlike(inline), F.concat(F.when(label_in.isNotNull(), F.concat(bold(label_in), F.lit("\n\n"))).otherwise(""), said(F.regexp_extract(t, inline, 2)), F.lit("\n")))
        .when(t.rlike(opened), F.concat(bold(label_open), F.lit("\n")))
        .when(t == "</TabItem>", "")
        .when(t.rlike(f"^<{tag}(?:\\s[^>]*)?/>\\z"), F.concat(F.lit("[unrendered component: "), F.regexp_extract(t, f"^<({tag})", 1), F.lit("]")))
        .when(t.rlike(pair), said(F.regexp_extract(t, pair, 2)))
        .when(t.rlike(f"^<{tag}(?:\\s[^>]*)?(?<!/)>\\z") | t.rlike(f"^</{tag}>\\z"), F.lit(None))
        .otherwise(line)
    )


def strip_mdx(body: Column) -> Column:
    """Plain Markdown: imports, exports and tags go, admonitions and tabs become labels, blank runs one blank.

    Every fenced region is one line of content meanwhile, its line feeds hidden as BREAK."""
    broken = lambda c: F.replace(c, F.lit("\n"), F.lit(BREAK))
    code = lambda z: F.concat(broken(F.regexp_replace(z["o"], "^\\n", "")), broken(z["p"]), broken(F.coalesce(z["f"], F.lit(""))))

    def lines(z: Column, i: Column) -> Column:
        own = F.split(F.when(i == 0, z["p"]).otherwise(F.regexp_replace(z["p"], "^\\n", "")), "\\n", -1)
        trimmed = F.transform(own, lambda line: F.struct(line.alias("line"), js_trim(line).alias("t")))
        return F.transform(trimmed, lambda x: _plain_line(x["line"], x["t"]))

    none = F.array().cast("array<string>")
    parts = F.transform(_pieces(body), lambda z, i: F.when(i % 2 == 1, F.array(code(z))).when(z["p"] == "", none).otherwise(lines(z, i)))
    kept = F.filter(F.flatten(parts), lambda x: x.isNotNull())
    joined = collapse_blanks(F.array_join(kept, "\n"))
    return F.replace(F.replace(joined, F.lit(BREAK), F.lit("\n")), F.lit(EMPTY), F.lit(""))


#: A block begins a document, behind a byte order mark at most, and ends at the next line of three dashes or with the document.
BLOCK = "(?s)^\uFEFF?---[ \\t]*\\r?(?=\\n|\\z)(.*?)(?:\\n---|\\z)(?:\\r?\\n)?"
_KEY, _PLAIN = "[A-Za-z_][A-Za-z0-9_-]*", "(?:[A-Za-z][A-Za-z0-9_ ./()+-]*|-?(?:0|[1-9][0-9]*)(?:\\.[0-9]+)?)"
FLAT = f"^(?:\\r?\\n(?:[ \\t]*|#[^\\n]*|{_KEY}:(?:[ \\t]+{_PLAIN})?[ \\t]*))*\\r?\\z"


def frontmatter_block(raw: Column) -> Column:
    """The YAML block of a document, without its delimiter lines; '' without one."""
    return F.regexp_extract(raw, BLOCK, 1)


def flat_block(block: Column) -> Column:
    """Whether a block surely holds plain scalars by unindented keys only, which ``frontmatter`` reads."""
    return (block == "") | block.rlike(FLAT)


def _field(block: Column, key: str) -> Column:
    value = F.regexp_extract(F.concat(F.lit("\n"), block), f"\\n{key}:[ \\t]*([^\\n]*)", 1)
    quoted = value.rlike("^[ \\t]*[\"']")  # a mark of comments inside quotes is text
    return js_trim(F.when(quoted, F.regexp_replace(value, "^([ \\t]*(?:\"(?:[^\"\\\\]|\\\\.)*\"|'(?:[^']|'')*')).*\\z", "$1")).otherwise(F.regexp_replace(value, "(?:^|[ \\t])#[^\\n]*\\z", "")))


def frontmatter(raw: Column) -> Column:
    """struct<title, sidebar_position, draft> of flat blocks; a value of another type counts as absent.

    Nested ``sidebar: order:`` serves where there is no direct position. ``quire.sources.files.any_frontmatter`` reads flat
    blocks with this and others as YAML."""
    block = frontmatter_block(raw)
    title, position, draft = _field(block, "title"), _field(block, "sidebar_position"), _field(block, "draft")
    nested = F.regexp_extract(F.concat(F.lit("\n"), block), "\\nsidebar:[ \\t]*\\n(?:[ \\t]+[^\\n]*\\n)*?[ \\t]+order:[ \\t]*([^\\n]*)", 1)
    number = "^[-+]?(?:[0-9]+(?:\\.[0-9]*)?|\\.[0-9]+)(?:[eE][-+]?[0-9]+)?\\z"
    quoted = "^(?:\"(.*)\"|'(.*)')\\z"
    plain = ~title.rlike(number) & ~F.lower(title).isin("true", "false", "null", "~", "") & ~title.rlike("^[\\[{&*!|>%@`]")
    text = F.when(title.rlike(quoted), F.concat(F.regexp_extract(title, quoted, 1), F.regexp_extract(title, quoted, 2))).when(plain, title)
    as_number = lambda c: F.when(js_trim(c).rlike(number), js_trim(c).cast("double"))
    return F.struct(text.alias("title"), F.coalesce(as_number(position), as_number(nested)).alias("sidebar_position"), F.when(F.lower(draft).isin("true", "false"), F.lower(draft) == "true").alias("draft"))


def frontmatter_body(raw: Column) -> Column:
    return F.regexp_replace(raw, BLOCK, "")
