"""A Markdown file's sections, sized and nested, in one pass over its lines: what ``quire.functions.markdown`` tells by columns, where every file needs all of it.

Column functions with lambdas are interpreted for each line and each heading; this takes a tenth of their time.
"""

from __future__ import annotations

from dataclasses import dataclass

from quire.functions.text import WS_CHARS


def units(text: str) -> int:
    """Length in UTF-16 code units."""
    return len(text) if text.isascii() else len(text.encode("utf-16-le")) // 2


def tokens_of(body: str) -> int:
    """``quire.functions.markdown.estimate_tokens`` of one string."""
    if "```" not in body:
        return -(-units(body) // 4)
    total, part, rate = 0, 0, 4  # part: the characters since the last fence line, a line feed a line
    for line in body.split("\n"):
        own = line.strip(WS_CHARS)
        if own.startswith("```"):
            total += -(-max(part - 1, 0) // rate) - (-units(own) // 4)
            part, rate = 0, 7 - rate
        else:
            part += units(line) + 1
    return total - (-max(part - 1, 0) // rate)


def heading(line: str) -> tuple[int, str] | None:
    """(level, name) of a line without white space before it, if it is a heading."""
    rest = line.lstrip("#")
    level = len(line) - len(rest)
    name = rest.strip(WS_CHARS)
    return (level, name) if level <= 6 and name and rest[0] in WS_CHARS else None


@dataclass(slots=True)
class Section:
    level: int
    name: str
    body: str
    tokens: int
    chain: list[int]
    subtree: int
    children: int = 0


def sections(content: str) -> list[Section]:
    """The preamble (level 0) and a section a heading, with the ordinals of the headings that enclose it, and the tokens of it and all it encloses.

    The preamble's ``children`` are the headings that nothing encloses, its ``subtree`` the whole file."""
    lines, inside = content.split("\n"), False
    found: list[tuple[int, int, str]] = [(-1, 0, "")]
    for at, line in enumerate(lines):
        own = line.lstrip(WS_CHARS)
        if own.startswith("```"):
            inside = not inside
        elif not inside and own.startswith("#") and (told := heading(own)):
            found.append((at, *told))
    out: list[Section] = []
    chain: list[int] = []
    for ord_, ((at, level, name), end) in enumerate(zip(found, [*(f[0] for f in found[1:]), len(lines)], strict=True)):
        body = "\n".join(lines[at + 1 : end]).strip(WS_CHARS)
        while chain and found[chain[-1]][1] >= level:
            chain.pop()
        tokens = tokens_of(body)
        out.append(Section(level, name, body, tokens, chain[:], tokens))
        if ord_:
            chain.append(ord_)
    for own in reversed(out[1:]):
        above = out[own.chain[-1] if own.chain else 0]
        above.subtree += own.subtree
        above.children += 1
    return out
