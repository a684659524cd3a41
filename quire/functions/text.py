"""Text primitives as Column -> Column functions."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The white space that trimming removes.
WS = "\\t\\n\\x0B\\f\\r \\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000\\uFEFF"
#: The same without the line feed, for patterns inside a line.
WS_LINE = WS.replace("\\n", "")
#: The same as characters.
WS_CHARS = "\t\n\x0b\f\r \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
#: Names that a file system reserves.
RESERVED = ("con", "prn", "aux", "nul", *(f"com{i}" for i in range(1, 10)), *(f"lpt{i}" for i in range(1, 10)))


def js_trim(text: Column) -> Column:
    """Without leading and trailing Unicode white space."""
    return F.btrim(text, F.lit(WS_CHARS))


def js_len(text: Column) -> Column:
    """Length in UTF-16 code units; that of ASCII text is its length in bytes."""
    return F.when(F.octet_length(text) == F.length(text), F.length(text)).otherwise(F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("long")


ASTRAL, HALF = "[\\x{10000}-\\x{10FFFF}]", "\uFDD5"


def _in_units(text: Column) -> Column:
    """The text with a mark behind each character of two UTF-16 units, so that characters count as units."""
    return F.when(text.rlike(ASTRAL), F.regexp_replace(text, f"({ASTRAL})", f"$1{HALF}")).otherwise(text)


def _whole(text: Column) -> Column:
    """Without those marks; a character cut in half is a replacement character, as half of it can't be written."""
    clean = F.replace(F.regexp_replace(text, f"{ASTRAL}\\z", "\uFFFD"), F.lit(HALF), F.lit(""))
    return F.when(text.rlike(ASTRAL), clean).otherwise(text)


def cap(text: Column, most: int) -> Column:
    """At most so many UTF-16 units; no character beyond as many is looked at."""
    text = F.substring(text, 1, most)
    return _whole(F.substring(_in_units(text), 1, most))


def nfkc(text: Column) -> Column:
    """NFKC normal form; Spark has no native one, so this is an Arrow function."""

    def normal(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda s: s if s is None or s.isascii() else unicodedata.normalize("NFKC", s))

    normal.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(normal, "string")(text)


def slug(text: Column, most: int = 64, normal: bool = True) -> Column:
    """A file name from a heading: lower-case ASCII letters and digits, runs of all else as one hyphen."""
    plain = F.lower(nfkc(text) if normal else text)
    short = cap(F.regexp_replace(F.regexp_replace(plain, "[^a-z0-9]+", "-"), "^-+|-+\\z", ""), most)
    short = F.regexp_replace(short, "-+\\z", "")
    return F.when((short == "") | short.isin(*RESERVED), "section").otherwise(short)


def slug_of(text: str) -> str:
    """``slug`` of one string."""
    plain = (text if text.isascii() else unicodedata.normalize("NFKC", text)).lower()
    short = re.sub("[^a-z0-9]+", "-", plain).strip("-")[:64].rstrip("-")
    return "section" if not short or short in RESERVED else short


def truncate_word(text: Column, most: int = 120) -> Column:
    """Cut at the last space at or before ``most`` UTF-16 units; without one, a hard cut.

    As many characters and two more decide, so no more of them are looked at."""
    text = F.substring(text, 1, most + 2)
    whole = _in_units(text)
    head = F.substring(whole, 1, most + 1)
    space = F.length(head) - F.instr(F.reverse(head), " ")
    cut = F.when(F.instr(head, " ") > 0, F.substr(whole, F.lit(1), space)).otherwise(F.substring(whole, 1, most))
    return F.when(F.length(whole) <= most, text).otherwise(_whole(cut))


def humanize(text: Column) -> Column:
    return js_trim(F.regexp_replace(text, "[-_]+", " "))


def base_name(path: Column) -> Column:
    """The last path segment without its extension."""
    return F.regexp_replace(F.element_at(F.split(path, "/", -1), -1), "\\.[^.]+\\z", "")


def numeric_prefix(name: Column) -> Column:
    """Leading digits before a separator or the end, as a double."""
    digits = F.regexp_extract(name, "^([0-9]+)(?:[-_.]|\\z)", 1)
    return F.when(digits != "", digits.cast("double"))


def yaml_scalar(text: Column) -> Column:
    out = F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))
    return F.concat(F.lit('"'), out, F.lit('"'))


def escape_link_text(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("["), F.lit("\\[")), F.lit("]"), F.lit("\\]"))


def escape_link_target(target: Column) -> Column:
    return F.replace(F.replace(F.replace(target, F.lit("("), F.lit("%28")), F.lit(")"), F.lit("%29")), F.lit(" "), F.lit("%20"))


def directory(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*\\z", "")


def relative_link(source: Column, target: Column) -> Column:
    """A target below the directory of its source, relative to that."""
    folder = directory(source)
    return F.when(folder == "", target).otherwise(F.substr(target, F.length(folder) + 2))


def file_bytes(text: Column) -> Column:
    return F.octet_length(text)


def prefixed(field: Column) -> Column:
    """UTF-8 bytes behind their length as four bytes, big end first."""
    data = F.encode(field, "UTF-8")
    return F.concat(F.unhex(F.lpad(F.hex(F.octet_length(data)), 8, "0")), data)
