"""Fill-in-middle transformation on ropes.

A text is cut into units, its lines (``[^\\n]*\\n|[^\\n]+``). A rope is an immutable balanced tree: a leaf holds at most
``LEAF_UNITS`` consecutive units, every node caches how many units and how many code points lie below it. Splitting at a
unit rank walks one path and shares the rest, concatenating joins two trees along their spines, so a document is rearranged
without copying its text until it is read out once. Two seeded ranks split a document in prefix, middle and
suffix; the parts are concatenated with sentinels as ``psm`` (``<P>`` prefix ``<S>`` suffix ``<M>`` middle) or
``spm`` (``<S>`` suffix ``<P>`` prefix ``<M>`` middle). The inverse splits the tree of the output at its sentinels by code-point ranks
and concatenates the parts again. A sentinel starts with its only ``<``, so none can arise across a seam.

Ranks, form and order come from the sha256 of ``seed:doc_id``: reruns and lost executors change nothing.

Defined results: a null text counts as empty; an empty text, a text that holds a sentinel and one that the rate leaves out
are ``plain``, their output is the text and both counts are null; a null doc_id is hashed as the empty string;
repeated rows are rows of their own with equal results; an empty table gives an empty result; extra columns are
kept by ``transform`` unless it sets them, and ignored by the query. Texts are read whole; a row is the unit of work, so no key can be hot.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.runtime import ship_code, spread

SEED, FIM_RATE, SPM_RATE = 7, 100, 50
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
LEAF_UNITS = 32
UNITS = re.compile(r"[^\n]*\n|[^\n]+")


@dataclass(frozen=True, slots=True)
class Leaf:
    units: tuple[str, ...]
    n_chars: int
    height: int = 0

    @property
    def n_units(self) -> int:
        return len(self.units)


@dataclass(frozen=True, slots=True)
class Branch:
    left: Rope
    right: Rope
    n_units: int
    n_chars: int
    height: int


Rope = Leaf | Branch
EMPTY = Leaf((), 0)


def leaf(units: tuple[str, ...]) -> Leaf:
    return Leaf(units, sum(map(len, units))) if units else EMPTY


def _branch(left: Rope, right: Rope) -> Branch:
    return Branch(left, right, left.n_units + right.n_units, left.n_chars + right.n_chars, max(left.height, right.height) + 1)


def _balanced(left: Rope, right: Rope) -> Rope:
    """A branch over trees whose heights differ by two at most, rotated so that they differ by one at most."""
    if left.height > right.height + 1:
        if left.left.height < left.right.height:
            left = _branch(_branch(left.left, left.right.left), left.right.right)
        return _branch(left.left, _branch(left.right, right))
    if right.height > left.height + 1:
        if right.right.height < right.left.height:
            right = _branch(right.left.left, _branch(right.left.right, right.right))
        return _branch(_branch(left, right.left), right.right)
    return _branch(left, right)


def concat(left: Rope, right: Rope) -> Rope:
    """Joins along the spine of the higher tree; what is not on the spine is shared."""
    if not left.n_chars:
        return right
    if not right.n_chars:
        return left
    if left.height > right.height + 1:
        return _balanced(left.left, concat(left.right, right))
    if right.height > left.height + 1:
        return _balanced(concat(left, right.left), right.right)
    return _branch(left, right)


def rope_of(text: str) -> Rope:
    """A balanced rope over the units of a text."""
    units = UNITS.findall(text)
    level: list[Rope] = [leaf(tuple(units[i : i + LEAF_UNITS])) for i in range(0, len(units), LEAF_UNITS)]
    while len(level) > 1:
        level = [_branch(*level[i : i + 2]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0] if level else EMPTY


def split_units(rope: Rope, rank: int) -> tuple[Rope, Rope]:
    """(the first ``rank`` units, the rest)."""
    if rank <= 0:
        return EMPTY, rope
    if rank >= rope.n_units:
        return rope, EMPTY
    if isinstance(rope, Leaf):
        return leaf(rope.units[:rank]), leaf(rope.units[rank:])
    if rank <= rope.left.n_units:
        first, second = split_units(rope.left, rank)
        return first, concat(second, rope.right)
    first, second = split_units(rope.right, rank - rope.left.n_units)
    return concat(rope.left, first), second


def split_chars(rope: Rope, rank: int) -> tuple[Rope, Rope]:
    """(the first ``rank`` code points, the rest); a unit that the rank falls into is cut."""
    if rank <= 0:
        return EMPTY, rope
    if rank >= rope.n_chars:
        return rope, EMPTY
    if isinstance(rope, Leaf):
        for i, unit in enumerate(rope.units):
            if rank < len(unit):
                cut = (unit[:rank],) if rank else ()
                return leaf(rope.units[:i] + cut), leaf((unit[rank:], *rope.units[i + 1 :]))
            rank -= len(unit)
    if rank <= rope.left.n_chars:
        first, second = split_chars(rope.left, rank)
        return first, concat(second, rope.right)
    first, second = split_chars(rope.right, rank - rope.left.n_chars)
    return concat(rope.left, first), second


def leaves(rope: Rope) -> Iterator[Leaf]:
    stack: list[Rope] = [rope]
    while stack:
        node = stack.pop()
        if isinstance(node, Leaf):
            yield node
        else:
            stack += [node.right, node.left]


def text_of(rope: Rope) -> str:
    return "".join(unit for found in leaves(rope) for unit in found.units)


def rearrange(rope: Rope, first: int, second: int, form: str) -> tuple[Rope, int, int]:
    """(output, code points of the prefix, code points of the middle) for two unit ranks in any order."""
    head, suffix = split_units(rope, max(first, second))
    prefix, middle = split_units(head, min(first, second))
    p, s, m = (leaf((x,)) for x in (PREFIX, SUFFIX, MIDDLE))
    order = [p, prefix, s, suffix, m, middle] if form == "psm" else [s, suffix, p, prefix, m, middle]
    out = EMPTY
    for part in order:
        out = concat(out, part)
    return out, prefix.n_chars, middle.n_chars


def restore(output: str, form: str) -> str:
    """The text that was rearranged, from its output and form alone."""
    if form == "plain":
        return output
    second = SUFFIX if form == "psm" else PREFIX
    at, mid = output.index(second), output.index(MIDDLE)
    rest, one = split_chars(rope_of(output), mid)
    one = split_chars(one, len(MIDDLE))[1]
    rest, three = split_chars(rest, at)
    two, three = split_chars(rest, len(PREFIX))[1], split_chars(three, len(second))[1]
    prefix, suffix = (two, three) if form == "psm" else (three, two)
    return text_of(concat(concat(prefix, one), suffix))


def _numbers(seed: int) -> list[Column]:
    """h1 to h4: the first four 8-digit groups of the hex sha256 of ``seed:doc_id``."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long").alias(f"__quire_h{i + 1}") for i in range(4)]


ADDED = "n long, form string, prefix_chars long, middle_chars long, output string, restored string"


def transform(docs: DataFrame, fim_rate: int = FIM_RATE, spm_rate: int = SPM_RATE, seed: int = SEED) -> DataFrame:
    """``docs`` with n, form, prefix_chars, middle_chars, output and restored, the text rebuilt from output and form."""
    ship_code(docs.sparkSession)
    added = [c.split()[0] for c in ADDED.split(", ")]
    kept = [c for c in docs.columns if c.lower() not in added]
    rows = docs.select(*[F.col(f"`{c}`") for c in kept], F.coalesce(F.col("text").cast("string"), F.lit("")).alias("__quire_text"), *_numbers(seed))
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*[f"`{c}`" for c in kept]).schema], ADDED])

    def one(text: str, h: tuple[int, ...]) -> tuple:
        rope = rope_of(text)
        n = rope.n_units
        if not text or any(s in text for s in (PREFIX, SUFFIX, MIDDLE)) or h[2] % 100 >= fim_rate:
            return n, "plain", None, None, text, text
        form = "spm" if h[3] % 100 < spm_rate else "psm"
        out, prefix, middle = rearrange(rope, h[0] % (n + 1), h[1] % (n + 1), form)
        output = text_of(out)
        return n, form, prefix, middle, output, restore(output, form)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.large_string(), pa.large_string()]
        for batch in batches:
            n, own = batch.num_rows, len(kept)
            start = 0
            while start < n:  # slices: what is built beside a batch stays small, however long its texts are
                done, size = [], 0
                while start + len(done) < n and (not done or size < SLICE_CHARS):
                    i = start + len(done)
                    text = batch.column(own)[i].as_py()
                    done.append(one(text, tuple(batch.column(own + 1 + j)[i].as_py() for j in range(4))))
                    size += len(text)
                columns = [batch.column(j).slice(start, len(done)) for j in range(own)]
                made = [pa.array(x, type=k).cast(pa.string() if k == pa.large_string() else k) for x, k in zip(zip(*done, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*columns, *made], names=[*kept, *added])
                start += len(done)

    return rows.mapInArrow(run, schema)


SLICE_CHARS = 1 << 23


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    digests = [F.sha2(c, 256).alias(f"{c}_sha256") for c in ("output", "restored")]
    return transform(docs).select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
u AS (SELECT *, regexp_extract_all(text, '[^\n]*\n|[^\n]+') AS lines FROM t),
v AS (SELECT *, len(lines) AS n, ('0x' || h[1:8])::BIGINT % (len(lines) + 1) AS a, ('0x' || h[9:16])::BIGINT % (len(lines) + 1) AS b,
             ('0x' || h[25:32])::BIGINT % 100 AS o FROM u),
w AS (SELECT *, CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') THEN 'plain'
                     WHEN o < 50 THEN 'spm' ELSE 'psm' END AS form,
             array_to_string(lines[1:least(a, b)], '') AS p, array_to_string(lines[least(a, b) + 1:greatest(a, b)], '') AS m,
             array_to_string(lines[greatest(a, b) + 1:], '') AS s FROM v)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM w
"""
