"""Emission planning: which file holds which node under a token budget.

A doc set's collapsed tree is bounded: nodes are dealt out by doc set and sorted, and a task plans one doc set after the other from
Arrow batches that hold many. Texts stay out of it, as nodes carry their token counts. A table of contents is a list of line lengths: its cost is a running sum, and packing it into
buckets is one pass over it. A table over the budget is packed into groups, whose lines make the next table, until it fits or
packing gains nothing; a body that doesn't fit beside its table becomes a first entry of its own.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import groupby, pairwise
from operator import itemgetter

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.sectioning import tokens_of, units
from quire.functions.text import slug_of
from quire.runtime import ship_code

BUDGET = 4000
PATHS = pa.list_(pa.int32())
PLAN = {
    "doc_set": pa.string(), "emit_ord": pa.int32(), "relative_path": pa.string(), "role": pa.string(), "name": pa.string(), "node_path": PATHS, "body_path": PATHS,
    "child_paths": pa.list_(pa.string()), "oversized": pa.bool_(), "oversized_index": pa.bool_(),
}
CHILDREN = {"doc_set": pa.string(), "path": PATHS, "parent_path": PATHS, "name": pa.string(), "slug": pa.string(), "recurses": pa.bool_(), "link_path": pa.string()}
NODE = ("doc_set", "path", "parent_path", "name", "own_tokens", "subtree_tokens", "has_body")
LISTS = ("path", "parent_path")
BATCH = 10_000  # rows a task gathers before it hands them on


class Listing:
    """The cost of a growing list of lines: a sum of lengths, unless a line has breaks of its own and may open a fence."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.used, self.plain = -1, True

    def cost_with(self, line: str) -> int:
        if self.plain and "\n" not in line:
            return -(-(self.used + 1 + units(line)) // 4)
        return tokens_of("\n".join([*self.lines, line]))

    def add(self, line: str) -> None:
        self.lines.append(line)
        self.used += 1 + units(line)
        self.plain = self.plain and "\n" not in line


def cost(lines: list[str]) -> int:
    listing = Listing()
    for line in lines[:-1]:
        listing.add(line)
    return listing.cost_with(lines[-1]) if lines else 0


def bucket_numbers(lines: list[str], budget: int) -> list[int]:
    """Next-fit bucket of every line, from 1; a line over the budget has a bucket of its own."""
    out: list[int] = []
    held = Listing()
    for line in lines:
        if not out or (held.lines and held.cost_with(line) > budget):
            held = Listing()
            out.append(out[-1] + 1 if out else 1)
        else:
            out.append(out[-1])
        held.add(line)
    return out


@dataclass(slots=True)
class Entry:
    """A line of a table of contents, and what it leads to: a node's place in the doc set, a body, or a group's entries."""

    name: str
    slug: str
    deep: bool
    node: int | None = None
    overview: int | None = None
    members: list[Entry] | None = None

    @property
    def link(self) -> str:
        return f"{self.slug}/index.md" if self.deep else f"{self.slug}.md"

    @property
    def line(self) -> str:
        return f"- [{self.name}]({self.link})"


def grouped(entries: list[Entry], budget: int) -> list[Entry]:
    """The entries, or groups of groups of them whose table fits where that can be had."""
    lines = [e.line for e in entries]
    while cost(lines) > budget:
        numbers = bucket_numbers(lines, budget)
        if numbers[-1] == len(entries):
            break
        buckets: list[list[Entry]] = [[] for _ in range(numbers[-1])]
        for number, entry in zip(numbers, entries, strict=True):
            buckets[number - 1].append(entry)
        entries = [Entry(b[0].name if b[0].name == b[-1].name else f"{b[0].name} – {b[-1].name}", f"group-{n}", True, members=b) for n, b in enumerate(buckets, 1)]
        lines = [e.line for e in entries]
    return entries


class DocSet:
    """A doc set's nodes in path order, as columns."""

    def __init__(self, rows: pd.DataFrame | dict[str, list], budget: int):
        self.budget = budget
        self.paths = [tuple(p) for p in rows["path"]]
        self.names = list(rows["name"])
        self.own, self.sizes, self.has_body = list(rows["own_tokens"]), list(rows["subtree_tokens"]), list(rows["has_body"])
        at = {path: i for i, path in enumerate(self.paths)}
        self.kids: list[list[int]] = [[] for _ in self.paths]
        for i, parent in enumerate(rows["parent_path"]):
            if parent is not None and len(self.paths[i]):
                self.kids[at[tuple(parent)]].append(i)

    def over(self, i: int) -> bool:
        return self.sizes[i] > self.budget

    def entries(self, i: int, overview: bool = False) -> list[Entry]:
        """The table of a node's children in order, behind its own body if that gets a file; equal slugs are numbered."""
        seen: Counter[str] = Counter()

        def numbered(base: str) -> str:
            seen[base] += 1
            return base if seen[base] == 1 else f"{base}-{seen[base]}"

        first = [Entry("Overview", numbered("overview"), False, overview=i)] if overview else []
        return first + [Entry(self.names[k], numbered(slug_of(self.names[k])), self.over(k) and bool(self.kids[k]), node=k) for k in self.kids[i]]

    def table(self, i: int) -> tuple[list[Entry], bool, bool]:
        """The entries of a node's index, whether its body stays beside them, and whether all of it fits."""
        entries = grouped(self.entries(i), self.budget)
        beside = self.has_body[i]
        if beside and self.own[i] + cost([e.line for e in entries]) > self.budget:
            entries, beside = grouped(self.entries(i, overview=True), self.budget), False
        return entries, beside, (self.own[i] if beside else 0) + cost([e.line for e in entries]) <= self.budget

    def plan(self) -> list[tuple]:
        """Rows of PLAN from relative_path on, parents before their children."""
        out: list[tuple] = []
        if not (self.over(0) and self.kids[0]):
            return [("SKILL.md", "skill", self.names[0], [], [], [], self.over(0), False)]
        waiting: list[tuple[str, str, Entry]] = [("SKILL.md", "resources", Entry(self.names[0], "", True, node=0))]
        while waiting:
            path, folder, entry = waiting.pop()
            if entry.overview is not None:
                out.append((path, "leaf", entry.name, None, list(self.paths[entry.overview]), [], self.own[entry.overview] > self.budget, False))
                continue
            if entry.members is None and not entry.deep:
                own = list(self.paths[entry.node])
                out.append((path, "leaf", entry.name, own, own, [], self.over(entry.node), False))
                continue
            if entry.members is not None:
                listed = entry.members
                out.append((path, "group", entry.name, None, None, [f"{folder}/{e.link}" for e in listed], False, cost([e.line for e in listed]) > self.budget))
            else:
                listed, beside, fits = self.table(entry.node)
                own = list(self.paths[entry.node])
                out.append((path, "index" if entry.node else "skill", entry.name, own, own if beside else None, [f"{folder}/{e.link}" for e in listed], False, not fits))
            waiting += [(f"{folder}/{e.link}", f"{folder}/{e.slug}", e) for e in reversed(listed)]
        return out


def _doc_sets(nodes: DataFrame, function: Callable[[DocSet], list[tuple]], budget: int, fields: dict[str, pa.DataType]) -> DataFrame:
    """Rows (all of ``fields`` but the doc set) that ``function`` makes of every doc set's nodes; a task holds one bounded doc set and a batch."""
    schema = pa.schema(list(fields.items()))

    def flat(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True) if rows else [()] * len(schema)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)

    def items(column: pa.Array, name: str) -> list:
        if name not in LISTS:
            return column.to_pylist()
        values, ends = column.values.to_numpy().tolist(), column.offsets.to_numpy().tolist()
        return [tuple(values[a:b]) for a, b in pairwise(ends)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes_of = groupby((row for batch in batches for row in zip(*[items(c, name) for c, name in zip(batch.columns, NODE, strict=True)], strict=True)), itemgetter(0))
        out: list[tuple] = []
        for doc_set, rows in nodes_of:
            own = dict(zip(NODE, zip(*rows, strict=True), strict=True))
            out += [(doc_set, *row) for row in function(DocSet(own, budget))]
            if len(out) >= BATCH:
                yield flat(out)
                out = []
        yield flat(out)

    ship_code(nodes.sparkSession)
    kinds = {pa.string(): "string", pa.int32(): "int", pa.bool_(): "boolean", PATHS: "array<int>", pa.list_(pa.string()): "array<string>"}
    dealt = nodes.select(*NODE).repartition("doc_set").sortWithinPartitions("doc_set", "path")
    return dealt.mapInArrow(run, ", ".join(f"{name} {kinds[kind]}" for name, kind in fields.items()))


def plan_emission(nodes: DataFrame, budget: int = BUDGET) -> DataFrame:
    """The plan of every doc set of a sized tree. ``body_path`` names the node whose text a file begins with, if any.

    What is below a node within the budget stays in its file, so those nodes are left out before any are dealt out."""
    if "parent_tokens" in nodes.columns:
        nodes = nodes.filter(F.col("parent_tokens").isNull() | (F.col("parent_tokens") > budget))
    return _doc_sets(nodes, lambda docs: [(i, *row) for i, row in enumerate(docs.plan(), 1)], budget, PLAN)


def _described(docs: DocSet) -> list[tuple]:
    return [(docs.paths[e.node], docs.paths[i], e.name, e.slug, e.deep, e.link) for i in range(len(docs.paths)) for e in docs.entries(i)]


def describe_children(nodes: DataFrame, budget: int = BUDGET) -> DataFrame:
    """slug, recurses and link_path of every node below a root, as the planner numbers and links them."""
    return _doc_sets(nodes, _described, budget, CHILDREN)


def buckets(lines: Column, budget: int) -> Column:
    """Next-fit bucket numbers of an ordered array of lines."""

    @F.pandas_udf("array<int>")
    def run(arrays: pd.Series) -> pd.Series:
        return arrays.map(lambda own: bucket_numbers(list(own), budget))

    return run(lines)


def duplicate_paths(plan: DataFrame) -> DataFrame:
    return plan.groupBy("doc_set", "relative_path").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
