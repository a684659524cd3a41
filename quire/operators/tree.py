"""Document trees as tables of nodes.

A node's ``path`` is an array of ordinals: for a folder the first file in it, for a file its place in the
doc set, for a heading its place in the file. Sorting by path is depth-first order, prefixes are ancestors,
so no recursion is needed. Everything is keyed by doc set, which is bounded.

Nodes carry names, token counts and where their text is (``file_ord``, ``ord``), not the text: files are parsed and
counted row by row, only this skeleton is shuffled, and texts are joined where they are rendered.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.arrays import bound, folded
from quire.functions.markdown import outline, sections
from quire.functions.sectioning import sections as sections_of
from quire.functions.text import base_name, humanize, js_trim
from quire.runtime import materialize, ship_code

KEY = ("doc_set", "path")
PLACE = ("doc_set", "file_ord", "ord")


def headings(files: DataFrame) -> DataFrame:
    """A row a section: doc_set, file_ord, ord (0: preamble), level, name, body. Row-local, no shuffle."""
    return files.select("doc_set", "file_ord", F.inline(sections(F.col("content"))))


def chains(heads: Column) -> Column:
    """For every heading of an array (ord, level, ...) the ordinals of those that enclose it, outermost first.

    One pass with a stack of rising levels: a heading closes all that aren't above it."""
    none = F.filter(F.array(F.struct(F.lit(0).alias("ord"), F.lit(0).alias("level"))), lambda _: F.lit(False))

    def step(stack: Column, head: Column) -> tuple[Column, Column]:
        above = F.filter(stack, lambda s: s["level"] < head["level"])
        return F.transform(above, lambda s: s["ord"]), F.concat(above, F.array(F.struct(head["ord"].alias("ord"), head["level"].alias("level"))))

    return folded(heads, none, step)


def subtrees(heads: Column) -> Column:
    """For every heading of an array (level, tokens, ...) the tokens of it and all it encloses, and how many it encloses directly.

    One pass from the last to the first: a heading takes in the finished ones of deeper levels behind it."""
    zero = F.lit(0).cast("long")
    none = F.filter(F.array(F.struct(F.lit(0).alias("level"), zero.alias("tokens"))), lambda _: F.lit(False))

    def step(done: Column, head: Column) -> tuple[Column, Column]:
        deeper = F.filter(done, lambda d: d["level"] > head["level"])  # from the nearest on, up to the first that isn't
        total = F.aggregate(deeper, head["tokens"], lambda a, d: a + d["tokens"])
        rest = F.filter(done, lambda d: d["level"] <= head["level"])
        return F.struct(total.alias("tokens"), F.size(deeper).alias("children")), F.concat(F.array(F.struct(head["level"].alias("level"), total.alias("tokens"))), rest)

    return F.reverse(folded(F.reverse(heads), none, step))


def heading_paths(files: DataFrame) -> DataFrame:
    """A row a heading (ord, level, name) with ``chain``, the ordinals of the headings that enclose it, ``parent``, the last of them, and ``n_children``. Row-local, no shuffle."""
    tokens = F.lit(0).cast("long").alias("tokens")
    heads = F.transform(outline(F.col("content")), lambda h: F.struct(h["ord"].alias("ord"), h["level"].alias("level"), h["name"].alias("name"), tokens))
    rows = files.select("doc_set", "file_ord", F.explode(F.array(heads)).alias("heads"))  # a generator's output is computed once
    nested = F.arrays_zip(F.col("heads").alias("h"), chains(F.col("heads")).alias("c"), subtrees(F.col("heads")).alias("s"))
    one = rows.select("doc_set", "file_ord", F.explode(nested).alias("x"))
    return one.select("doc_set", "file_ord", "x.h.ord", "x.h.level", "x.h.name", F.col("x.c").alias("chain"), F.try_element_at("x.c", F.lit(-1)).alias("parent"), F.col("x.s.children").cast("long").alias("n_children"))


def _name(h1: Column) -> Column:
    filled = lambda c: F.when(c != "", c)
    return F.coalesce(filled(js_trim(F.col("title"))), filled(h1), humanize(base_name(F.col("rel_path"))))


def file_names(files: DataFrame) -> DataFrame:
    """Adds ``name``: the title, else the first level-1 heading, else the file name in words."""
    h1 = F.filter(sections(F.col("content")), lambda s: (s["ord"] > 0) & (s["level"] == 1))
    return files.withColumn("name", _name(F.get(F.transform(h1, lambda s: s["name"]), F.lit(0))))


def _folder_prefixes() -> Column:
    parts = F.split("rel_path", "/", -1)
    return F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def folders(files: DataFrame) -> DataFrame:
    """doc_set, folder (path text), first_ord, depth: every folder with its first file."""
    rows = files.filter(F.col("rel_path").contains("/")).select("doc_set", "file_ord", F.explode(_folder_prefixes()).alias("folder"))
    return rows.groupBy("doc_set", "folder").agg(F.min("file_ord").alias("first_ord")).withColumn("depth", F.size(F.split("folder", "/", -1)))


HEADS = pa.struct([("ord", pa.int32()), ("name", pa.string()), ("tokens", pa.int64()), ("has_body", pa.bool_()), ("chain", pa.list_(pa.int32())), ("subtree", pa.int64()), ("children", pa.int32())])
FILE = "doc_set string, file_ord int, rel_path string, title string"
PARSED = "h1 string, own struct<tokens: bigint, has_body: boolean>, heads array<struct<ord: int, name: string, tokens: bigint, has_body: boolean, chain: array<int>, subtree: bigint, children: int>>, tokens bigint, children int"
FILES = 256  # files that a task holds parsed


def _parsed(contents: list[str | None], texts: bool) -> list[pa.Array]:
    """Columns of PARSED, and the bodies by section."""
    files = [sections_of(c or "") for c in contents]
    heads = [s for f in files for s in f[1:]]

    def listed(lengths: Iterable[int], values: pa.Array) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(accumulate(lengths, initial=0), pa.int32()), values)

    chains = listed((len(h.chain) for h in heads), pa.array([o for h in heads for o in h.chain], pa.int32()))
    columns = [[i for f in files for i in range(1, len(f))], [h.name for h in heads], [h.tokens for h in heads], [h.body != "" for h in heads], chains, [h.subtree for h in heads], [h.children for h in heads]]
    nested = pa.StructArray.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t.type) for c, t in zip(columns, HEADS, strict=True)], fields=list(HEADS))
    own = pa.StructArray.from_arrays([pa.array([f[0].tokens for f in files], pa.int64()), pa.array([f[0].body != "" for f in files], pa.bool_())], names=["tokens", "has_body"])
    out = [pa.array([next((s.name for s in f[1:] if s.level == 1), None) for f in files], pa.string()), own, listed((len(f) - 1 for f in files), nested)]
    out += [pa.array([f[0].subtree for f in files], pa.int64()), pa.array([f[0].children for f in files], pa.int32())]
    return [*out, listed(map(len, files), pa.array([s.body for f in files for s in f], pa.string()))] if texts else out


def parse(files: DataFrame, texts: bool = True) -> DataFrame:
    """A row a file, written once (without ``bodies`` unless ``texts``): doc_set, file_ord, rel_path, name, own (tokens, has_body of the preamble), heads (ord, name, tokens, has_body, chain, subtree, children by heading),
    tokens and children of the whole file, and bodies by section."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, FILES):
                part = batch.slice(at, FILES)
                yield pa.RecordBatch.from_arrays([*part.columns[:4], *_parsed(part.column(4).to_pylist(), texts)], names=names)

    ship_code(files.sparkSession)
    schema = f"{FILE}, {PARSED}" + (", bodies array<string>" if texts else "")
    names = ["doc_set", "file_ord", "rel_path", "title", "h1", "own", "heads", "tokens", "children", *(["bodies"] if texts else [])]
    rows = files.select("doc_set", "file_ord", "rel_path", "title", "content").mapInArrow(run, schema)
    return materialize(rows.select("doc_set", "file_ord", "rel_path", _name(F.col("h1")).alias("name"), *names[5:]), "parsed")


def bodies(parsed: DataFrame) -> DataFrame:
    """doc_set, file_ord, ord, body of every section that has one."""
    return parsed.select("doc_set", "file_ord", F.posexplode("bodies").alias("ord", "body")).filter("body <> ''")


def with_bodies(nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """Adds ``body``, empty for nodes without text."""
    return nodes.join(texts, list(PLACE), "left").withColumn("body", F.coalesce("body", F.lit("")))


def homes(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(folders with first_ord, depth, tokens, children and whether they stay; files with the first files and the staying of the folders they are in, outermost first).

    What moves is a row for each file and folder it is in, whatever the number of headings."""
    files = parsed.select("doc_set", "file_ord", "rel_path", "tokens")
    pairs = files.filter(F.col("rel_path").contains("/")).select("doc_set", "file_ord", "tokens", F.posexplode(_folder_prefixes()).alias("at", "folder"), (F.size(F.split("rel_path", "/", -1)) - 2).alias("last"))
    sums = pairs.groupBy("doc_set", "folder").agg(F.min("file_ord").alias("first_ord"), F.first("at").alias("at"), F.sum("tokens").alias("tokens"), F.count_if(F.col("at") == F.col("last")).alias("files"))
    sums = materialize(sums, "folders")
    inside = sums.filter("at > 0").groupBy("doc_set", F.regexp_replace("folder", "/[^/]*\\z", "").alias("folder")).agg(F.count(F.lit(1)).alias("inner"))
    placed = sums.join(inside, ["doc_set", "folder"], "left").withColumn("children", F.col("files") + F.coalesce("inner", F.lit(0)))
    placed = placed.withColumn("stays", F.col("children") != 1)
    joined = pairs.select("doc_set", "file_ord", "folder").join(placed, ["doc_set", "folder"])
    steps = F.array_sort(F.collect_list(F.struct("at", "first_ord", "stays", "tokens", "children")))
    return placed, joined.groupBy("doc_set", "file_ord").agg(steps.alias("steps"))


def _placed(parsed: DataFrame) -> DataFrame:
    """Parsed files with ``steps``, the folders they are in."""
    found = homes(parsed)[1]
    empty = F.array().cast("array<struct<at: int, first_ord: int, stays: boolean, tokens: bigint, children: bigint>>")
    return parsed.drop("bodies").join(found, ["doc_set", "file_ord"], "left").withColumn("steps", F.coalesce("steps", empty))


def _nodes(placed: DataFrame, root_name: str) -> DataFrame:
    """All nodes, also those that collapse: doc_set, path, kind, name, file_ord, ord, tokens, has_body, subtree_tokens, stays, above (paths' lengths of the ancestors that stay), parent_tokens (of the nearest of them; null if that is the root)."""
    zero, no = F.lit(0).cast("long"), F.lit(None).cast("int")
    dirs = F.transform("steps", lambda s: s["first_ord"])
    path = F.concat(dirs, F.array("file_ord"))
    depth = F.size("steps")
    # lengths of the paths of ancestors that stay: the root, then folders, then the file
    up_dirs = F.concat(F.array(F.lit(0)), F.filter(F.transform("steps", lambda s, i: F.when(s["stays"], i + 1)), lambda x: x.isNotNull()))
    file_stays = F.col("own.has_body") | (F.col("children") != 1)
    staying = lambda steps: F.try_element_at(F.transform(F.filter(steps, lambda s: s["stays"]), lambda s: s["tokens"]), F.lit(-1))
    rows = placed.withColumns({"_path": path, "_up": up_dirs, "_stays": file_stays, "_up_tokens": staying(F.col("steps"))})
    column = lambda c, name: c.alias(name)
    file = F.struct(
        column(F.col("_path"), "path"), column(F.lit("file"), "kind"), column(F.col("name"), "name"), column(F.lit(0), "ord"), column(F.col("own.tokens"), "tokens"), column(F.col("own.has_body"), "has_body"),
        column(F.col("tokens"), "subtree_tokens"), column(F.col("_stays"), "stays"), column(F.col("_up"), "above"), column(F.col("_up_tokens"), "parent_tokens"),
    )
    gone = F.transform(F.filter("heads", lambda h: ~h["has_body"] & (h["children"] == 1)), lambda h: h["ord"])
    rows = rows.withColumn("_gone", gone)
    with_file = F.when(F.col("_stays"), F.concat("_up", F.array(depth + 1))).otherwise(F.col("_up"))
    from_file = F.when(F.col("_stays"), F.col("tokens")).otherwise(F.col("_up_tokens"))
    rows = rows.withColumns({"_with_file": with_file, "_from_file": from_file, "_subtrees": F.transform("heads", lambda h: h["subtree"])})
    last_up = lambda h: F.try_element_at(F.filter(h["chain"], lambda o: ~F.array_contains("_gone", o)), F.lit(-1))
    over = lambda h: bound(last_up(h), lambda o: F.when(o.isNull(), F.col("_from_file")).otherwise(F.get("_subtrees", o - 1)))
    chain_up = lambda h: F.filter(F.transform(h["chain"], lambda o, i: F.when(~F.array_contains("_gone", o), F.size("_path") + i + 1)), lambda x: x.isNotNull())
    heads = F.transform("heads", lambda h: F.struct(
        column(F.concat("_path", h["chain"], F.array(h["ord"])), "path"), column(F.lit("heading"), "kind"), column(h["name"], "name"), column(h["ord"], "ord"), column(h["tokens"], "tokens"), column(h["has_body"], "has_body"),
        column(h["subtree"], "subtree_tokens"), column(h["has_body"] | (h["children"] != 1), "stays"), column(F.concat("_with_file", chain_up(h)), "above"), column(over(h), "parent_tokens"),
    ))
    own = rows.select("doc_set", "file_ord", F.inline(F.concat(F.array(file), heads)))
    own = own.select("doc_set", "path", "kind", "name", "file_ord", "ord", "tokens", "has_body", "subtree_tokens", "stays", "above", "parent_tokens")
    parts = F.split("rel_path", "/", -1)
    folder = rows.filter(F.size("steps") > 0).select("doc_set", F.posexplode("steps").alias("i", "step"), "steps", "_path", parts.alias("parts"), "_up").filter(F.get("_path", F.size("_path") - 1) == F.col("step.first_ord"))  # by the folder's first file
    folder = folder.select(
        "doc_set", F.slice("_path", F.lit(1), F.col("i") + 1).alias("path"), F.lit("folder").alias("kind"), humanize(F.get("parts", F.col("i"))).alias("name"), no.alias("file_ord"), no.alias("ord"),
        zero.alias("tokens"), F.lit(False).alias("has_body"), F.col("step.tokens").alias("subtree_tokens"), F.col("step.stays").alias("stays"), F.filter("_up", lambda n: n <= F.col("i")).alias("above"), staying(F.slice("steps", F.lit(1), F.col("i"))).alias("parent_tokens"),
    )
    roots = placed.groupBy("doc_set").agg(F.sum("tokens").alias("subtree_tokens"))
    roots = roots.select(
        "doc_set", F.array().cast("array<int>").alias("path"), F.lit("root").alias("kind"), F.lit(root_name).alias("name"), no.alias("file_ord"), no.alias("ord"), zero.alias("tokens"), F.lit(False).alias("has_body"),
        "subtree_tokens", F.lit(True).alias("stays"), F.array().cast("array<int>").alias("above"), F.lit(None).cast("long").alias("parent_tokens"),
    )
    return roots.unionByName(folder).unionByName(own)


def skeleton(parsed: DataFrame, root_name: str = "Docs") -> DataFrame:
    """doc_set, path, kind, name, file_ord, ord, tokens, has_body of root, folders, files and headings."""
    return _nodes(_placed(parsed), root_name).select("doc_set", "path", "kind", "name", "file_ord", "ord", "tokens", "has_body")


def build_tree(files: DataFrame, root_name: str = "Docs") -> DataFrame:
    """doc_set, path, kind, name, body of root, folders, files and headings."""
    parsed = parse(files)
    return with_bodies(skeleton(parsed, root_name), bodies(parsed)).select("doc_set", "path", "kind", "name", "body")


def collapsed(parsed: DataFrame, root_name: str = "Docs") -> DataFrame:
    """Without nodes below the root that have no body and one child, sized: doc_set, path, kind, name, file_ord, ord, own_tokens, has_body, subtree_tokens,
    ``parent_path`` and ``parent_tokens``, the nearest ancestor that stays and the tokens of its subtree (null if it is the root), and ``depth``, how many stay.

    The number of children doesn't change when a child collapses into its own child, so the rule is local. Tokens below a node are those of a range of its
    file's headings, or of whole files."""
    last = F.try_element_at("above", F.lit(-1))
    kept = _nodes(_placed(parsed), root_name).filter("stays")
    return kept.select("doc_set", "path", "kind", "name", "file_ord", "ord", F.col("tokens").alias("own_tokens"), "has_body", "subtree_tokens", F.slice("path", F.lit(1), last).alias("parent_path"), F.size("above").alias("depth"), "parent_tokens")


@dataclass
class Tree:
    """Sized nodes, and the texts of files: doc_set, file_ord, bodies by ord."""

    nodes: DataFrame
    texts: DataFrame

    @property
    def bodies(self) -> DataFrame:
        """The texts of sections by file_ord and ord."""
        return bodies(self.texts)

    def with_bodies(self) -> DataFrame:
        return with_bodies(self.nodes, self.bodies)


def sized_nodes(files: DataFrame, root_name: str = "Docs") -> DataFrame:
    """The nodes of ``sized_tree`` for those who read them once and no texts: neither is written."""
    return collapsed(parse(files, texts=False), root_name)


def sized_tree(files: DataFrame, root_name: str = "Docs") -> Tree:
    """Built, collapsed and sized. Nodes are written once: plans and renderers read them several times."""
    parsed = parse(files)
    return Tree(materialize(collapsed(parsed, root_name), "sized"), parsed.select("doc_set", "file_ord", "bodies"))
