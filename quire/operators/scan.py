"""Detectors of suspicious lines.

Fences here follow CommonMark: runs of three or more backticks or tildes, closed by a run of the same
character at least as long. Only lines that begin with such a run can change the state, so the fold is over those few; the lines
between two changes share a state. Everything is column functions on a file's own lines: no Python, no shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.arrays import folded
from quire.functions.text import cap, js_trim

#: What the detectors look for.
PHRASES = ("ignore previous instructions", "ignore all previous", "disregard the above", "forget your instructions", "you must now", "new instructions:")
TOOL_FENCES = ("tool", "function", "tool_call", "json tool")
SHELLS = "\\|\\s*(sudo\\s+)?(sh|bash|zsh|dash|ksh|fish)\\b"
ROLE = "(?i)^(system|assistant|user):"
ALWAYS, CUE = "(?i)\\b(always|every time)\\b", "(?i)\\b(this skill|before responding|before answering)\\b"
CURL = f"(?i)\\b(curl|wget)\\b.*{SHELLS}"
BASE64 = f"(?i)base64\\s+(-d|--decode)\\b.*{SHELLS}"
TOOL_NAME, TOOL_ARGUMENTS = '"name"\\s*:\\s*".+"', '"arguments"\\s*:'
EXCERPT = 200
RUN = "^(`{3,}|~{3,})"


def fence_changes(lines: Column) -> Column:
    """array<struct<at, opens, info>>: the lines (from 0) that open and close fences, by turns."""
    # a plain search first: hardly any line has three of these characters, and only those are trimmed and matched
    may = F.transform(lines, lambda x, i: F.when(F.contains(x, F.lit("```")) | F.contains(x, F.lit("~~~")), F.struct(i.alias("at"), x.alias("line"))))
    marked = F.transform(F.filter(may, lambda m: m.isNotNull()), lambda m: F.struct(m["at"].alias("at"), js_trim(m["line"]).alias("text")))
    marked = F.transform(F.filter(marked, lambda m: m["text"].rlike(RUN)), lambda m: F.struct(m["at"], m["text"], F.regexp_extract(m["text"], RUN, 1).alias("run")))

    def step(mark: Column, line: Column) -> tuple[Column, Column]:
        rest = F.substr(line["text"], F.length(line["run"]) + 1)
        closes = (mark != "") & (rest == "") & (F.left(line["run"], F.lit(1)) == F.left(mark, F.lit(1))) & (F.length(line["run"]) >= F.length(mark))
        opens = (mark == "") & ~(F.startswith(line["run"], F.lit("`")) & F.contains(rest, F.lit("`")))
        change = F.when(opens | closes, F.struct(line["at"].alias("at"), opens.alias("opens"), F.lower(js_trim(rest)).alias("info")))
        return change, F.when(opens, line["run"]).when(closes, "").otherwise(mark)

    return F.filter(folded(marked, F.lit(""), step), lambda c: c.isNotNull())


def fenced_lines(files: DataFrame) -> DataFrame:
    """A row a line (from 1) with its fence state: doc_set, relative_path, line_no, line, in_fence, block, opens, info, arguments. ``files`` has doc_set, relative_path, content."""
    rows = files.select("doc_set", "relative_path", F.explode(F.array(F.split(F.coalesce("content", F.lit("")), "\n", -1))).alias("lines"))
    # what is exploded is computed once, whatever refers to it
    rows = rows.select("*", F.explode(F.array(fence_changes(F.col("lines")))).alias("changes"))
    begins = F.concat(F.array(F.lit(0)), F.transform("changes", lambda c: c["at"]))
    ends = F.concat(F.transform("changes", lambda c: c["at"]), F.array(F.size("lines")))
    parts = F.arrays_zip(begins.alias("begin"), ends.alias("end"), F.concat(F.array(F.lit(None).cast("string")), F.transform("changes", lambda c: F.when(c["opens"], c["info"]))).alias("info"))
    # parts alternate: outside, inside, outside, ...
    own = lambda p: F.slice("lines", p["begin"] + 1, p["end"] - p["begin"])
    parts = F.transform(parts, lambda p, k: F.struct(p["begin"].alias("begin"), F.when(k % 2 == 1, ((k + 1) / 2).cast("int")).otherwise(0).alias("block"), p["info"].alias("info"), own(p).alias("own"), ((k % 2 == 1) & F.exists(own(p), lambda x: F.contains(x, F.lit('"arguments"')) & x.rlike(TOOL_ARGUMENTS))).alias("arguments")))

    def lines_of(p: Column) -> Column:
        return F.transform(p["own"], lambda x, j: F.struct(
            (p["begin"] + j + 1).alias("line_no"), x.alias("line"), (p["block"] > 0).alias("in_fence"), p["block"].alias("block"),
            ((p["block"] > 0) & (j == 0)).alias("opens"), F.when(j == 0, p["info"]).alias("info"), p["arguments"].alias("arguments"),
        ))

    return rows.select("doc_set", "relative_path", F.inline(F.flatten(F.transform(parts, lines_of))))


def excerpt(line: Column) -> Column:
    return cap(js_trim(line), EXCERPT)


def findings(lines: DataFrame) -> DataFrame:
    """doc_set, relative_path, line, rule, pattern, excerpt: a row for each rule that a line meets; two rules share a pattern.

    A line that names a tool counts if its block has an arguments key anywhere."""
    outside = ~F.col("in_fence")
    # plain searches go first: they find all that a pattern can match, and hardly any line passes them
    has = lambda *texts: reduce(lambda a, b: a | b, (F.contains("low", F.lit(t)) for t in texts))
    rules = [
        ("phrase", "instruction-override", has(*PHRASES)),
        ("role", "role-marker", outside & has("system:", "assistant:", "user:") & js_trim(F.col("line")).rlike(ROLE)),
        ("always", "always-invoke", outside & has("this skill", "before responding", "before answering") & F.col("line").rlike(ALWAYS) & F.col("line").rlike(CUE)),
        ("curl", "curl-pipe-shell", has("|") & has("curl", "wget") & F.col("line").rlike(CURL)),
        ("base64", "base64-decode", has("|") & has("base64") & F.col("line").rlike(BASE64)),
        ("tool-info", "tool-call-fence", F.col("opens") & F.col("info").isin(*TOOL_FENCES)),
        ("tool-json", "tool-call-fence", F.col("arguments") & F.col("line").rlike(TOOL_NAME)),
    ]
    met = F.array_compact(F.array(*[F.when(test, F.struct(F.lit(rule).alias("rule"), F.lit(label).alias("pattern"))) for rule, label, test in rules]))
    lines = lines.withColumn("low", F.lower("line"))
    return lines.select("doc_set", "relative_path", F.col("line_no").alias("line"), F.explode(met).alias("met"), excerpt(F.col("line")).alias("excerpt")).select("doc_set", "relative_path", "line", "met.rule", "met.pattern", "excerpt")


def scan(files: DataFrame) -> DataFrame:
    """All findings by line and pattern; one pass, no shuffle."""
    return findings(fenced_lines(files)).drop("rule")
