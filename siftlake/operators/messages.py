"""Texts for and from reviewers: prompts and their trimming, repair of answers, comments, and the functions that prompts quote.

Expressions and windows do the work; three text walks over characters or bytes are small Arrow functions."""

from __future__ import annotations

import base64
import gzip
import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

OPEN, CLOSE = "<<<CODE>>>", "<<<END_CODE>>>"
TRIMMED = "\n\n... [code context trimmed to fit the prompt budget] ...\n\n"
TRUNCATED = "\n\n[...TRUNCATED — context limit reached...]"
MAX_BODY_LINES = 20
# Words before a bracket that are no functions worth looking up.
SKIPPED_NAMES = (
    "if", "for", "while", "return", "not", "and", "or", "in", "is", "None", "True", "False", "len", "str", "int", "list", "dict", "set", "tuple", "print", "range", "type", "bool", "float", "bytes", "open",
    "super", "zip", "map", "filter", "sorted", "enumerate", "reversed", "hasattr", "getattr", "setattr", "isinstance", "issubclass",
)
# Fixed pattern: what may follow a quote that ends a JSON string.
_ENDS_STRING = re.compile(r'"[ \t\r\n]*(?:\Z|[}\]:]|,[ \t\r\n]*(?:\Z|["{\[\-tfn0-9}\]]))')
_STEP = re.compile(r'\\.|"', re.S)


def repair_quotes(text: str) -> str:
    """Escape quotes that stand inside JSON strings: those after which no JSON could go on. Valid JSON stays as it is."""
    inside = False

    def step(m: re.Match) -> str:
        nonlocal inside
        if m[0] != '"':
            return m[0]
        if inside and not _ENDS_STRING.match(text, m.start()):
            return '\\"'
        inside = not inside
        return '"'

    return _STEP.sub(step, text)


def repaired(text: Column) -> Column:
    @F.arrow_udf("string")
    def run(values: pa.Array) -> pa.Array:
        return _one_by_one(values, repair_quotes)

    return run(text)


def _one_by_one(values: pa.Array, make: Callable[[str], str]) -> pa.Array:
    """A text function over an Arrow batch; of the batch's texts only one at a time is a Python object."""
    return pa.array((make(x.as_py()) if x.is_valid else None for x in values), pa.string(), size=len(values))


def _whole(data: Column, starts: list[Column], sizes: list[Column]) -> Column:
    """The first of these slices of UTF-8 bytes that is whole text: a cut that falls inside a character moves by up to three bytes."""
    return F.coalesce(*[F.try_validate_utf8(F.substring(data, a, n).cast("string")) for a, n in zip(starts, sizes, strict=True)], F.lit(""))


def first_bytes(text: Column, size: Column) -> Column:
    """The first characters that fit `size` bytes."""
    sizes = [F.greatest(size - i, F.lit(0)) for i in range(4)]
    return F.when(F.octet_length(text) <= size, text).otherwise(_whole(text.cast("binary"), [F.lit(1)] * 4, sizes))


def last_bytes(text: Column, size: Column) -> Column:
    """The last characters that fit `size` bytes."""
    sizes = [F.greatest(size - i, F.lit(0)) for i in range(4)]
    return F.when(F.octet_length(text) <= size, text).otherwise(_whole(text.cast("binary"), [F.octet_length(text) - n + 1 for n in sizes], sizes))


def _let(body: Callable[[Column], Column], **values: Column) -> Column:
    """body(a struct of these values); each value is computed once, however often body names it."""
    return F.transform(F.array(F.struct(*[v.alias(k) for k, v in values.items()])), body)[0]


def trimmed(text: Column, most: int) -> Column:
    """A message of at most `most` bytes (no limit if not positive). Bytes go to its parts in this order: the end from the closing mark on, the head up to the opening mark, a
    note, and with what is left the code between the marks; a message without marks keeps its two ends in equal parts around the note."""
    if most <= 0:
        return text
    note = len(TRIMMED.encode())

    def joined(p: Column) -> Column:
        head, code, tail = p["head"], p["code"], p["tail"]
        for_tail = F.least(F.octet_length(tail), F.lit(most))
        for_head = F.least(F.octet_length(head), F.lit(most) - for_tail)
        left = F.lit(most - note) - F.octet_length(head) - F.octet_length(tail)
        return F.concat(first_bytes(head, for_head), F.when(left > 0, F.concat(first_bytes(code, left), F.lit(TRIMMED))).otherwise(""), last_bytes(tail, for_tail))

    def cut(m: Column) -> Column:
        text, a, b = m["text"], m["a"], m["b"]
        at, half = a + len(OPEN), F.lit(max(0, most - note) // 2)
        parts = _let(joined, head=F.substring(text, F.lit(1), at - 1), code=F.substring(text, at, F.greatest(b - at, F.lit(0))), tail=F.substring(text, b, F.length(text)))
        ends = _let(lambda x: last_bytes(x["both"], F.lit(most)), both=F.concat(first_bytes(text, half), F.lit(TRIMMED), last_bytes(text, half)))
        return F.when((a > 0) & (b >= a), parts).otherwise(ends)

    return F.when(F.octet_length(text) <= most, text).otherwise(_let(cut, text=text, a=F.instr(text, OPEN), b=F.instr(text, CLOSE)))


def gzip_base64(text: Column) -> Column:
    @F.arrow_udf("string")
    def run(values: pa.Array) -> pa.Array:
        return _one_by_one(values, lambda x: base64.b64encode(gzip.compress(x.encode(), 9, mtime=0)).decode())

    return run(text)


def adapted(text: Column, system_chars: int, max_tokens: int, scale: float = 1.0) -> Column:
    """A message whose code block is cut (to 200 characters at least) when four characters a token pass the context window."""
    budget = int(max_tokens * scale)
    room = max(200, budget * 4 - system_chars - 500)
    a, b = F.instr(text, OPEN), F.instr(text, CLOSE)
    start = a + len(OPEN)
    cut = F.concat(F.substring(text, F.lit(1), start - 1), F.substring(text, start, F.least(F.lit(room), b - start)), F.lit(TRUNCATED), F.substring(text, b, F.length(text)))
    over = F.floor((F.length(text) + system_chars) / 4) > budget
    return F.when(over & (a > 0) & (b > 0), cut).otherwise(text)


def user_message(paths: DataFrame, summary: DataFrame, snippet: DataFrame | None, context: DataFrame) -> DataFrame:
    """pr_id, message: summary, numbered data-flow paths, and the code between its marks.

    paths: pr_id, sink_line, sink, source_line, source, path, sanitizer; summary: pr_id, files, insertions, deletions; snippet: pr_id, snippet (None: the summary has
    it, once for each change); context: pr_id, path, nth, text."""
    order = W.partitionBy("pr_id").orderBy("path", "sink_line", "source_line")
    note = F.when(F.col("sanitizer").isNotNull(), F.concat(F.lit("[SANITIZED: "), "sanitizer", F.lit("]"))).otherwise(F.lit("[NO SANITIZER DETECTED]"))
    one = F.concat(F.lit("DATA FLOW PATH "), F.col("nth").cast("string"), F.lit(":\n  SOURCE  ["), "source", F.lit("] @ "), "path", F.lit(":"), F.col("source_line").cast("string"), F.lit("\n  SINK    ["), "sink", F.lit("] @ "), "path", F.lit(":"), F.col("sink_line").cast("string"), F.lit("\n  "), note)
    flows = paths.withColumn("nth", F.row_number().over(order)).withColumn("one", one).groupBy("pr_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", "one"))), lambda x: x["one"]), "\n").alias("flows"))
    around = context.groupBy("pr_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", "nth", "text"))), lambda x: x["text"]), "\n").alias("around"))
    # a change without an id meets nothing in joins, so its snippet stays out either way
    rows = summary.join(snippet, "pr_id", "left") if snippet is not None else summary.withColumn("snippet", F.when(F.col("pr_id").isNotNull(), F.col("snippet")))
    rows = rows.join(flows, "pr_id", "left").join(around, "pr_id", "left")
    head = F.concat(F.lit("DIFF SUMMARY: "), F.col("files").cast("string"), F.lit(" files, +"), F.col("insertions").cast("string"), F.lit(" -"), F.col("deletions").cast("string"), F.lit("\n\n"))
    body = F.coalesce("flows", F.lit("No explicit data-flow paths extracted. Analyze the diff heuristically."))
    code = F.concat(F.lit(f"\n{OPEN}\n"), F.coalesce("snippet", F.lit("")), F.lit("\n"), F.coalesce("around", F.lit("")), F.lit(f"\n{CLOSE}\nReturn the JSON verdict schema exactly."))
    return rows.select("pr_id", F.concat(head, body, code).alias("message"))


def coverage_comment(coverage: DataFrame, skips: DataFrame) -> DataFrame:
    """pr_id, comment: files analysed and left out, and why (reasons by name)."""
    rows = coverage.join(skips, "pr_id", "left")
    reasons = F.array_join(F.transform(F.split("skips", ","), lambda s: F.concat(F.lit("  - `"), F.regexp_replace(s, "=", "`: "))), "\n")
    text = F.concat(F.lit("- Files changed: **"), F.col("total").cast("string"), F.lit("**\n- Files analyzed: **"), F.col("analyzed").cast("string"), F.lit("**\n- Files skipped: **"), F.col("skipped").cast("string"), F.lit("**\n- Skip reasons:\n"), F.coalesce(reasons, F.lit("  - (none)")))
    return rows.select("pr_id", text.alias("comment"))


def tainted_names(edges: DataFrame, sinks: DataFrame) -> DataFrame:
    """pr_id, path, name: functions called in assignments, and the last part of each sink's function; sorted sets."""
    calls = edges.select("pr_id", "path", F.explode(F.regexp_extract_all(F.concat("from_var", F.lit(" "), "to_var"), F.lit(r"\b([a-zA-Z_]\w*)\s*\("), F.lit(1))).alias("name")).filter(~F.col("name").isin(*SKIPPED_NAMES))
    own = sinks.select("pr_id", "path", F.substring_index(F.trim(F.substring_index("function", "(", 1)), ".", -1).alias("name"))
    return calls.union(own).filter(F.length("name") > 2).distinct()


def imported_names(rows: DataFrame) -> DataFrame:
    """pr_id, path, name, module: names that Python and script files import from modules (script modules only if relative)."""
    py = F.regexp_extract("text", r"^\s*from\s+([\w.]+)\s+import\s+\(?([\w\s,]+)", 1)
    js = F.regexp_extract("text", r"(?:import\s+\{?([\w\s,]+)\}?\s+from|(?:const|let|var)\s+\{?([\w\s,]+)\}?\s*=\s*require\()\s*['\"](\.{1,2}/[^'\"]+)['\"]", 3)
    py_names = F.regexp_extract("text", r"^\s*from\s+([\w.]+)\s+import\s+\(?([\w\s,]+)", 2)
    js_names = F.concat(*[F.regexp_extract("text", r"(?:import\s+\{?([\w\s,]+)\}?\s+from|(?:const|let|var)\s+\{?([\w\s,]+)\}?\s*=\s*require\()\s*['\"](\.{1,2}/[^'\"]+)['\"]", i) for i in (1, 2)])
    hit = rows.withColumns({"module": F.when(py != "", py).when(js != "", js), "names": F.when(py != "", py_names).otherwise(js_names)}).filter("module IS NOT NULL")
    names = F.transform(F.split("names", ","), lambda x: F.regexp_extract(x, r"^\s*(\w+)", 1))
    return hit.select("pr_id", "path", F.explode(names).alias("name"), "module").filter("name <> ''")


def function_bodies(rows: DataFrame, most: int = MAX_BODY_LINES) -> DataFrame:
    """pr_id, path, name, body: each function from its first line to the end of its block, `most` following lines at most.

    A Python or Ruby block ends before the first line that is indented no more; one with braces ends where they are balanced again."""
    text = F.col("text")
    indented = F.col("language").isin("python", "ruby")
    by_indent = F.regexp_extract(text, r"^\s*(?:async\s+)?def\s+(\w+)\s*\(", 1)
    by_brace = F.coalesce(*[F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in (r"\bfunction\s+(\w+)\s*\(", r"\b(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s+)?(?:function\s*)?\(", r"\bfunc\s+(?:\([^)]+\)\s+)?(\w+)\s*\(", r"\b(?:public|private|protected|static)\s+(?:static\s+)?\w[\w<>\[\]]*\s+(\w+)\s*\(")])
    indent = F.length(text) - F.length(F.ltrim(text))
    heads = rows.select("pr_id", "path", F.when(indented, F.nullif(by_indent, F.lit(""))).otherwise(by_brace).alias("name"), F.col("line_no").alias("head"), indent.alias("head_indent"), indented.alias("indented")).filter("name IS NOT NULL")
    heads = heads.withColumn("line_no", F.explode(F.sequence("head", F.col("head") + most)))
    bare = F.regexp_replace(text, r"([\"']).*?\1", "")
    braces = F.length(F.regexp_replace(bare, r"[^{]", "")) - F.length(F.regexp_replace(bare, r"[^}]", ""))
    lines = rows.select("pr_id", "path", "line_no", "text", braces.alias("braces"), indent.alias("indent"), (F.trim(text) == "").alias("blank"))
    block = heads.join(lines, ["pr_id", "path", "line_no"])
    own = W.partitionBy("pr_id", "path", "name", "head").orderBy("line_no").rowsBetween(W.unboundedPreceding, W.currentRow)
    after = F.col("line_no") > F.col("head")
    block = block.withColumn("depth", F.sum("braces").over(own))
    ends = F.when(F.col("indented"), after & ~F.col("blank") & (F.col("indent") <= F.col("head_indent"))).otherwise(after & (F.col("depth") <= 0))
    block = block.withColumn("ended", F.sum(ends.cast("int")).over(own))
    kept = block.filter(F.when(F.col("indented"), F.col("ended") == 0).otherwise((F.col("ended") == 0) | ((F.col("ended") == 1) & ends)))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"]), "\n")
    return kept.groupBy("pr_id", "path", "name", "head").agg(body.alias("body"))
