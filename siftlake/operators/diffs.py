"""Unified diffs as relations: files, hunks, added lines, chunks. Every step keeps explicit order columns; pr_id is the one partition key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from siftlake.operators.messages import first_bytes

MAX_HUNK_LINES, LARGE_HUNK_LINES, MAX_CHUNKS = 150, 120, 20
LARGE_FILES, LARGE_ADDED, LARGE_BYTES = 25, 1000, 500_000
SNIPPET_LINES = 200
#: Test files of the chunked mode; it knows fewer suffixes than classification and needs a slash before the folder.
CHUNK_TEST_FILE = r"(?i)(^|/)(test_[^/]+|[^/]+_test|[^/]+\.test|[^/]+\.spec)\.(py|js|ts|go|java|rb|cs|php)$|/(tests?|spec|__tests__|test_helpers?)/"


def _by_pr(*keys: str) -> WindowSpec:
    return W.partitionBy("pr_id", *keys).orderBy("pos")


def _so_far(*keys: str) -> WindowSpec:
    return _by_pr(*keys).rowsBetween(W.unboundedPreceding, W.currentRow)


def _parts(raw_diff: str) -> Column:
    parts = F.split(F.coalesce(raw_diff, F.lit("")), "\r\n|\n|\r", -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def lines(prs: DataFrame) -> DataFrame:
    """prs (pr_id, raw_diff) to pr_id, pos (from 0), line. An empty last line is no line."""
    return prs.select("pr_id", F.posexplode(_parts("raw_diff")).alias("pos", "line"))


def files(rows: DataFrame) -> DataFrame:
    """Lines with file_ord and path; lines before the first header are dropped."""
    header = F.col("line").startswith("diff --git ")
    rows = rows.withColumn("file_ord", F.sum(F.when(header, 1).otherwise(0)).over(_so_far())).filter("file_ord > 0")
    named = F.regexp_extract("line", " b/(.+)$", 1)
    last = F.regexp_replace(F.element_at(F.split("line", " "), -1), "^[b/]+", "")
    path = F.when(header, F.when(named != "", named).otherwise(last))
    return rows.withColumn("path", F.first(path, ignorenulls=True).over(W.partitionBy("pr_id", "file_ord").orderBy("pos").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))


def file_chunks(prs: DataFrame) -> DataFrame:
    """pr_id, file_ord, path, n_lines, chunk: the text of each file's part."""
    rows = files(lines(prs))
    return rows.groupBy("pr_id", "file_ord", "path").agg(F.count(F.lit(1)).alias("n_lines"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n").alias("chunk"))


def changed_paths(prs: DataFrame) -> DataFrame:
    """pr_id, ord, path: the files of each change, once each in order of first sight; where no header is found, those that `+++ b/` lines name."""
    rows = lines(prs)
    found = files(rows).groupBy("pr_id", "path").agg(F.min("pos").alias("pos"))
    named = F.regexp_extract("line", r"^\+\+\+ b/(.+)$", 1)
    bare = rows.select("pr_id", "pos", named.alias("path")).filter("path <> ''").join(found.select("pr_id").distinct(), "pr_id", "left_anti")
    every = found.select("pr_id", "path", "pos").union(bare.groupBy("pr_id", "path").agg(F.min("pos").alias("pos")))
    return every.select("pr_id", (F.row_number().over(_by_pr()) - 1).alias("ord"), "path")


def last_by_path(chunks: DataFrame) -> DataFrame:
    """One row for each path: the last part's text at the first part's place."""
    return chunks.groupBy("pr_id", "path").agg(F.min("file_ord").alias("first_ord"), F.max_by("chunk", "file_ord").alias("chunk"))


def added_lines(rows: DataFrame, *keys: str) -> DataFrame:
    """pr_id, path, line_no, text of added lines, numbered in the new file. Every line that does not start with a minus moves the number on.

    With `keys`, such as the chunk, each of these parts is read as a diff of its own."""
    line = F.col("line")
    path = F.when(line.startswith("+++ b/"), F.substring(line, 7, 1_000_000))
    hunk = line.startswith("@@ ")
    start = F.when(hunk, F.coalesce(F.expr(r"try_cast(regexp_extract(line, '\\+([0-9]+)', 1) AS INT)"), F.lit(0)))
    so_far = _so_far(*keys)
    rows = rows.withColumns({"own_path": F.last(path, ignorenulls=True).over(so_far), "start": F.last(start, ignorenulls=True).over(so_far), "hunk": F.sum(F.when(hunk, 1).otherwise(0)).over(so_far)})
    added = line.startswith("+") & ~line.startswith("+++")
    moves = ~hunk & ~line.startswith("+++ b/") & ~line.startswith("-")
    inside = _so_far(*keys, "hunk")
    rows = rows.withColumn("line_no", F.coalesce("start", F.lit(0)) + F.sum(F.when(moves, 1).otherwise(0)).over(inside) - 1)
    return rows.filter(added & F.col("own_path").isNotNull()).select("pr_id", *keys, F.col("own_path").alias("path"), "line_no", F.substring(line, 2, 1_000_000).alias("text"))


def summary(rows: DataFrame) -> DataFrame:
    line = F.col("line")
    plus, minus = line.startswith("+") & ~line.startswith("+++"), line.startswith("-") & ~line.startswith("---")
    return rows.groupBy("pr_id").agg(F.count_if(line.startswith("diff --git ")).alias("files"), F.count_if(plus).alias("insertions"), F.count_if(minus).alias("deletions"))


def snippet(rows: DataFrame, limit: int = SNIPPET_LINES) -> DataFrame:
    """The first lines that show changes, joined in order."""
    line = F.col("line")
    shown = rows.filter(line.startswith("+") | line.startswith("-") | line.startswith("@@") | line.startswith("diff"))
    first = shown.withColumn("nth", F.row_number().over(_by_pr())).filter(F.col("nth") <= limit)
    return first.groupBy("pr_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n").alias("snippet"))


def heads(prs: DataFrame, limit: int = SNIPPET_LINES) -> DataFrame:
    """pr_id, files, insertions, deletions, snippet: `summary` and `snippet` of prs (pr_id, raw_diff) in one pass over whole diffs, without a row for each line.

    Rows of one pr_id are one change. A change without lines has no row, one without shown lines an empty snippet."""
    # through a generator, so that the optimiser does not copy the split to every field
    every = prs.select("pr_id", F.explode(F.array(_parts("raw_diff"))).alias("lines")).filter(F.size("lines") > 0)
    count = lambda keep: F.size(F.filter("lines", keep))
    plus = lambda x: x.startswith("+") & ~x.startswith("+++")
    minus = lambda x: x.startswith("-") & ~x.startswith("---")
    placed = F.transform("lines", lambda x, i: F.struct(i.alias("pos"), x.alias("line")))
    shown = F.filter(placed, lambda x: x["line"].startswith("+") | x["line"].startswith("-") | x["line"].startswith("@@") | x["line"].startswith("diff"))
    rows = every.select("pr_id", count(lambda x: x.startswith("diff --git ")).alias("files"), count(plus).alias("insertions"), count(minus).alias("deletions"), F.slice(shown, 1, limit).alias("shown"))
    first = F.slice(F.array_sort(F.flatten(F.collect_list("shown"))), 1, limit)
    return rows.groupBy("pr_id").agg(F.sum("files").alias("files"), F.sum("insertions").alias("insertions"), F.sum("deletions").alias("deletions"), F.array_join(F.transform(first, lambda x: x["line"]), "\n").alias("snippet"))


def large(prs: DataFrame, max_files: int = LARGE_FILES, max_added: int = LARGE_ADDED, max_bytes: int = LARGE_BYTES) -> DataFrame:
    """pr_id, is_large, reasons (text), mode: large, chunked (over 100 line feeds) or small."""
    counts = summary(lines(prs))
    rows = prs.join(counts, "pr_id", "left").fillna(0, ["files", "insertions"]).withColumn("bytes", F.octet_length(F.coalesce("raw_diff", F.lit(""))))
    reason = lambda name, value, most: F.when(value > most, F.concat(F.lit(f"{name}="), value.cast("string"), F.lit(f" > {most}")))
    reasons = F.array_compact(F.array(reason("changed_files", F.col("files"), max_files), reason("added_lines", F.col("insertions"), max_added), reason("total_diff_bytes", F.col("bytes"), max_bytes)))
    feeds = F.length("raw_diff") - F.length(F.replace("raw_diff", F.lit("\n"), F.lit("")))
    return rows.select("pr_id", (F.size(reasons) > 0).alias("is_large"), F.array_join(reasons, "; ").alias("reasons"), F.when(F.size(reasons) > 0, "large").when(feeds > 100, "chunked").otherwise("small").alias("mode"))


def hunk_bins(rows: DataFrame, max_lines: int = MAX_HUNK_LINES) -> DataFrame:
    """pr_id, file_ord, path, hunk, n_lines, bin: hunks packed in order, a new bin where the next hunk would pass max_lines.

    Packing depends on all earlier hunks of the file, so it is a fold over the file's hunk sizes."""
    in_file = W.partitionBy("pr_id", "file_ord").orderBy("pos").rowsBetween(W.unboundedPreceding, W.currentRow)
    parts = files(rows).withColumn("hunk", F.sum(F.when(F.col("line").startswith("@@"), 1).otherwise(0)).over(in_file)).filter("hunk > 0")
    sizes = parts.groupBy("pr_id", "file_ord", "path", "hunk").agg(F.count(F.lit(1)).cast("int").alias("n_lines"))
    per_file = sizes.groupBy("pr_id", "file_ord", "path").agg(F.array_sort(F.collect_list(F.struct("hunk", "n_lines"))).alias("hunks"))
    start = F.struct(F.lit(0).alias("filled"), F.lit(0).alias("bin"), F.array().cast("array<int>").alias("bins"))

    def step(state: Column, h: Column) -> Column:
        full = (state["filled"] > 0) & (state["filled"] + h["n_lines"] > max_lines)
        now = F.when(full, state["bin"] + 1).otherwise(state["bin"])
        return F.struct(F.when(full, h["n_lines"]).otherwise(state["filled"] + h["n_lines"]).alias("filled"), now.alias("bin"), F.concat(state["bins"], F.array(now)).alias("bins"))

    folded = per_file.withColumn("bins", F.aggregate("hunks", start, step)["bins"])
    zipped = folded.select("pr_id", "file_ord", "path", F.explode(F.arrays_zip("hunks", "bins")).alias("z"))
    return zipped.select("pr_id", "file_ord", "path", F.col("z.hunks.hunk").alias("hunk"), F.col("z.hunks.n_lines").alias("n_lines"), F.col("z.bins").alias("bin"))


def chunk_plan(rows: DataFrame, max_chunks: int = MAX_CHUNKS, max_lines: int = MAX_HUNK_LINES) -> DataFrame:
    """Chunks of the chunked mode in order, the first max_chunks of each change: pr_id, file_ord, path, bin, n_lines, placeholder, chunk.

    A test file is one placeholder; a file without hunks is one chunk of no lines."""
    every = files(rows).select("pr_id", "file_ord", "path").distinct()
    bins = hunk_bins(rows, max_lines).groupBy("pr_id", "file_ord", "bin").agg(F.sum("n_lines").alias("n_lines"))
    is_test = F.coalesce(F.col("path").rlike(CHUNK_TEST_FILE), F.lit(False))
    code = every.filter(~is_test).join(bins, ["pr_id", "file_ord"], "left").select("pr_id", "file_ord", "path", F.coalesce("bin", F.lit(0)).alias("bin"), F.coalesce("n_lines", F.lit(0).cast("long")).alias("n_lines"), F.lit(False).alias("placeholder"))
    tests = every.filter(is_test).select("pr_id", "file_ord", "path", F.lit(0).alias("bin"), F.lit(0).cast("long").alias("n_lines"), F.lit(True).alias("placeholder"))
    place = F.row_number().over(W.partitionBy("pr_id").orderBy("file_ord", "bin"))
    return code.unionByName(tests).withColumn("chunk", place).filter(F.col("chunk") <= max_chunks)


def chunk_lines(rows: DataFrame, max_chunks: int = MAX_CHUNKS, max_lines: int = MAX_HUNK_LINES) -> DataFrame:
    """pr_id, chunk, pos, line: the lines of each chunk of the plan, the file's header before its hunks. Placeholders have none."""
    in_file = _so_far("file_ord")
    parts = files(rows).withColumn("hunk", F.sum(F.when(F.col("line").startswith("@@"), 1).otherwise(0)).over(in_file))
    plan = chunk_plan(rows, max_chunks, max_lines).filter(~F.col("placeholder")).select("pr_id", "file_ord", "bin", "chunk")
    head = parts.filter("hunk = 0").join(plan, ["pr_id", "file_ord"])
    body = parts.filter("hunk > 0").join(hunk_bins(rows, max_lines).select("pr_id", "file_ord", "hunk", "bin"), ["pr_id", "file_ord", "hunk"]).join(plan, ["pr_id", "file_ord", "bin"])
    return head.select("pr_id", "chunk", "pos", "line").unionByName(body.select("pr_id", "chunk", "pos", "line"))


def _joined(order: Column, line: str = "line") -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("pos"), F.col(line).alias("line")))), lambda x: x["line"]), "\n")


def chunk_texts(rows: DataFrame, max_lines: int = MAX_HUNK_LINES) -> DataFrame:
    """pr_id, file_ord, path, bin, text: the header of each file (its lines before the first hunk) in front of each of its bins of hunks; a file without hunks is one whole text."""
    in_file = W.partitionBy("pr_id", "file_ord").orderBy("pos").rowsBetween(W.unboundedPreceding, W.currentRow)
    parts = files(rows).withColumn("hunk", F.sum(F.when(F.col("line").startswith("@@"), 1).otherwise(0)).over(in_file))
    head = parts.filter("hunk = 0").groupBy("pr_id", "file_ord", "path").agg(_joined(F.col("pos")).alias("head"))
    bins = hunk_bins(rows, max_lines).select("pr_id", "file_ord", "hunk", "bin")
    body = parts.filter("hunk > 0").join(bins, ["pr_id", "file_ord", "hunk"]).groupBy("pr_id", "file_ord", "path", "bin").agg(_joined(F.col("pos")).alias("body"))
    both = head.join(body, ["pr_id", "file_ord", "path"], "full")
    return both.select("pr_id", "file_ord", "path", F.coalesce("bin", F.lit(0)).alias("bin"), F.concat_ws("\n", "head", "body").alias("text"))


def planned_texts(rows: DataFrame, max_chunks: int = MAX_CHUNKS) -> DataFrame:
    """The chunk plan with its texts; a test file's placeholder has a null text."""
    return chunk_plan(rows, max_chunks).join(chunk_texts(rows), ["pr_id", "file_ord", "path", "bin"], "left").withColumn("text", F.when(~F.col("placeholder"), F.col("text")))


def trim(rows: DataFrame, max_bytes: int) -> DataFrame:
    """pr_id, file_ord, path, text: each file's part within max_bytes: all of it if it fits; else its header through the first hunk line, then whole lines while they fit;
    and where the header alone does not fit, as many of its first characters as do."""
    in_file = W.partitionBy("pr_id", "file_ord").orderBy("pos").rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = files(rows).withColumns({"used": F.sum(F.octet_length("line") + 1).over(in_file) - 1, "hunks": F.sum(F.when(F.col("line").startswith("@@"), 1).otherwise(0)).over(in_file)})
    head = (F.col("hunks") == 0) | ((F.col("hunks") == 1) & F.col("line").startswith("@@"))
    cut = rows.groupBy("pr_id", "file_ord", "path").agg(_joined(F.col("pos")).alias("whole"), F.max(F.when(head, F.col("used"))).alias("head"), F.max(F.when(F.col("used") <= max_bytes, F.col("used"))).alias("fit"))
    text = F.when(F.col("head") >= max_bytes, first_bytes(F.col("whole"), F.lit(max_bytes))).otherwise(first_bytes(F.col("whole"), F.col("fit")))
    return cut.select("pr_id", "file_ord", "path", F.when(F.octet_length("whole") <= max_bytes, F.col("whole")).otherwise(text).alias("text"))


def context(added: DataFrame, contents: DataFrame, around: int = 25, most: int = 120) -> DataFrame:
    """Numbered lines of the new files around added lines, first `most` of each file: pr_id, path, nth, text."""
    parts = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    parts = F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    all_lines = contents.select("pr_id", "path", F.posexplode(parts).alias("at", "line")).withColumn("line_no", F.col("at") + 1)
    # no line stands before the first
    low, high = F.greatest(F.col("line_no") - around, F.lit(1)), F.col("line_no") + around
    wanted = added.filter(high >= 1).select("pr_id", "path", F.explode(F.sequence(low, high)).alias("line_no")).distinct()
    rows = all_lines.join(wanted, ["pr_id", "path", "line_no"], "left_semi")
    nth = F.row_number().over(W.partitionBy("pr_id", "path").orderBy("line_no"))
    return rows.withColumn("nth", nth).filter(F.col("nth") <= most).select("pr_id", "path", "nth", F.format_string("%4d | %s", F.col("line_no"), F.col("line")).alias("text"))
