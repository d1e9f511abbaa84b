"""Queries over changed paths and diffs, and the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlake.operators import classify as c
from siftlake.operators import diffs as d

#: Path shapes that page ids are put into: each rule of classification, and names that only look alike.
SHAPES = ("src/auth/login_{}.py", "docs/guide_{}.html", "dist/package-lock_{}.json", "web/public/api-icon_{}.svg", "src/api/user_file_{}.ts", "tests/db_{}.py", "lib/test_query_{}.go", "web/app_{}.min.js", "src/authors/pathology_{}.java", "requirements_{}.txt", "svc/{}/package-lock.json", "README.{}", "src/sql/query/db/session/jwt/token_{}.rb", "pkg/spec/{}.tsx", "   ", "src/webhook/upload.config.{}.env.PHP")
SHAPE_SQL = f"SELECT CAST(page_id % 9 AS BIGINT) AS pr_id, CAST(page_id AS INTEGER) AS ord, replace([{', '.join(repr(s) for s in SHAPES)}][page_id % {len(SHAPES)} + 1], '{{}}', CAST(page_id AS VARCHAR)) AS path FROM pages"


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("page_id")
    shape = F.element_at(F.array(*map(F.lit, SHAPES)), (i % len(SHAPES) + 1).cast("int"))
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select((i % 9).cast("long").alias("pr_id"), i.cast("int").alias("ord"), F.replace(shape, F.lit("{}"), i.cast("string")).alias("path"))


def diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A diff made of each document's lines: a file every six lines, a hunk every three, and lines of all kinds."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("pr_id"), "text")
    name = lambda i: F.concat(F.when(i % 4 == 3, "tests/t").otherwise("src/f"), i.cast("string"), F.lit(".py"))

    def one(x, i):
        head = F.concat(F.lit("diff --git a/"), name(i), F.lit(" b/"), name(i), F.lit("\n--- a/"), name(i), F.lit("\n+++ b/"), name(i), F.lit("\n"))
        hunk = F.concat(F.lit("@@ -1,9 +"), (i * 2 + 1).cast("string"), F.lit(",9 @@\n"))
        sign = F.element_at(F.array(*map(F.lit, (" ", "+", "-", "+", "\\ "))), i % 5 + 1)
        return F.concat(F.when(i % 6 == 0, head).otherwise(""), F.when(i % 3 == 0, hunk).otherwise(""), sign, x)

    return docs.select("pr_id", F.array_join(F.transform(F.split("text", "\n", -1), one), "\n").alias("raw_diff"))


DIFF_SQL = """SELECT pr_id, string_agg(
  CASE WHEN i % 6 = 0 THEN 'diff --git a/' || p || ' b/' || p || chr(10) || '--- a/' || p || chr(10) || '+++ b/' || p || chr(10) ELSE '' END
  || CASE WHEN i % 3 = 0 THEN '@@ -1,9 +' || CAST(i * 2 + 1 AS VARCHAR) || ',9 @@' || chr(10) ELSE '' END
  || [' ', '+', '-', '+', '\\ '][i % 5 + 1] || x, chr(10) ORDER BY i) AS raw_diff
FROM (SELECT doc_id AS pr_id, i, x, CASE WHEN i % 4 = 3 THEN 'tests/t' ELSE 'src/f' END || CAST(i AS VARCHAR) || '.py' AS p
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents)) GROUP BY pr_id"""
LINES_SQL = "SELECT * FROM (SELECT pr_id, CAST(generate_subscripts(string_split(raw_diff, chr(10)), 1) - 1 AS INTEGER) AS pos, unnest(string_split(raw_diff, chr(10))) AS line, len(string_split(raw_diff, chr(10))) AS n FROM diffs) WHERE NOT (line = '' AND pos = n - 1)"
FILES_SQL = "SELECT *, regexp_extract(first(line) OVER (PARTITION BY pr_id, file_ord ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), ' b/(.+)$', 1) AS path FROM (SELECT pr_id, pos, line, sum(CASE WHEN line LIKE 'diff --git %' THEN 1 ELSE 0 END) OVER (PARTITION BY pr_id ORDER BY pos) AS file_ord FROM lines) WHERE file_ord > 0"

low = "lower(path)"
base = f"regexp_extract({low}, '[^/]*$')"
overlap = lambda names: f"list_has_any(string_split({low}, '/'), {list(names)})"
suffix = lambda names: "(" + " OR ".join(f"{low} LIKE '%{s}'" for s in names) + ")"
KEYWORD_SQL = "[" + ", ".join(f"{{'k': '{k}', 'w': {w}}}" for w, ks in c.KEYWORDS for k in ks) + "]"
CLASSIFIED_SQL = f"""SELECT pr_id, ord, path,
  CASE WHEN r IS NULL THEN 'analyze' WHEN r = 'test_file' THEN 'deprioritize' WHEN r = 'lockfile' THEN 'dependency_only' ELSE 'skip' END AS decision,
  CAST(CASE WHEN r IS NULL THEN least(100, 25 + coalesce(list_sum(list_transform(ks, lambda x: x.w)), 0)) WHEN r = 'test_file' THEN 10 ELSE 0 END AS INTEGER) AS risk_score,
  CASE WHEN r IS NULL THEN list_concat(['application_code'], list_transform(ks, lambda x: 'keyword:' || x.k)) ELSE [r] END AS reasons,
  coalesce(map_extract(MAP {c.LANGUAGES}, regexp_extract({low}, '\\.[^./]+$'))[1], 'python') AS language
FROM (SELECT *, list_filter({KEYWORD_SQL}, lambda x: list_contains(regexp_split_to_array({low}, '[^a-z0-9]+'), x.k)) AS ks,
  CASE WHEN path IS NULL OR trim(path) = '' THEN 'empty_path'
    WHEN {suffix(c.DOC_SUFFIXES)} OR regexp_replace({base}, '\\.[^.]*$', '') IN {c.DOC_BASENAMES} OR {overlap(c.DOC_SEGMENTS)} THEN 'docs'
    WHEN regexp_matches(path, '{c.MINIFIED}') THEN 'minified' WHEN {suffix(c.ASSET_SUFFIXES)} THEN 'static_asset' WHEN {overlap(c.GENERATED_SEGMENTS)} THEN 'generated'
    WHEN {base} IN {c.LOCKFILES} THEN 'lockfile' WHEN regexp_matches(path, '{c.TEST_FILE}') OR {overlap(c.TEST_SEGMENTS)} THEN 'test_file' END AS r FROM paths)"""
SELECTED_SQL = """SELECT *, CASE WHEN NOT selected THEN CASE WHEN reasons[1] = 'lockfile' THEN 'dependency_only' WHEN reasons[1] IN ('docs', 'generated', 'static_asset', 'minified') THEN reasons[1] WHEN decision = 'skip' THEN 'other' WHEN decision = 'deprioritize' THEN 'deprioritized_no_budget' ELSE 'budget_exhausted' END END AS bucket
FROM (SELECT *, coalesce(place <= 5, false) AS selected FROM (SELECT *, CASE WHEN decision IN ('analyze', 'deprioritize') THEN CAST(row_number() OVER (PARTITION BY pr_id, decision IN ('analyze', 'deprioritize') ORDER BY CASE decision WHEN 'analyze' THEN 0 ELSE 1 END, risk_score DESC, ord) AS INTEGER) END AS place FROM classified))"""
CALLS_SQL = "SELECT pr_id, place, chunk, CAST(call AS INTEGER) AS call FROM (SELECT *, row_number() OVER (PARTITION BY pr_id ORDER BY place, chunk) AS call FROM (SELECT pr_id, place, CAST(unnest(range(ord % 7)) AS INTEGER) AS chunk FROM selected WHERE selected) WHERE chunk < 5) WHERE call <= 8"


def classified(spark, sf_dir):
    return c.classify(paths(spark, sf_dir))


def selected(spark, sf_dir):
    return c.select_files(classified(spark, sf_dir), 5)


def calls(spark, sf_dir):
    chunks = selected(spark, sf_dir).filter("selected AND ord % 7 > 0").select("pr_id", "place", F.explode(F.expr("sequence(0, ord % 7 - 1)")).alias("chunk"))
    return c.cap_chunks(chunks, 5, 8)


def diff_lines(spark, sf_dir):
    return d.lines(diffs(spark, sf_dir))


def contents(spark, sf_dir):
    """The document itself stands in for the text of its first file."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select(F.col("doc_id").alias("pr_id"), F.lit("src/f0.py").alias("path"), "text")


HUNKS_SQL = "SELECT pr_id, CAST(file_ord AS BIGINT) AS file_ord, path, CAST(hunk AS BIGINT) AS hunk, CAST(count(*) AS INTEGER) AS n_lines FROM (SELECT *, sum(CASE WHEN line LIKE '@@%' THEN 1 ELSE 0 END) OVER (PARTITION BY pr_id, file_ord ORDER BY pos) AS hunk FROM files) WHERE hunk > 0 GROUP BY ALL"
BINS_SQL = "SELECT * FROM (WITH RECURSIVE w AS (SELECT *, n_lines AS filled, 0 AS bin FROM hunks WHERE hunk = 1 UNION ALL SELECT h.*, CASE WHEN w.filled + h.n_lines > {n} THEN h.n_lines ELSE w.filled + h.n_lines END, CASE WHEN w.filled + h.n_lines > {n} THEN w.bin + 1 ELSE w.bin END FROM w JOIN hunks h ON h.pr_id = w.pr_id AND h.file_ord = w.file_ord AND h.hunk = w.hunk + 1) SELECT pr_id, file_ord, path, hunk, n_lines, bin FROM w)"
ADDED_SQL = """SELECT pr_id, own_path AS path, CAST(coalesce(start, 0) + sum(moves) OVER (PARTITION BY pr_id, hunk ORDER BY pos) - 1 AS BIGINT) AS line_no, line, added FROM (
SELECT pr_id, pos, line, last(CASE WHEN line LIKE '+++ b/%' THEN substr(line, 7) END IGNORE NULLS) OVER w AS own_path, last(CASE WHEN line LIKE '@@ %' THEN CAST(regexp_extract(line, '\\+([0-9]+)', 1) AS INTEGER) END IGNORE NULLS) OVER w AS start,
sum(CASE WHEN line LIKE '@@ %' THEN 1 ELSE 0 END) OVER w AS hunk, line LIKE '+%' AND NOT line LIKE '+++%' AS added, CASE WHEN line LIKE '@@ %' OR line LIKE '+++ b/%' OR line LIKE '-%' THEN 0 ELSE 1 END AS moves
FROM lines WINDOW w AS (PARTITION BY pr_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""
ADDED_ONLY = f"SELECT pr_id, path, line_no, substr(line, 2) AS text FROM ({ADDED_SQL}) WHERE added AND path IS NOT NULL"


def with_diffs(body: str, **more: str) -> str:
    parts = {"diffs": DIFF_SQL, "lines": LINES_SQL, "files": FILES_SQL, **more}
    return f"WITH {', '.join(f'{k} AS ({v})' for k, v in parts.items())} {body}"


def with_paths(body: str) -> str:
    parts = {"paths": SHAPE_SQL, "classified": CLASSIFIED_SQL, "selected": SELECTED_SQL, "calls": CALLS_SQL}
    return f"WITH {', '.join(f'{k} AS ({v})' for k, v in parts.items())} {body}"


#: name: (function of session and folder, SQL)
DIFFS = {
    "path_classify": (lambda s, f: classified(s, f).select("pr_id", "ord", "path", "decision", "language"), with_paths("SELECT pr_id, ord, path, decision, language FROM classified")),
    "path_risk": (lambda s, f: classified(s, f).select("ord", "risk_score", F.array_join("reasons", ",").alias("reasons")), with_paths("SELECT ord, risk_score, array_to_string(reasons, ',') AS reasons FROM classified")),
    "file_select": (lambda s, f: selected(s, f).select("pr_id", "ord", "place", "selected", "bucket"), with_paths("SELECT pr_id, ord, place, selected, bucket FROM selected")),
    "chunk_caps": (lambda s, f: calls(s, f).select("pr_id", "place", "chunk", "call"), with_paths("SELECT * FROM calls")),
    "skip_histogram": (lambda s, f: c.skip_histogram(selected(s, f)), with_paths("SELECT pr_id, string_agg(bucket || '=' || CAST(n AS VARCHAR), ',' ORDER BY bucket) AS skips FROM (SELECT pr_id, bucket, count(*) AS n FROM selected WHERE bucket IS NOT NULL GROUP BY ALL) GROUP BY pr_id")),
    "coverage": (lambda s, f: c.coverage(selected(s, f), calls(s, f)), with_paths("SELECT s.pr_id, count(*) FILTER (WHERE selected AND done) AS analyzed, count(*) FILTER (WHERE NOT (selected AND done)) AS skipped, count(*) AS total, count(*) FILTER (WHERE selected AND NOT done) AS budget_exhausted_llm_calls FROM (SELECT *, EXISTS (SELECT 1 FROM calls c WHERE c.pr_id = x.pr_id AND c.place = x.place) AS done FROM selected x) s GROUP BY s.pr_id")),
    "prefetch_set": (lambda s, f: classified(s, f).filter(F.col("decision").isin("analyze", "deprioritize")).join(paths(s, f).filter("ord % 3 = 0").select("path"), "path", "left_anti").select("pr_id", "path"), with_paths("SELECT pr_id, path FROM classified WHERE decision IN ('analyze', 'deprioritize') AND path NOT IN (SELECT path FROM paths WHERE ord % 3 = 0)")),
    "diff_files": (lambda s, f: d.file_chunks(diffs(s, f)).withColumn("chunk", F.md5("chunk")), with_diffs("SELECT pr_id, CAST(file_ord AS BIGINT) AS file_ord, path, count(*) AS n_lines, md5(string_agg(line, chr(10) ORDER BY pos)) AS chunk FROM files GROUP BY pr_id, file_ord, path")),
    "diff_added_lines": (lambda s, f: d.added_lines(diff_lines(s, f)), with_diffs(ADDED_ONLY)),
    "diff_summary": (lambda s, f: d.summary(diff_lines(s, f)), with_diffs("SELECT pr_id, count(*) FILTER (WHERE line LIKE 'diff --git %') AS files, count(*) FILTER (WHERE line LIKE '+%' AND NOT line LIKE '+++%') AS insertions, count(*) FILTER (WHERE line LIKE '-%' AND NOT line LIKE '---%') AS deletions FROM lines GROUP BY pr_id")),
    "diff_snippet": (lambda s, f: d.snippet(diff_lines(s, f), 20).withColumn("snippet", F.md5("snippet")), with_diffs("SELECT pr_id, md5(string_agg(line, chr(10) ORDER BY pos)) AS snippet FROM (SELECT *, row_number() OVER (PARTITION BY pr_id ORDER BY pos) AS nth FROM lines WHERE line LIKE '+%' OR line LIKE '-%' OR line LIKE '@@%' OR line LIKE 'diff%') WHERE nth <= 20 GROUP BY pr_id")),
    "diff_large": (
        lambda s, f: d.large(diffs(s, f), 3, 12, 4000),
        with_diffs("SELECT pr_id, len(r) > 0 AS is_large, array_to_string(r, '; ') AS reasons, CASE WHEN len(r) > 0 THEN 'large' WHEN feeds > 100 THEN 'chunked' ELSE 'small' END AS mode FROM (SELECT pr_id, feeds, list_filter([CASE WHEN files > 3 THEN 'changed_files=' || files || ' > 3' END, CASE WHEN ins > 12 THEN 'added_lines=' || ins || ' > 12' END, CASE WHEN bytes > 4000 THEN 'total_diff_bytes=' || bytes || ' > 4000' END], lambda x: x IS NOT NULL) AS r FROM (SELECT d.pr_id, strlen(raw_diff) AS bytes, length(raw_diff) - length(replace(raw_diff, chr(10), '')) AS feeds, (SELECT count(*) FROM lines l WHERE l.pr_id = d.pr_id AND line LIKE 'diff --git %') AS files, (SELECT count(*) FROM lines l WHERE l.pr_id = d.pr_id AND line LIKE '+%' AND NOT line LIKE '+++%') AS ins FROM diffs d))"),
    ),
    "diff_chunks": (lambda s, f: d.hunk_bins(diff_lines(s, f), 7), with_diffs(f"SELECT * FROM ({BINS_SQL.format(n=7)})", hunks=HUNKS_SQL)),
    "diff_chunk_plan": (
        lambda s, f: d.chunk_plan(diff_lines(s, f), 4).select("pr_id", "file_ord", "bin", "n_lines", "chunk"),
        with_diffs("SELECT pr_id, file_ord, bin, n_lines, CAST(chunk AS INTEGER) AS chunk FROM (SELECT *, row_number() OVER (PARTITION BY pr_id ORDER BY file_ord, bin) AS chunk FROM (SELECT pr_id, file_ord, CASE WHEN t THEN 0 ELSE bin END AS bin, CAST(sum(CASE WHEN t THEN 0 ELSE n_lines END) AS BIGINT) AS n_lines FROM (SELECT *, path LIKE '%/test\\_%' ESCAPE '\\' OR path LIKE '%/tests/%' AS t FROM bins) GROUP BY ALL)) WHERE chunk <= 4", hunks=HUNKS_SQL, bins=BINS_SQL.format(n=150)),
    ),
    "diff_trim": (
        lambda s, f: d.trim(diff_lines(s, f), 60).withColumn("text", F.md5("text")),
        with_diffs("""SELECT pr_id, CAST(file_ord AS BIGINT) AS file_ord, path, md5(CASE WHEN strlen(whole) <= 60 THEN whole WHEN head >= 60 THEN cut ELSE coalesce(fit, '') END) AS text FROM (
  SELECT pr_id, file_ord, path, string_agg(line, chr(10) ORDER BY pos) AS whole, max(CASE WHEN hunks = 0 OR hunks = 1 AND line LIKE '@@%' THEN used END) AS head, string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE used <= 60) AS fit,
    (SELECT max(substr(w, 1, n)) FROM (SELECT string_agg(line, chr(10) ORDER BY pos) AS w), range(61) r(n) WHERE strlen(substr(w, 1, n)) <= 60) AS cut
  FROM (SELECT *, sum(strlen(line) + 1) OVER (PARTITION BY pr_id, file_ord ORDER BY pos) - 1 AS used, sum(CASE WHEN line LIKE '@@%' THEN 1 ELSE 0 END) OVER (PARTITION BY pr_id, file_ord ORDER BY pos) AS hunks FROM files) GROUP BY ALL)"""),
    ),
    "diff_chunk_texts": (
        lambda s, f: d.chunk_texts(diff_lines(s, f), 7).withColumn("text", F.md5("text")),
        with_diffs(f"""SELECT h.pr_id, CAST(h.file_ord AS BIGINT) AS file_ord, h.path, coalesce(bin, 0) AS bin, md5(concat_ws(chr(10), head, body)) AS text
FROM (SELECT pr_id, file_ord, path, string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE hunk = 0) AS head FROM numbered GROUP BY ALL) h
LEFT JOIN (SELECT n.pr_id, n.file_ord, bin, string_agg(line, chr(10) ORDER BY pos) AS body FROM numbered n JOIN ({BINS_SQL.format(n=7)}) b ON b.pr_id = n.pr_id AND b.file_ord = n.file_ord AND b.hunk = n.hunk GROUP BY ALL) k ON k.pr_id = h.pr_id AND k.file_ord = h.file_ord""", hunks=HUNKS_SQL, numbered="SELECT *, sum(CASE WHEN line LIKE '@@%' THEN 1 ELSE 0 END) OVER (PARTITION BY pr_id, file_ord ORDER BY pos) AS hunk FROM files"),
    ),
    "diff_test_flag": (lambda s, f: d.file_chunks(diffs(s, f)).groupBy(F.col("path").rlike(d.CHUNK_TEST_FILE).alias("is_test")).agg(F.count(F.lit(1)).alias("n")), with_diffs(f"SELECT regexp_matches(path, '{d.CHUNK_TEST_FILE}') AS is_test, count(*) AS n FROM (SELECT DISTINCT pr_id, file_ord, path FROM files) GROUP BY 1")),
    "diff_by_path": (lambda s, f: d.last_by_path(d.file_chunks(diffs(s, f).union(diffs(s, f)).groupBy("pr_id").agg(F.array_join(F.array_sort(F.collect_list("raw_diff")), "\n").alias("raw_diff")))).withColumn("chunk", F.md5("chunk")), with_diffs("SELECT pr_id, path, CAST(min(file_ord) AS BIGINT) AS first_ord, arg_max(chunk, file_ord) AS chunk FROM (SELECT pr_id, path, file_ord, md5(string_agg(line, chr(10) ORDER BY pos)) AS chunk FROM files GROUP BY ALL) GROUP BY pr_id, path")),
    "diff_context": (
        lambda s, f: d.context(d.added_lines(diff_lines(s, f)), contents(s, f), 1, 9),
        with_diffs("SELECT pr_id, path, CAST(nth AS INTEGER) AS nth, text FROM (SELECT *, row_number() OVER (PARTITION BY pr_id, path ORDER BY line_no) AS nth FROM (SELECT pr_id, 'src/f0.py' AS path, line_no, lpad(CAST(line_no AS VARCHAR), CAST(greatest(4, length(CAST(line_no AS VARCHAR))) AS INTEGER), ' ') || ' | ' || x AS text FROM (SELECT doc_id AS pr_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS line_no, len(string_split(text, chr(10))) AS n FROM documents) t WHERE NOT (x = '' AND line_no = n) AND EXISTS (SELECT 1 FROM added a WHERE a.pr_id = t.pr_id AND a.path = 'src/f0.py' AND abs(a.line_no - t.line_no) <= 1))) WHERE nth <= 9", added=ADDED_ONLY),
    ),
}

QUERIES = {name: f for name, (f, _) in DIFFS.items()}
ORACLE_SQL = {name: sql for name, (_, sql) in DIFFS.items()}
