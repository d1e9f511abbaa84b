"""Classification of changed paths, file selection within a budget, and coverage counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Names, suffixes, patterns and weights that decide how a path is classified.
DOC_BASENAMES = ("readme", "license", "licence", "copying", "notice", "changelog", "authors")
DOC_SUFFIXES = (".md", ".markdown", ".rst", ".txt", ".adoc")
DOC_SEGMENTS = ("docs", "doc")
GENERATED_SEGMENTS = ("dist", "build", "coverage", "node_modules", "vendor", "target", "out", ".next", ".nuxt")
ASSET_SUFFIXES = (".png", ".jpg", ".jpeg", ".gif", ".svg", ".ico", ".webp", ".bmp", ".woff", ".woff2", ".ttf", ".otf", ".eot")
MINIFIED = r"(?i)\.min\.(js|css|mjs|cjs)$"
LOCKFILES = ("package-lock.json", "yarn.lock", "pnpm-lock.yaml", "poetry.lock", "cargo.lock", "go.sum", "composer.lock", "pipfile.lock", "gemfile.lock")
TEST_SEGMENTS = ("test", "tests", "__tests__", "spec", "specs")
TEST_FILE = r"(?i)(^|/)(test_[^/]+|[^/]+_test|[^/]+\.test|[^/]+\.spec)\.(py|js|jsx|ts|tsx|mjs|cjs|go|java|rb|cs|php)$"
KEYWORDS = (
    (20, ("auth", "login", "session", "jwt", "token", "permission", "rbac", "payment", "billing", "secret")),
    (15, ("api", "route", "controller", "handler", "db", "query", "sql", "webhook", "upload")),
    (10, ("file", "path", "network", "request", "fetch", "http", "config", "env")),
)
APPLICATION_SCORE, TEST_SCORE, TOP_SCORE = 25, 10, 100
LANGUAGES = {".py": "python", ".pyw": "python", ".js": "javascript", ".mjs": "javascript", ".cjs": "javascript", ".ts": "typescript", ".tsx": "typescript", ".jsx": "javascript", ".go": "go", ".java": "java", ".rb": "ruby", ".php": "php", ".cs": "csharp"}
MAX_FILES, MAX_CHUNKS_PER_FILE, MAX_CALLS = 20, 5, 40

ANALYZE, DEPRIORITIZE, SKIP, DEPENDENCY = "analyze", "deprioritize", "skip", "dependency_only"


def _ends(path: Column, suffixes: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for s in suffixes:
        out = out | path.endswith(s)
    return out


def _segments(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda s: s != "")


def _has(values: Column, names: tuple[str, ...]) -> Column:
    return F.arrays_overlap(values, F.array(*map(F.lit, names)))


def tokens(path: Column) -> Column:
    """Distinct runs of a-z and 0-9 of a lower-cased path."""
    return F.array_distinct(F.filter(F.split(F.lower(path), "[^a-z0-9]+"), lambda t: t != ""))


def matched_keywords(path: Column) -> Column:
    """Keywords that are whole tokens of the path, heaviest tier first."""
    known = F.array(*[F.struct(F.lit(k).alias("keyword"), F.lit(w).alias("weight")) for w, ks in KEYWORDS for k in ks])
    own = tokens(path)
    return F.filter(known, lambda k: F.array_contains(own, k["keyword"]))


def language(path: Column) -> Column:
    suffix = F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv]), suffix), F.lit("python"))


def skip_reason(path: Column) -> Column:
    """Why a path is not analysed as application code: the first rule that fits; null if none."""
    low = F.lower(path)
    base = F.substring_index(low, "/", -1)
    stem = F.when(base.contains("."), F.regexp_replace(base, r"\.[^.]*$", "")).otherwise(base)
    return (
        F.when(path.isNull() | (F.trim(path) == ""), "empty_path")
        .when(_ends(low, DOC_SUFFIXES) | stem.isin(*DOC_BASENAMES) | _has(_segments(low), DOC_SEGMENTS), "docs")
        .when(path.rlike(MINIFIED), "minified")
        .when(_ends(low, ASSET_SUFFIXES), "static_asset")
        .when(_has(_segments(low), GENERATED_SEGMENTS), "generated")
        .when(base.isin(*LOCKFILES), "lockfile")
        .when(path.rlike(TEST_FILE) | _has(_segments(low), TEST_SEGMENTS), "test_file")
    )


def classify(paths: DataFrame) -> DataFrame:
    """paths with decision, risk_score, reasons (array) and language."""
    reason = F.col("reason")
    rows = paths.withColumn("reason", skip_reason(F.col("path"))).withColumn("keywords", matched_keywords(F.coalesce("path", F.lit(""))))
    decision = F.when(reason.isNull(), ANALYZE).when(reason == "test_file", DEPRIORITIZE).when(reason == "lockfile", DEPENDENCY).otherwise(SKIP)
    score = F.least(F.lit(TOP_SCORE), F.lit(APPLICATION_SCORE) + F.aggregate("keywords", F.lit(0), lambda a, k: a + k["weight"]))
    reasons = F.when(reason.isNull(), F.concat(F.array(F.lit("application_code")), F.transform("keywords", lambda k: F.concat(F.lit("keyword:"), k["keyword"])))).otherwise(F.array(reason))
    return rows.withColumns({"decision": decision, "risk_score": F.when(reason.isNull(), score).when(reason == "test_file", TEST_SCORE).otherwise(0), "reasons": reasons, "language": language(F.coalesce("path", F.lit("")))}).drop("reason", "keywords")


def select_files(classified: DataFrame, max_files: int = MAX_FILES) -> DataFrame:
    """Adds place (among the eligible), selected and bucket (why a file is left out). Application code first, then tests, by risk and input order."""
    eligible = F.col("decision").isin(ANALYZE, DEPRIORITIZE)
    order = W.partitionBy("pr_id", eligible).orderBy(F.when(F.col("decision") == ANALYZE, 0).otherwise(1), F.desc("risk_score"), "ord")
    rows = classified.withColumn("place", F.when(eligible, F.row_number().over(order)))
    selected = F.coalesce(F.col("place") <= max(0, max_files), F.lit(False))
    first = F.element_at("reasons", 1)
    left_out = F.when(first == "lockfile", DEPENDENCY).when(first.isin("docs", "generated", "static_asset", "minified"), first).when(F.col("decision") == SKIP, "other").when(F.col("decision") == DEPRIORITIZE, "deprioritized_no_budget").otherwise("budget_exhausted")
    return rows.withColumn("selected", selected).withColumn("bucket", F.when(~selected, left_out))


def skip_histogram(selection: DataFrame) -> DataFrame:
    """pr_id, skips: a map from bucket to count, as sorted text."""
    counts = selection.filter("bucket IS NOT NULL").groupBy("pr_id", "bucket").agg(F.count(F.lit(1)).alias("n"))
    entries = F.array_sort(F.collect_list(F.concat_ws("=", "bucket", F.col("n").cast("string"))))
    return counts.groupBy("pr_id").agg(F.array_join(entries, ",").alias("skips"))


def cap_chunks(chunks: DataFrame, per_file: int = MAX_CHUNKS_PER_FILE, per_pr: int = MAX_CALLS) -> DataFrame:
    """Chunks (pr_id, place, chunk) that are sent: the first of each file, then the first of the change in rank order."""
    own = W.partitionBy("pr_id", "place").orderBy("chunk")
    kept = chunks.withColumn("nth", F.row_number().over(own)).filter(F.col("nth") <= per_file)
    return kept.withColumn("call", F.row_number().over(W.partitionBy("pr_id").orderBy("place", "chunk"))).filter(F.col("call") <= per_pr).drop("nth")


def coverage(selection: DataFrame, calls: DataFrame) -> DataFrame:
    """Files analysed, left out and in all of each change; selected files that no call reached count as left out."""
    reached = calls.select("pr_id", "place").distinct().withColumn("reached", F.lit(True))
    rows = selection.join(reached, ["pr_id", "place"], "left").withColumn("done", F.col("selected") & F.coalesce("reached", F.lit(False)))
    return rows.groupBy("pr_id").agg(F.count_if("done").alias("analyzed"), F.count_if(~F.col("done")).alias("skipped"), F.count(F.lit(1)).alias("total"), F.count_if(F.col("selected") & ~F.col("done")).alias("budget_exhausted_llm_calls"))
