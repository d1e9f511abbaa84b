"""Queries over tables that batches and streams keep: counts by day, verdicts by path and diff, deletes; and the SQL that must give the same rows.

Each works on tables of its own in the shared folder, made from the given tables; they are read when the result is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlake.operators import buckets, cache, classify, deletes, exports, state
from siftlake.operators import diffs as df
from siftlake.operators import warehouse as w
from siftlake.plans import diff_queries as d
from siftlake.plans.finding_queries import ORACLE_SQL as FINDINGS_SQL
from siftlake.plans.warehouse_queries import ORACLE_SQL as WAREHOUSE_SQL
from siftlake.sources.domain import AS_OF, Principal, Tables, with_views
from siftlake.streaming import findings

USAGE = {"day": "24 HOURS", "week": "7 DAYS", "month": "30 DAYS"}
NOW = f"TIMESTAMP '{AS_OF}'"


def moment() -> Column:
    return F.expr(f"timestamp_ntz '{AS_OF}'")


def kept_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by day as a stream of scans keeps them."""
    at = findings.folder(spark)
    return findings.Kept(spark, f"{at}/counts", f"{at}/state", buckets.by_day, buckets.merged).run(scans_of(findings.arriving(spark, sf_dir)))


def scans_of(events: DataFrame) -> DataFrame:
    """The columns of scans that counts need, from events."""
    verdict = F.when(F.col("event_type") == "purchase", "TRUE_POSITIVE").when(F.col("event_type") == "click", "NEEDS_REVIEW").when(F.col("event_type") == "error", "ERROR").otherwise("FALSE_POSITIVE")
    return events.select(F.col("user_id").alias("repo_id"), verdict.alias("verdict"), F.col("ts").alias("created_at"))


def usage(counts: DataFrame, t: Tables) -> DataFrame:
    """Scans of each repository in three windows, and what is left of its daily limit."""
    rows = buckets.window_counts(counts, t.scans, AS_OF, USAGE)
    sums = rows.groupBy("repo_id").agg(*[F.sum(n).alias(n) for n in USAGE], F.sum(F.when(F.col("verdict") == "TRUE_POSITIVE", F.col("day")).otherwise(0)).alias("day_tp"))
    out = t.repos.join(sums.withColumnRenamed("repo_id", "id"), "id", "left").fillna(0, [*USAGE, "day_tp"])
    limit = F.coalesce("custom_daily_limit", F.lit(w.DEFAULT_LIMIT))
    return out.select("id", *USAGE, "day_tp", limit.alias("daily_limit"), F.greatest(F.lit(0), limit - F.col("day")).alias("remaining"))


def windows(counts: DataFrame, t: Tables) -> DataFrame:
    """Five windows of all scans, and all scans ever from the counts alone."""
    rows = buckets.window_counts(counts, t.scans, AS_OF, {"today": "1 DAY", "week": "7 DAYS", "month": "30 DAYS"})
    some = lambda name, verdict: F.coalesce(F.sum(F.when(F.col("verdict") == verdict, F.col(name))), F.lit(0))
    part = rows.agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in ("today", "week", "month")], some("month", "TRUE_POSITIVE").alias("true_positives_month"), some("week", "ERROR").alias("errors_week"))
    return part.join(F.broadcast(counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total")))).select("today", "week", "month", "total", "true_positives_month", "errors_week")


def trend(counts: DataFrame, t: Tables) -> DataFrame:
    """Verdicts by week of the last eight weeks, over the repositories of one login."""
    visible = w.visible_repos(t, Principal(), "login").select(F.col("id").alias("repo_id"))
    rows = buckets.weekly_counts(counts, t.scans, AS_OF, "56 DAYS").join(visible, "repo_id", "left_semi")
    names = {"true_positives": "TRUE_POSITIVE", "needs_review": "NEEDS_REVIEW", "false_positives": "FALSE_POSITIVE"}
    weeks = rows.groupBy("start").agg(*[F.sum(F.when(F.col("verdict") == v, F.col("n")).otherwise(0)).alias(n) for n, v in names.items()])
    height = F.col("true_positives") + F.col("needs_review") + F.col("false_positives")
    top = weeks.agg(F.greatest(F.lit(1), F.max(height)).alias("top"))
    return weeks.join(F.broadcast(top)).select(F.date_format("start", "MMM dd").alias("week"), *names, (height * 100 / F.col("top")).cast("int").alias("height_pct"))


def retained(s: SparkSession, f: str) -> DataFrame:
    """What is left of the scans, kept by day, after every owner's retention."""
    t, at = Tables(s, f), findings.folder(s)
    days = t.scans.select("id", "repo_id", "created_at", F.to_date("created_at").alias("day"))
    deletes.write(days, at, ["day"])
    schema = "id bigint, repo_id bigint, created_at timestamp_ntz, day date"
    doomed = state.expired_scans(t, deletes.read(s, at, schema)).select("id", "day")
    deletes.delete(s, at, schema, ["day"], doomed, ["id", "day"])
    return deletes.read(s, at, schema).select("id", "repo_id")


def left_account(s: SparkSession, f: str, who: Principal = Principal(), parts: int = 8) -> DataFrame:
    """name, n: rows of each table that are left when an account, its repositories and all that hangs on them are deleted, what hangs on others first.

    Tables are kept in parts by a hash: repositories and their scans by the repository, so the deletes touch the parts of the account's repositories only."""
    t, at = Tables(s, f), findings.folder(s)
    kept = {"users": (t.users, "github_id", "id"), "repos": (t.repos, "id", "user_id"), "scans": (t.scans, "repo_id", "id"), "feedback": (t.feedback, "scan_id", "github_id"), "audit": (t.audit, "github_id", "id")}
    schemas = {}
    for name, (table, key, more) in kept.items():
        rows = table.select(key, more, F.pmod(F.xxhash64(key), F.lit(parts)).cast("int").alias("part"))
        schemas[name] = rows.schema
        deletes.write(rows, f"{at}/{name}", ["part"])
    read = lambda name: deletes.read(s, f"{at}/{name}", schemas[name])
    drop = lambda name, doomed, on=None: deletes.delete(s, f"{at}/{name}", schemas[name], ["part"], doomed, on)
    own = F.col("github_id") == who.github_id
    repos = read("repos").join(read("users").filter(own).select(F.col("id").alias("user_id")), "user_id", "left_semi").select(F.col("id").alias("repo_id"), "part")
    drop("feedback", read("scans").join(repos, ["repo_id", "part"], "left_semi").select(F.col("id").alias("scan_id")), ["scan_id"])
    drop("feedback", own)
    drop("audit", own)
    drop("scans", repos, ["repo_id", "part"])
    drop("repos", repos.withColumnRenamed("repo_id", "id"), ["id", "part"])
    drop("users", own)
    out = None
    for name in kept:
        one = read(name).agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n"))
        out = one if out is None else out.union(one)
    return out


def file_items(s: SparkSession, f: str) -> DataFrame:
    """The changed files of all changes, with the key of path and diff."""
    return df.file_chunks(d.diffs(s, f)).select("pr_id", "file_ord", "path", cache.cache_key(F.col("path"), F.col("chunk")).alias("key"))


def earlier_answers(s: SparkSession, f: str) -> DataFrame:
    """A stored verdict for the files of two changes in three, up to fifteen days old, and later ones for some."""
    pr, items = F.col("pr_id"), file_items(s, f).filter("pr_id % 3 > 0")
    body = {"verdict": F.when(pr % 2 == 0, "TRUE_POSITIVE").otherwise("NEEDS_REVIEW"), "severity": F.lit("HIGH"), "cwe_id": F.lit("CWE-89"), "confidence": (pr % 10) / 10.0, "title": F.concat(F.lit("of "), pr.cast("string")), "summary": F.lit("s"), "evidence": F.lit("code"), "sanitizer_found": pr % 4 == 0, "sanitizer_description": F.lit(None).cast("string"), "attack_vector": F.lit("code"), "remediation": F.lit("fix"), "false_positive_reason": F.lit(None).cast("string")}
    rows = items.select("key", "pr_id", *[v.alias(n) for n, v in body.items()])
    one = cache.entries(rows, moment()).select("key", "content")
    first = F.min("pr_id").alias("pr_id")
    when = rows.groupBy("key").agg(first).select("key", F.expr("make_dt_interval(CAST(pr_id % 15 AS INT), CAST(pr_id % 5 AS INT))").alias("back"))
    aged = one.join(when, "key").select("key", (moment() - F.col("back")).alias("cached_at"), "content")
    return aged.withColumn("day", F.to_date("cached_at"))


def cached(s: SparkSession, f: str) -> DataFrame:
    """Each changed file with the state of its look-up and what the stored verdict says."""
    at = findings.folder(s)
    cache.append(earlier_answers(s, f), at)
    found = cache.looked_up(file_items(s, f), cache.stored(s, at), moment())
    says = F.from_json("content", "verdict string, confidence double, title string, evidence string, attack_vector string")
    return found.select("pr_id", "file_ord", "key", "state", says.alias("says")).select("pr_id", "file_ord", "key", "state", "says.*")


def asked_again(s: SparkSession, f: str) -> DataFrame:
    """Verdicts of all changed files in a second run: the first run's answers are stored, so all come from the table."""
    at = findings.folder(s)
    ask = lambda rows: rows.withColumn("content", F.to_json(F.struct(F.when(F.col("pr_id") % 2 == 0, "TRUE_POSITIVE").otherwise("FALSE_POSITIVE").alias("verdict"), F.lit("LOW").alias("severity"), ((F.col("pr_id") % 10) / 10.0).alias("confidence"), F.lit("x").alias("evidence"))))
    items = file_items(s, f)
    cache.append(cache.answered(items, cache.stored(s, at), moment(), ask)[1], at)
    again, _ = cache.answered(items, cache.stored(s, at), moment(), ask)
    return again.select("pr_id", "file_ord", "cached", "verdict", "confidence", "evidence")


KEYS_SQL = "SELECT pr_id, CAST(file_ord AS BIGINT) AS file_ord, path, substr(sha256(path || ':' || string_agg(line, chr(10) ORDER BY pos)), 1, 16) AS key FROM files GROUP BY pr_id, file_ord, path"
STORED_SQL = f"SELECT key, max((CASE WHEN pr_id % 2 = 0 THEN 'TRUE_POSITIVE' ELSE 'NEEDS_REVIEW' END, pr_id % 10 / 10.0, 'of ' || pr_id)) AS best, {NOW} - (min(pr_id) % 15) * INTERVAL 1 DAY - (min(pr_id) % 5) * INTERVAL 1 HOUR AS cached_at FROM keys WHERE pr_id % 3 > 0 GROUP BY key"
CACHED_SQL = d.with_diffs(
    f"""SELECT pr_id, file_ord, key, state, CASE WHEN state = 'hit' THEN best[1] END AS verdict, CASE WHEN state = 'hit' THEN best[2] END AS confidence, CASE WHEN state = 'hit' THEN best[3] END AS title, CASE WHEN state = 'hit' THEN '' END AS evidence, CAST(NULL AS VARCHAR) AS attack_vector
FROM (SELECT k.*, s.best, CASE WHEN s.key IS NULL THEN 'missing' WHEN {NOW} - cached_at > INTERVAL 7 DAY THEN 'expired' ELSE 'hit' END AS state FROM keys k LEFT JOIN stored s ON s.key = k.key)""",
    keys=KEYS_SQL,
    stored=STORED_SQL,
)
AGAIN_SQL = d.with_diffs("SELECT k.pr_id, k.file_ord, true AS cached, best[1] AS verdict, best[2] AS confidence, '' AS evidence FROM keys k JOIN (SELECT key, max((CASE WHEN pr_id % 2 = 0 THEN 'TRUE_POSITIVE' ELSE 'FALSE_POSITIVE' END, pr_id % 10 / 10.0)) AS best FROM keys GROUP BY key) m ON m.key = k.key", keys=KEYS_SQL)


def unsplit(s: SparkSession, f: str) -> DataFrame:
    """Diffs of which every third lacks the headers that the splitter looks for."""
    text = F.regexp_replace("raw_diff", r"diff --git [^\n]*\n", "")
    return d.diffs(s, f).select("pr_id", F.when(F.col("pr_id") % 3 == 0, text).otherwise(F.col("raw_diff")).alias("raw_diff"))


def prefetched(s: SparkSession, f: str) -> DataFrame:
    """Changed files that are worth fetching and not there already."""
    rows = classify.classify(df.changed_paths(unsplit(s, f)))
    there = s.read.parquet(f"{f}/documents.parquet").filter("doc_id % 5 = 0").select(F.col("doc_id").alias("pr_id"), F.lit("src/f0.py").alias("path"))
    return rows.filter(F.col("decision").isin("analyze", "deprioritize")).join(there, ["pr_id", "path"], "left_anti").select("pr_id", "ord", "path")


PREFETCH_SQL = f"""WITH diffs AS ({d.DIFF_SQL}), lines AS ({d.LINES_SQL}), named AS (SELECT pr_id, pos, substr(line, 7) AS path FROM lines WHERE line LIKE '+++ b/_%'),
paths AS (SELECT pr_id, CAST(row_number() OVER (PARTITION BY pr_id ORDER BY pos) - 1 AS INTEGER) AS ord, path FROM (SELECT pr_id, path, min(pos) AS pos FROM named GROUP BY ALL)), classified AS ({d.CLASSIFIED_SQL})
SELECT pr_id, ord, path FROM classified WHERE decision IN ('analyze', 'deprioritize') AND NOT (path = 'src/f0.py' AND pr_id % 5 = 0)"""

LINES = lambda *each: f"array_to_string(list_filter([{', '.join(each)}], lambda x: x IS NOT NULL), chr(10))"
DIGEST_SQL = f"""WITH digest AS ({WAREHOUSE_SQL["weekly_digest"].rstrip().rstrip(";")}), d AS (SELECT *, owner || '/' || name AS repo, '{exports.DASHBOARD}/repos/' || owner || '/' || name AS link, '{exports.TOOL} weekly digest: ' || owner || '/' || name AS title, top_cwe || ' (' || coalesce(top_severity, 'unknown') || ')' AS top,
  CASE WHEN sla_breaches > 0 THEN sla_breaches || ' CRITICAL/HIGH finding' || CASE WHEN sla_breaches = 1 THEN '' ELSE 's' END || ' open for more than 7 days' END AS late FROM digest),
t AS (SELECT *, {LINES("'*Last 7 days:*'", "'• ' || true_positives || ' true positive' || CASE WHEN true_positives = 1 THEN '' ELSE 's' END", "'• ' || needs_review || ' need' || CASE WHEN needs_review = 1 THEN 's' ELSE '' END || ' review'", "'• ' || false_positives || ' false positive' || CASE WHEN false_positives = 1 THEN '' ELSE 's' END", "'• Top weakness: ' || top", f"'{exports.ALARM} *' || late || '*'")} AS body,
  {LINES("'**Last 7 days**'", "'• ' || true_positives || ' true positives'", "'• ' || needs_review || ' needs review'", "'• ' || false_positives || ' false positives'", "'• Top: ' || top", f"'{exports.ALARM} **' || late || '**'")} AS about,
  list_filter([{{'name': 'True positives', 'value': CAST(true_positives AS VARCHAR)}}, {{'name': 'Needs review', 'value': CAST(needs_review AS VARCHAR)}}, {{'name': 'False positives', 'value': CAST(false_positives AS VARCHAR)}}, {{'name': 'Top weakness', 'value': top}}, {{'name': 'Overdue', 'value': late}}], lambda x: x.value IS NOT NULL) AS facts FROM d)
SELECT owner, name, CAST(to_json({{'text': title, 'blocks': [to_json({{'type': 'header', 'text': {{'type': 'plain_text', 'text': title}}}}), to_json({{'type': 'section', 'text': {{'type': 'mrkdwn', 'text': body}}, 'accessory': {{'type': 'button', 'text': {{'type': 'plain_text', 'text': 'View dashboard'}}, 'url': link}}}})]}}) AS VARCHAR) AS slack,
  CAST(to_json({{'embeds': [{{'title': title, 'url': link, 'color': CASE WHEN late IS NOT NULL THEN 16711680 WHEN true_positives > 0 THEN 16498468 ELSE 4906624 END, 'description': about, 'footer': {{'text': '{exports.TOOL} • {exports.DASHBOARD.split("://")[-1]}'}}}}]}}) AS VARCHAR) AS discord,
  CAST(to_json({{'@type': 'MessageCard', '@context': 'http://schema.org/extensions', 'themeColor': CASE WHEN late IS NOT NULL THEN 'FF0000' ELSE 'FBBF24' END, 'summary': title, 'sections': [{{'activityTitle': '{exports.TOOL} weekly digest', 'activitySubtitle': repo, 'facts': facts, 'potentialAction': [{{'@type': 'OpenUri', 'name': 'View dashboard', 'targets': [{{'os': 'default', 'uri': link}}]}}]}}]}}) AS VARCHAR) AS teams FROM t"""

T = lambda f: lambda s, d: f(Tables(s, d))

#: name: (function of session and folder, SQL)
STORED = {
    "usage_by_day": (lambda s, f: usage(buckets.by_day(Tables(s, f).scans), Tables(s, f)), WAREHOUSE_SQL["repo_usage"]),
    "stream_usage": (lambda s, f: usage(kept_counts(s, f), Tables(s, f)), WAREHOUSE_SQL["repo_usage"]),
    "scan_windows_by_day": (lambda s, f: windows(buckets.by_day(Tables(s, f).scans), Tables(s, f)), WAREHOUSE_SQL["admin_scan_windows"]),
    "weekly_trend_by_day": (lambda s, f: trend(buckets.by_day(Tables(s, f).scans), Tables(s, f)), WAREHOUSE_SQL["weekly_trend"]),
    "retention_delete": (retained, FINDINGS_SQL["retention_survivors"]),
    "account_delete": (left_account, FINDINGS_SQL["account_delete_survivors"]),
    "cache_verdicts": (cached, CACHED_SQL),
    "cache_second_run": (asked_again, AGAIN_SQL),
    "prefetch_unsplit": (prefetched, PREFETCH_SQL),
    "digest_payloads": (T(lambda t: exports.digest_payloads(w.weekly_digest(t))), DIGEST_SQL),
}
QUERIES = {name: f for name, (f, _) in STORED.items()}
ORACLE_SQL = {name: sql for name, (_, sql) in STORED.items() if sql}
