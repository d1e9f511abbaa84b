"""The findings warehouse as DataFrames: its tables, and deterministic domain views over the star-schema test tables."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Every time-relative query takes its moment from here or from the caller, never from the clock.
AS_OF = "2024-01-31 00:00:00"


@dataclass(frozen=True)
class Principal:
    """Who asks: decides which rows are visible."""

    github_id: int = 1004
    username: str = "nation_4"


class Tables:
    """Warehouse tables derived from the test tables in a folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def users(self) -> DataFrame:
        i = F.col("n_nationkey")
        return self.raw("nation").select(
            i.alias("id"),
            (i + 1000).cast("long").alias("github_id"),
            F.lower("n_name").alias("username"),
            F.when(i % 5 != 0, F.concat(F.lower("n_name"), F.lit("@example.org"))).alias("email"),
            F.when(i % 4 == 1, 7).when(i % 4 > 1, 14).alias("scan_retention_days"),
            F.expr("timestamp_ntz '2024-01-05 00:00:00' + make_dt_interval(n_nationkey)").alias("created_at"),
        )

    @cached_property
    def installations(self) -> DataFrame:
        i = F.col("n_nationkey")
        return self.raw("nation").select(
            (i + 5000).cast("long").alias("installation_id"),
            F.lower("n_name").alias("account_login"),
            F.when(i % 3 == 0, F.expr("timestamp_ntz '2024-01-20 00:00:00'")).alias("deleted_at"),
        )

    @cached_property
    def repos(self) -> DataFrame:
        c = self.raw("customer").join(self.raw("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        i = F.col("c_custkey")
        return c.select(
            i.alias("id"),
            F.lower("n_name").alias("owner"),
            F.col("c_name").alias("name"),
            F.when(i % 3 != 0, F.col("c_nationkey")).alias("user_id"),
            F.when(i % 2 == 0, F.col("c_nationkey") + 5000).cast("long").alias("installation_id"),
            F.when(i % 7 == 0, 5).alias("custom_daily_limit"),
            F.when(i % 4 == 0, "HIGH").when(i % 4 == 1, "LOW").alias("notify_min_severity"),
            (i % 5 == 0).alias("notify_on_needs_review"),
        )

    @cached_property
    def scans(self) -> DataFrame:
        k, i = F.col("k"), F.col("event_id")
        e = self.raw("events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
        verdict = F.when(F.col("event_type") == "purchase", "TRUE_POSITIVE").when(F.col("event_type") == "click", "NEEDS_REVIEW").when(F.col("event_type") == "error", "ERROR").otherwise("FALSE_POSITIVE")
        severity = F.element_at(F.array(*map(F.lit, ("CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO", "N/A"))), k % 6 + 1)
        return e.select(
            i.alias("id"),
            F.col("user_id").alias("repo_id"),
            F.when(i % 9 != 0, k).alias("pr_number"),
            F.substring(F.md5(i.cast("string").cast("binary")), 1, 12).alias("commit_sha"),
            verdict.alias("verdict"),
            severity.alias("severity"),
            F.when(k % 11 == 0, None).when(k % 10 == 0, "N/A").otherwise(F.concat(F.lit("CWE-"), F.lpad(k.cast("string"), 3, "0"))).alias("cwe_id"),
            F.least(F.lit(1.0), F.col("value") / 100).alias("confidence"),
            F.concat(F.lit("t"), (k % 7).cast("string")).alias("title"),
            F.when(i % 8 != 0, F.concat(F.lit("p"), (i % 3).cast("string"))).alias("provider"),
            F.col("ts").alias("created_at"),
        )

    @cached_property
    def feedback(self) -> DataFrame:
        s = self.scans.filter((F.col("verdict") == "TRUE_POSITIVE") & (F.col("id") % 3 == 0))
        first = s.select("id", F.lit(0).alias("again"))
        again = s.filter(F.col("id") % 6 == 0).select("id", F.lit(1).alias("again"))
        both = first.union(again).join(s.select("id", "created_at"), "id")
        i, n = F.col("id"), F.col("again")
        return both.select(
            i.alias("scan_id"),
            (i % 25 + 1000).cast("long").alias("github_id"),
            F.when((i + n) % 2 == 0, "FALSE_POSITIVE").otherwise("TRUE_POSITIVE").alias("correct_verdict"),
            F.when(n == 1, F.lit("second look")).alias("reason"),
            F.expr("created_at + make_dt_interval(CAST(id % 10 AS INT), CAST(again AS INT))").alias("created_at"),
        )

    @cached_property
    def audit(self) -> DataFrame:
        i = F.col("event_id")
        action = F.when(i % 3 == 0, "scan_ingested").when(i % 3 == 1, "rescan_triggered").otherwise("llm_key_issued")
        return self.raw("events").select(
            i.alias("id"),
            (F.col("user_id") % 25 + 1000).alias("github_id"),
            action.alias("action"),
            F.col("user_id").alias("repo_id"),
            F.concat(F.lit('{"pr_number": '), F.get_json_object("props", "$.k"), F.lit("}")).alias("details"),
            F.col("ts").alias("created_at"),
        )


#: The same views as DuckDB SQL, by name.
VIEWS = {
    "users": "SELECT n_nationkey AS id, CAST(n_nationkey + 1000 AS BIGINT) AS github_id, lower(n_name) AS username, CASE WHEN n_nationkey % 5 <> 0 THEN lower(n_name) || '@example.org' END AS email, CASE WHEN n_nationkey % 4 = 1 THEN 7 WHEN n_nationkey % 4 > 1 THEN 14 END AS scan_retention_days, TIMESTAMP '2024-01-05' + n_nationkey * INTERVAL 1 DAY AS created_at FROM nation",
    "installations": "SELECT CAST(n_nationkey + 5000 AS BIGINT) AS installation_id, lower(n_name) AS account_login, CASE WHEN n_nationkey % 3 = 0 THEN TIMESTAMP '2024-01-20' END AS deleted_at FROM nation",
    "repos": "SELECT c_custkey AS id, lower(n_name) AS owner, c_name AS name, CASE WHEN c_custkey % 3 <> 0 THEN c_nationkey END AS user_id, CASE WHEN c_custkey % 2 = 0 THEN CAST(c_nationkey + 5000 AS BIGINT) END AS installation_id, CASE WHEN c_custkey % 7 = 0 THEN 5 END AS custom_daily_limit, CASE WHEN c_custkey % 4 = 0 THEN 'HIGH' WHEN c_custkey % 4 = 1 THEN 'LOW' END AS notify_min_severity, c_custkey % 5 = 0 AS notify_on_needs_review FROM customer JOIN nation ON c_nationkey = n_nationkey",
    "scans": "SELECT event_id AS id, user_id AS repo_id, CASE WHEN event_id % 9 <> 0 THEN k END AS pr_number, substr(md5(CAST(event_id AS VARCHAR)), 1, 12) AS commit_sha, CASE event_type WHEN 'purchase' THEN 'TRUE_POSITIVE' WHEN 'click' THEN 'NEEDS_REVIEW' WHEN 'error' THEN 'ERROR' ELSE 'FALSE_POSITIVE' END AS verdict, ['CRITICAL', 'HIGH', 'MEDIUM', 'LOW', 'INFO', 'N/A'][k % 6 + 1] AS severity, CASE WHEN k % 11 = 0 THEN NULL WHEN k % 10 = 0 THEN 'N/A' ELSE 'CWE-' || lpad(CAST(k AS VARCHAR), 3, '0') END AS cwe_id, least(1.0, value / 100) AS confidence, 't' || CAST(k % 7 AS VARCHAR) AS title, CASE WHEN event_id % 8 <> 0 THEN 'p' || CAST(event_id % 3 AS VARCHAR) END AS provider, ts AS created_at FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)",
    "feedback": "SELECT id AS scan_id, CAST(id % 25 + 1000 AS BIGINT) AS github_id, CASE WHEN (id + again) % 2 = 0 THEN 'FALSE_POSITIVE' ELSE 'TRUE_POSITIVE' END AS correct_verdict, CASE WHEN again = 1 THEN 'second look' END AS reason, created_at + (id % 10) * INTERVAL 1 DAY + again * INTERVAL 1 HOUR AS created_at FROM (SELECT id, created_at, 0 AS again FROM scans WHERE verdict = 'TRUE_POSITIVE' AND id % 3 = 0 UNION ALL SELECT id, created_at, 1 FROM scans WHERE verdict = 'TRUE_POSITIVE' AND id % 6 = 0)",
    "audit": "SELECT event_id AS id, user_id % 25 + 1000 AS github_id, CASE event_id % 3 WHEN 0 THEN 'scan_ingested' WHEN 1 THEN 'rescan_triggered' ELSE 'llm_key_issued' END AS action, user_id AS repo_id, '{\"pr_number\": ' || json_extract_string(props, '$.k') || '}' AS details, ts AS created_at FROM events",
}


def with_views(body: str, **more: str) -> str:
    """A DuckDB statement over the views; further named parts may follow. The body may start with its own WITH list, without WITH."""
    parts = [f"{k} AS ({v})" for k, v in {**VIEWS, **more}.items()]
    return f"WITH {', '.join(parts)} {body}"
