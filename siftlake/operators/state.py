"""Changes to the warehouse as folds over append-only logs: the latest state of each key, survivors of deletions, derived rows."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftlake.functions import ranks
from siftlake.operators.warehouse import DEFAULT_LIMIT, moment
from siftlake.sources.domain import AS_OF, Tables

FEEDBACK_REASON = "Marked false positive via feedback"


def latest(log: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The last row of each key."""
    place = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return log.withColumn("place", place).filter("place = 1").drop("place")


def latest_feedback(t: Tables) -> DataFrame:
    return latest(t.feedback, ["scan_id", "github_id"], [F.desc("created_at"), "correct_verdict"]).select("scan_id", "github_id", "correct_verdict", "reason")


def derived_ignore_rules(t: Tables) -> DataFrame:
    """A true positive that feedback calls false becomes a rule: by weakness if known, else by title. Repeats stay."""
    scans = t.scans.filter(F.col("verdict") == "TRUE_POSITIVE").select(F.col("id").alias("scan_id"), "repo_id", "cwe_id", "title")
    rows = t.feedback.filter(F.col("correct_verdict") == "FALSE_POSITIVE").join(scans, "scan_id")
    known = F.col("cwe_id").isNotNull() & (F.col("cwe_id") != "N/A")
    rows = rows.filter(known | (F.coalesce("title", F.lit("")) != ""))
    return rows.select("repo_id", F.when(known, F.col("cwe_id")).alias("cwe_id"), F.when(~known, F.col("title")).alias("title_keyword"), F.coalesce("reason", F.lit(FEEDBACK_REASON)).alias("reason"))


def _with_age(t: Tables, scans: DataFrame, as_of: str, default_days: int) -> DataFrame:
    """Scans with `old`: whether they are older than their owner's retention; without owner or setting, the default."""
    owners = t.users.select(F.col("id").alias("user_id"), "scan_retention_days")
    days = t.repos.select(F.col("id").alias("repo_id"), "user_id").join(owners, "user_id", "left").select("repo_id", F.coalesce("scan_retention_days", F.lit(default_days)).alias("days"))
    old = F.col("created_at") < moment(as_of) - F.expr("make_dt_interval(days)")
    return scans.join(days, "repo_id", "left").withColumn("old", F.coalesce(old, F.lit(False)))


def retained_scans(t: Tables, as_of: str = AS_OF, default_days: int = 90) -> DataFrame:
    """Scans that are not older than their owner's retention."""
    return _with_age(t, t.scans, as_of, default_days).filter("NOT old").select("id", "repo_id")


def expired_scans(t: Tables, scans: DataFrame, as_of: str = AS_OF, default_days: int = 90) -> DataFrame:
    """The other ones, of a stored table of scans (repo_id, created_at and more)."""
    return _with_age(t, scans, as_of, default_days).filter("old").select(scans.columns)


def account_survivors(t: Tables, github_id: int = 1004) -> DataFrame:
    """Rows of each table that are left when an account, its repositories and all that hangs on them go."""
    gone = t.users.filter(F.col("github_id") == github_id).select(F.col("id").alias("user_id"))
    repos = t.repos.join(gone, "user_id", "left_anti")
    scans = t.scans.join(repos.select(F.col("id").alias("repo_id")), "repo_id", "left_semi")
    feedback = t.feedback.filter(F.col("github_id") != github_id).join(scans.select(F.col("id").alias("scan_id")), "scan_id", "left_semi")
    left = {"users": t.users.filter(F.col("github_id") != github_id), "repos": repos, "scans": scans, "feedback": feedback, "audit": t.audit.filter(F.col("github_id") != github_id)}
    out = None
    for name, rows in left.items():
        one = rows.agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n"))
        out = one if out is None else out.union(one)
    return out


def upserted_users(t: Tables) -> DataFrame:
    """Sign-ins over the users: a new name always, a new e-mail only if there is one; is_new tells first sign-ins."""
    signins = t.audit.select((F.col("github_id") + F.col("id") % 3).alias("github_id"), F.concat(F.lit("login_"), (F.col("id") % 5).cast("string")).alias("username"), F.when(F.col("id") % 4 == 0, F.concat(F.lit("m"), F.col("id").cast("string"), F.lit("@example.org"))).alias("email"), "id")
    fold = signins.groupBy("github_id").agg(F.max_by("username", "id").alias("new_name"), F.max_by("email", F.when(F.col("email").isNotNull(), F.col("id"))).alias("new_email"))
    rows = t.users.select("github_id", "username", "email").join(fold, "github_id", "full")
    return rows.select("github_id", F.coalesce("new_name", "username").alias("username"), F.coalesce("new_email", "email").alias("email"), F.col("username").isNull().alias("is_new"))


def latest_installations(t: Tables) -> DataFrame:
    """Installation events folded: the last one decides whether an installation is live."""
    log = t.audit.select((F.col("github_id") + 4000).alias("installation_id"), "id", (F.col("id") % 4 == 0).alias("removal"), "created_at")
    last = latest(log, ["installation_id"], [F.desc("created_at"), F.desc("id")])
    return last.select("installation_id", F.when(F.col("removal"), F.col("created_at")).alias("deleted_at"))


def latest_repos(t: Tables) -> DataFrame:
    """Limit overrides folded into the repositories: the last override of each wins, and one without a value keeps the old limit."""
    log = t.audit.select("repo_id", "id", F.when(F.col("id") % 5 != 0, (F.col("id") % 50).cast("int")).alias("new_limit"))
    last = log.groupBy("repo_id").agg(F.max_by("new_limit", "id").alias("new_limit"))
    return t.repos.select(F.col("id").alias("repo_id"), "custom_daily_limit").join(last, "repo_id", "left").select("repo_id", F.coalesce("new_limit", "custom_daily_limit").alias("custom_daily_limit"))


def clamped_settings(t: Tables) -> DataFrame:
    """Requested retention days: floored and kept within 1 and 365."""
    asked = F.col("confidence") * 500 - 20
    return t.scans.select("id", F.greatest(F.lit(1), F.least(F.lit(365), F.floor(asked))).alias("days"))


def normalized(t: Tables) -> DataFrame:
    """Scans as ingest stores them: weakness without leading zeros, confidence within 0 and 1; `stored` gives whole rows."""
    return t.scans.select("id", ranks.ingest_cwe(F.col("cwe_id")).alias("cwe_id"), ranks.clamp_confidence(F.col("confidence") * 3 - 1).alias("confidence"), F.substring("commit_sha", 1, 7).alias("sha7"), ranks.confidence_label(F.col("confidence")).alias("label"), ranks.commit_status(F.col("verdict"), F.col("confidence")).alias("status"))


def stored(items: DataFrame) -> DataFrame:
    """Items as ingest stores them, whole rows: texts cut to length, weakness and confidence normalised, defaults where fields are missing. items: id, and the columns below."""
    cut = lambda name, n: F.substring(name, 1, n).alias(name)
    return items.select("id", "repo_id", "pr_number", cut("commit_sha", 40), "pr_url", "verdict", F.coalesce("severity", F.lit("N/A")).alias("severity"), F.coalesce(ranks.ingest_cwe(F.col("cwe_id")), F.lit("N/A")).alias("cwe_id"), F.coalesce(ranks.clamp_confidence(F.col("confidence")), F.lit(0.0)).alias("confidence"), cut("title", 80), F.coalesce("provider", F.lit("unknown")).alias("provider"), F.coalesce("scan_ms", F.lit(0)).alias("scan_ms"), F.coalesce("suppressed", F.lit(False)).alias("suppressed"), cut("ignore_reason", 200))


def ignore_rules(log: DataFrame) -> DataFrame:
    """Ignore rules that are left after an append-only log of additions and deletions. log: id, repo_id, action ('add' or 'delete'), rule_id, cwe_id, reason; the last action of a rule counts."""
    last = log.groupBy("repo_id", "rule_id").agg(F.max_by(F.struct("action", "cwe_id", "reason"), "id").alias("last"))
    return last.filter(F.col("last.action") == "add").select("repo_id", "rule_id", "last.cwe_id", "last.reason")


def live_keys(log: DataFrame) -> DataFrame:
    """Keys after rotations and revocations: one hash for each user, none after a revocation. log: id, github_id, action ('rotate' or 'revoke'), token."""
    last = log.groupBy("github_id").agg(F.max_by(F.struct("action", "token"), "id").alias("last"))
    return last.filter(F.col("last.action") == "rotate").select("github_id", F.sha2(F.col("last.token").cast("binary"), 256).alias("token_hash"), ranks.masked_key(F.col("last.token")).alias("shown"))


def audit_rows(scans: DataFrame) -> DataFrame:
    """The audit rows that ingest appends: one for each stored scan."""
    details = F.to_json(F.struct("verdict", "severity", F.substring("commit_sha", 1, 7).alias("sha")))
    return scans.select(F.col("id").alias("scan_id"), F.lit("scan_ingested").alias("action"), "repo_id", details.alias("details"), "created_at")


def valid_batches(items: DataFrame) -> DataFrame:
    """Batches of ingested items (batch, ord, verdict, commit_sha): one bad item rejects its whole batch."""
    good = F.coalesce(F.col("verdict").isin("TRUE_POSITIVE", "FALSE_POSITIVE", "NEEDS_REVIEW", "ERROR") & (F.col("commit_sha") != ""), F.lit(False))
    return items.groupBy("batch").agg(F.bool_and(good).alias("accepted"), F.count(F.lit(1)).alias("items"))


def notify_primary(t: Tables) -> DataFrame:
    """The finding of each pull request that is announced: the most severe that the repository wants to hear of, the first of equals."""
    rows = t.scans.join(t.repos.select(F.col("id").alias("repo_id"), "notify_min_severity", "notify_on_needs_review"), "repo_id")
    wanted = rows.filter(ranks.should_notify(F.col("verdict"), F.col("severity"), F.col("notify_min_severity"), F.col("notify_on_needs_review")))
    return wanted.groupBy("repo_id", "pr_number").agg(F.max_by("id", F.struct(ranks.ingest_severity_rank(F.col("severity")), -F.col("id"))).alias("id"))


def batch_primary(t: Tables) -> DataFrame:
    """The most severe finding of each pull request, whatever its verdict, the first of equals."""
    return t.scans.groupBy("repo_id", "pr_number").agg(F.max_by("id", F.struct(ranks.ingest_severity_rank(F.col("severity")), -F.col("id"))).alias("id"))


def accept(requests: DataFrame, hours: int = 24) -> DataFrame:
    """Rate limit: a request (repo_id, id, ts, daily_limit) is accepted if fewer than daily_limit accepted ones lie in the window before it.

    Whether one is accepted depends on earlier acceptances, so each repository's requests run in order through a small state."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        repo, kept = None, deque()  # times of accepted requests in the window: at most the limit of one repository
        for rows in batches:
            flags = []
            for own, ts, limit in zip(rows["repo_id"], rows["ts"], rows["daily_limit"], strict=True):
                if own != repo:
                    repo, kept = own, deque()
                while kept and kept[0] <= ts - hours * 3_600_000_000:
                    kept.popleft()
                flags.append(len(kept) < limit)
                if flags[-1]:
                    kept.append(ts)
            yield pd.DataFrame({"repo_id": rows["repo_id"], "id": rows["id"], "accepted": flags})

    micros = F.unix_micros(F.col("ts").cast("timestamp")).alias("ts")
    rows = requests.select("repo_id", "id", micros, F.coalesce("daily_limit", F.lit(DEFAULT_LIMIT)).alias("daily_limit"))
    return rows.repartition("repo_id").sortWithinPartitions("repo_id", "ts", "id").mapInPandas(run, "repo_id bigint, id bigint, accepted boolean")
