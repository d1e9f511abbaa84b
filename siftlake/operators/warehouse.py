"""Reports over the findings warehouse: (tables, parameters) -> DataFrame. Ties are broken by stated keys; time comes in as a parameter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftlake.functions import ranks
from siftlake.sources.domain import AS_OF, Principal, Tables

DEFAULT_LIMIT = 100
VERDICTS = {"true_positives": "TRUE_POSITIVE", "needs_review": "NEEDS_REVIEW", "false_positives": "FALSE_POSITIVE"}


def moment(as_of: str) -> Column:
    return F.lit(as_of).cast("timestamp_ntz")


def since(column: str, as_of: str, interval: str) -> Column:
    """Strictly newer than as_of minus an interval."""
    return F.col(column) > F.expr(f"timestamp_ntz '{as_of}' - INTERVAL {interval}")


def count_where(condition: Column) -> Column:
    return F.count_if(condition)


def verdict_counts() -> list[Column]:
    return [count_where(F.col("verdict") == v).alias(k) for k, v in VERDICTS.items()]


def visible_repos(t: Tables, who: Principal, policy: str) -> DataFrame:
    """Ids of the repositories a principal sees. owned: their own. live: also those of their live installations. login: also
    installed ones under their name, whether or not the installation is live. The three are not interchangeable."""
    repos = t.repos
    owned = repos.join(t.users.filter(F.col("github_id") == who.github_id).select(F.col("id").alias("user_id")), "user_id", "left_semi").select("id")
    if policy == "owned":
        return owned
    if policy == "live":
        live = t.installations.filter((F.col("account_login") == who.username) & F.col("deleted_at").isNull())
        more = repos.join(live, "installation_id", "left_semi").select("id")
    elif policy == "login":
        more = repos.filter(F.col("installation_id").isNotNull() & (F.col("owner") == who.username)).select("id")
    else:
        raise ValueError(f"unknown policy {policy!r}")
    return owned.union(more).distinct()


def visible_scans(t: Tables, who: Principal, policy: str) -> DataFrame:
    return t.scans.join(visible_repos(t, who, policy).withColumnRenamed("id", "repo_id"), "repo_id", "left_semi")


def named(t: Tables, scans: DataFrame) -> DataFrame:
    return scans.join(t.repos.select(F.col("id").alias("repo_id"), "owner", "name"), "repo_id")


def recent_scans(t: Tables, who: Principal = Principal(), policy: str = "live", limit: int = 100) -> DataFrame:
    newest = visible_scans(t, who, policy).orderBy(F.desc("created_at"), "id").limit(limit)
    return named(t, newest).select("id", "owner", "name", "verdict", "severity", "cwe_id", "confidence", "created_at")


def filtered_scans(t: Tables, who: Principal = Principal(), repo: str | None = None, verdict: str | None = None, severity: str | None = None, newer: str | None = None, limit: int = 50) -> DataFrame:
    """Own scans with optional filters; a filter that is None is not applied."""
    scans = visible_scans(t, who, "owned")
    for column, value in (("verdict", verdict), ("severity", severity)):
        scans = scans.filter(F.col(column) == value) if value is not None else scans
    scans = scans.filter(F.col("created_at") > moment(newer)) if newer is not None else scans
    scans = named(t, scans).withColumn("slug", F.concat("owner", F.lit("/"), "name"))
    scans = scans.filter(F.col("slug") == repo) if repo is not None else scans
    return scans.orderBy(F.desc("created_at"), "id").limit(max(1, min(200, limit))).select("id", "slug", "verdict", "severity", "created_at")


def dashboard_stats(t: Tables, who: Principal = Principal(), as_of: str = AS_OF) -> DataFrame:
    return visible_scans(t, who, "live").filter(since("created_at", as_of, "30 DAYS")).agg(F.count(F.lit(1)).alias("total"), *verdict_counts())


def mttf_days(t: Tables, who: Principal = Principal()) -> DataFrame:
    """Mean days from a true positive to each false-positive feedback, to one decimal, halves up; null if there is none."""
    scans = visible_scans(t, who, "live").filter(F.col("verdict") == "TRUE_POSITIVE").select(F.col("id").alias("scan_id"), F.col("created_at").alias("scanned_at"))
    both = scans.join(t.feedback.filter(F.col("correct_verdict") == "FALSE_POSITIVE"), "scan_id")
    return both.agg((F.floor(F.avg(ranks.days_between(F.col("created_at"), F.col("scanned_at"))) * 10 + 0.5) / 10).alias("mttf_days"))


def repo_stats(t: Tables, as_of: str = AS_OF) -> DataFrame:
    """Thirty-day counts and mean confidence in percent (halves to even) of every repository with scans."""
    scans = t.scans.filter(since("created_at", as_of, "30 DAYS"))
    return scans.groupBy("repo_id").agg(F.count(F.lit(1)).alias("total"), *verdict_counts(), F.rint(F.round(F.avg("confidence") * 100, 9)).alias("avg_conf"))


def repo_top_cwes(t: Tables, limit: int = 5) -> DataFrame:
    known = t.scans.filter((F.col("verdict") == "TRUE_POSITIVE") & F.col("cwe_id").isNotNull() & (F.col("cwe_id") != "N/A"))
    counts = known.groupBy("repo_id", "cwe_id").agg(F.count(F.lit(1)).alias("cnt"))
    place = F.row_number().over(W.partitionBy("repo_id").orderBy(F.desc("cnt"), "cwe_id"))
    return counts.withColumn("place", place).filter(F.col("place") <= limit)


def repo_list(t: Tables, who: Principal = Principal(), as_of: str = AS_OF) -> DataFrame:
    """Own repositories, then app-installed ones without an owner; one row for each slug, own first, installed if either is."""
    scans = t.scans.filter(since("created_at", as_of, "30 DAYS")).groupBy("repo_id").agg(F.count(F.lit(1)).alias("total_scans"), count_where(F.col("verdict") == "TRUE_POSITIVE").alias("true_positives"), F.max("created_at").alias("last_scan_at"))
    own = t.repos.join(visible_repos(t, who, "owned"), "id", "left_semi").select("id", "owner", "name", F.col("installation_id").isNotNull().alias("app_installed"), F.lit(0).alias("priority"))
    live = t.installations.filter(F.col("deleted_at").isNull()).select("installation_id", "account_login")
    app = t.repos.filter(F.col("user_id").isNull()).join(live, "installation_id").filter((F.col("account_login") == who.username) | (F.col("owner") == who.username))
    app = app.select("id", "owner", "name", F.lit(True).alias("app_installed"), F.lit(1).alias("priority"))
    merged = own.union(app).groupBy("owner", "name").agg(F.min_by("id", F.struct("priority", "id")).alias("id"), F.bool_or("app_installed").alias("app_installed"))
    listed = merged.join(scans.withColumnRenamed("repo_id", "id"), "id", "left")
    return listed.select("id", "owner", "name", "app_installed", F.coalesce("total_scans", F.lit(0)).alias("total_scans"), F.coalesce("true_positives", F.lit(0)).alias("true_positives"), "last_scan_at")


def repo_usage(t: Tables, as_of: str = AS_OF) -> DataFrame:
    """Scans of each repository in three windows, and what is left of its daily limit."""
    counts = t.scans.groupBy("repo_id").agg(*[count_where(since("created_at", as_of, w)).alias(n) for n, w in (("day", "24 HOURS"), ("week", "7 DAYS"), ("month", "30 DAYS"))], count_where(since("created_at", as_of, "24 HOURS") & (F.col("verdict") == "TRUE_POSITIVE")).alias("day_tp"))
    out = t.repos.join(counts.withColumnRenamed("repo_id", "id"), "id", "left").fillna(0, ["day", "week", "month", "day_tp"])
    limit = F.coalesce("custom_daily_limit", F.lit(DEFAULT_LIMIT))
    return out.select("id", "day", "week", "month", "day_tp", limit.alias("daily_limit"), F.greatest(F.lit(0), limit - F.col("day")).alias("remaining"))


def top_vulns(t: Tables, who: Principal = Principal(), as_of: str = AS_OF, limit: int = 15) -> DataFrame:
    """Most frequent weaknesses of the last thirty days. The filter leaves no false positives, so that column is always 0."""
    scans = visible_scans(t, who, "live").filter(since("created_at", as_of, "30 DAYS") & F.col("verdict").isin("TRUE_POSITIVE", "NEEDS_REVIEW") & F.col("cwe_id").isNotNull() & (F.col("cwe_id") != "N/A"))
    groups = scans.groupBy(ranks.query_cwe(F.col("cwe_id")).alias("cwe_id"), "severity")
    out = groups.agg(F.expr("mode() WITHIN GROUP (ORDER BY title)").alias("title"), F.count(F.lit(1)).alias("total"), *verdict_counts(), F.max("created_at").alias("last_seen"))
    return out.orderBy(F.desc("true_positives"), F.desc("total"), "cwe_id", "severity").limit(limit)


def weekly_trend(t: Tables, who: Principal = Principal(), as_of: str = AS_OF) -> DataFrame:
    """Verdicts by week (from Monday) of the last eight weeks; weeks without scans are absent."""
    scans = visible_scans(t, who, "login").filter(since("created_at", as_of, "56 DAYS"))
    weeks = scans.groupBy(F.date_trunc("week", "created_at").alias("start")).agg(*verdict_counts())
    height = F.col("true_positives") + F.col("needs_review") + F.col("false_positives")
    top = weeks.agg(F.greatest(F.lit(1), F.max(height)).alias("top"))
    return weeks.join(F.broadcast(top)).select(F.date_format("start", "MMM dd").alias("week"), *VERDICTS, (height * 100 / F.col("top")).cast("int").alias("height_pct"))


def open_breaches(t: Tables, as_of: str, days: int) -> DataFrame:
    """Severe true positives older than `days` that nobody has called false."""
    old = t.scans.filter((F.col("verdict") == "TRUE_POSITIVE") & F.col("severity").isin("CRITICAL", "HIGH") & (F.col("created_at") < F.expr(f"timestamp_ntz '{as_of}' - make_dt_interval({int(days)})")))
    dismissed = t.feedback.filter(F.col("correct_verdict") == "FALSE_POSITIVE").select(F.col("scan_id").alias("id"))
    return old.join(dismissed, "id", "left_anti")


def sla_breaches(t: Tables, who: Principal = Principal(), as_of: str = AS_OF, days: int | None = None, limit: int = 50) -> DataFrame:
    """The severities are ordered as text, so HIGH comes before CRITICAL."""
    days = max(1, min(90, days or 7))
    rows = open_breaches(t, as_of, days).join(visible_repos(t, who, "live").withColumnRenamed("id", "repo_id"), "repo_id", "left_semi")
    rows = rows.orderBy(F.desc("severity"), "created_at", "id").limit(limit)
    return named(t, rows).select("id", "owner", "name", "severity", "cwe_id", F.floor(ranks.days_between(moment(as_of), F.col("created_at"))).alias("days_open"))


def sla_by_repo(t: Tables, who: Principal = Principal(), as_of: str = AS_OF) -> DataFrame:
    rows = sla_breaches(t, who, as_of)
    return rows.groupBy("owner", "name").agg(F.array_join(F.sort_array(F.collect_list("id")), ",").alias("ids"), F.count(F.lit(1)).alias("breaches"))


def weekly_digest(t: Tables, as_of: str = AS_OF) -> DataFrame:
    """Week's counts, top weakness (count, then name), highest severity and open breaches of each repository that has scans or breaches."""
    week = t.scans.filter(since("created_at", as_of, "7 DAYS"))
    counts = week.groupBy("repo_id").agg(F.count(F.lit(1)).alias("total"), *verdict_counts())
    tp = week.filter(F.col("verdict") == "TRUE_POSITIVE")
    by_cwe = tp.filter(F.col("cwe_id").isNotNull() & (F.col("cwe_id") != "N/A")).groupBy("repo_id", "cwe_id").agg(F.count(F.lit(1)).alias("n"))
    top_cwe = by_cwe.groupBy("repo_id").agg(F.min_by("cwe_id", F.struct(-F.col("n"), "cwe_id")).alias("top_cwe"))
    top_severity = tp.groupBy("repo_id").agg(F.max_by("severity", F.struct(ranks.digest_severity_rank(F.col("severity")), "severity")).alias("top_severity"))
    sla = open_breaches(t, as_of, 7).groupBy("repo_id").agg(F.count(F.lit(1)).alias("sla_breaches"))
    out = t.repos.select(F.col("id").alias("repo_id"), "owner", "name")
    for part in (counts, top_cwe, top_severity, sla):
        out = out.join(part, "repo_id", "left")
    out = out.fillna(0, ["total", *VERDICTS, "sla_breaches"])
    return out.filter((F.col("total") > 0) | (F.col("sla_breaches") > 0)).drop("repo_id")


def scan_windows(t: Tables, as_of: str = AS_OF) -> DataFrame:
    """Five windows in one pass over the scans."""
    day, week, month = (since("created_at", as_of, w) for w in ("1 DAY", "7 DAYS", "30 DAYS"))
    return t.scans.agg(count_where(day).alias("today"), count_where(week).alias("week"), count_where(month).alias("month"), F.count(F.lit(1)).alias("total"), count_where((F.col("verdict") == "TRUE_POSITIVE") & month).alias("true_positives_month"), count_where((F.col("verdict") == "ERROR") & week).alias("errors_week"))


def top_repos(t: Tables, as_of: str = AS_OF, limit: int = 10) -> DataFrame:
    counts = t.scans.filter(since("created_at", as_of, "30 DAYS")).groupBy("repo_id").agg(F.count(F.lit(1)).alias("scans_30d"), count_where(F.col("verdict") == "TRUE_POSITIVE").alias("true_positives"))
    return named(t, counts).orderBy(F.desc("scans_30d"), "owner", "name").limit(limit).drop("repo_id")


def user_totals(t: Tables, as_of: str = AS_OF) -> DataFrame:
    return t.users.agg(F.count(F.lit(1)).alias("total"), count_where(since("created_at", as_of, "7 DAYS")).alias("new_this_week"))


def near_limit(t: Tables, as_of: str = AS_OF, share: str = "0.8") -> DataFrame:
    """Repositories whose scans of a day reach a share of their limit."""
    counts = t.scans.filter(since("created_at", as_of, "24 HOURS")).groupBy("repo_id").agg(F.count(F.lit(1)).alias("scans_today"))
    rows = counts.join(t.repos.withColumnRenamed("id", "repo_id"), "repo_id").withColumn("daily_limit", F.coalesce("custom_daily_limit", F.lit(DEFAULT_LIMIT)))
    return rows.filter(F.col("scans_today") >= F.col("daily_limit") * F.lit(share).cast("decimal(3,2)")).select("owner", "name", "scans_today", "daily_limit")


def errors_by_provider(t: Tables, as_of: str = AS_OF) -> DataFrame:
    """Grouped by the raw provider: a null one and one that is called unknown stay apart."""
    errors = t.scans.filter((F.col("verdict") == "ERROR") & since("created_at", as_of, "7 DAYS"))
    return errors.groupBy(F.col("provider").alias("raw")).agg(F.count(F.lit(1)).alias("total"), count_where(since("created_at", as_of, "1 DAY")).alias("today")).select(F.coalesce("raw", F.lit("unknown")).alias("provider"), "total", "today")


def error_share(t: Tables, as_of: str = AS_OF) -> DataFrame:
    """Each provider's share of the week's errors in percent, halves up."""
    by = errors_by_provider(t, as_of)
    every = by.agg(F.sum("total").alias("every"))
    return by.join(F.broadcast(every)).select("provider", F.when(F.col("every") > 0, F.floor(F.col("total") * 100 / F.col("every") + 0.5)).otherwise(0).cast("bigint").alias("share_pct"))


def top_error_titles(t: Tables, as_of: str = AS_OF, limit: int = 12) -> DataFrame:
    errors = t.scans.filter((F.col("verdict") == "ERROR") & since("created_at", as_of, "7 DAYS") & F.col("title").isNotNull())
    return errors.groupBy("title").agg(F.count(F.lit(1)).alias("n"), F.max("created_at").alias("last_seen")).orderBy(F.desc("n"), "title").limit(limit)


def daily_errors(t: Tables, as_of: str = AS_OF) -> DataFrame:
    errors = t.scans.filter((F.col("verdict") == "ERROR") & since("created_at", as_of, "7 DAYS"))
    return errors.groupBy(F.to_date("created_at").alias("day")).agg(F.count(F.lit(1)).alias("errors"))


def admin_users(t: Tables, limit: int = 200) -> DataFrame:
    """Each user with the repositories they own or reach through a live installation of their name.

    The two ways are two equi-joins whose pairs are united, in place of one join on an OR."""
    repos = t.repos.select(F.col("id").alias("repo_id"), "user_id", "installation_id", "custom_daily_limit")
    owned = t.users.select(F.col("id").alias("user_id"), "github_id").join(repos, "user_id").select("github_id", "repo_id")
    live = t.installations.filter(F.col("deleted_at").isNull()).select("installation_id", "account_login")
    reached = repos.join(live, "installation_id").join(t.users.select("github_id", F.col("username").alias("account_login")), "account_login").select("github_id", "repo_id")
    pairs = owned.union(reached).distinct()
    scans = t.scans.groupBy("repo_id").agg(F.count(F.lit(1)).alias("scans"), F.max("created_at").alias("last"))
    rows = t.users.join(pairs, "github_id", "left").join(repos.select("repo_id", "custom_daily_limit"), "repo_id", "left").join(scans, "repo_id", "left")
    out = rows.groupBy("github_id", "username", "email").agg(
        F.count("repo_id").alias("repo_count"),
        F.coalesce(F.sum("scans"), F.lit(0)).alias("total_scans"),
        F.max("last").alias("last_scan_at"),
        F.max(F.coalesce("custom_daily_limit", F.lit(DEFAULT_LIMIT))).alias("daily_limit"),
        F.bool_or(F.col("custom_daily_limit").isNotNull()).alias("has_custom_limit"),
    )
    return out.orderBy(F.desc_nulls_last("last_scan_at"), "github_id").limit(limit)


def badge_latest(t: Tables) -> DataFrame:
    """Latest verdict of each repository that is not an error (newest, then smallest id), else unknown; with the label's width."""
    latest = t.scans.filter(F.col("verdict") != "ERROR").groupBy("repo_id").agg(F.max_by("verdict", F.struct("created_at", -F.col("id"))).alias("verdict"))
    rows = t.repos.select(F.col("id").alias("repo_id")).join(latest, "repo_id", "left").withColumn("verdict", F.coalesce("verdict", F.lit("unknown")))
    return rows.withColumn("label_width", F.greatest(F.length("verdict") * 7 + 14, F.lit(50)))


def audit_recent(t: Tables, action: str | None = None, limit: int = 200) -> DataFrame:
    rows = t.audit.filter(F.col("action") == action) if action else t.audit
    return rows.orderBy(F.desc("created_at"), "id").limit(limit).select("id", "github_id", "action", "details", "created_at")


def rescan_counts(t: Tables, as_of: str = AS_OF, hours: int = 24) -> DataFrame:
    """Rescans of each repository and pull request within a window, from the details' JSON."""
    rows = t.audit.filter((F.col("action") == "rescan_triggered") & since("created_at", as_of, f"{int(hours)} HOURS"))
    return rows.groupBy("repo_id", F.get_json_object("details", "$.pr_number").cast("int").alias("pr_number")).agg(F.count(F.lit(1)).alias("rescans"))


def issuance_counts(t: Tables, as_of: str = AS_OF) -> DataFrame:
    """Keys issued in a day against each repository's limit."""
    issued = t.audit.filter((F.col("action") == "llm_key_issued") & since("created_at", as_of, "24 HOURS")).groupBy("repo_id").agg(F.count(F.lit(1)).alias("issued"))
    limits = t.repos.groupBy("owner", "name").agg(F.min("id").alias("repo_id"), F.coalesce(F.max("custom_daily_limit"), F.lit(DEFAULT_LIMIT)).alias("effective_limit"))
    return limits.join(issued, "repo_id", "left").select("repo_id", F.coalesce("issued", F.lit(0)).alias("issued"), "effective_limit", (F.coalesce("issued", F.lit(0)) < F.col("effective_limit")).alias("allowed"))


def search(t: Tables, who: Principal = Principal(), text: str = "cwe-0", limit: int = 100) -> DataFrame:
    """Free-text search over the newest visible scans: any field holds the text, whatever its case."""
    rows = recent_scans(t, who, "live", limit).join(t.scans.select("id", "commit_sha", "pr_number", "title"), "id")
    q = text.lower()
    fields = [F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in ("owner", "name", "title", "cwe_id", "severity", "pr_number")] + [F.substring("commit_sha", 1, 7)]
    hit = F.lit(False)
    for f in fields:
        hit = hit | f.contains(q)
    return rows.filter(hit).select("id", "verdict")


def search_facets(t: Tables, who: Principal = Principal(), limit: int = 100) -> DataFrame:
    return recent_scans(t, who, "live", limit).agg(*verdict_counts())
