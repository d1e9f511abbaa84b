"""Queries over the warehouse and the SQL that must give the same rows."""

from __future__ import annotations

from siftlake.operators import warehouse as w
from siftlake.sources.domain import AS_OF, Principal, Tables, with_views

ME = Principal()
NOW = f"TIMESTAMP '{AS_OF}'"
COUNTS = "count(*) FILTER (WHERE verdict = 'TRUE_POSITIVE') AS true_positives, count(*) FILTER (WHERE verdict = 'NEEDS_REVIEW') AS needs_review, count(*) FILTER (WHERE verdict = 'FALSE_POSITIVE') AS false_positives"
#: Repositories that the principal sees, by policy.
VISIBLE = {"owned_repos": f"SELECT repos.* FROM repos JOIN users ON users.id = repos.user_id AND users.github_id = {ME.github_id}"}
VISIBLE["live_repos"] = f"SELECT * FROM owned_repos UNION SELECT repos.* FROM repos JOIN installations ON installations.installation_id = repos.installation_id AND account_login = '{ME.username}' WHERE deleted_at IS NULL"
VISIBLE["login_repos"] = f"SELECT * FROM owned_repos UNION SELECT * FROM repos WHERE installation_id IS NOT NULL AND owner = '{ME.username}'"
WEAK = "coalesce(regexp_replace(s.cwe_id, '^CWE-0+', 'CWE-'), 'Unknown')"
BREACH = f"s.verdict = 'TRUE_POSITIVE' AND s.severity IN ('CRITICAL', 'HIGH') AND s.created_at < {NOW} - INTERVAL 7 DAY AND NOT EXISTS (SELECT 1 FROM feedback f WHERE f.scan_id = s.id AND f.correct_verdict = 'FALSE_POSITIVE')"
DAYS = f"CAST(floor(epoch_us({NOW}) / 86400000000.0 - epoch_us(s.created_at) / 86400000000.0) AS BIGINT)"
RECENT = "SELECT s.id, r.owner, r.name, s.verdict, s.severity, s.cwe_id, s.confidence, s.created_at FROM scans s JOIN {} r ON s.repo_id = r.id ORDER BY s.created_at DESC, s.id LIMIT 100"
BREACHES = f"SELECT s.id, r.owner, r.name, s.severity, s.cwe_id, CAST(floor((epoch_us({NOW}) - epoch_us(s.created_at)) / 86400000000.0) AS BIGINT) AS days_open FROM scans s JOIN live_repos r ON s.repo_id = r.id WHERE {BREACH} ORDER BY s.severity DESC, s.created_at, s.id LIMIT 50"
ERRORS = f"FROM scans WHERE verdict = 'ERROR' AND created_at > {NOW} - INTERVAL 7 DAY"
BY_PROVIDER = f"SELECT coalesce(provider, 'unknown') AS provider, count(*) AS total, count(*) FILTER (WHERE created_at > {NOW} - INTERVAL 1 DAY) AS today {ERRORS} GROUP BY scans.provider"

#: name: (function of the tables, SQL)
WAREHOUSE = {
    "scans_recent_v1": (lambda t: w.recent_scans(t, policy="owned"), RECENT.format("owned_repos")),
    "scans_recent_v2": (lambda t: w.recent_scans(t, policy="live"), RECENT.format("live_repos")),
    "scans_recent_v3": (lambda t: w.recent_scans(t, policy="login"), RECENT.format("login_repos")),
    "scans_filtered_api": (
        lambda t: w.filtered_scans(t, verdict="TRUE_POSITIVE", newer="2024-01-10 00:00:00", limit=500),
        f"SELECT s.id, r.owner || '/' || r.name AS slug, s.verdict, s.severity, s.created_at FROM scans s JOIN owned_repos r ON s.repo_id = r.id WHERE s.verdict = 'TRUE_POSITIVE' AND s.created_at > TIMESTAMP '2024-01-10' ORDER BY s.created_at DESC, s.id LIMIT 200",
    ),
    "dashboard_stats": (w.dashboard_stats, f"SELECT count(*) AS total, {COUNTS} FROM scans s JOIN live_repos r ON s.repo_id = r.id WHERE s.created_at > {NOW} - INTERVAL 30 DAY"),
    "mttf_days": (w.mttf_days, f"SELECT floor(avg((epoch_us(f.created_at) - epoch_us(s.created_at)) / 86400000000.0) * 10 + 0.5) / 10 AS mttf_days FROM scans s JOIN feedback f ON f.scan_id = s.id JOIN live_repos r ON s.repo_id = r.id WHERE s.verdict = 'TRUE_POSITIVE' AND f.correct_verdict = 'FALSE_POSITIVE'"),
    "repo_stats": (w.repo_stats, f"SELECT repo_id, count(*) AS total, {COUNTS}, round_even(round(avg(confidence) * 100, 9), 0) AS avg_conf FROM scans WHERE created_at > {NOW} - INTERVAL 30 DAY GROUP BY repo_id"),
    "repo_top_cwes": (
        w.repo_top_cwes,
        "SELECT * FROM (SELECT repo_id, cwe_id, count(*) AS cnt, CAST(row_number() OVER (PARTITION BY repo_id ORDER BY count(*) DESC, cwe_id) AS INTEGER) AS place FROM scans WHERE verdict = 'TRUE_POSITIVE' AND cwe_id IS NOT NULL AND cwe_id <> 'N/A' GROUP BY repo_id, cwe_id) WHERE place <= 5",
    ),
    "repo_list": (
        w.repo_list,
        f"SELECT r.id, r.owner, r.name, r.installation_id IS NOT NULL AS app_installed, count(s.id) AS total_scans, count(s.id) FILTER (WHERE s.verdict = 'TRUE_POSITIVE') AS true_positives, max(s.created_at) AS last_scan_at FROM (SELECT * FROM owned_repos UNION SELECT repos.* FROM repos JOIN installations ON installations.installation_id = repos.installation_id WHERE user_id IS NULL AND deleted_at IS NULL AND '{ME.username}' IN (account_login, owner)) r LEFT JOIN scans s ON s.repo_id = r.id AND s.created_at > {NOW} - INTERVAL 30 DAY GROUP BY ALL",
    ),
    "repo_usage": (
        w.repo_usage,
        f"SELECT r.id, count(*) FILTER (WHERE s.created_at > {NOW} - INTERVAL 24 HOUR) AS day, count(*) FILTER (WHERE s.created_at > {NOW} - INTERVAL 7 DAY) AS week, count(*) FILTER (WHERE s.created_at > {NOW} - INTERVAL 30 DAY) AS month, count(*) FILTER (WHERE s.created_at > {NOW} - INTERVAL 24 HOUR AND s.verdict = 'TRUE_POSITIVE') AS day_tp, coalesce(r.custom_daily_limit, 100) AS daily_limit, greatest(0, coalesce(r.custom_daily_limit, 100) - count(*) FILTER (WHERE s.created_at > {NOW} - INTERVAL 24 HOUR)) AS remaining FROM repos r LEFT JOIN scans s ON s.repo_id = r.id GROUP BY r.id, r.custom_daily_limit",
    ),
    "top_vulns": (
        w.top_vulns,
        f"""SELECT cwe_id, severity, mode(title ORDER BY title) AS title, count(*) AS total, {COUNTS}, max(created_at) AS last_seen
FROM (SELECT {WEAK} AS cwe_id, severity, title, verdict, created_at FROM scans s SEMI JOIN live_repos r ON r.id = s.repo_id WHERE cwe_id <> 'N/A' AND verdict NOT IN ('FALSE_POSITIVE', 'ERROR') AND created_at > {NOW} - INTERVAL 30 DAY)
GROUP BY ALL ORDER BY true_positives DESC, total DESC, cwe_id, severity LIMIT 15""",
    ),
    "weekly_trend": (
        w.weekly_trend,
        f"SELECT strftime(start, '%b %d') AS week, true_positives, needs_review, false_positives, CAST(trunc((true_positives + needs_review + false_positives) * 100 / greatest(1, max(true_positives + needs_review + false_positives) OVER ())) AS INTEGER) AS height_pct FROM (SELECT date_trunc('week', s.created_at) AS start, {COUNTS} FROM scans s JOIN login_repos r ON s.repo_id = r.id WHERE s.created_at > {NOW} - INTERVAL 56 DAY GROUP BY 1)",
    ),
    "sla_breaches": (w.sla_breaches, BREACHES),
    "sla_by_repo": (w.sla_by_repo, f"SELECT owner, name, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS ids, count(*) AS breaches FROM ({BREACHES}) GROUP BY owner, name"),
    "weekly_digest": (
        w.weekly_digest,
        f"""SELECT owner, name, coalesce(total, 0) AS total, coalesce(true_positives, 0) AS true_positives, coalesce(needs_review, 0) AS needs_review, coalesce(false_positives, 0) AS false_positives, top_cwe, top_severity, coalesce(breaches, 0) AS sla_breaches
FROM repos
LEFT JOIN (SELECT repo_id, count(*) AS total, {COUNTS},
    arg_max(severity, {{'rank': coalesce(list_position(['LOW', 'MEDIUM', 'HIGH', 'CRITICAL'], severity), 0), 'name': severity}}) FILTER (WHERE verdict = 'TRUE_POSITIVE') AS top_severity
  FROM scans WHERE created_at > {NOW} - INTERVAL 7 DAY GROUP BY repo_id) week ON week.repo_id = repos.id
LEFT JOIN (SELECT repo_id, cwe_id AS top_cwe FROM scans WHERE verdict = 'TRUE_POSITIVE' AND cwe_id <> 'N/A' AND created_at > {NOW} - INTERVAL 7 DAY GROUP BY repo_id, cwe_id
  QUALIFY row_number() OVER (PARTITION BY repo_id ORDER BY count(*) DESC, cwe_id) = 1) worst ON worst.repo_id = repos.id
LEFT JOIN (SELECT repo_id, count(*) AS breaches FROM scans s WHERE {BREACH} GROUP BY repo_id) late ON late.repo_id = repos.id
WHERE total > 0 OR breaches > 0""",
    ),
    "admin_scan_windows": (
        w.scan_windows,
        f"SELECT count(*) FILTER (WHERE created_at > {NOW} - INTERVAL 1 DAY) AS today, count(*) FILTER (WHERE created_at > {NOW} - INTERVAL 7 DAY) AS week, count(*) FILTER (WHERE created_at > {NOW} - INTERVAL 30 DAY) AS month, count(*) AS total, count(*) FILTER (WHERE verdict = 'TRUE_POSITIVE' AND created_at > {NOW} - INTERVAL 30 DAY) AS true_positives_month, count(*) FILTER (WHERE verdict = 'ERROR' AND created_at > {NOW} - INTERVAL 7 DAY) AS errors_week FROM scans",
    ),
    "admin_top_repos": (w.top_repos, f"SELECT r.owner, r.name, count(*) AS scans_30d, count(*) FILTER (WHERE s.verdict = 'TRUE_POSITIVE') AS true_positives FROM scans s JOIN repos r ON s.repo_id = r.id WHERE s.created_at > {NOW} - INTERVAL 30 DAY GROUP BY r.id, r.owner, r.name ORDER BY scans_30d DESC, r.owner, r.name LIMIT 10"),
    "admin_user_totals": (w.user_totals, f"SELECT count(*) AS total, count(*) FILTER (WHERE created_at > {NOW} - INTERVAL 7 DAY) AS new_this_week FROM users"),
    "admin_near_limit": (w.near_limit, f"SELECT r.owner, r.name, count(*) AS scans_today, coalesce(r.custom_daily_limit, 100) AS daily_limit FROM repos r JOIN scans s ON s.repo_id = r.id WHERE s.created_at > {NOW} - INTERVAL 24 HOUR GROUP BY r.id, r.owner, r.name, r.custom_daily_limit HAVING count(*) >= coalesce(r.custom_daily_limit, 100) * 0.8"),
    "errors_by_provider": (w.errors_by_provider, BY_PROVIDER),
    "error_share": (w.error_share, f"SELECT provider, CAST(floor(total * 100.0 / sum(total) OVER () + 0.5) AS BIGINT) AS share_pct FROM ({BY_PROVIDER})"),
    "top_error_titles": (w.top_error_titles, f"SELECT title, count(*) AS n, max(created_at) AS last_seen {ERRORS} AND title IS NOT NULL GROUP BY title ORDER BY n DESC, title LIMIT 12"),
    "daily_errors": (w.daily_errors, f"SELECT CAST(created_at AS DATE) AS day, count(*) AS errors {ERRORS} GROUP BY 1"),
    "admin_users": (
        w.admin_users,
        """SELECT github_id, username, email, count(repo_id) AS repo_count, coalesce(sum(n), 0)::BIGINT AS total_scans, max(last_at) AS last_scan_at, coalesce(max(daily), 100) AS daily_limit, coalesce(bool_or(own), false) AS has_custom_limit
FROM users LEFT JOIN (
  SELECT member.user_id, repos.id AS repo_id, coalesce(custom_daily_limit, 100) AS daily, custom_daily_limit IS NOT NULL AS own
  FROM repos JOIN (SELECT user_id, id FROM repos WHERE user_id IS NOT NULL UNION
    SELECT u.id, r.id FROM repos r JOIN installations i USING (installation_id) JOIN users u ON u.username = i.account_login WHERE deleted_at IS NULL) member(user_id, id) ON member.id = repos.id
) mine(user_id, repo_id, daily, own) ON mine.user_id = users.id
LEFT JOIN (SELECT repo_id, count(*) AS n, max(created_at) AS last_at FROM scans GROUP BY repo_id) used USING (repo_id)
GROUP BY github_id, username, email ORDER BY last_scan_at DESC NULLS LAST, github_id LIMIT 200""",
    ),
    "badge_latest": (w.badge_latest, "SELECT repo_id, verdict, greatest(CAST(length(verdict) * 7 + 14 AS INTEGER), 50) AS label_width FROM (SELECT r.id AS repo_id, coalesce((SELECT s.verdict FROM scans s WHERE s.repo_id = r.id AND s.verdict <> 'ERROR' ORDER BY s.created_at DESC, s.id LIMIT 1), 'unknown') AS verdict FROM repos r)"),
    "audit_recent": (lambda t: w.audit_recent(t, "rescan_triggered"), "SELECT id, github_id, action, details, created_at FROM audit WHERE action = 'rescan_triggered' ORDER BY created_at DESC, id LIMIT 200"),
    "rescan_counts": (w.rescan_counts, f"SELECT repo_id, CAST(json_extract_string(details, '$.pr_number') AS INTEGER) AS pr_number, count(*) AS rescans FROM audit WHERE action = 'rescan_triggered' AND created_at > {NOW} - INTERVAL 24 HOUR GROUP BY ALL"),
    "issuance_counts": (
        w.issuance_counts,
        f"SELECT r.id AS repo_id, count(a.id) AS issued, coalesce(r.custom_daily_limit, 100) AS effective_limit, count(a.id) < coalesce(r.custom_daily_limit, 100) AS allowed FROM repos r LEFT JOIN audit a ON a.repo_id = r.id AND a.action = 'llm_key_issued' AND a.created_at > {NOW} - INTERVAL 24 HOUR GROUP BY r.id, r.custom_daily_limit",
    ),
    "search": (
        w.search,
        f"SELECT z.id, z.verdict FROM ({RECENT.format('live_repos')}) z JOIN scans s ON s.id = z.id WHERE contains(lower(z.owner), 'cwe-0') OR contains(lower(z.name), 'cwe-0') OR contains(lower(s.title), 'cwe-0') OR contains(lower(coalesce(z.cwe_id, '')), 'cwe-0') OR contains(lower(z.severity), 'cwe-0') OR contains(substr(s.commit_sha, 1, 7), 'cwe-0')",
    ),
    "search_facets": (w.search_facets, f"SELECT {COUNTS} FROM ({RECENT.format('live_repos')})"),
}

QUERIES = {name: (lambda spark, sf_dir, f=f: f(Tables(spark, sf_dir))) for name, (f, _) in WAREHOUSE.items()}
ORACLE_SQL = {name: with_views(sql, **VISIBLE) for name, (_, sql) in WAREHOUSE.items()}
