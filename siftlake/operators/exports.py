"""What leaves the warehouse: SARIF documents, CSV, webhook payloads, summaries and comments. Texts are columns; nothing is sent from here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftlake.operators.verdicts import DEFAULT_RULE, csv_field, sarif_level, worst

# Names of common weaknesses.
CWE_NAMES = {
    "CWE-22": "Path Traversal", "CWE-78": "OS Command Injection", "CWE-79": "Cross-Site Scripting (XSS)", "CWE-89": "SQL Injection", "CWE-94": "Code Injection / SSTI", "CWE-95": "Eval Injection",
    "CWE-200": "Information Exposure", "CWE-287": "Improper Authentication", "CWE-306": "Missing Authentication", "CWE-327": "Use of Broken Cryptographic Algorithm", "CWE-352": "Cross-Site Request Forgery (CSRF)",
    "CWE-434": "Unrestricted File Upload", "CWE-502": "Deserialization of Untrusted Data", "CWE-601": "Open Redirect", "CWE-611": "XML External Entity (XXE)", "CWE-798": "Use of Hard-coded Credentials", "CWE-918": "Server-Side Request Forgery (SSRF)",
}
# Where weaknesses are described, the schema of the documents, and the header of the CSV.
CWE_PAGE = "https://cwe.mitre.org/data/definitions/"
SARIF_SCHEMA = "https://json.schemastore.org/sarif-2.1.0.json"
CSV_HEADER = "id,repo,pr_number,commit_sha,pr_url,verdict,severity,cwe_id,confidence,title,provider,scan_ms,created_at"
TOOL = "Siftlake"
DASHBOARD = "https://dashboard.example"
ALARM, WARNING = "\U0001f6a8", "⚠️"


def cwe_name(cwe: Column) -> Column:
    names = F.create_map(*[F.lit(x) for pair in CWE_NAMES.items() for x in pair])
    return F.coalesce(F.element_at(names, cwe), cwe)


def rule_name(cwe: Column) -> Column:
    """The weakness's name without spaces, slashes and brackets."""
    return F.regexp_replace(cwe_name(cwe), "[ /()]", "")


def help_uri(cwe: Column) -> Column:
    """The page of the weakness's number; null without a number."""
    digits = F.regexp_replace(cwe, "[^0-9]", "")
    return F.when(digits != "", F.concat(F.lit(CWE_PAGE), digits, F.lit(".html")))


def percent(share: Column) -> Column:
    """Hundredths, half up."""
    return F.floor(F.coalesce(share, F.lit(0.0)) * 100 + 0.5).cast("string")


def sarif_rule(cwe: Column, level: Column) -> Column:
    name, uri = cwe_name(cwe), help_uri(cwe)
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    about = F.struct(text("See ", uri, " for more information about ", name, ".").alias("text"), text("See [", cwe, "](", uri, ") for more information about ", name, ".").alias("markdown"))
    return F.struct(
        cwe.alias("id"), rule_name(cwe).alias("name"), F.struct(text(name, " (", cwe, ")").alias("text")).alias("shortDescription"), F.struct(text(f"{TOOL} found a possible weakness: ", name, ". Review the marked code and the comment on it.").alias("text")).alias("fullDescription"),
        F.struct(level.alias("level")).alias("defaultConfiguration"), F.struct(F.array(F.lit("security"), cwe).alias("tags")).alias("properties"), uri.alias("helpUri"), F.when(uri.isNotNull(), about).alias("help"),
    )


def sarif_document(results: DataFrame, runs: DataFrame) -> DataFrame:
    """pr_id, sarif: a whole SARIF 2.1.0 document for each change. results: see sarif_results; runs: pr_id, repo, commit_sha.

    One rule for each weakness, with the level of its first result; results in order. A change's findings bound its document."""
    region = F.when(F.col("line").isNotNull(), F.struct(F.col("line").alias("startLine")))
    place = F.struct(F.struct(F.struct(F.coalesce("uri", F.lit(".")).alias("uri"), F.lit("%SRCROOT%").alias("uriBaseId")).alias("artifactLocation"), F.when(F.col("uri").isNotNull(), region).alias("region")).alias("physicalLocation"))
    message = F.concat("title", F.lit(". Confidence: "), F.floor(F.col("confidence") * 100).cast("string"), F.lit("%. See the comment for evidence and remediation."))
    about = F.struct("confidence", "verdict", "severity", F.coalesce("provider", F.lit("unknown")).alias("provider"))
    one = F.struct(F.col("rule").alias("ruleId"), "level", F.struct(message.alias("text")).alias("message"), F.array(place).alias("locations"), about.alias("properties"))
    in_order = lambda value: F.transform(F.array_sort(F.collect_list(F.struct("place", value.alias("value")))), lambda x: x["value"])
    found = results.groupBy("pr_id").agg(in_order(one).alias("results"))
    first = results.groupBy("pr_id", "rule").agg(F.min("place").alias("place"), F.min_by("level", "place").alias("level"))
    rules = first.groupBy("pr_id").agg(in_order(sarif_rule(F.col("rule"), F.col("level"))).alias("rules"))
    rows = found.join(rules, "pr_id").join(runs, "pr_id")
    driver = F.struct(F.lit(TOOL).alias("name"), F.lit("1.0.0").alias("version"), "rules")
    run = F.struct(F.struct(driver.alias("driver")).alias("tool"), "results", F.struct(F.concat(F.lit("siftlake/"), "repo", F.lit("/"), F.substring("commit_sha", 1, 7)).alias("id")).alias("automationDetails"))
    return rows.select("pr_id", F.to_json(F.struct(F.lit("2.1.0").alias("version"), F.lit(SARIF_SCHEMA).alias("$schema"), F.array(run).alias("runs"))).alias("sarif"))


def dashboard_level(severity: Column, verdict: Column) -> Column:
    """By severity; severities outside the map (N/A among them) go by the verdict."""
    by_verdict = F.when(verdict == "TRUE_POSITIVE", "error").when(verdict == "NEEDS_REVIEW", "warning").when(verdict.isin("FALSE_POSITIVE", "ERROR"), "none").otherwise("warning")
    return F.when(severity.isin("CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO"), sarif_level(severity)).otherwise(by_verdict)


def dashboard_results(scans: DataFrame, most: int = 10_000) -> DataFrame:
    """id, result: the newest `most` scans' actionable ones as SARIF results at their repository. scans: id, owner, name, ... created_at (as text)."""
    repo = F.concat("owner", F.lit("/"), "name")
    newest = scans.orderBy(F.desc("created_at"), "id").limit(most).filter(F.col("verdict").isin("TRUE_POSITIVE", "NEEDS_REVIEW"))
    where = F.struct(F.struct(F.struct(repo.alias("uri"), F.lit("REPO").alias("uriBaseId")).alias("artifactLocation")).alias("physicalLocation"))
    about = F.struct(repo.alias("repo"), "pr_number", "commit_sha", "verdict", "severity", "confidence", "provider", F.col("created_at").alias("scanned_at"))
    rule = F.coalesce("cwe_id", F.lit(f"{DEFAULT_RULE}Unknown"))
    one = F.struct(rule.alias("ruleId"), dashboard_level(F.col("severity"), F.col("verdict")).alias("level"), F.struct(F.coalesce("title", F.lit("Security issue")).alias("text")).alias("message"), F.array(where).alias("locations"), about.alias("properties"))
    return newest.select("id", F.to_json(one, {"ignoreNullFields": "false"}).alias("result"))


def csv_document(scans: DataFrame, most: int = 10_000) -> DataFrame:
    """nth, line: the header and the newest `most` scans. scans: owner, name and the header's columns, created_at as text.

    The rank runs over the rows that are left of `most` only."""
    newest = scans.withColumn("repo", F.concat("owner", F.lit("/"), "name")).orderBy(F.desc("created_at"), "id").limit(most)
    nth = F.row_number().over(W.orderBy(F.desc("created_at"), "id"))
    lines = newest.select(nth.alias("nth"), F.concat_ws(",", *[csv_field(F.col(c)) for c in CSV_HEADER.split(",")]).alias("line"))
    return scans.sparkSession.createDataFrame([(0, CSV_HEADER)], "nth int, line string").unionAll(lines)


def payloads(findings: DataFrame) -> DataFrame:
    """The rows' id with slack, discord and teams: JSON messages about one finding. findings: id, owner, name, verdict, severity, cwe_id, confidence, title, pr_number, pr_url, commit_sha."""
    certain = F.col("verdict") == "TRUE_POSITIVE"
    icon = F.when(certain, ALARM).otherwise(WARNING)
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    title, severity, cwe = F.coalesce("title", F.lit("Security finding")), F.coalesce("severity", F.lit("N/A")), F.coalesce("cwe_id", F.lit("N/A"))
    repo, sha, sure = text(F.col("owner"), "/", F.col("name")), F.substring("commit_sha", 1, 7), text(percent(F.col("confidence")), "%")
    number = F.coalesce(F.col("pr_number").cast("string"), F.lit("?"))
    linked = F.col("pr_url").isNotNull()
    slack_link = F.when(linked, text("<", F.col("pr_url"), "|PR #", number, ">")).otherwise(text("commit `", sha, "`"))
    body = text(icon, " *", title, "*\n*Repo:* `", repo, "` · ", slack_link, "\n*Severity:* ", severity, " · *CWE:* ", cwe, " · *Confidence:* ", sure)
    headline = text(icon, f" *{TOOL}: ", F.when(certain, "security issue").otherwise("needs review"), "*")
    slack = F.struct(headline.alias("text"), F.array(F.struct(F.lit("section").alias("type"), F.struct(F.lit("mrkdwn").alias("type"), body.alias("text")).alias("text"))).alias("blocks"))
    field = lambda name, value: F.struct(F.lit(name).alias("name"), value.alias("value"), F.lit(True).alias("inline"))
    discord_link = F.when(linked, text("[PR #", number, "](", F.col("pr_url"), ")")).otherwise(text("`", sha, "`"))
    embed = F.struct(text(icon, " ", title).alias("title"), text("**Repo:** `", repo, "`\n**Verdict:** ", F.col("verdict"), "\n**Severity:** ", severity, " · **CWE:** ", cwe).alias("description"), F.when(certain, 0xE74C3C).otherwise(0xF39C12).alias("color"), F.array(field("Confidence", sure), field("PR", discord_link)).alias("fields"))
    fact = lambda name, value: F.struct(F.lit(name).alias("name"), value.alias("value"))
    facts = F.array(fact("Verdict", F.col("verdict")), fact("Severity", severity), fact("CWE", cwe), fact("Confidence", sure))
    facts = F.when(linked, F.concat(facts, F.array(fact("PR", text("[#", number, "](", F.col("pr_url"), ")"))))).otherwise(facts)
    section = F.struct(text(icon, " ", title).alias("activityTitle"), repo.alias("activitySubtitle"), facts.alias("facts"))
    teams = F.struct(F.lit("MessageCard").alias("@type"), F.when(certain, "FF0000").otherwise("FFA500").alias("themeColor"), title.alias("summary"), F.array(section).alias("sections"))
    return findings.select("id", F.to_json(slack).alias("slack"), F.to_json(F.struct(F.array(embed).alias("embeds"))).alias("discord"), F.to_json(teams).alias("teams"))


def digest_payloads(digest: DataFrame, base: str = DASHBOARD) -> DataFrame:
    """owner, name with slack, discord and teams: the week of each repository as JSON messages. digest: see warehouse.weekly_digest.

    Lines and facts stand in a fixed order; those about a top weakness and open breaches are there only where there are such."""
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    number = lambda name: F.col(name).cast("string")
    plural = lambda name, one, many: F.when(F.col(name) == 1, one).otherwise(many)
    repo, overdue = text(F.col("owner"), "/", F.col("name")), F.col("sla_breaches") > 0
    link, title = text(f"{base}/repos/", repo), text(f"{TOOL} weekly digest: ", repo)
    has_top, top = F.col("top_cwe").isNotNull(), text(F.col("top_cwe"), " (", F.coalesce("top_severity", F.lit("unknown")), ")")
    lines = lambda *each: F.array_join(F.array_compact(F.array(*[F.lit(x) if isinstance(x, str) else x for x in each])), "\n")
    late = text(number("sla_breaches"), " CRITICAL/HIGH ", plural("sla_breaches", "finding", "findings"), " open for more than 7 days")
    body = lines(
        "*Last 7 days:*", text("• ", number("true_positives"), plural("true_positives", " true positive", " true positives")), text("• ", number("needs_review"), plural("needs_review", " needs review", " need review")),
        text("• ", number("false_positives"), plural("false_positives", " false positive", " false positives")), F.when(has_top, text("• Top weakness: ", top)), F.when(overdue, text(f"{ALARM} *", late, "*")),
    )
    plain = lambda value: F.struct(F.lit("plain_text").alias("type"), value.alias("text"))
    button = F.struct(F.lit("button").alias("type"), plain(F.lit("View dashboard")).alias("text"), link.alias("url"))
    # the blocks of a message are of two forms, so each is written by itself
    header = F.to_json(F.struct(F.lit("header").alias("type"), plain(title).alias("text")))
    section = F.to_json(F.struct(F.lit("section").alias("type"), F.struct(F.lit("mrkdwn").alias("type"), body.alias("text")).alias("text"), button.alias("accessory")))
    opening = F.to_json(F.struct(title.alias("text")))
    slack = F.concat(F.substring(opening, F.lit(1), F.length(opening) - 1), F.lit(',"blocks":['), header, F.lit(","), section, F.lit("]}"))
    about = lines("**Last 7 days**", text("• ", number("true_positives"), " true positives"), text("• ", number("needs_review"), " needs review"), text("• ", number("false_positives"), " false positives"), F.when(has_top, text("• Top: ", top)), F.when(overdue, text(f"{ALARM} **", late, "**")))
    color = F.when(overdue, 0xFF0000).when(F.col("true_positives") > 0, 0xFBBF24).otherwise(0x4ADE80)
    embed = F.struct(title.alias("title"), link.alias("url"), color.alias("color"), about.alias("description"), F.struct(F.lit(f"{TOOL} • {base.split('://')[-1]}").alias("text")).alias("footer"))
    fact = lambda name, value: F.struct(F.lit(name).alias("name"), value.alias("value"))
    facts = F.array_compact(F.array(fact("True positives", number("true_positives")), fact("Needs review", number("needs_review")), fact("False positives", number("false_positives")), F.when(has_top, fact("Top weakness", top)), F.when(overdue, fact("Overdue", late))))
    action = F.struct(F.lit("OpenUri").alias("@type"), F.lit("View dashboard").alias("name"), F.array(F.struct(F.lit("default").alias("os"), link.alias("uri"))).alias("targets"))
    card = F.struct(F.lit(f"{TOOL} weekly digest").alias("activityTitle"), repo.alias("activitySubtitle"), facts.alias("facts"), F.array(action).alias("potentialAction"))
    teams = F.struct(F.lit("MessageCard").alias("@type"), F.lit("http://schema.org/extensions").alias("@context"), F.when(overdue, "FF0000").otherwise("FBBF24").alias("themeColor"), title.alias("summary"), F.array(card).alias("sections"))
    return digest.select("owner", "name", slack.alias("slack"), F.to_json(F.struct(F.array(embed).alias("embeds"))).alias("discord"), F.to_json(teams).alias("teams"))


def step_summary(verdicts: DataFrame) -> DataFrame:
    """pr_id, summary: the worst verdict in markdown lines, and with several verdicts their number."""
    rows = worst(verdicts)
    sure = F.bround(F.col("confidence") * 100, 0).cast("long").cast("string")
    head = F.concat(F.lit(f"## {TOOL}: "), "verdict", F.lit("\n\n**"), "title", F.lit("** (confidence: "), sure, F.lit("%, provider: "), F.coalesce("provider", F.lit("unknown")), F.lit(")"))
    tail = F.when(F.col("n") > 1, F.concat(F.lit("\n\n_"), F.col("n").cast("string"), F.lit(" file(s) analyzed, "), F.col("tp").cast("string"), F.lit(" true positive(s)_"))).otherwise("")
    return rows.select("pr_id", F.concat(head, tail, F.lit("\n")).alias("summary"))


def summary_comment(verdicts: DataFrame, runs: DataFrame) -> DataFrame:
    """pr_id, comment: a table of the worst verdict, its text, how many true positives there are, and evidence and remediation where no line is pinned. runs: pr_id, commit_sha."""
    rows = worst(verdicts).join(runs.select("pr_id", F.col("commit_sha").alias("head_sha")), "pr_id")
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    given = lambda name, label: F.when(F.coalesce(F.col(name), F.lit("")) != "", text(f"\n**{label}:** ", F.col(name))).otherwise("")
    sure = F.bround(F.col("confidence") * 100, 0).cast("long").cast("string")
    safe = F.when(F.col("sanitizer_found"), text("yes: ", F.coalesce("sanitizer_description", F.lit("")))).otherwise("none detected")
    table = text("| Field | Value |\n|---|---|\n| Verdict | **", F.col("verdict"), "** |\n| Severity | **", F.col("severity"), "** |\n| CWE | `", F.col("cwe_id"), "` |\n| Confidence | ", sure, "% |\n| Analyzed by | `", F.coalesce("provider", F.lit("unknown")), "` |\n| Sanitizer | ", safe, " |")
    many = F.when(F.col("tp") > 1, text("\n> ", F.col("tp").cast("string"), " true positive findings; the worst one is shown.\n")).otherwise("")
    pinned = (F.coalesce("line_number", F.lit(0)) > 0) & (F.coalesce("file_path", F.lit("")) != "")
    evidence = F.when(F.coalesce("evidence", F.lit("")) != "", text("\n<details><summary>Evidence</summary>\n\n```\n", F.col("evidence"), "\n```\n</details>")).otherwise("")
    detail = F.when(pinned, text("\n> Comment on `", F.col("file_path"), "` line ", F.col("line_number").cast("string"), ".\n")).otherwise(F.concat(given("attack_vector", "Attack vector"), given("remediation", "Remediation"), given("false_positive_reason", "Why not exploitable"), evidence))
    return rows.select("pr_id", text(f"<!-- siftlake -->\n## {TOOL}: `", F.col("verdict"), "`\n\n", table, "\n\n**", F.col("title"), "**\n\n", F.col("summary"), "\n", many, detail, "\n<sub>Commit `", F.substring("head_sha", 1, 7), "`</sub>\n").alias("comment"))


def inline_comments(verdicts: DataFrame, chosen: DataFrame) -> DataFrame:
    """pr_id, place, path, line, body: the comments on lines. chosen: see inline."""
    rows = verdicts.join(chosen.select("pr_id", "ord", "place"), ["pr_id", "ord"])
    fix = F.when(F.coalesce("remediation", F.lit("")) != "", F.concat(F.lit("\n\n**Remediation:** "), "remediation")).otherwise("")
    body = F.concat(F.lit("**"), "severity", F.lit("** `"), "cwe_id", F.lit("`: **"), "title", F.lit("**\n\n"), "summary", fix)
    return rows.select("pr_id", "place", F.ltrim("file_path", F.lit("/")).alias("path"), F.col("line_number").alias("line"), body.alias("body"))


def badge(latest: DataFrame) -> DataFrame:
    """repo_id, label, color, label_width, svg: a badge for each repository's latest verdict (repo_id, verdict)."""
    # Labels and colours.
    look = {"TRUE_POSITIVE": ("issues found", "#e11d48"), "FALSE_POSITIVE": ("clean", "#16a34a"), "NEEDS_REVIEW": ("needs review", "#d97706"), "ERROR": ("error", "#6b7280")}
    label, color = F.lower("verdict"), F.lit("#6b7280")
    for verdict, (name, tone) in look.items():
        label, color = F.when(F.col("verdict") == verdict, name).otherwise(label), F.when(F.col("verdict") == verdict, tone).otherwise(color)
    width = F.greatest(F.length(label) * 7 + 14, F.lit(50))
    left = 72
    svg = F.concat(F.lit('<svg xmlns="http://www.w3.org/2000/svg" width="'), (width + left).cast("string"), F.lit(f'" height="20"><rect width="{left}" height="20" fill="#555"/><rect x="{left}" width="'), width.cast("string"), F.lit('" height="20" fill="'), color, F.lit(f'"/><text x="{left // 2}" y="14">{TOOL}</text><text x="'), (F.lit(left) + width / 2).cast("string"), F.lit('" y="14">'), label, F.lit("</text></svg>"))
    return latest.select("repo_id", label.alias("label"), color.alias("color"), width.alias("label_width"), svg.alias("svg"))
