"""Verdicts from recorded model responses: parsing, calibration, ranking, deduplication and export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftlake.functions import ranks
from siftlake.operators.messages import repaired

VERDICTS = ("TRUE_POSITIVE", "FALSE_POSITIVE", "NEEDS_REVIEW", "ERROR")
SEVERITIES = ("CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO", "N/A")
TEXTS = ("title", "summary", "evidence", "sanitizer_description", "attack_vector", "remediation", "false_positive_reason")
DEFAULT_RULE = "Siftlake/Finding"
MAX_INLINE = 10


def strip_fence(text: Column) -> Column:
    """Text inside a code fence: the first line goes, and the last if it is a bare fence."""
    text = F.regexp_replace(text, r"^\s+|\s+$", "")
    inner = F.regexp_replace(F.regexp_replace(text, r"^```[^\n]*\n?", ""), r"\n?[ \t]*```[ \t]*$", "")
    return F.when(text.startswith("```"), F.regexp_replace(inner, r"^\s+|\s+$", "")).otherwise(text)


def fix_escapes(text: Column) -> Column:
    """Backslashes that start no JSON escape are doubled."""
    text = F.regexp_replace(text, r"\\u(?![0-9a-fA-F]{4})", r"\\\\\\\\u")
    return F.regexp_replace(text, r'\\(?!["\\/bfnrtu])', r"\\\\\\\\")


def _read(value: Column) -> Column:
    """struct of what a JSON object says, as it stands; null if the parsed value is no JSON object."""
    text = lambda name: F.try_variant_get(value, f"$.{name}", "string").alias(name)
    own = F.try_variant_get(value, "$.confidence", "variant")
    kind = F.schema_of_variant(own)
    number = F.when(kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), F.try_variant_get(value, "$.confidence", "double")).when(kind == "BOOLEAN", F.try_variant_get(value, "$.confidence", "boolean").cast("double"))
    found = F.struct(text("verdict"), text("severity"), text("cwe_id"), number.alias("confidence"), *map(text, TEXTS), F.coalesce(F.try_variant_get(value, "$.sanitizer_found", "boolean"), F.lit(False)).alias("sanitizer_found"))
    return F.when(F.schema_of_variant(value).startswith("OBJECT"), found)


def _once(rows: DataFrame, value: Column, name: str) -> DataFrame:
    """Add a column through a generator, so that the optimiser does not copy its expression to every place that reads it."""
    return rows.select("*", F.explode(F.array(value)).alias(name))


def parse(responses: DataFrame) -> DataFrame:
    """responses (…, content) with verdict, severity, cwe_id, confidence, sanitizer_found and texts.

    What is no JSON object is read again with the quotes inside its strings escaped. What cannot be read then, or names an unknown verdict or
    severity, is an ERROR of confidence 0. A confidence must be a finite number (true counts as 1); anything else counts as 0."""
    rows = responses.withColumn("json", fix_escapes(strip_fence(F.col("content"))))
    # each text is parsed once, and its fields are read from the parsed value
    rows = _once(rows, F.try_parse_json("json"), "value")
    rows = _once(rows, _read(F.col("value")), "first")
    # only texts that could not be read go through the repair
    rows = rows.withColumn("mended", repaired(F.when(F.col("first").isNull(), F.col("json"))))
    rows = _once(rows, F.try_parse_json("mended"), "second")
    rows = _once(rows, F.coalesce("first", _read(F.col("second"))), "own")
    field = lambda name, missing: F.coalesce(F.col(f"own.{name}"), F.lit(missing))
    known = F.col("own").isNotNull() & field("verdict", "ERROR").isin(*VERDICTS) & field("severity", "N/A").isin(*SEVERITIES)
    value = F.col("own.confidence")
    confidence = F.when(~F.isnan(value) & (F.abs(value) < float("inf")), F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)))
    keep = lambda value, other: F.when(known, value).otherwise(F.lit(other))
    columns = {"verdict": keep(field("verdict", "ERROR"), "ERROR"), "severity": keep(field("severity", "N/A"), "N/A"), "cwe_id": keep(field("cwe_id", "N/A"), "N/A"), "confidence": keep(F.coalesce(confidence, F.lit(0.0)), 0.0), "sanitizer_found": keep(F.col("own.sanitizer_found"), False)}
    columns |= {t: F.when(known, F.col(f"own.{t}")) for t in TEXTS} | {"title": keep(field("title", ""), "Analysis failed"), "summary": keep(field("summary", ""), "The answer could not be read.")}
    return rows.withColumns(columns).drop("json", "value", "first", "mended", "second", "own")


def fixed_verdicts(rows: DataFrame, kind: str, marker: str = "siftlake-ignore") -> DataFrame:
    """rows (pr_id, and reason, cwe_id, file_path, line_number where the kind has them) with a verdict made without a model.

    kind: no_op for changes without code to look at, suppressed for findings that a comment with a reason silences, error for failures (reason: what failed)."""
    cut = lambda text: F.substring(text, 1, 80)
    reason = F.col("reason") if "reason" in rows.columns else F.lit(None).cast("string")
    shown = F.coalesce(F.nullif(F.trim(reason), F.lit("")), F.lit("Analysis engine error"))
    made = {
        "no_op": ("FALSE_POSITIVE", 0.99, F.lit("No security-relevant changes detected"), F.lit("The diff contains no code changes requiring security analysis."), F.lit("Empty or non-security diff"), "siftlake/static-analysis"),
        "suppressed": ("FALSE_POSITIVE", 0.99, cut(F.concat(F.lit(f"Suppressed by {marker}: "), reason)), F.concat(F.lit(f"Finding suppressed by inline `{marker}` comment. Reason: "), reason), reason, "siftlake/suppress-rule"),
        "error": ("ERROR", 0.0, cut(shown), reason, F.lit(None).cast("string"), "unknown"),
    }
    verdict, confidence, title, summary, why, provider = made[kind]
    cwe = F.coalesce("cwe_id", F.lit("N/A")) if kind == "suppressed" else F.lit("N/A")
    place = [F.col(c) for c in ("file_path", "line_number") if c in rows.columns]
    return rows.select("pr_id", F.lit(verdict).alias("verdict"), F.lit("N/A").alias("severity"), cwe.alias("cwe_id"), F.lit(confidence).alias("confidence"), title.alias("title"), summary.alias("summary"), why.alias("false_positive_reason"), F.lit(provider).alias("provider"), *place)


def suppressed_changes(sinks: DataFrame) -> DataFrame:
    """A verdict for each change all of whose sinks a comment silences, from its first one. sinks: pr_id, path, line_no, suppressed, ignore_cwe, ignore_reason."""
    first = F.min(F.struct("path", "line_no", "ignore_cwe", "ignore_reason")).alias("first")
    quiet = sinks.groupBy("pr_id").agg(F.bool_and("suppressed").alias("quiet"), first).filter("quiet")
    rows = quiet.select("pr_id", F.coalesce("first.ignore_cwe", F.lit("N/A")).alias("cwe_id"), F.coalesce("first.ignore_reason", F.lit("no reason given")).alias("reason"), F.col("first.path").alias("file_path"), F.col("first.line_no").alias("line_number"))
    return fixed_verdicts(rows, "suppressed")


def calibrate(verdict: Column, confidence: Column) -> Column:
    """A true positive needs 0.7; below 0.5 nothing but review is certain."""
    first = F.when((verdict == "TRUE_POSITIVE") & (confidence < 0.7), "NEEDS_REVIEW").otherwise(verdict)
    return F.when((confidence < 0.5) & first.isin("TRUE_POSITIVE", "FALSE_POSITIVE"), "NEEDS_REVIEW").otherwise(first)


def primary(verdicts: DataFrame) -> DataFrame:
    """Worst verdict of each change by verdict, severity and confidence; the first of equals."""
    key = F.struct(ranks.verdict_rank(F.col("verdict")), ranks.engine_severity_rank(F.col("severity")), "confidence", -F.col("ord"))
    best = F.max_by(F.struct("ord", "verdict", "severity", "confidence"), key).alias("best")
    counts = [F.count_if(F.col("verdict") == "ERROR").alias("errors"), F.count_if(F.col("verdict").isin("TRUE_POSITIVE", "NEEDS_REVIEW")).alias("actionable")]
    return verdicts.groupBy("pr_id").agg(best, *counts).select("pr_id", "best.*", "errors", "actionable")


def worst(verdicts: DataFrame) -> DataFrame:
    """The verdicts that `primary` takes, whole, with how many verdicts and true positives (n, tp) their change has: one sort by change, and no second reading of the verdicts."""
    change = W.partitionBy("pr_id")
    order = change.orderBy(ranks.verdict_rank(F.col("verdict")).desc(), ranks.engine_severity_rank(F.col("severity")).desc(), F.desc("confidence"), "ord")
    rows = verdicts.withColumns({"nth": F.row_number().over(order), "n": F.count(F.lit(1)).over(change), "tp": F.count_if(F.col("verdict") == "TRUE_POSITIVE").over(change)})
    return rows.filter("nth = 1").drop("nth")


def inline(verdicts: DataFrame, most: int = MAX_INLINE) -> DataFrame:
    """Findings to pin to lines: by severity, then input order, the first `most`; with how many more there are."""
    fit = verdicts.filter(F.col("verdict").isin("TRUE_POSITIVE", "NEEDS_REVIEW") & (F.coalesce("line_number", F.lit(0)) != 0) & (F.coalesce("file_path", F.lit("")) != ""))
    order = W.partitionBy("pr_id").orderBy(ranks.engine_severity_rank(F.col("severity")).desc(), "ord")
    rows = fit.withColumns({"place": F.row_number().over(order), "eligible": F.count(F.lit(1)).over(W.partitionBy("pr_id"))})
    return rows.filter(F.col("place") <= most).select("pr_id", "ord", "place", F.greatest(F.lit(0), F.col("eligible") - most).alias("overflow"))


def rule_id(cwe: Column) -> Column:
    return F.when(cwe.isNull() | cwe.isin("", "N/A"), DEFAULT_RULE).otherwise(cwe)


def sarif_level(severity: Column) -> Column:
    return F.when(severity.isin("CRITICAL", "HIGH"), "error").when(severity == "MEDIUM", "warning").when(severity == "LOW", "note").when(severity.isin("INFO", "N/A"), "none").otherwise("warning")


def sarif_results(verdicts: DataFrame) -> DataFrame:
    """Actionable findings without repeats: the most confident of each weakness, file and line, in order of first sight."""
    rows = verdicts.filter(F.col("verdict").isin("TRUE_POSITIVE", "NEEDS_REVIEW")).select("pr_id", "ord", rule_id(F.col("cwe_id")).alias("rule"), F.nullif(F.ltrim(F.coalesce("file_path", F.lit("")), F.lit("/")), F.lit("")).alias("uri"), F.when(F.col("line_number") > 0, F.col("line_number")).alias("line"), "severity", "confidence", "verdict", "title", "provider")
    best = F.max_by(F.struct("severity", "confidence", "verdict", "title", "provider"), F.struct("confidence", -F.col("ord"))).alias("best")
    groups = rows.groupBy("pr_id", "rule", "uri", "line").agg(F.min("ord").alias("first_ord"), best)
    place = F.row_number().over(W.partitionBy("pr_id").orderBy("first_ord"))
    return groups.select("pr_id", place.alias("place"), "rule", "uri", "line", sarif_level(F.col("best.severity")).alias("level"), "best.severity", "best.confidence", "best.verdict", "best.title", "best.provider")


def sarif_rules(results: DataFrame) -> DataFrame:
    """One rule for each weakness, with the level of its first result."""
    return results.groupBy("pr_id", "rule").agg(F.min("place").alias("place"), F.min_by("level", "place").alias("level"), F.count(F.lit(1)).alias("results"))


def csv_field(value: Column) -> Column:
    """Quotes are doubled; fields with commas, quotes or line feeds are quoted; null is empty."""
    text = F.coalesce(value.cast("string"), F.lit(""))
    return F.when(text.rlike('[,"\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def outgoing(verdicts: DataFrame, marker: str = "siftlake-ignore", manual: bool = True) -> DataFrame:
    """JSON items for the warehouse: ten fields, and on the manual path suppressions, which need a reason and a title that names the marker.

    verdicts: with provider, reason, pr_number, commit_sha, pr_url, scan_ms."""
    suppressed = F.lit(manual) & F.col("reason").isNotNull() & F.contains(F.lower("title"), F.lit(marker))
    item = F.struct("verdict", "severity", "cwe_id", "confidence", F.substring("title", 1, 80).alias("title"), "provider", "pr_number", "commit_sha", "pr_url", "scan_ms", F.when(suppressed, F.lit(True)).alias("suppressed"), F.when(suppressed, F.col("reason")).alias("ignore_reason"))
    return verdicts.select("pr_id", "ord", F.to_json(item).alias("item"))
