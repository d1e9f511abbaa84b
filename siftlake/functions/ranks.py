"""Ranks and small expressions. Places that rank severities differently are kept apart and named by where they are used."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F


def _rank(column: Column, values: dict[str, int], other: int) -> Column:
    out = F.lit(other)
    for value, rank in values.items():
        out = F.when(column == value, F.lit(rank)).otherwise(out)
    return out


def engine_severity_rank(severity: Column) -> Column:
    """Aggregating verdicts and selecting inline findings: CRITICAL 5 to INFO 1, everything else 0."""
    return _rank(severity, {"CRITICAL": 5, "HIGH": 4, "MEDIUM": 3, "LOW": 2, "INFO": 1}, 0)


def ingest_severity_rank(severity: Column) -> Column:
    """Notifications: CRITICAL 4 to INFO 0, N/A -1; unknown names 0."""
    return _rank(severity, {"CRITICAL": 4, "HIGH": 3, "MEDIUM": 2, "LOW": 1, "INFO": 0, "N/A": -1}, 0)


def digest_severity_rank(severity: Column) -> Column:
    """Weekly digest: CRITICAL 4 to LOW 1, else 0."""
    return _rank(severity, {"CRITICAL": 4, "HIGH": 3, "MEDIUM": 2, "LOW": 1}, 0)


def verdict_rank(verdict: Column) -> Column:
    return _rank(verdict, {"TRUE_POSITIVE": 3, "NEEDS_REVIEW": 2, "ERROR": 1}, 0)


def role_rank(role: Column) -> Column:
    return _rank(role, {"platform:admin": 50, "org:owner": 40, "repo:admin": 30, "repo:developer": 20, "repo:viewer": 10}, 0)


def ingest_cwe(cwe: Column) -> Column:
    """Leading zeros of a weakness number go at ingest; CWE-000 becomes CWE-0."""
    return F.regexp_replace(cwe, "^CWE-0+([0-9]+)", "CWE-$1")


def query_cwe(cwe: Column) -> Column:
    """Leading zeros go in reports; CWE-000 becomes CWE- and a missing number Unknown."""
    stripped = F.concat(F.lit("CWE-"), F.ltrim(F.substring(cwe, 5, 1000), F.lit("0")))
    return F.when(cwe.rlike("^CWE-0"), stripped).otherwise(F.coalesce(cwe, F.lit("Unknown")))


def clamp_confidence(value: Column) -> Column:
    """Finite numbers to 0..1; anything else is null."""
    finite = ~F.isnan(value) & (F.abs(value) < float("inf"))
    return F.when(finite, F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)))


def confidence_label(value: Column) -> Column:
    return F.when(value >= 0.9, "Very High").when(value >= 0.7, "High").when(value >= 0.5, "Medium").otherwise("Low")


def commit_status(verdict: Column, confidence: Column) -> Column:
    certain = (verdict == "TRUE_POSITIVE") & (confidence >= 0.8)
    return F.when(certain, "failure").when(verdict.isin("TRUE_POSITIVE", "NEEDS_REVIEW"), "pending").when(verdict == "FALSE_POSITIVE", "success").otherwise("error")


def status_description(verdict: Column, title: Column, most: int = 100) -> Column:
    """The verdict in words and the title, cut to what a commit status may hold."""
    words = F.when(verdict == "TRUE_POSITIVE", "Issue").when(verdict == "NEEDS_REVIEW", "Needs review").when(verdict == "FALSE_POSITIVE", "Clean").otherwise("Error")
    return F.substring(F.concat(words, F.lit(": "), F.coalesce(title, F.lit(""))), 1, most)


def at_least(role: Column, least: str) -> Column:
    """Whether a role is at least as strong as another."""
    return role_rank(role) >= role_rank(F.lit(least))


def masked_key(key: Column, shown: int = 8) -> Column:
    """The first characters of a key and four stars; a key that is no longer is all stars."""
    return F.when(F.length(key) > shown, F.concat(F.substring(key, 1, shown), F.lit("****"))).when(key.isNotNull(), "****")


def hmac_sha256(message: Column, key: str) -> Column:
    """HMAC with SHA-256 as lowercase hex, from two plain digests."""
    raw = key.encode()
    raw = (hashlib.sha256(raw).digest() if len(raw) > 64 else raw).ljust(64, b"\0")
    pad = lambda n: F.lit(bytearray(b ^ n for b in raw))
    inner = F.unhex(F.sha2(F.concat(pad(0x36), message.cast("binary")), 256))
    return F.sha2(F.concat(pad(0x5C), inner), 256)


def should_notify(verdict: Column, severity: Column, least: Column, on_review: Column) -> Column:
    loud = verdict.isin("FALSE_POSITIVE", "ERROR")
    quiet_review = (verdict == "NEEDS_REVIEW") & ~on_review
    enough = ingest_severity_rank(F.coalesce(severity, F.lit("INFO"))) >= ingest_severity_rank(F.coalesce(least, F.lit("INFO")))
    return ~loud & ~quiet_review & enough


def relative_age(then: Column, now: Column) -> Column:
    minutes = F.floor((F.unix_micros(now.cast("timestamp")) - F.unix_micros(then.cast("timestamp"))) / 60_000_000)
    hours, days = F.floor(minutes / 60), F.floor(minutes / 1440)
    return F.when(minutes < 60, F.concat(minutes.cast("string"), F.lit("m ago"))).when(hours < 24, F.concat(hours.cast("string"), F.lit("h ago"))).otherwise(F.concat(days.cast("string"), F.lit("d ago")))


def mask_last_segment(url: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(url, "^([^?#]*)", 1), "/[^/]*$", "/****")


def days_between(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))) / F.lit(86_400_000_000.0)
