"""Counts of scans by day that merge: kept by batches or by a stream, and read as windows with exact edges.

A window that reaches back to a moment is the days after that moment's day, from the counts, and the scans of that one day after the moment, from the details. So the details are read for
one day of each window, whatever its length."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEYS = ("repo_id", "day", "verdict")


def by_day(scans: DataFrame) -> DataFrame:
    """repo_id, day, verdict, n."""
    return scans.groupBy("repo_id", F.to_date("created_at").alias("day"), "verdict").agg(F.count(F.lit(1)).alias("n"))


def merged(known: DataFrame | None, arrived: DataFrame) -> DataFrame:
    """Counts by day of what is known and of what arrived; both may have several rows of a key."""
    rows = arrived if known is None else known.unionByName(arrived)
    return rows.groupBy(*KEYS).agg(F.sum("n").alias("n"))


def _moment(as_of: str, back: str):
    return F.expr(f"timestamp_ntz '{as_of}' - INTERVAL {back}")


def window_counts(counts: DataFrame, details: DataFrame, as_of: str, windows: dict[str, str]) -> DataFrame:
    """repo_id, verdict and for each window (name: how far back) the scans after its start. details: repo_id, verdict, created_at."""
    starts = {name: _moment(as_of, back) for name, back in windows.items()}
    days = {name: F.to_date(start) for name, start in starts.items()}
    whole = counts.filter(F.col("day") > F.least(*days.values(), F.lit("9999-12-31").cast("date")))
    whole = whole.select("repo_id", "verdict", *[F.when(F.col("day") > day, F.col("n")).otherwise(0).alias(name) for name, day in days.items()])
    inside = {name: (F.col("created_at") > start) & (F.col("created_at") < F.date_add(days[name], 1).cast("timestamp_ntz")) for name, start in starts.items()}
    some = None
    for one in inside.values():
        some = one if some is None else some | one
    edge = details.filter(some).select("repo_id", "verdict", *[one.cast("long").alias(name) for name, one in inside.items()])
    return whole.unionByName(edge).groupBy("repo_id", "verdict").agg(*[F.sum(name).alias(name) for name in windows])


def weekly_counts(counts: DataFrame, details: DataFrame, as_of: str, back: str) -> DataFrame:
    """repo_id, verdict, start of week, n of the scans after the window's start; the edge day's scans come from the details."""
    start = _moment(as_of, back)
    day = F.to_date(start)
    whole = counts.filter(F.col("day") > day).select("repo_id", "verdict", F.date_trunc("week", "day").cast("timestamp_ntz").alias("start"), "n")
    edge = details.filter((F.col("created_at") > start) & (F.col("created_at") < F.date_add(day, 1).cast("timestamp_ntz")))
    edge = edge.select("repo_id", "verdict", F.date_trunc("week", "created_at").cast("timestamp_ntz").alias("start"), F.lit(1).cast("long").alias("n"))
    return whole.unionByName(edge).groupBy("repo_id", "verdict", "start").agg(F.sum("n").alias("n"))
