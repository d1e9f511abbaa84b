"""A table of earlier verdicts by path and diff, with expiry: looked up as of a time, and added to for what was missing.

The table is partitioned by day, so a look-up reads the days that can still hold, and expired days go as whole partitions. It holds no code: evidence and attack are blank."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlake.operators import verdicts as v

#: Days that an entry holds, and characters of its key.
HOLDS_DAYS, KEY_CHARS = 7, 16
#: Days of the table that are kept; expired entries are seen as such so long.
KEPT_DAYS = 28
#: Fields of a stored verdict, in order; the two that may quote code are stored blank.
FIELDS = ("verdict", "severity", "cwe_id", "confidence", "title", "summary", "evidence", "sanitizer_found", "sanitizer_description", "attack_vector", "remediation", "false_positive_reason")
BLANK = {"evidence": "", "attack_vector": None}
SCHEMA = "key string, cached_at timestamp_ntz, content string, day date"


def cache_key(path: Column, diff: Column) -> Column:
    """The key of a file's change: the start of a hash of path and diff."""
    return F.substring(F.sha2(F.concat(path, F.lit(":"), diff).cast("binary"), 256), 1, KEY_CHARS)


def entries(verdicts: DataFrame, now: Column) -> DataFrame:
    """key, cached_at, content, day of new verdicts (key and FIELDS). Several of one key: the last by content, so that repeats give one entry."""
    value = F.to_json(F.struct(*[F.lit(BLANK[f]).cast("string").alias(f) if f in BLANK else F.col(f) for f in FIELDS]), {"ignoreNullFields": "false"})
    rows = verdicts.select("key", value.alias("content")).groupBy("key").agg(F.max("content").alias("content"))
    return rows.select("key", now.cast("timestamp_ntz").alias("cached_at"), "content", F.to_date(now).alias("day"))


def append(rows: DataFrame, path: str) -> None:
    """Add entries to the stored table."""
    rows.write.mode("append").partitionBy("day").parquet(path)


def stored(spark: SparkSession, path: str) -> DataFrame:
    """The stored table; an empty one where nothing is stored yet."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], SCHEMA)
    return spark.read.schema(SCHEMA).parquet(path)


def looked_up(items: DataFrame, store: DataFrame, now: Column, days: int = HOLDS_DAYS, kept: int = KEPT_DAYS) -> DataFrame:
    """items (with key) with state (hit, expired or missing) and, for hits, the stored content.

    The last entry of a key up to `now` counts, and holds for exactly `days` days. Partitions older than `kept` days are not read, as `removable` ones may be gone: what is only there is missing."""
    reaches = (F.col("cached_at") <= now) & (F.col("day") >= F.date_sub(F.to_date(now), kept)) & (F.col("day") <= F.to_date(now))
    last = store.filter(reaches).groupBy("key").agg(F.max_by(F.struct("cached_at", "content"), F.struct("cached_at", "content")).alias("last"))
    rows = items.join(last, "key", "left")
    holds = F.col("last.cached_at") >= now.cast("timestamp_ntz") - F.expr(f"INTERVAL {days} DAYS")
    state = F.when(F.col("last").isNull(), "missing").when(holds, "hit").otherwise("expired")
    return rows.withColumn("state", state).withColumn("content", F.when(F.col("state") == "hit", F.col("last.content"))).drop("last")


def removable(store: DataFrame, now: Column, kept: int = KEPT_DAYS) -> DataFrame:
    """The days whose partitions no look-up reads any more."""
    return store.filter(F.col("day") < F.date_sub(F.to_date(now), kept)).select("day").distinct()


def answered(items: DataFrame, store: DataFrame, now: Column, ask: Callable[[DataFrame], DataFrame], days: int = HOLDS_DAYS) -> tuple[DataFrame, DataFrame]:
    """(items with their verdict columns and whether they were `cached`, entries to append). Answers that are errors are not stored. Both come from one plan: where asking is dear, write the first before making the second.

    ask: from items without a verdict to the same items with `content`, a model's answer. Items that are looked up or asked for share the parser, so a stored verdict reads as a new one."""
    known = looked_up(items, store, now, days)
    hits = known.filter("state = 'hit'").drop("state").withColumn("cached", F.lit(True))
    fresh = ask(known.filter("state <> 'hit'").drop("state", "content")).withColumn("cached", F.lit(False))
    parsed = v.parse(hits.unionByName(fresh)).drop("content")
    return parsed, entries(parsed.filter(~F.col("cached") & (F.col("verdict") != "ERROR")), now)
