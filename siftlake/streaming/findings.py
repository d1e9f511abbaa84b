"""Structured Streaming forms of the event-shaped queries; on closed input they give the batch answers."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from siftlake.functions import ranks


def ingest(items: DataFrame) -> DataFrame:
    """Arriving scans as they are stored: stateless, so it serves streams and batches alike."""
    return items.select("event_id", F.col("ts").cast("timestamp").alias("ts"), ranks.clamp_confidence(F.col("value") / 100).alias("confidence"), "event_type")


def weekly_counts(items: DataFrame, late: str = "7 days") -> DataFrame:
    """Events by week from Monday. The epoch was a Thursday, hence the offset of four days."""
    rows = items.select(F.col("ts").cast("timestamp").alias("ts"), "event_type").withWatermark("ts", late)
    weeks = rows.groupBy(F.window("ts", "7 days", "7 days", "4 days").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return weeks.select(F.to_date("w.start").alias("week"), "event_type", "n")


def sliding_counts(items: DataFrame, window: str = "24 hours", step: str = "6 hours", late: str = "1 day") -> DataFrame:
    """Events of each user in sliding windows: usage against a quota."""
    rows = items.select(F.col("ts").cast("timestamp").alias("ts"), "user_id").withWatermark("ts", late)
    return rows.groupBy(F.window("ts", window, step).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.end").alias("until"), "user_id", "n")


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Run a stream over all that is there now, into Parquet; started again, it goes on where it stopped."""
    stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint).option("path", path).trigger(availableNow=True).start().awaitTermination()


def arriving(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream of files."""
    return spark.readStream.schema(spark.read.parquet(f"{sf_dir}/events.parquet").schema).parquet(f"{sf_dir}/events*.parquet")


def folder(spark: SparkSession) -> str:
    """A new folder that driver and executors share; one of this machine in local mode only."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{(root or tempfile.mkdtemp(prefix='siftlake-streams-')).rstrip('/')}/stream-{uuid.uuid4().hex}"


def _numbers(spark: SparkSession, path: str, pattern: str) -> list[int]:
    """The numbers in the names of a folder's entries that match, in order; none where the folder is missing."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [x.getPath().getName() for x in files.listStatus(at)] if files.exists(at) else []
    return sorted(int(m[1]) for m in (re.fullmatch(pattern, n) for n in names) if m)


@contextmanager
def rocks(spark: SparkSession) -> Iterator[None]:
    """State in RocksDB, which timers and several states of a key need; the session's setting comes back afterwards."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def _same(rows: DataFrame) -> DataFrame:
    return rows


class Kept:
    """A table that a stream's batches are folded into, in folders named by the batch's number.

    A batch writes its own rows, folded, as a part; every `every`-th batch writes the whole table, merged with the parts since the last whole one. So a batch costs its own rows, and the
    table is written anew for one batch in `every`. Nothing is kept on the driver: what lies before a batch is the last complete whole table of a lower number and the parts after it, so a batch that
    runs again after a failure writes the same rows over what it left; the current table reaches to the last batch that the stream's checkpoint has committed.

    make(rows): arrived rows as rows of the table; merge(known, more): the table (None before the first) with more rows of its kind."""

    def __init__(self, spark: SparkSession, path: str, checkpoint: str, make: Callable[[DataFrame], DataFrame], merge: Callable[[DataFrame | None, DataFrame], DataFrame], every: int = 10):
        self.spark, self.path, self.checkpoint = spark, path.rstrip("/"), checkpoint.rstrip("/")
        self.make, self.merge, self.every = make, merge, every

    def _at(self, kind: str, n: int) -> str:
        return f"{self.path}/{kind}-{n}"

    def complete(self, kind: str) -> list[int]:
        """Numbers of the folders of a kind ('whole' or 'part') that were written to the end."""
        of = self.spark._jvm.org.apache.hadoop.fs.Path
        files = of(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration())
        return [n for n in _numbers(self.spark, self.path, rf"{kind}-(\d+)") if files.exists(of(f"{self._at(kind, n)}/_SUCCESS"))]

    def before(self, batch: int) -> DataFrame | None:
        """The table of all batches of lower numbers."""
        whole = [n for n in self.complete("whole") if n < batch]
        parts = [n for n in self.complete("part") if (whole[-1] if whole else -1) < n < batch]
        known = self.spark.read.parquet(self._at("whole", whole[-1])) if whole else None
        return self.merge(known, self.spark.read.parquet(*[self._at("part", n) for n in parts])) if parts else known

    def write(self, rows: DataFrame, batch: int) -> None:
        if (batch + 1) % self.every:
            self.make(rows).write.mode("overwrite").parquet(self._at("part", batch))
            return
        self.merge(self.before(batch), self.make(rows)).write.mode("overwrite").parquet(self._at("whole", batch))
        # the last whole table before this one stays for a batch that runs again; what it holds may go
        older = [n for n in self.complete("whole") if n < batch]
        for kind in ("whole", "part"):
            for n in [n for n in self.complete(kind) if older and (n < older[-1] or n == older[-1] and kind == "part")]:
                at = self.spark._jvm.org.apache.hadoop.fs.Path(self._at(kind, n))
                at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)

    def current(self) -> DataFrame | None:
        """The table after the last committed batch; None before the first."""
        committed = _numbers(self.spark, f"{self.checkpoint}/commits", r"(\d+)")
        return self.before(committed[-1] + 1) if committed else None

    def run(self, stream: DataFrame, mode: str = "append") -> DataFrame | None:
        """Fold all that is there now; the current table. Started again, it goes on where it stopped."""
        stream.writeStream.foreachBatch(self.write).outputMode(mode).option("checkpointLocation", self.checkpoint).trigger(availableNow=True).start().awaitTermination()
        return self.current()


def all_now(spark: SparkSession, stream: DataFrame, mode: str) -> DataFrame:
    """What a stream gives for all that is there now, through tables in the shared folder: in append mode all rows, in complete mode the last batch's."""
    at = folder(spark)
    if mode == "append":
        run_available(stream, f"{at}/rows", f"{at}/state")
        return spark.read.schema(stream.schema).parquet(f"{at}/rows")
    rows = Kept(spark, f"{at}/rows", f"{at}/state", _same, lambda _, arrived: arrived, every=1).run(stream, mode)
    return spark.createDataFrame([], stream.schema) if rows is None else rows


HOUR = 3_600_000_000
#: The repository of a closing request, which is none.
CLOSING = -(2**63)


class RateLimit(StatefulProcessor):
    """One repository's requests: those that wait for the watermark, and the times of those accepted in the window.

    Requests are decided in order of time once the watermark has passed them, whatever the order in which they arrived; a timer calls for that. Another one
    ends the state when all accepted times are out of the window."""

    def __init__(self, limit: int, hours: int):
        self.limit, self.span = limit, hours * HOUR

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at bigint, id bigint")
        self.kept = handle.getValueState("kept", "times array<bigint>")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for part in rows:
            self.waiting.appendList(list(zip(part["at"].astype(int).tolist(), part["id"].astype(int).tolist(), strict=True)))
            first = min(x for x in (first, int(part["at"].min())) if x is not None)
        if first is not None:
            self._call(first)
        return iter(())

    def _call(self, at: int) -> None:
        """A timer for when the watermark, in milliseconds, is past a time in microseconds."""
        self.handle.registerTimer(at // 1000 + 1)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        rows = sorted((int(at), int(i)) for at, i in self.waiting.get()) if self.waiting.exists() else []
        due, later = [r for r in rows if r[0] < mark], [r for r in rows if r[0] >= mark]
        kept = [int(x) for x in self.kept.get()[0]] if self.kept.exists() else []
        flags = []
        for at, _ in due:
            kept = [x for x in kept if x > at - self.span]
            flags.append(len(kept) < self.limit)
            if flags[-1]:
                kept.append(at)
        kept = [x for x in kept if later or x > mark - self.span]
        if later:
            self.waiting.put(later)
            self._call(later[0][0])
        else:
            self.waiting.clear()
        if kept:
            self.kept.update((kept,))
            self._call(kept[-1] + self.span)
        else:
            self.kept.clear()
        if due:
            yield pd.DataFrame({"repo_id": [key[0]] * len(due), "id": [i for _, i in due], "accepted": flags})

    def close(self) -> None:
        pass


def accepted(requests: DataFrame, limit: int, hours: int = 24, late: str = "1 day") -> DataFrame:
    """The rate limit as a stateful stream: repo_id, id, accepted. requests: repo_id, id, ts, in any order of arrival.

    A request is decided when the watermark, `late` behind the newest one, has passed it; a request that arrives later than that is not decided. A repository's
    state is its requests of that time and `limit` accepted times. Needs the RocksDB state store."""
    rows = requests.select("repo_id", "id", "ts", F.unix_micros("ts").alias("at")).withWatermark("ts", late)
    return rows.groupBy("repo_id").transformWithStateInPandas(RateLimit(limit, hours), "repo_id bigint, id bigint, accepted boolean", "append", "EventTime")


def accepted_now(spark: SparkSession, sf_dir: str, limit: int) -> DataFrame:
    """The flags of all requests that are there now. A closing request far ahead, in a file of its own that comes last, lets the watermark pass all others; it is left out."""
    at = folder(spark)
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").alias("repo_id"), F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("ts"))
    rows.write.parquet(f"{at}/in/1")
    rows.agg(F.max("ts").alias("ts")).filter("ts IS NOT NULL").select(F.lit(CLOSING).alias("repo_id"), F.lit(CLOSING).alias("id"), (F.col("ts") + F.expr("INTERVAL 400 DAYS")).alias("ts")).coalesce(1).write.parquet(f"{at}/in/2")
    stream = spark.readStream.schema(rows.schema).parquet(f"{at}/in/*")
    with rocks(spark):
        return all_now(spark, accepted(stream, limit), "append").filter(F.col("repo_id") != CLOSING)


def last_words(rows: DataFrame) -> DataFrame:
    """Feedback by scan and user, the last word of each. Rows: scan_id, user_id, verdict, ts, event_id."""
    return rows.groupBy("scan_id", "user_id").agg(F.max_by(F.struct("verdict", "ts", "event_id"), F.struct("ts", "event_id")).alias("last")).select("scan_id", "user_id", "last.*")


def fold_feedback(known: DataFrame | None, arrived: DataFrame) -> DataFrame:
    """What is known with what arrived."""
    return last_words(arrived if known is None else known.unionByName(arrived))


def feedback(arriving_rows: DataFrame) -> DataFrame:
    """Events as feedback: scan_id, user_id, verdict, ts, event_id."""
    return arriving_rows.select((F.col("event_id") % 50).alias("scan_id"), "user_id", F.col("event_type").alias("verdict"), F.col("ts").cast("timestamp").alias("ts"), "event_id")


def folded_now(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feedback table after a stream of feedback."""
    at = folder(spark)
    rows = Kept(spark, f"{at}/table", f"{at}/state", last_words, fold_feedback).run(feedback(arriving(spark, sf_dir)))
    return rows.select("scan_id", "user_id", "verdict")
