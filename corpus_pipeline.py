"""Documents to training tokens: quality, near-duplicates, secrets, mixing, byte-level BPE.

Every stage takes rows with the five columns of documents, ignores further ones, and returns these five (the last stage: tokens). Ids, languages and sources may be null
or repeat: a row is a document. Empty tables give empty tables. Null and empty texts: the quality stage drops them, as they have no line; the other stages keep them."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: Rows that go to a Python worker at a time. Documents are long, and a worker keeps the memory of its largest batch for all later stages.
BATCH_ROWS = 1000
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line classifier accepts (score of 0.3 or more); texts without a line score 0 and go. Repeated rows are judged alike."""
    from siftlake.llm import quality_crf
    from siftlake.llm.common import table

    docs = docs.select(*COLUMNS)
    model = quality_crf.fit(docs, table(spark, sf_dir, "labels"))
    return quality_crf.score(docs, model).filter(F.col("score") >= 0.3).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str, broadcast_ids: int = 2_000_000) -> DataFrame:
    """One document of each group of linked ones: the one with the smallest id. Documents without words all stay.

    Ids that go are broadcast up to `broadcast_ids` of them, so that texts are not shuffled; more are joined."""
    from siftlake.llm import ngram_join
    from siftlake.llm.common import stash

    docs = docs.select(*COLUMNS)
    groups = ngram_join.join(docs)
    ids = stash(groups.groupBy("doc_id").agg(F.max(F.col("doc_id").eqNullSafe(F.col("component_id"))).alias("stays"), F.count(F.lit(1)).alias("n")).filter("NOT stays OR n > 1"))

    def among(which: str, how: str, rows: DataFrame) -> DataFrame:
        some = ids.filter(which).select(F.col("doc_id").alias("_id"))
        some = F.broadcast(some) if some.count() <= broadcast_ids else some
        return rows.join(some, rows["doc_id"].eqNullSafe(some["_id"]), how)

    kept = among("NOT stays", "left_anti", docs)
    if ids.filter("stays").isEmpty():
        return kept
    # rows of one id and text are one document
    return among("stays", "left_anti", kept).union(among("stays", "left_semi", kept).dropDuplicates(["doc_id", "text"]))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mask every secret inside its text; all documents stay, null texts as null with a length of 0."""
    from siftlake.llm import secret_scan

    clean = secret_scan.redact(docs.select(*COLUMNS))
    return clean.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled so that source, language and topic have their target shares; nine tenths of all tokens stay, and documents that must rise are repeated. Rows of one id share their draw; documents without tokens weigh nothing and are drawn like the rest of their cell."""
    from siftlake.llm import raking

    sample = raking.mix(docs.select(*COLUMNS), keep=0.9).filter("_mix_kept")
    return sample.withColumn("_mix_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_mix_copies")))).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document that is left; none for null and empty texts."""
    import public_tokenizers

    from siftlake.llm import byte_bpe

    return byte_bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).select("doc_id", "n_tokens", "ids")


def _in_small_batches(stage: Stage) -> Stage:
    """The stage in a session that sends BATCH_ROWS rows at a time; it stays set, as the stage's rows are computed when they are written."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
        return stage(spark, docs, sf_dir)

    return run


STAGES: list[tuple[str, Stage]] = [(f.__name__, _in_small_batches(f)) for f in (quality, near_duplicates, secrets, mixture, tokens)]

#: Sequence models and byte-pair merges have no SQL; the tests compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each stage's rows written as Parquet and read again for the next."""
    from siftlake.llm.common import stash, table

    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stash(docs)
    return docs
