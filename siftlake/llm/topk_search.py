"""Exact top-k search by inner product over integer vectors.

Every dimension is a term with a posting list of (candidate, weight). Query rows are sparse: for each of
their non-zero terms the weighted postings are scattered into a dense array of scores, one slot for each
candidate of the block; the best k of each block are cut out by partition selection, and the blocks' lists
are merged by rank.

Both sides are cut into blocks of bounded size by a hash of id, vector and place, so that repeated rows spread, and every query block meets every
candidate block in an equi-join on (query block, slot); slots spread the pairs over tasks, so no task or driver ever holds a whole side.
Query blocks are large and are worked through in parts, so a candidate block is shipped once for each `query_block` queries.

Vectors that are null or hold null or non-finite components take no part. Ties go to the smaller id, null ids last.
Rows of one id are rows of their own, as queries and as candidates: each has its place among them (query_row, from 1, by vector), and
a query row leaves out only itself. A query must be a row of the candidates with the same id and vector to leave itself out. Rows with a null id are
candidates; a query with a null id gives a null query_id. Vectors may differ in length: missing terms weigh nothing. Empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def integer_vector(vector: Column, scale: int = 1024) -> Column:
    """floor(scale * x) of each component x as double."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(scale)))


def usable(vector: Column) -> Column:
    return vector.isNotNull() & F.forall(vector, lambda x: F.coalesce(~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))), F.lit(False)))


def block_scores(queries: list[np.ndarray], rows: list[np.ndarray]) -> np.ndarray:
    """Term-at-a-time accumulation: scores[q, c] of all queries against one block of candidates."""
    lengths = np.array([len(x) for x in rows], dtype=np.int64)
    terms = np.concatenate([np.arange(n) for n in lengths]) if len(rows) else np.empty(0, np.int64)
    owner = np.repeat(np.arange(len(rows)), lengths)
    weights = np.concatenate(rows) if len(rows) else np.empty(0, np.int64)
    order = np.argsort(terms, kind="stable")
    order = order[weights[order] != 0]
    terms, owner, weights = terms[order], owner[order], weights[order]
    width = int(lengths.max(initial=0))
    starts = np.searchsorted(terms, np.arange(width + 1))
    scores = np.zeros((len(queries), len(rows)), dtype=np.int64)
    for q, query in enumerate(queries):
        row = scores[q]
        for t in np.flatnonzero(query[:width]):
            a, b = starts[t], starts[t + 1]
            row[owner[a:b]] += query[t] * weights[a:b]
    return scores


def select_top(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best by (score descending, id ascending), by partition selection."""
    if len(scores) > k:
        cut = np.partition(scores, len(scores) - k)[len(scores) - k]
        keep = np.flatnonzero(scores >= cut)
    else:
        keep = np.arange(len(scores))
    return keep[np.lexsort((ids[keep], -scores[keep]))][:k]


#: Stands for a null id inside blocks; no null id is smaller than another one.
NO_ID = np.iinfo(np.int64).max
#: Queries scored at a time against one block of candidates.
PART = 256


def numbered(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """Rows with their place among the rows of their id. Rows of one id and vector are alike, so their order does not matter."""
    return df.select(id_col, vector_col, F.row_number().over(W.partitionBy(id_col).orderBy(vector_col)).alias("row"))


def top_k(queries: DataFrame, candidates: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "vector", query_block: int = 16_384, candidate_block: int = 4096, slots: int = 64) -> DataFrame:
    """The k best candidates of each query: query_id, rank (from 1), the candidate's id, score, query_row.

    vector_col holds arrays of long (see integer_vector and usable). `queries` holds all rows of the ids that it names.
    """

    def pack(df: DataFrame, block: int) -> tuple[DataFrame, int]:
        """Rows packed into blocks of about `block` rows."""
        rows = numbered(df, id_col, vector_col)
        parts = max(1, -(-df.count() // block))
        key = F.pmod(F.xxhash64(id_col, vector_col, "row"), F.lit(parts)).cast("int").alias("block")
        one = F.struct(F.coalesce(F.col(id_col).cast("long"), F.lit(int(NO_ID))).alias("id"), "row", F.col(vector_col).alias("v"))
        return rows.select(key, one.alias("one")).groupBy("block").agg(F.collect_list("one").alias("rows")), parts

    q, n_q = pack(queries, query_block)
    c, n_c = pack(candidates, candidate_block)
    slots = max(1, min(slots, n_c))
    left = c.select("block", "rows", F.pmod("block", F.lit(slots)).alias("slot"), F.explode(F.sequence(F.lit(0), F.lit(n_q - 1))).alias("q_block"))
    right = q.select(F.col("block").alias("q_block"), F.col("rows").alias("q_rows"), F.explode(F.sequence(F.lit(0), F.lit(slots - 1))).alias("slot"))
    # not broadcast: blocks are repeated behind the shuffle that Spark takes their size from
    pairs = left.join(right.hint("merge"), ["q_block", "slot"]).select("q_rows", "rows")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def unpack(value) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
            rows = value.values
            v, ids, place = rows.field("v"), rows.field("id").to_numpy(), rows.field("row").to_numpy()
            offsets, flat = v.offsets.to_numpy(), v.values.to_numpy(zero_copy_only=False)
            return ids, place, [flat[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]

        for batch in batches:
            for i in range(batch.num_rows):
                (q_ids, q_place, qs), (ids, place, rows) = unpack(batch.column(0)[i]), unpack(batch.column(1)[i])
                for a in range(0, len(qs), PART):
                    scores, out = block_scores(qs[a : a + PART], rows), []
                    for own, own_place, row in zip(q_ids[a : a + PART], q_place[a : a + PART], scores, strict=True):
                        others = np.flatnonzero((ids != own) | (place != own_place))
                        best = others[select_top(row[others], ids[others], k)]
                        out.append((np.full(len(best), own), np.full(len(best), own_place), ids[best], row[best]))
                    query, query_row, found, score = (np.concatenate(x) for x in zip(*out, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(query, mask=query == NO_ID), pa.array(query_row, pa.int32()), pa.array(found, mask=found == NO_ID), pa.array(score)], ["query_id", "query_row", id_col, "score"])

    found = pairs.mapInArrow(run, f"query_id bigint, query_row int, {id_col} bigint, score bigint")
    order = W.partitionBy("query_id", "query_row").orderBy(F.desc("score"), F.asc_nulls_last(id_col))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", id_col, "score", "query_row")
