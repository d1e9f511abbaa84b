"""Hard-negative mining with bit-sliced integer products.

The components of all vectors are integers, cut into bit-planes: plane j of a vector is a bitmap of its dimensions, 64 to a word. The product
of an anchor with one plane of a candidate is a weighted sum of bit counts of their planes' intersections. Planes are worked through from the
most significant one; what the planes below can still add lies between the sums of the anchor's negative and positive components times 2^left - 1,
so each candidate has an interval of scores that halves with each plane. A candidate goes as soon as its interval misses every
window that is asked for, or lies below k candidates that are surely inside. What is left at the last plane has exact scores.

Two passes over the same blocks: the best rows of an anchor's own label (one window without limits), then for each of these positives the best
rows of other labels inside the window that its score sets. Rows are dealt into blocks by a hash, whatever their labels, so a frequent label is
spread like all others; a block of anchors meets each block of rows in an equi-join on (group of anchor blocks, slot), and blocks give
at most k rows for each anchor and window.

Rows with a null label, a null vector, or a null or non-finite component take no part. Rows of one id are rows of their own; an anchor leaves out only its own
row. Null ids are never anchors and come last among ties. Vectors may differ in length: missing components weigh nothing. Products are exact up to 64 bits; beyond that
they wrap. Empty tables give an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import stash
from .topk_search import integer_vector, usable

#: Stands for a null id inside blocks; no null id is smaller than another one.
NO_ID = np.iinfo(np.int64).max
FAR = 1 << 62
#: Blocks of anchors that meet one copy of a block of rows.
TOGETHER = 16


@dataclass
class Sliced:
    """Bit-planes of vectors, most significant first: bits[plane, vector, word] and the weight of each plane."""

    bits: np.ndarray
    weights: np.ndarray


def sliced(rows: np.ndarray) -> Sliced:
    """Two's complement planes of integer rows; the first plane, of the signs, weighs less than nothing."""
    n, width = rows.shape
    most, least = int(rows.max(initial=0)), int(rows.min(initial=0))
    planes = max(most.bit_length(), (-1 - least).bit_length() if least < 0 else 0) + 1
    words = max(1, -(-width // 64))
    bits = np.zeros((planes, n, words * 8), dtype=np.uint8)
    for place, j in enumerate(range(planes - 1, -1, -1)):
        packed = np.packbits(((rows >> j) & 1).astype(np.uint8), axis=1)
        bits[place, :, : packed.shape[1]] = packed
    weights = np.array([-(1 << planes - 1), *(1 << j for j in range(planes - 2, -1, -1))], dtype=np.int64)
    return Sliced(bits.view(np.uint64), weights)


def plane_products(anchor: Sliced, plane: np.ndarray) -> np.ndarray:
    """Products of one anchor with the 0/1 vectors of a plane [vector, word]."""
    counts = np.bitwise_count(anchor.bits[:, 0, None, :] & plane[None])
    return anchor.weights @ counts.sum(axis=2, dtype=np.int64)


def best_in_windows(anchor: np.ndarray, rows: Sliced, at: np.ndarray, ids: np.ndarray, windows: list[tuple[int, int]], k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each window (low, high) the positions and scores of the k best rows of `at` inside it, ties to the smaller id."""
    own = sliced(anchor[None])
    up, down = int(anchor[anchor > 0].sum()), int(anchor[anchor < 0].sum())
    score = np.zeros(len(at), dtype=np.int64)
    for place, weight in enumerate(rows.weights):
        if not len(at):
            break
        score += weight * plane_products(own, rows.bits[place, at])
        rest = (1 << len(rows.weights) - 1 - place) - 1
        if rest * (up - down) > int(score.max()) - int(score.min()):
            continue  # all intervals overlap, so none can go yet
        low, high = score + rest * down, score + rest * up
        keep = np.zeros(len(at), dtype=bool)
        for a, b in set(windows):
            fits = (high >= a) & (low <= b)
            sure = low[(low >= a) & (high <= b)]
            if len(sure) > k:
                fits &= high >= np.partition(sure, len(sure) - k)[len(sure) - k]
            keep |= fits
        at, score = at[keep], score[keep]
    out = []
    for a, b in windows:
        inside = np.flatnonzero((score >= a) & (score <= b))
        first = inside[np.lexsort((ids[at[inside]], -score[inside]))][:k]
        out.append((at[first], score[first]))
    return out


def _matrix(column: pa.ListArray, width: int) -> np.ndarray:
    offsets, flat = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    out = np.zeros((len(column), width), dtype=np.int64)
    for i, (a, b) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)):
        out[i, : min(width, b - a)] = flat[a : min(b, a + width)]
    return out


def _blocks(rows: DataFrame, size: int) -> tuple[DataFrame, int]:
    """block, rows: rows packed into blocks of about `size`, whatever their ids and labels."""
    parts = max(1, -(-rows.count() // size))
    return rows.select(F.pmod(F.xxhash64("row"), F.lit(parts)).cast("int").alias("block"), F.struct(*rows.columns).alias("one")).groupBy("block").agg(F.collect_list("one").alias("rows")), parts


def _meet(anchors: DataFrame, rows: DataFrame, anchor_block: int, row_block: int, slots: int, work: Callable, schema: str) -> DataFrame:
    """work(anchors, rows) for each block of anchors with each block of rows, as struct arrays; it yields record batches of `schema`."""
    left, n_left = _blocks(anchors, anchor_block)
    right, n_right = _blocks(rows, row_block)
    tasks, slots = slots, max(1, min(slots, n_right))
    # each group of anchor blocks costs a copy of all rows
    groups = min(n_left, max(-(-n_left // TOGETHER), -(-tasks // slots)))
    left = left.select(F.pmod("block", F.lit(groups)).alias("with"), F.col("rows").alias("anchors"), F.explode(F.sequence(F.lit(0), F.lit(slots - 1))).alias("slot"))
    right = right.select("rows", F.pmod("block", F.lit(slots)).alias("slot"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("with"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield from work(batch.column(0)[i].values, batch.column(1)[i].values)

    # blocks are repeated behind the shuffle that Spark takes their size from, so it would broadcast up to `slots` times what it allows
    right, left = (x.repartition(3 * groups * slots, "with", "slot") for x in (right, left))
    return right.join(left.hint("merge"), ["with", "slot"]).select("anchors", "rows").mapInArrow(run, schema)


def _positives(anchors: pa.StructArray, rows: pa.StructArray, k: int) -> Iterator[pa.RecordBatch]:
    own, own_label, ids, labels, places = anchors.field("row").to_numpy(), anchors.field("label").to_numpy(), rows.field("id").to_numpy(), rows.field("label").to_numpy(), rows.field("row").to_numpy()
    width = max([0, *(len(x) for x in (anchors.field("vector"), rows.field("vector")) for x in x)])
    vectors, bits = _matrix(anchors.field("vector"), width), sliced(_matrix(rows.field("vector"), width))
    of_label = {x: np.flatnonzero(labels == x) for x in np.unique(labels)}
    found = []
    for i in range(len(own)):
        at = of_label.get(own_label[i], np.empty(0, np.int64))
        [(best, score)] = best_in_windows(vectors[i], bits, at[places[at] != own[i]], ids, [(-FAR, FAR)], k)
        found.append((np.full(len(best), own[i]), ids[best], score))
    if found:
        row, found_id, score = map(np.concatenate, zip(*found, strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(found_id, mask=found_id == NO_ID), pa.array(score)], ["row", "positive_id", "positive_score"])


def _negatives(anchors: pa.StructArray, rows: pa.StructArray, k: int, low: int, high: int) -> Iterator[pa.RecordBatch]:
    own, own_label, ids, labels = anchors.field("row").to_numpy(), anchors.field("label").to_numpy(), rows.field("id").to_numpy(), rows.field("label").to_numpy()
    width = max([0, *(len(x) for x in (anchors.field("vector"), rows.field("vector")) for x in x)])
    vectors, bits = _matrix(anchors.field("vector"), width), sliced(_matrix(rows.field("vector"), width))
    others = {x: np.flatnonzero(labels != x) for x in np.unique(own_label)}
    scores = anchors.field("scores").to_pylist()
    found = []
    for i in range(len(own)):
        windows = [(-(-low * s // 100), high * s // 100) for s in scores[i]]
        for nth, (best, score) in enumerate(best_in_windows(vectors[i], bits, others[own_label[i]], ids, windows, k), 1):
            found.append((np.full(len(best), own[i]), np.full(len(best), nth), ids[best], score))
    if found:
        row, nth, found_id, score = map(np.concatenate, zip(*found, strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(nth, pa.int32()), pa.array(found_id, mask=found_id == NO_ID), pa.array(score)], ["row", "nth", "negative_id", "negative_score"])


def mine(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: int = 256, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", anchor_block: int = 1024, row_block: int = 8192, slots: int = 64) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    For each row where is_anchor, its `positives` best rows of the same label; for each of these the `negatives` best rows of other labels with
    low * positive_score <= 100 * negative_score <= high * positive_score, ranked from 1. Components are floor(scale * x)."""
    rows = vectors.filter(usable(F.col(vector_col)) & F.col(label_col).isNotNull())
    # the number of a row is fixed by writing it
    rows = stash(rows.select(F.coalesce(F.col(id_col).cast("long"), F.lit(int(NO_ID))).alias("id"), F.col(label_col).cast("long").alias("label"), integer_vector(F.col(vector_col), scale).alias("vector"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"), F.monotonically_increasing_id().alias("row")))
    anchors, rows = rows.filter("anchor").drop("anchor"), rows.drop("anchor")
    found = _meet(anchors, rows, anchor_block, row_block, slots, lambda a, r: _positives(a, r, positives), "row bigint, positive_id bigint, positive_score bigint")
    order = W.partitionBy("row").orderBy(F.desc("positive_score"), F.asc_nulls_last("positive_id"))
    best = stash(found.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= positives))
    scores = best.groupBy("row").agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "positive_score"))), lambda x: x["positive_score"]).alias("scores"))
    with_scores = stash(anchors.join(scores, "row"))
    found = _meet(with_scores, rows, anchor_block, row_block, slots, lambda a, r: _negatives(a, r, negatives, low, high), "row bigint, nth int, negative_id bigint, negative_score bigint")
    order = W.partitionBy("row", "nth").orderBy(F.desc("negative_score"), F.asc_nulls_last("negative_id"))
    found = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= negatives)
    out = found.join(best, ["row", "nth"]).join(with_scores.select("row", F.col("id").alias("anchor_id")), "row")
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
