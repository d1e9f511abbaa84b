import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftlake.llm import hard_negatives as H

SCHEMA = "vec_id bigint, label int, embedding array<float>, row string, id string, score int"


def brute(rows, anchors, positives=5, negatives=3):
    kept = [(i, label, [math.floor(256 * x) for x in v]) for i, label, v in rows if label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    product = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    order = lambda s: (-s[0], s[1] is None, s[1] or 0)
    out = []
    for n, (anchor, label, v) in enumerate(kept):
        if anchor is None or anchor % anchors:
            continue
        scored = [(product(v, w), i, other) for m, (i, other, w) in enumerate(kept) if m != n]
        for best, positive, _ in sorted((s for s in scored if s[2] == label), key=order)[:positives]:
            fits = sorted((s for s in scored if s[2] != label and 50 * best <= 100 * s[0] <= 95 * best), key=order)
            out += [(anchor, positive, rank, i, best, score) for rank, (score, i, _) in enumerate(fits[:negatives], 1)]
    return sorted(out, key=str)


def mined(spark, rows, anchors, **how):
    df = spark.createDataFrame([(*r, "r", "i", 1) for r in rows], SCHEMA)
    got = H.mine(df, F.col("vec_id") % anchors == 0, **how)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted((tuple(r) for r in got.collect()), key=str)


@pytest.mark.parametrize("seed, width, blocks", [(1, 3, (2, 3)), (2, 64, (100, 7)), (3, 130, (5, 1000))])
def test_same_rows_as_all_products(spark, seed, width, blocks):
    pick = random.Random(seed)
    rows = [(i, pick.choice([0, 1, 1, 1, 2]), [np.float32(pick.gauss(0, 1) + 0.7).item() for _ in range(width)]) for i in range(90)]
    assert mined(spark, rows, 4, anchor_block=blocks[0], row_block=blocks[1], slots=3) == brute(rows, 4)


def test_odd_rows(spark):
    ones = [1.0, 1.0]
    rows = [(10, 1, ones), (10, 1, ones), (20, 1, ones), (1, 1, ones), (2, 2, [0.75, 0.75]), (3, 2, [0.75, 0.75]), (None, 2, [0.75, 0.75]), (None, 1, ones), (4, 3, [0.5]), (5, 3, [1.5, 0.1, 9.0])]
    rows += [(30, None, ones), (40, 1, None), (50, 1, [None, 1.0]), (60, 1, [float("nan"), 1.0]), (70, 1, [float("inf"), 1.0]), (80, 4, []), (90, 5, ones), (6, 6, [-1.0, -1.0]), (100, 6, [-0.5, -0.5]), (7, 6, [1.0, 1.0]), (110, 7, [0.0, 0.0]), (8, 7, ones)]
    for blocks in ((1, 1), (3, 4), (100, 100)):
        assert mined(spark, rows, 10, anchor_block=blocks[0], row_block=blocks[1]) == brute(rows, 10)
    assert mined(spark, [], 10) == [] and mined(spark, rows[:1], 10) == []


def test_planes_give_back_the_numbers():
    pick = np.random.default_rng(4)
    for low, high in ((-1, 1), (0, 1), (-9, 3), (-2**31, 2**31), (-5, -4)):
        rows = pick.integers(low, high, (7, 70))
        cut = H.sliced(rows)
        bits = np.unpackbits(cut.bits.view(np.uint8), axis=2)[:, :, :70]
        assert (np.tensordot(cut.weights, bits.astype(np.int64), 1) == rows).all()


def test_most_rows_go_before_the_last_plane(monkeypatch):
    pick = np.random.default_rng(5)
    rows, anchor = pick.integers(-128, 128, (5000, 64)), pick.integers(-128, 128, 64)
    seen, products = [], H.plane_products
    monkeypatch.setattr(H, "plane_products", lambda a, plane: seen.append(len(plane)) or products(a, plane))
    [(best, score)] = H.best_in_windows(anchor, H.sliced(rows), np.arange(5000), np.arange(5000), [(-H.FAR, H.FAR)], 5)
    want = rows @ anchor
    assert best.tolist() == np.lexsort((np.arange(5000), -want))[:5].tolist() and score.tolist() == want[best].tolist()
    assert seen[0] == 5000 and seen[-1] < 500


def test_blocks_are_never_broadcast(spark):
    """Spark would see a few rows of anchors and send them to the driver once for each slot."""
    from siftlake.llm import topk_search

    rows = [(i, i % 3, [float(i % 7), 1.0]) for i in range(60)]
    df = spark.createDataFrame([(i, label, [int(x) for x in v], i) for i, label, v in rows], "id long, label long, vector array<long>, row long")
    met = H._meet(df.filter("id % 5 = 0"), df, 4, 8, 64, lambda a, r: H._positives(a, r, 2), "row bigint, positive_id bigint, positive_score bigint")
    best = topk_search.top_k(df.filter("id % 5 = 0"), df, 2, "id", query_block=4, candidate_block=8)
    for found, n in ((met, 12 * 8 * 2), (best, 24)):
        assert 24 <= found.count() <= n
        kept = found.cache()
        kept.count()
        plan = kept._jdf.queryExecution().executedPlan().toString()
        kept.unpersist()
        assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
