from math import comb

import numpy as np
import pytest

from siftlake.llm import minhash_dedup as M
from tests.llm.test_ngram_join import brute, near_copies


def result(df, **how):
    rows = M.dedup(df, **how).collect()
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in rows), key=str)


@pytest.mark.parametrize("seed, tile", [(1, M.TILE), (2, 2), (3, 3)])
def test_same_components_as_all_pairs(spark, seed, tile):
    rows = near_copies(seed)
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    assert result(df, tile=tile) == brute(rows, 3, 85)


def test_near_copies_around_one_text_and_strays(spark, monkeypatch):
    monkeypatch.setattr(M, "SPREAD", 10)
    base = [f"b{i}" for i in range(200)]
    rows = []
    for i in range(120):
        text = list(base)
        for k in range(i % 12):
            text[(37 * i + 17 * k) % 200] = f"e{i}x{k}"
        rows.append((i, " ".join(text)))
    rows += [(200 + i, " ".join(f"u{i}x{k}" for k in range(50))) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = brute(rows, 3, 85)
    assert result(df) == want
    assert result(df, tile=8, broadcast_nodes=0) == want


def test_odd_rows(odd, none):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert result(odd) == brute(rows, 3, 85)
    assert M.dedup(none).count() == 0
    kept = {r.doc_id: r.kept for r in M.dedup(odd).collect()}
    assert kept[2] and kept[3] and kept[4] and kept[6] is False


def test_overlaps_of_sets_in_blocks():
    pick = np.random.default_rng(3)
    sets = [np.unique(pick.integers(0, 300, pick.integers(1, 200), dtype=np.uint64)) for _ in range(40)]
    want = [[len(np.intersect1d(a, b)) for b in sets] for a in sets]
    for room in (10**6, 500, 1):
        assert M._overlaps(sets, room).tolist() == want


def test_posterior_bounds():
    """The bound is the least count whose posterior chance, by numeric integration of the Beta density, reaches the chance asked for."""
    least, grid = M.least_equal(85, 1e-6, 64), np.linspace(0, 1, 200_001)
    for n in (8, 16, 33, 64):
        for m, reaches in ((least[n], True), (least[n] - 1, False)):
            if m >= 0:
                density = comb(n, int(m)) * (n + 1) * grid**m * (1 - grid) ** (n - m)
                assert (np.trapezoid(density[grid >= 0.85], grid[grid >= 0.85]) >= 1e-6 * 0.999) == reaches


def test_equal_bytes_follow_the_similarity():
    pick = np.random.default_rng(1)
    for shared in (0, 300, 850, 950):
        got = []
        for _ in range(20):
            both = pick.integers(0, 2**63, 2000 - shared, dtype=np.uint64)
            a, b = (np.frombuffer(M.signature(np.unique(x)), np.uint8) for x in (both[:1000], both[1000 - shared :]))
            got.append((a == b).mean())
        want = shared / (2000 - shared)
        assert abs(np.mean(got) - (want + (1 - want) / 256)) < 0.02
