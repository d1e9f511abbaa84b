import random
import re

import numpy as np
import pytest

from siftlake.llm import ngram_join as J


def shingles(text, width=5):
    ws = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not ws:
        return frozenset()
    return frozenset([tuple(ws)] if len(ws) < width else [tuple(ws[i : i + width]) for i in range(len(ws) - width + 1)])


def brute(rows, width=5, percent=80):
    """Components by comparing all pairs: {row: (n_shingles, component_id)}."""
    sets = [shingles(t, width) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                parent[find(i)] = find(j)
    out = []
    for i, (own, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None] if sets[i] else [own]
        out.append((own, len(sets[i]), min(ids, default=None)))
    return sorted(out, key=str)


def result(df, **how):
    return sorted(((r[0], r[1], r[2]) for r in J.join(df, **how).select("doc_id", "n_shingles", "component_id").collect()), key=str)


def near_copies(seed, n_groups=12):
    pick, rows = random.Random(seed), []
    for _ in range(n_groups):
        text = [f"w{pick.randint(0, 60)}" for _ in range(pick.choice([1, 3, 5, 9, 40, 120]))]
        for _ in range(pick.randint(1, 9)):
            copy = list(text)
            for _ in range(pick.randint(0, 1 + len(text) // 25)):
                copy[pick.randrange(len(copy))] = f"x{pick.randint(0, 9)}"
            rows.append((len(rows), " ".join(copy).title() if pick.random() < 0.3 else "\t".join(copy)))
    return rows


@pytest.mark.parametrize("seed, percent", [(1, 80), (2, 80), (3, 50)])
def test_same_components_as_all_pairs(spark, seed, percent):
    rows = near_copies(seed)
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    assert result(df, percent=percent) == brute(rows, percent=percent)
    assert result(df, percent=percent, tile=2) == brute(rows, percent=percent)


def test_many_near_copies_and_a_passage_that_all_share(spark, monkeypatch):
    monkeypatch.setattr(J, "HEAVY_FROM", 2)
    passage = " ".join(f"p{i}" for i in range(30))
    base = [f"b{i}" for i in range(60)]
    rows = [(i, " ".join([*base[:i], f"e{i}", *base[i + 1 :]]) if i < 60 else f"{passage} " + " ".join(f"u{i}x{k}" for k in range(5 + i % 20))) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert result(df) == brute(rows)
    assert result(df, broadcast_nodes=0) == brute(rows)
    assert result(df, tile=4) == brute(rows)


def test_odd_rows(odd, none):
    assert result(odd) == brute([(r.doc_id, r.text) for r in odd.collect()])
    assert J.join(none).count() == 0


def test_word_hashes_tell_words_apart(monkeypatch):
    """Equal words have equal hashes wherever they stand and however the bytes are cut; different words have different ones."""
    pick = random.Random(4)
    ws = ["".join(pick.choice("ab\u00e9Z-") for _ in range(pick.randint(1, 12))) for _ in range(4000)] + ["a" * 3000, "a" * 3001, "\x00", "\x00\x00", "ab", "ba", "aab", "aba", "baa"]
    pick.shuffle(ws)
    seen = {}
    for piece in (1 << 20, 64):
        monkeypatch.setattr(J, "PIECE", piece)
        text = "".join(w + pick.choice([" ", "\t", "\n\n", " \x0b\x0c\r"]) for w in ws)
        data = text.encode().translate(J.LOWER_BYTES)
        starts, hashes = J.Shingler().word_hashes(data)
        assert [data[a:].split(None, 1)[0] for a in starts.tolist()] == data.split() and len(data.split()) == len(hashes)
        for w, h in zip(data.split(), hashes.tolist(), strict=True):
            assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)
    assert all(len(x) == 0 for x in J.Shingler().word_hashes(b" \n"))


def test_sets_do_not_depend_on_their_batch():
    texts = ["a b c d e f", None, "", "a b", " ", "x " * 50, "\u00c9t\u00e9 a b c d e f g", "a b c d e f"]
    make = J.Shingler()
    together = make(texts)
    assert all((a == b).all() and len(a) == len(b) for a, [b] in zip(together, ([*make([t])] for t in texts), strict=True))
    assert [len(x) for x in together] == [2, 0, 0, 1, 0, 1, 4, 2] and make([]) == []


def test_bound_is_never_below_the_overlap():
    pick = np.random.default_rng(2)
    for _ in range(300):
        pool = pick.integers(0, 2**63, 400, dtype=np.uint64)
        a, b = (np.unique(pick.choice(pool, pick.integers(1, 300))) for _ in range(2))
        shared = len(np.intersect1d(a, b))
        assert J.overlap_bound(J.signature(a), len(a), J.signature(b), len(b)) >= shared
        assert J.overlap_bound(J.signature(a), len(a), J.signature(a), len(a)) == len(a)


def test_components_of_long_chains(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(i + 1, i) for i in range(100, 130)]
    got = {(r.node, r.part) for r in J.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {(i, 0) for i in range(1, 41)} | {(i, 100) for i in range(101, 131)}
