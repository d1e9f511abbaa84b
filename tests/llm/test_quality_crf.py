import itertools
import zlib

import numpy as np

from siftlake.llm import quality_crf as Q


def test_marginals_match_all_labellings():
    pick = np.random.default_rng(1)
    lines = np.array([3, 0, 1, 5])
    unary, transition = pick.normal(size=(9, 2)), pick.normal(size=(2, 2))
    got, pairs = Q.marginals(unary, transition, lines)
    at, want, want_pairs = 0, [], np.zeros((2, 2))
    for n in lines:
        u = unary[at : at + n]
        at += n
        total, good, moves = 0.0, np.zeros((n, 2)), np.zeros((2, 2))
        for ys in itertools.product((0, 1), repeat=int(n)):
            w = np.exp(sum(u[i, y] for i, y in enumerate(ys)) + sum(transition[a, b] for a, b in itertools.pairwise(ys)))
            total += w
            for i, y in enumerate(ys):
                good[i, y] += w
            for a, b in itertools.pairwise(ys):
                moves[a, b] += w
        want.append(good / total)
        want_pairs += moves / total
    assert np.allclose(got, np.concatenate(want)) and np.allclose(pairs, want_pairs)


def test_features_of_a_text_do_not_depend_on_its_neighbours():
    texts = [b"One line.\nTwo | lines", b"", b"\n\n  \n", b"A\nA\nA", "é日\n".encode()]
    together, _, lines = Q.line_features(texts)
    assert lines.tolist() == [2, 0, 0, 3, 1]
    assert np.array_equal(together, np.concatenate([Q.line_features([t])[0] for t in texts]))


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = Q.fit(docs, labels)
    truth = {r.doc_id: r.quality for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0}
    got = {r.doc_id: r.score for r in Q.score(docs, model).collect() if r.doc_id in truth}
    right = [(got[i] >= 0.3) == bool(y) for i, y in truth.items()]
    kept = [got[i] >= 0.3 for i, y in truth.items() if y]
    assert len(right) > 50 and np.mean(right) > 0.95 and np.mean(kept) > 0.98


def test_labels_of_the_held_out_fold_do_not_matter(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    a = Q.fit(docs, labels)
    b = Q.fit(docs, labels.selectExpr("doc_id", "CASE WHEN crc32(CAST(doc_id AS STRING)) % 5 = 0 THEN 1 - quality ELSE quality END AS quality"))
    assert np.array_equal(a.weights, b.weights)


def test_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1), (9, 0), (9, 1), (99, 1), (None, 1), (5, None), (6, 7)], "doc_id bigint, quality int")
    model = Q.fit(odd, labels)
    got = Q.score(odd, model).collect()
    assert len(got) == odd.count() and set(got[0].asDict()) == set(odd.columns)
    assert all(0 <= r.score <= 1 for r in got) and all(r.score == 0 for r in got if r.doc_id in (2, 3, 4))
    assert Q.score(none, model).count() == 0
    for value in (0, 1):
        only = Q.fit(odd, spark.createDataFrame([(1, value), (9, value)], "doc_id bigint, quality int"))
        assert {r.score for r in Q.score(odd, only).collect() if r.doc_id not in (2, 3, 4)} == {float(value)}
    assert {r.score for r in Q.score(odd, Q.fit(none, labels)).collect()} == {0.0, 0.5}


def test_the_fit_is_bounded_in_lines_and_rows(spark):
    """One row for each id, and documents that still fit `max_lines`."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels"))
    whole = Q.fit(docs, labels)
    assert np.array_equal(whole.weights, Q.fit(docs.union(docs), labels).weights)
    few = Q.fit(docs, labels, max_lines=60)
    assert not np.array_equal(whole.weights, few.weights) and Q.score(docs, few).count() == docs.count()


def test_wrapper_columns_and_the_aggregate(spark):
    """A document's score is the length-weighted mean of its lines' marginals, and the query adds fold and decision."""
    from siftlake.llm import queries

    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    model = Q.fit(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
    for r in queries.op4_quality_crf(spark, sf).collect():
        features, length, lines = Q.line_features([docs[r.doc_id].encode()])
        want = 0.0
        if len(features):
            unary = np.zeros((len(features), 2))
            unary[:, Q.GOOD] = ((features - model.mean) / model.scale) @ model.weights
            good = Q.marginals(unary, model.transition, lines)[0][:, Q.GOOD]
            want = (good * length).sum() / length.sum()
        assert abs(r.score - want) < 1e-6 and r.predicted == (r.score >= 0.3) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
