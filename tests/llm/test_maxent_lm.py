import math
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from siftlake.llm import maxent_lm as M


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + [" "]


def held_out(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1


def check_base(rows, got):
    count = Counter(t for i, text in rows if not held_out(i) for t in tokens(text))
    total, distinct = sum(count.values()), len(count)
    want = []
    for i, text in rows:
        ts = tokens(text)
        base = sum(math.log10((count[t] + 0.5) / (total + 0.5 * (distinct + 1))) for t in ts)
        want.append((str(i), held_out(i), len(ts), sum(t in count for t in ts), total, round(base, 6)))
    assert sorted(want) == sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got)


def test_base_score_and_both_ways_of_looking_up(odd, none):
    got = M.score(odd, partitions=2).collect()
    check_base([(r.doc_id, r.text) for r in odd.collect()], got)
    joined = M.score(odd, broadcast_vocab=0, partitions=2).collect()
    key = lambda r: (str(r.doc_id), r.n_tokens, r.base_score)
    assert np.allclose([r.score for r in sorted(got, key=key)], [r.score for r in sorted(joined, key=key)])
    assert all(r.score <= 0 for r in got)
    assert M.score(none, partitions=2).count() == 0


def test_without_training_texts(spark):
    only = [i for i in range(40) if held_out(i)]
    got = M.score(spark.createDataFrame([(i, "a b") for i in only], "doc_id bigint, text string"), partitions=2).collect()
    assert len(got) == len(only) and {(r.n_known, r.train_tokens) for r in got} == {(0, 0)}


def test_better_than_the_base_on_held_out_texts(docs):
    got = M.score(docs, partitions=2).collect()
    check_base([(r.doc_id, r.text) for r in docs.collect()], got)
    out = [r for r in got if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def test_probabilities_of_all_tokens_sum_to_one():
    """Over every known token and the unseen one, in some contexts, with random weights."""
    count = {b"a": 5, b"b": 3, b"cc": 2, b"dd": 2, b"e": 1, b"f": 1, b" ": 4}
    own = {b"a": 0, b" ": 1}
    groups = np.zeros(M.CLASSES)
    for t, c in count.items():
        if c > 1 and t not in own:
            groups[M.group_of(t)] += c
    v = M.Vocabulary(sum(count.values()), len(count), 2, 2, own, groups)
    known = list(count)
    keys = M.hashes_of(known, M.Shingler())
    order = np.argsort(keys)
    encoder = M.Encoder(v, keys[order], np.array(list(count.values()))[order], np.array([M.kind_of(t, c, v) for t, c in count.items()])[order])
    c, kind = encoder.look_up(M.hashes_of([*count, b"never"], M.Shingler()))
    share = 10 ** encoder.share(c, kind)
    by_class = np.bincount(kind, share, minlength=M.CLASSES)
    used = np.unique(kind)
    assert np.allclose(by_class[used], 1)
    weights = np.random.default_rng(0).normal(size=(M.BUCKETS, M.CLASSES))
    p = np.exp(M.class_log_probabilities(weights, np.array([0, 5, M.CONTEXTS - 1])))
    assert np.allclose(p.sum(axis=1), 1)


def test_gradient_is_that_of_the_likelihood():
    pick = np.random.default_rng(4)
    contexts, counts = pick.integers(0, M.CONTEXTS, 6), pick.integers(0, 4, (6, M.CLASSES)).astype(float)
    weights = pick.normal(size=(M.BUCKETS, M.CLASSES))
    value = lambda w: (counts * M.class_log_probabilities(w, contexts)).sum()
    g = M.gradient(weights, contexts, counts)
    for bucket in M.features_of(contexts)[:, 0]:
        moved = weights.copy()
        moved[bucket, 7] += 1e-5
        assert abs((value(moved) - value(weights)) / 1e-5 - g[bucket, 7]) < 1e-3


def test_scores_of_single_events_are_those_of_whole_rows():
    pick = np.random.default_rng(9)
    weights = pick.normal(size=(M.BUCKETS, M.CLASSES)).astype(np.float32)
    scores = M.ClassScores(weights)
    for n in (0, 5, 9000):
        contexts, kinds = pick.integers(0, M.CONTEXTS, n), pick.integers(0, M.CLASSES, n)
        want = M.class_log_probabilities(weights, contexts)[np.arange(n), kinds]
        assert np.allclose(scores(contexts, kinds), want) and np.allclose(scores(contexts, kinds), want)


def test_contexts_stay_within_texts():
    got = M.contexts_of(np.array([3, 4, 5, 6]), np.array([3, 1]))
    w, b = M.WIDTH, M.BEFORE
    assert got.tolist() == [(b * w + b) * w + b, (b * w + b) * w + 3, (b * w + 3) * w + 4, (b * w + b) * w + b]


def test_tilted_probabilities_sum_to_one_and_fit_best():
    """Over a whole class, with weights that no other choice betters."""
    share = np.array([0.4, 0.3, 0.2, 0.1])
    seen = np.array([5.0, 0.0, 3.0, 1.0])  # the last one is seen once, so it has no feature
    group, token = np.zeros(4, np.uint64), np.arange(4, dtype=np.uint32)
    p = share * np.exp(M.tilt(group, token, share, seen))
    assert abs(p.sum() - 1) < 1e-9

    def penalised(w):
        q = share * np.exp(np.array([w[0], 0, w[1], 0]))
        return (seen * np.log(q / q.sum())).sum() - (w**2).sum() / (2 * M.VARIANCE)

    w = np.log(p / share)
    w = (w - w[1])[[0, 2]]
    assert all(penalised(w) >= penalised(w + d) - 1e-6 for d in np.random.default_rng(1).normal(scale=0.1, size=(50, 2)))
    # other groups change nothing, and nothing seen changes nothing
    both = M.tilt(np.repeat(np.array([7, 9], np.uint64), 4), np.tile(token, 2), np.tile(share, 2), np.concatenate([seen, np.zeros(4)]))
    assert np.allclose(both, np.concatenate([np.log(p / share), np.zeros(4)]))


def brute_features(rows):
    """What features of pairs add to each text, from dictionaries; rows: (id, text)."""
    texts = [tokens(t) for _, t in rows]
    count = Counter(t for (i, _), ts in zip(rows, texts, strict=True) if not held_out(i) for t in ts)
    own = {t for t, c in sorted(((t, c) for t, c in count.items() if c > 1), key=lambda x: (-x[1], x[0].encode()))[: M.OWN]}
    kind = {t: M.group_of(t.encode()) for t in count if count[t] > 1 and t not in own}
    total = Counter()
    for t, k in kind.items():
        total[k] += count[t]
    events = []
    for n, ((i, _), ts) in enumerate(zip(rows, texts, strict=True)):
        for j, t in enumerate(ts):
            if t in kind:
                events.append((n, (ts[j - 1] if j else None, kind[t]), t, count[t] / total[kind[t]], float(not held_out(i))))
    number = lambda values: np.unique(np.array([str(v) for v in values]), return_inverse=True)[1].astype(np.uint64)
    if not events:
        return np.zeros(len(rows))
    text, last, token, share, weight = zip(*events, strict=True)
    share, weight = np.array(share), np.array(weight)
    pair = M.tilt(number(last), number(token).astype(np.uint32), share, weight)
    return np.bincount(np.array(text), pair, minlength=len(rows)) / np.log(10)


def test_token_features_against_dictionaries(spark, docs, odd):
    for df in (docs, odd.union(odd), docs.union(docs).union(docs.limit(3))):
        rows = [(r.doc_id, r.text) for r in df.collect()]
        keyed = df.select(F.col("doc_id").alias("id"), "text", (M.fold_of(F.col("doc_id")) == 1).alias("held_out"))
        counts = M.stash(M.count_tokens(keyed.filter(~F.col("held_out")).select("text")))
        corpus = M.Corpus(keyed, counts, M.vocabulary_of(counts), 10**6)
        for parts in (1, 7):
            got = {r.key: r.add for r in M.score_events(M.send_events(corpus, ~F.col("held_out"), parts), parts).collect()}
            keys = [r.key for r in df.select(F.xxhash64("text").alias("key")).collect()]
            assert np.allclose([got[k] for k in keys], brute_features(rows), atol=0.02 * max(len(t or "") for _, t in rows) ** 0.5), parts


def test_events_after_a_dominant_token_are_cut(spark):
    """One token stands before nearly all others: its groups stay near the size that is asked for, and probabilities still sum to one over a class."""
    pick = np.random.default_rng(7)
    rows = [(i, " ".join(f"the w{x}" for x in pick.integers(0, 50, 200))) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    keyed = df.select(F.col("doc_id").alias("id"), "text", (M.fold_of(F.col("doc_id")) == 1).alias("held_out"))
    counts = M.stash(M.count_tokens(keyed.filter(~F.col("held_out")).select("text")))
    corpus = M.Corpus(keyed, counts, M.vocabulary_of(counts), 10**6)
    sizes = {}
    for most in (10**9, 1000):
        [(_, _, coded)] = corpus.reader()(next(iter(keyed.select("text").toArrow().to_batches())))
        keys = np.array([r.key for r in df.select(F.xxhash64("text").alias("key")).collect()]).view(np.uint64)
        _, group, _, _ = M.token_events(coded, keys, most)
        sizes[most] = np.unique(group, return_counts=True)[1].max()
    assert sizes[1000] < 0.25 * sizes[10**9]
    whole, cut = ({r.doc_id: r.score / r.n_tokens for r in M.score(df, partitions=2, part=p).collect()} for p in (10**9, 3000))
    assert max(abs(whole[i] - cut[i]) for i, _ in rows) < 0.3


def test_cuts_of_big_groups_change_no_score(spark):
    """Scores do not depend on whether a group is cut: one after a frequent token, one after a token with a class of many, and the starts of texts."""
    pick = np.random.default_rng(11)
    skewed = lambda n: np.minimum(pick.geometric(0.05, n), 60)
    rows = [(i, " ".join([f"s{x % 7}" for x in skewed(1)] + [f"{'the' if x % 3 else 'rare'} w{x}" for x in skewed(150)])) for i in range(120)]
    df = spark.createDataFrame(rows + [(i + 1000, t) for i, t in rows[:20]] + [(5000, None)], "doc_id bigint, text string")
    key = lambda part: {r.doc_id: r.score for r in M.score(df, partitions=2, part=part).collect()}
    whole = key(10**9)
    for part in (2000, 300, 40):
        cut = key(part)
        assert max(abs(whole[i] - cut[i]) for i in whole) < 1e-6, part
    keyed = df.select(F.col("doc_id").alias("id"), "text", (M.fold_of(F.col("doc_id")) == 1).alias("held_out"))
    counts = M.stash(M.count_tokens(keyed.filter(~F.col("held_out")).select("text")))
    corpus = M.Corpus(keyed, counts, M.vocabulary_of(counts), 10**6)
    big = M.big_groups(M.class_counts(corpus, ~F.col("held_out"), 2, 40), 40)
    assert len(big.groups) > 3 and big.cuts.max() > 5


def test_documents_that_occur_twice_score_higher(spark, docs):
    """The model remembers what its corpus repeats."""
    many = docs.filter(M.fold_of(F.col("doc_id")) != 1)
    some = [r.doc_id for r in many.orderBy("doc_id").limit(20).collect()]
    again = many.filter(F.col("doc_id").isin(*some)).withColumn("doc_id", F.col("doc_id") * 1000 + 7)
    both = {r.doc_id: r.score / r.n_tokens for r in M.score(many.unionByName(again.filter(M.fold_of(F.col("doc_id")) != 1)), partitions=2).collect()}
    once = {r.doc_id: r.score / r.n_tokens for r in M.score(many, partitions=2).collect()}
    doubled = [i for i in some if i * 1000 + 7 in both and once[i] < -2]
    assert len(doubled) > 5 and np.mean([both[i] - once[i] for i in doubled]) > 0.3


def test_wrapper_columns(spark):
    from siftlake.llm import queries

    got = queries.op1_maxent_lm(spark, "/root/testdata/sf0.001")
    assert got.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    rows = got.collect()
    check_base([(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()], rows)
    assert all(r.score <= 0 for r in rows)


def test_a_batch_looks_each_distinct_token_up_once_and_in_order(monkeypatch):
    keys = np.sort(M.hashes_of([b"a", b"b", b" "], M.Shingler()))
    encoder = M.Encoder(M.Vocabulary(9, 3, 0, 0, {}, np.zeros(M.CLASSES)), keys, np.array([4, 3, 2]), np.array([M.OWN] * 3))
    asked, look_up = [], encoder.look_up
    monkeypatch.setattr(encoder, "look_up", lambda hashes: asked.append(hashes) or look_up(hashes))
    coded = encoder.encode([b"b a zz b", b"", b"A b zz"])
    assert [len(x) for x in asked] == [4] and (np.diff(asked[0].view(np.int64) ^ np.int64(-(2**63))) > 0).all()
    want = M.hashes_of([b"b", b"a", b"zz", b"b", b" ", b" ", b"a", b"b", b"zz", b" "], M.Shingler())
    assert coded.hash.tolist() == want.tolist() and coded.lengths.tolist() == [5, 1, 4]
    count, kind = look_up(want)
    assert coded.count.tolist() == count.tolist() and coded.kind.tolist() == kind.tolist() and np.allclose(coded.share, encoder.share(count, kind))


def test_sums_bring_all_that_a_text_needs(spark, odd):
    """Texts sent from many tasks, by as many parts, have their sizes, base and class scores once."""
    many = odd
    for _ in range(3):
        many = many.union(odd)
    keyed = many.repartition(9).select(F.col("doc_id").alias("id"), "text", (M.fold_of(F.col("doc_id")) == 1).alias("held_out"))
    counts = M.stash(M.count_tokens(keyed.filter(~F.col("held_out")).select("text")))
    vocabulary = M.vocabulary_of(counts)
    corpus = M.Corpus(keyed, counts, vocabulary, 10**6)
    weights = np.random.default_rng(5).normal(size=(M.BUCKETS, M.CLASSES)).astype(np.float32)
    got = {r.key: r for r in M.score_events(M.send_events(corpus, ~F.col("held_out"), 5, weights=spark.sparkContext.broadcast(weights)), 3).collect()}
    rows = odd.select("text", F.xxhash64("text").alias("key")).collect()
    assert set(got) == {r.key for r in rows}
    encoder = M.Encoder(vocabulary, *M.hashed_counts(counts, vocabulary))
    for r in rows:
        one, c = got[r.key], encoder.encode([(r.text or "").encode()])
        by_class = M.class_log_probabilities(weights, M.contexts_of(c.kind, c.lengths))[np.arange(len(c.kind)), c.kind] / np.log(10)
        assert (one.tokens, one.known) == (len(c.kind), (c.count > 0).sum())
        assert np.isclose(one.own, (by_class + c.share).sum(), rtol=1e-5) and np.isclose(one.base, (np.log10(c.count + 0.5) - vocabulary.below).sum())


def sent(spark, rows, most=10**6):
    keyed = rows.select(F.col("doc_id").alias("id"), "text", (M.fold_of(F.col("doc_id")) == 1).alias("held_out"))
    counts = M.stash(M.count_tokens(keyed.filter(~F.col("held_out")).select("text")))
    vocabulary = M.vocabulary_of(counts)
    return M.Corpus(keyed, counts, vocabulary, most), vocabulary


def test_what_is_sent_does_not_grow_with_the_number_of_parts(spark, docs):
    """A text whose events go to hundreds of parts does not name itself in each."""
    corpus, _ = sent(spark, docs)
    size = {p: M.send_events(corpus, ~F.col("held_out"), p).agg(F.sum(F.length("blob"))).first()[0] for p in (5, 500)}
    assert size[500] < 1.25 * size[5]
    few, many = ({r.key: r.add for r in M.score_events(M.send_events(corpus, ~F.col("held_out"), p), 3).collect()} for p in (5, 500))
    assert few.keys() == many.keys() and max(abs(few[k] - many[k]) for k in few) < 1e-6


def test_sums_return_once_for_each_lane(spark, docs, monkeypatch):
    """Parts add up before anything returns, also if a task can hold the sums of few texts only."""
    corpus, _ = sent(spark, docs.union(docs.limit(7)).repartition(3))
    whole = {r.key: r for r in M.score_events(M.send_events(corpus, ~F.col("held_out"), 40), 2).collect()}
    monkeypatch.setattr(M, "MOST_TEXTS", 10)
    small = {r.key: r for r in M.score_events(M.send_events(corpus, ~F.col("held_out"), 40), 40).collect()}
    assert whole.keys() == small.keys() and sum(r.rows for r in whole.values()) == docs.count() + 7
    assert max(abs(whole[k].add - small[k].add) for k in whole) < 1e-6 and all(whole[k][2:] == small[k][2:] for k in whole)


def test_tokens_that_no_held_out_text_has_twice_are_not_broadcast(spark, docs, odd):
    """A vocabulary just too large: tokens seen once are looked up for held-out texts only, with equal scores, and texts are not joined with their tokens."""
    again = docs.filter(M.fold_of(F.col("doc_id")) != 1).limit(9).withColumn("doc_id", F.explode(F.sequence(F.lit(10**6), F.lit(10**6 + 3))))
    rows = docs.select("doc_id", "text").union(odd.select("doc_id", "text")).union(again.select("doc_id", "text"))
    _, vocabulary = sent(spark, rows)
    keyed = rows.select(F.col("doc_id").alias("id"), "text", (M.fold_of(F.col("doc_id")) == 1).alias("held_out"))
    counts = M.stash(M.count_tokens(keyed.filter(~F.col("held_out")).select("text")))
    corpus = M.Corpus(keyed, counts, vocabulary, vocabulary.distinct - 1, ~F.col("held_out"))
    assert corpus.partly and len(corpus.shared.value[0]) < 0.9 * vocabulary.distinct
    key = lambda r: (str(r.doc_id), r.n_tokens, r.n_known, round(r.base_score, 6), r.score)
    whole, partly = (sorted(map(key, M.score(rows, broadcast_vocab=n, partitions=2).collect())) for n in (10**6, vocabulary.distinct - 1))
    assert [x[:4] for x in whole] == [x[:4] for x in partly] and np.allclose([x[4] for x in whole], [x[4] for x in partly], rtol=1e-9, atol=1e-6)
