from pyspark.sql import functions as F

from siftlake.llm import topk_search as K

ROWS = [(1, [0.5, -0.25]), (2, [0.5, -0.25]), (3, None), (4, [None, 1.0]), (5, [float("nan"), 1.0]), (6, [float("inf"), 0.0]), (7, []), (8, [1.0]), (100, [1.0, 1.0]), (200, [-1.0, 0.0, 2.0]), (300, [0.0, 0.0]), (8, [1.0]), (200, [1.0]), (300, [0.0, 0.0]), (None, [1.0, 1.0]), (None, [2.0])]


def brute(rows, k):
    out, seen = [], {}
    places = []
    for q, v in sorted(rows, key=lambda r: r[1]):
        seen[q] = seen.get(q, 0) + 1
        places.append((q, seen[q], v))
    for q, place, v in places:
        if q is None or q % 100:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), i is None, i or 0) for i, other, w in places if (i, other) != (q, place))
        out += [(q, rank, None if gone else i, -s, place) for rank, (s, gone, i) in enumerate(scored[:k], 1)]
    return sorted(out, key=str)


def vectors(spark, rows):
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").withColumn("score", F.lit("extra"))
    return df.filter(K.usable(F.col("embedding"))).select("vec_id", K.integer_vector(F.col("embedding")).alias("vector"), "score")


def test_small_tables_in_many_blocks(spark):
    v = vectors(spark, ROWS)
    kept = [(r.vec_id, r.vector) for r in v.collect()]
    assert {i for i, _ in kept} == {1, 2, 7, 8, 100, 200, 300, None}
    for k, qb, cb in ((3, 1, 2), (10, 100, 100), (1, 2, 1)):
        got = K.top_k(v.filter("vec_id % 100 = 0"), v, k, query_block=qb, candidate_block=cb, slots=3)
        assert sorted((tuple(r) for r in got.collect()), key=str) == brute(kept, k)


def test_empty_tables(spark):
    v = vectors(spark, ROWS)
    assert K.top_k(v.filter("false"), v).count() == 0 and K.top_k(v, v.filter("false")).count() == 0


def test_whole_table_against_brute_force(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").filter(K.usable(F.col("embedding")))
    v = rows.select("vec_id", K.integer_vector(F.col("embedding")).alias("vector"))
    got = sorted((tuple(r) for r in K.top_k(v.filter("vec_id % 100 = 0"), v, candidate_block=64).collect()), key=str)
    assert got == brute([(r.vec_id, r.vector) for r in v.collect()], 10)
