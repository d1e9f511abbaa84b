import hashlib
import re

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from siftlake.llm import queries, raking
from siftlake.llm.common import table


def test_margins_meet_their_targets(spark):
    cells = spark.createDataFrame([(s, lang, t, 10 * i + 5) for i, (s, lang, t) in enumerate((s, lang, t) for s in "abc" for lang in "xy" for t in "pq")], "source string, lang string, topic string, tokens bigint")
    targets = {"source": {"a": 0.5, "b": 0.25, "c": 0.25}, "lang": {"x": 0.7}}
    got = raking.factors(cells, targets, passes=12).collect()
    total = sum(r.tokens for r in got)
    share = lambda m, v: sum(r.tokens * r.factor for r in got if r[m] == v) / total
    assert abs(share("source", "a") - 0.5) < 1e-6 and abs(share("lang", "x") - 0.7) < 1e-6 and abs(share("lang", "y") - 0.3) < 1e-6
    roots = {t: sum(r.tokens for r in got if r.topic == t) ** 0.5 for t in "pq"}
    assert abs(share("topic", "p") - roots["p"] / sum(roots.values())) < 1e-6
    s = raking.scale_for(spark.createDataFrame(got), 0.6, rounds=20)
    assert abs(sum(min(1, s * r.factor) * r.tokens for r in got) - 0.6 * total) < 1e-6 * total


def test_targets_that_do_not_fit(spark):
    cells = spark.createDataFrame([(s, lang, "t", 10) for s in "ab" for lang in "xy"], "source string, lang string, topic string, tokens bigint")
    got = raking.factors(cells, {"source": {"a": 3.0, "b": 1.0}, "lang": {"z": 0.9}, "topic": {"t": 0.5}}).collect()
    share = lambda m, v: sum(r.tokens * r.factor for r in got if r[m] == v) / 40
    assert abs(share("source", "a") - 0.75) < 1e-9 and abs(share("lang", "x") - 0.5) < 1e-9 and abs(share("topic", "t") - 1) < 1e-9


def test_expected_copies_meet_the_margins(spark):
    """The sample's expected shares, source, language and a topic of the caller's, are the targets within 1 %."""
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    targets = {"lang": {"en": 0.3, "es": 0.25}, "topic": {"0": 0.2, "1": 0.5}}
    rows = raking.mix(docs, targets, passes=12, topic=F.col("doc_id") % 3).collect()
    every = sum(r._mix_expected * r._mix_n_tokens for r in rows)
    for m, wanted in (*targets.items(), ("topic", {"2": 0.3})):
        for value, share in wanted.items():
            assert abs(sum(r._mix_expected * r._mix_n_tokens for r in rows if r[f"_mix_{m}"] == value) / every - share) < 0.01 * share


def test_odd_rows(odd, none):
    got = raking.mix(odd).collect()
    assert len(got) == odd.count() and set(odd.columns) <= set(got[0].asDict())
    for r in got:
        n = len(re.findall(r"[^\x20\x09-\x0d]+", r.text or ""))
        u = int(hashlib.md5(f"mix:{'' if r.doc_id is None else r.doc_id}".encode()).hexdigest()[:12], 16) / 2**48
        assert r._mix_n_tokens == n and r._mix_kept == (u < r._mix_probability) and 0 <= r._mix_probability <= 1
        assert (r._mix_source, r._mix_lang) == (r.source or "", r.lang or "")
    assert raking.mix(none).count() == 0
    assert raking.mix(odd.filter("doc_id = 2")).count() == 1


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_same_as_sql(spark, sf):
    got = sorted(tuple(r) for r in queries.op6_raking(spark, f"/root/testdata/{sf}").collect())
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '/root/testdata/{sf}/documents.parquet'")
    assert got == sorted(con.sql(raking.sql()).fetchall())


def test_no_python_on_the_main_path(spark):
    plan = queries.op6_raking(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    plan = queries.op10_merkle(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_sample_has_the_target_shares(spark):
    sf = "/root/testdata/sf0.01"
    docs = table(spark, sf, "documents").select(*corpus_pipeline.COLUMNS)
    rows = [r.asDict() for r in raking.mix(docs, keep=0.9).drop("text").collect()]
    assert all((r["_mix_copies"] > 0) == r["_mix_kept"] for r in rows) and max(r["_mix_copies"] for r in rows) > 1
    times = {r["doc_id"]: r["_mix_copies"] for r in rows}
    sample = corpus_pipeline.mixture(spark, docs, sf)
    assert {r.doc_id: r.n for r in sample.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).collect()} == {i: n for i, n in times.items() if n}
    for m in ("lang", "topic"):
        shares = [{v: sum(r["_mix_n_tokens"] * w(r) for r in rows if r[f"_mix_{m}"] == v) for v in {r[f"_mix_{m}"] for r in rows}} for w in (lambda r: 1, lambda r: r["_mix_weight"], lambda r: r["_mix_copies"])]
        before, target, got = ({v: x / sum(s.values()) for v, x in s.items()} for s in shares)
        # six passes leave the margins close to the default targets; the draw of 1000 documents adds its noise
        roots = {v: x**0.5 for v, x in before.items()}
        assert all(abs(target[v] - roots[v] / sum(roots.values())) < 1e-3 for v in before)
        assert all(abs(got[v] - target[v]) < 0.02 for v in before), (m, before, target, got)
