"""Each stage on its predecessor's rows against a brute-force version."""

import public_tokenizers as P
import pytest
import tiktoken

import corpus_pipeline
from siftlake.llm import byte_bpe, quality_crf, raking, secret_scan
from siftlake.llm.common import stash, table
from tests.llm.test_ngram_join import brute as components
from tests.llm.test_secret_scan import brute as secrets

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    rows = [table(spark, SF, "documents")]
    for _, stage in corpus_pipeline.STAGES:
        rows.append(stash(stage(spark, rows[-1], SF)))
    return rows


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_columns_and_names(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "secrets", "mixture", "tokens"]
    assert all(tuple(df.columns) == corpus_pipeline.COLUMNS for df in stages[1:-1])


def test_quality_keeps_good_documents(spark, stages):
    before, after = by_id(stages[0]), by_id(stages[1])
    model = quality_crf.fit(stages[0], table(spark, SF, "labels"))
    want = {i for i, r in before.items() if model.scores([r.text.encode()])[0] >= 0.3}
    assert set(after) == want
    good = [r.doc_id for r in table(spark, SF, "labels").filter("quality = 1").collect()]
    assert sum(i in after for i in good) >= 0.98 * len(good)


def test_one_document_of_each_group(stages):
    before, after = by_id(stages[1]), by_id(stages[2])
    groups = components([(i, r.text) for i, r in before.items()])
    assert set(after) == {i for i, _, least in groups if i == least}
    assert all(after[i].text == before[i].text for i in after)


def test_secrets_are_masked(stages):
    before, after = by_id(stages[2]), by_id(stages[3])
    assert set(before) == set(after)
    scanner = secret_scan.Scanner(secret_scan.BASE_RULES + secret_scan.MORE_RULES)
    for i, r in after.items():
        assert not secrets(r.text) and r.n_chars == len(r.text)
        assert scanner.spans([before[i].text]) != [[]] or r.text == before[i].text


def test_mixture_and_tokens(stages):
    before, after, tokens = by_id(stages[3]), by_id(stages[4]), by_id(stages[5])
    assert set(after) == {r.doc_id for r in raking.mix(stages[3], keep=0.9).filter("_mix_kept").collect()} <= set(before)
    ranks = {t: i for i, t in enumerate(byte_bpe.read_ranks(P.path("byte_bpe_50k.tiktoken")))}
    plain = tiktoken.Encoding("plain", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert {i: r.ids for i, r in tokens.items()} == {i: plain.encode_ordinary(r.text) for i, r in after.items()}


def test_odd_rows(spark, odd, none):
    for df in (odd, none):
        rows = df
        for _, stage in corpus_pipeline.STAGES:
            rows = stash(stage(spark, rows, SF))
        assert set(rows.columns) == {"doc_id", "n_tokens", "ids"}
    assert rows.count() == 0
