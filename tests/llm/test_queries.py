import hashlib
import re
import struct
from collections import Counter

import public_tokenizers
import pytest
import tiktoken

from siftlake.llm import byte_bpe, queries, url_filter
from tests.llm.test_secret_scan import brute as secrets
from tests.oracle import compare, connect

SF, SMALL = "/root/testdata/sf0.01", "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_rows_as_sql(spark, name):
    assert compare(queries.QUERIES[name](spark, SF), connect(SF), queries.ORACLE_SQL[name])


def rows_and_texts(spark, name):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    got = queries.QUERIES[name](spark, SMALL).collect()
    assert sorted(r.doc_id for r in got) == sorted(docs)
    return [(r, docs[r.doc_id]) for r in got]


def test_byte_bpe_columns(spark):
    ranks = {t: i for i, t in enumerate(byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")))}
    plain = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for r, text in rows_and_texts(spark, "op5_byte_bpe"):
        ids = plain.encode_ordinary(text)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


def test_secret_scan_columns(spark):
    for r, text in rows_and_texts(spark, "op7_secret_scan"):
        base = secrets(text)
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == x for k, _, _ in base) for x in ("assign", "access", "hex"))
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest() and set(joined.split(",")) <= set(r.spans.split(","))


def test_url_filter_shares_and_verdicts(spark):
    """Rules by plain string tests, and every template's share and verdict from the counts of its own rows."""
    rows = queries.op9_url_filter(spark, SF).collect()
    urls = {r.page_id: r.url for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    assert sorted(r.page_id for r in rows) == sorted(urls)
    kinds = {}
    for r in rows:
        host, path = re.match("(?s)[^:]*://([^/?#]*)([^?#]*)", urls[r.page_id]).groups()
        fits = [(len(h + p), h + p, kind) for kind, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        _, rule, kinds[r.page_id] = max(fits, default=(0, None, None))
        assert (r.host, r.path, r.rule) == (host, path, rule)
    own, anywhere, every = Counter(), Counter(), Counter()
    for r in rows:
        for label in [x for x in (kinds[r.page_id],) if x]:
            own[r.host, r.template, label] += 1
            anywhere[r.template, label] += 1
            every[label] += 1
    prior = (every["block"] + 1) / (every.total() + 2)
    for r in rows:
        n, k = (anywhere[r.template, "block"] + anywhere[r.template, "allow"], anywhere[r.template, "block"])
        wide = (k + 8 * prior) / (n + 8)
        n, k = (own[r.host, r.template, "block"] + own[r.host, r.template, "allow"], own[r.host, r.template, "block"])
        share = (k + 8 * wide) / (n + 8)
        assert abs(r.blocked_share - share) < 1e-6 and r.verdict == (kinds[r.page_id] or ("block" if share >= 0.5 else "allow"))
