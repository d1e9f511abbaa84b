import hashlib
import struct

import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from siftlake.llm import byte_bpe

PATH = P.path("byte_bpe_50k.tiktoken")
TOKENS = byte_bpe.read_ranks(PATH)
PLAIN = tiktoken.Encoding("plain", pat_str=P.PATTERN, mergeable_ranks={t: i for i, t in enumerate(TOKENS)}, special_tokens={})
CODEC = byte_bpe.Codec(TOKENS, P.PATTERN)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(exclude_categories=["Cs"])), max_size=4))
def test_same_ids_as_the_rank_encoder_and_exact_round_trip(texts):
    ids = list(CODEC.encode_batch(texts))
    assert ids == [PLAIN.encode_ordinary(t) for t in texts]
    assert [CODEC.decode(x) for x in ids] == [t.encode() for t in texts]


@pytest.mark.parametrize("text", ["a" * 5000, "▁▁ ▁x <unk></s>", "\x00\x01\x7f", " \t\n \r\n  x", "<|endoftext|>"])
def test_awkward_texts(text):
    assert list(CODEC.encode_batch([text])) == [PLAIN.encode_ordinary(text)]


def test_odd_rows(odd):
    rows = byte_bpe.digests(odd, PATH, P.PATTERN).collect()
    assert len(rows) == odd.count()
    want = {}
    for r in odd.collect():
        ids = PLAIN.encode_ordinary(r.text or "")
        want[(r.doc_id, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest())] = 1
    assert {tuple(r) for r in rows} == set(want)


def test_encode_gives_ids_and_bytes(odd, none):
    for r in byte_bpe.encode(odd, PATH, P.PATTERN).collect():
        assert r.n_tokens == len(r.ids) and b"".join(TOKENS[i] for i in r.ids) == bytes(r.decoded)
    assert byte_bpe.encode(none, PATH, P.PATTERN).count() == 0


def test_ranks_need_no_gaps(tmp_path):
    (tmp_path / "r").write_text("YQ== 0\nYg== 2\n")
    with pytest.raises(ValueError):
        byte_bpe.read_ranks(str(tmp_path / "r"))
