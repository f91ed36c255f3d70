import base64
from pathlib import Path

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from leafmill.llm.tokens import ByteBPE, RankQueue, encode_corpus

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
BPE = ByteBPE(Path(VOCABULARY).read_bytes())


def peer(text):
    import tiktoken

    if not hasattr(peer, "enc"):
        peer.enc = tiktoken.Encoding("own", pat_str=r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""", mergeable_ranks=BPE.ranks, special_tokens={})
    return peer.enc.encode_ordinary(text)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("ab e  \n\t 'sü9.,<|>नी​ \x1c"), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_same_ids_as_public_encoder(text):
    assert BPE.encode(text) == peer(text)


def test_long_pretokens_and_whole_vocabulary():
    for text in ("a" * 5000, "abcab" * 3000, " " * 4000, "=" * 4001, "<|endoftext|> x", "क" * 2000):
        assert BPE.encode(text) == peer(text)
    assert all(BPE.merge(token) == [rank] for token, rank in BPE.ranks.items())


@given(st.lists(st.tuples(st.integers(0, 9000), st.integers(0, 50))))
def test_queue_order(entries):
    queue = RankQueue(9001)
    for entry in entries:
        queue.push(*entry)
    assert [queue.pop() for _ in entries] == sorted(entries) and queue.pop() is None


def test_rows(spark):
    rows = [(1, "Zinc oxide", 7), (2, None, 8), (3, "", 9), (3, "", 9), (4, " x" * 20000, 1)]
    got = encode_corpus(spark.createDataFrame(rows, "doc_id long, text string, ids int"), VOCABULARY).collect()
    assert sorted((r.doc_id, r.ids) for r in got) == sorted((d, peer(t or "")) for d, t, _ in rows)
    assert encode_corpus(spark.createDataFrame([], "doc_id long, text string"), VOCABULARY).count() == 0


def test_bad_vocabulary(spark, tmp_path):
    (tmp_path / "v").write_bytes(base64.b64encode(b"a") + b" 0\n")
    with pytest.raises(KeyError):
        ByteBPE((tmp_path / "v").read_bytes())
