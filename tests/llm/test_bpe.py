import struct

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from cuelake.llm import bpe

from .helpers import docs

PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def models():
    ranks = bpe.load_ranks(PATH)
    return bpe.ByteBpe(ranks, PATTERN), tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids(packed):
    return list(struct.unpack(f"<{len(packed) // 4}I", packed))


@pytest.mark.parametrize("text", ["", " ", "aaaa" * 50, "Hello world, it's 2024!", "ÄÖÜ straße", "日本語 text 漢字", "\n\n\t x  y", "abab" * 2000, "<|endoftext|>", "🙂👩‍👩‍👧"])
def test_equals_tiktoken(models, text):
    own, other = models
    packed = own.encode(text)
    assert ids(packed) == other.encode_ordinary(text)
    assert own.decode(packed) == text.encode()


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from("abeinrst ")), max_size=80))
def test_random_texts(models, text):
    own, other = models
    assert ids(own.encode(text)) == other.encode_ordinary(text)


def test_long_pre_token(models):
    own, other = models
    text = "abcde" * 8000
    assert ids(own.encode(text)) == other.encode_ordinary(text)


def test_table(spark):
    rows = [(1, "hello there"), (1, "hello there"), (2, None), (3, ""), (None, "x")]
    out = bpe.decode(bpe.encode(docs(spark, rows), PATH, PATTERN), PATH, PATTERN).collect()
    assert sorted((r.doc_id or 0, bytes(r.decoded).decode()) for r in out) == [(0, "x"), (1, "hello there"), (1, "hello there"), (2, ""), (3, "")]
    assert bpe.encode(docs(spark, []), PATH, PATTERN).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from("abeinrst ")), max_size=120), max_size=12))
def test_texts_together(models, texts):
    own, other = models
    assert [ids(x) for x in own.encode_texts(texts)] == [other.encode_ordinary(t) for t in texts]


def test_new_short_pre_tokens_are_merged_together(models, monkeypatch):
    ranks, other = models[0].ranks, models[1]
    own, alone = bpe.ByteBpe(ranks, PATTERN), []
    one = own.encode_piece
    monkeypatch.setattr(own, "encode_piece", lambda piece: alone.append(piece) or one(piece))
    # More new pre-tokens than rows, of all lengths about the edge, repeated pairs, and one text that goes alone.
    texts = ["".join(f" q{'xzab'[i % 4] * (i % 70)}w{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}{'uvwxyzabcd'[i // 100 % 10]}k" for i in range(k, 5000, 3)) for k in range(3)] + ["", "zzq" * 400_000]
    assert [ids(x) for x in own.encode_texts(texts)] == [other.encode_ordinary(t) for t in texts]
    assert all(len(p) > bpe.SHORT or len(p) == 1 or p in ranks for p in alone)
    assert not any(level.any() for level in (own.merge_arrays[2].leaves, own.merge_arrays[2].summary, own.merge_arrays[2].top))
