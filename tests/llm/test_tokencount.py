import math
import random

import public_tokenizers
import pytest

from cuelake.llm import tokencount

from .helpers import docs

PATH = public_tokenizers.path("piece_bpe_32k.model")


def brute(token, scores):
    """Best (score, -pieces) over all segmentations."""
    best = [(0.0, 0)]
    for k in range(1, len(token) + 1):
        options = [(best[k - 1][0] + tokencount.UNKNOWN, best[k - 1][1] - 1)]
        for a in range(k):
            s = scores.get(token[a:k])
            if s is not None:
                options.append((best[a][0] + s, best[a][1] - 1))
        best.append(max(options))
    return -best[-1][1]


def test_trie_against_brute_force():
    rng = random.Random(1)
    scores = {"".join(rng.choices("abc", k=rng.randrange(1, 5))): -math.log(rng.randrange(2, 40)) for _ in range(30)} | {"▁": -2.0, "▁a": -1.0}
    trie = tokencount.Trie(scores)
    for _ in range(500):
        word = "".join(rng.choices("abcd", k=rng.randrange(1, 12)))
        assert trie.count(word) == brute("▁" + word, scores)
    assert len(trie.forward) < sum(1 + len(x) for x in trie.ends)
    shared = {("▁" + x)[:n] for x in trie.ends for n in range(1, len(x) + 2)}
    assert len(trie.forward) == 1 + len(shared)  # a node for each distinct prefix, and the root


@pytest.fixture(scope="module")
def scores():
    return tokencount.load_pieces(PATH)


def test_table(spark, scores):
    rows = [(1, "the quick brown fox the"), (1, "the quick brown fox the"), (2, None), (3, " \n\t"), (4, "日本 ÿ𝔘"), (5, "x" * 3000), (None, "one")]
    got = sorted((r.doc_id or 0, r.n_pretokens, r.n_tokens) for r in tokencount.token_counts(docs(spark, rows), PATH).collect())
    assert got == sorted((i or 0, len((t or "").split()), sum(brute("▁" + w, scores) for w in (t or "").split())) for i, t in rows)
    assert tokencount.token_counts(docs(spark, []), PATH).count() == 0


def test_long_pre_token(scores):
    """A pre-token of a million characters takes a trie of SHARED nodes."""
    trie = tokencount.Trie(scores)
    word = "".join(random.Random(2).choices("etaoinshr", k=1000))
    assert trie.count(word) == brute("▁" + word, scores)
    assert trie.count(word[:300] * 3000) > 100_000
    assert len(trie.forward) <= 2 * tokencount.SHARED + 1 and not trie.ends


def test_bounded_trie(monkeypatch, scores):
    monkeypatch.setattr(tokencount, "NODES", 50)
    trie = tokencount.Trie(scores)
    words = [f"word{k}" for k in range(100)]
    assert [trie.count(w) for w in words] == [brute("▁" + w, scores) for w in words]
    assert len(trie.forward) < 80
