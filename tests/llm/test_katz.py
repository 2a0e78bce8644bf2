import math
import random
import re
import zlib
from collections import Counter

import pytest

from cuelake.llm import katz

from .helpers import docs


def tokens(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), "<end>"]


class Model:
    """The same model by dictionaries and recursion."""

    def __init__(self, texts, order):
        self.order = order
        self.counts = [Counter() for _ in range(order + 1)]
        for t in texts:
            for k in range(1, order + 1):
                for gram in self.grams(tokens(t), k):
                    self.counts[k][gram] += 1
        self.d = [None] + [self.discounts(self.counts[k]) for k in range(1, order + 1)]
        self.vocabulary = [g[0] for g in self.counts[1]]
        self.followers = [None] + [{} for _ in range(order)]
        for k in range(1, order + 1):
            for g, c in self.counts[k].items():
                self.followers[k].setdefault(g[:-1], {})[g[-1]] = c
        self.cache = {}

    @staticmethod
    def grams(words, k):
        padded = ["<begin>"] * (k - 1) + words
        return [tuple(padded[i : i + k]) for i in range(len(words))]

    @staticmethod
    def discounts(counts):
        n = Counter(counts.values())
        k = katz.K
        common = (k + 1) * n[k + 1] / n[1] if n[1] else 1.0
        out = {}
        for r in range(1, k + 1):
            d = ((r + 1) * n[r + 1] / (r * n[r]) - common) / (1 - common) if n[r] and common != 1 else -1
            out[r] = d if 0 < d < 1 else (r - 0.5) / r
        return out

    def history(self, h):
        if h not in self.cache:
            k = len(h) + 1
            seen = self.followers[k].get(h, {})
            total = sum(seen.values())
            mass = sum(self.d[k].get(c, 1) * c for c in seen.values())
            divisor = total if total - mass > 1e-9 * max(total, 1) else total + 1
            left = 1 - mass / divisor
            lower = sum(self.p(w, h[1:]) for w in seen) if h else 0.0
            self.cache[h] = seen, divisor, left / (1 - lower) if seen else 1.0
        return self.cache[h]

    def p(self, w, h):
        seen, divisor, weight = self.history(h)
        if w in seen:
            return self.d[len(h) + 1].get(seen[w], 1) * seen[w] / divisor
        return weight * self.p(w, h[1:]) if h else weight

    def score(self, text):
        return sum(math.log10(self.p(g[-1], g[:-1])) for g in self.grams(tokens(text), self.order))


def corpus(n=120, seed=9):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(60)] + ["The", "THE", "Ünï", "ÜNÏ"]
    weights = [1 / (k + 1) for k in range(len(words))]
    return [(i, " \t".join(rng.choices(words, weights, k=rng.randrange(0, 60)))) for i in range(n)]


@pytest.mark.parametrize("order", [1, 2, 3])
def test_against_recursion(spark, monkeypatch, order):
    monkeypatch.setattr(katz, "BLOCK_TOKENS", 500)
    monkeypatch.setattr(katz, "PART_TOKENS", 400)
    rows = [*corpus(), (500, None), (501, ""), (501, "w1 w1"), (502, "unheard words " * 400)]
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    train = [t for i, t in rows if not held(i)]
    model = Model(train, order)
    seen = Counter(x for t in train for x in tokens(t))
    n, v = sum(seen.values()), len(seen)
    got = sorted((r.doc_id, r.n_tokens, r) for r in katz.katz_scores(docs(spark, rows), order).collect())
    want = sorted((i, len(tokens(t)), t) for i, t in rows)
    assert len(got) == len(want)
    for (i, size, r), (j, wanted, t) in zip(got, want, strict=True):
        assert (i, size, r.held_out, r.train_tokens) == (j, wanted, held(i), n)
        assert r.n_known == sum(x in seen for x in tokens(t))
        assert r.base_score == pytest.approx(sum(math.log10((seen[x] + 1) / (n + v + 1)) for x in tokens(t)))
        assert r.score == pytest.approx(model.score(t), rel=1e-9)


def test_sums_to_one():
    model = Model([t for _, t in corpus()], 2)
    for h in [("<begin>",), ("the",), ("w0",), ("w30",), ("never",), ()]:
        assert sum(model.p(w, h) for w in [*model.vocabulary, "unknown"]) == pytest.approx(1)


def test_edges(spark):
    assert katz.katz_scores(docs(spark, [])).count() == 0
    held = next(i for i in range(50) if zlib.crc32(str(i).encode()) % 7 == 2)
    r = katz.katz_scores(docs(spark, [(held, "only held out")])).collect()
    assert [(x.n_tokens, x.n_known, x.train_tokens, x.score) for x in r] == [(4, 0, 0, 0.0)]
    assert [x.doc_id for x in katz.katz_scores(docs(spark, [(None, "no id")])).collect()] == [None]


def test_end_is_no_word(spark):
    """Texts cannot spell the end token."""
    rows = [(i, "\x00end one <end> END") for i in range(20)]
    train = [t for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2]
    seen = Counter(x for t in train for x in tokens(t.replace("<end>", "<own>")))
    n, v = sum(seen.values()), len(seen)
    for r in katz.katz_scores(docs(spark, rows)).collect():
        assert r.base_score == pytest.approx(sum(math.log10((seen[x] + 1) / (n + v + 1)) for x in tokens(rows[0][1].replace("<end>", "<own>"))))
