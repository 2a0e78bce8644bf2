import math
import random
import re
from collections import Counter, defaultdict

import numpy as np

from cuelake.llm import balltree

from .helpers import docs

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
SMALL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, items, k=20):
    split = lambda t: TERM.findall((t or "").translate(SMALL))
    counts = [(i, Counter(split(t))) for i, t in rows]
    counts = [(i, c, c.total()) for i, c in counts if c]
    n_docs, n_terms = len(counts), sum(n for *_, n in counts)
    df = Counter(t for _, c, _ in counts for t in c)
    out = defaultdict(list)
    for item, text in sorted({(i, t or "") for i, t in items}, key=repr):
        ranked = []
        for i, c, n in counts:
            m = 100 - 25 + 25 * n * n_docs // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t in split(text) if c[t])
            if s > 0:
                ranked.append((-s, i is not None, i or 0, i))
        out[item] += [(r + 1, x[3], -x[0]) for r, x in enumerate(sorted(ranked, key=lambda x: x[:3])[:k])]
    return sorted(((item, *x) for item, own in out.items() for x in own), key=repr)


def some_docs(n, seed=1):
    rng = random.Random(seed)
    words = [f"{a}{b}" for a in "abcdefg" for b in ("lo", "ma", "ñu", "Ké", "123", "_x", "中文")]
    topics = [rng.sample(words, 12) for _ in range(6)]
    seps = [" ", ", ", "\n", "-", "\x00", "\x7f"]
    rows = []
    for i in range(n):
        topic = rng.choice(topics)
        rows.append((i, "".join(rng.choice(topic if rng.random() < 0.8 else words) + rng.choice(seps) for _ in range(rng.randrange(0, 60)))))
    return rows, words, topics, rng


def got(spark, rows, items, **more):
    table = spark.createDataFrame([(i, t, "x", 1) for i, t in items], "item_id bigint, text string, terms string, chunk int")
    return [tuple(r) for r in balltree.search(docs(spark, rows), table, **more).collect()]


def test_against_brute_force(spark, monkeypatch):
    for name, value in (("CHUNK", 2000), ("LEAST", 1000), ("LEAF", 5), ("PART", 40)):
        monkeypatch.setattr(balltree, name, value)
    rows, words, topics, rng = some_docs(400)
    rows += [(1000 + k, rows[5][1]) for k in range(50)]  # ties beyond k
    rows += [(3000, None), (3001, ""), (3002, " .,- "), (None, rows[7][1]), (7, rows[7][1]), (7, rows[8][1]), (3003, "LOng alo " * 3000)]
    items = [(k, " ".join(rng.choices(topics[k % 6], k=rng.randrange(3, 25)))) for k in range(20)]
    items += [(50, None), (51, ""), (52, "nowhere"), (53, "ALO alo Ñu ñu"), (0, "alo"), (1, items[1][1]), (None, words[3]), (54, "alo nowhere ma")]
    want = brute(rows, items)
    assert sorted(got(spark, rows, items), key=repr) == want
    assert len(want) > 300


def test_empty_tables(spark):
    assert got(spark, [], [(1, "alo")]) == []
    assert got(spark, [(1, "alo")], []) == []
    assert got(spark, [(1, None)], [(1, "alo")]) == []
    pair = [(1, "alo Alo"), (2, "b")]
    assert got(spark, pair, [(1, "alo")], k=5) == brute(pair, [(1, "alo")])


def test_subtrees_are_left_out():
    """Topics without common terms: a search scores few documents, and finds the same."""
    rng = np.random.default_rng(2)
    rows = [np.sort(rng.choice(30, 8, replace=False)) + 30 * (k % 40) for k in range(2000)]
    impacts = rng.integers(1, 10**6, 8 * 2000)
    tree = balltree.BallTree(np.arange(2000), np.arange(2001) * 8, np.concatenate(rows), impacts, 1200)
    dims, weights = np.arange(60, 80), rng.integers(100, 9000, 20)
    ids, scores = tree.search(dims, weights, 10)
    whole = np.zeros(1200, np.int64)
    whole[dims] = weights
    want = (whole[np.array(rows)] * impacts.reshape(2000, 8)).sum(axis=1)
    best = np.lexsort((np.arange(2000), -want))[:10]
    assert ids.tolist() == best.tolist() and scores.tolist() == want[best].tolist()
    assert tree.scored < 1000


def test_parts_of_long_texts(monkeypatch):
    text = "Äpfel apple APPLE x9-y ".encode() * 50
    whole = balltree.count_terms(text)
    monkeypatch.setattr(balltree, "PART", 7)
    assert balltree.count_terms(text) == whole and whole["Äpfel".encode()] == 50 and whole[b"apple"] == 100
