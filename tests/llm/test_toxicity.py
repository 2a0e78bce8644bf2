import math
import random
import zlib
from collections import Counter
from functools import cache
from itertools import combinations

import numpy as np
import pytest

from cuelake.llm import toxicity

from .helpers import docs


def brute(s, t):
    """The kernel by its definition, normalised."""

    def raw(x, y):
        total = 0.0
        for i in combinations(range(len(x)), toxicity.ORDER):
            for j in combinations(range(len(y)), toxicity.ORDER):
                if [x[k] for k in i] == [y[k] for k in j]:
                    total += toxicity.DECAY ** (i[-1] - i[0] + 1 + j[-1] - j[0] + 1)
        return total

    return raw(s, t) / math.sqrt(raw(s, s) * raw(t, t))


def test_kernel():
    rng = random.Random(2)
    words = ["^" + "".join(rng.choices("abci", k=rng.randrange(3, 9))) for _ in range(40)]
    marks = toxicity.Landmarks(["^abc", "^iiab", "^cabici"])
    got = marks.similar(words, 0.0)
    for k, w in enumerate(words):
        for j, m in enumerate(marks.words):
            assert got[k, j] == pytest.approx(brute(w, m), abs=1e-5)
    cut = marks.similar(words)
    near = got.max(axis=1) >= toxicity.ACTIVE
    assert np.allclose(cut[near], got[near]) and not cut[~near].any()


def corpus(n=400, seed=4):
    rng = random.Random(seed)
    plain = ["".join(rng.choices("aeionrst", k=rng.randrange(3, 9))) for _ in range(300)]
    bad = ["dummkopf", "blockhead", "rascal"]
    rows, marks = [], []
    for i in range(n):
        words = rng.choices(plain, k=rng.randrange(5, 120))
        toxic = i % 5 == 1
        if toxic:
            for _ in range(2):
                words.insert(rng.randrange(len(words)), rng.choice(bad))
        rows.append((i, " ".join(w + rng.choice(["", "", "."]) for w in words)))
        marks.append((i, 0, int(toxic)))
    return rows, marks


def labels(spark, marks):
    return spark.createDataFrame(marks, "doc_id bigint, quality int, toxic int")


@pytest.fixture(scope="module")
def model(spark):
    rows, marks = corpus()
    return toxicity.fit(docs(spark, rows), labels(spark, marks))


def test_held_out(spark, model):
    rows, marks = corpus()
    got = {r.doc_id: r.score for r in toxicity.score(docs(spark, rows), model).collect()}
    held = [(i, y) for i, _, y in marks if zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(held) > 50 and sum((got[i] >= 0.5) == y for i, y in held) >= 0.97 * len(held)


@cache
def subsequences(word):
    """Weight of each subsequence of a word."""
    out = Counter()
    for i in combinations(range(len(word)), toxicity.ORDER):
        out[tuple(word[k] for k in i)] += toxicity.DECAY ** (i[-1] - i[0] + 1)
    return out


@cache
def kernel(s, t):
    raw = lambda x, y: sum(v * subsequences(y)[u] for u, v in subsequences(x).items())
    return raw(s, t) / math.sqrt(raw(s, s) * raw(t, t))


def slow_score(model, text):
    """A text's score by definition: kernels of all words with all landmarks, pooled over sentences, mapped and weighed."""
    marks = model.landmarks

    def row(tokens):
        rows = [[kernel(w, m) for m in marks] for t in tokens for w in toxicity.forms(t)]
        return np.max([r if max(r) >= toxicity.ACTIVE else [0.0] * len(marks) for r in rows] or [[0.0] * len(marks)], axis=0)

    sentences = [[]]
    for line in text.lower().split("\n"):
        for w in line.split():
            sentences[-1].append(w)
            if w[-1] in ".!?":
                sentences.append([])
        sentences.append([])
    found = [row(x) for x in sentences if x]
    total = np.sum(found, axis=0) if found else np.zeros(len(marks))
    best = np.max(found, axis=0) if found else np.zeros(len(marks))
    values, vectors = np.linalg.eigh(np.array([[kernel(a, b) for b in marks] for a in marks]))
    root = vectors / np.sqrt(values) @ vectors.T
    x = np.concatenate([f @ root for f in (best, total / max(1, len(found)), np.log1p(total))])
    a, b = model.curve
    return 1 / (1 + math.exp(-(a * (((x - model.centre) / model.scale) @ model.weights + model.bias) + b)))


def test_score_by_definition(spark, model):
    rows = [*corpus()[0][:60], (900, ""), (901, "You BLOCKHEAD!\nras-cal, r.a.s.c.a.l? dumm_kopf. fine words"), (902, "blxockhead rasca. blockheads\n\nrascals")]
    got = {r.doc_id: r.score for r in toxicity.score(docs(spark, rows), model).collect()}
    assert len(model.landmarks) >= 3
    for i, t in rows:
        assert got[i] == pytest.approx(slow_score(model, t), abs=1e-4), t


def test_many_insults(spark):
    """Forty insults without common stems, each in few texts: held-out recall of every one."""
    rng = random.Random(12)
    plain = ["".join(rng.choices("aeionrst", k=rng.randrange(3, 9))) for _ in range(300)]
    bad = ["".join(rng.choices("bcdfghjklmpquvwxyz", k=8)) for _ in range(40)]
    rows = []
    for i in range(2400):
        words = rng.choices(plain, k=rng.randrange(5, 60))
        insult = bad[i // 4 % 40] if i % 4 == 1 else None
        for _ in range(2 if insult else 0):
            words.insert(rng.randrange(len(words)), insult)
        rows.append((" ".join(words), int(i % 4 == 1), insult))
    model = toxicity.fit(docs(spark, [(i, r[0]) for i, r in enumerate(rows)]), labels(spark, [(i, 0, r[1]) for i, r in enumerate(rows)]))
    held = [r for i, r in enumerate(rows) if zlib.crc32(str(i).encode()) % 5 == 0]
    got = model.scorer().scores([r[0] for r in held]) >= 0.5
    caught = {w: [g for g, r in zip(got, held, strict=True) if r[2] == w] for w in bad}
    assert all(sum(c) >= 0.6 * len(c) for c in caught.values())
    assert sum(got) <= 1.05 * sum(r[1] for r in held)


def test_training_is_bounded(spark):
    """Repeated ids with many texts do not raise the number of rows read; the model needs no text on the driver."""
    rows = [(k % 7, f"text number {k}") for k in range(500)]
    train = toxicity.training_rows(docs(spark, rows), labels(spark, [(k, 0, k % 2) for k in range(7)]), 20)
    assert train.count() == 20


def test_other_scripts():
    """Letters outside a-z are compared exactly, also those with one coarse code."""
    step = toxicity.LETTERS - 27
    word = "^" + "".join(chr(0x4E00 + k) for k in (5, 90, 333))
    other = "^" + "".join(chr(0x4E00 + k + step) for k in (5, 90, 333))
    got = toxicity.Landmarks([word]).similar([word, other], 0.0)
    assert got[0, 0] == pytest.approx(1) and got[1, 0] == 0
    assert toxicity.forms("坏") and not toxicity.forms("a")


@pytest.mark.parametrize("insult", ["you dummkopf here", "you d.u.m.m.k.o.p.f here", "you dummmkopf here", "you d u m m k o p f here", "such a dumxmkopf it is", "such a blockheaad it is", "xxxx BLOCK-HEAD.", "z" * 30 + " rascal"])
def test_variants(model, insult):
    assert model.scorer().scores([insult])[0] >= 0.5


def test_edges(spark, model):
    rows = [(1, None), (2, ""), (3, "tree stone"), (3, "tree stone"), (None, "a rascal, rascal"), (5, "tear " * 30000), (6, "a" * 5000)]
    got = toxicity.score(docs(spark, rows), model).collect()
    assert len(got) == 7 and all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r.score for r in got}
    assert by[1] == by[2] == by[3] < 0.5 <= by[None]
    assert toxicity.score(docs(spark, []), model).count() == 0
    kept = toxicity.reject(docs(spark, rows), model)
    assert kept.columns == docs(spark, rows).columns and None not in {r.doc_id for r in kept.collect()} and kept.count() == 6


def test_poor_labels(spark):
    rows, marks = corpus(40)
    for some in ([], [(i, 0, 0) for i, _, _ in marks], [(i, 0, None) for i, _, _ in marks], [(i, 0, 1) for i, _, _ in marks]):
        m = toxicity.fit(docs(spark, rows), labels(spark, some))
        assert len(set(m.scorer().scores([r[1] for r in rows]).tolist())) == 1


def test_near_copies_train_once(spark):
    rng = random.Random(3)
    base = [f"w{k}" for k in rng.choices(range(500), k=80)]
    copies = [(k, " ".join([*base[:40], f"x{k}", *base[40:]])) for k in range(30)]
    others = [(100 + k, " ".join(f"w{j}" for j in rng.choices(range(500), k=60))) for k in range(30)]
    marks = [(i, 0, int(i < 15)) for i, _ in copies + others]
    train = toxicity.training_rows(docs(spark, copies + others), labels(spark, marks), 1000)
    ids = toxicity.training_ids(train.cache())
    groups = {t: sum(r.toxic == t for r in train.collect() if " w" in r.text) for t in (0, 1)}
    assert ids.num_rows <= 2 + sum(1 for i, _ in others) and ids.num_rows < sum(groups.values())
    assert set(ids.column("toxic").to_pylist()) == {0, 1}
