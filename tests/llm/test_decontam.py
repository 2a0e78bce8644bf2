import random

import numpy as np
import pytest

from cuelake.llm import decontam

from .helpers import docs

WORDS = [f"word{k}" for k in range(400)]


def bench(spark, rows):
    return spark.createDataFrame(rows, "item_id bigint, text string")


def slow_tiles(item, text, least):
    """Greedy string tiling by trying every pair of places."""
    a, b, out = [True] * len(item), [x >= 0 for x in text], []
    while True:
        best = []
        for i in range(len(item)):
            for j in range(len(text)):
                n = 0
                while i + n < len(item) and j + n < len(text) and a[i + n] and b[j + n] and item[i + n] == text[j + n]:
                    n += 1
                best.append((-n, i, j))
        n, i, j = min(best, default=(0, 0, 0))
        if -n < least:
            return out
        for k in range(-n):
            a[i + k] = b[j + k] = False
        out.append((i, j, -n))


@pytest.mark.parametrize("seed", range(30))
def test_tiles(seed):
    rng = random.Random(seed)
    item = [rng.randrange(4) for _ in range(rng.randrange(1, 25))]
    text = [rng.randrange(-1, 4) for _ in range(rng.randrange(1, 40))]
    if seed % 3 == 0:
        text = item[len(item) // 2 :] + [-1] + item[: len(item) // 2]
    seed_of = {}
    seeds = lambda x: [(k, seed_of.setdefault(tuple(x[k : k + 3]), len(seed_of))) for k in range(len(x) - 2) if min(x[k : k + 3]) >= 0]
    own = np.array([h for _, h in seeds(item)], np.uint64)
    shared = [(k, h) for k, h in seeds(text) if h in own]
    got = decontam.tiles(own, np.array([h for _, h in shared], np.uint64), np.array([k for k, _ in shared], np.int64), 3) if len(own) else []
    assert all(item[i : i + n] == text[j : j + n] for i, j, n in got)
    assert sorted(x[2] for x in got) == sorted(x[2] for x in slow_tiles(item, text, 3))


def slow_leaks(rows, items, least=5, threshold=0.6):
    """All pairs, by trying every pair of places."""
    out = set()
    for doc_id, text in rows:
        for item_id, item in items:
            a, b = decontam.words_of(item or ""), decontam.words_of(text or "")
            ids = {w: k for k, w in enumerate(a + b)}
            covered = sum(x[2] for x in slow_tiles([ids[w] for w in a], [ids[w] for w in b], least))
            if len(a) >= least and covered >= threshold * len(a):
                out.add((doc_id, item_id, covered))
    return out


def test_against_brute_force(spark):
    rng = random.Random(8)
    items = [(k, " ".join(rng.choices(WORDS[:40], k=rng.randrange(3, 25)))) for k in range(12)]
    rows = []
    for k in range(40):
        words = rng.choices(WORDS[:40], k=rng.randrange(60))
        for _ in range(rng.randrange(3)):
            part = rng.choice(items)[1].split()
            cut = rng.randrange(len(part))
            at = rng.randrange(len(words) + 1)
            words[at:at] = rng.choice([part, part[cut:] + part[:cut], part[:cut], part[cut:] + ["x"] + part[:cut]])
        rows.append((k, " ".join(words)))
    got = {(r.doc_id, r.item_id, r.covered_words) for r in decontam.find_leaks(docs(spark, rows), bench(spark, items)).collect()}
    assert got == slow_leaks(rows, items) and len(got) > 10
    left = {r.doc_id for r in decontam.decontaminate(docs(spark, rows), bench(spark, items)).collect()}
    assert left == {i for i, _ in rows} - {i for i, _, _ in got}


def test_passages(spark):
    rng = random.Random(3)
    item = rng.choices(WORDS, k=40)
    other = rng.choices(WORDS, k=30)
    filler = lambda n: rng.choices(WORDS, k=n)
    rows = [
        (1, " ".join(filler(50) + item + filler(50))),
        (2, " ".join(filler(50) + item[20:] + filler(30) + item[:20] + filler(9))),
        (3, " ".join(w.upper() + "," for w in item)),
        (4, " ".join(filler(300))),
        (5, None),
        (6, ""),
        (7, " ".join(filler(20) + item[:10] + filler(20))),
        (8, " ".join((filler(30) + other) * 200)),
        (8, " ".join((filler(30) + other) * 200)),
        (9, "two words"),
    ]
    items = [(1, " ".join(item)), (2, " ".join(other)), (3, None), (4, ""), (5, "two words")]
    got = sorted((r.doc_id, r.item_id) for r in decontam.find_leaks(docs(spark, rows), bench(spark, items)).collect())
    assert got == [(1, 1), (2, 1), (3, 1), (8, 2), (8, 2)]
    left = sorted(r.doc_id for r in decontam.decontaminate(docs(spark, rows), bench(spark, items)).collect())
    assert left == [4, 5, 6, 7, 9]
    assert sorted((r.item_id, r.n_words) for r in decontam.short_items(bench(spark, items)).collect()) == [(3, 0), (4, 0), (5, 2)]


def test_phrase_shared_by_all(spark):
    """One phrase in every document and item makes no pairs; the passages that leak are found all the same."""
    rng = random.Random(11)
    phrase = " ".join(f"p{k}" for k in range(8))
    items = [(k, f"{phrase} " + " ".join(f"i{k}x{j}" for j in range(12))) for k in range(1000)]
    rows = [(k, " ".join(rng.choices(WORDS, k=6)) + f" {phrase}") for k in range(2000)]
    own = [f"i7x{j}" for j in range(12)]
    rows += [(5000, items[7][1]), (5001, " ".join(own)), (5002, " ".join([*own[6:], "gap", *own[:6]])), (5003, f"{phrase} {' '.join(own[:3])}"), (5003, f"{phrase} {' '.join(own[:5])}"), (None, items[9][1])]
    table = decontam.stored(decontam.item_seeds(bench(spark, items), 5), "items")
    near = decontam.stored(decontam.document_seeds(docs(spark, rows), decontam.filter_of(table), 5), "seeds")
    counts = near.groupBy("seed").count().withColumnRenamed("count", "n")
    met = decontam.met_by_keys(near, decontam.item_keys(table, counts, 5, 0.6), counts)
    assert met.count() < 100
    assert decontam.shared_seeds(near, met, table).selectExpr("sum(size(shared))").first()[0] < 1000
    got = {(r.doc_id, r.item_id, r.covered_words) for r in decontam.find_leaks(docs(spark, rows), bench(spark, items)).collect()}
    assert got == {(5000, 7, 20), (5001, 7, 12), (5002, 7, 12), (5003, 7, 13), (None, 9, 20)}


@pytest.mark.parametrize("seed", range(3))
def test_keys_lose_no_leak(spark, seed):
    """Words from a small set, so that seeds repeat within items and are common: equal to trying all pairs."""
    rng = random.Random(seed)
    some = WORDS[:3]
    items = [(k, " ".join(rng.choices(some, k=rng.randrange(5, 14)))) for k in range(8)]
    rows = [(k, " ".join(rng.choices(some, k=rng.randrange(4, 40)))) for k in range(30)]
    got = {(r.doc_id, r.item_id, r.covered_words) for r in decontam.find_leaks(docs(spark, rows), bench(spark, items)).collect()}
    assert got == slow_leaks(rows, items) and got


def test_empty_clashes_and_scripts(spark):
    items = [(k, " ".join(f"a{k}x{j}" for j in range(8))) for k in range(6)]
    got = decontam.find_leaks(docs(spark, items), bench(spark, [*items, items[0]])).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == [(0, 0), *((k, k) for k in range(6))]
    assert decontam.find_leaks(docs(spark, []), bench(spark, items)).count() == 0
    assert decontam.find_leaks(docs(spark, items), bench(spark, [])).count() == 0
    names = "doc_id bigint, text string, seed string, place string, item string, text_id string, shared string"
    rows = spark.createDataFrame([(1, items[0][1], *"abcde"), (1, "other", *"abcde"), (None, items[1][1], *"abcde")], names)
    assert [r.text for r in decontam.decontaminate(rows, bench(spark, items)).collect()] == ["other"]
    passage = "\u6f22\u5b57\u304b\u306a\u4ea4\u3058\u308a\u6587"
    turned = passage[4:] + "\u3002x" + passage[:4]
    got = decontam.find_leaks(docs(spark, [(1, f"x{passage}y"), (2, turned * 2), (3, turned)]), bench(spark, [(1, passage * 2)]), threshold=0.5)
    assert {r.doc_id for r in got.collect()} == {1, 2}
