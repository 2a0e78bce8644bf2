import math

import numpy as np
import pytest

from cuelake.llm import ann

SCHEMA = "vec_id bigint, embedding array<float>, label int, v string, c1 string"


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], None, "x", "y") for i, v in rows], SCHEMA)


def brute(rows, every, k):
    good = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if v is not None and None not in v and np.isfinite(np.array(v, float)).all() and np.any(np.array(v, np.float32) != 0)]
    ids, x = np.array([i for i, _ in good]), np.array([v for _, v in good])
    out = {}
    for q, v in good:
        if q % every == 0:
            s = (x * v).sum(axis=1)
            some = ids != q
            best = np.lexsort((ids[some], -s[some]))[:k]
            out[q] = list(zip(ids[some][best].tolist(), s[some][best].tolist(), strict=True))
    return out


def results(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        assert r.rank == len(out.setdefault(r.query_id, [])) + 1
        out[r.query_id].append((r.vec_id, r.score))
    return out


def vectors(n, seed=1, dim=16):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(20, dim))
    x = centres[rng.integers(0, 20, n)] + 0.5 * rng.normal(size=(n, dim))
    return [(k, (v / np.linalg.norm(v)).tolist()) for k, v in enumerate(x)]


def test_exact_when_all_are_candidates(spark):
    rows = vectors(300)
    rows += [(300 + k, rows[7][1]) for k in range(60)]
    rows += [(1000, None), (1001, [0.0] * 16), (1020, [math.nan] * 16), (1040, [None] * 16), (1060, [math.inf] * 16), (1080, [1.0])]
    got = results(ann.search(table(spark, rows)))
    want = brute([r for r in rows if r[0] != 1080], 20, 20)
    assert got.keys() == want.keys()
    for q, w in want.items():
        assert [i for i, _ in got[q]] == [i for i, _ in w]
        assert [s for _, s in got[q]] == pytest.approx([s for _, s in w])


def test_recall(spark, monkeypatch):
    monkeypatch.setattr(ann, "CHUNK", 40)
    rows = vectors(4000, 2)
    got, want = results(ann.search(table(spark, rows), candidates=600)), brute(rows, 20, 20)
    found = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert found >= 0.9 * sum(map(len, want.values()))


def recall(got, want):
    return sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want) / sum(map(len, want.values()))


def test_budget_grows_until_neighbours_are_met(spark):
    """Scattered vectors, whose neighbours lie in many cells: 100 candidates of 6,000 meet few of them."""
    x = np.random.default_rng(6).normal(size=(6000, 16))
    rows = [(k, (v / np.linalg.norm(v)).tolist()) for k, v in enumerate(x)]
    assert recall(results(ann.search(table(spark, rows), candidates=100)), brute(rows, 20, 20)) >= 0.9


def test_small_share_is_visited(spark, monkeypatch):
    """Clustered vectors at the default of 4,000 candidates: few of 60,000 are visited, and most neighbours are found."""
    budgets = []
    enough = ann.enough
    monkeypatch.setattr(ann, "enough", lambda *a: budgets.append(enough(*a)) or budgets[-1])
    rows = vectors(60_000, 3)
    got, want = results(ann.search(table(spark, rows), query_every=300)), brute(rows, 300, 20)
    assert max(budgets[0], 4021) <= 0.1 * len(rows)
    assert recall(got, want) >= 0.9


def test_walk_meets_all_cells_down_to_its_last():
    rng = np.random.default_rng(3)
    a, b, sizes = rng.integers(0, 6, 9) / 4, rng.integers(0, 6, 7) / 4, rng.integers(0, 3, (9, 7))
    near = a[:, None] + b[None, :]
    for wanted in (1, 5, 20, int(sizes.sum()), 10**9):
        found, last = ann.walk(a, b, sizes.tolist(), wanted)
        assert sorted(found) == list(zip(*(x.tolist() for x in np.nonzero((near >= last) & (sizes > 0))), strict=True))
        held, nearer = sum(sizes[c] for c in found), sizes[near > last].sum()
        assert held >= min(wanted, sizes.sum()) and nearer < wanted


def test_walk_opens_no_more_than_it_needs(monkeypatch):
    """A short walk over a million cells touches few of them."""
    pushed = []
    push, replace = ann.heapq.heappush, ann.heapq.heapreplace
    monkeypatch.setattr(ann.heapq, "heappush", lambda h, x: pushed.append(x) or push(h, x))
    monkeypatch.setattr(ann.heapq, "heapreplace", lambda h, x: pushed.append(x) or replace(h, x))
    rng = np.random.default_rng(4)
    found, _ = ann.walk(rng.normal(size=1000), rng.normal(size=1000), [[1] * 1000] * 1000, 50)
    assert len(found) == 50 and len(pushed) <= 100


def test_deal():
    first, parts = ann.deal(np.array([3, 4, 25, 0, 9, 2]), 10)
    assert first.tolist() == [0, 0, 1, 4, 4, 5] and parts.tolist() == [1, 1, 3, 1, 1, 1]


def test_query_of_an_id_with_two_vectors(spark):
    """The least vector asks, in whatever order the rows come."""
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [0.9, 0.1]), (2, [0.1, 0.9])]
    for some in (rows, rows[::-1]):
        assert {q: [i for i, _ in v] for q, v in results(ann.search(table(spark, some))).items()} == {0: [2, 1]}


def test_enough():
    sizes = np.array([[3, 0], [2, 5]])
    one, two = np.array([[1.0, 0.0]]), np.array([[0.5, 0.2]])  # nearness 1.5, 1.2, 0.5, 0.2
    assert [ann.enough(one, two, sizes, [[c]], 1.0) for c in ((0, 0), (1, 0), (1, 1))] == [3, 5, 10]
    assert ann.enough(one, two, sizes, [[(0, 0), (1, 1)]], 0.5) == 3
    assert ann.enough(one, two, sizes, [[]], 0.9) == 0


def test_few_and_empty(spark):
    got = results(ann.search(table(spark, [(0, [1.0, 0.0]), (20, [1.0, 0.0]), (3, [0.5, 0.5]), (3, [0.5, 0.5])])))
    assert {q: [i for i, _ in v] for q, v in got.items()} == {0: [20, 3], 20: [0, 3]}
    assert ann.search(table(spark, [])).count() == 0
    assert ann.search(table(spark, [(0, [1.0])])).count() == 0


def test_many_equal_rows_of_one_id(spark):
    """A query in 25 equal rows still finds the others that hold the same vector."""
    rows = [(20, [1.0, 0.0])] * 25 + [(21, [1.0, 0.0]), (22, [1.0, 0.0])]
    assert {q: [i for i, _ in v] for q, v in results(ann.search(table(spark, rows))).items()} == {20: [21, 22]}


def test_walk_order():
    rng = np.random.default_rng(0)
    a, b = rng.normal(size=9), rng.normal(size=7)
    sizes = rng.integers(0, 3, (9, 7))
    pairs, _ = ann.walk(a, b, sizes.tolist(), 10**9)
    assert len(pairs) == (sizes > 0).sum()
    assert all(a[p] + b[q] >= a[r] + b[s] - 1e-12 for (p, q), (r, s) in zip(pairs, pairs[1:], strict=False))
