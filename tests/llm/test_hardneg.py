import math

import numpy as np
import pytest

from cuelake.llm import hardneg

SCHEMA = "vec_id bigint, embedding array<float>, label int, q string, planes string, chunk int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, lab, "x", "y", 3) for i, lab, v in rows], SCHEMA)


def brute(rows, every=100, k=5):
    lengths = [len(v) for _, _, v in rows if v is not None]
    common = max(set(lengths), key=lengths.count) if lengths else 0
    good = {}
    for i, lab, v in rows:
        if None in (i, lab, v) or len(v) != common or any(x is None or not math.isfinite(x) for x in v):
            continue
        q = [math.floor(256 * float(np.float32(x))) for x in v]
        if all(abs(x) < hardneg.limit(common) - 1 for x in q):
            good[i] = min(good.get(i, (lab, q)), (lab, q))
    out = set()
    for a, (lab, q) in good.items():
        if a % every:
            continue
        ranked = sorted((-sum(x * y for x, y in zip(q, p, strict=True)), i) for i, (_, p) in good.items() if i != a)
        for s, p in [(-s, i) for s, i in ranked if good[i][0] == lab][:k]:
            inside = [(-t, i) for t, i in ranked if good[i][0] != lab and 80 * s <= -100 * t <= 100 * s][:k]
            out |= {(a, p, r + 1, i, s, t) for r, (t, i) in enumerate(inside)}
    return out


def vectors(n, seed, dim=20, labels=4, scale=0.4):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(3, dim))
    x = scale * (centres[rng.integers(0, 3, n)] + rng.normal(size=(n, dim)))
    return [(k, int(rng.integers(0, labels)), [float(a) for a in v]) for k, v in enumerate(x)]


def got(spark, rows, **more):
    return {tuple(r) for r in hardneg.mine(table(spark, rows), **more).collect()}


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(hardneg, "CHUNK", 150)
    rows = vectors(700, 1)
    rows += [(5000 + k, k % 3, rows[7][2]) for k in range(60)]  # ties
    rows += [(1000, None, rows[0][2]), (1100, 1, None), (1200, 1, [math.nan] * 20), (1300, 1, [None] + [0.1] * 19), (1400, 1, [math.inf] * 20), (1500, 1, [0.5])]
    rows += [(1600, 1, [0.0] * 20), (1700, 2, []), (None, 1, rows[0][2]), (1800, 3, [1e30] * 20), (200, 0, rows[3][2]), (300, rows[300][1], rows[300][2])]
    assert got(spark, rows) == brute(rows)
    assert len(brute(rows)) > 50


@pytest.mark.parametrize("scale", [0.001, 30.0])
def test_sizes_of_numbers(spark, scale):
    rows = vectors(300, 2, dim=9, scale=scale)
    assert got(spark, rows, anchor_every=50) == brute(rows, 50)


def test_one_label_and_none(spark):
    rows = [(i, 1, v) for i, _, v in vectors(200, 3)]
    assert got(spark, rows) == set()
    assert got(spark, []) == set()
    assert got(spark, [(0, 1, [0.5, -0.5])]) == set()


def test_scores_are_whole_inner_products():
    rng = np.random.default_rng(4)
    x, a = rng.integers(-700, 700, (500, 13)), rng.integers(-700, 700, (7, 13))
    planes = hardneg.planes_of(x, 11).transpose(1, 2, 0)
    assert np.array_equal(hardneg.scores(np.ascontiguousarray(planes), hardneg.subset_sums(a, np.int64)), x @ a.T)
