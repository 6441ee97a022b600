import random

import numpy as np
import pytest

from chronoview.llm import negatives
from chronoview.llm.vectors import LIMIT

SCHEMA = "vec_id long, embedding array<double>, label int, anchor string, score int, rank long"
EXTRA = ("x", 1, 2)


def vectors(n, width=16, seed=0, labels=4, close=0.6):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(width)] for _ in range(labels)]
    found = []
    for i in range(n):
        label = rng.randrange(labels)
        found.append((i, [close * c + rng.gauss(0, 0.5) for c in centres[rng.randrange(labels)]],
                      label, *EXTRA))
    return found


def expected(data, every, positives=5, count=3):
    kept = [(r[0], [int(np.floor(256 * x)) for x in r[1]], r[2]) for r in data
            if r[0] is not None and r[2] is not None and r[1] and all(
                x is not None and np.isfinite(x) for x in r[1])]
    width = max({len(k[1]) for k in kept}, key=lambda s: sum(len(k[1]) == s for k in kept))
    kept = [k for k in kept if len(k[1]) == width]
    rows = []
    for a, (anchor, v, label) in enumerate(kept):
        if anchor % every:
            continue
        scores = [(-sum(x * y for x, y in zip(v, w)), i, own == label)
                  for b, (i, w, own) in enumerate(kept) if b != a]
        best = sorted(s for s in scores if s[2])[:positives]
        for p, positive, _ in best:
            hard = sorted(s for s in scores if not s[2] and 50 * -p <= 100 * -s[0] <= 95 * -p)
            rows += [(anchor, positive, k + 1, n, -p, -s)
                     for k, (s, n, _) in enumerate(hard[:count])]
    return sorted(rows)


def check(spark, data, every=7):
    frame = spark.createDataFrame(data, SCHEMA).repartition(3)
    got = sorted(tuple(r) for r in negatives.hard_negatives(frame, every=every).collect())
    want = expected(data, every)
    assert got == want and want


def test_against_all_pairs(spark):
    check(spark, vectors(400))


def test_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    data = vectors(90, seed=2) + [
        (None, [1.0] * 16, 1, *EXTRA), (700, None, 1, *EXTRA), (707, [1.0] * 16, None, *EXTRA),
        (714, [nan] * 16, 1, *EXTRA), (721, [inf] * 16, 1, *EXTRA), (728, [1.0] * 3, 1, *EXTRA),
        (735, [], 1, *EXTRA), (742, [0.0] * 16, 1, *EXTRA), (-7, [0.3] * 16, 2, *EXTRA)]
    data += [data[14], data[14], data[15], (14, [0.2] * 16, 3, *EXTRA)]
    check(spark, data)


def test_one_label_holds_most_rows(spark):
    data = [(i, v, 0 if i % 3 else label, *EXTRA) for i, v, label, *_ in vectors(300, seed=4)]
    check(spark, data)


def test_ties_go_by_id(spark):
    data = [(i, [(1.0 if k == i % 3 else 0.9) * (1 - i % 2 / 4) for k in range(16)], i % 2, *EXTRA)
            for i in range(60)]
    check(spark, data)


def test_several_cells(spark, monkeypatch):
    monkeypatch.setattr(negatives, "ANCHORS", 8)
    monkeypatch.setattr(negatives, "ROWS", 32)
    monkeypatch.setattr(negatives, "LEAST_ROWS", 4)
    check(spark, vectors(200, seed=6))


def test_empty_table(spark):
    assert negatives.hard_negatives(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("width", [1, 3, 16, 64, 100])
def test_bounds_hold_and_narrow(width):
    rng = np.random.default_rng(width)
    v = rng.integers(-300, 300, (40, width))
    means, deviations = negatives.summaries(v)
    exact, at, before = v @ v.T, 0, None
    for bounds in negatives.levels_of(width):
        cut = slice(at, at + len(bounds) - 1)
        middle = means[:, cut] @ means[:, cut].T
        spread = deviations[:, cut] @ deviations[:, cut].T
        assert (np.abs(exact - middle) <= spread + 1e-6 * (1 + np.abs(exact))).all()
        assert before is None or (spread <= before + 1e-6 * (1 + before)).all()
        at, before = at + len(bounds) - 1, spread


def test_summaries_spare_products(monkeypatch):
    """Clustered vectors: few pairs are left for the exact product after the first steps."""
    rng = np.random.default_rng(1)
    centres = rng.normal(0, 100, (20, 2)).repeat(32, axis=1)
    v = (centres[rng.integers(0, 20, 4000)] + rng.normal(0, 3, (4000, 64))).astype(np.int64)
    means, deviations = negatives.summaries(v)
    ids = np.arange(4000)
    rows = negatives.Vectors(ids, ids, ids % 3, v, means, deviations)
    counted = []
    real = negatives.comparable

    def counting(*sides):
        counted.append(1)
        return real(*sides)
    monkeypatch.setattr(negatives, "comparable", counting)
    left = []
    whole = negatives.scored

    def watching(*args):
        found = whole(*args)
        left.append(len(found[2]))
        return found
    monkeypatch.setattr(negatives, "scored", watching)
    n = 100
    found = negatives.search(rows.part(0, n), rows, True, np.full((n, 1), negatives.LOW),
                             np.full((n, 1), negatives.HIGH), 5)
    assert len(found[0]) == 5 * n
    assert sum(left) < 0.1 * n * 4000
    score = v[:n] @ v.T
    for i in range(n):
        allowed = [j for j in range(4000) if j != i and j % 3 == i % 3]
        best = sorted((-score[i, j], j) for j in allowed)[:5]
        own = [(-s, j) for a, s, j in zip(found[0], found[2], found[3]) if a == i]
        assert sorted(own) == best


def test_large_whole_numbers_stay_exact():
    v = np.full((2, 64), LIMIT, np.int64)
    left, right = negatives.comparable(v, v)
    assert (left @ right.T).astype(np.int64).tolist() == [[64 * LIMIT * LIMIT] * 2] * 2
