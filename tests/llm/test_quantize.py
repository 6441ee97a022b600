import hashlib
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from chronoview.llm import quantize

SCHEMA = "vec_id long, embedding array<double>, label int, error string, row int, home long"
EXTRA = ("x", 1, 2)
NAN, INF = float("nan"), float("inf")


def vectors(n, width=8, seed=0, labels=3):
    rng = random.Random(seed)
    return [(i, [rng.gauss(0, 1) for _ in range(width)], rng.randrange(labels), *EXTRA)
            for i in range(n)]


def usable(v):
    return v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v)


def expected(data, parts=4, entries=256, rounds=4, scale=1024):
    kept = [(r[0], [max(-1 << 24, min(1 << 24, math.floor(scale * x))) for x in r[1]], r[2])
            for r in data if usable(r[1])]
    sizes = Counter(len(v) for _, v, _ in kept)
    usual = max(sizes, key=lambda s: (sizes[s], s))
    kept = [k for k in kept if len(k[1]) == usual]
    kept.sort(key=lambda k: (k[0] is None, k[0] or 0, k[1]))
    width = usual // parts
    cut = [[v[k * width:(k + 1) * width] for k in range(parts)] for _, v, _ in kept]
    books = [[list(c[k]) for c in cut[:entries]] for k in range(parts)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), e) for e, c in enumerate(book))
    for _ in range(rounds):
        for k in range(parts):
            members = defaultdict(list)
            for c in cut:
                members[nearest(c[k], books[k])[1]].append(c[k])
            for e, own in members.items():
                books[k][e] = [sum(x) // len(own) for x in zip(*own)]
    digest = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode())
    rows = []
    for (vec_id, _, label), c in zip(kept, cut):
        best = [nearest(c[k], books[k]) for k in range(parts)]
        rows.append((vec_id, label, "".join(f"{e:02x}" for _, e in best), sum(d for d, _ in best)))
    totals = Counter()
    for r in rows:
        totals[r[1]] += r[3]
    return Counter((*r, totals[r[1]], digest.hexdigest()) for r in rows)


def check(spark, data, **options):
    frame = spark.createDataFrame(data, SCHEMA).repartition(5)
    got = Counter(tuple(r) for r in quantize.vector_codes(frame, **options).collect())
    assert got == expected(data, **options)


def test_awkward_rows(spark):
    data = vectors(60) + [
        (100, None, 1, *EXTRA), (101, [1.0, None] * 4, 1, *EXTRA), (102, [NAN] * 8, 2, *EXTRA),
        (103, [INF] + [0.0] * 7, 2, *EXTRA), (104, [], 0, *EXTRA), (105, [1.0] * 4, 0, *EXTRA),
        (None, [0.5] * 8, None, *EXTRA), (106, [0.5] * 8, None, *EXTRA),
        (107, [1e300, -1e300] * 4, 1, *EXTRA), (3, [0.25] * 8, 1, *EXTRA)]
    data += [data[3], data[3]]
    check(spark, data)
    check(spark, data, entries=7, rounds=3)


def test_one_entry_holds_a_third(spark, monkeypatch):
    monkeypatch.setattr(quantize, "OWNER_ROWS", 16)
    monkeypatch.setattr(quantize, "SLOT_ROWS", 64)
    data = [(i, [0.5] * 8 if i % 3 else v, label, *EXTRA) for i, v, label, *_ in vectors(600)]
    check(spark, data, entries=20)


def test_more_rows_than_entries(spark):
    check(spark, vectors(700, width=4, seed=5))


def test_empty_and_unequal(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert quantize.vector_codes(empty).collect() == []
    with pytest.raises(ValueError, match="equal parts"):
        quantize.vector_codes(spark.createDataFrame([(1, [1.0] * 6, 1, *EXTRA)], SCHEMA))


def test_residents_are_read_without_a_shuffle(spark):
    """Of the two sides of a round only arriving members pass an exchange."""
    rows = quantize.numbered(spark.createDataFrame(vectors(80), SCHEMA), 1024, *(
        quantize.F.col(c) for c in ("vec_id", "label")))
    members, books = quantize.fit(rows, 4, 16, 2)
    layout = quantize.Layout(80, 4, 8)
    plan = quantize.reassign(members, books, layout)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Bucketed: true" in plan
    before = plan[:plan.index("Exchange")]
    assert before.count("Bucketed: true") == 1 or plan.count("Bucketed: true") == 1


def test_large_whole_numbers_stay_exact():
    points = np.array([[1 << 24, -(1 << 24)], [3, 4]], np.int64)
    entry, distance = quantize.nearest(points, np.array([[0, 0], [-(1 << 24), 1 << 24]], np.int64))
    assert entry.tolist() == [0, 0]
    assert distance.tolist() == [2 * (1 << 48), 25]
