import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from corpus import EXTRA, SCHEMA, awkward, rows, sentence

from chronoview.llm import neardup

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not words:
        return frozenset()
    if len(words) < width:
        return frozenset([tuple(words)])
    return frozenset(tuple(words[i:i + width]) for i in range(len(words) - width + 1))


def brute(data, width=4, percent=80):
    sets = [shingles(r[1], width) for r in data]
    parent = list(range(len(data)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for i in range(len(data)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(
                    sets[i] | sets[j]):
                parent[find(i)] = find(j)
    members = {}
    for i, row in enumerate(data):
        members.setdefault(find(i), []).append(row[0])
    want = Counter()
    for i, row in enumerate(data):
        known = [x for x in members[find(i)] if x is not None]
        name = (min(known) if known else None) if sets[i] else row[0]
        want[(row[0], len(sets[i]), name, row[0] == name)] += 1
    return want


def edited(rng, text, changes):
    words = text.split()
    for _ in range(changes):
        words[rng.randrange(len(words))] = "edit" + str(rng.randint(0, 10**6))
    return " ".join(words)


def corpus(seed):
    rng = random.Random(seed)
    texts = []
    for _ in range(40):
        base = sentence(rng, rng.randint(3, 150))
        texts.append(base)
        for _ in range(rng.randint(0, 4)):
            texts.append(edited(rng, base, rng.randint(0, 5)))
    return rows(texts)


@pytest.mark.parametrize("seed", [1, 2])
def test_components_equal_brute_force(spark, seed):
    data = corpus(seed) + awkward(seed, 10)[10:]
    data = [(None if r[0] is None else i, *r[1:]) for i, r in enumerate(data)]
    got = neardup.near_duplicates(spark.createDataFrame(data, SCHEMA)).collect()
    assert Counter(map(tuple, got)) == brute(data)


def test_a_large_group_of_near_copies_and_a_chain(spark):
    rng = random.Random(7)
    base = sentence(rng, 120)
    texts = [edited(rng, base, rng.randint(1, 4)) for _ in range(150)]
    chain = sentence(rng, 100).split()
    for k in range(30):
        texts.append(" ".join(chain))
        chain[3 * k] = f"link{k}"
    data = rows(texts)
    got = neardup.near_duplicates(spark.createDataFrame(data, SCHEMA)).collect()
    assert Counter(map(tuple, got)) == brute(data)


def test_shingle_sets_equal_the_definition(monkeypatch):
    texts = [r[1] for r in awkward()] + ["A b C", "a B c", "x y z w v"]
    for stretch in (1 << 18, 64):
        monkeypatch.setattr("chronoview.llm.words.STRETCH", stretch)
        with np.errstate(over="ignore"):
            sizes = [len(s) for s in neardup.text_shingles(pa.array(texts), 4)]
        assert sizes == [len(shingles(t, 4)) for t in texts]


def test_estimate_is_close_and_corrected():
    rng = np.random.default_rng(1)
    with np.errstate(over="ignore"):
        for share in (0.0, 0.5, 0.8, 0.95):
            values = rng.integers(0, 1 << 63, 3000).astype(np.uint64)
            common = int(2000 * share)
            a, b = values[:2000], np.concatenate([values[2000 - common:2000],
                                                  values[2000:2000 + 2000 - common]])
            b = b[:2000]
            truth = len(set(a) & set(b)) / len(set(a) | set(b))
            n = np.array([2000.0])
            got = neardup.estimate(neardup.registers(a)[None], neardup.registers(b)[None], n, n)
            assert abs(got[0] - truth) < 0.16


def test_components_of_edges(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)]
    edges = [(min(e), max(e)) for e in edges if e[0] != e[1]] + [(1000 + i, 1001 + i)
                                                               for i in range(40)]
    got = {r.node: r.label for r in neardup.components(
        spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x
    for a, b in edges:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    assert len({(find(n), got[n]) for n in got}) == len({find(n) for n in got}) == len(
        set(got.values()))
    assert set(got) == {x for e in edges for x in e}


def test_one_of_each_group_stays(spark):
    data = corpus(3) + [(None, "null id", None, None, 1, *EXTRA)] * 2
    frame = spark.createDataFrame(data, SCHEMA)
    kept = neardup.drop_near_duplicates(frame)
    assert kept.columns == frame.columns
    want = Counter({k[0]: n for k, n in brute(data, 5).items() if k[3] and k[0] is not None})
    got = Counter(r.doc_id for r in kept.collect())
    assert got.pop(None) == 2
    assert got == want


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert neardup.near_duplicates(empty).collect() == []
    assert neardup.drop_near_duplicates(empty).collect() == []


def test_an_id_on_several_texts_loses_no_group(spark):
    """Rows leave by id and text together; one row of each group stays."""
    rng = random.Random(8)
    a, b = sentence(rng, 80), sentence(rng, 80)
    texts = [(1, a), (5, edited(rng, a, 1)), (5, b), (9, edited(rng, b, 1))]
    frame = spark.createDataFrame([(i, t, "en", "s", 1, *EXTRA) for i, t in texts], SCHEMA)
    got = sorted((r.doc_id, r.text) for r in neardup.drop_near_duplicates(frame).collect())
    assert got == [(1, a), (5, b)]
    again = texts + [(1, edited(rng, a, 1)), (1, a), (1, a.upper())]
    frame = spark.createDataFrame([(i, t, "en", "s", 1, *EXTRA) for i, t in again], SCHEMA)
    got = [r.doc_id for r in neardup.drop_near_duplicates(frame).collect()]
    assert sorted(got) == [1, 5]
