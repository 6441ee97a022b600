import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from corpus import SCHEMA, awkward, rows, sentence

from chronoview.llm import golomb, suffixes


def expected(data):
    bodies = [(r[0], (r[1] or "").encode()) for r in data]
    first = {}
    for doc_id, body in bodies:
        if doc_id is not None:
            for i in range(len(body) - 49):
                own = body[i:i + 50]
                first[own] = min(first.get(own, doc_id), doc_id)
    want = Counter()
    for doc_id, body in bodies:
        gone = bytearray(len(body))
        if doc_id is not None:
            for i in range(len(body) - 49):
                if first[body[i:i + 50]] < doc_id:
                    gone[i:i + 50] = b"\1" * 50
        kept = bytes(b for b, g in zip(body, gone) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        want[(doc_id, len(body), sum(gone), spans, hashlib.sha256(kept).hexdigest())] += 1
    return want


def check(spark, data, partitions=6):
    frame = spark.createDataFrame(data, SCHEMA).repartition(partitions)
    got = suffixes.repeated_passages(frame).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert Counter(tuple(r) for r in got.collect()) == expected(data)


def test_awkward_rows(spark):
    check(spark, awkward())


def planted(seed, sizes, n=80):
    """Texts that share passages of given sizes at any offset, in any order of ids."""
    rng = random.Random(seed)
    shared = [bytes(rng.choice(b"abcdefgh ") for _ in range(s)).decode() for s in sizes]
    texts = []
    for _ in range(n):
        text = ""
        for _ in range(rng.randint(0, 4)):
            text += sentence(rng, rng.randint(0, 12)) + rng.choice([*shared, "", " "])
        texts.append(text)
    rng.shuffle(texts)
    return rows(texts)


@pytest.mark.parametrize("seed", range(3))
def test_planted_passages(spark, seed):
    check(spark, planted(seed, (29, 30, 49, 50, 51, 52, 60, 69, 70, 71, 72, 73, 90, 93, 200)))


def test_overlapping_and_periodic_texts(spark):
    check(spark, rows(["ab" * 60, "a" * 49, "a" * 50, "a" * 51, "ba" * 200, "x" + "a" * 120,
                       "Ж" * 60, "Ж" * 30, "日本" * 40, "y" * 500 + "Ж" * 26, "a" * 3000]))


def test_one_group_holds_a_third(spark):
    rng = random.Random(9)
    same = sentence(rng, 60)
    check(spark, rows([same + str(i % 5) if i % 3 == 0 else sentence(rng, 20)
                       for i in range(300)]))


def test_equal_ids_and_rows(spark):
    rng = random.Random(4)
    a, b = sentence(rng, 40), sentence(rng, 40)
    data = rows([a, a, b, a + b, b])
    data += [data[1], data[3], (2, a, *data[2][2:]), (None, a, *data[2][2:])]
    check(spark, data)


def test_long_text_over_several_stretches(spark):
    rng = random.Random(6)
    words = [sentence(rng, 1) for _ in range(500)]
    text = " ".join(rng.choice(words) for _ in range(260_000))
    assert len(text) > suffixes.STRETCH
    tail = text[suffixes.STRETCH - 300:suffixes.STRETCH + 300]
    frame = spark.createDataFrame(rows([tail, text, "q" + tail[100:200]]), SCHEMA)
    got = {r.doc_id: r for r in suffixes.repeated_passages(frame).collect()}
    assert got[0].n_removed == 0
    kept = text.replace(tail, "")
    assert (got[1].n_removed, got[1].n_spans) == (600, 1)
    assert got[1].kept_sha256 == hashlib.sha256(kept.encode()).hexdigest()
    assert (got[2].n_removed, got[2].n_spans) == (100, 1)


def test_empty_table(spark):
    assert suffixes.repeated_passages(spark.createDataFrame([], SCHEMA)).collect() == []


def test_cover_takes_any_two_places_to_sampled_ones():
    for a in range(suffixes.PERIOD):
        for b in range(suffixes.PERIOD):
            assert any((a + d) % suffixes.PERIOD in suffixes.COVER and
                       (b + d) % suffixes.PERIOD in suffixes.COVER
                       for d in range(suffixes.PERIOD))


def test_texts_are_read_without_a_shuffle(spark):
    frame = spark.createDataFrame(rows(["a" * 60, "b" * 70]), SCHEMA)
    texts = suffixes.in_blocks(frame, 8)
    answers = spark.createDataFrame([], suffixes.ANSWERS)
    plan = suffixes.passes(texts, answers, None, suffixes.RESULT)._jdf.queryExecution() \
        .executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Bucketed: true" in plan


@pytest.mark.parametrize("bits", [64, 40, 8])
@pytest.mark.parametrize("n", [0, 1, 2, 50, 200])
def test_golomb_code_round_trip(n, bits):
    rng = np.random.default_rng(n + bits)
    values = np.sort(rng.integers(0, (1 << bits) - 1, n, dtype=np.uint64, endpoint=True))
    assert golomb.decode(golomb.encode(values, 1 << bits), n).tolist() == values.tolist()


def test_chance_of_a_shared_name_is_bounded():
    for size in (0, 10**6, 10**9, 10**14):
        plan = suffixes.Plan(size)
        assert 64 + 8 * plan.more >= 2 * np.log2(max(2, size)) + 20 or size < 10**6


@pytest.mark.parametrize("seed", range(4))
def test_names_are_told_apart_by_both_halves(seed):
    rng = np.random.default_rng(seed)
    value, more = (rng.integers(0, 4, 60).astype(np.uint64) for _ in range(2))
    docs = rng.integers(0, 9, 60)
    names = suffixes.Names(value, docs, more)
    for i in range(60):
        same = docs[(value == value[i]) & (more == more[i])]
        group = names.group[i]
        assert (names.value[group], names.more[group]) == (value[i], more[i])
        assert (names.least[group], names.most[group]) == (same.min(), same.max())
    assert len(names.value) == len({*zip(value.tolist(), more.tolist())})
