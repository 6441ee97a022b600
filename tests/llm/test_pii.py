import hashlib
import random
import re
from collections import Counter

import pytest
from corpus import EXTRA, SCHEMA, awkward, rows, sentence
from pyspark.sql import functions as F

from chronoview.llm import pii

# The patterns as the contract states them.
STATED = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def valid(kind, match):
    digits = re.sub("[^0-9]", "", match)
    if kind == "ip":
        return all(int(x) <= 255 for x in match.split("."))
    if kind == "card":
        values = [int(c) * (1 + i % 2) for i, c in enumerate(digits[::-1])]
        return 12 <= len(digits) <= 19 and sum(v - 9 * (v > 9) for v in values) % 10 == 0
    return kind != "phone" or 9 <= len(digits) <= 15


def brute(text):
    spans = [(m.start(), n, m.end()) for n, kind in enumerate(STATED)
             for m in re.finditer(STATED[kind], text or "") if valid(kind, m[0])]
    joined = ",".join(f"{pii.KINDS[n]}:{a}:{b}" for a, n, b in sorted(spans))
    return (*(sum(s[1] == n for s in spans) for n in range(4)), joined)


def check(spark, data):
    got = pii.personal_data(spark.createDataFrame(data, SCHEMA)).collect()
    want = Counter()
    for row in data:
        *counts, joined = brute(row[1])
        want[(row[0], *counts, hashlib.sha256(joined.encode()).hexdigest())] += 1
    assert Counter(tuple(r)[:6] for r in got) == want
    return got


def test_base_equals_the_stated_patterns(spark):
    rng = random.Random(6)
    bits = ["a", "Z9", "@", ".", "-", "_", "x@y.zz", "+1", " ", " ", "(212)", "555", "1.2.3.4",
            "256.1.1.1", "4111 1111 1111 1111", "4111111111111112", "é", "\U0001F600", "\n", "%",
            "001.02.3.255", "12", "+49 30 1234567", "7", "..", "@@"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 25))) for _ in range(700)]
    texts += ["a@b.c_d@e.f", "1.2.3.4.5.6.7.8.9", "abc@x@y.z", "a@b.com-x@c.de", "٣@x.y"]
    check(spark, rows(texts) + awkward()[40:])


def test_many_matches_and_long_runs(spark):
    texts = ["10.0.0.1 " * 3000, "1" * 50000, "a" * 50000 + "@b.c", "+" + "1 " * 20000,
             "a@b." + "c." * 20000 + "d", "4111 1111 1111 1111, " * 600]
    check(spark, rows(texts))


def test_contexts_reveal_unseen_identifiers(spark):
    rng = random.Random(8)
    texts = []
    for i in range(60):
        texts.append(f"{sentence(rng, 10)} my phone +1 212 555 {1000 + i} {sentence(rng, 5)}")
    hidden = [f"{sentence(rng, 8)} my phone 0301234{i:03d}, {sentence(rng, 6)}" for i in range(3)]
    clean = [f"{sentence(rng, 8)} in the year 20240{i} {sentence(rng, 3)}" for i in range(10)]
    data = rows(texts + hidden + clean)
    got = {r.doc_id: r for r in check(spark, data)}
    for i in range(60, 63):
        start = data[i][1].index("0301234")
        assert got[i].spans == f"phone:{start}:{start + 10}" and got[i].n_found == 1
    assert not any(r.n_found for i, r in got.items() if i not in (60, 61, 62))


def test_mixed_contexts_are_not_trusted(spark):
    rng = random.Random(9)
    seeds = ["a@b.com", "10.1.2.3", "4111 1111 1111 1111", "+1 212 555 1234"]
    texts = [f"{sentence(rng, 5)} the {seeds[i % 4]} {sentence(rng, 3)}" for i in range(80)]
    texts += [f"the 1234567{i}" for i in range(5)]
    assert not any(r.n_found for r in check(spark, rows(texts)))


@pytest.mark.parametrize("n", [1, 2, 255, 256, 257, 1000])
def test_running_sums(spark, n):
    values = [random.Random(n).randint(0, 9) for _ in range(n)]
    got = spark.createDataFrame([(values,)], "v array<int>").select(
        pii.running(F.col("v"))).first()[0]
    assert got == [sum(values[:i]) for i in range(n)]


def test_empty_table(spark):
    assert pii.personal_data(spark.createDataFrame([], SCHEMA)).collect() == []
    assert pii.personal_data(spark.createDataFrame(
        [(1, None, None, None, None, *EXTRA)], SCHEMA)).first().n_found == 0
