import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from corpus import EXTRA, SCHEMA, awkward, rows, sentence

from chronoview.llm import exact


@pytest.mark.parametrize("bits", [64, 40, 8])
@pytest.mark.parametrize("n", [0, 1, 2, 50, 200])
def test_golomb_code_round_trip(n, bits):
    rng = np.random.default_rng(n + bits)
    span = 1 << bits
    values = np.unique(rng.integers(0, span - 1, n, dtype=np.uint64, endpoint=True))
    code = exact.golomb_encode(values, span)
    assert list(exact.golomb_decode(code, len(values))) == list(values)
    if len(values) > 40 and bits > 8:
        assert len(code) * 8 < len(values) * (bits - np.log2(len(values)) + 3) + 16


def expected(data):
    groups = defaultdict(list)
    for row in data:
        groups[row[1] or ""].append(row[0])
    want = Counter()
    for row in data:
        ids = groups[row[1] or ""]
        known = [i for i in ids if i is not None]
        keep = max(known) if known else None
        want[(row[0], keep, len(ids), hashlib.sha256((row[1] or "").encode()).hexdigest())] += 1
    return want, groups


def check(spark, data, partitions=6):
    frame = spark.createDataFrame(data, SCHEMA).repartition(partitions)
    got = exact.exact_duplicates(frame).collect()
    want, groups = expected(data)
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    assert sum(r.kept for r in got) == len(groups)
    assert all(r.doc_id == r.keep_id for r in got if r.kept)
    return frame


def test_awkward_rows(spark):
    check(spark, awkward())


def test_one_hot_group(spark):
    rng = random.Random(3)
    check(spark, rows([sentence(rng, 5) if i % 3 else "the same text" for i in range(3000)]))


def test_equal_hashes_are_verified_by_bytes(spark, monkeypatch):
    from pyspark.sql import functions as F
    monkeypatch.setattr(exact, "fingerprint", lambda text: F.length(text).cast("long"))
    check(spark, rows([f"text {i % 7:03d}" for i in range(60)] + ["text 9999"]))


def test_several_blocks_per_partition(spark, monkeypatch):
    monkeypatch.setattr(exact, "BLOCK_ROWS", 16)
    data = rows([f"t{i % 150}" for i in range(300)])
    want, _ = expected(data)
    # Block bounds are fixed on the driver's side of the pickled function.
    frame = spark.createDataFrame(data, SCHEMA)
    got = exact.exact_duplicates(frame).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want


def test_whole_rows_stay(spark):
    data = awkward() + [(5, "same", None, "a", 1, *EXTRA), (5, "same", "en", "b", 2, *EXTRA),
                        (4, "same", "fr", None, 3, *EXTRA)]
    frame = spark.createDataFrame(data, SCHEMA)
    kept = exact.drop_exact_duplicates(frame)
    assert kept.columns == frame.columns
    got = [tuple(r) for r in kept.collect()]
    _, groups = expected(data)
    assert Counter(r[1] or "" for r in got) == Counter(dict.fromkeys(groups, 1))
    originals = Counter(map(tuple, data))
    for row in got:
        known = [i for i in groups[row[1] or ""] if i is not None]
        assert originals[row] and row[0] == (max(known) if known else None)


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert exact.exact_duplicates(empty).collect() == []
    assert exact.drop_exact_duplicates(empty).collect() == []
