import math
import random
from collections import Counter
from itertools import takewhile

import pytest
from corpus import EXTRA, SCHEMA, awkward, sentence
from pyspark.sql import functions as F

from chronoview.llm import quality

GAPS = " \t\n\x0b\f\r"


def split_words(text):
    for c in GAPS[1:]:
        text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


def brute(text):
    text = text or ""
    words = split_words(text)
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    times = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if split_words(x)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text),
            len(lines) - len(set(lines)), len(covered))


def labels_of(spark, pairs):
    return spark.createDataFrame(pairs, "doc_id long, quality int, toxic int")


def test_counts_equal_brute_force(spark):
    rng = random.Random(4)
    data = awkward() + [(1000 + i, " ".join(rng.choice("abc") for _ in range(rng.randint(0, 40))),
                         "en", "s", 0, *EXTRA) for i in range(60)]
    got = quality.quality_report(spark.createDataFrame(data, SCHEMA),
                                 labels_of(spark, [])).collect()
    want = Counter()
    for row in data:
        n, *rest = counts = brute(row[1])
        failed = n < 50 or 100 * counts[4] > 50 * n
        want[(row[0], *counts, failed, not failed, row[2])] += 1
    assert Counter(map(tuple, got)) == want


def test_binomial_tail_is_exact(spark):
    cases = [(0, 10, .1), (3, 10, .2), (12, 400, .05), (400, 20000, .02), (5, 5, .3),
             (0, 5, .004), (3900, 1_000_000, .004), (4000, 1_000_000, .004)]
    for k, n, rate in cases:
        got = spark.range(1).select(quality.binomial_tail(
            F.lit(k).cast("long"), F.lit(n).cast("long"), rate)).first()[0]
        want = sum(math.exp(math.lgamma(n + 1) - math.lgamma(j + 1) - math.lgamma(n - j + 1) +
                            j * math.log(rate) + (n - j) * math.log1p(-rate))
                   for j in range(k + 1))
        assert got == pytest.approx(want, rel=1e-6)


def corpus_with_labels(n=3000):
    rng = random.Random(9)
    data, labels = [], []
    for i in range(n):
        bad = i % 5 == 0
        words = sentence(rng, 60).split()
        if bad:
            words = [w + "###" for w in words]
        data.append((i, " ".join(words), "en", "s", 0, *EXTRA))
        labels.append((i, 0 if bad else 1, 0))
    return data, labels


def test_bad_documents_go_and_good_ones_stay(spark):
    data, labels = corpus_with_labels()
    frame = spark.createDataFrame(data, SCHEMA)
    verdict = {r.doc_id: r.kept for r in quality.quality_report(
        frame, labels_of(spark, labels)).collect()}
    good = [verdict[i] for i, q, _ in labels if q]
    assert sum(not v for v in good) <= quality.RISK * len(good)
    assert not any(verdict[i] for i, q, _ in labels if not q)
    kept = quality.keep_good(frame, labels_of(spark, labels))
    assert kept.columns == frame.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, v in verdict.items() if v)


def test_few_labels_prove_nothing(spark):
    data, labels = corpus_with_labels(200)
    verdict = quality.quality_report(spark.createDataFrame(data, SCHEMA),
                                     labels_of(spark, labels)).collect()
    assert all(r.kept for r in verdict)


def test_cutoffs_satisfy_the_exact_bound(spark):
    data, labels = corpus_with_labels()
    counted = quality.measured(spark.createDataFrame(data, SCHEMA))
    row = quality.fit_cutoffs(counted, labels_of(spark, labels)).first()
    good = {i for i, q, _ in labels if q}
    tests = len(quality.GRID)
    per_rule = quality.RISK / len(quality.GRID)
    values = counted.select("doc_id", *(v.alias(k) for k, v in quality.features().items())).collect()
    for rule in quality.GRID:
        cutoff = row[f"_{rule}"]
        held = [r[rule] for r in values if r.doc_id in good]

        def tail(candidate):
            n, k = len(held), sum(v > candidate for v in held)
            return sum(math.comb(n, j) * per_rule ** j * (1 - per_rule) ** (n - j)
                       for j in range(k + 1))
        safe = list(takewhile(lambda c: tail(c) <= quality.DELTA / tests, quality.GRID[rule]))
        assert cutoff == (safe[-1] if safe else None)


def test_null_and_contradicting_labels(spark):
    data = awkward()
    labels = [(0, 1, 0), (0, 0, 0), (None, 1, 0), (1, None, None), (999, 1, 1)]
    frame = spark.createDataFrame(data, SCHEMA)
    assert quality.quality_report(frame, labels_of(spark, labels)).count() == len(data)
    empty = spark.createDataFrame([], SCHEMA)
    assert quality.quality_report(empty, labels_of(spark, labels)).collect() == []
    assert quality.keep_good(empty, labels_of(spark, [])).collect() == []


def test_very_long_texts(spark):
    text = ("w " * 30000) + " ".join(f"x{i}" for i in range(60000))
    got = quality.quality_report(spark.createDataFrame([(1, text, "en", "s", 0, *EXTRA)], SCHEMA),
                                 labels_of(spark, [])).first()
    assert (got.n_words, got.n_repeat_words) == (90000, 30000)


def test_every_label_counts(spark):
    """Beyond any former bound of labelled rows: a late bad one still turns a cutoff down."""
    n = 30_000
    counted = spark.range(n).select(
        F.col("id").alias("doc_id"), F.lit("en").alias("lang"), F.lit(100).alias("n_words"),
        F.lit(500).alias("word_chars"), F.when(F.col("id") % 200 == 0, 60).otherwise(0).alias(
            "n_symbols"), F.lit(0).alias("n_dup_lines"), F.lit(0).alias("n_repeat_words"),
        F.lit(0).alias("n_capitals"), F.lit(10).alias("n_lines"))
    labels = counted.select("doc_id", F.lit(1).alias("quality"))
    few = labels.where("doc_id % 200 <> 0 OR doc_id < 400")
    row = quality.fit_cutoffs(counted, labels).first()
    assert row["_symbols"] == 0.75  # 150 of 30,000 good ones beyond 0.5 are too many
    assert quality.fit_cutoffs(counted, few).first()["_symbols"] == 0.05
