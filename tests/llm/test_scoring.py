import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from corpus import SCHEMA, awkward, rows, sentence

from chronoview.llm import scoring
from chronoview.llm.words import lower_bytes

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DEEP = scoring.CONTEXT


def symbols(text):
    return [scoring.PAD] * DEEP + list((text or "").translate(LOWER).encode()) + [scoring.END]


class Naive:
    """Prediction by partial matching as told, one symbol after the other."""

    def __init__(self, texts):
        counts = {DEEP: Counter()}
        for text in texts:
            s = symbols(text)
            counts[DEEP].update(tuple(s[i - DEEP:i + 1]) for i in range(DEEP, len(s)))
        for k in range(DEEP - 1, -1, -1):
            counts[k] = Counter(g[1:] for g in counts[k + 1])
        self.seen = {k: defaultdict(dict) for k in counts}
        for k, grams in counts.items():
            for gram, n in grams.items():
                self.seen[k][gram[:-1]][gram[-1]] = n

    def p(self, context, symbol):
        excluded, p = set(), 1.0
        for k in range(DEEP, -1, -1):
            here = self.seen[k].get(tuple(context[DEEP - k:]))
            if here is None:
                continue
            left = {s: n for s, n in here.items() if s not in excluded}
            total = sum(left.values()) + len(left)
            if symbol in left:
                return p * left[symbol] / total
            if left:
                p *= len(left) / total
            excluded |= set(here)
        return p / (scoring.SYMBOLS - len(excluded))

    def score(self, text):
        s = symbols(text)
        return sum(math.log10(self.p(s[i - DEEP:i], s[i])) for i in range(DEEP, len(s)))


def trie(texts):
    data, bounds = lower_bytes(pa.array(texts, pa.string()))
    keys, n = np.unique(scoring.windows(scoring.framed(data, bounds)[0])[0], return_counts=True)
    layers = [(keys, n)]
    for k in range(DEEP, 0, -1):
        keys, n = np.unique(keys & scoring.CODE((1 << 8 * k) - 1), return_counts=True)
        layers.append((keys, n))
    return scoring.Trie(layers[::-1])


def score(model, text):
    data, bounds = lower_bytes(pa.array([text], pa.string()))
    codes = scoring.windows(scoring.framed(data, bounds)[0])[0]
    return model.log_probability(codes).sum() / math.log(10)


def test_trie_equals_the_naive_model():
    rng = random.Random(1)
    train = [sentence(rng, rng.randint(0, 12), "abc") for _ in range(20)] + ["Hello World", "é"]
    model, naive = trie(train), Naive(train)
    for text in ("abc a", "hello abz", "", "zzz", "é", "worl q a b c", None):
        assert score(model, text) == pytest.approx(naive.score(text), rel=1e-5)


def test_probabilities_sum_to_one():
    naive = Naive(["abab abba", "bab"])
    for context in ("ab" * DEEP, "zz" * DEEP, "ba" * DEEP):
        history = list(context[-DEEP:].encode())
        total = sum(naive.p(history, s) for s in range(scoring.SYMBOLS))
        assert total == pytest.approx(1.0)


def brute(data):
    def tokens(text):
        return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER)) + [None]
    train = [r for r in data if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 != 2]
    counts = Counter(t for r in train for t in tokens(r[1]))
    n, v = sum(counts.values()), len(counts)
    naive = Naive([r[1] for r in train])
    for row in data:
        mine = tokens(row[1])
        held = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 2
        yield (row[0], held, len(mine), sum(counts[t] > 0 for t in mine), n,
               sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in mine), naive.score(row[1]))


@pytest.mark.parametrize("hot", [1 << 20, 20])
def test_scores_equal_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(scoring, "HOT_WORDS", hot)
    data = [r for r in awkward(n=25) if r[1] is None or len(r[1]) < 3000]
    got = scoring.language_model_scores(spark.createDataFrame(data, SCHEMA)).collect()
    want = sorted(brute(data), key=str)
    assert len(got) == len(want)
    for mine, theirs in zip(sorted(map(tuple, got), key=str), want):
        assert mine[:5] == theirs[:5]
        assert mine[5:] == pytest.approx(theirs[5:], rel=1e-5)


@pytest.mark.parametrize("bound", [0, 40, 300])
def test_no_bound_changes_the_scores(spark, monkeypatch, bound):
    monkeypatch.setattr(scoring, "TRIE", bound)
    rng = random.Random(5)
    data = rows([sentence(rng, rng.randint(0, 30), "abé中") for _ in range(40)])
    got = scoring.language_model_scores(spark.createDataFrame(data, SCHEMA)).collect()
    want = {r[0]: r[-1] for r in brute(data)}
    assert {r.doc_id: r.score for r in got} == pytest.approx(want, rel=1e-9)


def test_looked_up_probabilities_sum_to_one(spark, monkeypatch):
    monkeypatch.setattr(scoring, "LOOKUP_ROWS", 50)
    rng = random.Random(6)
    train = [(i, sentence(rng, 12, "abé")) for i in range(15)]
    grams = scoring.corpus_counts(spark.createDataFrame(train, "doc_id long, text string")).where(
        f"kind = {scoring.GRAM_ROWS}").select("key", "n")
    seen = sorted({r.key >> 8 for r in grams.collect()})
    contexts = rng.sample(seen, 12) + [c ^ 0x010000000000 >> 8 for c in rng.sample(seen, 4)] + [
        int.from_bytes(b"zz" * 3, "big") >> 8]
    # All bytes; 0xFF is the end of a text, and PAD, never seen, stands for the byte 0xFF too.
    wanted = spark.createDataFrame([(c << 8 | s,) for c in set(contexts) for s in range(256)],
                                   "key long")
    sums = defaultdict(float)
    for r in scoring.code_costs(grams, wanted, scoring.short_levels(grams)).collect():
        sums[r.key >> 8] += math.exp(r.log_p) * (1 + (r.key & 0xFF == scoring.PAD))
    assert set(sums) == set(contexts)
    assert list(sums.values()) == pytest.approx([1.0] * len(sums))


def test_tally_hands_on_what_it_cannot_hold(monkeypatch):
    monkeypatch.setattr(scoring, "KEPT_KEYS", 10)
    tally, seen = scoring.Tally(0), Counter()
    rng, want = np.random.default_rng(0), Counter()
    for _ in range(20):
        keys = rng.integers(0, 40, 30).astype(np.uint64)
        want.update(keys.tolist())
        tally.add(keys)
        if tally.pending > 10:
            for batch in tally.rows():
                seen.update(dict(zip(batch.column("key").to_pylist(),
                                     batch.column("n").to_pylist())))
    for batch in tally.rows():
        seen.update(dict(zip(batch.column("key").to_pylist(), batch.column("n").to_pylist())))
    assert seen == want


def test_held_out_likeness(spark):
    rng = random.Random(2)
    data = rows([sentence(rng, 60, "ab") for _ in range(150)] + [sentence(rng, 60, "yz")])
    got = {r.doc_id: r.score / r.n_tokens for r in scoring.language_model_scores(
        spark.createDataFrame(data, SCHEMA)).collect()}
    assert got[150] < min(v for k, v in got.items() if k != 150)


def test_empty_table(spark):
    assert scoring.language_model_scores(spark.createDataFrame([], SCHEMA)).collect() == []
