import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from corpus import SCHEMA, awkward
from tokenizers import Tokenizer

from chronoview.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def unpack(plan):
    bins, seen = defaultdict(list), Counter()
    for length, first, n, start, offset in plan.runs:
        assert first == seen[length]
        seen[length] += n
        for i in range(n):
            bins[start + i].append((offset, length))
    return bins, seen


def check_plan(histogram, capacity, groups):
    plan = packing.Plan(dict(histogram), capacity, groups)
    bins, seen = unpack(plan)
    assert +seen == +Counter(histogram)
    assert sorted(bins) == list(range(plan.bins))
    for pieces in bins.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity
    return plan.bins


@pytest.mark.parametrize("seed", range(40))
def test_plans_place_everything_once(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 50, 300])
    histogram = Counter(rng.randint(1, capacity) for _ in range(rng.randint(1, 300)))
    check_plan(histogram, capacity, rng.choice([1, 4, 32]))


def test_plans_are_near_the_bound():
    rng = random.Random(5)
    for lengths in ([rng.randint(1, 2048) for _ in range(20000)],
                    [min(2048, int(rng.lognormvariate(6.3, 1)) + 1) for _ in range(20000)]):
        used = check_plan(Counter(lengths), 2048, packing.GROUPS)
        assert used <= 1.02 * sum(lengths) / 2048 + 2


def test_plan_size_depends_on_the_capacity_alone():
    histogram = Counter(random.Random(6).randint(1, 64) for _ in range(3000))
    one = len(packing.Plan(dict(histogram), 64, 8).runs)
    many = len(packing.Plan({k: n * 10**6 for k, n in histogram.items()}, 64, 8).runs)
    assert many < 4 * one


def test_groups_have_equal_cardinality():
    grouped = packing.Plan.group(Counter(range(1, 101)), 10)
    assert [sum(n for _, n in runs) for _, runs in grouped] == [10] * 10
    assert all(max(length for length, _ in runs) == size for size, runs in grouped)


def test_ids_equal_the_library():
    model, mine = Tokenizer.from_file(PATH), packing.WordEncoder(PATH)
    rng = random.Random(2)
    bits = list("aAbBzé'’sStT.,;:!?*#$%&()\"-—…<>|≠ ̱̌H 數字٣3४ ÷×ÀßŒ\n\t") + [
        "'s", "'LL", "<|endoftext|>", "<|ENDOFTEXT|>", "ǰ", "Ω", "K", "한", "각", "ﬁ", "ª", "²"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    ids, bounds = mine.encode(pa.array(texts))
    for k, text in enumerate(texts):
        assert list(ids[bounds[k]:bounds[k + 1]]) == model.encode(
            text, add_special_tokens=False).ids, text


@pytest.mark.parametrize("guarded", [False, True])
def test_letters_that_the_tokenizer_parts(monkeypatch, guarded):
    if guarded:  # without the look at each word, the count of units has to notice
        monkeypatch.setattr(packing, "stays_letters", str.isalpha)
    model, mine = Tokenizer.from_file(PATH), packing.WordEncoder(PATH)
    words = ["\u0130stanbul", "hello", "world", "\u0939\u0958", "plain", "\ufb2a\u05d0",
             "words", "after", "\u0130", "\u0130. end"]
    for text in [" ".join(words), *words, " ".join(words[::-1])]:
        ids, _ = mine.encode(pa.array([text]))
        assert ids.tolist() == model.encode(text, add_special_tokens=False).ids, text


def pieces_of(text, model, capacity):
    ids = np.array(model.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
    return [(k // capacity, k, len(ids[k:k + capacity]),
             zlib.crc32(ids[k:k + capacity].tobytes())) for k in range(0, len(ids), capacity)]


@pytest.mark.parametrize("batch_bytes", [packing.BATCH_BYTES, 200])
def test_pack_is_complete_and_gapless(spark, monkeypatch, batch_bytes):
    monkeypatch.setattr(packing, "BATCH_BYTES", batch_bytes)
    data = awkward()
    got = packing.pack(spark.createDataFrame(data, SCHEMA), PATH, capacity=64, groups=8).collect()
    model = Tokenizer.from_file(PATH)
    want = Counter((row[0], *piece) for row in data for piece in pieces_of(row[1], model, 64))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 64
    assert len(bins) <= 1.1 * sum(r.length for r in got) / 64 + 2


def test_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], SCHEMA), PATH).collect() == []
