import random
import zlib

import numpy as np
import pytest
from corpus import EXTRA, SCHEMA, awkward, rows, sentence

from chronoview.llm import langid

LETTERS = {"aa": "abcdeo", "bb": "stuvxo", "cc": "жзийко"}


def labelled(n=240, seed=0):
    rng = random.Random(seed)
    data = []
    for i in range(n):
        lang = sorted(LETTERS)[i % 3]
        text = " ".join("".join(rng.choice(LETTERS[lang]) for _ in range(rng.randint(2, 7)))
                        for _ in range(rng.randint(3, 60)))
        data.append((i, text, lang, "s", len(text), *EXTRA))
    return data


def test_held_out_languages_are_found(spark):
    data = labelled()
    got = {r.doc_id: r for r in langid.identify(spark.createDataFrame(data, SCHEMA)).collect()}
    for row in data:
        held = zlib.crc32(str(row[0]).encode()) % 4 == 2
        assert got[row[0]].held_out == held and 0 <= got[row[0]].score <= 1
    wrong = [r for r in data if got[r[0]].lang_pred != r[2]]
    assert len(wrong) <= 0.02 * len(data)
    assert np.mean([got[r[0]].accepted for r in data]) > 0.9


def test_labels_of_held_out_rows_are_not_learned(spark):
    data = labelled()
    changed = [(*r[:2], "cc" if zlib.crc32(str(r[0]).encode()) % 4 == 2 else r[2], *r[3:])
               for r in data]
    one, two = (sorted(map(tuple, langid.identify(spark.createDataFrame(d, SCHEMA)).collect()))
                for d in (data, changed))
    assert one == two


def test_awkward_rows(spark):
    data = awkward()
    got = langid.identify(spark.createDataFrame(data, SCHEMA)).collect()
    assert len(got) == len(data)
    texts = {}
    for row in data:
        texts.setdefault(row[0], set()).add(row[1])
    for row in got:
        blank = all(not any(c.isalpha() for c in t or "") for t in texts[row.doc_id])
        if row.doc_id is not None:
            assert (row.lang_pred == "und") == blank
        assert row.lang_pred in ("und", "en", "fr")


def test_nothing_to_learn_from(spark):
    data = [(*r[:2], None, *r[3:]) for r in labelled(6)]
    got = langid.identify(spark.createDataFrame(data, SCHEMA)).collect()
    assert {(r.lang_pred, r.score) for r in got} == {("und", 0.0)}
    assert langid.identify(spark.createDataFrame([], SCHEMA)).collect() == []


def counted(texts):
    known, _ = langid.codes(texts)
    ends = langid.grams(known)[known[langid.ORDER - 1:] != langid.PAD]
    return np.unique(ends, return_counts=True)


def test_probabilities_sum_to_one():
    models = langid.Models({"a": counted(["banana bandana", "anab"]), "b": counted(["xyz banx"])})
    alphabet = models.layers[0].keys
    for context in ("ban", "xyz", "qqq", "nan"):
        head = np.uint64(0)
        for c in context:
            head = (head << np.uint64(16)) | np.uint64(ord(c))
        codes = (head << np.uint64(16)) | alphabet
        unseen = (head << np.uint64(16)) | np.uint64(ord("~"))
        total = np.exp(models.log_probability(np.append(codes, unseen))).sum(axis=0)
        assert total == pytest.approx([1.0, 1.0], abs=1e-4)


def test_kneser_ney_against_the_definition():
    texts = ["abab abba", "bab"]
    models = langid.Models({"x": counted(texts)})
    chars = ["\x01\x01\x01" + t for t in texts]
    order4 = {}
    for t in chars:
        for i in range(3, len(t)):
            order4[t[i - 3:i + 1]] = order4.get(t[i - 3:i + 1], 0) + 1
    counts = {4: order4}
    for k in (3, 2, 1):
        counts[k] = {}
        for g in counts[k + 1]:
            counts[k][g[1:]] = counts[k].get(g[1:], 0) + 1
    size = len(counts[1]) + 1

    def p(gram):
        k = len(gram)
        if not k:
            return 1 / size
        mine = {g: n for g, n in counts[k].items() if g[:-1] == gram[:-1]}
        if not mine:
            return p(gram[1:])
        ones = sum(n == 1 for n in counts[k].values())
        twos = sum(n == 2 for n in counts[k].values())
        discount = ones / (ones + 2 * twos) if ones and twos else 0.5
        total = sum(mine.values())
        own = max(mine.get(gram, 0) - discount, 0)
        return own / total + discount * len(mine) / total * p(gram[1:])

    for text in ("abba", "bbbb", "a b", "zab"):
        t = "\x01\x01\x01" + text
        want = -np.mean([np.log(p(t[i - 3:i + 1])) for i in range(3, len(t))])
        assert models.cross_entropies([text])[0, 0] == pytest.approx(want, rel=1e-4)


def test_texts_in_one_batch_do_not_touch():
    models = langid.Models({"x": counted(["abc abd", "bcd"])})
    texts = ["abc", "", "d", "!!", "ab" * 50]
    together = models.cross_entropies(texts)
    apart = np.vstack([models.cross_entropies([t]) for t in texts])
    np.testing.assert_allclose(together, apart, rtol=1e-6)


def test_numbers_are_no_letters(spark):
    """Fractions, superscripts and numerals of other kinds alone give und."""
    data = rows([sentence(random.Random(i), 30) for i in range(40)], langs=("en",))
    odd = ["\u00bd\u00b2", "\u2167", "\u2460 \u2461", "12 ½", "\u0663", "_", "e", "\u00e9", "\u4e2d"]
    data += [(100 + i, t, *data[0][2:]) for i, t in enumerate(odd)]
    got = {r.doc_id: r for r in langid.identify(spark.createDataFrame(data, SCHEMA)).collect()}
    for i, text in enumerate(odd):
        assert (got[100 + i].lang_pred == "und") == (not any(map(str.isalpha, text))), text
        assert got[100 + i].lang_pred != "und" or got[100 + i].score == 0
