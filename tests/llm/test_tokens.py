import random

import pyarrow as pa
import public_tokenizers
import pytest
from corpus import SCHEMA, awkward
from sentencepiece import SentencePieceProcessor

from chronoview.llm import tokens

PATH = public_tokenizers.path("piece_bpe_32k.model")
ODD = [" a", "a ", "  ", "", None, " ", "a  b", " \n x  \t y ", "▁a ▁ b", "<s> x </s>",
       "x" * 3000 + "  " + "y" * 10, "　 a", "\U0001F600 ab   "]


def test_counts_equal_the_library(spark):
    data = awkward()
    got = tokens.token_counts(spark.createDataFrame(data, SCHEMA), PATH, 100).collect()
    model = SentencePieceProcessor(model_file=PATH)
    want = []
    for row in data:
        n = len(model.encode(row[1] or ""))
        want.append((row[0], len((row[1] or "").encode()), n, n > 100))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_odd_spaces(spark):
    model = SentencePieceProcessor(model_file=PATH)
    got = tokens.PieceCounter(PATH).count(pa.array(ODD))
    assert list(got) == [len(model.encode(t or "")) for t in ODD]


@pytest.mark.parametrize("lead", ["", " ", "   "])
def test_long_texts_are_cut_safely(monkeypatch, lead):
    monkeypatch.setattr(tokens, "BATCH_BYTES", 40)
    model = SentencePieceProcessor(model_file=PATH)
    text = lead + "some words  with   runs of spaces \n and lines " * 20
    assert tokens.PieceCounter(PATH).count(pa.array([text]))[0] == len(model.encode(text))


def test_memory_is_bounded(monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED", 3)
    counter = tokens.PieceCounter(PATH)
    for word in ("abc def ghi", "jkl mno", "pqr abc"):
        counter.count(pa.array([word]))
    assert len(counter.known) <= 5


def test_empty_table(spark):
    assert tokens.token_counts(spark.createDataFrame([], SCHEMA), PATH).collect() == []


def test_random_strings_with_the_space_mark(monkeypatch):
    """Literal U+2581 beside spaces, in batches and in long texts cut into parts."""
    rng = random.Random(5)
    model = SentencePieceProcessor(model_file=PATH)
    letters = [" ", "\u2581", "a", "5", "the", "\n", ".", "<unk>", "\u00e9", "\u4e2d", "  "]
    counter = tokens.PieceCounter(PATH)
    for _ in range(400):
        texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 12)))
                 for _ in range(3)]
        want = [len(model.encode(t)) for t in texts]
        assert counter.count(pa.array(texts)).tolist() == want, texts
    monkeypatch.setattr(tokens, "BATCH_BYTES", 20)
    for _ in range(400):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(30, 60)))
        assert counter.count(pa.array([text])).tolist() == [len(model.encode(text))], [text]
