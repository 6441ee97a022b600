"""Small corpora with the awkward cases every operator must bear."""

from __future__ import annotations

import random

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, size long, "
          "target double, kept boolean, label long, _maybe string, hash string, length int")
EXTRA = (7, 1.5, True, 3, "x", "y", 4)


def sentence(rng: random.Random, words: int, letters: str = "abcdefgh") -> str:
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 6)))
                    for _ in range(words))


def rows(texts, sources=("a", "b", "c"), langs=("en", "fr")):
    """Rows of SCHEMA; ids from 0 on."""
    return [(i, t, langs[i % len(langs)], sources[i % len(sources)],
             None if t is None else len(t), *EXTRA) for i, t in enumerate(texts)]


def awkward(seed: int = 0, n: int = 40):
    """Null, empty and white texts, ties, copies, a long text, a null id, a repeated row."""
    rng = random.Random(seed)
    texts = [sentence(rng, rng.randint(1, 120)) for _ in range(n)]
    texts += [None, "", " \t\n ", "one", texts[0], texts[0], texts[1] + " ",
              "Ünïcode ЖЖ 日本 \U0001F600 x" * 3, sentence(rng, 6000), "a\nb\na\nb\n" * 30]
    found = rows(texts)
    found.append(found[3])
    found.append((None, texts[2], None, None, 1, *EXTRA))
    found.append((None, None, None, None, None, *EXTRA))
    return found
