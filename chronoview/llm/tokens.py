"""Token counts: batched encoding inside Arrow functions that return lengths only.

A piece model of this kind never joins a space to the character before it, so a text may be
cut before any space that follows a character other than a space (or its mark, U+2581), and each part encoded alone. Parts are
words here: a word seen before costs one look-up, unseen words of a batch are encoded in one
call. Batches hold a bounded number of bytes; a longer text is worked off in parts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from chronoview.llm.common import byte_slices, cut_at_gaps

BATCH_BYTES = 4 << 20
REMEMBERED = 1 << 20
LIMIT = 4096
SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
# A literal U+2581 is the model's own mark of a space and may join one that follows it.
UNITS = re.compile("(?<=[^ \u2581]) ")
UNEVEN = "^ |  |\u2581 | $"


class PieceCounter:
    """Counts pieces of a sentencepiece model; equal to encoding every text whole."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor
        self.model = SentencePieceProcessor(model_file=path)
        self.known: dict[str, int] = {}
        self.lone_space = len(self.model.encode("a ")) - len(self.model.encode("a"))
        self.can_cut = self._cuts_are_safe()

    def _cuts_are_safe(self) -> bool:
        """No piece has a space mark after another character, and no space is dropped."""
        marks = re.compile("[^▁]▁")
        pieces = (self.model.id_to_piece(i) for i in range(self.model.get_piece_size()))
        return not any(marks.search(p) for p in pieces) and self.model.decode(
            self.model.encode("a  b ")) == "a  b "

    def unit_counts(self, units: list[str]) -> np.ndarray:
        """Pieces of each unit, every unit standing after a space or at the start."""
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        new = [u for u in units if u not in known]
        if new:
            known.update(zip(new, map(len, self.model.encode(new, num_threads=1))))
        return np.fromiter((known[u] for u in units), np.int64, len(units))

    def _spaced(self, text: str) -> int:
        """A text with runs of spaces, or a space at either end."""
        units = UNITS.split(text)
        lone = sum(1 for u in units if not u)
        return int(self.unit_counts([u for u in units if u]).sum()) + lone * self.lone_space

    def _long(self, text: str) -> int:
        total = 0
        for part in cut_at_gaps(text, BATCH_BYTES, before=" \u2581"):
            total += self._spaced(part) if part else self.lone_space
        return total

    def count(self, texts: pa.Array) -> np.ndarray:
        texts = pc.fill_null(texts, "")
        if not self.can_cut:
            return np.array([len(x) for x in self.model.encode(texts.to_pylist(),
                                                               num_threads=1)], np.int64)
        if len(texts) == 1 and len(texts[0].as_py()) > BATCH_BYTES:
            return np.array([self._long(texts[0].as_py())], np.int64)
        split = pc.split_pattern(texts, " ")
        flat = pc.dictionary_encode(split.flatten())
        words = flat.dictionary.to_numpy(zero_copy_only=False).tolist()
        per_word = self.unit_counts(words) if words else np.zeros(0, np.int64)
        codes = flat.indices.to_numpy()
        offsets = split.offsets.to_numpy() - split.offsets[0].as_py()
        sums = np.concatenate([[0], np.cumsum(per_word[codes])])
        counts = sums[offsets[1:]] - sums[offsets[:-1]]
        odd = pc.match_substring_regex(texts, UNEVEN).to_numpy(zero_copy_only=False)
        for row in np.flatnonzero(odd):
            counts[row] = self._spaced(texts[row].as_py())
        return counts


_COUNTERS: dict[str, PieceCounter] = {}


def counter(path: str) -> PieceCounter:
    if path not in _COUNTERS:
        _COUNTERS[path] = PieceCounter(path)
    return _COUNTERS[path]


def token_counts(docs: DataFrame, model_path: str, limit: int = LIMIT) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit.

    Null and empty texts have 0 bytes and 0 tokens. Repeated rows and null ids are counted
    like any other; an empty table gives no rows; other columns are ignored. A text above 4 MB
    is a batch of its own and is worked off in parts.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in byte_slices(batches, "text", BATCH_BYTES):
            texts = part.column("text")
            counts = counter(model_path).count(texts)
            yield pa.RecordBatch.from_arrays([
                part.column("doc_id").cast(pa.int64()),
                pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64()),
                pa.array(counts), pa.array(counts > limit)],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
