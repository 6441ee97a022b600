"""Language identification by interpolated Kneser-Ney character models.

One model of order 4 per language, fitted on a bounded sample of labelled documents. The
character n-grams of all languages lie in one sorted array of 64-bit codes per order, with one
log-probability per language beside each; a position is one binary search, and only n-grams
that no language has seen go on to shorter ones. The language of least cross-entropy per
character wins. A second labelled sample gives the temperature of the score and, per language,
the cross-entropy beyond which a prediction is marked as not accepted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoview.llm.common import byte_slices
from chronoview.session import staged

ORDER = 4
# Labelled documents used per language: for the model, and for score and rejection.
FIT_DOCS, CHECK_DOCS = 2000, 500
ACCEPTED = 0.995
BATCH_BYTES = 1 << 20
SPACE, PAD, ASTRAL = 0x20, 1, 0xFFFF
UNKNOWN = "und"


def _character_classes() -> np.ndarray:
    """For each 16-bit code: its small letter, or a space for anything that is no letter."""
    table = np.full(1 << 16, SPACE, np.uint16)
    for code in range(1 << 16):
        if chr(code).isalpha():
            small = chr(code).lower()
            table[code] = ord(small) if len(small) == 1 else code
    return table


_CLASSES: list[np.ndarray] = []


def codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Character codes of all texts, each after three pads, and where each begins (n + 1).

    Runs of characters that are no letters become one space.
    """
    if not _CLASSES:
        _CLASSES.append(_character_classes())
    pad = chr(PAD) * (ORDER - 1)
    raw = np.frombuffer((pad + pad.join(texts)).encode("utf-32-le"), np.uint32)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + ORDER - 1
    begins = np.concatenate([[0], np.cumsum(lengths)])
    known = _CLASSES[0][np.minimum(raw, ASTRAL)]
    high = np.flatnonzero(raw > ASTRAL)
    if len(high):
        points, place = np.unique(raw[high], return_inverse=True)
        letters = np.array([chr(p).isalpha() for p in points])
        known[high] = np.where(letters[place], ASTRAL, SPACE)
    pads = np.add.outer(begins[:-1], np.arange(ORDER - 1)).ravel()
    known[pads] = PAD
    keep = np.ones(len(known), bool)
    keep[1:] = (known[1:] != SPACE) | (known[:-1] != SPACE)
    return known[keep], np.concatenate([[0], np.cumsum(keep)])[begins]


def grams(known: np.ndarray) -> np.ndarray:
    """64-bit code of the four characters that end at each position from the fourth on."""
    wide = known.astype(np.uint64)
    return (wide[:-3] << np.uint64(48)) | (wide[1:-2] << np.uint64(32)) | (
        wide[2:-1] << np.uint64(16)) | wide[3:]


def gram_counts(sample: DataFrame) -> DataFrame:
    """lang, gram, n over a sample of (lang, text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in byte_slices(batches, "text", BATCH_BYTES):
            langs = np.array(part.column("lang").to_pylist(), object)
            texts = np.array(part.column("text").to_pylist(), object)
            for lang in sorted(set(langs)):
                known, begins = codes(list(texts[langs == lang]))
                all_grams = grams(known)
                ends = all_grams[known[ORDER - 1:] != PAD]
                found, n = np.unique(ends, return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(found), pa.string()), pa.array(found.view(np.int64)),
                     pa.array(n.astype(np.int64))], names=["lang", "gram", "n"])

    counted = sample.mapInArrow(run, "lang string, gram long, n long")
    return counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class Layer:
    """One order: sorted n-grams and contexts of all languages, with one column each."""

    def __init__(self, keys: np.ndarray, contexts: np.ndarray, log_p: np.ndarray,
                 log_back: np.ndarray):
        self.keys, self.contexts = keys, contexts
        self.log_p, self.log_back = log_p, log_back

    @staticmethod
    def find(sorted_keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(sorted_keys, wanted), max(0, len(sorted_keys) - 1))
        return at, sorted_keys[at] == wanted if len(sorted_keys) else np.zeros(len(wanted), bool)


class Models:
    """Interpolated Kneser-Ney models of several languages over one set of sorted arrays."""

    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray]]):
        """``counts``: per language its distinct codes of order 4 and their counts."""
        self.langs = sorted(counts)
        per_order = [self._continuations(*counts[lang]) for lang in self.langs]
        letters = np.unique(np.concatenate([orders[1][0] for orders in per_order]))
        self.log_uniform = -np.log(len(letters) + 1.0)
        self.layers: list[Layer] = []
        for k in range(1, ORDER + 1):
            self.layers.append(self._layer(k, [orders[k] for orders in per_order]))

    @staticmethod
    def _continuations(keys: np.ndarray, counts: np.ndarray) -> dict[int, tuple]:
        """Counts of order 4; below, the number of distinct characters before an n-gram."""
        orders = {ORDER: (keys, counts.astype(float))}
        for k in range(ORDER - 1, 0, -1):
            keys, n = np.unique(keys & np.uint64((1 << 16 * k) - 1), return_counts=True)
            orders[k] = keys, n.astype(float)
        return orders

    def _below(self, k: int, keys: np.ndarray) -> np.ndarray:
        """Log-probabilities by order k - 1 of n-grams of order k, every language."""
        if k == 1:
            return np.full((len(keys), len(self.langs)), self.log_uniform)
        return self.log_probability(keys & np.uint64((1 << 16 * (k - 1)) - 1), k - 1)

    def _layer(self, k: int, counted: list[tuple]) -> Layer:
        keys = np.unique(np.concatenate([c[0] for c in counted]))
        contexts = np.unique(keys >> np.uint64(16))
        own = np.searchsorted(contexts, keys >> np.uint64(16))
        lower = np.exp(self._below(k, keys))
        p, back = np.empty((len(keys), len(counted))), np.ones((len(contexts), len(counted)))
        for column, (mine, n) in enumerate(counted):
            at = np.searchsorted(keys, mine)
            ones, twos = (n == 1).sum(), (n == 2).sum()
            discount = ones / (ones + 2.0 * twos) if ones and twos else 0.5
            total = np.bincount(own[at], n, len(contexts))
            kinds = np.bincount(own[at], minlength=len(contexts))
            seen = total > 0
            back[seen, column] = discount * kinds[seen] / total[seen]
            p[:, column] = back[own, column] * lower[:, column]
            p[at, column] += (n - discount) / total[own[at]]
        return Layer(keys, contexts, np.log(p).astype(np.float32),
                     np.log(np.maximum(back, 1e-30)).astype(np.float32))

    def log_probability(self, wanted: np.ndarray, k: int = ORDER) -> np.ndarray:
        """(positions, languages): log P(last character | those before), order k."""
        layer = self.layers[k - 1]
        at, hit = Layer.find(layer.keys, wanted)
        rows = layer.log_p[at]
        miss = np.flatnonzero(~hit)
        if len(miss):
            unseen = wanted[miss]
            below = self._below(k, unseen).astype(np.float32)
            context, known = Layer.find(layer.contexts, unseen >> np.uint64(16))
            below[known] += layer.log_back[context[known]]
            rows[miss] = below
        return rows

    def cross_entropies(self, texts: list[str]) -> np.ndarray:
        """(texts, languages): nats per character; NaN for a text without characters."""
        known, begins = codes(texts)
        result = np.full((len(texts), len(self.langs)), np.nan)
        lengths = np.diff(begins) - (ORDER - 1)
        filled = np.flatnonzero(lengths > 0)
        if not len(filled):
            return result
        # In stretches, so that one very long text stays bounded.
        sums = np.zeros((len(texts), len(self.langs)))
        all_grams = grams(known)
        owner = np.repeat(np.arange(len(texts)), np.diff(begins))[ORDER - 1:]
        wanted = known[ORDER - 1:] != PAD
        for start in range(0, len(all_grams), 1 << 19):
            part = slice(start, start + (1 << 19))
            take = wanted[part]
            mine = owner[part][take]
            if not len(mine):
                continue
            rows = self.log_probability(all_grams[part][take])
            firsts = np.flatnonzero(np.diff(mine, prepend=-1))
            sums[mine[firsts]] += np.add.reduceat(rows, firsts, axis=0, dtype=np.float64)
        result[filled] = -sums[filled] / lengths[filled, None]
        return result


def has_letter(text: str) -> bool:
    """Whether a character is a letter; numbers such as fractions or superscripts are none."""
    return any(map(str.isalpha, text))


def held_out(doc_id: Column, parts: int, part: int = 2) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % parts == part, F.lit(False))


def labelled_sample(docs: DataFrame) -> DataFrame:
    """lang, text, for_fit: a bounded number of labelled documents per language, by hash."""
    usable = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() &
                        ~held_out(F.col("doc_id"), 4))
    # Stored, so that its size is known and the texts need not move to meet it.
    sizes = staged(usable.groupBy("lang").agg(F.count("*").alias("_have")), "language-sizes")
    fit = F.least(F.lit(float(FIT_DOCS)), F.col("_have") * 0.8)
    draw = F.pmod(F.xxhash64("doc_id", F.lit("language")), F.lit(1 << 30)) / float(
        1 << 30) * F.col("_have")
    return (usable.select("doc_id", "lang", "text").join(sizes, "lang")
            .where(draw < FIT_DOCS + CHECK_DOCS)
            .select("lang", F.coalesce("text", F.lit("")).alias("text"),
                    (draw < fit).alias("for_fit")))


def fit(docs: DataFrame) -> tuple[Models | None, float, np.ndarray]:
    """Models, temperature and the accepted cross-entropy per language."""
    sample = labelled_sample(docs)
    # The sample bounds the model: no n-gram of it is left out.
    counted = gram_counts(sample.where("for_fit").select("lang", "text")).toArrow()
    langs = np.array(counted.column("lang").to_pylist(), object)
    keys = counted.column("gram").to_numpy().view(np.uint64)
    n = counted.column("n").to_numpy()
    counts = {}
    for lang in sorted(set(langs)):
        mine = langs == lang
        order = np.argsort(keys[mine])
        counts[lang] = keys[mine][order], n[mine][order]
    if not counts:
        return None, 1.0, np.zeros(0)
    models = Models(counts)
    shared = docs.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in byte_slices(batches, "text", BATCH_BYTES):
            entropies = shared.value.cross_entropies(part.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [part.column("lang"), pa.array(list(entropies), pa.list_(pa.float64()))],
                names=["lang", "entropies"])

    checked = sample.where("NOT for_fit").select("lang", "text").mapInArrow(
        run, "lang string, entropies array<double>").collect()
    known = {lang: i for i, lang in enumerate(models.langs)}
    rows = [(known[r.lang], r.entropies) for r in checked
            if r.lang in known and not np.isnan(r.entropies[0])]
    limits = np.full(len(models.langs), np.inf)
    if not rows:
        return models, 1.0, limits
    truth = np.array([r[0] for r in rows])
    entropies = np.array([r[1] for r in rows])
    for i in range(len(limits)):
        own = entropies[(truth == i) & (entropies.argmin(axis=1) == i), i]
        if len(own):
            limits[i] = np.quantile(own, ACCEPTED)

    def loss(temperature: float) -> float:
        scaled = -entropies * temperature
        top = scaled.max(axis=1, keepdims=True)
        return float(np.mean(np.log(np.exp(scaled - top).sum(axis=1)) + top[:, 0] -
                             scaled[np.arange(len(truth)), truth]))
    grid = 2.0 ** np.arange(-2, 9)
    return models, float(min(grid, key=loss)), limits


def identify(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score, accepted.

    A null text, or one without a letter, is ``und`` with score 0 and not accepted; so is
    everything if no labelled document exists. A null doc_id is never held out nor learned
    from. Ties go to the language first in order. Repeated rows are predicted alike, an empty
    table gives no rows, other columns are ignored.
    """
    models, temperature, limits = fit(docs)
    shared = docs.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in byte_slices(batches, "text", BATCH_BYTES):
            texts = pc.fill_null(part.column("text"), "").to_pylist()
            n = len(texts)
            langs, scores, accepted = [UNKNOWN] * n, np.zeros(n), np.zeros(n, bool)
            if shared.value is not None:
                entropies = shared.value.cross_entropies(texts)
                known = np.flatnonzero(np.array([has_letter(x) for x in texts], bool) &
                                       ~np.isnan(entropies[:, 0]))
                best = entropies[known].argmin(axis=1)
                scaled = -entropies[known] * temperature
                weights = np.exp(scaled - scaled.max(axis=1, keepdims=True))
                scores[known] = weights.max(axis=1) / weights.sum(axis=1)
                accepted[known] = entropies[known, best] <= limits[best]
                for row, i in zip(known, best):
                    langs[row] = shared.value.langs[i]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id").cast(pa.int64()), part.column("held_out"),
                 pa.array(langs, pa.string()), pa.array(scores), pa.array(accepted)],
                names=["doc_id", "held_out", "lang_pred", "score", "accepted"])

    return docs.select("doc_id", held_out(F.col("doc_id"), 4).alias("held_out"), "text").mapInArrow(
        run, "doc_id long, held_out boolean, lang_pred string, score double, accepted boolean")
