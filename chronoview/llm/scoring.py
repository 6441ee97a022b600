"""Language-model scores: prediction by partial matching over bytes, and a unigram base.

The corpus model is a byte-context trie of five context bytes, trained from n-gram counts of
all training documents and stored as sorted arrays. The probability of a byte is looked for in
the longest context seen; failing that, the model escapes to the next shorter one (method C:
as many escapes as distinct bytes seen there), where the bytes of the longer context are
excluded, since they would have been coded before. Shorter contexts count a byte once per
longer context (update exclusion). Below all contexts every byte left is equally likely.

No n-gram is left out. The counts of all of them are a table; n-grams whose contexts end in the
same bytes meet in one task, which has all their longer contexts whole, and the shortest orders,
bounded by the number of byte strings, go to all tasks. The most frequent n-grams go to all tasks
with their final probabilities, from the totals of the full table; only a document's other
n-grams are shuffled to theirs.

The base needs the count of every word. Words are counted by hash for the whole corpus; the
most frequent ones, a bounded table, go to all tasks, and only occurrences of rarer words are
shuffled to their counts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from chronoview.llm.common import byte_slices
from chronoview.llm.langid import held_out
from chronoview.llm.words import lower_bytes, word_hashes, word_spans
from chronoview.session import staged

CONTEXT = 5
CODE = np.uint32 if CONTEXT < 4 else np.uint64
SYMBOLS = 257  # bytes and the end of a text
PAD, END = 0xFE, 0xFF  # no byte of UTF-8
FOLDS, HELD = 7, 2
# Bounds of what is sent to all tasks ahead of the joins: n-grams, and words.
TRIE, HOT_WORDS = 1 << 20, 1 << 20
# Contexts of fewer bytes go to all tasks whole: at most 256 ** SHARED n-grams, whatever the corpus.
SHARED = 3
LOOKUP_ROWS = 1 << 19
BATCH_BYTES = 1 << 20
KEPT_KEYS = 1 << 20
WORD_ROWS, GRAM_ROWS, TOTAL_ROWS = 0, 1, 2
TALLIES = "kind int, key long, n long"
SCORED = ("row long, doc_id long, held_out boolean, n_words long, hot_known long, "
          "hot_sum double, score double, rare array<long>, "
          "open array<struct<key:long,times:long>>")
COSTS = "key long, log_p double"


def framed(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts in a row, each after pads and before an end mark, and where each begins."""
    n = len(bounds) - 1
    extra = CONTEXT + 1
    begins = bounds + extra * np.arange(n + 1)
    framed_bytes = np.full(len(data) + extra * n, PAD, np.uint8)
    shift = np.repeat(np.arange(n) * extra + CONTEXT, np.diff(bounds))
    framed_bytes[np.arange(len(data)) + shift] = data
    framed_bytes[begins[1:] - 1] = END
    return framed_bytes, begins


def windows(framed_bytes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of context and symbol at every symbol, one byte each, and the symbols' places."""
    n = max(0, len(framed_bytes) - CONTEXT)
    codes = np.zeros(n, CODE)
    for k in range(CONTEXT + 1):
        codes <<= CODE(8)
        codes |= framed_bytes[k:k + n]
    real = framed_bytes[CONTEXT:] != PAD
    return codes[real], np.flatnonzero(real) + CONTEXT


class Tally:
    """Counts of 64-bit keys with bounded memory; full tallies are handed on as rows."""

    def __init__(self, kind: int):
        self.kind = kind
        self.keys: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.pending = 0

    def add(self, keys: np.ndarray) -> None:
        found, n = np.unique(keys, return_counts=True)
        self.keys.append(found)
        self.counts.append(n)
        self.pending += len(found)
        if self.pending > 2 * KEPT_KEYS:
            self.merge()

    def merge(self) -> None:
        if len(self.keys) > 1:
            keys, place = np.unique(np.concatenate(self.keys), return_inverse=True)
            counts = np.bincount(place, np.concatenate(self.counts), len(keys))
            self.keys, self.counts = [keys], [counts.astype(np.int64)]
            self.pending = len(keys)

    def rows(self) -> Iterator[pa.RecordBatch]:
        self.merge()
        for keys, counts in zip(self.keys, self.counts):
            for a in range(0, len(keys), 1 << 16):
                part = keys[a:a + (1 << 16)].astype(np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(part), self.kind, np.int32)), pa.array(part),
                     pa.array(counts[a:a + (1 << 16)].astype(np.int64))],
                    names=["kind", "key", "n"])
        self.keys, self.counts, self.pending = [], [], 0


def corpus_counts(train: DataFrame) -> DataFrame:
    """Counts over all training documents: words by hash, byte n-grams, documents and words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, grams = Tally(WORD_ROWS), Tally(GRAM_ROWS)
        docs = tokens = 0
        with np.errstate(over="ignore"):
            for part in byte_slices(batches, "text", BATCH_BYTES):
                data, bounds = lower_bytes(part.column("text"))
                starts, ends, _ = word_spans(data, bounds)
                words.add(word_hashes(data, starts, ends))
                grams.add(windows(framed(data, bounds)[0])[0])
                docs, tokens = docs + part.num_rows, tokens + len(starts)
                for tally in (words, grams):
                    if tally.pending > KEPT_KEYS:
                        tally.merge()
                    if tally.pending > KEPT_KEYS:
                        yield from tally.rows()
        yield from words.rows()
        yield from grams.rows()
        yield pa.RecordBatch.from_arrays(
            [pa.array([TOTAL_ROWS] * 2, pa.int32()), pa.array([0, 1]),
             pa.array([docs, tokens])], names=["kind", "key", "n"])

    counted = train.select("text").mapInArrow(run, TALLIES)
    return counted.groupBy("kind", "key").agg(F.sum("n").alias("n"))


def most_frequent(counts: DataFrame, bound: int) -> DataFrame:
    """Keys of the counts from the least count on that at most ``bound`` keys reach."""
    top = 1 << 16
    sizes = counts.groupBy(F.least("n", F.lit(top)).alias("_level")).agg(
        F.count("*").alias("_keys"))
    reached = sizes.withColumn("_above", F.sum("_keys").over(W.orderBy(F.desc("_level"))))
    level = reached.where(F.col("_above") <= bound).agg(F.min("_level")).first()[0]
    if level is None:
        return counts.limit(0)
    return counts.where(F.col("n") >= level)


def arrays(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    table = counts.select("key", "n").toArrow()
    keys = table.column("key").to_numpy().view(np.uint64)
    order = np.argsort(keys)
    return keys[order], table.column("n").to_numpy()[order]


def find(sorted_keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(sorted_keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(sorted_keys, wanted), len(sorted_keys) - 1)
    return at, sorted_keys[at] == wanted


class Level:
    """All contexts of one length: what they have seen, and what an escape into them costs."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, shorter: Level | None):
        self.keys = keys.astype(CODE)
        self.log_count = np.log(counts.astype(float))
        owners = self.keys >> CODE(8)
        self.contexts, first = np.unique(owners, return_index=True)
        total = np.add.reduceat(counts.astype(float), first) if len(keys) else np.zeros(0)
        kinds = np.diff(np.append(first, len(keys))).astype(float)
        self.total, self.kinds = total, kinds
        self.log_all = np.log(total + kinds)
        self.log_escape = np.log(kinds) - self.log_all
        if shorter is None:
            # Below no context: the symbols that no text has.
            left = np.maximum(SYMBOLS - kinds, 1.0)
            self.below_log_all, self.below_log_escape = np.log(left), np.zeros(len(left))
            return
        # Escaping from here into the next shorter context leaves out the symbols seen here.
        depth_mask = CODE(shorter.mask)
        at, _ = find(shorter.keys, self.keys & depth_mask)
        there, _ = find(shorter.contexts, (self.contexts << CODE(8) & depth_mask)
                        >> CODE(8))
        excluded = np.add.reduceat(np.exp(shorter.log_count[at]), first) if len(
            keys) else np.zeros(0)
        total_left = np.maximum(np.round(shorter.total[there] - excluded), 0.0)
        kinds_left = shorter.kinds[there] - kinds
        everything = np.maximum(total_left + kinds_left, 1.0)
        self.below_log_all = np.log(everything)
        self.below_log_escape = np.where(
            kinds_left > 0, np.log(np.maximum(kinds_left, 1.0)) - self.below_log_all, 0.0)

    mask = 0


class Trie:
    """Symbol probabilities of the trained model."""

    def __init__(self, layers: list[tuple[np.ndarray, np.ndarray]],
                 base: list[Level] | None = None):
        """``layers[k]``: codes of k context bytes and a symbol, and their counts; ``base`` has
        the levels below the first layer, if any are built already."""
        self.levels: list[Level] = list(base or [])
        for k, (keys, counts) in enumerate(layers, len(self.levels)):
            level = Level(keys, counts, self.levels[-1] if self.levels else None)
            level.mask = (1 << 8 * (k + 1)) - 1
            self.levels.append(level)
        top = self.levels[-1]
        own = np.searchsorted(top.contexts, top.keys >> CODE(8))
        self.log_p = top.log_count - top.log_all[own]

    def log_probability(self, codes: np.ndarray) -> np.ndarray:
        """Natural log-probability of every symbol given the bytes before it."""
        top = self.levels[-1]
        at, hit = find(top.keys, codes)
        result = np.where(hit, self.log_p[at] if len(self.log_p) else 0.0, 0.0).astype(float)
        rows = np.flatnonzero(~hit)
        left = codes[rows]
        spent = np.zeros(len(rows))
        # The longer context that was escaped from, if any was known, per open symbol.
        above = np.full(len(rows), -1)
        for k in range(CONTEXT, -1, -1):
            level = self.levels[k]
            mask = CODE(level.mask)
            if k < CONTEXT:
                longer = self.levels[k + 1]
                at, hit = find(level.keys, left & mask)
                context, _ = find(level.contexts, (left & mask) >> CODE(8))
                whole = np.where(above >= 0, longer.below_log_all[above] if len(
                    longer.below_log_all) else 0.0, level.log_all[context] if len(
                        level.log_all) else 0.0)
                done = np.flatnonzero(hit)
                result[rows[done]] = spent[done] + level.log_count[at[done]] - whole[done]
                open_ones = np.flatnonzero(~hit)
                rows, left = rows[open_ones], left[open_ones]
                spent, above = spent[open_ones], above[open_ones]
            if not len(rows):
                return result
            context, known = find(level.contexts, (left & mask) >> CODE(8))
            fresh = above < 0
            if k < CONTEXT and len(longer.below_log_escape):
                spent = spent + np.where(fresh, 0.0, longer.below_log_escape[above])
            if len(level.log_escape):
                spent = spent + np.where(fresh & known, level.log_escape[context], 0.0)
            above = np.where(known, context, -1)
        lowest = self.levels[0]
        left_over = lowest.below_log_all[0] if len(lowest.below_log_all) else math.log(SYMBOLS)
        result[rows] = spent - left_over
        return result


def shortened(keys: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes of k context bytes and a symbol, and how many longer ones each has."""
    return np.unique(keys & CODE((1 << 8 * (k + 1)) - 1), return_counts=True)


def short_levels(grams: DataFrame) -> list[Level]:
    """The levels of fewer than ``SHARED`` context bytes, from all n-grams."""
    def ending(k: int) -> Column:
        return F.col("key").bitwiseAND(F.lit((1 << 8 * (k + 1)) - 1).cast("long")).alias("key")

    longer = grams.select(ending(SHARED)).distinct()
    layers = [arrays(longer.groupBy(ending(SHARED - 1)).agg(F.count("*").alias("n")))]
    for k in range(SHARED - 2, -1, -1):
        layers.append(shortened(layers[-1][0], k))
    return Trie(layers[::-1]).levels


def frequent_costs(grams: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent n-grams and their log-probabilities, by the totals of all n-grams."""
    context = F.shiftright("key", 8).alias("_context")
    contexts = grams.groupBy(context).agg(
        (F.sum("n") + F.count("*")).alias("_all"))
    frequent = most_frequent(grams, TRIE).select("key", "n", context)
    return arrays(frequent.join(contexts, "_context").select(
        "key", (F.log("n") - F.log("_all")).alias("n")))


def looked_up(keys: np.ndarray, n: np.ndarray, base: list[Level]) -> pa.RecordBatch:
    """Log-probabilities of the keys without a count, by the others, which are all n-grams
    with the same ends of contexts."""
    seen = n > 0
    order = np.argsort(keys[seen])
    layers = [(keys[seen][order], n[seen][order])]
    for k in range(CONTEXT - 1, SHARED - 1, -1):
        layers.append(shortened(layers[-1][0], k))
    wanted = keys[~seen]
    return pa.RecordBatch.from_arrays(
        [pa.array(wanted.view(np.int64)),
         pa.array(Trie(layers[::-1], base).log_probability(wanted))], names=["key", "log_p"])


def code_costs(grams: DataFrame, wanted: DataFrame, base: list[Level]) -> DataFrame:
    """key, log_p: natural log-probability of each wanted code; ``grams`` are all counts.

    Both are dealt out by the last bytes of the context, so every context that is not in
    ``base`` is whole in one task, which works through them in stretches.
    """
    shared = grams.sparkSession.sparkContext.broadcast(base)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = shared.value
        held: list[tuple[np.ndarray, ...]] = []
        fresh = 0
        for batch in batches:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64),
                         batch.column(2).to_numpy()))
            fresh += batch.num_rows
            if fresh >= LOOKUP_ROWS:
                ends, keys, n = map(np.concatenate, zip(*held))
                whole = np.searchsorted(ends, ends[-1])
                if whole:
                    yield looked_up(keys[:whole], n[:whole], base)
                held, fresh = [(ends[whole:], keys[whole:], n[whole:])], 0
        if held:
            _, keys, n = map(np.concatenate, zip(*held))
            yield looked_up(keys, n, base)

    end = F.shiftright("key", 8).bitwiseAND(F.lit((1 << 8 * SHARED) - 1).cast("long"))
    met = grams.select(end.alias("end"), "key", "n").unionByName(
        wanted.select(end.alias("end"), "key", F.lit(0).cast("long").alias("n")))
    return met.repartition("end").sortWithinPartitions("end").mapInArrow(run, COSTS)


def repeats(owner: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Rows of owner, code and how often it has it, by owner."""
    codes = codes.astype(np.int64)
    order = np.lexsort((codes, owner))
    owner, codes = owner[order], codes[order]
    first = np.flatnonzero(np.append(True, (np.diff(owner) != 0) | (np.diff(codes) != 0))[
        :len(codes)])
    return np.stack([owner[first], codes[first], np.diff(np.append(first, len(codes)))])


def scored(docs: DataFrame, frequent: tuple[np.ndarray, np.ndarray],
           hot: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """Per document the model's and the base's sums over frequent n-grams and words, and its
    rarer ones."""
    shared = docs.sparkSession.sparkContext.broadcast(
        (*frequent, hot[0], np.log10(hot[1] + 1.0)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram_keys, gram_logs, hot_keys, hot_logs = shared.value
        row = TaskContext.get().partitionId() << 40
        with np.errstate(over="ignore"):
            for part in byte_slices(batches, "text", BATCH_BYTES):
                n = part.num_rows
                data, bounds = lower_bytes(part.column("text"))
                starts, ends, first = word_spans(data, bounds)
                hashes = word_hashes(data, starts, ends)
                at, hit = find(hot_keys, hashes)
                logs = np.where(hit, hot_logs[at] if len(hot_logs) else 0.0, 0.0)
                sums = np.concatenate([[0.0], np.cumsum(logs)])
                hits = np.concatenate([[0], np.cumsum(hit)])
                rare = hashes[~hit].view(np.int64)
                codes, places = windows(framed(data, bounds)[0])
                begins = bounds + (CONTEXT + 1) * np.arange(n + 1)
                scores = np.zeros(n)
                open_ones = [np.zeros((3, 0), np.int64)]
                # In stretches, so that one very long text stays bounded.
                for a in range(0, len(codes), 1 << 20):
                    some = codes[a:a + (1 << 20)]
                    owner = np.searchsorted(begins, places[a:a + (1 << 20)], "right") - 1
                    at, hit = find(gram_keys, some)
                    scores += np.bincount(owner[hit], gram_logs[at[hit]], n)
                    open_ones.append(repeats(owner[~hit], some[~hit]))
                owner, grams, times = np.concatenate(open_ones, axis=1)
                opened = np.searchsorted(owner, np.arange(n + 1)).astype(np.int32)
                offsets = np.arange(len(first)) * 0 + first - hits[first]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(row, row + n)), part.column("doc_id").cast(pa.int64()),
                     part.column("held_out"), pa.array(np.diff(first).astype(np.int64)),
                     pa.array(np.diff(hits[first]).astype(np.int64)),
                     pa.array(np.diff(sums[first])), pa.array(scores / math.log(10)),
                     pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)),
                                              pa.array(rare)),
                     pa.ListArray.from_arrays(pa.array(opened), pa.StructArray.from_arrays(
                         [pa.array(grams), pa.array(times)], names=["key", "times"]))],
                    names=["row", "doc_id", "held_out", "n_words", "hot_known", "hot_sum",
                           "score", "rare", "open"])
                row += n

    return docs.select("doc_id", held_out(F.col("doc_id"), FOLDS, HELD).alias("held_out"),
                       "text").mapInArrow(run, SCORED)


def language_model_scores(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Both models learn from documents whose crc32(doc_id) mod 7 is not 2; a null id is neither
    held out nor learned from. A null or empty text is its end alone. Repeated rows are scored
    alike; an empty table gives no rows; other columns are ignored. Words are told apart by a
    64-bit hash.
    """
    train = docs.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), FOLDS, HELD))
    counts = staged(corpus_counts(train), "score-counts")
    totals = dict(counts.where(F.col("kind") == TOTAL_ROWS).select("key", "n").collect())
    n_docs, n_words = totals.get(0, 0), totals.get(1, 0)
    words = counts.where(F.col("kind") == WORD_ROWS).select("key", "n")
    distinct = words.count() + (1 if n_docs else 0)
    all_tokens = n_docs + n_words
    share = math.log10(all_tokens + distinct + 1)

    grams = counts.where(F.col("kind") == GRAM_ROWS).select("key", "n")
    rows = staged(scored(docs, frequent_costs(grams), arrays(most_frequent(words, HOT_WORDS))),
                  "score-rows")
    opened = rows.select("row", F.inline("open"))
    costs = code_costs(grams, opened.select("key").distinct(), short_levels(grams))
    far = opened.join(costs, "key").groupBy("row").agg(
        F.sum(F.col("times") * F.col("log_p")).alias("_far"))
    rare = rows.select("row", F.explode("rare").alias("key")).join(words, "key").groupBy(
        "row").agg(F.sum(F.log10(F.col("n") + 1)).alias("_sum"), F.count("*").alias("_known"))
    summed = rows.drop("rare", "open").join(rare, "row", "left").join(far, "row", "left")
    end_log, end_known = math.log10(n_docs + 1), 1 if n_docs else 0
    tokens = F.col("n_words") + 1
    return summed.select(
        "doc_id", "held_out", tokens.alias("n_tokens"),
        (F.col("hot_known") + F.coalesce("_known", F.lit(0)) + end_known).alias("n_known"),
        F.lit(all_tokens).cast("long").alias("train_tokens"),
        (F.col("hot_sum") + F.coalesce("_sum", F.lit(0.0)) + F.lit(end_log) -
         tokens * F.lit(share)).alias("base_score"),
        (F.col("score") + F.coalesce("_far", F.lit(0.0)) / math.log(10)).alias("score"))
