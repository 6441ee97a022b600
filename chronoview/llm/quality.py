"""Quality rules with risk-controlled cutoffs.

A rule rejects documents whose feature lies beyond a cutoff. Cutoffs come from labelled
documents: for every stratum (language), rule and candidate of a fixed grid, the number of
good documents beyond it is counted. A candidate is safe when the exact binomial
(Clopper-Pearson) upper bound of its false-rejection rate is at most the rule's share of the
allowed risk, i.e. when P(Bin(n, risk) <= k) <= delta / m, with m the number of strata times
rules (Bonferroni). Within a rule, candidates are tested in fixed order from mild to strict, up
to the first that fails, which needs no further correction. The last safe one becomes the
cutoff; a stratum with too few labels to prove anything has none and rejects nothing.

Everything is column expressions. Features are computed inside one row, so no word leaves it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from chronoview.llm.common import GAP, GAPS, let, packed, unpacked, whole, without
from chronoview.session import staged

SYMBOLS = "#*$%&|<>"
WINDOW = 3
MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50

RISK = 0.02
DELTA = 0.05

# Candidates of every rule, mild to strict; a document is beyond one when its feature is greater.
GRID = {
    "symbols": [4.0, 2.0, 1.5, 1.0, 0.75, 0.5, 0.35, 0.25, 0.15, 0.1, 0.05],
    "repeated": [0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15, 0.1, 0.05],
    "dup_lines": [0.8, 0.6, 0.5, 0.4, 0.3, 0.2, 0.1, 0.05],
    "long_words": [40.0, 30.0, 25.0, 20.0, 16.0, 14.0, 12.0, 10.0],
    "capitals": [0.95, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2],
}
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def words_of(text: Column) -> Column:
    trimmed = F.trim(text, F.lit(GAPS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(
        F.split(trimmed, f"{GAP}+"))


def duplicate_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    return let(F.filter(F.split(text, "\n"), lambda x: F.rtrim(x, F.lit(GAPS)) != ""),
               lambda lines: F.size(lines) - F.size(F.array_distinct(lines)))


def repeated_words(windows: Column) -> Column:
    """Words within windows that occur twice or more, from the hashes of all windows.

    Sorting (hash, place) puts equal windows side by side; the places that have an equal
    neighbour, in order, cover the next window's words or up to the next such place.
    """
    def covered(sorted_windows: Column) -> Column:
        last = F.size(sorted_windows) - 1

        def twice(x: Column, i: Column) -> Column:
            return ((i > 0) & (F.get(sorted_windows, i - 1)["h"] == x["h"])) | (
                (i < last) & (F.get(sorted_windows, i + 1)["h"] == x["h"]))
        places = F.array_sort(F.transform(F.filter(sorted_windows, twice), lambda x: x["at"]))
        return let(places, lambda p: F.coalesce(F.aggregate(
            p, F.struct(F.lit(-WINDOW).alias("at"), F.lit(0).alias("n")),
            lambda s, x: F.struct(x.alias("at"),
                                  (s["n"] + F.least(F.lit(WINDOW), x - s["at"])).alias("n")),
            lambda s: s["n"]), F.lit(0)))

    placed = F.sort_array(F.transform(windows, lambda h, i: F.struct(
        h.alias("h"), i.alias("at"))))
    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(
        let(placed, covered))


def counts_of(text: Column) -> Column:
    """All counts of a text in one struct, its words split and hashed once.

    The bindings keep the optimizer from copying the split into every use of a count.
    """
    def windows_of(words: Column) -> Column:
        return F.when(F.size(words) < WINDOW, F.array().cast("array<bigint>")).otherwise(
            F.transform(F.sequence(F.lit(0), F.size(words) - WINDOW), lambda i: F.xxhash64(
                *(F.get(words, i + k) for k in range(WINDOW)))))

    def removed(body: Column, characters: str) -> Column:
        return F.length(body) - F.length(without(body, characters))

    def counted(body: Column, words: Column, windows: Column) -> Column:
        counts = {
            "n_words": F.size(words),
            "word_chars": F.length(without(body, GAPS)),
            "n_symbols": removed(body, SYMBOLS),
            "n_dup_lines": duplicate_lines(body),
            "n_repeat_words": repeated_words(windows),
            "n_capitals": removed(body, CAPITALS),
            "n_lines": removed(body, "\n") + 1,
        }
        return F.struct(*(v.cast("long").alias(k) for k, v in counts.items()))

    return let(text, lambda body: let(words_of(body), lambda words: let(
        windows_of(words), lambda windows: counted(body, words, windows))))


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, lang and the counts of every document; null and empty texts have none."""
    return docs.select("doc_id", "lang", counts_of(whole()).alias("_counts")).select(
        "doc_id", "lang", "_counts.*")


def features(at=F.col) -> dict[str, Column]:
    """The rules' features from the counts; a text without words has none beyond a cutoff."""
    def share(a: str, b: str) -> Column:
        return F.coalesce(F.try_divide(at(a), at(b)), F.lit(0.0))
    return {"symbols": share("n_symbols", "n_words"),
            "repeated": share("n_repeat_words", "n_words"),
            "dup_lines": share("n_dup_lines", "n_lines"),
            "long_words": share("word_chars", "n_words"),
            "capitals": share("n_capitals", "word_chars")}


def base_failed(at=F.col) -> Column:
    return (at("n_words") < MIN_WORDS) | (
        at("n_repeat_words") * 100 > at("n_words") * MAX_REPEATED_PERCENT)


def log_factorial(x: Column) -> Column:
    """ln(x!) by Stirling's series after a shift of 16, to about 1e-13 of its size."""
    product = F.lit(1.0)
    for i in range(1, 17):
        product = product * (x + F.lit(float(i)))
    y = x + F.lit(17.0)  # ln(x!) = lnGamma(y) - ln((x + 1) ... (x + 16))
    series = 1 / (12 * y) - 1 / (360 * F.pow(y, F.lit(3))) + 1 / (1260 * F.pow(y, F.lit(5)))
    return (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + series - F.log(product)


def binomial_tail(k: Column, n: Column, rate: float) -> Column:
    """P(Bin(n, rate) <= k), summed from the term of k down until terms are below 1e-17 of it.

    So many terms count as nine deviations hold, beyond the mode if k is above it; a k that is
    nine deviations above the mean has a tail of 1.
    """
    mean, deviation = n * F.lit(rate), F.sqrt(n * F.lit(rate * (1 - rate)))
    term = (log_factorial(n.cast("double")) - log_factorial(k.cast("double"))
            - log_factorial((n - k).cast("double")) + k * F.lit(math.log(rate))
            + (n - k) * F.lit(math.log1p(-rate)))
    terms = F.least(k, F.ceil(9 * deviation + 60 + F.greatest(k - mean, F.lit(0.0))))
    back = F.lit((1 - rate) / rate)

    def add(state: Column, step: Column) -> Column:
        j = k - step + 1
        value = state["term"] * j / (n - j + 1) * back
        return F.struct(value.alias("term"), (state["sum"] + value).alias("sum"))

    one = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))
    steps = F.when(terms < 1, F.array().cast("array<bigint>")).otherwise(
        F.sequence(F.lit(1).cast("bigint"), terms.cast("bigint")))
    total = F.exp(term) * F.aggregate(steps, one, add, lambda s: s["sum"])
    return F.when(k > mean + 9 * deviation + 60, F.lit(1.0)).otherwise(
        F.least(total, F.lit(1.0)))


def fit_cutoffs(counted: DataFrame, labels: DataFrame, risk: float = RISK,
                delta: float = DELTA) -> DataFrame:
    """One row per stratum: _stratum and one cutoff column per rule (null: the rule is off).

    ``counted`` has doc_id, lang and the counts; ``labels`` doc_id and quality (1 is good). All
    labelled documents count. Contradicting labels of a document count as bad.
    """
    good = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
        F.min("quality").alias("_quality")).where("_quality = 1").select("doc_id")
    held = counted.where(~base_failed()).join(good, "doc_id", "left_semi").withColumnRenamed(
        "lang", "_stratum")
    beyond = [F.sum((value > candidate).cast("long")).alias(f"{rule}_{i}")
              for rule, value in features().items()
              for i, candidate in enumerate(GRID[rule])]
    counts = held.groupBy("_stratum").agg(F.count("*").alias("_n"), *beyond)
    tests = F.count("*").over(W.partitionBy()) * len(GRID)
    share = risk / len(GRID)
    leveled = counts.withColumn("_level", F.lit(delta) / tests)

    def safe(rule: str) -> Column:
        return F.array(*(binomial_tail(F.col(f"{rule}_{i}"), F.col("_n"), share) <= F.col("_level")
                         for i in range(len(GRID[rule])))).alias(f"_{rule}")

    def cutoff(rule: str) -> Column:
        grid = F.array(*map(F.lit, GRID[rule]))
        failed = F.array_position(f"_{rule}", False).cast("int")
        last = F.when(failed == 0, len(GRID[rule])).otherwise(failed - 1)
        return F.get(grid, last - 1).alias(f"_{rule}")

    flags = staged(leveled.select("_stratum", *map(safe, GRID)), "quality-tests")
    return staged(flags.select("_stratum", *map(cutoff, GRID)), "quality-cutoffs")


def rejected(at=F.col) -> Column:
    """Whether the base or a rule rejects; a missing cutoff rejects nothing."""
    verdict = base_failed(at)
    for rule, value in features(at).items():
        verdict = verdict | F.coalesce(value > F.col(f"_{rule}"), F.lit(False))
    return verdict


def with_cutoffs(docs: DataFrame, cutoffs: DataFrame) -> DataFrame:
    return docs.join(cutoffs, docs["lang"].eqNullSafe(cutoffs["_stratum"]), "left")


def quality_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, the five counts, base_failed, kept (and lang).

    Null text counts as empty and fails the base. Repeated rows are judged alike; documents
    with a null lang are a stratum of their own. Empty tables of documents give no rows, of
    labels no cutoffs. Other columns are ignored.
    """
    counted = staged(measured(docs), "quality-counted")
    return with_cutoffs(counted, fit_cutoffs(counted, labels)).select(
        "doc_id", *COUNTS, base_failed().alias("base_failed"), (~rejected()).alias("kept"),
        "lang")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents the rules keep, whole rows with all their columns."""
    cutoffs = fit_cutoffs(staged(measured(docs), "quality-counted"), labels)
    good = let(counts_of(whole()), lambda counts: ~rejected(lambda name: counts[name]))
    return unpacked(with_cutoffs(packed(docs, "text", "lang"), cutoffs).where(good))
