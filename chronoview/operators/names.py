"""Suspiciously similar names: an exact similarity join without comparing all pairs."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.DoubleType())
def matching_ratio(left: pd.Series, right: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp ratio 2M / (|a| + |b|), compared in lower case."""
    return pd.Series([SequenceMatcher(None, a.lower(), b.lower()).ratio()
                      for a, b in zip(left, right)], index=left.index, dtype="float64")


def _short_limit(threshold: float) -> int:
    """Longest name of a pair that may match without sharing a bigram."""
    longest_pair = int(1 / (1.5 * threshold - 1) + 1e-9)
    return int(longest_pair * (1 - threshold / 2) + 1e-9)


def _tokens(size, threshold: float):
    """Distinct bigrams of a lower-cased name; very short names also give their letters."""
    name = F.lower(F.col("name"))
    nothing = F.array().cast("array<string>")

    def pieces(length: int):
        starts = F.sequence(F.lit(1), size - (length - 1))
        return F.when(size >= length, F.transform(
            starts, lambda i: F.substr(name, i, F.lit(length)))).otherwise(nothing)

    letters = F.when(size <= _short_limit(threshold), pieces(1)).otherwise(nothing)
    return F.array_distinct(F.concat(pieces(2), letters))


def similar_names(support: DataFrame, threshold: float = 0.80) -> DataFrame:
    """Pairs of distinct names with ratio >= threshold, with supports, best first.

    Exact prefix filtering. Let n = |a| + |b|. At ratio >= t at most (1-t)n letters are
    unmatched, so at most (1-t)n + 1 blocks hold the matched ones, and of the bigrams of
    a name of length L at most L * (1 + (1 - 1.5t) / (1 - t/2)) can be foreign to its
    partner. Each name is therefore looked up under that many of its rarest bigrams plus
    one: the rarest bigram two similar names share is always among them. Pairs too short
    to be sure of a common bigram share a letter instead. Length prunes the candidates
    and only the survivors reach Python.
    """
    if not 2 / 3 < threshold <= 1:
        raise ValueError("the threshold must be above 2/3 and at most 1")
    size = F.length("name")
    names = support.select(F.col("family").alias("name"), "support")
    tokens = names.select("name", F.explode(_tokens(size, threshold)).alias("token"))
    frequency = tokens.groupBy("token").agg(F.count("*").alias("df"))
    ordered = tokens.join(frequency, "token").groupBy("name").agg(
        F.sort_array(F.collect_list(F.struct("df", "token"))).alias("ordered"))
    foreign = 1 + (1 - 1.5 * threshold) / (1 - threshold / 2)
    prefix = F.when(size <= _short_limit(threshold), F.size("ordered")).otherwise(
        F.least(F.size("ordered"), F.floor(size * F.lit(foreign) + 1e-9).cast("int") + 1))
    keys = ordered.select("name", F.explode(
        F.slice("ordered", F.lit(1), prefix)).alias("t")).select("name", "t.token")
    left = keys.select(F.col("name").alias("family_a"), "token")
    right = keys.select(F.col("name").alias("family_b"), "token")
    la, lb = F.length("family_a"), F.length("family_b")
    pairs = (left.join(right, "token").where(F.col("family_a") < F.col("family_b"))
             .where(F.lit(2.0) * F.least(la, lb) >= F.lit(threshold) * (la + lb) - 1e-9)
             .select("family_a", "family_b").distinct())
    scored = (pairs.withColumn("ratio", matching_ratio("family_a", "family_b"))
              .where(F.col("ratio") >= threshold))
    a = names.select(F.col("name").alias("family_a"), F.col("support").alias("support_a"))
    b = names.select(F.col("name").alias("family_b"), F.col("support").alias("support_b"))
    return (scored.join(a, "family_a").join(b, "family_b")
            .select("family_a", "support_a", "family_b", "support_b",
                    F.round(F.col("ratio") * 100, 2).alias("similarity"))
            .orderBy(F.desc("similarity"), "family_a", "family_b"))
