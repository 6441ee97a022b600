"""Deterministic stratified folds and their checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from chronoview.operators.ranking import ranked, seeded_order, sha_bucket

DEFAULT_SEEDS = tuple(range(42, 52))


def repeated_folds(samples: DataFrame, k: int = 10, seeds: Sequence[int] = DEFAULT_SEEDS,
                   label: str = "class_id") -> DataFrame:
    """test_fold per (seed, sha).

    Classes follow one another in the order of their first id; within a class, samples
    follow a seeded hash of their id; positions are dealt round the k folds. Fold sizes
    per class therefore equal those of stratified dealing by position, and the result
    does not depend on the order of the input. Ranks come from bucket sizes, so a class
    with a third of all rows is not sorted in one task.
    """
    if k < 2:
        raise ValueError("at least two folds are needed")
    sizes = samples.groupBy(label).agg(F.min("sha").alias("_first"), F.count("*").alias("_size"))
    # One row per class: the running total is over classes, not samples.
    before = W.orderBy("_first").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(label, F.coalesce(F.sum("_size").over(before), F.lit(0))
                           .alias("start"))
    seeded = samples.withColumn("seed", F.explode(F.array(*(F.lit(s) for s in seeds))))
    # An expression, not a column: the hash is taken again where rows are sorted, not shuffled.
    order = seeded_order(F.col("sha"), F.col("seed"))
    numbered = ranked(seeded, ["seed", label], [order, F.col("sha")], sha_bucket(order), "_rank",
                      offsets, [label])
    return (numbered.withColumn("test_fold", F.pmod(F.col("_rank") - 1, F.lit(k)).cast("int"))
            .drop("_rank"))


def stratified_folds(samples: DataFrame, k: int = 10, seed: int = 42,
                     label: str = "class_id") -> DataFrame:
    return repeated_folds(samples, k, [seed], label).drop("seed")


def small_classes(samples: DataFrame, k: int, label: str = "class_id") -> DataFrame:
    """Violations: classes with fewer samples than folds."""
    return (samples.groupBy(label).agg(F.count("*").alias("n")).where(F.col("n") < k)
            .select(label, "n", F.lit("class_smaller_than_fold_count").alias("rule")))


def fold_counts(folds: DataFrame, label: str = "class_id") -> DataFrame:
    return folds.groupBy("test_fold", label).agg(F.count("*").alias("n"))


def fold_crosstab(folds: DataFrame, k: int, labels: Sequence,
                  label: str = "class_id") -> DataFrame:
    """Fold rows, class columns, zero-filled for every fold 0..k-1."""
    wide = (folds.groupBy("test_fold").pivot(label, list(labels)).agg(F.count(F.lit(1))))
    every = folds.sparkSession.range(k).select(F.col("id").cast("int").alias("test_fold"))
    return every.join(wide, "test_fold", "left").na.fill(0)


def check_folds(folds: DataFrame, k: int, label: str = "class_id") -> DataFrame:
    """Violations of a fold table, as (subject, rule).

    Ids are counted once per id; everything else comes from the fold x class counts.
    """
    counts = fold_counts(folds, label)
    outside = counts.where(F.col("test_fold").isNull() | (F.col("test_fold") < 0)
                           | (F.col("test_fold") >= k)) \
        .select(F.col("test_fold").cast("string").alias("subject"),
                F.lit("fold_outside_range").alias("rule"))
    per_class = counts.groupBy(label).agg(
        F.count_distinct("test_fold").alias("folds"),
        (F.max("n") - F.min("n")).alias("spread"))
    class_rules = per_class.select(
        F.col(label).cast("string").alias("subject"),
        F.explode(F.array_compact(F.array(
            F.when(F.col("folds") < k, F.lit("class_missing_from_a_fold")),
            F.when(F.col("spread") > 1, F.lit("class_not_balanced")))))
        .alias("rule"))
    repeated = (folds.groupBy("sha").agg(F.count("*").alias("n")).where("n > 1")
                .select(F.col("sha").alias("subject"), F.lit("sample_repeated").alias("rule")))
    return outside.unionByName(class_rules).unionByName(repeated)


def fold_partition_audit(folds: DataFrame, k: int) -> DataFrame:
    """Train and test sizes of every fold, which must add up to all samples."""
    sizes = folds.groupBy("test_fold").agg(F.count("*").alias("test_samples"))
    every = folds.sparkSession.range(k).select(F.col("id").cast("int").alias("test_fold"))
    return (every.join(sizes, "test_fold", "left")
            .select("test_fold", F.coalesce("test_samples", F.lit(0)).alias("test_samples"))
            .withColumn("train_samples",
                        sizes.agg(F.coalesce(F.sum("test_samples"), F.lit(0))).scalar()
                        - F.col("test_samples")))
