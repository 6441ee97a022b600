"""Fusing the views: uniform and quality-weighted mixtures, and leak-free selection."""

from __future__ import annotations

from collections.abc import Sequence
from math import log

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from chronoview.functions import vectors as V
from chronoview.operators.ranking import lookup_join

# The views, and the quality scales tried by the selection.
VIEWS = ("raw_byte", "entropy", "sbsmi")
QUALITY_SCALES = (0.0, 0.5, 1.0, 2.0, 4.0)
TIE_TOLERANCE = 1e-12
SAMPLE_KEYS = ("seed", "month", "sha")


def align_views(scores: DataFrame, value: str, views: Sequence[str] = VIEWS,
                keys: Sequence[str] = SAMPLE_KEYS,
                same: Sequence[str] = ("label",)) -> DataFrame:
    """One column of ``value`` per view, joined on the sample keys and the shared columns.

    The keys are unique per view (check_predictions), so the joins are one-to-one; with
    view-partitioned storage each branch reads its own partitions, and all three share
    one partitioning.
    """
    on = [*keys, *same]
    aligned = None
    for view in views:
        part = scores.where(F.col("view") == view).select(*on, F.col(value).alias(view))
        aligned = part if aligned is None else aligned.join(part, on)
    return aligned


def fuse_uniform(calibrated: DataFrame, views: Sequence[str] = VIEWS) -> DataFrame:
    """Mean of the views' probabilities, in log space."""
    aligned = align_views(calibrated, "log_probabilities", views)
    mixed = F.col(views[0])
    for view in views[1:]:
        mixed = V.log_add(mixed, F.col(view))
    return aligned.select(*SAMPLE_KEYS, "label", V.add_scalar(
        mixed, F.lit(-log(len(views)))).alias("log_probabilities"))


def quality_weights(qualities: DataFrame, scales: Sequence[float] = QUALITY_SCALES) -> DataFrame:
    """Softmax over the views of scale * quality, per seed and scale."""
    grid = qualities.select("seed", "view", "quality", F.explode(
        F.array(*(F.lit(float(s)) for s in scales))).alias("quality_scale"))
    group = W.partitionBy("seed", "quality_scale")
    shifted = grid.withColumn("_s", F.col("quality_scale") * F.col("quality")) \
        .withColumn("_s", F.col("_s") - F.max("_s").over(group))
    return (shifted.withColumn("log_weight", F.col("_s") - F.ln(F.sum(F.exp("_s")).over(group)))
            .withColumn("weight", F.exp("log_weight"))
            .select("seed", "quality_scale", "view", "log_weight", "weight"))


def fuse_weighted(calibrated: DataFrame, weights: DataFrame,
                  views: Sequence[str] = VIEWS) -> DataFrame:
    """Sum over views of weight * probability in log space, for every scale in ``weights``."""
    aligned = align_views(calibrated, "log_probabilities", views)
    wide = weights.groupBy("seed", "quality_scale").agg(
        *(F.max(F.when(F.col("view") == v, F.col("log_weight"))).alias(f"_w_{v}")
          for v in views))
    # One row per seed and scale: arrays of weights keep the join key unique.
    listed = wide.groupBy("seed").agg(F.collect_list(F.struct(
        "quality_scale", *(f"_w_{v}" for v in views))).alias("_scales"))
    both = lookup_join(aligned, listed, ["seed"]).withColumn("_s", F.explode("_scales")) \
        .select(*aligned.columns, "_s.*")
    mixed = V.add_scalar(F.col(views[0]), F.col(f"_w_{views[0]}"))
    for view in views[1:]:
        mixed = V.log_add(mixed, V.add_scalar(F.col(view), F.col(f"_w_{view}")))
    return both.select("quality_scale", *SAMPLE_KEYS, "label",
                       mixed.alias("log_probabilities"))


def scale_scores(candidates: DataFrame, selection_month: str,
                 metric: str = "macro_f1_supported") -> DataFrame:
    """Mean and deviation of the selection month's metric over seeds, per scale."""
    return (candidates.where(F.col("month") == selection_month).groupBy("quality_scale")
            .agg(F.avg(metric).alias("score_mean"), F.stddev_samp(metric).alias("score_std"),
                 F.count("*").alias("n_seeds")))


def incomplete_scales(candidates: DataFrame, selection_month: str, seeds: int) -> DataFrame:
    return (candidates.where(F.col("month") == selection_month).groupBy("quality_scale")
            .agg(F.count("*").alias("n"), F.count_distinct("seed").alias("distinct"))
            .where((F.col("n") != seeds) | (F.col("distinct") != seeds)))


def select_scale(scores: DataFrame, tolerance: float = TIE_TOLERANCE) -> DataFrame:
    """Best scale; a larger one must win by more than the tolerance over the best so far."""
    # One row per scale of a fixed grid, so the list below is as long as that grid.
    ordered = F.sort_array(F.collect_list(F.struct("quality_scale", "score_mean")))

    def better(best, candidate):
        return F.when(candidate["score_mean"] > best["score_mean"] + F.lit(tolerance), candidate) \
            .otherwise(best)

    best = scores.agg(ordered.alias("_all")).select(
        F.aggregate(F.slice("_all", F.lit(2), F.size("_all")),
                    F.element_at("_all", 1), better).alias("_best"))
    return best.select(F.col("_best.quality_scale").alias("selected_scale"),
                       F.col("_best.score_mean").alias("score_mean"))


def select_epoch(history: DataFrame, metric: str = "metric") -> DataFrame:
    """Epoch with the best mean metric over seeds; the earliest wins ties."""
    means = history.groupBy("view", "epoch").agg(F.avg(metric).alias("mean_metric"),
                                                 F.count("*").alias("n_seeds"))
    best = means.groupBy("view").agg(F.max(F.struct(
        "mean_metric", (-F.col("epoch")).alias("neg_epoch"))).alias("b"),
        F.max("epoch").alias("pilot_epochs"))
    return best.select("view", (-F.col("b.neg_epoch")).alias("selected_epoch"),
                       F.col("b.mean_metric").alias("mean_metric"), "pilot_epochs")


def check_history(history: DataFrame, seeds: Sequence[int] | None = None,
                  metric: str = "metric") -> DataFrame:
    """Runs whose epochs are not 1..E, whose length differs, or whose metric is not finite."""
    value = F.col(metric)
    finite = value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))
    runs = history.groupBy("view", "seed").agg(
        F.count("*").alias("n"), F.count_distinct("epoch").alias("distinct"),
        F.min("epoch").alias("low"), F.max("epoch").alias("high"),
        F.count_if(~finite).alias("bad"))
    longest = runs.groupBy("view").agg(F.max("high").alias("epochs"),
                                       F.count("*").alias("runs"))
    joined = runs.join(longest, "view")
    rules = [F.when((F.col("low") != 1) | (F.col("n") != F.col("high"))
                    | (F.col("distinct") != F.col("n")), F.lit("epochs_not_consecutive")),
             F.when(F.col("high") != F.col("epochs"), F.lit("run_lengths_differ")),
             F.when(F.col("bad") > 0, F.lit("metric_not_finite"))]
    if seeds is not None:
        rules += [F.when(F.col("runs") != len(seeds), F.lit("runs_missing")),
                  F.when(~F.col("seed").isin(*seeds), F.lit("unknown_seed"))]
    return joined.select("view", "seed", F.explode(F.array_compact(F.array(*rules)))
                         .alias("rule"))
