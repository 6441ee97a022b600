"""Classification and calibration metrics from one pass over scored samples.

``score_facts`` reduces any number of samples to at most classes x classes x bins rows per
group; every report below is computed from those rows, so samples are read and shuffled
once however many metrics are asked for.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoview.functions import vectors as V

ECE_BINS = 15
MODEL_KEYS = ("view", "seed", "month")
SUMMARY_METRICS = ("accuracy", "macro_f1_supported", "macro_f1_fixed", "weighted_f1",
                   "balanced_accuracy", "nll", "brier", "ece")


def score_rows(predictions: DataFrame, keys: Sequence[str] = MODEL_KEYS,
               log_probabilities: Column | None = None) -> DataFrame:
    """Per-sample predicted class, confidence, true-class probability, NLL and Brier score."""
    logp = V.log_softmax(F.col("logits")) if log_probabilities is None else log_probabilities
    scores = F.col("logits") if log_probabilities is None else log_probabilities
    first = predictions.select(*keys, "sha", "label", V.argmax(scores).alias("predicted"),
                               logp.alias("_logp"))
    second = first.withColumn("_p", V.exp_array(F.col("_logp")))
    return second.select(
        *keys, "sha", "label", "predicted",
        F.array_max("_p").alias("confidence"),
        V.at(F.col("_p"), F.col("label")).alias("p_true"),
        (-V.at(F.col("_logp"), F.col("label"))).alias("nll"),
        V.brier(F.col("_p"), F.col("label")).alias("brier"))


def confidence_bin(confidence: Column, bins: int = ECE_BINS) -> Column:
    return F.least(F.floor(confidence * bins), F.lit(bins - 1)).cast("int")


def score_facts(scored: DataFrame, keys: Sequence[str] = MODEL_KEYS) -> DataFrame:
    """Counts and score sums per (keys, label, predicted, bin), combined map-side."""
    return (scored.groupBy(*keys, "label", "predicted",
                           confidence_bin(F.col("confidence")).alias("bin"))
            .agg(F.count("*").alias("n"), F.sum("confidence").alias("sum_confidence"),
                 F.sum("nll").alias("sum_nll"), F.sum("brier").alias("sum_brier")))


def _groups(facts: DataFrame, keys: Sequence[str]) -> DataFrame:
    return facts.select(*keys).distinct()


def _axis(size: int) -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit(size - 1)))


def confusion_matrix(facts: DataFrame, classes: int,
                     keys: Sequence[str] = MODEL_KEYS) -> DataFrame:
    """Dense true x predicted counts in long form."""
    cells = facts.groupBy(*keys, "label", "predicted").agg(F.sum("n").alias("n"))
    grid = (_groups(facts, keys).select(*keys, _axis(classes).alias("label"))
            .select(*keys, "label", _axis(classes).alias("predicted")))
    return (grid.join(cells, [*keys, "label", "predicted"], "left")
            .select(*keys, "label", "predicted", F.coalesce("n", F.lit(0)).alias("n")))


def class_marginals(facts: DataFrame, keys: Sequence[str] = MODEL_KEYS) -> DataFrame:
    """tp, support and predicted count of every class that occurs as truth or prediction."""
    hit = F.col("label") == F.col("predicted")
    sides = facts.select(*keys, F.explode(F.array(
        F.struct(F.col("label").alias("class_id"), F.col("n").alias("support"),
                 F.lit(0).cast("bigint").alias("predicted_count"),
                 F.when(hit, F.col("n")).otherwise(0).alias("tp")),
        F.struct(F.col("predicted").alias("class_id"), F.lit(0).cast("bigint").alias("support"),
                 F.col("n").alias("predicted_count"),
                 F.lit(0).cast("bigint").alias("tp")))).alias("s"))
    return sides.groupBy(*keys, F.col("s.class_id").alias("class_id")).agg(
        F.sum("s.support").alias("support"), F.sum("s.predicted_count").alias("predicted_count"),
        F.sum("s.tp").alias("tp"))


def _rates(marginals: DataFrame) -> DataFrame:
    tp, support, predicted = F.col("tp"), F.col("support"), F.col("predicted_count")
    return (marginals.withColumn("fp", predicted - tp).withColumn("fn", support - tp)
            .withColumn("precision", F.when(predicted > 0, tp / predicted))
            .withColumn("recall", F.when(support > 0, tp / support))
            .withColumn("f1", F.when(support + predicted > 0, 2 * tp / (support + predicted))))


def per_class_report(facts: DataFrame, classes: int,
                     keys: Sequence[str] = MODEL_KEYS) -> DataFrame:
    """Every class 0..C-1; undefined ratios are NULL, absent classes are marked."""
    grid = _groups(facts, keys).select(*keys, _axis(classes).alias("class_id"))
    dense = (grid.join(class_marginals(facts, keys), [*keys, "class_id"], "left")
             .na.fill(0, ["support", "predicted_count", "tp"]))
    return _rates(dense).withColumn("status", F.when(F.col("support") > 0, "present")
                                    .otherwise("absent_this_month"))


def _zero(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0.0))


def averages(facts: DataFrame, classes: int, keys: Sequence[str] = MODEL_KEYS) -> DataFrame:
    """Accuracy and macro (supported and fixed), weighted, micro and balanced averages."""
    rates = _rates(class_marginals(facts, keys))
    supported = F.col("support") > 0
    out = [F.sum("support").alias("n_samples"), F.count_if(supported).alias("n_supported_classes"),
           (F.sum("tp") / F.sum("support")).alias("accuracy")]
    for name in ("precision", "recall", "f1"):
        out += [F.avg(F.when(supported, _zero(name))).alias(f"macro_{name}_supported"),
                (F.sum(_zero(name)) / F.lit(float(classes))).alias(f"macro_{name}_fixed"),
                (F.sum(_zero(name) * F.col("support")) / F.sum("support"))
                .alias(f"weighted_{name}")]
    out.append(F.avg(F.when(supported, F.col("recall"))).alias("balanced_accuracy"))
    return (rates.groupBy(*keys).agg(*out)
            .withColumn("micro_f1", F.col("accuracy")))


def probability_losses(facts: DataFrame, keys: Sequence[str] = MODEL_KEYS) -> DataFrame:
    return facts.groupBy(*keys).agg(
        (F.sum("sum_nll") / F.sum("n")).alias("nll"),
        (F.sum("sum_brier") / F.sum("n")).alias("brier"),
        (F.sum("sum_confidence") / F.sum("n")).alias("mean_confidence"))


def ece_bins(facts: DataFrame, keys: Sequence[str] = MODEL_KEYS,
             bins: int = ECE_BINS) -> DataFrame:
    """All bins, empty ones with count 0 and NULL accuracy and confidence."""
    hit = F.when(F.col("label") == F.col("predicted"), F.col("n")).otherwise(0)
    filled = facts.groupBy(*keys, "bin").agg(
        F.sum("n").alias("count"), (F.sum(hit) / F.sum("n")).alias("accuracy"),
        (F.sum("sum_confidence") / F.sum("n")).alias("confidence"))
    grid = _groups(facts, keys).select(*keys, _axis(bins).alias("bin"))
    return grid.join(filled, [*keys, "bin"], "left").select(
        *keys, "bin", (F.col("bin") / F.lit(float(bins))).alias("lower"),
        ((F.col("bin") + 1) / F.lit(float(bins))).alias("upper"),
        F.coalesce("count", F.lit(0)).alias("count"), "accuracy", "confidence")


def ece(facts: DataFrame, keys: Sequence[str] = MODEL_KEYS) -> DataFrame:
    hit = F.when(F.col("label") == F.col("predicted"), F.col("n")).otherwise(0)
    per_bin = facts.groupBy(*keys, "bin").agg(
        F.sum("n").alias("_n"), F.abs(F.sum(hit) - F.sum("sum_confidence")).alias("_gap"))
    return per_bin.groupBy(*keys).agg((F.sum("_gap") / F.sum("_n")).alias("ece"))


def report_rows(facts: DataFrame, classes: int, keys: Sequence[str] = MODEL_KEYS) -> DataFrame:
    """One row of scalars per group; all three inputs are a few rows per group."""
    return (averages(facts, classes, keys)
            .join(probability_losses(facts, keys), list(keys))
            .join(ece(facts, keys), list(keys)))


def seed_summary(rows: DataFrame, keys: Sequence[str] = ("view", "month"),
                 metrics: Sequence[str] = SUMMARY_METRICS, seed: str = "seed") -> DataFrame:
    """Mean and sample standard deviation over seeds (NULL for one seed)."""
    stats = []
    for name in metrics:
        stats += [F.avg(name).alias(f"{name}_mean"), F.stddev_samp(name).alias(f"{name}_std")]
    return rows.groupBy(*keys).agg(
        F.count("*").alias("n_seeds"),
        # One row per seed reaches this point, so the list is as long as the seed list.
        F.array_join(F.transform(F.sort_array(F.collect_list(seed)),
                                 lambda s: s.cast("string")), ",").alias("seeds"),
        *stats)


def label_metrics(pairs: DataFrame, true: str = "y_true", predicted: str = "y_pred",
                  labels: Sequence[int] | None = None,
                  keys: Sequence[str] = ()) -> DataFrame:
    """Accuracy and macro precision, recall and F1 over a fixed or the occurring label set."""
    facts = pairs.groupBy(*keys, F.col(true).alias("label"),
                          F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))
    rates = _rates(class_marginals(facts, keys))
    counted = F.lit(True) if labels is None else F.col("class_id").isin(*labels)
    size = F.count_if(counted) if labels is None else F.lit(float(len(labels)))
    macro = [(F.sum(F.when(counted, _zero(name)).otherwise(0.0)) / size).alias(f"macro_{name}")
             for name in ("precision", "recall", "f1")]
    return rates.groupBy(*keys).agg((F.sum("tp") / F.sum("support")).alias("accuracy"), *macro)


def fold_metrics(facts: DataFrame, classes: int, fold: str = "test_fold") -> DataFrame:
    return (averages(facts, classes, [fold]).join(probability_losses(facts, [fold]), fold)
            .select(fold, F.col("n_samples").alias("samples"), "accuracy",
                    F.col("macro_f1_fixed").alias("macro_f1"), "balanced_accuracy",
                    F.col("nll").alias("uncalibrated_nll")))


def month_f1_summary(facts: DataFrame, classes: int,
                     keys: Sequence[str] = ("view", "seed")) -> DataFrame:
    """Mean and worst monthly macro-F1 over the fixed class set."""
    monthly = averages(facts, classes, [*keys, "month"])
    return monthly.groupBy(*keys).agg(F.avg("macro_f1_fixed").alias("mean_month_macro_f1"),
                                      F.min("macro_f1_fixed").alias("worst_month_macro_f1"),
                                      F.count("*").alias("n_months"))


def family_quality(facts: DataFrame, classes: int,
                   keys: Sequence[str] = ("view", "seed")) -> DataFrame:
    """Mean NLL of each true family, NULL and marked when absent."""
    present = facts.groupBy(*keys, F.col("label").alias("class_id")).agg(
        F.sum("n").alias("support"), (F.sum("sum_nll") / F.sum("n")).alias("mean_nll"))
    grid = _groups(facts, keys).select(*keys, _axis(classes).alias("class_id"))
    return grid.join(present, [*keys, "class_id"], "left").select(
        *keys, "class_id", F.coalesce("support", F.lit(0)).alias("support"), "mean_nll",
        F.when(F.col("support").isNotNull(), "present")
        .otherwise("absent_from_quality_month").alias("status"))


def class_balanced_quality(facts: DataFrame, keys: Sequence[str] = ("view", "seed")) -> DataFrame:
    """Q = minus the unweighted mean over present families of the family's mean NLL."""
    per_family = facts.groupBy(*keys, "label").agg(
        (F.sum("sum_nll") / F.sum("n")).alias("_loss"))
    return per_family.groupBy(*keys).agg((-F.avg("_loss")).alias("quality"),
                                         F.count("*").alias("n_supported_classes"))


def predictions_table(scored: DataFrame, keys: Sequence[str] = MODEL_KEYS) -> DataFrame:
    return scored.select(
        *keys, "sha", F.col("label").alias("true_class_id"),
        F.col("predicted").alias("predicted_class_id"), "confidence",
        F.col("p_true").alias("true_class_probability"), "nll", "brier")
