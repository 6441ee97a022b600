"""Predictions to calibrated, fused and selected methods, without looking ahead."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoview.errors import require_clean
from chronoview.operators import calibration as C
from chronoview.operators import fusion as X
from chronoview.operators import metrics as M
from chronoview.operators import validate as K
from chronoview.session import freeze, staged

FIT_MONTH = "2020-02"
SELECTION_MONTH = "2020-03"


@dataclass
class Experiment:
    """Frames of a fusion experiment; all but ``calibrated`` are small and computed once."""
    temperatures: DataFrame
    calibrated: DataFrame
    qualities: DataFrame
    weights: DataFrame
    scale_scores: DataFrame
    selection: DataFrame
    comparison: DataFrame


def _report(scored_input: DataFrame, keys: Sequence[str], classes: int) -> DataFrame:
    rows = M.score_rows(scored_input, keys, F.col("log_probabilities"))
    return M.report_rows(M.score_facts(rows, keys), classes, keys)


def run_experiment(predictions: DataFrame, classes: int, fit_month: str = FIT_MONTH,
                   selection_month: str = SELECTION_MONTH,
                   scales: Sequence[float] = X.QUALITY_SCALES,
                   views: Sequence[str] = X.VIEWS, check: bool = True,
                   seeds: Sequence[int] | None = None,
                   months: Sequence[str] | None = None) -> Experiment:
    """Temperatures and qualities use the fit month only, the scale the selection month only.

    Every view needs scores for every seed and month of the grid; seeds and months that are
    not given are those of the predictions. A missing cell, a model without a temperature,
    a prediction that scaling changes or a scale without all seeds is refused.

    The calibrated probabilities are written once to the shared folder; every later step
    reads those columns, so logits are scored once whatever the number of methods.
    """
    if check:
        require_clean(K.check_predictions(predictions, classes), "predictions")
        # At most one row per model and month reaches the driver.
        cells = predictions.select("seed", "month").distinct().collect()
        seeds = sorted({r.seed for r in cells}) if seeds is None else seeds
        months = sorted({r.month for r in cells}) if months is None else months
        require_clean(K.check_grid(predictions, views, seeds, months), "prediction grid")
        require_clean(K.check_alignment(predictions, len(views) * len(seeds)),
                      "prediction alignment")
    fit_rows = predictions.where(F.col("month") == fit_month)
    temperatures = freeze(C.fit_temperatures(fit_rows))
    if check:
        require_clean(predictions.select("view", "seed").distinct().join(
            temperatures, ["view", "seed"], "left_anti"), "models without a temperature")
        require_clean(C.changed_predictions(predictions, temperatures), "scaled predictions")
    calibrated = staged(C.calibrate(predictions, temperatures).select(
        *M.MODEL_KEYS, "sha", "label", "log_probabilities"), "calibrated")

    keys = list(M.MODEL_KEYS)
    facts = freeze(M.score_facts(M.score_rows(calibrated, keys, F.col("log_probabilities")),
                                 keys))
    singles = M.report_rows(facts, classes, keys)
    qualities = M.class_balanced_quality(facts.where(F.col("month") == fit_month))
    weights = freeze(X.quality_weights(qualities, scales))

    fused = X.fuse_weighted(calibrated, weights, views)
    candidates = freeze(_report(fused, ["quality_scale", "seed", "month"], classes))
    if check:
        require_clean(X.incomplete_scales(candidates, selection_month, len(seeds)), "scales")
    scores = X.scale_scores(candidates, selection_month)
    selection = freeze(X.select_scale(scores))
    chosen = selection.first().selected_scale

    uniform = candidates.where("quality_scale = 0").withColumn("view", F.lit("uniform"))
    quality = candidates.where(F.col("quality_scale") == chosen) \
        .withColumn("view", F.lit("quality_only"))
    comparison = singles.unionByName(uniform.drop("quality_scale")) \
        .unionByName(quality.drop("quality_scale"))
    return Experiment(temperatures, calibrated, qualities, weights, scores, selection,
                      comparison)


def method_comparison(experiment: Experiment) -> DataFrame:
    """Seed summaries of the single views and both fusions."""
    return M.seed_summary(experiment.comparison, ("view", "month"))
