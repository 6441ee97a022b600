"""Pilot training: epochs of mini-batches with an evaluation after each, resumable.

All (view, seed) models of a pilot are trained together. A mini-batch is a pass over the stored
rows of its hash; every model's batches follow its own seed. After each epoch one pass scores the
hold-out months, and weights and history are stored; a run that died goes on after its last
stored epoch, one of other inputs or settings is refused.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoview.errors import ContractViolation, require_clean
from chronoview.operators import metrics as M
from chronoview.operators import training as R
from chronoview.operators.journal import folder
from chronoview.operators.provenance import claim_output, finish_output, run_identity
from chronoview.operators.selection import pilot_month_problems, pilot_split
from chronoview.session import staged

HISTORY = ("view string, seed int, epoch int, train_loss double, val_loss double, metric double, "
           "worst_month_macro_f1 double")
WEIGHTS = "model int, weights array<double>"


def batch_of(sha: Column, seed: int, epoch: int, batches: int) -> Column:
    """The mini-batch of a sample, the same in any engine."""
    text = F.concat(F.lit(f"{seed}:{epoch}:"), sha)
    return F.pmod(F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("bigint"),
                  F.lit(batches))


def rate_of(epoch: int, epochs: int, rate: float) -> float:
    """Cosine decay over the epochs."""
    return rate * 0.5 * (1 + math.cos(math.pi * epoch / epochs))


def _named(models: list[tuple[str, int]], condition) -> Column:
    """Indices of the models for which ``condition(view, seed)`` holds."""
    return F.array_compact(F.array(*(F.when(condition(view, seed), F.lit(k))
                                     for k, (view, seed) in enumerate(models))))


def evaluate(holdout: DataFrame, weights: np.ndarray, models: list[tuple[str, int]],
             classes: int, months: Sequence[str]) -> dict:
    """model -> (mean loss, mean and worst macro F1 over the months)."""
    rows = holdout.withColumn("tests", _named(models, lambda view, seed: F.col("view") == view))
    scored = R.score_many(rows, weights, "sha", "month")
    keys = ["model", "month"]
    report = M.report_rows(M.score_facts(M.score_rows(scored, keys), keys), classes, keys)
    whole = report.groupBy("model").agg(
        (F.sum(F.col("nll") * F.col("n_samples")) / F.sum("n_samples")).alias("loss"),
        F.avg("macro_f1_fixed").alias("mean"), F.min("macro_f1_fixed").alias("worst"),
        F.count("*").alias("months")).collect()  # one row per model
    if len(whole) != len(models) or any(r["months"] != len(months) for r in whole):
        raise ContractViolation("every model needs samples in every hold-out month")
    return {r["model"]: (r["loss"], r["mean"], r["worst"]) for r in whole}


def pilot_histories(spark: SparkSession, train: DataFrame, seeds: Sequence[int], classes: int,
                    epochs: int, fit_through: str, holdout_months: Sequence[str], path: str,
                    batches: int = 8, rate: float = 0.1, decay: float = 0.0) -> DataFrame:
    """One history row per (view, seed, epoch), as ``select_epoch`` reads them.

    ``train`` has view, sha, month, label, features. Rows to ``fit_through`` are learned from,
    later ones must be of exactly the hold-out months.
    """
    fit, holdout = pilot_split(train, fit_through, holdout_months)
    require_clean(pilot_month_problems(holdout, holdout_months), "pilot months")
    settings = {"seeds": list(seeds), "classes": classes, "epochs": epochs, "batches": batches,
                "fit_through": fit_through, "holdout": list(holdout_months), "rate": rate,
                "decay": decay}
    identity = run_identity(settings, {"train": train})
    place = folder(spark, path)
    if not claim_output(spark, path, identity):
        return _history(place)
    fit, holdout = staged(fit, "pilot-fit"), staged(holdout, "pilot-holdout")
    views = sorted(r["view"] for r in fit.select("view").distinct().collect())  # the models' views
    models = [(view, seed) for view in views for seed in seeds]
    first = fit.select(F.size("features").alias("n")).first()
    if first is None:
        raise ContractViolation("no rows to learn from")
    shape = len(models), classes, first["n"] + 1
    done = _last_epoch(place)
    weights = np.zeros(shape) if not done else _stored(spark, f"{place.root}/weights/epoch={done}",
                                                       shape)
    for epoch in range(done, epochs):
        losses, step = np.zeros((batches, len(models))), rate_of(epoch, epochs, rate)
        for batch in range(batches):
            own = _named(models, lambda view, seed: (F.col("view") == view) & (
                batch_of(F.col("sha"), seed, epoch, batches) == batch))
            rows = fit.withColumn("fits", own).where(F.size("fits") > 0)
            _, losses[batch], gradient = R.gradients(rows, weights)
            weights = weights - step * (gradient + decay * weights)
        found = evaluate(holdout, weights, models, classes, holdout_months)
        rows = [(view, seed, epoch + 1, float(losses[:, k].mean()), *map(float, found[k]))
                for k, (view, seed) in enumerate(models)]
        _store(spark, weights, f"{place.root}/weights/epoch={epoch + 1}")
        spark.createDataFrame(rows, HISTORY).coalesce(1).write.mode("overwrite").parquet(
            f"{place.root}/history/run={epoch + 1}")
    finish_output(spark, path, identity)
    return _history(place)


def _history(place) -> DataFrame:
    return place.spark.read.schema(HISTORY).parquet(f"{place.root}/history").select(
        *(c.split()[0] for c in HISTORY.split(", ")))


def _last_epoch(place) -> int:
    """The last epoch whose weights and history are whole."""
    epoch = 0
    while place.exists("weights", f"epoch={epoch + 1}", "_SUCCESS") and place.exists(
            "history", f"run={epoch + 1}", "_SUCCESS"):
        epoch += 1
    return epoch


def _store(spark: SparkSession, weights: np.ndarray, path: str) -> None:
    rows = [(k, w.ravel().tolist()) for k, w in enumerate(weights)]
    spark.createDataFrame(rows, WEIGHTS).write.mode("overwrite").parquet(path)


def _stored(spark: SparkSession, path: str, shape: tuple) -> np.ndarray:
    rows = spark.read.schema(WEIGHTS).parquet(path).collect()
    return np.stack([np.reshape(r["weights"], shape[1:]) for r in sorted(
        rows, key=lambda r: r["model"])])
