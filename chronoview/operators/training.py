"""Many linear classifiers fitted in the same passes over the data.

A row says which models learn from it (``fits``) and which score it (``tests``), so the folds of
a cross validation, its repeats and seeds share one stored table and no row is copied per model.
One pass evaluates losses and gradients of all models: a task multiplies its rows with all
weights at once and adds up; tasks' sums meet in two steps of a tree. The driver keeps a
quasi-Newton descent per model and asks for the next points of all of them together, so that
fifteen models take as many jobs as the slowest one alone. What it holds, and what is broadcast,
is models x classes x (features + 1) numbers, times the few steps a descent remembers: a bound
set by the caller's models, not by the data.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoview.errors import ContractViolation

SUMS = "model int, bucket int, n bigint, loss double, gradient array<double>"
ROWS_AT_ONCE = 512
MEMORY = 5
#: Weights that may be broadcast and held: models x classes x (features + 1).
MOST_WEIGHTS = 1 << 26


def _matrix(lists: pa.Array, rows: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(rows, -1)


def _members(lists: pa.Array, rows: int, models: int) -> np.ndarray:
    """Row by model: whether the row's list names the model."""
    found = np.zeros((rows, models), bool)
    owner = np.repeat(np.arange(rows), lists.value_lengths().fill_null(0).to_numpy(
        zero_copy_only=False).astype(int))
    found[owner, lists.flatten().to_numpy(zero_copy_only=False)] = True
    return found


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS_AT_ONCE):
            yield batch.slice(start, ROWS_AT_ONCE)


def _logits(features: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows with a constant 1, logits by row, model and class)."""
    models, classes, width = weights.shape
    if features.shape[1] != width - 1:
        raise ValueError(f"rows have {features.shape[1]} features, the models {width - 1}")
    rows = np.concatenate([features, np.ones((len(features), 1))], axis=1)
    return rows, (rows @ weights.reshape(-1, width).T).reshape(-1, models, classes)


def _log_softmax(logits: np.ndarray) -> np.ndarray:
    shifted = logits - logits.max(axis=-1, keepdims=True)
    return shifted - np.log(np.exp(shifted).sum(axis=-1, keepdims=True))


def _added(key: str):
    """Sum the parts of a group: a square root's number of tasks, or of buckets."""
    def add(table: pa.Table) -> pa.Table:
        n, loss = (table.column(c).to_numpy().sum() for c in ("n", "loss"))
        gradient = _matrix(table.column("gradient").combine_chunks(), table.num_rows).sum(axis=0)
        bucket = table.column("bucket")[0].as_py() if key == "bucket" else 0
        return pa.table({"model": table.column("model")[:1], "bucket": pa.array([bucket], pa.int32()),
                         "n": pa.array([n], pa.int64()), "loss": pa.array([loss], pa.float64()),
                         "gradient": pa.array([gradient], pa.list_(pa.float64()))})
    return add


def gradients(rows: DataFrame, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, mean loss, mean gradient) of every model at its weights, in one pass.

    ``rows`` has features, label and fits; ``weights`` is (models, classes, features + 1), the
    last column being the constant. Models that no row fits have 0 rows and zeros.
    """
    models, classes, width = weights.shape
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(weights)
    buckets = max(1, int(rows.rdd.getNumPartitions() ** 0.5))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, loss = np.zeros(models, np.int64), np.zeros(models)
        gradient = np.zeros((models * classes, width))
        for part in _slices(batches):
            size = part.num_rows
            member = _members(part.column("fits"), size, models)
            features, logits = _logits(_matrix(part.column("features"), size), shared.value)
            label = part.column("label").to_numpy()
            logs = _log_softmax(logits)
            loss -= (logs[np.arange(size), :, label] * member).sum(axis=0)
            n += member.sum(axis=0)
            rest = np.exp(logs)
            rest[np.arange(size), :, label] -= 1
            rest *= member[:, :, None]
            gradient += rest.reshape(size, -1).T @ features
        bucket = TaskContext.get().partitionId() % buckets
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(models), pa.int32()), pa.array([bucket] * models, pa.int32()),
             pa.array(n), pa.array(loss),
             pa.array(list(gradient.reshape(models, -1)), pa.list_(pa.float64()))],
            names=["model", "bucket", "n", "loss", "gradient"])

    sums = rows.select("features", "label", "fits").mapInArrow(run, SUMS)
    near = sums.groupBy("model", "bucket").applyInArrow(_added("bucket"), SUMS)
    whole = near.groupBy("model").applyInArrow(_added("model"), SUMS).collect()
    shared.unpersist()
    n, loss, gradient = np.zeros(models, np.int64), np.zeros(models), np.zeros(weights.shape)
    for r in whole:  # one row per model
        n[r["model"]] = r["n"]
        loss[r["model"]] = r["loss"] / max(1, r["n"])
        gradient[r["model"]] = np.reshape(r["gradient"], weights.shape[1:]) / max(1, r["n"])
    return n, loss, gradient


class Descent:
    """One model's quasi-Newton descent; it only says where to evaluate next."""

    def __init__(self, start: np.ndarray, tolerance: float, most: int):
        self.x, self.tolerance, self.left = start, tolerance, most
        self.value = self.gradient = self.direction = None
        self.step, self.steps, self.changes, self.done = 0.0, [], [], False

    def point(self) -> np.ndarray:
        return self.x if self.value is None else self.x + self.step * self.direction

    def take(self, value: float, gradient: np.ndarray) -> None:
        if self.value is not None:
            slope = float((self.gradient * self.direction).sum())
            if not value <= self.value + 1e-4 * self.step * slope:
                self.step /= 2
                self.done = self.step < 1e-12
                return
            moved, change = self.step * self.direction, gradient - self.gradient
            if (moved * change).sum() > 1e-12 * (change * change).sum():
                self.steps, self.changes = ([*kept, new][-MEMORY:] for kept, new in (
                    (self.steps, moved), (self.changes, change)))
            self.x = self.x + moved
            self.left -= 1
        self.value, self.gradient = value, gradient
        self.done = self.left <= 0 or float(np.abs(gradient).max()) <= self.tolerance
        self.direction = -self._scaled(gradient)
        self.step = 1.0 if self.steps else min(1.0, 1.0 / max(1e-12, float(np.sqrt(
            (gradient * gradient).sum()))))

    def _scaled(self, gradient: np.ndarray) -> np.ndarray:
        """The gradient under the curvature that the remembered steps show."""
        found, shares = gradient.copy(), []
        for moved, change in zip(self.steps[::-1], self.changes[::-1]):
            share = (moved * found).sum() / (moved * change).sum()
            shares.append(share)
            found -= share * change
        if self.steps:
            last, change = self.steps[-1], self.changes[-1]
            found *= (last * change).sum() / (change * change).sum()
        for moved, change, share in zip(self.steps, self.changes, shares[::-1]):
            found += (share - (change * found).sum() / (moved * change).sum()) * moved
        return found


def fit_many(rows: DataFrame, models: int, classes: int, reg_param: float = 0.01,
             max_iter: int = 50, tolerance: float = 1e-7) -> tuple[np.ndarray, int]:
    """(weights of all models, passes over the rows) of multinomial logistic regressions.

    The mean loss plus half of ``reg_param`` times the squared weights, constants apart, is
    least at the end. ``rows``: features, label in [0, classes), fits. A model without rows
    keeps zeros. ``rows`` is read once per pass and should be stored.
    """
    first = rows.select(F.size("features").alias("n")).first()
    if first is None:
        raise ContractViolation("no rows to learn from")
    shape = models, classes, first["n"] + 1
    if np.prod(shape) > MOST_WEIGHTS:
        raise ContractViolation(f"{shape} weights are more than {MOST_WEIGHTS}")
    descents = [Descent(np.zeros(shape[1:]), tolerance, max_iter) for _ in range(models)]
    penalty = np.full(shape[2], reg_param)
    penalty[-1] = 0.0
    passes = 0
    while not all(d.done for d in descents):
        points = np.stack([d.point() for d in descents])
        _, loss, gradient = gradients(rows, points)
        passes += 1
        for d, x, value, slope in zip(descents, points, loss, gradient):
            if not d.done:
                d.take(value + 0.5 * float((penalty * x * x).sum()), slope + penalty * x)
    return np.stack([d.x for d in descents]), passes


def score_many(rows: DataFrame, weights: np.ndarray, *carry: str) -> DataFrame:
    """(carry.., label, model, logits): a row for every model in ``tests``, in one pass."""
    shared = rows.sparkSession.sparkContext.broadcast(weights)
    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in carry) + \
        (", " if carry else "") + "label int, model int, logits array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(batches):
            size = part.num_rows
            member = _members(part.column("tests"), size, len(shared.value))
            _, logits = _logits(_matrix(part.column("features"), size), shared.value)
            row, model = np.nonzero(member)
            taken = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [*(part.column(c).take(taken) for c in carry), part.column("label").take(taken),
                 pa.array(model, pa.int32()),
                 pa.array(list(logits[row, model]), pa.list_(pa.float64()))],
                names=[*carry, "label", "model", "logits"])

    return rows.select(*carry, F.col("label").cast("int").alias("label"), "features",
                       "tests").mapInArrow(run, schema)


def fold_members(fold, k: int) -> tuple:
    """(fits, tests) of a row: all models but its fold's learn from it, that one scores it."""
    everyone = F.sequence(F.lit(0), F.lit(k - 1))
    return F.filter(everyone, lambda m: m != fold), F.array(fold.cast("int"))
