"""Temperature fitting for all models at once, and the effect of calibration."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from chronoview.errors import ContractViolation, require_clean
from chronoview.functions import vectors as V
from chronoview.operators import metrics as M
from chronoview.operators.ranking import lookup_join
from chronoview.operators.validate import broken_rules

MIN_TEMPERATURE = 0.05
MAX_TEMPERATURE = 20.0
TOLERANCE = 1e-12
MAX_PASSES = 80
FIT_SCHEMA = ("view string, seed int, temperature double, inverse_temperature double, "
              "fit_nll_before double, fit_nll_after double, fit_nll_delta double, "
              "status string, at_search_boundary boolean, iterations int, "
              "derivative_at_solution double")


@dataclass
class _Search:
    """Bracket of one model's inverse temperature; a few numbers per model."""
    low: float
    high: float
    beta: float = 1.0
    nll: float = 0.0
    slope: float = 0.0
    baseline: float = 0.0
    baseline_slope: float = 0.0
    passes: int = 0
    open: bool = True
    bound: str | None = None


def _evaluate(samples: DataFrame, betas: list[tuple[str, int, float]]) -> dict:
    """Mean NLL, its derivative and curvature for each (view, seed, beta), in one job."""
    spark = samples.sparkSession
    asked = spark.createDataFrame(betas, "view string, seed int, beta double")
    start = F.struct(F.lit(0.0).alias("s0"), F.lit(0.0).alias("s1"), F.lit(0.0).alias("s2"))

    def step(acc, z):
        weight = F.exp(F.col("beta") * z)
        return F.struct((acc["s0"] + weight).alias("s0"),
                        (acc["s1"] + z * weight).alias("s1"),
                        (acc["s2"] + z * z * weight).alias("s2"))

    sums = samples.join(asked, ["view", "seed"]).select(
        "view", "seed", "beta", "z_true", F.aggregate("z", start, step).alias("m"))
    mean = F.col("m.s1") / F.col("m.s0")
    rows = sums.groupBy("view", "seed", "beta").agg(
        F.avg(F.ln("m.s0") - F.col("beta") * F.col("z_true")).alias("nll"),
        F.avg(mean - F.col("z_true")).alias("slope"),
        F.avg(F.col("m.s2") / F.col("m.s0") - mean * mean).alias("curvature")).collect()
    return {(r.view, r.seed, r.beta): (r.nll, r.slope, r.curvature) for r in rows}


def fit_temperatures(predictions: DataFrame, minimum: float = MIN_TEMPERATURE,
                     maximum: float = MAX_TEMPERATURE) -> DataFrame:
    """Temperature per (view, seed) minimising the mean NLL of the given samples.

    The NLL is convex in 1/T, so a bracketed Newton search meets the bisection optimum in
    a handful of passes. Each pass is one map-side-combined aggregate over all models;
    only their brackets reach the driver. Samples are reduced to centred logits once.
    """
    if not 0 < minimum <= 1 <= maximum or minimum >= maximum:
        raise ValueError("temperature bounds must be positive, distinct and include 1")
    require_clean(broken_rules(predictions, ["view", "seed"], {
        "logits_not_finite": F.col("logits").isNull() | ~V.all_finite(F.col("logits")),
        "label_outside_logits": F.col("label").isNull() | (F.col("label") < 0)
        | (F.col("label") >= F.size("logits"))}), "temperature fit")
    samples = predictions.select(
        "view", F.col("seed").cast("int").alias("seed"), "label",
        V.let(V.as_doubles(F.col("logits")), lambda x: V.let(
            F.array_max(x), lambda top: F.transform(x, lambda v: v - top))).alias("z")
    ).select("view", "seed", "z", V.at(F.col("z"), F.col("label")).alias("z_true")) \
        .persist(StorageLevel.MEMORY_AND_DISK)
    try:
        searches = _search(samples, 1.0 / maximum, 1.0 / minimum)
    finally:
        samples.unpersist()
    rows = [_fit_row(view, seed, s) for (view, seed), s in sorted(searches.items())]
    return predictions.sparkSession.createDataFrame(rows, FIT_SCHEMA)


def _search(samples: DataFrame, low: float, high: float) -> dict[tuple[str, int], _Search]:
    models = [(r.view, r.seed) for r in
              samples.select("view", "seed").distinct().collect()]
    if not models:
        raise ContractViolation("no predictions to fit a temperature on")
    found = _evaluate(samples, [(v, s, b) for v, s in models for b in (low, 1.0, high)])
    searches = {}
    for view, seed in models:
        at_low, at_one, at_high = (found[view, seed, b] for b in (low, 1.0, high))
        s = _Search(low, high, baseline=at_one[0], baseline_slope=at_one[1])
        if at_low[1] >= 0:
            s.beta, s.nll, s.slope, s.bound = low, at_low[0], at_low[1], "maximum"
        elif at_high[1] <= 0:
            s.beta, s.nll, s.slope, s.bound = high, at_high[0], at_high[1], "minimum"
        s.open = s.bound is None
        if s.open:
            s.nll, s.slope = at_one[0], at_one[1]
            _advance(s, at_one)
        searches[view, seed] = s
    for _ in range(MAX_PASSES):
        active = {key: s for key, s in searches.items() if s.open}
        if not active:
            break
        found = _evaluate(samples, [(v, sd, s.beta) for (v, sd), s in active.items()])
        for (view, seed), s in active.items():
            values = found[view, seed, s.beta]
            s.passes += 1
            s.nll, s.slope = values[0], values[1]
            _advance(s, values)
    unfinished = sorted(key for key, s in searches.items() if s.open)
    if unfinished:
        raise ContractViolation(f"the temperature search did not end for {unfinished[:5]}")
    return searches


def _advance(s: _Search, values: tuple[float, float, float]) -> None:
    """Shrink the bracket, then take a Newton step or, outside the bracket, halve it."""
    _, slope, curvature = values
    if slope > 0:
        s.high = s.beta
    else:
        s.low = s.beta
    tolerance = TOLERANCE * max(1.0, abs(s.beta))
    step = s.beta - slope / curvature if curvature > 0 else s.low - 1.0
    if abs(step - s.beta) <= tolerance or s.high - s.low <= tolerance:
        s.open = False
    else:
        s.beta = step if s.low < step < s.high else (s.low + s.high) / 2


def _fit_row(view: str, seed: int, s: _Search) -> tuple:
    beta, nll, slope = s.beta, s.nll, s.slope
    if s.baseline - nll <= TOLERANCE:
        beta, nll, slope, status = 1.0, s.baseline, s.baseline_slope, \
            "no_nll_improvement_keep_T1"
    elif s.bound:
        status = f"{s.bound}_temperature_bound"
    else:
        status = "interior_optimum"
    return (view, seed, 1.0 / beta, beta, s.baseline, nll, nll - s.baseline, status,
            status.endswith("_bound"), s.passes, slope)


def attach_temperature(predictions: DataFrame, temperatures: DataFrame) -> DataFrame:
    """Predictions beside their model's temperature; the fit has one row per model."""
    return lookup_join(predictions, temperatures.select("view", "seed", "temperature"),
                       ["view", "seed"])


def calibrate(predictions: DataFrame, temperatures: DataFrame) -> DataFrame:
    """log softmax(logits / T) as ``log_probabilities``."""
    return attach_temperature(predictions, temperatures).withColumn(
        "log_probabilities", V.log_softmax(F.col("logits"), F.col("temperature")))


def changed_predictions(predictions: DataFrame, temperatures: DataFrame) -> DataFrame:
    """Samples whose predicted class a temperature changes; must be empty."""
    both = attach_temperature(predictions, temperatures)
    scaled = V.argmax(F.transform(V.as_doubles(F.col("logits")),
                                  lambda x: x / F.col("temperature")))
    return both.where(V.argmax(F.col("logits")) != scaled).select("view", "seed", "month", "sha")


def calibration_delta(predictions: DataFrame, temperatures: DataFrame,
                      classes: int) -> DataFrame:
    """Metrics before and after scaling per (view, seed, month), from one pass."""
    both = attach_temperature(predictions, temperatures).withColumn("_version", F.explode(
        F.array(F.struct(F.lit("before").alias("name"), F.lit(1.0).alias("t")),
                F.struct(F.lit("after").alias("name"), F.col("temperature").alias("t")))))
    keys = [*M.MODEL_KEYS, "version"]
    scored = M.score_rows(
        both.withColumn("version", F.col("_version.name"))
        .withColumn("log_probabilities", V.log_softmax(F.col("logits"), F.col("_version.t"))),
        keys, F.col("log_probabilities"))
    rows = M.report_rows(M.score_facts(scored, keys), classes, keys)
    kept = ["accuracy", "macro_f1_supported", "macro_f1_fixed", "weighted_f1",
            "balanced_accuracy"]
    wide = rows.groupBy(*M.MODEL_KEYS).agg(
        F.max("n_samples").alias("n_samples"),
        F.max("n_supported_classes").alias("n_supported_classes"),
        *(F.max(F.when(F.col("version") == "before", F.col(m))).alias(m) for m in kept),
        *(F.max(F.when(F.col("version") == v, F.col(m))).alias(f"{m}_{v}")
          for m in ("nll", "brier", "ece", "mean_confidence") for v in ("before", "after")))
    return wide.select("*", *((F.col(f"{m}_after") - F.col(f"{m}_before")).alias(f"{m}_delta")
                              for m in ("nll", "brier", "ece", "mean_confidence")))
