"""Score queries: softmax, reports, calibration, fusion, selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronoview.catalog import tables as Q
from chronoview.catalog.cohort import sql
from chronoview.catalog.registry import query
from chronoview.catalog.tables import CLASSES, Tables
from chronoview.functions import vectors as V
from chronoview.operators import calibration as C
from chronoview.operators import fusion as X
from chronoview.operators import metrics as M
from chronoview.operators import validate as K
from chronoview.plans import experiment as E
from chronoview.plans import pilot as L
from chronoview.session import freeze, scratch_path
from chronoview.sources import sinks as W
from chronoview.sources import tables as T

KEYS = list(M.MODEL_KEYS)
REPORT = Q.SCORED + ", " + Q.report("scored", "report")
DOUBLES = {"accuracy", "nll", "brier", "ece", "mean_confidence", "balanced_accuracy"}


def rounded(df, digits: int = 6):
    """All doubles rounded, so that both engines print the same digits."""
    return df.select(*(F.round(f.name, digits).alias(f.name)
                       if f.dataType.typeName() == "double" else F.col(f.name)
                       for f in df.schema.fields))


def rounds(columns: str, digits: int = 6) -> str:
    return ", ".join(f"round({c}, {digits}) AS {c}" for c in columns.split())


def _scored(t: Tables):
    return M.score_rows(t.predictions)


def _facts(t: Tables):
    return M.score_facts(_scored(t))


# -- vectors ----------------------------------------------------------------------------

@query("b20_log_softmax", sql(Q.PREDICTIONS + ", " + Q.log_probabilities("logits", "lp", "2.0"), """
SELECT view, seed, sha, c, round(lp, 8) AS lp, round(exp(lp), 8) AS p FROM lp"""))
def _(t: Tables):
    rows = t.predictions.select("view", "seed", "sha", F.posexplode(
        V.log_softmax(F.col("logits"), 2.0)).alias("c", "lp"))
    return rows.select("view", "seed", "sha", "c", F.round("lp", 8).alias("lp"),
                       F.round(F.exp("lp"), 8).alias("p"))


@query("b21_argmax", sql(Q.SCORED, "SELECT view, seed, sha, predicted FROM scored"))
def _(t: Tables):
    return t.predictions.select("view", "seed", "sha", V.argmax(F.col("logits"))
                                .alias("predicted"))


# -- predictions as a source and sink ---------------------------------------------------

@query("a9_scan_predictions", sql(Q.PREDICTIONS, """
SELECT view, seed, month, sha, label, round(sum(z), 6) AS total FROM logits
WHERE view = 'entropy' AND seed = 22 GROUP BY ALL"""))
def _(t: Tables):
    path = scratch_path(t.spark, "predictions")
    W.write_predictions(_export(t), path, CLASSES)
    rows = T.scan_predictions(t.spark, path, CLASSES, views=["entropy"], seeds=[22])
    return rows.select(*KEYS, "sha", "label", F.round(V.array_sum(F.col("logits")), 6)
                       .alias("total"))


def _limbs_sql() -> str:
    """The recorded sums of an export, from the long logits."""
    scaled = "z * 1048576"
    middle = f"(({scaled}) - floor({scaled})) * 4294967296"
    low = f"(({middle}) - floor({middle})) * 4294967296"
    parts = " || ':' || ".join(f"CAST(floor({p}) AS BIGINT)" for p in (scaled, middle, low))
    sums = ", ".join(f"CAST(sum(CAST('0x' || substr(digest, {8 * k + 1}, 8) AS BIGINT)) AS BIGINT) "
                     f"AS limb{k}" for k in range(4))
    return f"""SELECT view, seed, month, count(*) AS n, {sums} FROM (
  SELECT view, seed, month, md5(sha || '|' || label || '|' ||
    string_agg({parts}, ',' ORDER BY c)) AS digest FROM logits
  GROUP BY view, seed, month, sha, label) GROUP BY view, seed, month"""


@query("a14_export_checksums", sql(Q.PREDICTIONS, _limbs_sql()))
def _(t: Tables):
    path = scratch_path(t.spark, "predictions")
    W.write_predictions(_export(t), path, CLASSES)
    return t.spark.read.parquet(f"{path}_checksums")


@query("a9_verified_predictions", sql(Q.PREDICTIONS, """
SELECT DISTINCT view, seed, month, rule FROM logits, (VALUES ('checksum')) AS r(rule)
WHERE view = 'sbsmi' AND month = '2020-02'
UNION ALL SELECT DISTINCT view, seed, month, rule FROM logits,
  (VALUES ('checksum'), ('row_count')) AS r(rule) WHERE view = 'raw_byte' AND month = '2020-03'"""))
def _(t: Tables):
    """A stored export, of which one model's smallest logit bits and another's rows were changed."""
    path = scratch_path(t.spark, "predictions")
    W.write_predictions(_export(t), path, CLASSES)
    rows = T.scan_predictions(t.spark, path, CLASSES)
    first = rows.groupBy(*KEYS).agg(F.min("sha").alias("_first"))
    one = F.col("sha") == F.col("_first")
    nudged = F.transform("logits", lambda z, i: F.when(i == 0, z + z * F.lit(2.0 ** -50)).otherwise(z))
    changed = rows.join(first, KEYS).withColumn("logits", F.when(
        one & (F.col("view") == "sbsmi") & (F.col("month") == "2020-02"), nudged).otherwise(
        F.col("logits"))).where(~(one & (F.col("view") == "raw_byte") & (
            F.col("month") == "2020-03")))
    recorded = t.spark.read.parquet(f"{path}_checksums")
    return K.check_export(changed, recorded, CLASSES)


def _export(t: Tables):
    return t.predictions.withColumn("embedding", F.transform(
        "logits", lambda x: x.cast("float")))


@query("a14_write_predictions", sql(Q.PREDICTIONS, """
SELECT view, seed, month, label, count(*) AS n FROM logits WHERE c = 0 GROUP BY ALL"""))
def _(t: Tables):
    path = scratch_path(t.spark, "predictions")
    W.write_predictions(_export(t), path, CLASSES)
    return t.spark.read.parquet(f"{path}_class_counts")


@query("a15_write_report_set", sql(REPORT, """
SELECT view, CAST(seed AS VARCHAR) AS seed, month, CAST(class_id AS VARCHAR) AS class_id,
  'family' || class_id AS family, CAST(CAST(tp AS BIGINT) AS VARCHAR) AS tp,
  CAST(CAST(support AS BIGINT) AS VARCHAR) AS support,
  CASE WHEN support > 0 THEN 'present' ELSE 'absent_this_month' END AS status
FROM report_rates WHERE support + predicted_count > 0"""))
def _(t: Tables):
    path = scratch_path(t.spark, "report")
    names = t.read("embeddings").select(F.col("label").alias("class_id")).distinct().withColumn(
        "family", F.concat(F.lit("family"), F.col("class_id").cast("string")))
    scored = _scored(t)
    W.write_report_set(freeze(M.score_facts(scored)), names, CLASSES, path, scored)
    rows = T.scan_contract_csv(t.spark, f"{path}/classification_report_csv")
    return rows.where("support <> '0' OR predicted_count <> '0'").select(
        *KEYS, "class_id", "family", "tp", "support", "status")


# -- metrics ----------------------------------------------------------------------------

@query("e12_confusion_matrix", sql(Q.SCORED, """
SELECT g.view, g.seed, g.month, a.c AS label, b.c AS predicted, count(s.sha) AS n
FROM (SELECT DISTINCT view, seed, month FROM scored) g,
  (SELECT CAST(unnest(range(0, 10)) AS INTEGER) AS c) a, (SELECT CAST(unnest(range(0, 10)) AS INTEGER) AS c) b
LEFT JOIN scored s ON s.view = g.view AND s.seed = g.seed AND s.month = g.month
  AND s.label = a.c AND s.predicted = b.c GROUP BY ALL"""))
def _(t: Tables):
    return M.confusion_matrix(_facts(t), CLASSES)


@query("e13_per_class_report", sql(REPORT, """
SELECT g.view, g.seed, g.month, a.c AS class_id, CAST(coalesce(support, 0) AS BIGINT) AS support,
  CAST(coalesce(predicted_count, 0) AS BIGINT) AS predicted_count,
  CAST(coalesce(tp, 0) AS BIGINT) AS tp, CAST(coalesce(predicted_count - tp, 0) AS BIGINT) AS fp,
  CAST(coalesce(support - tp, 0) AS BIGINT) AS fn,
  round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS f1,
  CASE WHEN support > 0 THEN 'present' ELSE 'absent_this_month' END AS status
FROM (SELECT DISTINCT view, seed, month FROM scored) g,
  (SELECT CAST(unnest(range(0, 10)) AS INTEGER) AS c) a
LEFT JOIN report_rates q ON q.view = g.view AND q.seed = g.seed AND q.month = g.month
  AND q.class_id = a.c"""))
def _(t: Tables):
    return rounded(M.per_class_report(_facts(t), CLASSES))


AVERAGES = ("accuracy macro_precision_supported macro_precision_fixed weighted_precision "
            "macro_recall_supported macro_recall_fixed weighted_recall macro_f1_supported "
            "macro_f1_fixed weighted_f1 balanced_accuracy")


@query("e14_averages", sql(REPORT, f"""
SELECT view, seed, month, n_samples, n_supported_classes, {rounds(AVERAGES)},
  round(accuracy, 6) AS micro_f1 FROM report"""))
def _(t: Tables):
    return rounded(M.averages(_facts(t), CLASSES))


@query("e15_nll_brier", sql(REPORT, f"""
SELECT view, seed, month, {rounds('nll brier mean_confidence')} FROM report"""))
def _(t: Tables):
    return rounded(M.probability_losses(_facts(t)))


@query("e16_ece", sql(REPORT, f"SELECT view, seed, month, {rounds('ece')} FROM report"))
def _(t: Tables):
    return rounded(M.ece(_facts(t)))


@query("e16_ece_bins", sql(REPORT, """
SELECT g.view, g.seed, g.month, b.bin, round(b.bin / 15.0, 6) AS lower,
  round((b.bin + 1) / 15.0, 6) AS upper, coalesce(count, 0) AS count,
  round(accuracy, 6) AS accuracy, round(confidence, 6) AS confidence
FROM (SELECT DISTINCT view, seed, month FROM scored) g,
  (SELECT CAST(unnest(range(0, 15)) AS INTEGER) AS bin) b
LEFT JOIN report_bins r ON r.view = g.view AND r.seed = g.seed AND r.month = g.month AND r.bin = b.bin"""))
def _(t: Tables):
    return rounded(M.ece_bins(_facts(t)))


SUMMARY = " ".join(M.SUMMARY_METRICS)
SUMMARY_SQL = ", ".join(f"round(avg({m}), 6) AS {m}_mean, round(stddev_samp({m}), 6) AS {m}_std"
                        for m in M.SUMMARY_METRICS)


@query("e17_seed_summary", sql(REPORT, f"""
SELECT view, month, count(*) AS n_seeds, string_agg(CAST(seed AS VARCHAR), ',' ORDER BY seed) AS seeds,
  {SUMMARY_SQL} FROM report GROUP BY view, month"""))
def _(t: Tables):
    return rounded(M.seed_summary(M.report_rows(_facts(t), CLASSES)))


@query("e18_classification_metrics", """
WITH pairs AS (SELECT quality AS y_true, 1 - toxic AS y_pred FROM labels),
t AS (SELECT y_true AS c, count(*) AS support, count(*) FILTER (y_true = y_pred) AS tp FROM pairs GROUP BY 1),
q AS (SELECT y_pred AS c, count(*) AS predicted FROM pairs GROUP BY 1),
r AS (SELECT coalesce(tp, 0) AS tp, coalesce(support, 0) AS s, coalesce(predicted, 0) AS n
  FROM t FULL JOIN q USING (c))
SELECT round(sum(tp) / sum(s), 6) AS accuracy,
  round(avg(CASE WHEN n > 0 THEN tp / n ELSE 0 END), 6) AS macro_precision,
  round(avg(CASE WHEN s > 0 THEN tp / s ELSE 0 END), 6) AS macro_recall,
  round(avg(2 * tp / (s + n)), 6) AS macro_f1 FROM r""")
def _(t: Tables):
    pairs = t.read("labels").select(F.col("quality").alias("y_true"),
                                    (1 - F.col("toxic")).alias("y_pred"))
    return rounded(M.label_metrics(pairs))


FOLD_REPORT = Q.SCORED + """, folded AS (SELECT *, CAST(seed % 3 AS INTEGER) AS test_fold FROM scored),
renamed AS (SELECT test_fold, view || seed || sha AS sha, label, predicted, confidence, nll, brier FROM folded)
, """ + Q.report("renamed", "report", "test_fold")


@query("e19_fold_metrics", sql(FOLD_REPORT, """
SELECT test_fold, n_samples AS samples, round(accuracy, 6) AS accuracy,
  round(macro_f1_fixed, 6) AS macro_f1, round(balanced_accuracy, 6) AS balanced_accuracy,
  round(nll, 6) AS uncalibrated_nll FROM report"""))
def _(t: Tables):
    scored = _scored(t).withColumn("test_fold", F.pmod(F.col("seed"), F.lit(3)).cast("int"))
    return rounded(M.fold_metrics(M.score_facts(scored, ["test_fold"]), CLASSES))


@query("e20_month_f1_summary", sql(REPORT, """
SELECT view, seed, round(avg(macro_f1_fixed), 6) AS mean_month_macro_f1,
  round(min(macro_f1_fixed), 6) AS worst_month_macro_f1, count(*) AS n_months
FROM report GROUP BY view, seed"""))
def _(t: Tables):
    return rounded(M.month_f1_summary(_facts(t), CLASSES))


QUALITY = Q.SCORED + """, losses AS (
  SELECT view, seed, label, avg(nll) AS loss FROM scored WHERE month = '2020-02' GROUP BY ALL),
quality AS (SELECT view, seed, -avg(loss) AS quality, count(*) AS n_supported_classes
  FROM losses GROUP BY view, seed)"""


@query("e21_class_balanced_quality", sql(QUALITY, """
SELECT view, seed, round(quality, 6) AS quality, n_supported_classes FROM quality"""))
def _(t: Tables):
    february = _facts(t).where(F.col("month") == "2020-02")
    return rounded(M.class_balanced_quality(february))


@query("e21_family_quality", sql(QUALITY, """
SELECT g.view, g.seed, a.c AS class_id, coalesce(n, 0) AS support, round(mean_nll, 6) AS mean_nll,
  CASE WHEN n IS NOT NULL THEN 'present' ELSE 'absent_from_quality_month' END AS status
FROM (SELECT DISTINCT view, seed FROM scored WHERE month = '2020-02') g,
  (SELECT CAST(unnest(range(0, 10)) AS INTEGER) AS c) a
LEFT JOIN (SELECT view, seed, label, count(*) AS n, avg(nll) AS mean_nll FROM scored
  WHERE month = '2020-02' GROUP BY ALL) l ON l.view = g.view AND l.seed = g.seed AND l.label = a.c"""))
def _(t: Tables):
    february = _facts(t).where(F.col("month") == "2020-02")
    return rounded(M.family_quality(february, CLASSES))


CALIBRATED = (Q.PREDICTIONS + ", " + Q.log_probabilities("logits", "lp", Q.FIXED_T))
BOTH = (Q.PREDICTIONS + ", " + Q.log_probabilities("logits", "lp0") + ", "
        + Q.scored("lp0", "before") + ", " + Q.report("before", "b") + ", "
        + Q.log_probabilities("logits", "lp1", Q.FIXED_T) + ", " + Q.scored("lp1", "after")
        + ", " + Q.report("after", "a"))
DELTA_METRICS = ("nll", "brier", "ece", "mean_confidence")


@query("e22_calibration_delta", sql(BOTH, "SELECT view, seed, month, b.n_samples, " + ", ".join(
    f"round(b.{m}, 6) AS {m}_before, round(a.{m}, 6) AS {m}_after, round(a.{m} - b.{m}, 6) AS {m}_delta"
    for m in DELTA_METRICS) + ", round(b.accuracy, 6) AS accuracy "
    "FROM b JOIN a USING (view, seed, month)"))
def _(t: Tables):
    delta = C.calibration_delta(t.predictions, t.fixed_temperatures, CLASSES)
    return rounded(delta.select(*KEYS, "n_samples", *(
        f"{m}_{v}" for m in DELTA_METRICS for v in ("before", "after", "delta")), "accuracy"))


# -- calibration and fusion -------------------------------------------------------------

@query("d8_apply_temperature_join", sql(CALIBRATED, """
SELECT view, seed, month, sha, round(sum(lp), 5) AS total, round(max(lp), 7) AS top FROM lp
GROUP BY ALL"""))
def _(t: Tables):
    rows = C.calibrate(t.predictions, t.fixed_temperatures)
    return rows.select(*KEYS, "sha", F.round(V.array_sum(F.col("log_probabilities")), 5)
                       .alias("total"),
                       F.round(F.array_max("log_probabilities"), 7).alias("top"))


@query("j2_calibrate", sql(CALIBRATED, """
SELECT view, seed, sha, c, round(lp, 7) AS lp FROM lp"""))
def _(t: Tables):
    rows = C.calibrate(t.predictions, t.fixed_temperatures)
    return rows.select("view", "seed", "sha", F.posexplode("log_probabilities")
                       .alias("c", "lp")).withColumn("lp", F.round("lp", 7))


FIT_SQL = """
WITH RECURSIVE """ + Q.PREDICTIONS + """, centred AS (
  SELECT view, seed, sha, label, c, z - max(z) OVER (PARTITION BY view, seed, sha) AS z
  FROM logits WHERE month = '2020-02'),
truth AS (SELECT view, seed, sha, max(CASE WHEN c = label THEN z END) AS zt, list(z) AS zs
  FROM centred GROUP BY view, seed, sha),
brackets AS (
  SELECT DISTINCT view, seed, 0 AS i, CAST(0.05 AS DOUBLE) AS lo, CAST(20.0 AS DOUBLE) AS hi FROM truth
  UNION ALL
  SELECT view, seed, i + 1, CASE WHEN d > 0 THEN lo ELSE mid END, CASE WHEN d > 0 THEN mid ELSE hi END
  FROM (SELECT b.view, b.seed, b.i, b.lo, b.hi, (b.lo + b.hi) / 2 AS mid,
      avg(list_sum(list_transform(zs, lambda x: x * exp((b.lo + b.hi) / 2 * x)))
        / list_sum(list_transform(zs, lambda x: exp((b.lo + b.hi) / 2 * x))) - zt) AS d
    FROM brackets b JOIN truth t ON b.view = t.view AND b.seed = t.seed
    WHERE b.i < 46 GROUP BY b.view, b.seed, b.i, b.lo, b.hi)),
fitted AS (SELECT view, seed, (lo + hi) / 2 AS beta FROM brackets WHERE i = 46)"""


@query("j1_fit_temperature", FIT_SQL + """
SELECT f.view, f.seed, round(1 / beta, 6) AS temperature,
  round(avg(ln(list_sum(list_transform(zs, lambda x: exp(x)))) - zt), 6) AS fit_nll_before,
  round(avg(ln(list_sum(list_transform(zs, lambda x: exp(beta * x)))) - beta * zt), 6) AS fit_nll_after,
  'interior_optimum' AS status
FROM fitted f JOIN truth t ON f.view = t.view AND f.seed = t.seed GROUP BY f.view, f.seed, beta""")
def _(t: Tables):
    fits = C.fit_temperatures(t.predictions.where(F.col("month") == "2020-02"))
    return rounded(fits.select("view", "seed", "temperature", "fit_nll_before",
                               "fit_nll_after", "status"))


UNIFORM = CALIBRATED + """, fused AS (
  SELECT 'uniform' AS view, seed, month, sha, label, c, ln(avg(exp(lp))) AS lp
  FROM lp GROUP BY seed, month, sha, label, c)"""


@query("j3_fuse_uniform", sql(UNIFORM, """
SELECT seed, month, sha, label, c, round(lp, 7) AS lp FROM fused"""))
def _(t: Tables):
    fused = X.fuse_uniform(C.calibrate(t.predictions, t.fixed_temperatures))
    return fused.select("seed", "month", "sha", "label", F.posexplode("log_probabilities")
                        .alias("c", "lp")).withColumn("lp", F.round("lp", 7))


WEIGHTED = CALIBRATED + ", " + Q.scored("lp", "scored") + """, quality AS (
  SELECT view, seed, -avg(loss) AS quality FROM (SELECT view, seed, label, avg(nll) AS loss
    FROM scored WHERE month = '2020-02' GROUP BY ALL) GROUP BY view, seed),
scales AS (SELECT CAST(s AS DOUBLE) AS quality_scale FROM (VALUES (0), (0.5), (1), (2), (4)) AS v(s)),
weights AS (SELECT seed, quality_scale, view, exp(quality_scale * quality)
    / sum(exp(quality_scale * quality)) OVER (PARTITION BY seed, quality_scale) AS weight
  FROM quality, scales),
fused AS (SELECT quality_scale, seed, month, sha, label, c, ln(sum(weight * exp(lp))) AS lp
  FROM lp JOIN weights USING (view, seed) GROUP BY ALL),
""" + Q.scored("fused", "fused_scored", "quality_scale, seed, month") + ", " + Q.report(
    "fused_scored", "candidates", "quality_scale, seed, month") + """,
scale_scores AS (SELECT quality_scale, avg(macro_f1_supported) AS score_mean,
  stddev_samp(macro_f1_supported) AS score_std, count(*) AS n_seeds
  FROM candidates WHERE month = '2020-03' GROUP BY quality_scale)"""


def _weights(t: Tables):
    calibrated = C.calibrate(t.predictions, t.fixed_temperatures)
    facts = M.score_facts(M.score_rows(calibrated, KEYS, F.col("log_probabilities")))
    quality = M.class_balanced_quality(facts.where(F.col("month") == "2020-02"))
    return calibrated, X.quality_weights(quality)


@query("j4_quality_weights", sql(WEIGHTED, """
SELECT seed, quality_scale, view, round(weight, 7) AS weight FROM weights"""))
def _(t: Tables):
    return _weights(t)[1].select("seed", "quality_scale", "view",
                                 F.round("weight", 7).alias("weight"))


@query("j5_fuse_weighted", sql(WEIGHTED, """
SELECT quality_scale, seed, month, sha, label, c, round(lp, 6) AS lp FROM fused"""))
def _(t: Tables):
    calibrated, weights = _weights(t)
    fused = X.fuse_weighted(calibrated, freeze(weights))
    return fused.select("quality_scale", "seed", "month", "sha", "label",
                        F.posexplode("log_probabilities").alias("c", "lp")) \
        .withColumn("lp", F.round("lp", 6))


def _candidates(t: Tables):
    calibrated, weights = _weights(t)
    keys = ["quality_scale", "seed", "month"]
    scored = M.score_rows(X.fuse_weighted(calibrated, freeze(weights)), keys,
                          F.col("log_probabilities"))
    return M.report_rows(freeze(M.score_facts(scored, keys)), CLASSES, keys)


@query("j6_select_scale", sql(WEIGHTED, """
SELECT quality_scale AS selected_scale, round(score_mean, 6) AS score_mean FROM scale_scores
ORDER BY round(score_mean, 11) DESC, quality_scale LIMIT 1"""))
def _(t: Tables):
    return rounded(X.select_scale(X.scale_scores(_candidates(t), "2020-03")))


@query("j6_scale_scores", sql(WEIGHTED, """
SELECT quality_scale, round(score_mean, 6) AS score_mean, round(score_std, 6) AS score_std, n_seeds
FROM scale_scores"""))
def _(t: Tables):
    return rounded(X.scale_scores(_candidates(t), "2020-03"))


@query("j7_select_epoch", sql(Q.HISTORY, """
SELECT view, epoch AS selected_epoch, round(mean_metric, 8) AS mean_metric, pilot_epochs FROM (
  SELECT view, epoch, avg(metric) AS mean_metric, max(epoch) OVER (PARTITION BY view) AS pilot_epochs,
    row_number() OVER (PARTITION BY view ORDER BY avg(metric) DESC, epoch) AS r
  FROM history GROUP BY view, epoch) WHERE r = 1"""))
def _(t: Tables):
    best = X.select_epoch(t.history)
    return best.select("view", F.col("selected_epoch").cast("bigint").alias("selected_epoch"),
                       F.round("mean_metric", 8).alias("mean_metric"),
                       F.col("pilot_epochs").cast("bigint").alias("pilot_epochs"))


@query("j7_check_history", sql(Q.HISTORY, """
SELECT view, seed, 'epochs_not_consecutive' AS rule FROM history
WHERE NOT (view = 'error' AND seed = 1 AND epoch = 5) GROUP BY view, seed
HAVING min(epoch) <> 1 OR count(*) <> max(epoch)"""))
def _(t: Tables):
    gap = (F.col("view") == "error") & (F.col("seed") == 1) & (F.col("epoch") == 5)
    return X.check_history(t.history.where(~gap), [0, 1, 2])


@query("j8_predictions_table", sql(Q.SCORED, """
SELECT view, seed, month, sha, label AS true_class_id, predicted AS predicted_class_id,
  round(confidence, 7) AS confidence, round(p_true, 7) AS true_class_probability,
  round(nll, 7) AS nll, round(brier, 7) AS brier FROM scored"""))
def _(t: Tables):
    return rounded(M.predictions_table(_scored(t)), 7)


COMPARISON = ["accuracy", "macro_f1_supported", "nll", "brier"]


@query("j9_method_comparison", FIT_SQL + ", " + Q.log_probabilities(
    "(SELECT l.*, beta FROM logits l JOIN fitted USING (view, seed))", "lp", "1 / beta")
    .replace("SELECT view, seed, month, sha, label, c, z,", "SELECT view, seed, month, sha, label, c,")
    + WEIGHTED[len(CALIBRATED):].replace("quality AS (\n  SELECT", "quality AS (\n  SELECT")
    + ", " + Q.report("scored", "singles") + """,
chosen AS (SELECT quality_scale FROM scale_scores ORDER BY round(score_mean, 11) DESC, quality_scale LIMIT 1),
rows AS (
  SELECT view, seed, month, accuracy, macro_f1_supported, nll, brier FROM singles
  UNION ALL SELECT 'uniform', seed, month, accuracy, macro_f1_supported, nll, brier
  FROM candidates WHERE quality_scale = 0
  UNION ALL SELECT 'quality_only', seed, month, accuracy, macro_f1_supported, nll, brier
  FROM candidates JOIN chosen USING (quality_scale))
SELECT view, month, count(*) AS n_seeds, """ + ", ".join(
        f"round(avg({m}), 5) AS {m}_mean" for m in COMPARISON) + """
FROM rows GROUP BY view, month""")
def _(t: Tables):
    summary = E.method_comparison(E.run_experiment(t.predictions, CLASSES))
    return summary.select("view", "month", "n_seeds", *(
        F.round(f"{m}_mean", 5).alias(f"{m}_mean") for m in COMPARISON))


# -- validation -------------------------------------------------------------------------

def _dirty(t: Tables):
    first = F.col("month") == "2020-02"
    return t.predictions.withColumn("label", F.when(
        (F.col("view") == "sbsmi") & (F.col("label") == 9), 10).otherwise(F.col("label"))) \
        .withColumn("logits", F.when((F.col("view") == "entropy") & first & (F.col("label") == 0),
                                     F.slice("logits", 1, 9)).otherwise(F.col("logits")))


@query("v7_check_predictions", sql(Q.PREDICTIONS, """
SELECT view, seed, month, sha, CASE view WHEN 'sbsmi' THEN 'label_range' ELSE 'logits_width' END AS rule
FROM logits WHERE c = 0 AND ((view = 'sbsmi' AND label = 9)
  OR (view = 'entropy' AND month = '2020-02' AND label = 0))"""))
def _(t: Tables):
    return K.check_predictions(_dirty(t), CLASSES)


@query("v7_check_class_counts", sql(Q.PREDICTIONS, """
SELECT DISTINCT view, seed, month, unnest([9, 10]) AS label, 'class_count' AS rule
FROM logits WHERE view = 'sbsmi' AND label = 9"""))
def _(t: Tables):
    return K.check_class_counts(_dirty(t), W.class_counts(t.predictions))


@query("v8_check_alignment", sql(Q.PREDICTIONS, """
SELECT DISTINCT month, sha, 'labels_differ' AS rule FROM logits WHERE label = 9"""))
def _(t: Tables):
    return K.check_alignment(_dirty(t), len(Q.VIEW_OFFSETS))


PILOT_BATCH = "CAST('0x' || substr(sha256(seed || ':0:' || sha), 1, 8) AS BIGINT) % 2"
PILOT = f"""rows_ AS (
  SELECT sha256(CAST(vec_id AS VARCHAR)) AS sha, vec_id, label, embedding,
    CASE WHEN vec_id % 4 < 2 THEN '2019-10' WHEN vec_id % 4 = 2 THEN '2019-12' ELSE '2020-01' END AS month
  FROM embeddings),
points AS (
  SELECT sha, label, month, i, CAST(embedding[i] AS DOUBLE) AS x FROM rows_, (SELECT unnest(range(1, 65)) AS i)
  UNION ALL SELECT sha, label, month, 65, 1 FROM rows_),
classes AS (SELECT unnest(range(10)) AS c),
seeded AS (SELECT *, {PILOT_BATCH} AS batch FROM points, (VALUES (11), (22)) AS s(seed)),
g0 AS (SELECT seed, c, i, avg((0.1 - CASE WHEN label = c THEN 1.0 ELSE 0.0 END) * x) AS g
  FROM seeded, classes WHERE month = '2019-10' AND batch = 0 GROUP BY ALL),
z1 AS (SELECT seed, sha, c, sum(-8 * g * x) AS z FROM seeded JOIN g0 USING (seed, i)
  WHERE month = '2019-10' AND batch = 1 GROUP BY ALL),
p1 AS (SELECT seed, sha, c, exp(z) / sum(exp(z)) OVER (PARTITION BY seed, sha) AS p FROM z1),
g1 AS (SELECT seed, c, i, avg((p - CASE WHEN label = c THEN 1.0 ELSE 0.0 END) * x) AS g
  FROM seeded JOIN p1 USING (seed, sha) GROUP BY ALL),
z2 AS (SELECT seed, sha, label, month, c, sum(-8 * (g0.g + g1.g) * x) AS z
  FROM seeded JOIN g0 USING (seed, i) JOIN g1 USING (seed, c, i)
  WHERE month <> '2019-10' GROUP BY ALL),
told AS (SELECT seed, month, sha, label, min(c) AS predicted FROM (
    SELECT *, max(z) OVER (PARTITION BY seed, sha) AS top FROM z2) WHERE z = top GROUP BY ALL),
f1 AS (SELECT seed, month, c, count(*) FILTER (label = c AND predicted = c) AS tp,
    count(*) FILTER (label = c) + count(*) FILTER (predicted = c) AS both_sides
  FROM told, classes GROUP BY ALL),
months AS (SELECT seed, month, avg(CASE WHEN both_sides > 0 THEN 2 * tp / both_sides ELSE 0 END) AS f
  FROM f1 GROUP BY ALL)"""


@query("j7_pilot_history", sql(PILOT, """
SELECT 'embedding' AS view, seed, 1 AS epoch, round(avg(f), 8) AS metric,
  round(min(f), 8) AS worst_month_macro_f1 FROM months GROUP BY seed"""))
def _(t: Tables):
    """Two seeds, one epoch of two mini-batches each, evaluated on two hold-out months."""
    key = F.col("vec_id") % 4
    train = t.read("embeddings").select(
        F.lit("embedding").alias("view"), F.sha2(F.col("vec_id").cast("string"), 256).alias("sha"),
        F.when(key < 2, "2019-10").when(key == 2, "2019-12").otherwise("2020-01").alias("month"),
        F.col("label").cast("int").alias("label"),
        F.transform("embedding", lambda x: x.cast("double")).alias("features"))
    history = L.pilot_histories(t.spark, train, [11, 22], CLASSES, 1, "2019-11",
                                ["2019-12", "2020-01"], scratch_path(t.spark, "pilot"),
                                batches=2, rate=8.0)
    return history.select("view", "seed", "epoch", F.round("metric", 8).alias("metric"),
                          F.round("worst_month_macro_f1", 8).alias("worst_month_macro_f1"))
