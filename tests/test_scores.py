"""Metrics, calibration, fusion and selection against NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoview.errors import ContractViolation
from chronoview.functions import vectors as V
from chronoview.operators import calibration as C
from chronoview.operators import fusion as X
from chronoview.operators import metrics as M
from chronoview.operators import validate as K
from chronoview.plans import experiment as E

CLASSES = 4
SCHEMA = "view string, seed int, month string, sha string, label int, logits array<double>"


def sha(i):
    from hashlib import sha256
    return sha256(str(i).encode()).hexdigest()


@pytest.fixture(scope="module")
def data():
    """Two seeds, three views, two months; class 3 never occurs as truth."""
    rng, rows = np.random.default_rng(7), []
    for month in ("2020-02", "2020-03"):
        labels = rng.integers(0, 3, 40)
        for seed in (11, 22):
            for sharp, view in enumerate(X.VIEWS):
                z = rng.normal(size=(40, CLASSES)) * (1 + sharp)
                z[np.arange(40), labels] += 1.0
                rows += [(view, seed, month, sha(f"{month}{i}"), int(labels[i]), z[i].tolist())
                         for i in range(40)]
    return rows


@pytest.fixture(scope="module")
def predictions(spark, data):
    return spark.createDataFrame(data, SCHEMA).cache()


def arrays(data, view, seed, month):
    part = [r for r in data if r[:3] == (view, seed, month)]
    return np.array([r[5] for r in part]), np.array([r[4] for r in part])


def softmax(z):
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def bisect(z, y):
    z = z - z.max(axis=1, keepdims=True)
    true = z[np.arange(len(y)), y]
    low, high = 1 / 20, 1 / 0.05
    for _ in range(80):
        mid = (low + high) / 2
        p = softmax(mid * z)
        if ((p * z).sum(axis=1) - true).mean() > 0:
            high = mid
        else:
            low = mid
    return 2 / (low + high)


def f1_macro(y, p, classes):
    scores = []
    for c in classes:
        tp = ((y == c) & (p == c)).sum()
        scores.append(2 * tp / max(1, (y == c).sum() + (p == c).sum()))
    return float(np.mean(scores))


def test_label_metric_goldens(rows):
    frame = rows(list(zip([0, 0, 1, 1], [0, 1, 1, 1])), "y_true int, y_pred int")
    got = M.label_metrics(frame).first()
    assert np.allclose([got.accuracy, got.macro_precision, got.macro_recall, got.macro_f1],
                       [0.75, 5 / 6, 0.75, 11 / 15])
    fixed = M.label_metrics(frame, labels=[0, 1, 2]).first()
    assert np.isclose(fixed.macro_f1, 22 / 45)


def test_argmax_takes_the_first(rows):
    frame = rows([([1.0, 3.0, 3.0],)], "a array<double>")
    assert frame.select(V.argmax(F.col("a"))).first()[0] == 1


def test_log_softmax_is_stable(rows):
    frame = rows([([1e4, 0.0, -1e4],)], "a array<double>")
    assert frame.select(V.log_softmax(F.col("a"))).first()[0] == [0.0, -1e4, -2e4]


def test_report(predictions, data):
    facts = M.score_facts(M.score_rows(predictions))
    got = {(r.view, r.seed, r.month): r for r in M.report_rows(facts, CLASSES).collect()}
    assert len(got) == 12
    for key, row in got.items():
        z, y = arrays(data, *key)
        p, hit = softmax(z), None
        predicted = z.argmax(axis=1)
        hit, conf = predicted == y, p.max(axis=1)
        bins = np.minimum((conf * 15).astype(int), 14)
        ece = sum((bins == b).mean() * abs(hit[bins == b].mean() - conf[bins == b].mean())
                  for b in set(bins))
        true = p[np.arange(len(y)), y]
        assert np.isclose(row.accuracy, hit.mean()) and np.isclose(row.ece, ece)
        assert np.isclose(row.nll, -np.log(true).mean())
        assert np.isclose(row.brier, ((p ** 2).sum(axis=1) - 2 * true + 1).mean())
        assert np.isclose(row.macro_f1_supported, f1_macro(y, predicted, sorted(set(y))))
        assert np.isclose(row.macro_f1_fixed, f1_macro(y, predicted, range(CLASSES)))
    absent = M.per_class_report(facts, CLASSES).where("class_id = 3").first()
    assert absent.status == "absent_this_month" and absent.recall is None


def test_temperatures_match_bisection(predictions, data):
    fits = C.fit_temperatures(predictions.where("month = '2020-02'")).collect()
    assert len(fits) == 6
    for fit in fits:
        want = bisect(*arrays(data, fit.view, fit.seed, "2020-02"))
        assert abs(fit.temperature - want) < 1e-8 and fit.status == "interior_optimum"
        assert fit.fit_nll_after <= fit.fit_nll_before


@pytest.mark.parametrize("logits, labels, status, temperature", [
    ([[5.0, 0.0], [0.0, 5.0]], [0, 1], "minimum_temperature_bound", 0.05),
    ([[5.0, 0.0], [0.0, 5.0]], [1, 0], "maximum_temperature_bound", 20.0),
    ([[0.0, 0.0], [0.0, 0.0]], [0, 1], "no_nll_improvement_keep_T1", 1.0)])
def test_temperature_bounds(rows, logits, labels, status, temperature):
    frame = rows([("v", 1, "m", sha(i), y, z) for i, (y, z) in enumerate(zip(labels, logits))], SCHEMA)
    fit = C.fit_temperatures(frame).first()
    assert fit.status == status and np.isclose(fit.temperature, temperature)
    with pytest.raises(ValueError):
        C.fit_temperatures(frame, 2.0, 20.0)


@pytest.mark.parametrize("logits, label", [([float("nan"), 0.0], 0), ([1.0, 0.0], 2),
                                           ([float("inf"), 0.0], 0), (None, 0)])
def test_bad_scores_fit_no_temperature(rows, logits, label):
    frame = rows([("v", 1, "m", sha(0), label, logits), ("v", 1, "m", sha(1), 0, [1.0, 0.0])],
                 SCHEMA)
    with pytest.raises(ContractViolation):
        C.fit_temperatures(frame)


def test_no_scores_fit_no_temperature(predictions):
    with pytest.raises(ContractViolation, match="no predictions"):
        C.fit_temperatures(predictions.where("month = 'none'"))


def test_scaling_keeps_predictions(predictions):
    fits = C.fit_temperatures(predictions.where("month = '2020-02'"))
    assert C.changed_predictions(predictions, fits).isEmpty()


def test_experiment(predictions, data):
    result = E.run_experiment(predictions, CLASSES)
    temperature = {(r.view, r.seed): r.temperature for r in result.temperatures.collect()}
    probability, quality = {}, {}
    for seed in (11, 22):
        for view in X.VIEWS:
            for month in ("2020-02", "2020-03"):
                z, y = arrays(data, view, seed, month)
                probability[view, seed, month] = softmax(z / temperature[view, seed])
            p, y = probability[view, seed, "2020-02"], arrays(data, view, seed, "2020-02")[1]
            loss = -np.log(p[np.arange(len(y)), y])
            quality[view, seed] = -np.mean([loss[y == c].mean() for c in sorted(set(y))])
    got = {(r.view, r.seed): r.quality for r in result.qualities.collect()}
    assert all(np.isclose(got[k], quality[k]) for k in quality)
    means = []
    for scale in X.QUALITY_SCALES:
        scores = []
        for seed in (11, 22):
            q = np.array([scale * quality[v, seed] for v in X.VIEWS])
            w = np.exp(q - q.max()) / np.exp(q - q.max()).sum()
            fused = sum(wi * probability[v, seed, "2020-03"] for wi, v in zip(w, X.VIEWS))
            y = arrays(data, X.VIEWS[0], seed, "2020-03")[1]
            scores.append(f1_macro(y, fused.argmax(axis=1), sorted(set(y))))
        means.append(np.mean(scores))
    best = 0
    for i, score in enumerate(means):
        if score > means[best] + 1e-12:
            best = i
    chosen = result.selection.first()
    assert chosen.selected_scale == X.QUALITY_SCALES[best]
    assert np.isclose(chosen.score_mean, means[best])
    table = {(r.view, r.month): r for r in E.method_comparison(result).collect()}
    assert len(table) == 10 and all(r.n_seeds == 2 and r.seeds == "11,22" for r in table.values())


def test_fusion_never_uses_the_selection_month_to_fit(predictions):
    changed = predictions.withColumn("label", F.when(
        F.col("month") == "2020-03", F.pmod(F.col("label") + 1, F.lit(3))).otherwise(F.col("label")))
    one = E.run_experiment(predictions, CLASSES, check=False)
    two = E.run_experiment(changed, CLASSES, check=False)
    for frame in ("temperatures", "qualities", "weights"):
        a, b = getattr(one, frame), getattr(two, frame)
        assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_misaligned_predictions_are_refused(predictions):
    short = predictions.where(f"NOT (view = 'sbsmi' AND seed = 11 AND sha = '{sha('2020-020')}')")
    with pytest.raises(ContractViolation):
        E.run_experiment(short, CLASSES)
    assert {r.rule for r in K.check_alignment(short, 6).collect()} == {"not_scored_by_every_model"}


def test_absent_models_are_refused(predictions):
    gone = predictions.where("NOT (view = 'entropy' AND seed = 22)")
    with pytest.raises(ContractViolation, match="prediction grid"):
        E.run_experiment(gone, CLASSES)
    both = predictions.where("seed <> 22")
    with pytest.raises(ContractViolation, match="scores_missing"):
        E.run_experiment(both, CLASSES, seeds=[11, 22])
    late = predictions.where("NOT (view = 'sbsmi' AND seed = 11 AND month = '2020-02')")
    with pytest.raises(ContractViolation, match="prediction grid"):
        E.run_experiment(late, CLASSES)


def test_scale_ties_prefer_the_smaller(rows):
    scores = rows([(0.0, 0.5), (1.0, 0.5 + 5e-13), (2.0, 0.4)], "quality_scale double, score_mean double")
    assert X.select_scale(scores).first().selected_scale == 0.0
    clear = rows([(0.0, 0.5), (1.0, 0.6), (2.0, 0.6)], "quality_scale double, score_mean double")
    assert X.select_scale(clear).first().selected_scale == 1.0


def test_epochs(rows):
    history = rows([("v", s, e, m) for s in (1, 2) for e, m in ((1, 0.2), (2, 0.9), (3, 0.9))],
                   "view string, seed int, epoch int, metric double")
    best = X.select_epoch(history).first()
    assert (best.selected_epoch, best.pilot_epochs) == (2, 3)
    assert X.check_history(history, [1, 2]).isEmpty()
    broken = history.where("NOT (seed = 2 AND epoch = 3)")
    assert {r.rule for r in X.check_history(broken, [1, 2]).collect()} == {"run_lengths_differ"}
    assert {r.rule for r in X.check_history(history, [1, 2, 3]).collect()} == {"runs_missing"}


def test_one_seed_has_no_deviation(rows):
    frame = rows([("v", "m", 1, 0.5)], "view string, month string, seed int, nll double")
    row = M.seed_summary(frame, metrics=["nll"]).first()
    assert row.nll_std is None and row.seeds == "1"
