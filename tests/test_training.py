"""Many models in the same passes."""

import numpy as np
import pytest

from chronoview.errors import ContractViolation
from chronoview.operators import training

SCHEMA = "sha string, features array<double>, label int, fits array<int>, tests array<int>"


def table(rows, n=120, width=4, classes=3, models=4, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(0, 1, (n, width))
    label = (x @ rng.normal(0, 2, (width, classes)) + rng.normal(0, 1, (n, classes))).argmax(axis=1)
    data = [(f"s{i}", x[i].tolist(), int(label[i]), [m for m in range(models) if m != i % models],
             [i % models]) for i in range(n)]
    return rows(data, SCHEMA).repartition(5), x, label


def direct(x, label, weights, use):
    """Mean loss and gradient of one model, from the definition."""
    x1 = np.concatenate([x, np.ones((len(x), 1))], axis=1)[use]
    z = x1 @ weights.T
    p = np.exp(z - z.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    own = label[use]
    loss = -np.log(p[np.arange(len(own)), own]).mean()
    p[np.arange(len(own)), own] -= 1
    return loss, p.T @ x1 / len(own)


def test_gradients_of_all_models_in_one_pass(spark, rows):
    frame, x, label = table(rows)
    weights = np.random.default_rng(1).normal(0, 1, (5, 3, 5))
    jobs = spark.sparkContext.statusTracker()
    n, loss, gradient = training.gradients(frame, weights)
    assert n.tolist() == [90] * 4 + [0] and jobs is not None
    for m in range(4):
        want = direct(x, label, weights[m], np.arange(len(x)) % 4 != m)
        assert loss[m] == pytest.approx(want[0], rel=1e-12)
        np.testing.assert_allclose(gradient[m], want[1], atol=1e-12)
    assert not gradient[4].any()


def test_many_models_equal_single_ones(spark, rows, tmp_path):
    frame, x, label = table(rows)
    frame.write.parquet(str(tmp_path / "rows"))
    stored = spark.read.parquet(str(tmp_path / "rows"))
    together, passes = training.fit_many(stored, 4, 3, reg_param=0.05, max_iter=60)
    single = []
    for m in (0, 3):
        alone = stored.selectExpr("features", "label", f"array_repeat(0, int(array_contains(fits, {m}))) AS fits")
        weights, own = training.fit_many(alone, 1, 3, reg_param=0.05, max_iter=60)
        np.testing.assert_allclose(together[m], weights[0], atol=1e-6)
        single.append(own)
        _, slope = direct(x, label, weights[0], np.arange(len(x)) % 4 != m)
        slope[:, :-1] += 0.05 * weights[0][:, :-1]
        assert np.abs(slope).max() < 1e-6
    assert passes <= max(single) + 5 and passes < 60


def test_rows_are_scored_by_the_models_they_name(spark, rows):
    frame, x, _ = table(rows, n=30)
    weights = np.random.default_rng(2).normal(0, 1, (4, 3, 5))
    got = training.score_many(frame, weights, "sha").collect()
    assert len(got) == 30
    for r in got:
        i = int(r.sha[1:])
        assert r.model == i % 4
        np.testing.assert_allclose(r.logits, weights[i % 4] @ [*x[i], 1], atol=1e-12)


def test_refusals(spark, rows):
    with pytest.raises(ContractViolation, match="no rows"):
        training.fit_many(rows([], SCHEMA), 2, 3)
    frame, _, _ = table(rows, n=4)
    with pytest.raises(ContractViolation, match="more than"):
        training.fit_many(frame, 1 << 20, 1 << 10)
