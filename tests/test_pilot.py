"""Pilot training with histories, and its continuation."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoview.errors import ContractViolation
from chronoview.operators import fusion as X
from chronoview.plans import pilot as P

SCHEMA = "view string, sha string, month string, label int, features array<double>"
MONTHS = ["2019-12", "2020-01"]


def table(rows, n=90):
    rng = np.random.default_rng(3)
    data = []
    for view in ("a", "b"):
        x = rng.normal(0, 1, (n, 3))
        label = x.argmax(axis=1)
        data += [(view, f"{i:064x}", ["2019-10", "2019-12", "2020-01"][i % 3], int(label[i]),
                  x[i].tolist()) for i in range(n)]
    return rows(data, SCHEMA)


def run(spark, train, path, epochs=3, **more):
    options = {"batches": 2, "rate": 1.0, **more}
    return P.pilot_histories(spark, train, [11, 22], 3, epochs, "2019-11", MONTHS, path, **options)


def values(history):
    return sorted(tuple(np.round(v, 10) if isinstance(v, float) else v for v in r)
                  for r in history.collect())


def test_histories_feed_the_choice_of_epochs(spark, rows, tmp_path):
    train = table(rows)
    history = run(spark, train, str(tmp_path / "pilot"))
    assert history.count() == 12 and X.check_history(history, [11, 22]).isEmpty()
    best = {r["view"]: r for r in X.select_epoch(history).collect()}
    assert set(best) == {"a", "b"} and all(1 <= r.selected_epoch <= 3 for r in best.values())
    first = {(r.view, r.seed, r.epoch): r for r in history.collect()}
    assert first["a", 11, 3].train_loss < first["a", 11, 1].train_loss
    assert first["a", 11, 3].metric > 0.5
    assert first["a", 11, 1].train_loss != first["a", 22, 1].train_loss
    assert values(run(spark, train, str(tmp_path / "pilot"))) == values(history)


def test_a_pilot_that_dies_goes_on(spark, rows, tmp_path, monkeypatch):
    train = table(rows)
    whole = values(run(spark, train, str(tmp_path / "whole")))
    calls, real = [], P.evaluate

    def dies(*args):
        calls.append(1)
        if len(calls) == 2:
            raise RuntimeError("killed")
        return real(*args)
    monkeypatch.setattr(P, "evaluate", dies)
    path = str(tmp_path / "pilot")
    with pytest.raises(RuntimeError, match="killed"):
        run(spark, train, path)
    assert values(run(spark, train, path)) == whole
    assert len(calls) == 4  # the first epoch was not made again
    with pytest.raises(ContractViolation, match="other inputs or settings"):
        run(spark, train, path, rate=2.0)


def test_hold_out_months_are_checked(spark, rows, tmp_path):
    lacking = table(rows).where(F.col("month") != "2020-01")
    with pytest.raises(ContractViolation, match="missing_month"):
        run(spark, lacking, str(tmp_path / "pilot"))
