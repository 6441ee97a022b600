"""Tables stored by sample."""

from pyspark.sql import functions as F

from chronoview.operators import fusion as X
from chronoview.operators import validate as K
from chronoview.sources import aligned as D

SCHEMA = ("view string, seed int, month string, sha string, label int, logits array<double>")


def scores(rows, view, n=60):
    return rows([(view, 11, "2020-02", f"{i:064x}", i % 2, [float(i % 3), 1.0]) for i in range(n)],
                SCHEMA)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_joins_and_groupings_by_sample_plan_no_exchange(spark, rows, tmp_path):
    for view in ("raw_byte", "entropy"):
        D.write_aligned(scores(rows, view), str(tmp_path / view), 4)
    left, right = (D.scan_aligned(spark, str(tmp_path / v)) for v in ("raw_byte", "entropy"))
    joined = left.join(right.select("sha", F.col("logits").alias("other")).hint("merge"), "sha")
    assert "Exchange" not in plan(joined) and "Bucketed: true" in plan(joined)
    assert joined.count() == 60
    again = left.select("sha", "month", "label").groupBy("month", "sha").count()
    assert "Exchange" not in plan(again) and again.count() == 60
    per_sample = K.check_alignment(left, 1)
    assert "Exchange" not in plan(per_sample) and per_sample.isEmpty()


def test_layout_is_kept_and_rows_come_back(spark, rows, tmp_path):
    frame = scores(rows, "sbsmi")
    D.write_aligned(frame, str(tmp_path / "t"), 3)
    back = D.scan_aligned(spark, str(tmp_path / "t"))
    assert back.schema.simpleString() == frame.schema.simpleString()
    assert sorted(map(str, back.collect())) == sorted(map(str, frame.collect()))
    files = list((tmp_path / "t" / "rows").glob("*.parquet"))
    assert len(files) == 3  # one per bucket
    assert X is not None
