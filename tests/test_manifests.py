"""Manifests in buckets: what a merge touches, publishes and refuses."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from chronoview.errors import ContractViolation
from chronoview.sources import manifests as H

SCHEMA = ("sha string, family string, class_id int, split string, month string, timestamp string, "
          "raw_byte_path string, content_sha256 string, config_id string")


def manifest(rows, ids, path="p", month="2019-10"):
    return rows([(f"{i:064x}", "f", 1, "train", month, month, path and f"{path}/{i}", "c" * 64, "k")
                 for i in ids], SCHEMA)


def files(root):
    return {f: f.stat().st_mtime_ns for f in Path(root, "data").rglob("*.parquet")}


def test_only_touched_buckets_are_rewritten(spark, rows, tmp_path):
    root = str(tmp_path / "manifest")
    assert len(H.merge_into(spark, root, manifest(rows, range(40), None), 8)) >= 6
    before = files(root)
    touched = H.merge_into(spark, root, manifest(rows, [3, 100]), 8)
    assert 1 <= len(touched) <= 2
    after = files(root)
    assert {f: after[f] for f in before} == before
    fresh = {int(f.parent.name.removeprefix("bucket=")) for f in after if f not in before}
    assert fresh == set(touched)
    now = {r.sha: r.raw_byte_path for r in H.read_manifest(spark, root).collect()}
    assert len(now) == 41 and now[f"{3:064x}"] == "p/3" and now[f"{4:064x}"] is None
    old = H.read_manifest(spark, root, version=1)
    assert old.count() == 40 and old.where("raw_byte_path IS NOT NULL").isEmpty()
    plan = H.read_manifest(spark, root)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_a_merge_that_dies_is_not_seen(spark, rows, tmp_path):
    """Without the marker of its last job a version does not count."""
    root = str(tmp_path / "manifest")
    H.merge_into(spark, root, manifest(rows, range(10)), 4)
    H.merge_into(spark, root, manifest(rows, [50]), 4)
    (tmp_path / "manifest" / "versions" / "version=2" / "_SUCCESS").unlink()
    assert H.read_manifest(spark, root).count() == 10
    H.merge_into(spark, root, manifest(rows, [50]), 4)
    assert H.read_manifest(spark, root).count() == 11


def test_refusals(spark, rows, tmp_path):
    root = str(tmp_path / "manifest")
    with pytest.raises(ContractViolation, match="no manifest"):
        H.read_manifest(spark, root)
    H.merge_into(spark, root, manifest(rows, range(5)), 4)
    with pytest.raises(ContractViolation, match="month_conflict"):
        H.merge_into(spark, root, manifest(rows, [2], month="2019-11"), 4)
    with pytest.raises(ContractViolation, match="has 4 buckets"):
        H.merge_into(spark, root, manifest(rows, [9]), 8)
    twice = manifest(rows, [7]).unionByName(manifest(rows, [7]))
    with pytest.raises(ContractViolation, match="id_repeated"):
        H.merge_into(spark, root, twice, 4)
    assert H.merge_into(spark, root, manifest(rows, []), 4) == []
    assert H.read_manifest(spark, root).where(F.col("sha").isNull()).isEmpty()
