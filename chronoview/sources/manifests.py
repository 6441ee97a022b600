"""Merged manifests in hash buckets: an upsert reads and rewrites the buckets it touches.

``data/version=V/bucket=B`` holds the rows of bucket B as merge V wrote them, ``versions/version=V``
says for every bucket which version is current. That small table is written last and counts once
its job has ended, so readers see a merge whole or not at all; files of untouched buckets are
neither read nor written. What a merge that died left behind is in no version's list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoview.errors import ContractViolation, require_clean
from chronoview.operators.dataset import upsert_conflicts, upsert_manifest
from chronoview.operators.journal import Folder, folder
from chronoview.operators.validate import check_ids
from chronoview.session import staged

POINTER = "bucket int, at int"


def bucket_of(sha: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(sha), F.lit(buckets)).cast("int")


def _versions(place: Folder) -> list[int]:
    return place.numbered("versions", prefix="version=", finished=True)


def current_buckets(place: Folder, version: int | None = None) -> dict[int, int]:
    """bucket -> version of its files; as many entries as there are buckets with rows."""
    seen = _versions(place)
    if not seen:
        return {}
    at = seen[-1] if version is None else version
    rows = place.spark.read.schema(POINTER).parquet(f"{place.root}/versions/version={at}")
    return {r["bucket"]: r["at"] for r in rows.collect()}


def _rows(place: Folder, buckets: dict[int, int]) -> DataFrame:
    paths = [f"{place.root}/data/version={v}/bucket={b}" for b, v in sorted(buckets.items())]
    return place.spark.read.option("basePath", f"{place.root}/data").parquet(*paths).drop(
        "version", "bucket")


def read_manifest(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The current manifest, or that of an earlier version."""
    place = folder(spark, path)
    buckets = current_buckets(place, version)
    if not buckets:
        raise ContractViolation(f"{path} holds no manifest")
    return _rows(place, buckets)


def merge_into(spark: SparkSession, path: str, new: DataFrame, buckets: int = 256) -> list[int]:
    """Upsert rows by sha into the manifest at ``path``; returns the buckets that were rewritten.

    New rows extend or complete old ones (``upsert_manifest``); repeated ids, rows that differ in
    frozen columns, and another number of buckets than the manifest has, are refused before
    anything is written. Of two merges at once only one can publish its version.
    """
    place = folder(spark, path)
    new = staged(new, "manifest-rows")
    require_clean(check_ids(new), path)
    current = current_buckets(place)
    if current:
        stored = spark.read.text(f"{place.root}/buckets").first()["value"]
        if int(stored) != buckets:
            raise ContractViolation(f"{path} has {stored} buckets, not {buckets}")
    placed = new.select(bucket_of(F.col("sha"), buckets).alias("bucket"))
    touched = sorted(r["bucket"] for r in placed.distinct().collect())  # at most all buckets
    if not touched:
        return []
    there = {b: current[b] for b in touched if b in current}
    merged = new
    if there:
        old = _rows(place, there)
        require_clean(upsert_conflicts(old, new), path)
        merged = upsert_manifest(old, new)
    version = max([*_versions(place), *place.numbered("data", prefix="version=")], default=0) + 1
    rows = merged.withColumn("bucket", bucket_of(F.col("sha"), buckets))
    rows.repartition(min(buckets, len(touched)), "bucket").write.partitionBy("bucket").parquet(
        f"{place.root}/data/version={version}")
    if not current:
        spark.createDataFrame([(str(buckets),)], "value string").coalesce(1).write.mode(
            "overwrite").text(f"{place.root}/buckets")
    pointer = [(b, v) for b, v in ({**current, **dict.fromkeys(touched, version)}).items()]
    spark.createDataFrame(pointer, POINTER).coalesce(1).write.parquet(
        f"{place.root}/versions/version={version}")
    return touched
