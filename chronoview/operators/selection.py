"""Filters, shards, limits and seeded samples over manifests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoview.errors import ContractViolation
from chronoview.functions import scalars as S
from chronoview.operators.ranking import lookup_join, ranked, seeded_order, sha_bucket


def filter_eligible(df: DataFrame, label_map: DataFrame) -> DataFrame:
    return lookup_join(df, label_map.select("family"), ["family"], "left_semi")


def filter_candidates(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Malware rows with a valid id and a family in a fixed list (compared in lower case)."""
    return df.where(F.col("is_valid_sha256") & F.lower(F.col("family")).isin(*names))


def select_rows(manifest: DataFrame, splits: Sequence[str],
                months: Sequence[str] | None = None, limit: int | None = None,
                shard_id: int = 0, num_shards: int = 1) -> DataFrame:
    """Split and month filter, then the id shard, then the first rows of each split."""
    if num_shards < 1 or not 0 <= shard_id < num_shards:
        raise ValueError("require 0 <= shard_id < num_shards and num_shards >= 1")
    if limit is not None and limit <= 0:
        raise ValueError("limit must be positive")
    chosen = manifest.where(F.col("split").isin(*splits))
    if months:
        chosen = chosen.where(F.col("month").isin(*months))
    if num_shards > 1:
        chosen = chosen.where(S.hex_mod(F.col("sha"), num_shards) == shard_id)
    if limit is None:
        return chosen
    order = [F.col("month"), F.col("sha")]
    bucket = F.concat_ws("/", "month", sha_bucket(F.col("sha"), 2))
    numbered = ranked(chosen, ["split"], order, bucket, "_n")
    return numbered.where(F.col("_n") <= limit).drop("_n")


def sample_per_family(candidates: DataFrame, n: int, seed: int) -> DataFrame:
    """n samples per family in a seeded order of their ids (not any engine's random stream)."""
    keyed = candidates.withColumn("_order", seeded_order(F.col("sha"), seed))
    numbered = ranked(keyed, ["family"], [F.col("_order"), F.col("sha")],
                      sha_bucket(F.col("_order")), "_n")
    return numbered.where(F.col("_n") <= n).drop("_n", "_order")


def short_families(candidates: DataFrame, families: Sequence[str], n: int) -> DataFrame:
    """Families of the list with fewer than n candidates (including none)."""
    spark = candidates.sparkSession
    wanted = spark.range(1).select(
        F.explode(F.array(*(F.lit(f) for f in families))).alias("family"))
    counts = candidates.groupBy("family").agg(F.count("*").alias("available"))
    return (wanted.join(counts, "family", "left")
            .select("family", F.coalesce("available", F.lit(0)).alias("available"))
            .where(F.col("available") < n))


def select_training(df: DataFrame, start: str, stop: str) -> DataFrame:
    """Rows inside the half-open training window, in id order."""
    ts = F.col("timestamp")
    return df.where((ts >= F.lit(start).cast("timestamp"))
                    & (ts < F.lit(stop).cast("timestamp"))).orderBy("sha")


def training_label_conflicts(df: DataFrame, start: str, stop: str) -> DataFrame:
    """Rows whose split label and timestamp disagree about training membership."""
    ts = F.col("timestamp")
    inside = (ts >= F.lit(start).cast("timestamp")) & (ts < F.lit(stop).cast("timestamp"))
    labelled = F.coalesce(S.normalize_split(F.col("split")) == "train", F.lit(False))
    return df.where(F.coalesce(inside, F.lit(False)) != labelled).select(
        "sha", F.lit("train_label_disagrees").alias("rule"))


def available_members(samples: DataFrame, index: DataFrame,
                      max_size: int | None = None) -> DataFrame:
    """Samples with exactly one member of an acceptable size."""
    single = index.groupBy("sha").agg(F.count("*").alias("_members"),
                                      F.min("member").alias("member"),
                                      F.min("size").alias("size")).where("_members = 1")
    kept = samples.join(single.drop("_members"), "sha").where(F.col("size") > 0)
    return kept.where(F.col("size") <= max_size) if max_size is not None else kept


def ambiguous_members(samples: DataFrame, index: DataFrame) -> DataFrame:
    """Wanted samples with several archive members."""
    many = index.groupBy("sha").agg(F.count("*").alias("members")).where("members > 1")
    return many.join(samples.select("sha"), "sha", "left_semi")


def first_n_available(samples: DataFrame, index: DataFrame, limit: int,
                      max_size: int | None = None) -> DataFrame:
    """First ids that have exactly one readable member: a top-k, never a full sort."""
    if limit < 1 or (max_size is not None and max_size <= 0):
        raise ValueError("limit and max_size must be positive")
    return available_members(samples, index, max_size).orderBy("sha").limit(limit)


def guard_future(selected: DataFrame, frozen_id: str | None, config_id: str) -> DataFrame:
    """Violations: test rows mixed with other splits, or without the frozen configuration."""
    found = selected.agg(F.count_if(F.col("split") == "test").alias("test_rows"),
                         F.count_if(F.col("split") != "test").alias("other_rows"))
    wrong = F.lit(frozen_id != config_id)
    return (found.select(
        "test_rows", "other_rows",
        F.explode(F.array_compact(F.array(
            F.when((F.col("test_rows") > 0) & (F.col("other_rows") > 0),
                   F.lit("future_test_mixed_with_other_splits")),
            F.when((F.col("test_rows") > 0) & wrong,
                   F.lit("future_test_without_frozen_config")))))
        .alias("rule")))


def pilot_split(train: DataFrame, fit_through: str,
                holdout_months: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Fit rows (month <= fit_through) and hold-out rows of exactly the expected months."""
    if any(month <= fit_through for month in holdout_months):
        raise ContractViolation("hold-out months must come after the fit months")
    return (train.where(F.col("month") <= fit_through),
            train.where(F.col("month") > fit_through))


def pilot_month_problems(holdout: DataFrame, holdout_months: Sequence[str]) -> DataFrame:
    """Expected months without rows and unexpected months with rows."""
    spark = holdout.sparkSession
    expected = spark.range(1).select(
        F.explode(F.array(*(F.lit(m) for m in holdout_months))).alias("month"),
        F.lit(True).alias("expected"))
    seen = holdout.groupBy("month").agg(F.count("*").alias("n"))
    return (expected.join(seen, "month", "full_outer")
            .where(F.col("expected").isNull() | F.col("n").isNull())
            .select("month", F.when(F.col("n").isNull(), F.lit("missing_month"))
                    .otherwise(F.lit("unexpected_month")).alias("rule")))


def skip_completed(todo: DataFrame, log: DataFrame, keys: Sequence[str] = ("sha", "modality"),
                   done: Sequence[str] = ("success", "skipped", "CREATED", "VERIFIED")
                   ) -> DataFrame:
    finished = log.where(F.col("status").isin(*done)).select(*keys).distinct()
    return todo.join(finished, list(keys), "left_anti")


def invalid_examples(raw: DataFrame, n: int = 10) -> DataFrame:
    """First rows whose id or timestamp is unusable, with their raw values."""
    bad_id = ~S.is_sha256(F.col("sha"))
    bad_ts = S.parse_mixed_timestamp(F.col("timestamp")).isNull()
    return (raw.where(bad_id | bad_ts)
            .select("sha", "timestamp", "family",
                    F.concat_ws("+", F.when(bad_id, F.lit("id")),
                                F.when(bad_ts, F.lit("timestamp"))).alias("problem"))
            .orderBy(S.normalize_id(F.col("sha")), "sha").limit(n))
