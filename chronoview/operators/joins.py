"""Id alignment: attaching classes and indexes, matching sources, comparing id sets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoview.functions import scalars as S
from chronoview.operators.ranking import lookup_join


def attach_class_id(df: DataFrame, label_map: DataFrame) -> DataFrame:
    """Many-to-one join to the frozen class map."""
    return lookup_join(df, label_map.select("family", "class_id"), ["family"])


def duplicate_keys(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def attach_index(manifest: DataFrame, index: DataFrame) -> DataFrame:
    """Optional size and CRC beside each sample; check ``duplicate_keys(index)`` first."""
    return manifest.join(index.select("sha", "file_size", "zip_crc32"), "sha", "left")


def match_sources(samples: DataFrame, index: DataFrame) -> DataFrame:
    """Matches per wanted sample: how many members, and the first one by name.

    The index is aggregated first, so an id with very many members costs one row.
    """
    per_sha = index.groupBy("sha").agg(
        F.count("*").alias("matches"),
        F.min(F.struct("member", "size")).alias("_first"))
    return (samples.join(per_sha, "sha", "left")
            .withColumn("matches", F.coalesce("matches", F.lit(0)))
            .withColumn("status", F.when(F.col("matches") == 0, "missing")
                        .when(F.col("matches") > 1, "ambiguous").otherwise("matched"))
            .withColumn("member", F.when(F.col("matches") == 1, F.col("_first.member")))
            .withColumn("size", F.when(F.col("matches") == 1, F.col("_first.size")))
            .drop("_first"))


def match_candidates(samples: DataFrame, index: DataFrame) -> DataFrame:
    """All members of the samples that are not matched exactly once, one row per member."""
    off = match_sources(samples, index).where("status <> 'matched'").select(
        "sha", "status", "matches")
    return off.join(index.select("sha", "member"), "sha", "left")


def range_split_join(df: DataFrame, ranges: DataFrame) -> DataFrame:
    """Split by an interval table (name, start, stop), half-open.

    The intervals are turned into days and joined by equality, so the plan hashes on the
    day instead of comparing every row with every interval.
    """
    days = ranges.select("split", F.explode(F.sequence(
        F.col("start").cast("date"), F.date_sub(F.col("stop").cast("date"), 1))).alias("_day"))
    return (lookup_join(df.withColumn("_day", F.col("ts").cast("date")), days, ["_day"], "left")
            .drop("_day")
            .withColumn("split", F.when(F.col("ts").isNull(), "invalid")
                        .otherwise(F.coalesce("split", F.lit("outside_protocol")))))


def overlapping_ranges(ranges: DataFrame) -> DataFrame:
    """Days claimed by two intervals."""
    days = ranges.select("split", F.explode(F.sequence(
        F.col("start").cast("date"), F.date_sub(F.col("stop").cast("date"), 1))).alias("day"))
    return duplicate_keys(days, "day")


def id_cross_check(sets: dict[str, DataFrame]) -> DataFrame:
    """Sizes of several id sets and of every ordered difference, in one aggregate per id."""
    names = list(sets)
    union = None
    for name in names:
        part = sets[name].select("sha", F.lit(name).alias("origin"))
        union = part if union is None else union.unionByName(part)
    held = union.groupBy("sha").agg(
        *(F.max(F.col("origin") == name).alias(name) for name in names))
    measures = [F.count_if(F.col(a)).alias(f"{a}_ids") for a in names]
    measures += [F.count_if(F.col(a) & ~F.col(b)).alias(f"{a}_missing_from_{b}")
                 for a in names for b in names if a != b]
    return held.agg(*measures)


def split_fold(folds: DataFrame, fold: int) -> tuple[DataFrame, DataFrame]:
    """(train, test): the test part is the fold, the training part everything else."""
    return folds.where(F.col("test_fold") != fold), folds.where(F.col("test_fold") == fold)


def overlap(left: DataFrame, right: DataFrame, key: str = "sha") -> DataFrame:
    """Ids present on both sides; must be empty for train/test or month pairs."""
    return left.select(key).join(right.select(key), key, "left_semi").distinct()


def log_coverage(log: DataFrame, cohort: DataFrame,
                 same: Sequence[str] = ("family", "path")) -> DataFrame:
    """Violations: cohort ids not logged exactly once, logged strangers, changed columns."""
    logged = log.groupBy("sha").agg(F.count("*").alias("_entries"),
                                    *(F.min(c).alias(f"_log_{c}") for c in same))
    both = cohort.select("sha", *same, F.lit(True).alias("_wanted")).join(
        logged, "sha", "full_outer")
    changed = F.lit(False)
    for column in same:
        changed = changed | ~F.col(column).eqNullSafe(F.col(f"_log_{column}"))
    rule = (F.when(F.col("_entries").isNull(), "not_logged")
            .when(F.col("_wanted").isNull(), "not_in_cohort")
            .when(F.col("_entries") > 1, "logged_more_than_once")
            .when(changed, "columns_differ"))
    return both.select("sha", rule.alias("rule")).where("rule IS NOT NULL")


def report_against_output(outputs: DataFrame, reports: DataFrame, identity: Sequence[str],
                          keys: Sequence[str] = ("sha", "modality")) -> DataFrame:
    """Violations between stored views and their reports, one row per broken rule.

    The blank view of a missing content, whose report passes with the error as a note, has no
    content digest.
    """
    noted = F.lit(False)
    if {"error", "content_size"} <= set(reports.columns):
        noted = (F.col("error").isNotNull() & F.col("content_size").isNull()
                 & F.col("content_sha256").isNull())
    left = outputs.select(*keys, F.col("output_sha256").alias("_stored"),
                          F.size("pixels").alias("_cells"),
                          *(F.col(c).alias(f"_out_{c}") for c in identity),
                          F.lit(True).alias("_has_output"))
    right = reports.select(*keys, "status", "output_sha256", "content_sha256",
                           noted.alias("_no_content"),
                           *(F.col(c).alias(f"_rep_{c}") for c in identity),
                           F.lit(True).alias("_has_report"))
    both = left.join(right, list(keys), "full_outer")
    paired = F.col("_has_output").isNotNull() & F.col("_has_report").isNotNull()
    rules = [
        F.when(F.col("_has_output").isNull(), F.lit("missing_output")),
        F.when(F.col("_has_report").isNull(), F.lit("missing_report")),
        F.when(paired & (F.col("status") != "PASS"), F.lit("status_not_pass")),
        F.when(paired & ~F.col("_stored").eqNullSafe(F.col("output_sha256")),
               F.lit("output_digest")),
        F.when(paired & ~F.col("_no_content") & ~S.is_sha256(F.col("content_sha256")),
               F.lit("content_digest")),
        F.when(paired & (F.col("_cells") != 4096), F.lit("shape")),
    ]
    rules += [F.when(paired & ~F.col(f"_out_{c}").eqNullSafe(F.col(f"_rep_{c}")),
                     F.lit(f"{c}_differs")) for c in identity]
    return both.select(*keys, F.explode(F.array_compact(F.array(*rules))).alias("rule"))


def id_difference(left: DataFrame, right: DataFrame, key: str = "sha") -> DataFrame:
    return left.select(key).subtract(right.select(key))


def id_intersection(left: DataFrame, right: DataFrame, key: str = "sha") -> DataFrame:
    return left.select(key).intersect(right.select(key))


def set_equal(expected: DataFrame, actual: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Missing and unexpected keys; empty when both hold the same keys."""
    sides = (expected.select(*keys, F.lit(1).alias("_e"), F.lit(0).alias("_a"))
             .unionByName(actual.select(*keys, F.lit(0).alias("_e"), F.lit(1).alias("_a"))))
    return (sides.groupBy(*keys).agg(F.max("_e").alias("_e"), F.max("_a").alias("_a"))
            .where(F.col("_e") != F.col("_a"))
            .select(*keys, F.when(F.col("_e") == 1, F.lit("missing"))
                    .otherwise(F.lit("unexpected")).alias("problem")))
