"""Metadata audit, family support, eligibility, class ids and count tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoview.functions import scalars as S
from chronoview.operators.ranking import ranked, skew_join
from chronoview.session import staged

MIN_FILES = 50
MIN_MONTHS = 3


def standardize(raw: DataFrame, ranges: Sequence[tuple[str, str, str]] = S.SPLIT_RANGES,
                binary_available: Column | None = None) -> DataFrame:
    """The v0 sample manifest of (sha, timestamp, family) metadata; one narrow projection."""
    typed = raw.select(
        S.normalize_id(F.col("sha")).alias("sample_id"),
        S.valid_sha_or_null(F.col("sha")).alias("sha256"),
        S.is_sha256(F.col("sha")).alias("is_valid_sha256"),
        S.parse_mixed_timestamp(F.col("timestamp")).alias("timestamp"),
        S.normalize_family(F.col("family")).alias("family"),
        (F.lit(False) if binary_available is None else binary_available)
        .alias("binary_available"),
    )
    return typed.select(
        "sample_id", "sha256", "is_valid_sha256", "timestamp",
        S.month_label(F.col("timestamp")).alias("month"),
        "family",
        F.col("family").isNotNull().alias("is_malware"),
        S.assign_split(F.col("timestamp"), ranges).alias("split"),
        "binary_available",
    )


def malware_manifest(standard: DataFrame, splits: Sequence[str] = S.SPLIT_ORDER) -> DataFrame:
    return standard.where(F.col("is_malware") & F.col("split").isin(*splits))


def malware_manifest_problems(standard: DataFrame,
                              splits: Sequence[str] = S.SPLIT_ORDER) -> DataFrame:
    """One row of counts that must all be zero before the malware subset is used."""
    bad = F.col("is_malware")
    return standard.agg(
        F.count_if(bad & F.col("timestamp").isNull()).alias("null_timestamps"),
        F.count_if(bad & F.col("sha256").isNull()).alias("null_sha256"),
        F.count_if(bad & ~F.col("split").isin(*splits)).alias("outside_splits"),
    )


def metadata_audit(standard: DataFrame) -> DataFrame:
    """Row, id and timestamp checks, in two scans.

    Distinct ids are counted per id first, so the exact count is one partial aggregate
    plus one shuffle on the id and never gathers ids in one task.
    """
    malware, valid = F.col("is_malware"), F.col("is_valid_sha256")
    per_id = standard.groupBy("sample_id").agg(
        F.count("*").alias("n"), F.count_if(valid).alias("n_valid"),
        F.count_if(malware).alias("n_malware"),
        F.count_if(malware & valid).alias("n_malware_valid"),
        F.count_if(F.col("timestamp").isNull()).alias("n_bad_ts"),
        F.count_if(malware & F.col("timestamp").isNull()).alias("n_malware_bad_ts"),
        F.min("timestamp").alias("first"), F.max("timestamp").alias("last"),
        F.min(F.when(malware, F.col("timestamp"))).alias("first_malware"),
        F.max(F.when(malware, F.col("timestamp"))).alias("last_malware"))
    return per_id.agg(
        F.sum("n").alias("metadata_rows"),
        F.count("*").alias("unique_sample_ids"),
        F.sum(F.col("n") - 1).alias("duplicate_id_rows"),
        F.sum("n_malware").alias("malware_rows"),
        F.sum(F.col("n") - F.col("n_malware")).alias("benign_rows"),
        F.sum(F.col("n") - F.col("n_valid")).alias("nonstandard_ids_all"),
        F.sum(F.col("n_malware") - F.col("n_malware_valid")).alias("nonstandard_ids_malware"),
        F.sum(F.col("n") - F.col("n_valid") - F.col("n_malware") + F.col("n_malware_valid"))
        .alias("nonstandard_ids_benign"),
        F.sum("n_bad_ts").alias("invalid_timestamps_all"),
        F.sum("n_malware_bad_ts").alias("invalid_timestamps_malware"),
        F.sum(F.col("n_bad_ts") - F.col("n_malware_bad_ts")).alias("invalid_timestamps_benign"),
        S.iso_utc(F.min("first")).alias("earliest_timestamp"),
        S.iso_utc(F.max("last")).alias("latest_timestamp"),
        S.iso_utc(F.min("first_malware")).alias("earliest_malware_timestamp"),
        S.iso_utc(F.max("last_malware")).alias("latest_malware_timestamp"),
    )


def counts_by(df: DataFrame, *columns: str, name: str = "n") -> DataFrame:
    return df.groupBy(*columns).agg(F.count("*").alias(name))


def family_support(train: DataFrame, min_files: int = MIN_FILES,
                   min_months: int = MIN_MONTHS) -> DataFrame:
    """Distinct files and months per family and the eligibility flag.

    Catalyst groups by (family, value) before it groups by family, so the ids of a hot
    family are counted by many tasks.
    """
    return (train.groupBy("family")
            .agg(F.count_distinct("sha").alias("n_files"),
                 F.count_distinct("month").alias("n_months"))
            .withColumn("eligible", (F.col("n_files") >= min_files)
                        & (F.col("n_months") >= min_months)))


def distinct_files(df: DataFrame, *keys: str, name: str = "n_files") -> DataFrame:
    return df.groupBy(*keys).agg(F.count_distinct("sha").alias(name))


def coverage_summary(support: DataFrame) -> DataFrame:
    eligible = F.col("eligible")
    return support.agg(
        F.count("*").alias("training_families"),
        F.count_if(eligible).alias("eligible_families"),
        F.count_if(~eligible).alias("excluded_families"),
        F.sum("n_files").alias("training_files"),
        F.sum(F.when(eligible, F.col("n_files")).otherwise(0)).alias("eligible_files"),
        F.sum(F.when(~eligible, F.col("n_files")).otherwise(0)).alias("excluded_files"),
        F.round(100.0 * F.sum(F.when(eligible, F.col("n_files")).otherwise(0))
                / F.sum("n_files"), 4).alias("coverage_percent"))


def support_histogram(support: DataFrame, eligible_only: bool = True) -> DataFrame:
    rows = support.where("eligible") if eligible_only else support
    return rows.groupBy("n_months").agg(F.count("*").alias("n_families"))


def rank_support(support: DataFrame) -> DataFrame:
    return support.orderBy(F.desc("eligible"), F.desc("n_files"), F.desc("n_months"), "family")


def borderline_families(support: DataFrame, n: int = 15) -> DataFrame:
    """The n weakest eligible families and the n strongest excluded ones."""
    weakest = (support.where("eligible")
               .orderBy("n_files", "n_months", "family").limit(n)
               .withColumn("kind", F.lit("lowest_eligible")))
    strongest = (support.where(~F.col("eligible"))
                 .orderBy(F.desc("n_files"), F.desc("n_months"), "family").limit(n)
                 .withColumn("kind", F.lit("highest_excluded")))
    return weakest.unionByName(strongest)


def class_ids_by_name(families: DataFrame) -> DataFrame:
    """0-based class id by family name; names are bucketed by their first characters."""
    numbered = ranked(families, [], [F.col("family")], F.substring("family", 1, 2), "class_id")
    return numbered.withColumn("class_id", (F.col("class_id") - 1).cast("int"))


def eligible_label_map(support: DataFrame) -> DataFrame:
    return class_ids_by_name(support.where("eligible").select("family", "n_files", "n_months"))


def pivot_counts(df: DataFrame, period: str, families: Sequence[str]) -> DataFrame:
    """Distinct files per period in one column per family (0 when absent) and their total."""
    cells = distinct_files(df.where(F.col("family").isin(*families)), period, "family")
    wide = (cells.groupBy(period).pivot("family", list(families)).agg(F.sum("n_files"))
            .na.fill(0))
    total = sum((F.col(f"`{name}`") for name in families), F.lit(0).cast("bigint"))
    return wide.withColumn("TOTAL", total)


def grouping_totals(df: DataFrame, outer: str, inner: str) -> DataFrame:
    """Distinct files beside their subtotals and grand total (each sha has one family)."""
    ids = df.select(outer, inner, "sha").distinct()
    summed = ids.rollup(outer, inner).agg(
        F.count("*").alias("n_files"), F.grouping(outer).alias("_outer"),
        F.grouping(inner).alias("_inner"))
    # A NULL group keeps its NULL; only rolled-up columns say TOTAL.
    return summed.select(F.when(F.col("_outer") == 1, "TOTAL").otherwise(F.col(outer)).alias(outer),
                         F.when(F.col("_inner") == 1, "TOTAL").otherwise(F.col(inner)).alias(inner),
                         "n_files")


def peak_period(df: DataFrame, period: str = "month") -> DataFrame:
    """First period with the largest count, per family."""
    cells = distinct_files(df, "family", period)
    best = cells.groupBy("family").agg(
        F.max("n_files").alias("peak_files"),
        F.min(F.struct((-F.col("n_files")).alias("k"), F.col(period).alias("p"))).alias("_best"))
    return best.select("family", F.col("_best.p").alias(f"peak_{period}"), "peak_files")


def rank_periods(df: DataFrame, period: str = "month", top: int | None = None) -> DataFrame:
    totals = distinct_files(df, period).orderBy(F.desc("n_files"), period)
    return totals.limit(top) if top is not None else totals


def compare_expected(expected: DataFrame, current: DataFrame) -> DataFrame:
    """Expected against current counts per family, with a TOTAL row."""
    right = current.withColumnRenamed("family", "_family")
    on = expected["family"].eqNullSafe(right["_family"])
    both = expected.join(right, on, "full_outer").select(
        F.coalesce("family", "_family").alias("family"), F.coalesce("expected", F.lit(0)).alias("expected"),
        F.coalesce("current", F.lit(0)).alias("current"))
    summed = both.rollup("family").agg(F.sum("expected").alias("expected"),
                                       F.sum("current").alias("current"),
                                       F.grouping("family").alias("_total"))
    return summed.select(
        F.when(F.col("_total") == 1, "TOTAL").otherwise(F.col("family")).alias("family"), "expected", "current",
        (F.col("current") - F.col("expected")).alias("difference"),
        S.percent_difference(F.col("current"), F.col("expected")).alias("percent_difference"))


def densify(cells: DataFrame, row_values: Sequence, row: str, column_values: Sequence,
            column: str, value: str) -> DataFrame:
    """Long table with every (row, column) of two fixed axes, missing values 0.

    The axes are parameters, so the grid is exploded from literals: no join of data with data.
    """
    spark = cells.sparkSession
    grid = (spark.range(1)
            .select(F.explode(F.array(*(F.lit(v) for v in row_values))).alias(row))
            .select(row, F.explode(F.array(*(F.lit(v) for v in column_values))).alias(column)))
    return (grid.join(cells, [row, column], "left")
            .select(row, column, F.coalesce(value, F.lit(0)).alias(value)))


def archive_inventory(index: DataFrame) -> DataFrame:
    """Member count, bytes, duplicate paths and names that look like ids."""
    name = S.sha_from_filename(F.col("member"))
    per_path = (index.withColumn("_sha_like", S.is_sha256(name))
                .groupBy("member").agg(F.count("*").alias("n"), F.sum("size").alias("size"),
                                       F.count_if("_sha_like").alias("sha_like")))
    return per_path.agg(
        F.sum("n").alias("members"), F.sum("size").alias("uncompressed_bytes"),
        F.sum(F.col("n") - 1).alias("duplicate_paths"),
        F.sum("sha_like").alias("sha_like_names"),
        F.sum(F.col("n") - F.col("sha_like")).alias("other_names"))


def status_counts(log: DataFrame, keys: Sequence[str],
                  statuses: Sequence[str]) -> DataFrame:
    return (log.groupBy(*keys).pivot("status", list(statuses)).agg(F.count(F.lit(1)))
            .na.fill(0, list(statuses)))


def cross_split_duplicates(contents: DataFrame,
                           order: Sequence[str] = S.SPLIT_ORDER) -> DataFrame:
    """Samples whose content was first seen under another sha in another split.

    The first owner is a min over (split order, month, sha), combined map-side, so a
    content held by a third of all samples never lands in one task; only contents that
    occur in several splits are joined back, hot ones by bounded broadcast.
    """
    place = F.struct(S.split_rank(F.col("split"), order).alias("rank"),
                     F.col("month"), F.col("sha"), F.col("split"))
    first = (contents.groupBy("content_sha256")
             .agg(F.min(place).alias("owner"), F.min("split").alias("low"),
                  F.max("split").alias("high"))
             .where(F.col("low") != F.col("high"))
             .select("content_sha256", F.col("owner.sha").alias("owner_sha"),
                     F.col("owner.split").alias("owner_split")))
    return (skew_join(contents.select("content_sha256", "sha", "split"), first,
                      ["content_sha256"])
            .where((F.col("split") != F.col("owner_split")) & (F.col("sha") != F.col("owner_sha")))
            .select("content_sha256", "owner_sha", "sha", "owner_split", "split"))


def first_owner(contents: DataFrame, order: Sequence[str] = S.SPLIT_ORDER) -> DataFrame:
    """First sha holding each content, in manifest order, beside its number of holders."""
    place = F.struct(S.split_rank(F.col("split"), order).alias("rank"),
                     F.col("month"), F.col("sha"))
    return (contents.groupBy("content_sha256")
            .agg(F.min(place).alias("owner"), F.count("*").alias("holders"))
            .select("content_sha256", F.col("owner.sha").alias("owner_sha"), "holders"))


def dataset_hash(df: DataFrame, columns: Sequence[str], id_column: str = "sha") -> DataFrame:
    """Order-independent content hash of a table.

    Rows are hashed alone and folded per id prefix, so the last step sees at most 4096
    digests; equal tables give equal hashes whatever their row order or partitioning.
    """
    digest = S.canonical_hash(*columns)
    folded = (df.select(F.col(id_column).alias("_id"), digest.alias("_h"))
              .groupBy(F.substring(F.sha2(F.col("_h"), 256), 1, 3).alias("_bucket"))
              .agg(F.count("*").alias("n"), *_digest_sums("_h")))
    line = F.concat_ws(",", "_bucket", F.col("n").cast("string"),
                       *(F.col(f"_w{i}").cast("string") for i in range(8)))
    return folded.agg(
        F.sum("n").alias("n_rows"),
        F.sha2(F.concat_ws("\n", F.sort_array(F.collect_list(line))), 256).alias("dataset_hash"))


def prefix_tree(df: DataFrame, columns: Sequence[str], id_column: str = "sha",
                depth: int = 3) -> DataFrame:
    """(level, prefix, n, w0..w7): sums of row digests per hex prefix of the id, levels 0 to depth.

    Level 0 stands for the whole table. Rows are summed once, into the deepest prefixes; every
    level above adds up the one below, so trees of parts can be merged by summing. Ids should be
    spread over prefixes as hashes are; an id that is no hex number falls into its own prefix.
    """
    words = [f"w{i}" for i in range(8)]
    digest = S.canonical_hash(*columns)
    level = (df.select(F.substring(F.coalesce(F.lower(id_column), F.lit("")), 1, depth)
                       .alias("prefix"), digest.alias("_h"))
             .groupBy("prefix").agg(F.count("*").alias("n"), *(
                 s.alias(w) for s, w in zip(_digest_sums("_h"), words))))
    level = staged(level, "prefix-tree")
    tree = level.select(F.lit(depth).alias("level"), "prefix", "n", *words)
    for length in range(depth - 1, -1, -1):
        level = level.groupBy(F.substring("prefix", 1, length).alias("prefix")).agg(
            F.sum("n").alias("n"), *(F.sum(w).alias(w) for w in words))
        tree = tree.unionByName(level.select(F.lit(length).alias("level"), "prefix", "n", *words))
    return tree


def differing_prefixes(left: DataFrame, right: DataFrame, depth: int = 3) -> list[str]:
    """Deepest prefixes whose rows differ between two stored trees, found from the top down.

    A level reads only the children of what differed above; the list has at most 16^depth
    prefixes (for hex ids), and is empty, after one comparison, for equal tables.
    """
    words = ["n", *(f"w{i}" for i in range(8))]
    found = [""]
    for length in range(depth + 1):
        wanted = (F.col("level") == length) & F.substring("prefix", 1, max(0, length - 1)).isin(found)
        both = left.where(wanted).select("prefix", *words).join(
            right.where(wanted).select("prefix", *(F.col(w).alias(f"_{w}") for w in words)),
            "prefix", "full_outer")
        same = F.lit(True)
        for w in words:
            same = same & F.col(w).eqNullSafe(F.col(f"_{w}"))
        found = sorted(r["prefix"] for r in both.where(~same).select("prefix").collect())
        if not found:
            return []
    return found


def changed_rows(left: DataFrame, right: DataFrame, prefixes: Sequence[str],
                 columns: Sequence[str], id_column: str = "sha", depth: int = 3) -> DataFrame:
    """(id, change) of rows added, removed or changed, from rows of the differing prefixes only."""
    def side(df: DataFrame, name: str) -> DataFrame:
        within = F.substring(F.lower(id_column), 1, depth).isin(list(prefixes))
        return df.where(within).select(F.col(id_column), S.canonical_hash(*columns).alias(name))
    both = side(left, "_left").join(side(right, "_right"), id_column, "full_outer")
    change = (F.when(F.col("_left").isNull(), "added").when(F.col("_right").isNull(), "removed")
              .when(F.col("_left") != F.col("_right"), "changed"))
    return both.select(id_column, change.alias("change")).where("change IS NOT NULL")


def _digest_sums(name: str) -> list[Column]:
    """Sums of the eight 32-bit words of a digest: commutative, so no rows are gathered."""
    return [F.sum(F.conv(F.substring(name, 8 * i + 1, 8), 16, 10).cast("decimal(38,0)"))
            .alias(f"_w{i}") for i in range(8)]


def fold_sizes(folds: DataFrame, fold: str = "test_fold") -> DataFrame:
    return folds.groupBy(fold).agg(F.count("*").alias("n"))
