"""Metadata to canonical manifest, as one lazy plan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoview.errors import require_clean
from chronoview.functions import scalars as S
from chronoview.operators import cohort as C
from chronoview.operators import joins as J
from chronoview.operators import validate as K
from chronoview.session import freeze, staged
from chronoview.sources import tables as T


def eligible_rows(metadata: DataFrame, label_map: DataFrame) -> DataFrame:
    """Normalised rows of the frozen families with their class ids."""
    resolved = T.resolve_columns(metadata).select(
        S.normalize_id(F.col("sha")).alias("sha"),
        S.normalize_family(F.col("family"), lower=True).alias("family"),
        S.parse_mixed_timestamp(F.col("timestamp")).alias("ts"))
    return J.attach_class_id(resolved, label_map)


def manifest_problems(rows: DataFrame) -> DataFrame:
    """Bad ids, repeated ids and unreadable timestamps among the eligible rows, in one pass."""
    per_id = rows.groupBy(F.col("sha").alias("subject")).agg(
        F.count("*").alias("n"), F.count_if(F.col("ts").isNull()).alias("bad_ts"))
    return K.broken_rules(per_id, ["subject"], {
        "sha_format": ~S.is_sha256(F.col("subject")), "timestamp": F.col("bad_ts") > 0,
        "id_repeated": F.col("n") > 1})


def build_manifest(metadata: DataFrame, label_map: DataFrame, index: DataFrame | None = None,
                   ranges: Sequence[tuple[str, str, str]] = S.SPLIT_RANGES,
                   check: bool = True) -> DataFrame:
    """Canonical manifest rows inside the protocol, in canonical order.

    With checks, the eligible rows are written once to the shared folder: the check, the
    sampling for the sort and the sort itself read the parsed rows instead of the text.
    """
    rows = eligible_rows(metadata, label_map)
    if check:
        rows = staged(rows, "eligible")
        require_clean(manifest_problems(rows), "eligible metadata")
    split = rows.withColumn("split", S.assign_split(F.col("ts"), ranges)).where(
        F.col("split").isin(*(name for name, _, _ in ranges)))
    dated = split.select("sha", "family", "class_id", "split",
                         S.month_label(F.col("ts")).alias("month"),
                         S.iso_utc(F.col("ts")).alias("timestamp"))
    if index is None:
        sized = dated.withColumn("file_size", F.lit(None).cast("bigint")) \
            .withColumn("zip_crc32", F.lit(None).cast("string"))
    else:
        if check:
            require_clean(J.duplicate_keys(index, "sha"), "size index")
        sized = J.attach_index(dated, index)
    return T.canonical_order(sized.select(*T.MANIFEST_COLUMNS),
                             [name for name, _, _ in ranges])


def freeze_label_map(train: DataFrame, min_files: int = C.MIN_FILES,
                     min_months: int = C.MIN_MONTHS) -> DataFrame:
    """Class map of the families eligible on training rows only, computed once."""
    return freeze(C.eligible_label_map(C.family_support(train, min_files, min_months)))
