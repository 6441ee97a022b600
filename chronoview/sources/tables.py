"""Text tables with fixed contracts, label maps, manifests, predictions and JSON records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronoview.errors import ContractViolation, require_clean, require_columns
from chronoview.functions import scalars as S
from chronoview.operators import validate as K

ID_ALIASES = ("sha256", "sha", "sample_id")
FAMILY_ALIASES = ("family_norm", "family")
MANIFEST_COLUMNS = ("sha", "family", "class_id", "split", "month", "timestamp",
                    "file_size", "zip_crc32")


def scan_contract_csv(spark: SparkSession, path: str, required: set[str] | None = None,
                      multi_line: bool = False) -> DataFrame:
    """CSV whose columns all stay strings; a byte-order mark in the header is dropped.

    Only the header line reaches the driver; rows are read by the executors. Line breaks
    inside quotes need ``multi_line``, which makes a file one task; without it files split.
    """
    first = spark.read.text(path).limit(1).collect()
    if not first or not first[0].value.strip("﻿ \t"):
        raise ContractViolation(f"{path} is empty or has no header")
    rows = (spark.read.option("header", True).option("quote", '"').option("escape", '"')
            .option("multiLine", multi_line).option("enforceSchema", False).csv(path))
    rows = rows.toDF(*(name.replace("﻿", "") for name in rows.columns))
    if required:
        require_columns(rows, required, path)
    return rows


def scan_metadata(spark: SparkSession, path: str) -> DataFrame:
    """sha, timestamp and family as strings; other columns are pruned."""
    return scan_contract_csv(spark, path, {"sha", "timestamp", "family"}).select(
        "sha", "timestamp", "family")


def resolve_columns(df: DataFrame) -> DataFrame:
    """First id and family alias present, renamed to sha and family."""
    def first(aliases: Sequence[str], what: str) -> str:
        for name in aliases:
            if name in df.columns:
                return name
        raise ContractViolation(f"no {what} column among {list(aliases)}")
    id_name, family = first(ID_ALIASES, "id"), first(FAMILY_ALIASES, "family")
    others = [c for c in df.columns if c not in {*ID_ALIASES, *FAMILY_ALIASES}]
    return df.select(F.col(id_name).alias("sha"), F.col(family).alias("family"), *others)


def normalized_label_map(raw: DataFrame) -> DataFrame:
    return raw.select(S.normalize_family(F.col("family"), lower=True).alias("family"),
                      S.integer_or_null(F.col("class_id")).cast("int").alias("class_id"))


def load_label_map(spark: SparkSession, path: str, classes: int | None = None) -> DataFrame:
    raw = scan_contract_csv(spark, path, {"family", "class_id"})
    require_clean(K.check_label_map(raw, classes), f"label map {path}")
    return normalized_label_map(raw)


def typed_manifest(raw: DataFrame) -> DataFrame:
    """Manifest rows with their types, in canonical order."""
    def optional(name: str):
        return F.col(name) if name in raw.columns else F.lit(None).cast("string")
    size = F.nullif(F.trim(optional("file_size").cast("string")), F.lit(""))
    rows = raw.select(
        S.normalize_id(F.col("sha")).alias("sha"),
        S.normalize_family(F.col("family"), lower=True).alias("family"),
        S.integer_or_null(F.col("class_id")).cast("int").alias("class_id"),
        S.normalize_split(F.col("split")).alias("split"),
        F.trim("month").alias("month"), F.trim(F.col("timestamp").cast("string"))
        .alias("timestamp"),
        size.try_cast("bigint").alias("file_size"),
        F.nullif(S.normalize_id(optional("zip_crc32")), F.lit("")).alias("zip_crc32"))
    return canonical_order(rows)


def canonical_order(df: DataFrame, order: Sequence[str] = S.SPLIT_ORDER) -> DataFrame:
    """train, validation, test; then month; then sha (range-partitioned, no single task)."""
    return df.orderBy(S.split_rank(F.col("split"), order), "month", "sha")


def load_manifest(spark: SparkSession, path: str, label_map: DataFrame,
                  ranges: Sequence[tuple[str, str, str]] = S.SPLIT_RANGES) -> DataFrame:
    raw = scan_contract_csv(spark, path, {"sha", "family", "split", "timestamp", "month",
                                          "class_id"})
    for name in ("file_size", "zip_crc32"):
        if name not in raw.columns:
            raw = raw.withColumn(name, F.lit(None).cast("string"))
    if raw.isEmpty():
        raise ContractViolation(f"{path} has no rows")
    require_clean(K.check_manifest(raw, label_map, ranges), f"manifest {path}")
    return typed_manifest(raw)


def scan_view_images(spark: SparkSession, path: str, modality: str | None = None,
                     splits: Sequence[str] | None = None,
                     months: Sequence[str] | None = None) -> DataFrame:
    """Stored views; the filters are partition columns, so other folders are not listed."""
    views = spark.read.parquet(path)
    if modality:
        views = views.where(F.col("modality") == modality)
    if splits:
        views = views.where(F.col("split").isin(*splits))
    if months:
        views = views.where(F.col("month").isin(*months))
    return views


def scan_gray_images(spark: SparkSession, path: str) -> DataFrame:
    """8-bit gray PNG files as pixel arrays; undecodable or other images have NULL pixels.

    (origin, sha, width, height, pixels)
    """
    image = spark.read.format("image").option("dropInvalid", False) \
        .option("recursiveFileLookup", True).load(path).select("image.*")
    gray = (F.col("height") > 0) & (F.col("nChannels") == 1) & (F.col("mode") == 0)
    # Pixel rows of one 64x64 image: a fixed, small number of bytes per row.
    pixels = F.transform(F.sequence(F.lit(1), F.octet_length("data")),
                         lambda i: F.conv(F.hex(F.substring(F.col("data"), i, F.lit(1))), 16, 10)
                         .cast("float"))
    return image.select(
        "origin", F.regexp_replace(S.base_name(F.lower("origin")), r"\.png$", "").alias("sha"),
        "width", "height", F.when(gray, pixels).alias("pixels"))


PREDICTION_SCHEMA = T.StructType([
    T.StructField("view", T.StringType()), T.StructField("seed", T.IntegerType()),
    T.StructField("month", T.StringType()), T.StructField("sha", T.StringType()),
    T.StructField("label", T.IntegerType()),
    T.StructField("logits", T.ArrayType(T.DoubleType())),
    T.StructField("embedding", T.ArrayType(T.FloatType())),
])


def scan_predictions(spark: SparkSession, path: str, classes: int,
                     views: Sequence[str] | None = None, seeds: Sequence[int] | None = None,
                     months: Sequence[str] | None = None, check: bool = True) -> DataFrame:
    """Stored predictions without their embeddings, which the column pruning leaves unread.

    The checksums that were recorded at writing are compared with those of the rows, in the
    pass that checks the rows themselves.
    """
    rows = spark.read.schema(PREDICTION_SCHEMA).parquet(path).drop("embedding")
    chosen = F.lit(True)
    for name, wanted in (("view", views), ("seed", seeds), ("month", months)):
        if wanted:
            chosen = chosen & F.col(name).isin(*wanted)
    rows = rows.where(chosen)
    if check:
        recorded = spark.read.parquet(f"{path.rstrip('/')}_checksums").where(chosen)
        require_clean(K.check_export(rows, recorded, classes), f"predictions {path}")
        require_clean(K.repeated_samples(rows), f"predictions {path}")
    return rows


def scan_json_records(spark: SparkSession, path: str, schema: T.StructType | str | None = None,
                      lines: bool = True) -> DataFrame:
    """JSON lines (histories) or whole-file records (reports)."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.option("multiLine", not lines).option("mode", "FAILFAST").json(path)
