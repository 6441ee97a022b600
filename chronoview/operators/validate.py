"""Fail-closed checks: each returns a violations frame (subject, rule); empty means valid."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoview.functions import scalars as S
from chronoview.functions import vectors as V
from chronoview.operators.ranking import lookup_join


def broken_rules(df: DataFrame, subject: Sequence[str], rules: dict[str, Column]) -> DataFrame:
    """One row per (subject, rule) whose condition holds; one projection, no shuffle."""
    flags = [F.when(F.coalesce(condition, F.lit(False)), F.lit(rule))
             for rule, condition in rules.items()]
    return df.select(*subject, F.explode(F.array_compact(F.array(*flags))).alias("rule"))


def check_ids(df: DataFrame, id_column: str = "sha") -> DataFrame:
    """Null, blank and (case-insensitively) repeated ids, one row per bad id."""
    key = S.normalize_id(F.col(id_column))
    per_id = df.groupBy(key.alias("subject")).agg(F.count("*").alias("n"))
    return broken_rules(per_id, ["subject"], {
        "id_null": F.col("subject").isNull(),
        "id_blank": F.col("subject") == "",
        "id_repeated": (F.col("n") > 1) & (F.col("subject") != ""),
    })


def check_label_map(label_map: DataFrame, size: int | None = None) -> DataFrame:
    """A one-to-one map of lower-cased families to ids 0..C-1."""
    family = S.normalize_family(F.col("family"), lower=True)
    class_id = S.integer_or_null(F.col("class_id"))
    typed = label_map.select(family.alias("family"), class_id.alias("class_id"),
                             F.col("class_id").cast("string").alias("raw"))
    bad_rows = broken_rules(
        typed.select(F.coalesce("family", F.lit("")).alias("subject"), "family", "class_id"),
        ["subject"], {"family_blank": F.col("family").isNull(),
                      "class_id_not_integer": F.col("class_id").isNull()})
    repeated = (typed.groupBy(F.col("family").alias("subject")).agg(F.count("*").alias("n"))
                .where("n > 1 AND subject IS NOT NULL")
                .select("subject", F.lit("family_repeated").alias("rule")))
    shared = (typed.groupBy("class_id").agg(F.count("*").alias("n"))
              .where("n > 1 AND class_id IS NOT NULL")
              .select(F.col("class_id").cast("string").alias("subject"),
                      F.lit("class_id_repeated").alias("rule")))
    whole = broken_rules(
        typed.agg(F.count("*").alias("n"), F.count_distinct("class_id").alias("ids"),
                  F.min("class_id").alias("low"), F.max("class_id").alias("high")),
        [], {"class_ids_not_contiguous": (F.col("low") != 0) | (F.col("high") + 1 != F.col("ids")),
             "wrong_number_of_classes": F.lit(False) if size is None else F.col("n") != size,
             "empty_map": F.col("n") == 0}
    ).select(F.lit("map").alias("subject"), "rule")
    return bad_rows.unionByName(repeated).unionByName(shared).unionByName(whole)


def check_bijection(df: DataFrame, left: str = "family", right: str = "class_id") -> DataFrame:
    """Families with several ids and ids with several families in any table."""
    pairs = df.select(F.col(left).cast("string").alias("l"),
                      F.col(right).cast("string").alias("r")).distinct()
    many_right = (pairs.groupBy(F.col("l").alias("subject")).agg(F.count("*").alias("n"))
                  .where("n > 1").select("subject", F.lit(f"{left}_has_several_{right}")
                                         .alias("rule")))
    many_left = (pairs.groupBy(F.col("r").alias("subject")).agg(F.count("*").alias("n"))
                 .where("n > 1").select("subject", F.lit(f"{right}_has_several_{left}")
                                        .alias("rule")))
    return many_right.unionByName(many_left)


def check_manifest(manifest: DataFrame, label_map: DataFrame,
                   ranges: Sequence[tuple[str, str, str]] = S.SPLIT_RANGES) -> DataFrame:
    """Every row rule of the canonical manifest plus id uniqueness."""
    names = {name for name, _, _ in ranges}
    frozen = label_map.select(F.col("family").alias("_family"),
                              F.col("class_id").cast("string").alias("_class"))
    keyed = lookup_join(
        manifest.withColumn("_family", S.normalize_family(F.col("family"), lower=True)),
        frozen, ["_family"], "left")
    ts = S.parse_iso_timestamp(F.col("timestamp").cast("string"))
    split = S.normalize_split(F.col("split"))
    size = F.nullif(F.trim(F.col("file_size").cast("string")), F.lit(""))
    crc = F.nullif(S.normalize_id(F.col("zip_crc32")), F.lit(""))
    staged = keyed.select(
        S.normalize_id(F.col("sha")).alias("subject"), ts.alias("_ts"), split.alias("_split"),
        F.trim(F.col("class_id").cast("string")).alias("_given"), "_class",
        F.trim("month").alias("_month"), size.alias("_size"), crc.alias("_crc"))
    rows = broken_rules(staged, ["subject"], {
        "sha_format": ~S.is_sha256(F.col("subject")) | F.col("subject").isNull(),
        "class_map": F.col("_class").isNull() | ~F.col("_given").eqNullSafe(F.col("_class")),
        "unknown_split": F.col("_split").isNull() | ~F.col("_split").isin(*names),
        "timestamp": F.col("_ts").isNull(),
        "date_outside_split": F.col("_ts").isNotNull() & F.col("_split").isNotNull()
        & (S.assign_split(F.col("_ts"), ranges) != F.col("_split")),
        "month_mismatch": F.col("_ts").isNotNull()
        & ~F.col("_month").eqNullSafe(S.month_label(F.col("_ts"))),
        "file_size": F.col("_size").isNotNull()
        & ~(F.col("_size").rlike(r"^\d+$") & (F.col("_size").try_cast("bigint") > 0)),
        "zip_crc32": F.col("_crc").isNotNull() & ~F.col("_crc").rlike(S.CRC_PATTERN),
    })
    repeated = check_ids(manifest).where("rule = 'id_repeated'")
    return rows.unionByName(repeated)


def check_paths(df: DataFrame, root: str, files: DataFrame | None = None,
                path: str = "image_path") -> DataFrame:
    """Unsafe paths, paths shared by several ids, and (given an index) missing files."""
    resolved = df.select("sha", F.col(path).alias("path"),
                         S.resolve_path(root, F.col(path)).alias("resolved"))
    unsafe = resolved.where(F.col("resolved").isNull()).select(
        F.col("sha").alias("subject"), F.lit("path_empty_or_unsafe").alias("rule"))
    shared = (resolved.where(F.col("resolved").isNotNull()).groupBy("resolved")
              .agg(F.count("*").alias("n")).where("n > 1")
              .select(F.col("resolved").alias("subject"), F.lit("path_shared").alias("rule")))
    found = unsafe.unionByName(shared)
    if files is not None:
        absent = (resolved.where(F.col("resolved").isNotNull())
                  .join(files.select(F.col("path").alias("resolved")), "resolved", "left_anti")
                  .select(F.col("sha").alias("subject"), F.lit("file_missing").alias("rule")))
        found = found.unionByName(absent)
    return found


def view_image_rules() -> dict:
    """4096 cells; integers 0..255 for transition views, finite [0, 1] for the others."""
    pixels = F.col("pixels")
    byte = F.forall(pixels, lambda p: p.isNotNull() & (p >= 0) & (p <= 255) & (F.floor(p) == p))
    unit = F.forall(pixels, lambda p: p.isNotNull() & ~F.isnan(p) & (p >= 0) & (p <= 1))
    return {
        "modality": ~F.col("modality").isin("raw_byte", "entropy", "sbsmi"),
        "shape": pixels.isNull() | (F.size(pixels) != 4096),
        "range": F.when(F.col("modality") == "sbsmi", ~byte).otherwise(~unit),
    }


def check_view_images(views: DataFrame) -> DataFrame:
    return broken_rules(views, ["sha", "modality"], view_image_rules())


EXPORT_KEYS = ("view", "seed", "month")
LIMBS = tuple(f"limb{k}" for k in range(4))


def prediction_rules(classes: int) -> dict:
    return {
        "sha_format": ~S.is_sha256(F.col("sha")) | (S.normalize_id(F.col("sha")) != F.col("sha")),
        "label_range": F.col("label").isNull() | (F.col("label") < 0)
        | (F.col("label") >= classes),
        "logits_width": F.col("logits").isNull() | (F.size("logits") != classes),
        "logits_finite": ~V.all_finite(F.col("logits")),
    }


def repeated_samples(predictions: DataFrame) -> DataFrame:
    return (predictions.groupBy(*EXPORT_KEYS, "sha").agg(F.count("*").alias("n"))
            .where("n > 1").select(*EXPORT_KEYS, "sha", F.lit("sample_repeated").alias("rule")))


def check_predictions(predictions: DataFrame, classes: int) -> DataFrame:
    """Row rules of a prediction export plus repeated ids per (view, seed, month)."""
    rows = broken_rules(predictions, [*EXPORT_KEYS, "sha"], prediction_rules(classes))
    return rows.unionByName(repeated_samples(predictions))


def export_checksums(predictions: DataFrame, classes: int | None = None) -> DataFrame:
    """Per (view, seed, month): rows, four sums that stand for all of them, broken row rules.

    Every row (sha, label, logits bit by bit) is hashed to 128 bits, whose four 32-bit limbs are
    summed: the order and the partitioning of rows do not matter, and sums of parts add up. With
    ``classes`` the same pass counts the rows that break a rule of exports.
    """
    text = F.concat_ws("|", F.coalesce("sha", F.lit("-")), F.coalesce(
        F.col("label").cast("string"), F.lit("-")), F.coalesce(
        V.exact_text(F.col("logits")), F.lit("-")))
    digest = F.md5(text)
    rules = {} if classes is None else prediction_rules(classes)
    broken = F.lit(False)
    for rule in rules.values():
        broken = broken | F.coalesce(rule, F.lit(True))
    return predictions.groupBy(*EXPORT_KEYS).agg(
        F.count("*").alias("n"),
        *(F.sum(F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("bigint")).alias(name)
          for k, name in enumerate(LIMBS)),
        F.count_if(broken).alias("broken"))


def check_export(predictions: DataFrame, recorded: DataFrame, classes: int) -> DataFrame:
    """Violations of an export against its recorded checksums, with the row rules in one pass."""
    values = ["n", *LIMBS]
    actual = export_checksums(predictions, classes)
    both = actual.join(recorded.select(*EXPORT_KEYS, *(F.col(c).alias(f"_{c}") for c in values)),
                       list(EXPORT_KEYS), "full_outer")
    same = F.lit(True)
    for c in LIMBS:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return broken_rules(both, EXPORT_KEYS, {
        "not_recorded": F.col("_n").isNull(), "export_missing": F.col("n").isNull(),
        "row_count": F.col("n") != F.col("_n"), "checksum": F.col("n").isNotNull()
        & F.col("_n").isNotNull() & ~same, "broken_rows": F.col("broken") > 0})


def check_class_counts(predictions: DataFrame, recorded: DataFrame) -> DataFrame:
    """Label counts against the counts recorded beside the export."""
    keys = ["view", "seed", "month", "label"]
    actual = predictions.groupBy(*keys).agg(F.count("*").alias("actual"))
    return (actual.join(recorded.select(*keys, F.col("n").alias("recorded")), keys, "full_outer")
            .where(~F.coalesce("actual", F.lit(0)).eqNullSafe(F.coalesce("recorded", F.lit(0))))
            .select(*keys, F.lit("class_count").alias("rule")))


def check_alignment(predictions: DataFrame, models: int) -> DataFrame:
    """Samples that are not scored once, with one label, by every (view, seed)."""
    per_sample = predictions.groupBy("month", "sha").agg(
        F.count("*").alias("n"), F.min("label").alias("low"), F.max("label").alias("high"))
    return broken_rules(per_sample, ["month", "sha"], {
        "not_scored_by_every_model": F.col("n") != models,
        "labels_differ": F.col("low") != F.col("high"),
    })


def check_grid(predictions: DataFrame, views: Sequence[str], seeds: Sequence[int],
               months: Sequence[str]) -> DataFrame:
    """(view, seed, month) cells that an experiment needs and lacks, or has beyond its grid.

    The grid is exploded from the arguments: a model that is wholly absent is found too.
    """
    def axis(values, kind):
        return F.explode(F.array(*(F.lit(v).cast(kind) for v in values)))
    keys = ["view", "seed", "month"]
    wanted = (predictions.sparkSession.range(1).select(axis(views, "string").alias("view"))
              .withColumn("seed", axis(seeds, "int")).withColumn("month", axis(months, "string"))
              .withColumn("_wanted", F.lit(True)))
    seen = predictions.select("view", F.col("seed").cast("int").alias("seed"), "month") \
        .distinct().withColumn("_seen", F.lit(True))
    return broken_rules(wanted.join(seen, keys, "full_outer"), keys, {
        "scores_missing": F.col("_seen").isNull(), "scores_not_asked_for": F.col("_wanted").isNull()})


def check_same_config(configs: DataFrame, expected: dict[str, str]) -> DataFrame:
    """Workers whose configuration id or input hashes differ from the first or the expected."""
    summary = configs.agg(F.count("*").alias("n"), F.min("config_id").alias("low"),
                          F.max("config_id").alias("high"))
    whole = broken_rules(summary, [], {
        "no_config": F.col("n") == 0, "configs_differ": F.col("low") != F.col("high")}
    ).select(F.lit("all").alias("subject"), "rule")
    rules = {f"{name}_mismatch": ~F.col(name).eqNullSafe(F.lit(value))
             for name, value in expected.items()}
    if not rules:
        return whole
    each = broken_rules(configs.select(F.col("worker").cast("string").alias("subject"),
                                       *expected), ["subject"], rules)
    return whole.unionByName(each)


def check_source_bytes(read: DataFrame) -> DataFrame:
    """Bytes actually read against the declared size, CRC and cached content hash."""
    return broken_rules(read, ["sha"], {
        "size": ~F.col("content_size").eqNullSafe(F.col("declared_size")),
        "crc": F.col("declared_crc32").isNotNull()
        & (F.col("content_crc32") != F.col("declared_crc32")),
        "cached_hash": F.col("cached_sha256").isNotNull()
        & (F.col("content_sha256") != F.col("cached_sha256")),
    })


def compare_views(left: DataFrame, right: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """Per (sha, modality): differing pixels, largest difference and PASS or FAIL.

    A view that only one side has is a FAIL.
    """
    keys = ["sha", "modality"]
    joined = left.select(*keys, F.col("pixels").alias("_l")).join(
        right.select(*keys, F.col("pixels").alias("_r")), keys, "full_outer")
    gaps = F.zip_with("_l", "_r", lambda a, b: F.abs(a.cast("double") - b.cast("double")))
    floats = F.zip_with("_l", "_r", lambda a, b: (a.cast("float") != b.cast("float")).cast("int"))
    measured = joined.select(
        *keys, F.size("_l").alias("_nl"), F.size("_r").alias("_nr"),
        F.size(F.filter(gaps, lambda g: g > 0)).cast("bigint").alias("differing_pixels"),
        F.array_max(gaps).alias("max_abs_difference"),
        F.aggregate(floats, F.lit(0), lambda a, x: a + x).cast("bigint")
        .alias("differing_float32"))
    exact = (F.col("modality") != "sbsmi") | (F.col("differing_pixels") == 0)
    passed = (F.col("_nl") == F.col("_nr")) & exact & (F.col("max_abs_difference") <= tolerance)
    return measured.select(*keys, "differing_pixels", "max_abs_difference", "differing_float32",
                           F.when(F.coalesce(passed, F.lit(False)), "PASS").otherwise("FAIL")
                           .alias("status"))
