"""Writers: view datasets, contract CSV, JSON records, predictions and report sets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoview.errors import require_clean, require_columns
from chronoview.operators import metrics as M
from chronoview.operators import validate as K
from chronoview.session import staged


def write_views(views: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """split/month/modality folders.

    Rows are rebalanced by folder: adaptive execution splits a folder that is larger than the
    advised partition, so a month with a third of all samples is written by as many tasks as
    its bytes need, and no folder gets a file from every task.
    """
    folder = ["split", "month", "modality"]
    writer = views.hint("rebalance", *(F.col(c) for c in folder)).write.mode(mode)
    if mode == "overwrite":
        writer = writer.option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(*folder).parquet(path)


def write_contract_csv(df: DataFrame, path: str, columns: Sequence[str],
                       order: Sequence | None = None, single_file: bool = False) -> None:
    """Fixed column order with a header, sorted; one file only for small reports."""
    require_columns(df, set(columns), path)
    rows = df.orderBy(*order) if order else df
    rows = rows.select(*columns)
    if single_file:
        rows = rows.coalesce(1)
    rows.write.mode("errorifexists").option("header", True).option("emptyValue", "") \
        .option("nullValue", "").option("ignoreLeadingWhiteSpace", False) \
        .option("ignoreTrailingWhiteSpace", False).csv(path)


def write_json_record(df: DataFrame, path: str) -> None:
    """Sorted-key JSON lines; NaN or infinite numbers are refused before anything is written."""
    checks = {}
    for field in df.schema.fields:
        if field.dataType.typeName() in ("double", "float"):
            value = F.col(field.name)
            checks[f"{field.name}_not_finite"] = F.isnan(value) | (F.abs(value) == float("inf"))
    if checks:
        require_clean(K.broken_rules(df, [], checks), path)
    line = F.to_json(F.struct(*(F.col(c) for c in sorted(df.columns))),
                     {"ignoreNullFields": "false"})
    df.select(line.alias("value")).write.mode("errorifexists").text(path)


def write_predictions(predictions: DataFrame, path: str, classes: int,
                      mode: str = "errorifexists") -> None:
    """view/seed/month folders after the export checks, plus class counts and checksums.

    The rows may be the end of an inference run, so they are computed once: stored in the
    shared folder, checked and counted there, then published.
    """
    predictions = staged(predictions, "predictions")
    require_clean(K.check_predictions(predictions, classes), path)
    writer = predictions.write.mode(mode)
    if mode == "overwrite":
        writer = writer.option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("view", "seed", "month").parquet(path)
    class_counts(predictions).write.mode(mode).parquet(f"{path.rstrip('/')}_class_counts")
    K.export_checksums(predictions).drop("broken").write.mode(mode).parquet(
        f"{path.rstrip('/')}_checksums")


def class_counts(predictions: DataFrame) -> DataFrame:
    return predictions.groupBy("view", "seed", "month", "label").agg(F.count("*").alias("n"))


def report_lines(per_class: DataFrame, names: DataFrame,
                 keys: Sequence[str] = M.MODEL_KEYS) -> DataFrame:
    """Fixed-width text lines of a classification report; undefined values print as '-'."""
    def number(name: str):
        return F.coalesce(F.format_number(F.round(F.col(name), 4), 4), F.lit("-"))
    joined = per_class.join(names.select("class_id", "family"), "class_id", "left")
    return joined.select(*keys, "class_id", F.format_string(
        "%-24s %10s %10s %10s %10d", F.coalesce("family", F.col("class_id").cast("string")),
        number("precision"), number("recall"), number("f1"), F.col("support")).alias("line"))


def wide_confusion(confusion: DataFrame, classes: int,
                   keys: Sequence[str] = M.MODEL_KEYS) -> DataFrame:
    """One row per true class, one column per predicted class."""
    return (confusion.groupBy(*keys, "label").pivot("predicted", list(range(classes)))
            .agg(F.sum("n")).na.fill(0))


def write_report_set(facts: DataFrame, names: DataFrame, classes: int, path: str,
                     scored: DataFrame | None = None,
                     keys: Sequence[str] = M.MODEL_KEYS) -> None:
    """Scalars (JSON), per-class and confusion tables (CSV), text lines and predictions.

    Everything but the prediction table comes from the aggregated facts.
    """
    root = path.rstrip("/")
    per_class = M.per_class_report(facts, classes, keys)
    write_json_record(M.report_rows(facts, classes, keys), f"{root}/report_json")
    write_json_record(M.ece_bins(facts, keys), f"{root}/ece_bins_json")
    named = per_class.join(names.select("class_id", "family"), "class_id", "left")
    write_contract_csv(named, f"{root}/classification_report_csv",
                       [*keys, "class_id", "family", "precision", "recall", "f1", "support",
                        "predicted_count", "tp", "fp", "fn", "status"], [*keys, "class_id"])
    wide = wide_confusion(M.confusion_matrix(facts, classes, keys), classes, keys)
    write_contract_csv(wide, f"{root}/confusion_matrix_csv",
                       [*keys, "label", *map(str, range(classes))], [*keys, "label"])
    lines = report_lines(per_class, names, keys).orderBy(*keys, "class_id")
    lines.select("line").write.mode("errorifexists").text(f"{root}/classification_report_txt")
    if scored is not None:
        table = M.predictions_table(scored, keys)
        write_contract_csv(table, f"{root}/predictions_csv", table.columns)
