"""Datasets of views, failing closed: generate, merge, audit."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from chronoview.errors import ContractViolation, require_clean
from chronoview.operators import dataset as G
from chronoview.operators import joins as J
from chronoview.operators import journal
from chronoview.operators import validate as K
from chronoview.operators.provenance import (
    claim_output,
    finish_output,
    record_hash,
    run_identity,
)
from chronoview.operators.selection import guard_future
from chronoview.operators.validate import broken_rules
from chronoview.session import staged
from chronoview.sources import sinks


def source_problems(selected: DataFrame, index: DataFrame, blank: bool = False) -> DataFrame:
    """Samples without a member, with several, with an empty one or not of the declared size.

    ``index`` has sha, member, size; a manifest may declare ``file_size`` per sample. With
    ``blank`` an empty member is no problem.
    """
    matched = J.match_sources(selected, index)
    rules = {"source_missing": F.col("status") == "missing",
             "source_ambiguous": F.col("status") == "ambiguous",
             "source_empty": F.lit(not blank) & (F.col("size") == 0)}
    if "file_size" in selected.columns:
        rules["source_size"] = F.col("file_size").isNotNull() & (
            F.col("size") != F.col("file_size"))
    return broken_rules(matched, ["sha"], rules)


def declared_problems(views: DataFrame, declared: DataFrame) -> DataFrame:
    """Bytes that were read against the size and CRC that the manifest or index declares."""
    read = views.where("status = 'PASS'").select(
        "sha", "content_size", "content_crc32", "content_sha256").distinct()
    wanted = declared.select(
        "sha", F.col("file_size").cast("bigint").alias("declared_size"),
        F.col("zip_crc32").alias("declared_crc32"))
    joined = read.join(wanted, "sha")
    return K.check_source_bytes(joined.withColumn("declared_size", F.coalesce(
        "declared_size", "content_size")).withColumn(
        "cached_sha256", F.lit(None).cast("string")))


def source_index(blobs: DataFrame) -> DataFrame:
    """sha, member, size: a declared size is taken, so that contents need not be read for it."""
    size = F.col("size") if "size" in blobs.columns else F.octet_length("content")
    return blobs.select("sha", "member", size.cast("bigint").alias("size"))


def dataset_identity(selected: DataFrame, settings: dict,
                     modalities: Sequence[str] = G.MODALITIES,
                     blank: bool = False) -> tuple[str, dict]:
    """(config_id, identity) of a generation run."""
    settings = {**settings, "modalities": list(modalities), **({"blank": True} if blank else {})}
    return record_hash(settings), run_identity(settings, {"selected": selected})


def changed_sources(blobs: DataFrame, whole: DataFrame) -> DataFrame:
    """Sources whose bytes are no longer those that the stored views were made from."""
    now = blobs.select("sha", F.sha2("content", 256).alias("_now"))
    made = whole.select("sha", "content_sha256").distinct()
    return broken_rules(now.join(made, "sha"), ["sha"], {
        "source_changed": F.col("_now") != F.col("content_sha256")})


def generate_dataset(spark: SparkSession, selected: DataFrame, blobs: DataFrame, settings: dict,
                     path: str, frozen_id: str | None = None,
                     modalities: Sequence[str] = G.MODALITIES,
                     verify_sources: bool = False, blank: bool = False) -> DataFrame:
    """Select, guard, match, view, check, commit and log; returns the log of this run.

    ``blobs`` has sha, member, content and, if known, size. Mixed or unfrozen future rows,
    missing, ambiguous or empty sources and an output of another run are refused before the
    first write. Every run reads what is stored again: items whose pixels still have their
    digest are VERIFIED (with ``verify_sources`` also by their source's bytes), all others are
    made, CREATED. A run that died at any point is so continued, and a damaged file mended.
    Views are written once, checked from figures taken while they are written, and count from
    the commit on; views that could not be made, or whose bytes are not those declared, are set
    aside and refused. With ``blank`` sources without bytes are not refused: their views are
    all zero.
    """
    config_id, identity = dataset_identity(selected, settings, modalities, blank)
    require_clean(guard_future(selected, frozen_id, config_id), path)
    require_clean(source_problems(selected, source_index(blobs), blank), path)
    claim_output(spark, path, identity)
    place = journal.folder(spark, path)
    whole = journal.recover(place, selected, modalities, config_id)
    if verify_sources:
        require_clean(changed_sources(blobs, whole), path)
    wanted = journal.items(selected, modalities, config_id)
    todo = staged(wanted.join(whole, list(journal.ITEM), "left_anti"), "journal-todo")
    attempt = place.next_attempt()
    made = spark.createDataFrame([], journal.COMMITS)
    if not todo.isEmpty():
        journal.claim(place, todo, attempt)
        made = make_views(place, selected, blobs, todo, attempt, config_id, modalities, blank)
    settled = journal.committed(place).select(*journal.ITEM, "file")
    adopted = whole.join(settled, [*journal.ITEM, "file"], "left_anti")
    fresh = staged(adopted.unionByName(made), "journal-fresh")
    if not fresh.isEmpty():
        journal.commit(place, fresh, attempt)
    log = selected.select("sha", "split", "month").join(wanted, "sha").join(
        todo.select(*journal.ITEM, F.lit(True).alias("_made")), list(journal.ITEM), "left").select(
        "sha", "split", "month", "modality",
        F.when(F.col("_made"), "CREATED").otherwise("VERIFIED").alias("status"),
        F.lit(None).cast("string").alias("error"), "config_id")
    run = f"{place.root}/log/run={uuid.uuid4().hex}"
    log.write.parquet(run)
    finish_output(spark, path, identity)
    return spark.read.parquet(run)


def make_views(place: journal.Folder, selected: DataFrame, blobs: DataFrame, todo: DataFrame,
               attempt: int, config_id: str, modalities: Sequence[str],
               blank: bool = False) -> DataFrame:
    """Write the views of the claimed items and return their commit rows, or refuse them all."""
    samples = selected.join(todo.select("sha").distinct(), "sha", "left_semi")
    views = G.as_stored(G.generate_views(samples, blobs, config_id, modalities, blank).join(
        todo, list(journal.ITEM), "left_semi"))
    watch = Observation()
    name = f"attempt={attempt}"
    sinks.write_views(views.observe(watch, *G.view_figures()), f"{place.views}/{name}")
    made = staged(journal.written(place, attempt), "journal-made")
    try:
        require_clean(broken_rules(made.join(todo, list(journal.ITEM), "right"), list(
            journal.ITEM), {"view_missing": F.col("output_sha256").isNull()}), place.root)
        G.require_figures(watch.get, made, place.root)
        if {"file_size", "zip_crc32"} <= set(selected.columns):
            require_clean(declared_problems(made.withColumn("status", F.lit("PASS")), selected),
                          place.root)
    except ContractViolation:
        place.set_aside(name)
        raise
    return made


def merge_dataset(selected: DataFrame, workers: dict[str, DataFrame],
                  modalities: Sequence[str] = G.MODALITIES,
                  previous: DataFrame | None = None) -> DataFrame:
    """The merged manifest of several workers' reports, or a refusal.

    All workers need one configuration, every (sample, modality) exactly one passing report,
    every sample the same bytes in all views; with a ``previous`` manifest its frozen columns
    must agree, and its rows are kept or extended.
    """
    if not workers:
        raise ContractViolation("no worker to merge")
    reports = staged(G.union_workers(workers), "merge-reports")
    configs = reports.select("worker", "config_id").distinct()
    require_clean(K.check_same_config(configs, {}), "workers")
    require_clean(G.candidate_problems(selected, reports, modalities), "candidates")
    wanted = reports.join(selected.select("sha"), "sha", "left_semi")
    merged = staged(G.merge_views(selected, wanted, modalities), "merged")
    require_clean(broken_rules(merged, ["sha"], {
        "not_merged": F.col("merge_status") != "merged"}), "merge")
    merged = merged.drop("merge_status")
    if previous is None:
        return merged
    require_clean(G.upsert_conflicts(previous, merged), "previous manifest")
    return G.upsert_manifest(previous, merged)
