"""Incremental generation: files that arrive later are viewed once, finished ones never again."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoview.functions import scalars as S
from chronoview.operators import dataset as G
from chronoview.operators.selection import skip_completed
from chronoview.session import staged

BINARY_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


KEY = ("sha", "modality", "config_id")
LOG_SCHEMA = "sha string, modality string, config_id string, status string, batch_id bigint"


def stored_files(spark: SparkSession, source: str,
                 files_per_batch: int = 100_000) -> DataFrame:
    """A stream of (member, sha, content) of the files under a folder."""
    return (spark.readStream.format("binaryFile").schema(BINARY_SCHEMA)
            .option("recursiveFileLookup", True).option("maxFilesPerTrigger", files_per_batch)
            .load(source)
            .select(F.col("path").alias("member"), S.sha_from_filename(F.col("path"))
                    .alias("sha"), "content"))


def incremental_views(blobs: DataFrame, manifest: DataFrame, config_id: str,
                      output: str, log: str, checkpoint: str,
                      modalities: Sequence[str] = G.MODALITIES) -> None:
    """View every blob of a stream (member, sha, content) that is not finished yet, and stop.

    The stream's checkpoint remembers what it has offered; the log keeps a replayed batch from
    writing an item twice, per configuration. A blob whose sample is not in the manifest is
    logged as WAITING; where manifest rows may come later, ``views_as_both_arrive`` keeps such
    blobs until their row is there. Each batch writes to its own folder, in overwrite mode, so a retried batch replaces its own
    output only. Finished items are dropped before they are viewed.
    """
    names = F.array(*(F.lit(m) for m in modalities))

    def one_batch(batch: DataFrame, batch_id: int) -> None:
        arrived = batch.select("sha").distinct().withColumn("config_id", F.lit(config_id))
        items = arrived.withColumn("modality", F.explode(names))
        items = unfinished(items, log, batch_id)
        known = manifest.select("sha")
        items = staged(items.join(known, "sha", "left_semi"), "stream-items")
        done = viewed(manifest, batch, items, config_id, modalities,
                      f"{output.rstrip('/')}/batch={batch_id}")
        waiting = arrived.join(known, "sha", "left_anti").withColumn(
            "modality", F.explode(names)).select(*KEY, F.lit("WAITING").alias("status"))
        logged(done.unionByName(waiting), log, batch_id)

    query = (blobs.writeStream.foreachBatch(one_batch).option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).start())
    query.awaitTermination()


def unfinished(items: DataFrame, log: str, batch_id: int) -> DataFrame:
    """Items that no earlier batch has finished; a replayed batch does not see its own log."""
    if batch_id == 0:
        return items
    earlier = items.sparkSession.read.option("recursiveFileLookup", True).schema(
        LOG_SCHEMA).parquet(log).where(F.col("batch_id") < batch_id)
    return skip_completed(items, earlier, KEY)


def viewed(manifest: DataFrame, blobs: DataFrame, items: DataFrame, config_id: str,
           modalities: Sequence[str], folder: str) -> DataFrame:
    """Write the views of the items to their own folder; returns their log rows."""
    # What is wanted of a sample comes with its manifest row: views are not joined once more.
    wanted = items.groupBy("sha").agg(F.collect_set("modality").alias("wanted"))
    views = G.generate_views(manifest.join(wanted, "sha"), blobs, config_id, modalities)
    views.write.mode("overwrite").partitionBy("split", "month", "modality").parquet(folder)
    written = items.sparkSession.read.option("basePath", folder).schema(views.schema).parquet(
        folder)
    return G.generation_log(written).withColumn("config_id", F.lit(config_id)).select(
        *KEY, "status")


def logged(rows: DataFrame, log: str, batch_id: int, part: str = "") -> None:
    rows.withColumn("batch_id", F.lit(batch_id).cast("bigint")).write.mode("overwrite").parquet(
        f"{log.rstrip('/')}/batch={batch_id}{part}")


def named_files(rows: DataFrame) -> DataFrame:
    """(member, sha, content) of files by name: only these are opened."""
    names = [r["member"] for r in rows.select("member").collect()]
    spark = rows.sparkSession
    if not names:
        return spark.createDataFrame([], "member string, sha string, content binary")
    files = spark.read.format("binaryFile").load(names)
    return files.select(F.col("path").alias("member"),
                        S.sha_from_filename(F.col("path")).alias("sha"), "content")


def views_as_both_arrive(names: DataFrame, rows: DataFrame,
                         fetch: Callable[[DataFrame], DataFrame], config_id: str, output: str,
                         log: str, checkpoint: str, modalities: Sequence[str] = G.MODALITIES,
                         files_per_read: int | None = 100_000) -> None:
    """View every blob once both it and its manifest row are there, in whichever order; and stop.

    ``names`` streams (member, sha), ``rows`` streams manifest rows. Both wait in the state of
    their join, keyed by sha, for the other side, across batches and runs, so nothing is left
    WAITING once its row has come. The state has names and rows only: contents are opened by
    ``fetch(rows with member and sha)`` when they are released, at most about
    ``files_per_read`` names at a time; None is for a ``fetch`` that scans a table and takes no
    name to the driver: it reads all that a batch released in one scan. What ``fetch`` gives of
    other samples is dropped. A row or blob that comes again is viewed once.
    """
    identity = rows.select("sha", *G.IDENTITY)
    both = names.select("sha", "member").join(identity, "sha")
    kinds = F.array(*(F.lit(m) for m in modalities))

    def one_batch(batch: DataFrame, batch_id: int) -> None:
        first = F.min(F.struct("member", *G.IDENTITY)).alias("_first")
        ready = batch.groupBy("sha").agg(first).select("sha", "_first.*")
        items = ready.withColumn("config_id", F.lit(config_id)).withColumn(
            "modality", F.explode(kinds))
        items = staged(unfinished(items, log, batch_id), "stream-ready")
        parts = 1 if files_per_read is None else max(
            1, -(-items.count() // (files_per_read * len(modalities))))
        for k in range(parts):
            part = items.where(F.pmod(F.xxhash64("member"), F.lit(parts)) == k)
            samples = part.select("sha", "member", *G.IDENTITY).distinct()
            done = viewed(samples.drop("member"), fetch(samples.select("member", "sha")),
                          part.select(*KEY), config_id, modalities,
                          f"{output.rstrip('/')}/batch={batch_id}/part={k}")
            logged(done, log, batch_id, f"/part={k}")

    query = (both.writeStream.foreachBatch(one_batch).option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).start())
    query.awaitTermination()
