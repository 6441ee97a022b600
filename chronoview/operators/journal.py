"""The journal of a view dataset: which items an attempt claims, and which it has committed.

A dataset folder holds

* ``views/attempt=N/split=../month=../modality=..``: what attempt N made,
* ``journal/claims/attempt=N``: the items (sha, modality, config_id) it set out to make, written
  before the first view,
* ``journal/commits/attempt=N``: items that are whole from then on, with the digests of pixels
  and source and the file that holds them, written after the last view.

An attempt counts only with its commits. What one that died left behind is read again, digest by
digest: files of whole views are adopted, others are set aside, and the items they lack are made
anew. So every run ends with the dataset that an undisturbed one makes.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoview.errors import ContractViolation
from chronoview.operators.dataset import IDENTITY, VIEW_SCHEMA, pixels_sha256
from chronoview.session import staged

ITEM = ("sha", "modality", "config_id")
PRINTS = ("content_sha256", "content_size", "content_crc32")
COMMITS = ("sha string, modality string, config_id string, output_sha256 string, "
           "content_sha256 string, content_size bigint, content_crc32 string, file string, "
           "attempt int")


@dataclass(frozen=True)
class Folder:
    """Paths of a dataset, and the few metadata operations they need."""

    spark: SparkSession
    root: str

    @property
    def views(self) -> str:
        return f"{self.root}/views"

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.root, *parts)))

    def _files(self):
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def exists(self, *parts: str) -> bool:
        return self._files().exists(self._path(*parts))

    def numbered(self, *parts: str, prefix: str, finished: bool = False) -> list[int]:
        """Numbers of the folders there; finished ones have their job's marker."""
        if not self.exists(*parts):
            return []
        names = [s.getPath().getName() for s in self._files().listStatus(self._path(*parts))]
        found = [int(n.removeprefix(prefix)) for n in names if n.startswith(prefix)]
        return sorted(n for n in found if not finished or self.exists(
            *parts, f"{prefix}{n}", "_SUCCESS"))

    def attempts(self, *parts: str, finished: bool = False) -> list[int]:
        return self.numbered(*parts, prefix="attempt=", finished=finished)

    def set_aside(self, name: str) -> None:
        """Move a file or folder of views out of every reader's sight, keeping it."""
        number = 0
        while self.exists("_set_aside", str(number), name):
            number += 1
        target = self._path("_set_aside", str(number), name)
        self._files().mkdirs(target.getParent())
        if not self._files().rename(self._path("views", name), target):
            raise ContractViolation(f"cannot set {name} aside in {self.root}")

    def next_attempt(self) -> int:
        seen = self.attempts("journal", "claims") + self.attempts("views")
        return max(seen, default=0) + 1


def folder(spark: SparkSession, path: str) -> Folder:
    return Folder(spark, path.rstrip("/"))


def _file(path: Column) -> Column:
    """A file's name below the views folder, however the source spells the rest."""
    return F.substring_index(path, "/views/", -1)


def items(selected: DataFrame, modalities, config_id: str) -> DataFrame:
    return selected.select("sha", F.explode(F.array(*(F.lit(m) for m in modalities)))
                           .alias("modality"), F.lit(config_id).alias("config_id"))


def claim(place: Folder, todo: DataFrame, attempt: int) -> None:
    todo.select(*ITEM).write.parquet(f"{place.root}/journal/claims/attempt={attempt}")


def committed(place: Folder) -> DataFrame:
    """Current commits: of an item's the latest."""
    done = place.attempts("journal", "commits", finished=True)
    if not done:
        return place.spark.createDataFrame([], COMMITS)
    paths = [f"{place.root}/journal/commits/attempt={n}" for n in done]
    rows = place.spark.read.option("basePath", f"{place.root}/journal/commits").schema(
        COMMITS).parquet(*paths)
    rest = F.struct("attempt", *(c for c in rows.columns if c not in (*ITEM, "attempt")))
    return rows.groupBy(*ITEM).agg(F.max(rest).alias("_last")).select(*ITEM, "_last.*").select(
        rows.columns)


def stored_views(place: Folder, tolerant: bool = False) -> DataFrame:
    """All rows below ``views`` with their file; ``tolerant`` skips files that cannot be read."""
    reader = place.spark.read.schema(VIEW_SCHEMA + ", attempt int")
    if tolerant:
        reader = reader.option("ignoreCorruptFiles", True).option("ignoreMissingFiles", True)
    return reader.parquet(place.views).withColumn("file", _file(F.col("_metadata.file_path")))


def view_files(place: Folder) -> DataFrame:
    """Names of all files of views, from the listing alone."""
    return place.spark.read.format("binaryFile").option("recursiveFileLookup", True).option(
        "pathGlobFilter", "*.parquet").load(place.views).select(_file(F.col("path")).alias("file"))


def recover(place: Folder, selected: DataFrame, modalities, config_id: str) -> DataFrame:
    """Rows of COMMITS for every wanted item whose stored pixels are whole; the rest goes.

    A file counts only as a whole: one that cannot be read, holds a wrong, unwanted or repeated
    view or lacks a committed one is set aside, and what it held is made again. Pixels are read
    once and only their digests go on.
    """
    if not place.exists("views"):
        return place.spark.createDataFrame([], COMMITS)
    known = committed(place)
    seen = staged(stored_views(place, tolerant=True).select(
        *ITEM, *IDENTITY, "output_sha256", *PRINTS, "status", "file", "attempt",
        pixels_sha256(F.col("pixels")).alias("_digest")), "journal-seen")
    wanted = items(selected, modalities, config_id).join(
        selected.select("sha", *(F.col(c).alias(f"_is_{c}") for c in IDENTITY)), "sha")
    agreed = known.select(*ITEM, F.col("output_sha256").alias("_agreed"),
                          F.col("file").alias("_home"))
    joined = seen.join(wanted, list(ITEM), "left").join(agreed, list(ITEM), "left")
    same = F.lit(True)
    for c in IDENTITY:
        same = same & F.col(c).eqNullSafe(F.col(f"_is_{c}"))
    whole = (same & (F.col("status") == "PASS")
             & F.col("output_sha256").eqNullSafe(F.col("_digest"))
             & F.coalesce(F.col("_agreed") == F.col("_digest"), F.lit(True))
             & F.coalesce(F.col("_home") == F.col("file"), F.lit(True)))
    judged = staged(joined.select(*seen.columns, F.coalesce(whole, F.lit(False)).alias("_whole")),
                    "journal-judged")
    first = judged.where("_whole").groupBy(*ITEM).agg(F.min("file").alias("_first"))
    repeated = judged.where("_whole").join(first, list(ITEM)).where("file <> _first")
    bad = staged(
        judged.where("NOT _whole").select("file")
        .unionByName(repeated.select("file"))
        .unionByName(view_files(place).join(judged.select("file"), "file", "left_anti"))
        .unionByName(known.join(judged.where("_whole"), [*ITEM, "file"], "left_anti")
                     .select("file")).distinct(), "journal-bad")
    here = view_files(place).join(bad, "file", "left_semi").distinct()
    for row in here.toLocalIterator():  # damaged files only, one name at a time
        place.set_aside(row["file"])
    return staged(judged.where("_whole").join(bad, "file", "left_anti").select(
        *ITEM, "output_sha256", *PRINTS, "file", "attempt"), "journal-whole")


def written(place: Folder, attempt: int) -> DataFrame:
    """Commit rows of what an attempt wrote; pixels stay unread."""
    path = f"{place.views}/attempt={attempt}"
    rows = place.spark.read.option("basePath", place.views).schema(
        VIEW_SCHEMA + ", attempt int").parquet(path)
    return rows.select(*ITEM, "output_sha256", *PRINTS,
                       _file(F.col("_metadata.file_path")).alias("file"), "attempt")


def commit(place: Folder, rows: DataFrame, attempt: int) -> None:
    """Make items count; the attempt that commits may have adopted them from another."""
    home = rows.withColumn("attempt", F.lit(attempt)).select(
        *(c.split()[0] for c in COMMITS.split(", ")))
    home.drop("attempt").write.parquet(f"{place.root}/journal/commits/attempt={attempt}")


def current_views(spark: SparkSession, path: str) -> DataFrame:
    """The views of a dataset that attempts have committed, without those still being made."""
    place = folder(spark, path)
    homes = committed(place).select(F.regexp_extract("file", r"^attempt=(\d+)/", 1).cast("int")
                                    .alias("home")).distinct()
    numbers = [r["home"] for r in homes.collect()]  # one per attempt
    return stored_views(place).where(F.col("attempt").isin(numbers)).drop("file", "attempt")
