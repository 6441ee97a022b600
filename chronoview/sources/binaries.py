"""Binary sources: folders of files and members of ZIP archives."""

from __future__ import annotations

import zipfile
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from chronoview.functions import scalars as S


def scan_binary_folder(spark: SparkSession, root: str, content: bool = True,
                       glob: str | None = None) -> DataFrame:
    """(member, sha, size[, content]) of every file below a folder.

    Without ``content`` the reader prunes it and only the file listing is used.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    files = reader.load(root)
    return files.select(F.col("path").alias("member"), S.sha_from_filename(F.col("path"))
                        .alias("sha"), F.col("length").alias("size"),
                        *(["content"] if content else []))


class MemberSlice(InputPartition):
    """A run of archive members read by one task."""

    def __init__(self, path: str, start: int, stop: int):
        self.path, self.start, self.stop = path, start, stop


class ZipMembersReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.index_only = options.get("indexonly", "false").lower() == "true"
        self.bytes_per_task = int(options.get("bytespertask", 128 << 20))

    def _members(self, archive: zipfile.ZipFile) -> list[zipfile.ZipInfo]:
        return [m for m in archive.infolist() if not m.is_dir()]

    def partitions(self) -> list[InputPartition]:
        """Slices of about equal uncompressed bytes, from the archive's directory alone."""
        with zipfile.ZipFile(self.path) as archive:
            sizes = [m.file_size for m in self._members(archive)]
        slices, start, filled = [], 0, 0
        for i, size in enumerate(sizes):
            filled += size
            if filled >= self.bytes_per_task:
                slices.append(MemberSlice(self.path, start, i + 1))
                start, filled = i + 1, 0
        if start < len(sizes) or not slices:
            slices.append(MemberSlice(self.path, start, len(sizes)))
        return slices

    def read(self, partition: MemberSlice) -> Iterator[tuple]:
        with zipfile.ZipFile(partition.path) as archive:
            for member in self._members(archive)[partition.start:partition.stop]:
                content = None if self.index_only else archive.read(member)
                yield (member.filename, int(member.file_size), int(member.compress_size),
                       f"{member.CRC:08x}", content)


class ZipMembers(DataSource):
    """``spark.read.format("zip_members").load(archive)``; option indexOnly skips contents."""

    @classmethod
    def name(cls) -> str:
        return "zip_members"

    def schema(self) -> str:
        return ("member string, size bigint, compressed_size bigint, crc32 string, "
                "content binary")

    def reader(self, schema) -> DataSourceReader:
        return ZipMembersReader(self.options)


def scan_zip_members(spark: SparkSession, path: str, content: bool = True,
                     bytes_per_task: int = 128 << 20) -> DataFrame:
    """(member, sha, size, compressed_size, crc32[, content]); nothing is extracted to disk.

    Every member is checked by size and CRC while it is read (the archive format's own
    check); slices of members are independent tasks and can be retried anywhere.
    """
    spark.dataSource.register(ZipMembers)
    rows = (spark.read.format("zip_members").option("indexOnly", str(not content).lower())
            .option("bytesPerTask", bytes_per_task).load(path))
    sha = S.sha_from_filename(F.col("member"))
    return rows.select("member", sha.alias("sha"), "size", "compressed_size", "crc32",
                       *(["content"] if content else []))
