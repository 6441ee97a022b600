"""Vector codes by Lloyd's algorithm with resident members.

A vector is cut into parts; each part position has a codebook of entries. Its members, the
parts nearest to an entry, live with an owner (position, entry, salt); owners are dealt over
slots, and a table bucketed by slot holds them. The salts bound an owner's members even if one
entry has them all.

1. A round first reads every slot's members where they lie and, by the only shuffle, those that
   changed their entry in the round before. Each task assigns its members to the nearest entry
   and stores them at home, with the slot of the new entry beside it.
2. Entries are updated from partial sums, one per owner (and one per slot and entry for members
   about to move). The driver sees parts x entries sums, whatever the size of the table.
3. The next round leaves members of the same owner in place; the others migrate.

A lost executor costs nothing stored: every round is a table in the shared folder.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoview.llm.vectors import comparable, matrix, numbered
from chronoview.llm.words import mix
from chronoview.session import scratch_path, staged

OWNER_ROWS = 1 << 14
SLOT_ROWS = 1 << 16
MAX_BUCKETS = 50_000
STEP = 4096
MEMBERS = "home int, slot int, row long, part int, entry int, point array<int>"
ASSIGNED = "row long, part int, entry int, distance long"
RESULT = ("vec_id long, label int, code string, error long, label_error long, "
          "codebooks_sha256 string")


def nearest(points: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry (ties to the lower) and the squared distance, exact."""
    entry, distance = (np.zeros(len(points), np.int64) for _ in range(2))
    points, book = comparable(points, book)
    norms = (book * book).sum(axis=1)
    for at in range(0, len(points), STEP):
        part = points[at:at + STEP]
        far = norms - 2 * (part @ book.T) + (part * part).sum(axis=1)[:, None]
        entry[at:at + STEP] = far.argmin(axis=1)
        distance[at:at + STEP] = far.min(axis=1)
    return entry, distance


class Layout:
    """Where owners live: salts of an entry, slots, and buckets of the stored table."""

    def __init__(self, rows: int, parts: int, shuffle_partitions: int):
        self.salts = -(-rows // OWNER_ROWS)
        self.slots = max(shuffle_partitions, -(-rows * parts // SLOT_ROWS))
        self.buckets = min(MAX_BUCKETS, self.slots)

    def slot(self, part: np.ndarray, entry: np.ndarray, row: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            salt = mix(row.astype(np.uint64)) % np.uint64(self.salts)
            owner = mix(mix(part.astype(np.uint64) << np.uint64(32) | entry.astype(np.uint64))
                        + salt)
            return (owner % np.uint64(self.slots)).astype(np.int32)


def assign(part: np.ndarray, points: np.ndarray,
           books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    entry, distance = (np.zeros(len(part), np.int64) for _ in range(2))
    for k in range(len(books)):
        own = np.flatnonzero(part == k)
        if len(own):
            entry[own], distance[own] = nearest(points[own], books[k])
    return entry, distance


def settle(parts: DataFrame, books: np.ndarray, layout: Layout) -> DataFrame:
    """First assignment: every part moves to its owner."""
    def run(batches):
        for batch in batches:
            part, row = (batch.column(c).to_numpy() for c in ("part", "row"))
            entry, _ = assign(part, matrix(batch.column("point"), len(part)), books)
            slot = pa.array(layout.slot(part, entry, row))
            yield pa.RecordBatch.from_arrays(
                [slot, slot, batch.column("row"), batch.column("part"),
                 pa.array(entry, pa.int32()), batch.column("point")],
                names=["home", "slot", "row", "part", "entry", "point"])

    return parts.mapInArrow(run, MEMBERS).repartition(layout.buckets, "home")


def gathered(members: DataFrame):
    """Residents, read where they lie, beside the members that arrive."""
    columns = ["row", "part", "point"]
    stay = members.where("slot = home").select("home", *columns)
    come = members.where("slot != home").select(F.col("slot").alias("home"), *columns)
    return stay.groupBy("home").cogroup(come.groupBy("home"))


def both(stay: pa.Table, come: pa.Table):
    table = pa.concat_tables([stay, come])
    part, row = (table.column(c).to_numpy() for c in ("part", "row"))
    return table, part, row, matrix(table.column("point"), len(part))


def reassign(members: DataFrame, books: np.ndarray, layout: Layout) -> DataFrame:
    def run(key, stay: pa.Table, come: pa.Table) -> pa.Table:
        table, part, row, points = both(stay, come)
        entry, _ = assign(part, points, books)
        return pa.table({
            "home": pa.array([key[0].as_py()] * len(part), pa.int32()),
            "slot": pa.array(layout.slot(part, entry, row)),
            "row": table.column("row"), "part": table.column("part"),
            "entry": pa.array(entry, pa.int32()), "point": table.column("point")})

    return gathered(members).applyInArrow(run, MEMBERS)


def measure(members: DataFrame, books: np.ndarray) -> DataFrame:
    """The last assignment: entries and distances, without the parts."""
    def run(key, stay: pa.Table, come: pa.Table) -> pa.Table:
        table, part, row, points = both(stay, come)
        entry, distance = assign(part, points, books)
        return pa.table({"row": table.column("row"), "part": table.column("part"),
                         "entry": pa.array(entry, pa.int32()), "distance": pa.array(distance)})

    return gathered(members).applyInArrow(run, ASSIGNED)


def stored(spark: SparkSession, members: DataFrame, layout: Layout) -> DataFrame:
    """Members in a table bucketed by home: later reads need no shuffle to find residents."""
    name = f"vector_members_{uuid.uuid4().hex}"
    (members.write.bucketBy(layout.buckets, "home")
     .option("path", scratch_path(spark, "codes-members")).saveAsTable(name))
    return spark.table(name)


def updated(members: DataFrame, books: np.ndarray) -> np.ndarray:
    """Entries as floor(sum / count) of their members; unused ones stay."""
    sums = members.groupBy("part", "entry").agg(
        F.count("*").alias("n"), F.array(*[
            F.sum(F.col("point")[k].cast("long")) for k in range(books.shape[2])]).alias("sums"))
    books = books.copy()
    for r in sums.collect():  # parts x entries rows at most
        books[r["part"], r["entry"]] = [s // r["n"] for s in r["sums"]]
    return books


def fit(rows: DataFrame, parts: int, entries: int, rounds: int) -> tuple[DataFrame, np.ndarray]:
    """(members after the last round, final codebooks[part, entry, place])."""
    spark = rows.sparkSession
    seeds = rows.orderBy(F.col("vec_id").asc_nulls_last(), "v", "row").limit(entries)
    first = np.array([r["v"] for r in seeds.select("v").collect()], np.int64)
    width = first.shape[1] // parts
    if width * parts != first.shape[1]:
        raise ValueError(f"vectors of {first.shape[1]} components have no {parts} equal parts")
    books = first.reshape(len(first), parts, width).transpose(1, 0, 2).copy()
    layout = Layout(rows.count(), parts, int(spark.conf.get("spark.sql.shuffle.partitions")))
    cut = rows.select("row", F.posexplode(F.array(*[
        F.slice("v", k * width + 1, width) for k in range(parts)])).alias("part", "point"))
    members = stored(spark, settle(cut, books, layout), layout)
    books = updated(members, books)
    for _ in range(rounds - 1):
        members = stored(spark, reassign(members, books, layout), layout)
        books = updated(members, books)
    return members, books


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def vector_codes(vectors: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4,
                 scale: int = 1024) -> DataFrame:
    """One row per usable vector: vec_id, label, code, error, label_error, codebooks_sha256.

    Rows whose vector is null, empty or holds null or non-finite components are dropped, so are
    vectors of another length than most. Components become floor(scale * x), held to 2^24.
    Codebooks start from the vectors of the smallest vec_ids (a null id is the largest; equal ids
    by their vectors); fewer vectors than entries make fewer entries. Repeated rows are coded and
    counted one by one. label_error adds up all rows of a label, null labels together. A vector's
    length must be a multiple of ``parts``, else a ValueError tells it. Long vectors are held one
    slot (2^16 parts) at a time. An empty table gives no rows; other columns are ignored.
    """
    rows = numbered(vectors, scale, F.col("vec_id").cast("long").alias("vec_id"),
                    F.col("label").cast("int").alias("label"))
    if rows.isEmpty():
        return rows.sparkSession.createDataFrame([], RESULT)
    members, books = fit(rows, parts, entries, rounds)
    final = measure(members, books).groupBy("row").agg(
        F.sort_array(F.collect_list(F.struct("part", "entry"))).alias("_code"),
        F.sum("distance").alias("error"))
    code = F.concat_ws("", F.transform(
        "_code", lambda c: F.lpad(F.lower(F.hex(c["entry"])), 2, "0")))
    coded = staged(rows.select("row", "vec_id", "label").join(final, "row").select(
        "vec_id", "label", code.alias("code"), "error"), "codes")
    labels = coded.groupBy(F.col("label").alias("_label")).agg(
        F.sum("error").alias("label_error"))
    return coded.join(labels, F.col("label").eqNullSafe(F.col("_label"))).drop("_label").withColumn(
        "codebooks_sha256", F.lit(digest(books)))
