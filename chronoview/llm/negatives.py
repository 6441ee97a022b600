"""Hard negatives by segment summaries.

Every vector is cut into segments, and each segment's mean and deviation are stored (both times
the root of its length). The inner product of two vectors lies within the sum of the products
of means, plus or minus the sum of the products of deviations. Coarse segments are tried first;
pairs that no bound rules out are refined with finer ones, and only what is left is multiplied
out, exactly.

Anchors and rows meet in cells: a block of anchors and a group of rows, both bounded, so every
anchor meets every row once and no task holds more than one cell. A cell returns a few rows an
anchor. First the anchors' best rows of their own label are found, then, between the bounds that
these positives set, the best rows of other labels.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from chronoview.llm.vectors import comparable, matrix, numbered
from chronoview.session import staged

LEVELS = (2, 8, 32)
ANCHORS, ROWS = 1 << 15, 1 << 16
# A cell with fewer rows returns about as much as it reads.
LEAST_ROWS = 1 << 10
CHUNK, STEP, FIRST_STEP = 256, 2048, 64
# With fewer pairs left than this share, pairs are worked off one by one.
SPARSE = 1 / 16
LOW, HIGH = np.iinfo(np.int64).min, np.iinfo(np.int64).max
SUMMED = ("row long, vec_id long, label long, v array<int>, means array<double>, "
          "deviations array<double>")
FOUND = "anchor long, slot int, score long, other_id long, other long"


def levels_of(width: int) -> list[list[int]]:
    """Segment bounds of every level, coarse to fine; each level refines the one before."""
    return [np.unique(np.linspace(0, width, min(width, n) + 1).astype(int)).tolist()
            for n in LEVELS if n == LEVELS[0] or n <= width]


def summaries(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Means and deviations of all segments of all levels, times the root of their lengths."""
    v = v.astype(np.float64)
    means, deviations = [], []
    for bounds in levels_of(v.shape[1]):
        for a, b in zip(bounds[:-1], bounds[1:]):
            part = v[:, a:b]
            mean = part.mean(axis=1)
            means.append(mean * (b - a) ** 0.5)
            deviations.append(((part - mean[:, None]) ** 2).sum(axis=1) ** 0.5)
    return np.stack(means, axis=1), np.stack(deviations, axis=1)


def listed(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.FixedSizeListArray.from_arrays(pa.array(values.ravel(), kind), values.shape[1]).cast(
        pa.list_(kind))


def summarised(rows: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                means, deviations = summaries(matrix(batch.column("v"), batch.num_rows))
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c) for c in ("row", "vec_id", "label", "v")),
                     listed(means, pa.float64()), listed(deviations, pa.float64())],
                    names=["row", "vec_id", "label", "v", "means", "deviations"])

    return rows.select("row", "vec_id", "label", "v").mapInArrow(run, SUMMED)


class Vectors:
    """Columns of a table of summarised rows, cut into chunks with ``part``."""

    def __init__(self, row, ids, labels, v, means, deviations):
        self.row, self.ids, self.labels = row, ids, labels
        self.v, self.means, self.deviations = v, means, deviations

    @classmethod
    def of(cls, table: pa.Table) -> Vectors:
        n = table.num_rows
        return cls(*(table.column(c).to_numpy() for c in ("row", "vec_id", "label")),
                   *(matrix(table.column(c), n) for c in ("v", "means", "deviations")))

    def part(self, a: int, b: int) -> Vectors:
        return Vectors(*(x[a:b] for x in vars(self).values()))


class Shortlist:
    """The best rows of every (anchor, slot) so far: by score, then id, then row."""

    def __init__(self, lists: int, size: int):
        self.size = size
        self.at, self.score, self.ids, self.row = (np.zeros(0, np.int64) for _ in range(4))
        self.need = np.full(lists, LOW)

    def add(self, at, score, ids, row):
        at, score, ids, row = (np.concatenate(x) for x in (
            (self.at, at), (self.score, score), (self.ids, ids), (self.row, row)))
        order = np.lexsort((row, ids, -score, at))
        at = at[order]
        place = np.arange(len(at)) - np.searchsorted(at, at)
        order, at, place = (x[place < self.size] for x in (order, at, place))
        self.at, self.score, self.ids, self.row = at, score[order], ids[order], row[order]
        full = place == self.size - 1
        self.need[at[full]] = self.score[full]


def products(a: np.ndarray, b: np.ndarray, pairs) -> np.ndarray:
    if pairs is None:
        return a @ b.T
    i, j = pairs
    return np.einsum("ij,ij->i", a[i], b[j])


def scored(anchors: Vectors, rows: Vectors, mask: np.ndarray, keep) -> tuple:
    """(i, j, exact score) of the masked pairs that no level of summaries rules out."""
    at = 0
    pairs = None
    for bounds in levels_of(rows.v.shape[1]):
        n = len(bounds) - 1
        if pairs is None and np.count_nonzero(mask) < SPARSE * mask.size:
            pairs = np.nonzero(mask)
        cut = slice(at, at + n)
        middle = products(anchors.means[:, cut], rows.means[:, cut], pairs)
        spread = products(anchors.deviations[:, cut], rows.deviations[:, cut], pairs)
        spread += 1 + 1e-9 * (np.abs(middle) + spread)  # more than rounding can take away
        i = np.arange(len(mask))[:, None] if pairs is None else pairs[0]
        likely = keep(i, middle - spread, middle + spread)
        if pairs is None:
            mask = mask & likely
        else:
            pairs = pairs[0][likely], pairs[1][likely]
        at += n
    left, right = comparable(anchors.v, rows.v)
    if pairs is None and np.count_nonzero(mask) < SPARSE * mask.size:
        pairs = np.nonzero(mask)
    score = products(left, right, pairs)
    if pairs is None:
        pairs = np.nonzero(mask)
        score = score[pairs]
    return *pairs, score.astype(np.int64)


def steps(total: int):
    """Short steps first: they set the scores that later ones must reach."""
    at, step = 0, FIRST_STEP
    while at < total:
        yield at, min(total, at + step)
        at, step = at + step, min(STEP, 2 * step)


def search(anchors: Vectors, rows: Vectors, same: bool, low: np.ndarray, high: np.ndarray,
           size: int) -> tuple[np.ndarray, ...]:
    """Best ``size`` rows of the same (or of other) labels with low <= score <= high.

    low and high are given per anchor and slot; the result has flat lists anchor x slot.
    """
    found = []
    slots = low.shape[1]
    for a in range(0, len(anchors.row), CHUNK):
        chunk = anchors.part(a, a + CHUNK)
        floor, roof = low[a:a + CHUNK], high[a:a + CHUNK]
        best = Shortlist(floor.size, size)
        for b, c in steps(len(rows.row)):
            part = rows.part(b, c)
            mask = (chunk.labels[:, None] == part.labels) == same
            if same:
                mask &= chunk.row[:, None] != part.row
            need = np.maximum(floor, best.need.reshape(-1, slots))

            def keep(i, least, most):
                return np.logical_or.reduce([(most >= need[i, s]) & (least <= roof[i, s])
                                             for s in range(slots)])
            i, j, score = scored(chunk, part, mask, keep)
            for s in range(slots):
                hit = (score >= need[i, s]) & (score <= roof[i, s])
                if hit.any():
                    best.add(i[hit] * slots + s, score[hit], part.ids[j[hit]], part.row[j[hit]])
        found.append((chunk.row[best.at // slots], best.at % slots, best.score, best.ids,
                      best.row))
    return tuple(np.concatenate(x) for x in zip(*found))


def in_cells(anchors: DataFrame, rows: DataFrame, many: int, total: int, run) -> DataFrame:
    """Every block of anchors beside every group of rows, each pair in one cell."""
    blocks = max(1, -(-many // ANCHORS))
    tasks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")),
                -(-total * blocks // ROWS))
    groups = max(1, min(-(-tasks // blocks), total // LEAST_ROWS))

    def dealt(df, own, others):
        place = F.pmod(F.xxhash64("row"), F.lit(own)).cast("int")
        return df.withColumn("_own", place).withColumn(
            "_other", F.explode(F.sequence(F.lit(0), F.lit(others - 1))))
    left = dealt(anchors, blocks, groups).select(
        (F.col("_own") * groups + F.col("_other")).alias("cell"),
        *(F.col(c).alias(c) for c in anchors.columns))
    right = dealt(rows, groups, blocks).select(
        (F.col("_other") * groups + F.col("_own")).alias("cell"), *rows.columns)
    return left.groupBy("cell").cogroup(right.groupBy("cell")).applyInArrow(run, FOUND)


def table_of(found: tuple[np.ndarray, ...] | None) -> pa.Table:
    columns = found or tuple(np.zeros(0, np.int64) for _ in range(5))
    kinds = pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)],
                    names=["anchor", "slot", "score", "other_id", "other"])


def ranked(found: DataFrame, name: str, size: int) -> DataFrame:
    order = W.partitionBy("anchor", "slot").orderBy(F.desc("score"), "other_id", "other")
    return found.withColumn(name, F.row_number().over(order)).where(F.col(name) <= size)


def hard_negatives(vectors: DataFrame, every: int = 50, positives: int = 5, negatives: int = 3,
                   low: int = 50, high: int = 95, scale: int = 256) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are rows whose vec_id is divisible by ``every``; their positives the best other rows
    of their label, their negatives, per positive, the best rows of other labels that score
    between ``low`` and ``high`` percent of the positive's score. Rows with a null vec_id or
    label, a null or empty vector, null or non-finite components, or of another length than most
    take no part. Components become floor(scale * x), held to 2^24. Equal scores go by vec_id;
    repeated rows are other rows, of equal id and score by their place in the stored table, which
    changes no value returned. Anchors without positives or negatives give no rows, nor does an
    empty table; other columns are ignored. Tasks hold bounded numbers of vectors, whatever their
    length.
    """
    usable = vectors.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull())
    rows = staged(summarised(numbered(usable, scale, F.col("vec_id").cast("long").alias("vec_id"),
                                      F.col("label").cast("long").alias("label"))), "summaries")
    anchors = rows.where(F.pmod("vec_id", F.lit(every)) == 0)
    total, many = rows.count(), anchors.count()

    def near(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return table_of(None)
        n = left.num_rows
        return table_of(search(Vectors.of(left), Vectors.of(right), True, np.full((n, 1), LOW),
                               np.full((n, 1), HIGH), positives))

    best = staged(ranked(in_cells(anchors, rows, many, total, near), "place", positives).select(
        "anchor", (F.col("place") - 1).alias("slot"), F.col("score").alias("positive_score"),
        F.col("other_id").alias("positive_id")), "positives")
    scores = best.groupBy("anchor").agg(F.transform(F.sort_array(F.collect_list(F.struct(
        "slot", "positive_score"))), lambda x: x["positive_score"]).alias("scores"))
    asked = anchors.join(scores.withColumnRenamed("anchor", "row"), "row")

    def hard(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return table_of(None)
        floor, roof = (np.full((left.num_rows, positives), x) for x in (HIGH, LOW))
        for i, own in enumerate(left.column("scores").to_pylist()):
            own = np.array(own, np.int64)
            floor[i, :len(own)] = -((-low * own) // 100)
            roof[i, :len(own)] = high * own // 100
        return table_of(search(Vectors.of(left), Vectors.of(right), False, floor, roof,
                               negatives))

    found = ranked(in_cells(asked, rows, many, total, hard), "rank", negatives)
    names = anchors.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id"))
    return found.join(best, ["anchor", "slot"]).join(names, "anchor").select(
        "anchor_id", "positive_id", "rank", F.col("other_id").alias("negative_id"),
        "positive_score", F.col("score").alias("negative_score"))


def relabelled(vectors: DataFrame, every: int = 7, labels: int = 10) -> DataFrame:
    """Labels of rows whose vec_id is divisible by ``every`` move on by one."""
    moved = F.when(F.pmod("vec_id", F.lit(every)) == 0, (F.col("label") + 1) % labels)
    return vectors.withColumn("label", F.coalesce(moved, F.col("label")))
