"""Near-duplicates by HyperMinHash: compressed registers, banding, estimate, exact check.

A document is the set of its distinct word shingles (64-bit hashes). Each of 128 hash
functions keeps the set's smallest value as a 16-bit register: its leading-zero count and the
ten bits after the first one. (Registers are kept per function, not per prefix of one hash:
a short text would leave most prefixes empty and could not be banded.)

1. Documents with equal sets form one class; from here on a class counts once.
2. Four registers make a band. Classes that share a band form a bucket. At similarity 0.8 all
   32 bands miss with probability 5e-8.
3. Every class is paired with the smallest of its buckets' members, then with the smallest
   member of each bucket that it is not connected to, never all with all. Pairs are dropped
   when the collision-corrected estimate is far below the threshold, the rest are compared on
   their full sets.
4. A bucket whose members are not all connected yet is compared completely: what lies outside
   its largest component meets all other components, block by block inside tasks, registers
   first and then the sets of likely members, so that no row per pair arises.
5. Components contract by least neighbour until no edge is left.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronoview.llm.common import byte_slices, packed, unpacked
from chronoview.llm.words import lower_bytes, mix, word_hashes, word_spans
from chronoview.operators.sieve import sieve_of, sift
from chronoview.session import staged

REGISTERS, ROWS = 128, 4
BANDS = REGISTERS // ROWS
MANTISSA = 10
BLOCK = 64
BATCH_BYTES = 1 << 20
# An estimate this many deviations below the threshold ends a pair unchecked.
DEVIATIONS = 6.0

_seeds = mix(np.arange(1, 2 * REGISTERS + 9, dtype=np.uint64))
FLIPS, FACTORS = _seeds[:REGISTERS], _seeds[REGISTERS:2 * REGISTERS] | np.uint64(1)
WEIGHTS = _seeds[2 * REGISTERS:] | np.uint64(1)
SKETCHES = "doc_id long, n_shingles long, node long, bands array<long>"


def text_shingles(texts: pa.Array, width: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of every text; a shorter text is one shingle."""
    data, bounds = lower_bytes(texts)
    starts, ends, first = word_spans(data, bounds)
    words = word_hashes(data, starts, ends)
    weights = [WEIGHTS[k % len(WEIGHTS)] + np.uint64(2 * (k // len(WEIGHTS)))
               for k in range(width)]
    rolled = np.zeros(max(0, len(words) - width + 1), np.uint64)
    for k in range(width):
        rolled += words[k:k + len(rolled)] * weights[k]
    rolled = mix(rolled)
    for a, b in zip(first[:-1], first[1:]):
        if b - a >= width:
            yield np.unique(rolled[a:b - width + 1])
        elif b > a:
            total = np.uint64(b - a)
            for k in range(b - a):
                total = total + words[a + k] * weights[k]
            yield mix(np.array([total], np.uint64))
        else:
            yield np.zeros(0, np.uint64)


def registers(shingles: np.ndarray) -> np.ndarray:
    """128 registers of 16 bits: leading zeros of the least value, then its next ten bits."""
    least = np.full(REGISTERS, np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(shingles), 256):
        part = shingles[start:start + 256, None] ^ FLIPS
        part *= FACTORS
        np.minimum(least, part.min(axis=0), out=least)
    bits = np.maximum(least, np.uint64(1)).astype(np.float64).view(np.uint64)
    power = (bits >> np.uint64(52)).astype(np.int64) - 1023
    tail = (bits >> np.uint64(52 - MANTISSA)).astype(np.int64) & ((1 << MANTISSA) - 1)
    zeros = np.maximum(0, 63 - power)
    return ((zeros << MANTISSA) | tail).astype(np.uint16)


def set_hash(shingles: np.ndarray) -> int:
    """One 64-bit name for a set."""
    total = np.uint64(len(shingles)) + mix(shingles ^ WEIGHTS[7]).sum(dtype=np.uint64)
    return int(mix(np.array([total], np.uint64)).view(np.int64)[0])


def sketch(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n_shingles, node (the set's name) and bands; a text without words has neither."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for part in byte_slices(batches, "text", BATCH_BYTES):
                sizes, nodes, bands = [], [], []
                for shingles in text_shingles(part.column("text"), width):
                    sizes.append(len(shingles))
                    nodes.append(set_hash(shingles) if len(shingles) else None)
                    bands.append(registers(shingles).view(np.int64) if len(shingles) else None)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").cast(pa.int64()), pa.array(sizes, pa.int64()),
                     pa.array(nodes, pa.int64()), pa.array(bands, pa.list_(pa.int64()))],
                    names=["doc_id", "n_shingles", "node", "bands"])

    return docs.select("doc_id", "text").mapInArrow(run, SKETCHES)


def shingle_sets(docs: DataFrame, width: int) -> DataFrame:
    """node and set of every document with words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for part in byte_slices(batches, "text", BATCH_BYTES):
                found = [s for s in text_shingles(part.column("text"), width) if len(s)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([set_hash(s) for s in found], pa.int64()),
                     pa.array([s.view(np.int64) for s in found], pa.list_(pa.int64()))],
                    names=["node", "shingles"])

    return docs.select("text").mapInArrow(run, "node long, shingles array<long>")


def estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Jaccard estimate from equal registers, corrected for registers equal by chance.

    Minima of unrelated sets of n and m elements fall into one cell of relative width
    2^-MANTISSA (0.72 of it on average within a power of two) with that width times
    nm / (n + m)^2.
    """
    equal = (a == b).mean(axis=1)
    chance = 0.72 * 2.0 ** -MANTISSA * (na * nb) / (na + nb) ** 2
    return np.clip((equal - chance) / (1 - chance), 0, 1)


def likely_from(similarity: float) -> float:
    return similarity - DEVIATIONS * (similarity * (1 - similarity) / REGISTERS) ** 0.5


def estimated(pairs: DataFrame, classes: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of classes that sizes and registers allow to be similar."""
    floor = likely_from(similarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = (batch.column(c).flatten().to_numpy().view(np.uint16)
                           .reshape(-1, REGISTERS) for c in ("bands_a", "bands_b"))
            na, nb = (batch.column(c).to_numpy().astype(float) for c in ("n_a", "n_b"))
            likely = estimate(left, right, na, nb) >= floor
            yield batch.select(["a", "b"]).filter(pa.array(likely))

    def side(name):
        return classes.select(F.col("node").alias(name), F.col("n_shingles").alias(f"n_{name}"),
                              F.col("bands").alias(f"bands_{name}"))
    sized = pairs.join(side("a"), "a").join(side("b"), "b")
    near = F.least("n_a", "n_b") >= F.greatest("n_a", "n_b") * F.lit(similarity - 1e-9)
    return sized.where(near).select(
        "a", "b", "n_a", "n_b", "bands_a", "bands_b").mapInArrow(run, "a long, b long")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs whose full sets are similar enough."""
    def side(name):
        return sets.select(F.col("node").alias(name), F.col("shingles").alias(f"set_{name}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    shared = F.size(F.array_intersect("set_a", "set_b"))
    union = F.size("set_a") + F.size("set_b") - F.col("_shared")
    return (both.withColumn("_shared", shared)
            .where(F.col("_shared") * 100 >= union * percent).select("a", "b"))


def components(links: DataFrame) -> DataFrame:
    """node, label of every linked node: edges contract to least neighbours until none is left.

    Names of sets are random, so chains of ever smaller neighbours are short.
    """
    edges, labels = links, None
    while True:
        both = edges.select("a", "b").unionByName(
            edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = staged(both.groupBy("a").agg(F.min("b").alias("_least")).select(
            F.col("a").alias("node"), F.least("a", "_least").alias("label")), "near-least")

        def to(name):
            return least.select(F.col("node").alias(name), F.col("label").alias(f"_{name}"))
        moved = edges.join(to("a"), "a").join(to("b"), "b").where("_a != _b")
        edges = staged(moved.select(F.least("_a", "_b").alias("a"),
                                    F.greatest("_a", "_b").alias("b")).distinct(), "near-edges")
        if labels is None:
            labels = least
        else:
            step = least.select(F.col("node").alias("label"), F.col("label").alias("_next"))
            labels = staged(labels.join(step, "label", "left").select(
                "node", F.coalesce("_next", "label").alias("label")), "near-labels")
        if edges.isEmpty():
            return labels


def labelled(members: DataFrame, labels: DataFrame) -> DataFrame:
    return members.join(labels, "node", "left").withColumn(
        "label", F.coalesce("label", "node"))


def between(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sides are not connected yet."""
    def side(name):
        return labels.select(F.col("node").alias(name), F.col("label").alias(f"_{name}"))
    both = pairs.join(side("a"), "a", "left").join(side("b"), "b", "left")
    return both.where(F.coalesce("_a", "a") != F.coalesce("_b", "b")).select("a", "b")


def open_members(members: DataFrame, labels: DataFrame) -> DataFrame:
    """band, key, node, label, rest, block of every bucket that is not connected yet.

    ``rest`` marks what is outside the bucket's largest component; blocks of both parts hold
    about BLOCK members.
    """
    marked = labelled(members, labels)
    parts = marked.groupBy("band", "key", "label").agg(F.count("*").alias("_n"))
    buckets = parts.groupBy("band", "key").agg(
        F.max(F.struct("_n", "label")).alias("_top"), F.sum("_n").alias("_all"),
        F.count("*").alias("_parts")).where("_parts > 1").select("band", "key", "_top", "_all")
    held = marked.join(buckets, ["band", "key"])
    rest = F.col("label") != F.col("_top.label")
    size = F.when(rest, F.col("_all") - F.col("_top._n")).otherwise(F.col("_top._n"))
    block = F.pmod(F.xxhash64("node"), F.ceil(size / BLOCK))
    return held.select("band", "key", "node", "label", rest.alias("rest"), block.alias("block"))


def block_pairs(held: DataFrame, *fields: str) -> DataFrame:
    """Blocks outside the largest component beside every block they are compared with."""
    blocks = staged(held.groupBy("band", "key", "rest", "block").agg(
        F.collect_list(F.struct("node", "label", *fields)).alias("members")), "near-blocks")
    left = blocks.where("rest").select("band", "key", F.col("block").alias("_left"),
                                       F.col("members").alias("left"))
    right = blocks.select("band", "key", "rest", "block", F.col("members").alias("right"))
    return left.join(right, ["band", "key"]).where(
        ~F.col("rest") | (F.col("_left") <= F.col("block"))).select("band", "key", "left", "right")


class Side:
    """One block of a row: members with their registers and, if they came along, sets."""

    def __init__(self, column: pa.Array, row: int):
        a, b = column.offsets[row].as_py(), column.offsets[row + 1].as_py()
        fields = column.values.slice(a, b - a)
        self.nodes = fields.field("node").to_numpy()
        self.labels = fields.field("label").to_numpy()
        self.bands = np.ascontiguousarray(
            fields.field("bands").flatten().to_numpy().reshape(b - a, BANDS))
        self.marks = self.bands.view(np.uint16)
        self.sizes = fields.field("n_shingles").to_numpy().astype(float)
        names = [f.name for f in column.type.value_type]
        self.sets = [x.values.to_numpy() for x in fields.field("shingles")] \
            if "shingles" in names else None

    def likely(self, i: int, other: Side, band: int, percent: int, floor: float) -> np.ndarray:
        """Members of the other block that may be linked to the i-th here, likeliest first.

        A pair that shares several bands is left to the first of them.
        """
        near = np.minimum(other.sizes, self.sizes[i]) * 100 >= np.maximum(
            other.sizes, self.sizes[i]) * percent
        first = (other.bands == self.bands[i]).argmax(axis=1) == band
        found = np.flatnonzero(first & near & (other.labels != self.labels[i]))
        guess = estimate(other.marks[found], self.marks[i][None], other.sizes[found],
                         self.sizes[i])
        order = np.argsort(-guess)
        return found[order][:np.count_nonzero(guess >= floor)]


def likely_members(pairs: DataFrame, percent: int) -> DataFrame:
    """band, key, node of members with a likely partner: only their sets need to travel."""
    floor = likely_from(percent / 100)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row in range(batch.num_rows):
                band, key = (batch.column(c)[row].as_py() for c in ("band", "key"))
                left, right = Side(batch.column("left"), row), Side(batch.column("right"), row)
                wanted = set()
                for i in range(len(left.nodes)):
                    found = left.likely(i, right, band, percent, floor)
                    if len(found):
                        wanted.add(int(left.nodes[i]))
                        wanted.update(right.nodes[found].tolist())
                rows += [(band, key, node) for node in wanted]
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[k] for x in rows], t) for k, t in
                 enumerate((pa.int32(), pa.int64(), pa.int64()))], names=["band", "key", "node"])

    return pairs.mapInArrow(run, "band int, key long, node long").distinct()


def compared(pairs: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between components of one bucket, by the full sets.

    One link tells enough about a class and a component.
    """
    floor = likely_from(percent / 100)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            links = []
            for row in range(batch.num_rows):
                band = batch.column("band")[row].as_py()
                left, right = Side(batch.column("left"), row), Side(batch.column("right"), row)
                for i, node in enumerate(left.nodes):
                    met = set()
                    for j in left.likely(i, right, band, percent, floor):
                        if right.labels[j] in met:
                            continue
                        shared = len(np.intersect1d(left.sets[i], right.sets[j],
                                                    assume_unique=True))
                        if 100 * shared >= percent * (left.sizes[i] + right.sizes[j] - shared):
                            met.add(right.labels[j])
                            links.append((min(node, right.nodes[j]), max(node, right.nodes[j])))
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return pairs.mapInArrow(run, "a long, b long").distinct()


def near_classes(docs: DataFrame, width: int = 4, percent: int = 80) -> tuple[DataFrame, DataFrame]:
    """(sketches, groups): doc_id, n_shingles, node; and node, label, component_id."""
    similarity = percent / 100
    sketches = staged(sketch(docs, width), "near-sketches")
    classes = staged(sketches.where("node IS NOT NULL").groupBy("node").agg(
        F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"),
        F.first("bands").alias("bands")), "near-classes")
    banded = classes.select("node", F.posexplode("bands").alias("band", "key"))
    buckets = staged(banded.groupBy("band", "key").agg(
        F.min("node").alias("pivot"), F.max("node").alias("_last")).where(
        "pivot != _last").drop("_last"), "near-buckets")
    place = F.xxhash64("band", "key")
    sieve = sieve_of(buckets.select(place.alias("_place")), "_place")
    members = staged(sift(banded, place, sieve).where("_maybe").select("band", "key", "node")
                     .join(buckets, ["band", "key"]), "near-members")

    wanted = members.select("node").distinct()
    shared = staged(sift(classes, F.col("node"), sieve_of(wanted, "node")).where("_maybe").drop(
        "_maybe").join(wanted, "node", "left_semi"), "near-shared")
    reps = shared.select(F.coalesce("rep", F.lit(0)).alias("rep"))
    texts = sift(docs.select("text", F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias(
        "_id")), F.col("_id"), sieve_of(reps, "rep")).where("_maybe").select("text")
    sets = staged(shingle_sets(texts, width).join(shared, "node", "left_semi").dropDuplicates(
        ["node"]), "near-sets")

    def linked(pairs):
        return verified(estimated(pairs, shared, similarity), sets, percent)

    # One partner each first: it connects most of a large group. Other pivots follow where
    # they would connect components.
    stars = members.where("pivot != node")
    nearest = stars.groupBy("node").agg(F.min("pivot").alias("a")).withColumnRenamed("node", "b")
    links = staged(linked(nearest), "near-links")
    labels = components(links)
    pivots = stars.select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct()
    links = links.unionByName(staged(linked(between(pivots, labels)), "near-links"))
    labels = components(links)
    held = staged(open_members(members.drop("pivot"), labels), "near-open")
    known = held.join(shared.select("node", "n_shingles", "bands"), "node")
    wanted = likely_members(block_pairs(known, "n_shingles", "bands"), percent)
    full = known.join(wanted, ["band", "key", "node"], "left_semi").join(
        sets.select("node", "shingles"), "node")
    found = staged(compared(block_pairs(full, "n_shingles", "bands", "shingles"), percent),
                   "near-links")
    if not found.isEmpty():
        labels = components(links.unionByName(found))
    placed = labelled(classes.select("node", "rep"), labels)
    names = placed.groupBy("label").agg(F.min("rep").alias("component_id"))
    groups = placed.join(names, "label").select("node", "label", "component_id")
    return sketches.select("doc_id", "n_shingles", "node"), groups


def near_duplicates(docs: DataFrame, width: int = 4, percent: int = 80) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    component_id is the smallest doc_id reachable over links of at least ``percent``
    similarity; a text without words (null, empty) is its own component. Repeated rows share a
    component and a verdict; a null id never names a component that has another id. An empty
    table gives no rows; other columns are ignored.
    """
    sketches, groups = near_classes(docs, width, percent)
    filled = sketches.where("node IS NOT NULL").join(groups, "node").select(
        "doc_id", "n_shingles", "component_id")
    empty = sketches.where("node IS NULL").select(
        "doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return filled.unionByName(empty).withColumn(
        "kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def with_node(rows: DataFrame, width: int) -> DataFrame:
    """Add ``_node``, the name of the set of ``_text``, and drop the text."""
    kept = [f for f in rows.schema.fields if f.name != "_text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for part in byte_slices(batches, "_text", BATCH_BYTES):
                nodes = [set_hash(s) if len(s) else None
                         for s in text_shingles(part.column("_text"), width)]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(f.name) for f in kept), pa.array(nodes, pa.int64())],
                    names=[*(f.name for f in kept), "_node"])

    return rows.mapInArrow(run, T.StructType([*kept, T.StructField("_node", T.LongType())]))


def drop_near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The documents that stay, whole rows: of each component one row, with its smallest id.

    A verdict belongs to a doc_id and a set together, so an id that stands on several texts
    loses only those that its components drop; of several rows with the smallest id in one
    component, that of the set first in order stays, and of rows equal in both any one. Only
    rows whose id the sieve of concerned ids lets through are named again and joined; the
    others never move. Rows with a null id and texts without words stay. Long texts are
    worked off in stretches; a set is held whole.
    """
    sketches, groups = near_classes(docs, width, percent)
    pairs = sketches.where("node IS NOT NULL AND doc_id IS NOT NULL").groupBy(
        "node", "doc_id").agg(F.count("*").alias("_rows"))
    placed = staged(pairs.join(groups.select("node", "label"), "node"), "near-verdicts")
    best = placed.groupBy("label").agg(F.min(F.struct("doc_id", "node")).alias("_best")).select(
        "_best.*")
    gone = staged(placed.join(best, ["doc_id", "node"], "left_anti").select(
        F.col("doc_id").alias("_id"), F.col("node").alias("_node")), "near-gone")
    repeated = placed.where("_rows > 1").select(F.col("doc_id").alias("_id"))
    ids = gone.select("_id").unionByName(repeated)
    sifted = sift(packed(docs, F.col("doc_id").cast("long").alias("_id"),
                         F.col("text").alias("_text")),
                  F.coalesce(F.col("_id"), F.lit(0)), sieve_of(ids, "_id"))
    concerned = F.col("_maybe") & F.col("_id").isNotNull()
    named = with_node(sifted.where(concerned).select("_row", "_id", "_text"), width)
    stay = named.join(gone, ["_id", "_node"], "left_anti")
    worded = stay.where("_node IS NOT NULL").groupBy("_id", "_node").agg(
        F.first("_row").alias("_row"))
    rest = sifted.where(~concerned).select("_row").unionByName(
        stay.where("_node IS NULL").select("_row"))
    return unpacked(rest.unionByName(worded.select("_row")))
