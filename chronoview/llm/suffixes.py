"""Repeated passages by a distributed difference-cover algorithm.

A passage is a run of ``LENGTH`` bytes; only that far do suffixes have to be compared. Places of
a document are sampled where (place mod 21) lies in a difference cover: for any two places there
is a shift below 21 that takes both to sampled ones.

1. Sampled triples (three words of ten bytes) are named by fingerprints and sorted: every block
   of documents sends sorted, Golomb-coded lists to the owners of ranges of names, which merge
   them and return a bitmap. A suffix whose triple no other document has is done with.
2. The names are the letters of the next level: the triple of names at s, s + 21 and s + 42
   stands for 72 bytes. Its owner compares equal neighbours and tells each block whether a
   document with a smaller id has the same. That settles all passages inside longer repeats.
3. What is left of the other suffixes, near the ends of repeats, is merged in by its own first
   50 bytes: again sorted by name, and again only what occurs twice is compared with its
   neighbours.

Only names travel, the texts never do: they are stored once, in blocks of bounded size in a table
bucketed by block, and every pass reads the blocks where they lie, beside the answers for them.
A block sends every name once, so a passage in a third of all documents is a list entry of each
block and no more.

Names that decide have so many bits that any two different strings of the whole corpus share one
with a probability below 2^-20; those of presence lists are cut short, which lets a few suffixes
more through.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from math import ceil, log2

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoview.llm import golomb
from chronoview.llm.words import mix
from chronoview.session import scratch_path, staged

# A difference cover modulo 21.
PERIOD, COVER = 21, (0, 1, 6, 8, 18)
LENGTH = 50
# A triple must fit into any passage whatever its first sampled place.
TRIPLE = LENGTH - PERIOD + 1
DEEP = TRIPLE + 2 * PERIOD
BLOCK_BYTES = 8 << 20
STRETCH = 1 << 20
OWNER_NAMES = 1 << 21
MAX_BUCKETS = 50_000

_random = mix(np.arange(1, 2 * 257 + 9, dtype=np.uint64))
LETTERS = _random[:256], _random[257:513]
BASES = _random[514] | np.uint64(1), _random[515] | np.uint64(1)
WEIGHTS = _random[516:] | np.uint64(1)
STATE = -1
TEXTS = "block long, row long, doc_id long, body binary"
LISTS = "block long, owner int, own long, count int, code binary, more binary, docs binary"
ANSWERS = "block long, owner int, code binary"
RESULT = "row long, doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


class Plan:
    """Widths of names and numbers of owners for a corpus of ``size`` bytes."""

    def __init__(self, size: int):
        size = max(size, 2)
        # Presence: one in 128 single names looks repeated. Decisions: 2 log2(n) + 20 bits.
        self.short = min(64, ceil(log2(size)) + 7)
        self.more = max(0, ceil((2 * log2(size) + 20 - 64) / 8))
        self.mask = np.uint64((1 << 8 * self.more) - 1)
        self.owner_bits = max(4, ceil(log2(size * len(COVER) / PERIOD / OWNER_NAMES)))


def powers(base: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    size = STRETCH + DEEP
    both = []
    for step in (base, np.uint64(pow(int(base), -1, 1 << 64))):
        steps = np.full(size, step, np.uint64)
        steps[0] = 1
        both.append(np.multiply.accumulate(steps))
    return both[0], both[1]


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def prints(data: np.ndarray, at: np.ndarray, length: int, which: int = 0) -> np.ndarray:
    """Fingerprints of data[a:a + length] for sorted places ``at``, stretch by stretch."""
    if which not in _powers:
        _powers[which] = powers(BASES[which])
    up, down = _powers[which]
    found = np.empty(len(at), np.uint64)
    first = 0
    while first < len(at):
        origin = at[first]
        last = int(np.searchsorted(at, origin + STRETCH))
        piece = data[origin:min(len(data), origin + STRETCH + length)]
        sums = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum(LETTERS[which][piece] * up[:len(piece)], out=sums[1:])
        a = at[first:last] - origin
        found[first:last] = (sums[a + length] - sums[a]) * down[a]
        first = last
    return mix(found)


class Block:
    """Documents side by side; places count through all their bytes."""

    def __init__(self, texts: pa.Table):
        texts = texts.sort_by("row")
        self.row = texts.column("row").to_numpy()
        ids = texts.column("doc_id").combine_chunks()
        self.known = ids.is_valid().to_numpy(zero_copy_only=False)
        self.ids = ids.fill_null(0).to_numpy()
        bodies = [np.frombuffer(b.as_buffer(), np.uint8) for b in texts.column("body")]
        self.bounds = np.cumsum([0, *map(len, bodies)])
        self.data = np.concatenate([np.zeros(0, np.uint8), *bodies])

    def doc(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.bounds, at, "right") - 1

    def fitting(self, length: int) -> np.ndarray:
        """Places of known documents where ``length`` bytes follow, as marks."""
        marks = np.zeros(len(self.data) + 1, np.int8)
        sizes = np.diff(self.bounds)
        whole = self.known & (sizes >= max(length, LENGTH))
        marks[self.bounds[:-1][whole]] = 1
        np.add.at(marks, self.bounds[1:][whole] - length + 1, -1)
        return np.cumsum(marks[:-1], dtype=np.int8).astype(bool)

    def sampled(self) -> np.ndarray:
        """Sorted sampled places where a triple fits."""
        cover = np.zeros(PERIOD, bool)
        cover[list(COVER)] = True
        kind = np.int32 if len(self.data) < 1 << 31 else np.int64
        place = np.arange(len(self.data), dtype=kind)
        place -= np.repeat(self.bounds[:-1].astype(kind), np.diff(self.bounds))
        place %= PERIOD
        return np.flatnonzero(cover[place] & self.fitting(TRIPLE))


def cover_marks(size: int, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """True at every place in one of the stretches [first, end)."""
    depth = np.zeros(size + 1, np.int32)
    np.add.at(depth, first, 1)
    np.add.at(depth, end, -1)
    return np.cumsum(depth[:-1], dtype=np.int32) > 0


class Names:
    """Distinct names of a block's suffixes with the smallest and largest document of each."""

    def __init__(self, value: np.ndarray, docs: np.ndarray, more: np.ndarray | None = None):
        order = np.argsort(value)
        ranked = value[order]
        fresh = np.ones(len(order), bool)
        fresh[1:] = ranked[1:] != ranked[:-1]
        if more is not None:
            apart = more[order][1:] != more[order][:-1]
            if (apart & ~fresh[1:]).any():  # one value with several second halves, out of order
                order = np.lexsort((more, value))
                apart = more[order][1:] != more[order][:-1]
            fresh[1:] |= apart
        self.group = np.empty(len(order), np.int64)
        self.group[order] = np.cumsum(fresh) - 1
        firsts = np.flatnonzero(fresh)
        self.value = ranked[firsts]
        self.more = None if more is None else more[order][firsts]
        held = docs[order]
        self.least = np.minimum.reduceat(held, firsts) if len(firsts) else held
        self.most = np.maximum.reduceat(held, firsts) if len(firsts) else held

    def shared_here(self) -> np.ndarray:
        return self.least != self.most


def owner_bounds(values: np.ndarray, bits: int, owner_bits: int) -> np.ndarray:
    """Where each owner's names begin (owners + 1 bounds) among sorted names of ``bits``."""
    width = bits - owner_bits
    edges = np.arange(1, 1 << owner_bits, dtype=np.uint64) << np.uint64(width)
    return np.concatenate([[0], np.searchsorted(values, edges), [len(values)]])


def lists(block: int, names: Names, bits: int, plan: Plan, decide: bool) -> list[dict]:
    """One row per owner that gets names from this block."""
    bounds = owner_bounds(names.value, bits, plan.owner_bits)
    span = 1 << (bits - plan.owner_bits)
    rows = []
    for owner in np.flatnonzero(np.diff(bounds)):
        a, b = bounds[owner], bounds[owner + 1]
        row = {"block": block, "owner": int(owner), "own": 0, "count": int(b - a),
               "code": golomb.encode(names.value[a:b] & np.uint64(span - 1), span),
               "more": None, "docs": None}
        if decide:
            least = names.least[a:b]
            base = int(least.min())
            width = max(1, -(-(int(least.max()) - base).bit_length() // 8))
            row["docs"] = base.to_bytes(8, "little", signed=True) + (
                least.astype(np.uint64) - np.uint64(base & (1 << 64) - 1)).view(
                np.uint8).reshape(-1, 8)[:, :width].tobytes()
            row["more"] = names.more[a:b].view(np.uint8).reshape(-1, 8)[:, :plan.more].tobytes()
        rows.append(row)
    return rows


def widened(data: bytes, count: int) -> np.ndarray:
    """Whole numbers of equal width, least byte first."""
    wide = np.zeros((count, 8), np.uint8)
    if data:
        part = np.frombuffer(data, np.uint8).reshape(count, -1)
        wide[:, :part.shape[1]] = part
    return wide.view(np.uint64).ravel()


def answered(sent: DataFrame, bits: int, plan: Plan, decide: bool, name: str) -> DataFrame:
    """Bitmaps of the lists' names: known to another block, or to a smaller document there.

    State rows only pass through, each in a group of its own.
    """
    def judge(table: pa.Table) -> pa.Table:
        if table.column("owner")[0].as_py() == STATE:
            return table.select(["block", "owner", "code"])
        counts = table.column("count").to_pylist()
        value = np.concatenate([golomb.decode(c.as_py(), n)
                                for c, n in zip(table.column("code"), counts)])
        if decide:
            more = np.concatenate([widened(m.as_py(), n)
                                   for m, n in zip(table.column("more"), counts)])
            docs = np.concatenate([
                (widened(d.as_py()[8:], n) + np.frombuffer(d.as_py()[:8], np.uint64)).view(np.int64)
                for d, n in zip(table.column("docs"), counts)])
            names = Names(value, docs, more)
            hit = names.least[names.group] < docs
        else:
            names = Names(value, np.repeat(np.arange(len(counts)), counts))
            hit = names.shared_here()[names.group]
        ends = np.cumsum(counts)
        maps = [np.packbits(hit[e - n:e]).tobytes() for e, n in zip(ends, counts)]
        return pa.table({"block": table.column("block"), "owner": table.column("owner"),
                         "code": pa.array(maps, pa.binary())})

    return staged(sent.groupBy("owner", "own").applyInArrow(judge, ANSWERS), name)


def read_bits(names: Names, answers: dict[int, bytes], bits: int, plan: Plan) -> np.ndarray:
    bounds = owner_bounds(names.value, bits, plan.owner_bits)
    found = np.zeros(len(names.value), bool)
    for owner in np.flatnonzero(np.diff(bounds)):
        a, b = bounds[owner], bounds[owner + 1]
        found[a:b] = np.unpackbits(np.frombuffer(answers[owner], np.uint8), count=b - a)
    return found


def packed_state(*marks: np.ndarray) -> bytes:
    return b"".join(np.packbits(m).tobytes() for m in marks)


def unpacked_state(code: bytes, size: int, number: int) -> list[np.ndarray]:
    each = -(-size // 8)
    data = np.frombuffer(code, np.uint8).reshape(number, each) if size else \
        np.zeros((number, 0), np.uint8)
    return [np.unpackbits(d, count=size).astype(bool) for d in data]


def in_blocks(docs: DataFrame, buckets: int) -> DataFrame:
    """Every text as bytes, dealt into blocks, in a table bucketed by block."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            numbers = []
            for body in batch.column("body"):
                size = len(body.as_buffer())
                if held and held + size > BLOCK_BYTES:
                    block, held = block + 1, 0
                held += size
                numbers.append(block)
            yield pa.RecordBatch.from_arrays(
                [pa.array(numbers, pa.int64()), *batch.columns],
                names=["block", *batch.schema.names])

    texts = docs.select(F.monotonically_increasing_id().alias("row"),
                        F.col("doc_id").cast("long").alias("doc_id"),
                        F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("body"))
    spark = docs.sparkSession
    name = f"passage_blocks_{uuid.uuid4().hex}"
    (texts.mapInArrow(run, TEXTS).write.bucketBy(buckets, "block")
     .option("path", scratch_path(spark, "passage-blocks")).option("compression", "zstd")
     .saveAsTable(name))
    return spark.table(name)


def passes(texts: DataFrame, answers: DataFrame | None, run, schema: str) -> DataFrame:
    """``run(block number, Block, answers by owner)`` for every block, read where it lies."""
    def one(number: int, table: pa.Table, given: pa.Table | None) -> pa.Table:
        block = Block(table)
        by_owner = {} if given is None else {
            o: c.as_py() for o, c in zip(given.column("owner").to_pylist(), given.column("code"))}
        with np.errstate(over="ignore"):
            return run(number, block, by_owner)

    if answers is None:
        return texts.groupBy("block").applyInArrow(
            lambda key, table: one(key[0].as_py(), table, None), schema)
    return texts.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
        lambda key, table, given: one(key[0].as_py(), table, given), schema)


def rows_of(rows: list[dict], block: int, state: bytes | None = None) -> pa.Table:
    if state is not None:
        rows = [*rows, {"block": block, "owner": STATE, "own": block, "count": 0, "code": state,
                        "more": None, "docs": None}]
    kinds = {"block": pa.int64(), "owner": pa.int32(), "own": pa.int64(), "count": pa.int32(),
             "code": pa.binary(), "more": pa.binary(), "docs": pa.binary()}
    return pa.table({c: pa.array([r[c] for r in rows], k) for c, k in kinds.items()})


def shortened(value: np.ndarray, plan: Plan) -> np.ndarray:
    return value >> np.uint64(64 - plan.short)


def deep_names(block: Block, repeated: np.ndarray, at: np.ndarray,
               plan: Plan) -> tuple[Names, np.ndarray]:
    """Names of 72 bytes of the sampled places whose three triples are all repeated."""
    fits = block.fitting(DEEP)
    parts = [np.searchsorted(at, at + k * PERIOD) for k in (1, 2)]
    good = repeated & fits[at]
    for p in parts:
        inside = np.minimum(p, max(0, len(at) - 1))
        good &= repeated[inside]
    starts = np.flatnonzero(good)
    values = []
    for which in (0, 1):
        triple = prints(block.data, at, TRIPLE, which) if len(starts) else np.zeros(0, np.uint64)
        total = triple[starts] * WEIGHTS[0]
        for p, weight in zip(parts, WEIGHTS[1:3]):
            total += triple[p[starts]] * weight
        values.append(mix(total))
    places = at[starts]
    return Names(values[0], block.ids[block.doc(places)], values[1] & plan.mask), places


def window_names(block: Block, open_places: np.ndarray, plan: Plan) -> Names:
    first, second = (prints(block.data, open_places, LENGTH, w) for w in (0, 1))
    return Names(first, block.ids[block.doc(open_places)], second & plan.mask)


def repeated_passages(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    Bytes covered by a passage of 50 bytes that also starts in a document with a smaller doc_id
    are removed; passages are judged on the input, overlaps count, and matches never cross
    documents. Null texts count as empty. Rows with equal doc_ids do not remove from each other;
    a null doc_id is neither smaller nor larger than another, so such rows stay whole. Texts
    below 50 bytes stay whole. A text is held whole by one task, and worked off in stretches; a
    block ends where 8 MB are reached. An empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    plan = Plan(size)
    buckets = min(MAX_BUCKETS, max(int(spark.conf.get("spark.sql.shuffle.partitions")),
                                   size // BLOCK_BYTES + 1))
    texts = in_blocks(docs, buckets)

    def triples(number: int, block: Block, _) -> pa.Table:
        at = block.sampled()
        value = shortened(prints(block.data, at, TRIPLE), plan)
        names = Names(value, block.ids[block.doc(at)])
        return rows_of(lists(number, names, plan.short, plan, False), number)

    def recursion(number: int, block: Block, given: dict) -> pa.Table:
        at = block.sampled()
        value = shortened(prints(block.data, at, TRIPLE), plan)
        names = Names(value, block.ids[block.doc(at)])
        known = read_bits(names, given, plan.short, plan) | names.shared_here()
        repeated = known[names.group]
        deep, _ = deep_names(block, repeated, at, plan)
        return rows_of(lists(number, deep, 64, plan, True), number, packed_state(repeated))

    def remaining(number: int, block: Block, given: dict) -> pa.Table:
        at = block.sampled()
        repeated, = unpacked_state(given[STATE], len(at), 1)
        deep, places = deep_names(block, repeated, at, plan)
        smaller = read_bits(deep, given, 64, plan)[deep.group]
        smaller |= deep.least[deep.group] < block.ids[block.doc(places)]
        n = len(block.data)
        start = block.bounds[:-1][block.doc(at)]
        fits = block.fitting(LENGTH)
        settled = cover_marks(n, places[smaller], places[smaller] + DEEP - LENGTH + 1) & fits
        near = at[repeated]
        likely = cover_marks(n, np.maximum(near - (PERIOD - 1), start[repeated]), near + 1) & fits
        waiting = likely & ~settled
        open_places = np.flatnonzero(waiting)
        value = shortened(prints(block.data, open_places, LENGTH), plan)
        names = Names(value, block.ids[block.doc(open_places)])
        return rows_of(lists(number, names, plan.short, plan, False), number,
                       packed_state(settled, waiting))

    def neighbours(number: int, block: Block, given: dict) -> pa.Table:
        settled, waiting = unpacked_state(given[STATE], len(block.data), 2)
        open_places = np.flatnonzero(waiting)
        value = shortened(prints(block.data, open_places, LENGTH), plan)
        names = Names(value, block.ids[block.doc(open_places)])
        known = read_bits(names, given, plan.short, plan) | names.shared_here()
        waiting[open_places[~known[names.group]]] = False
        exact = window_names(block, np.flatnonzero(waiting), plan)
        return rows_of(lists(number, exact, 64, plan, True), number,
                       packed_state(settled, waiting))

    def removal(number: int, block: Block, given: dict) -> pa.Table:
        settled, waiting = unpacked_state(given[STATE], len(block.data), 2)
        open_places = np.flatnonzero(waiting)
        exact = window_names(block, open_places, plan)
        smaller = read_bits(exact, given, 64, plan)[exact.group]
        smaller |= exact.least[exact.group] < block.ids[block.doc(open_places)]
        settled[open_places[smaller]] = True
        first = np.flatnonzero(settled)
        gone = cover_marks(len(block.data), first, first + LENGTH)
        removed, spans, hashes = [], [], []
        for a, b in zip(block.bounds[:-1], block.bounds[1:]):
            own = gone[a:b]
            removed.append(int(np.count_nonzero(own)))
            spans.append(int(own[:1].sum() + np.count_nonzero(own[1:] & ~own[:-1])))
            hashes.append(hashlib.sha256(block.data[a:b][~own].tobytes()).hexdigest())
        return pa.table({
            "row": pa.array(block.row), "doc_id": pa.array(block.ids, mask=~block.known),
            "n_bytes": pa.array(np.diff(block.bounds)), "n_removed": pa.array(removed, pa.int64()),
            "n_spans": pa.array(spans, pa.int64()), "kept_sha256": pa.array(hashes, pa.string())})

    def level(answers, run, bits, decide, name):
        return answered(passes(texts, answers, run, LISTS), bits, plan, decide, name)

    answers = level(None, triples, plan.short, False, "passage-triples")
    answers = level(answers, recursion, 64, True, "passage-deep")
    answers = level(answers, remaining, plan.short, False, "passage-remaining")
    answers = level(answers, neighbours, 64, True, "passage-neighbours")
    return passes(texts, answers, removal, RESULT).drop("row")
