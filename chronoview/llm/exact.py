"""Exact dedup by exchange of Golomb-coded fingerprints.

1. Every input partition fingerprints its texts and sends each owner (a range of hash values)
   its sorted hashes, delta-coded with a Golomb-Rice code: a little more than the bits that
   separate neighbours, instead of 64 for each.
2. An owner merges the lists and returns one bitmap per list: which hashes occur in another
   list too. A hash that repeats inside one list is marked by the sender itself.
3. Documents with a marked hash are suspects. Only their texts are grouped, byte by byte,
   with partial aggregation first, so a group of copies sends one row per partition.

A partition's rows and its lists are written together, and owners and senders work from that
table, so a task that is run again cannot disagree with an earlier answer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoview.llm.common import packed, unpacked, whole
from chronoview.operators.sieve import sieve_of, sift
from chronoview.session import staged

# Rows a sender holds at most; a larger partition sends in several blocks.
BLOCK_ROWS = 1 << 16
MAX_OWNERS = 4096
SENT = ("block long, owner int, count int, code binary, doc_id array<long>, "
        "hash array<long>, digest array<binary>")
MARKED = "doc_id long, hash long, digest binary, suspect boolean"


def golomb_parameter(values: int, span: int) -> int:
    """Bits of the remainder: the binary logarithm of the mean gap."""
    return max(0, int(span / max(1, values)).bit_length() - 1)


def golomb_encode(sorted_values: np.ndarray, span: int) -> bytes:
    """Golomb-Rice code of the gaps of sorted distinct values in [0, span).

    One byte for the parameter, then per gap its quotient in unary and its remainder.
    """
    shift = golomb_parameter(len(sorted_values), span)
    gaps = np.diff(sorted_values, prepend=np.uint64(0)).astype(np.uint64)
    quotients = (gaps >> np.uint64(shift)).astype(np.int64)
    widths = quotients + 1 + shift
    ends = np.cumsum(widths)
    bits = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    starts = ends - widths
    ones = np.repeat(starts, quotients) + (
        np.arange(int(quotients.sum())) - np.repeat(np.cumsum(quotients) - quotients, quotients))
    bits[ones] = 1
    for k in range(shift):
        bits[starts + quotients + 1 + k] = (gaps >> np.uint64(shift - 1 - k)) & np.uint64(1)
    return bytes([shift]) + np.packbits(bits).tobytes()


def golomb_decode(code: bytes, count: int) -> np.ndarray:
    shift = code[0]
    bits = np.unpackbits(np.frombuffer(code, np.uint8, offset=1))
    zeros = np.flatnonzero(bits == 0)
    # The next stop bit is the first zero at or after the end of the value before.
    quotients, starts = np.zeros(count, np.uint64), np.zeros(count, np.int64)
    at, z = 0, 0
    follow = np.searchsorted(zeros, np.arange(len(bits) + 1)) if count else zeros
    for i in range(count):
        z = zeros[follow[at]]
        quotients[i] = z - at
        starts[i] = z + 1
        at = z + 1 + shift
    values = quotients << np.uint64(shift)
    for k in range(shift):
        values |= bits[starts + k].astype(np.uint64) << np.uint64(shift - 1 - k)
    return np.cumsum(values, dtype=np.uint64)


def owner_count(docs: DataFrame) -> int:
    """A power of two that follows the number of input partitions."""
    wanted = max(16, docs.rdd.getNumPartitions())
    return min(MAX_OWNERS, 1 << (wanted - 1).bit_length())


def send(docs: DataFrame, owners: int) -> DataFrame:
    """Rows of every block (owner -1) and the lists that the block sends (owner >= 0)."""
    bits = owners.bit_length() - 1
    span = 1 << (64 - bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK_ROWS):
                held.append(batch.slice(start, BLOCK_ROWS))
                rows += held[-1].num_rows
                if rows >= BLOCK_ROWS:
                    yield lists(block, held)
                    block, held, rows = block + 1, [], 0
        if held:
            yield lists(block, held)

    def lists(block: int, held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        ids, hashes, digests = (table.column(c).combine_chunks()
                                for c in ("doc_id", "hash", "digest"))
        distinct = np.unique(hashes.to_numpy().astype(np.uint64))
        owner = (distinct >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(
            len(distinct), np.int64)
        bounds = np.searchsorted(owner, np.arange(owners + 1))
        used = np.flatnonzero(np.diff(bounds))
        codes = [golomb_encode(distinct[bounds[o]:bounds[o + 1]] & np.uint64(span - 1), span)
                 for o in used]
        n = len(used)

        def column(first, rest):
            return pa.array([first] + [rest] * n)
        return pa.RecordBatch.from_arrays([
            pa.array([block] * (n + 1), pa.int64()),
            pa.array([-1, *used.tolist()], pa.int32()),
            pa.array([len(ids), *np.diff(bounds)[used].tolist()], pa.int32()),
            pa.array([None, *codes], pa.binary()),
            pa.array([ids.to_pylist()] + [None] * n, pa.list_(pa.int64())),
            pa.array([hashes.to_pylist()] + [None] * n, pa.list_(pa.int64())),
            pa.array([digests.to_pylist()] + [None] * n, pa.list_(pa.binary()))],
            names=["block", "owner", "count", "code", "doc_id", "hash", "digest"])

    return docs.mapInArrow(run, SENT)


def answer(sent: DataFrame) -> DataFrame:
    """Per block and owner: a bitmap of the list's hashes that another list holds too."""
    def decide(table: pa.Table) -> pa.Table:
        counts = table.column("count").to_pylist()
        decoded = [golomb_decode(code.as_py(), n)
                   for code, n in zip(table.column("code"), counts)]
        values, index, times = np.unique(np.concatenate(decoded), return_inverse=True,
                                         return_counts=True)
        shared = (times > 1)[index]
        ends = np.cumsum(counts)
        maps = [np.packbits(shared[e - n:e]).tobytes() for e, n in zip(ends, counts)]
        return pa.table({"block": table.column("block"), "owner": table.column("owner"),
                         "bitmap": pa.array(maps, pa.binary())})

    lists = sent.where("owner >= 0").select("block", "owner", "count", "code")
    return lists.groupBy("owner").applyInArrow(decide, "block long, owner int, bitmap binary")


def mark(sent: DataFrame, answers: DataFrame, owners: int) -> DataFrame:
    """Every document's fingerprint row with its verdict: suspect or surely unique."""
    bits = owners.bit_length() - 1

    def decide(rows: pa.Table, maps: pa.Table) -> pa.Table:
        hashes = rows.column("hash").combine_chunks().flatten().to_numpy()
        distinct, index, times = np.unique(hashes.astype(np.uint64), return_inverse=True,
                                           return_counts=True)
        owner = (distinct >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(
            len(distinct), np.int64)
        bounds = np.searchsorted(owner, np.arange(owners + 1))
        shared = times > 1
        answered = 0
        for o, bitmap in zip(maps.column("owner").to_pylist(), maps.column("bitmap")):
            a, b = bounds[o], bounds[o + 1]
            shared[a:b] |= np.unpackbits(np.frombuffer(bitmap.as_py(), np.uint8),
                                         count=b - a).astype(bool)
            answered += b - a
        if answered != len(distinct):
            raise RuntimeError("a block of fingerprints lacks an owner's answer")
        return pa.table({"doc_id": rows.column("doc_id").combine_chunks().flatten(),
                         "hash": pa.array(hashes),
                         "digest": rows.column("digest").combine_chunks().flatten(),
                         "suspect": pa.array(shared[index])})

    blocks = sent.where("owner = -1").select("block", "doc_id", "hash", "digest")
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(decide, MARKED)


def fingerprint(text):
    return F.xxhash64(text)


def exchange(docs: DataFrame) -> DataFrame:
    """doc_id, hash, digest (SHA-256) and suspect of every document, stored."""
    text = whole()
    prints = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                         fingerprint(text).alias("hash"),
                         F.unhex(F.sha2(text, 256)).alias("digest"))
    owners = owner_count(docs)
    sent = staged(send(prints, owners), "exact-sent")
    return staged(mark(sent, answer(sent), owners), "exact-marked")


def sieve_of_suspects(marked: DataFrame) -> DataFrame:
    return staged(sieve_of(marked.where("suspect").select("hash"), "hash"), "exact-sieve")


def verified_groups(docs: DataFrame, sieve: DataFrame) -> DataFrame:
    """Suspect texts grouped byte by byte: digest, keep_id (largest doc_id), group_size."""
    suspects = sift(docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                                whole().alias("_text")), fingerprint(F.col("_text")), sieve)
    groups = suspects.where("_maybe").groupBy("_text").agg(
        F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    return groups.select(F.unhex(F.sha2("_text", 256)).alias("digest"), "keep_id", "group_size")


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are compared as they are; null counts as empty. The row with the largest doc_id of
    equal texts stays (a null id is the smallest); of rows equal in text and doc_id one stays.
    An empty table gives no rows; other columns are ignored.
    """
    marked = exchange(docs)
    sieve = sieve_of_suspects(marked)
    groups = staged(verified_groups(docs, sieve), "exact-groups")
    # Rows that agree in id and text are counted, not paired, and come back after the join.
    rows = marked.groupBy("digest", "doc_id").agg(F.count("*").alias("_rows"),
                                                  F.max("suspect").alias("suspect"))
    alone = rows.where(~F.col("suspect")).select(
        "doc_id", "digest", "_rows", F.col("doc_id").alias("keep_id"),
        F.lit(1).cast("long").alias("group_size"))
    shared = rows.where("suspect").join(groups, "digest").select(
        "doc_id", "digest", "_rows", "keep_id", "group_size")
    return alone.unionByName(shared).withColumn(
        "_row", F.explode(F.sequence(F.lit(1), F.col("_rows").cast("int")))).select(
        "doc_id", "keep_id", "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("_row") == 1)).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"))


def drop_exact_duplicates(docs: DataFrame) -> DataFrame:
    """The documents that stay, whole rows with all their columns.

    Surely unique ones never move; suspects are grouped by their text, where the row with the
    largest doc_id stays (ties by the other columns).
    """
    sieve = sieve_of_suspects(exchange(docs))
    sifted = sift(packed(docs, whole().alias("_text")), fingerprint(F.col("_text")), sieve)
    unique = sifted.where(~F.col("_maybe"))
    chosen = (sifted.where("_maybe").groupBy("_text").agg(
        F.max(F.struct(F.col("_row.doc_id").alias("_id"), "_row")).alias("_best"))
        .select(F.col("_best._row").alias("_row")))
    return unpacked(unique).unionByName(unpacked(chosen))
