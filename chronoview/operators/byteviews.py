"""The byte views as plans: states, transitions, local entropy, area resize.

Bytes are counted inside tasks (bytes, windows, transitions, layout rows of a blob); what is
grouped, resized and joined afterwards are those counts. The Arrow functions compute whole views
faster.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from chronoview.functions import kernels
from chronoview.functions.vectors import let
from chronoview.operators.blocks import cells_view

SIDE = 64
STATES_AT_ONCE = 1 << 20


def counted(blobs: DataFrame, kernel: Callable[[np.ndarray], tuple[np.ndarray, ...]],
            fields: list[tuple[str, T.DataType]], key: str = "sha") -> DataFrame:
    """Rows (key, fields..) that a kernel gives per blob: counts, never a row per byte.

    A missing or empty content gives none.
    """
    schema = T.StructType([blobs.schema[key], *(T.StructField(n, t) for n, t in fields)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, blob in enumerate(batch.column("content")):
                if not blob.is_valid or not len(blob.as_buffer()):
                    continue
                columns = kernel(kernels.as_bytes(blob.as_buffer()))
                keys = batch.column(key).take(pa.array(np.full(len(columns[0]), row)))
                yield pa.RecordBatch.from_arrays([keys, *map(pa.array, columns)],
                                                 names=[key, *(n for n, _ in fields)])

    return blobs.select(key, "content").mapInArrow(run, schema)


def byte_counts(blobs: DataFrame, key: str = "sha") -> DataFrame:
    """(key, byte, k): at most 256 rows per blob."""
    def kernel(values: np.ndarray) -> tuple[np.ndarray, ...]:
        counts = np.zeros(256, np.int64)
        for start in range(0, values.size, kernels.SLICE_BYTES):
            counts += np.bincount(values[start:start + kernels.SLICE_BYTES], minlength=256)
        used = np.flatnonzero(counts)
        return used.astype(np.int32), counts[used]
    return counted(blobs, kernel, [("byte", T.IntegerType()), ("k", T.LongType())], key)


def transition_totals(blobs: DataFrame, bits: int = 6, key: str = "sha") -> DataFrame:
    """(key, prev, cur, n, positions): at most 4^bits rows per blob; positions are summed."""
    size = 1 << bits

    def kernel(values: np.ndarray) -> tuple[np.ndarray, ...]:
        states = kernels.lbit_states(values, bits)
        n = np.zeros(size * size, np.int64)
        positions = np.zeros(size * size, np.int64)
        for start in range(1, states.size, STATES_AT_ONCE):
            part = states[start - 1:start + STATES_AT_ONCE].astype(np.int64)
            pair = part[:-1] * size + part[1:]
            found = np.bincount(pair, minlength=size * size)
            within = np.bincount(pair, np.arange(pair.size), size * size)
            n += found
            positions += within.astype(np.int64) + start * found
        used = np.flatnonzero(n)
        return ((used // size).astype(np.int32), (used % size).astype(np.int32), n[used],
                positions[used])
    return counted(blobs, kernel, [("prev", T.IntegerType()), ("cur", T.IntegerType()),
                                   ("n", T.LongType()), ("positions", T.LongType())], key)


def byte_array(content: Column) -> Column:
    """The bytes of a blob as integers; NULL when there are none.

    Latin-1 maps every byte to the character of the same number, so one decode and one
    split read the whole blob without a substring per byte.
    """
    return F.when(F.octet_length(content) > 0, F.transform(
        F.split(F.decode(content, "ISO-8859-1"), ""), lambda c: F.ascii(c)))


def state_array(content: Column, bits: int = 6) -> Column:
    """MSB-first non-overlapping states of a blob; a short tail gets high-order zeros.

    A state of at most 8 bits lies within two bytes, taken as one integer and shifted.
    """
    if not 1 <= bits <= 8:
        raise ValueError("bits must be from 1 to 8")

    def states(values: Column) -> Column:
        total = F.size(values) * 8

        def one(i: Column) -> Column:
            start, stop = i * bits, F.least((i + 1) * bits, total)
            first = F.shiftright(start, 3)
            pair = F.get(values, first) * 256 + F.coalesce(F.get(values, first + 1), F.lit(0))
            unused = F.lit(16) + first * 8 - stop
            return F.call_function("shiftright", pair, unused).bitwiseAND(
                F.call_function("shiftleft", F.lit(1), stop - start) - 1)
        return F.transform(F.sequence(F.lit(0), F.ceil(total / bits).cast("int") - 1), one)
    return let(byte_array(content), lambda v: F.when(v.isNotNull(), states(v)))


def transition_probabilities(counts: DataFrame, key: str = "sha") -> DataFrame:
    """Row-normalised probabilities of the transitions that occur."""
    # At most 64 rows per (blob, previous state).
    total = F.sum("n").over(W.partitionBy(key, "prev"))
    return counts.select(key, "prev", "cur", "n", (F.col("n") / total).alias("p"))


def transition_pixels(probabilities: DataFrame, key: str = "sha") -> DataFrame:
    return probabilities.select(key, "prev", "cur",
                                F.floor(F.col("p") * 255).cast("int").alias("pixel"))


def shannon_entropy(blobs: DataFrame, key: str = "sha") -> DataFrame:
    """Entropy of each blob's byte distribution in bits and over 8."""
    bits = F.log2(F.sum("k")) - F.sum(F.col("k") * F.log2("k")) / F.sum("k")
    return byte_counts(blobs, key).groupBy(key).agg(
        F.greatest(bits, F.lit(0.0)).alias("entropy_bits")) \
        .withColumn("entropy_unit", F.col("entropy_bits") / 8)


def window_entropies(blobs: DataFrame, key: str = "sha") -> DataFrame:
    """(key, w, h): H/8 of the 256-byte windows every 128 bytes, the operator's own rows."""
    def kernel(values: np.ndarray) -> tuple[np.ndarray, ...]:
        h = kernels.window_entropies(values)
        return np.arange(h.size, dtype=np.int32), h
    return counted(blobs, kernel, [("w", T.IntegerType()), ("h", T.DoubleType())], key)


def raw_byte_cells_view(blobs: DataFrame, key: str = "sha", fractional: bool = True) -> DataFrame:
    return cells_view(blobs, "raw_byte", key, fractional)


def entropy_cells_view(blobs: DataFrame, key: str = "sha", fractional: bool = True) -> DataFrame:
    return cells_view(blobs, "entropy", key, fractional)


def sbsmi_cells_view(blobs: DataFrame, bits: int = 6, key: str = "sha") -> DataFrame:
    return transition_pixels(
        transition_probabilities(transition_totals(blobs, bits, key), key), key)


def explode_pixels(views: DataFrame, keys: tuple[str, ...] = ("sha",),
                   pixels: str = "pixels") -> DataFrame:
    """(keys, r, c, value) of dense 64x64 arrays; a missing view gives no cells.

    Of a plain explode Spark infers a filter on the array, and a view that a Python function
    makes would be made once more for it.
    """
    cells = views.select(*keys, F.posexplode_outer(pixels).alias("i", "value")).where(
        "i IS NOT NULL")
    return cells.select(*keys, F.floor(F.col("i") / SIDE).cast("int").alias("r"),
                        F.pmod(F.col("i"), F.lit(SIDE)).cast("int").alias("c"), "value")
