"""Views of blobs that arrive in blocks: mergeable partial results per block.

A block is a multiple of 768 bytes: whole 6-bit states, whole entropy blocks and whole
layout rows. Every block gives partial sums on its own; these are added up per blob, so one
huge blob is spread over as many tasks as it has blocks. A short block would touch all 4,096
cells of a view, so what is shuffled are the sums of its own layout rows, fewer bytes than the
block has; they become cells where they are added up.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoview.functions import kernels
from chronoview.functions.arrow import VIEWS_AT_ONCE

BLOCK_UNIT = 768
BLOCK_BYTES = BLOCK_UNIT * 16384
MODALITIES = ("raw_byte", "entropy", "sbsmi")
PART_SCHEMA = ("modality string, n_bytes bigint, first int, rows int, cells binary, sums binary")
#: Up to so many layout rows a block sends their sums, beyond it those of the 4,096 output cells.
OWN_ROWS = 256


def split_blocks(blobs: DataFrame, block_bytes: int = BLOCK_BYTES,
                 keys: Sequence[str] = ("sha",), blank: bool = False) -> DataFrame:
    """(keys.., block_no, bytes, n_bytes, before, after) of whole blobs.

    A block brings the 128 bytes on either side along, cut where the whole blob is at hand:
    no block is joined to another. ``keys`` name a blob: with several members of one sha,
    give the member too. An empty or missing content has no block, with ``blank`` one without
    bytes.
    """
    if block_bytes < BLOCK_UNIT or block_bytes % BLOCK_UNIT:
        raise ValueError(f"block size must be a multiple of {BLOCK_UNIT}")
    size, content = F.octet_length("content"), F.col("content")
    starts = F.when(size > 0, F.sequence(F.lit(0), F.floor((size - 1) / block_bytes).cast("int")))
    if blank:
        content, size = F.coalesce(content, F.lit(b"")), F.coalesce(size, F.lit(0))
        starts = F.coalesce(starts, F.array(F.lit(0)))
    numbered = blobs.select(*keys, "content", size.cast("bigint").alias("n_bytes"),
                            F.explode(starts).alias("block_no"))
    first = F.col("block_no") * block_bytes
    return numbered.select(
        *keys, "block_no", "n_bytes",
        F.substring(content, first + 1, F.lit(block_bytes)).alias("bytes"),
        F.when(F.col("block_no") > 0, F.substring(content, first - 127, F.lit(128))).alias("before"),
        F.substring(content, first + block_bytes + 1, F.lit(128)).alias("after"))


def _block_parts(block_bytes: int, keys: Sequence[str], modalities: Sequence[str],
                 fractional: bool):
    """mapInArrow body: partial sums of one block, one row per view, packed little-endian.

    Bytes: 16-bit sums of own cells, or 64-bit ones of output cells. Entropies: doubles of
    128-byte blocks or of output cells. Transitions: 16-bit cells and 32-bit counts.
    """
    def sums(row: dict, name: str, first: int, values: np.ndarray) -> tuple[bytes | None, bytes]:
        n, rows = row["n_bytes"], kernels.layout_height(values.size)
        left, right = row["before"] or b"", row["after"] or b""
        if name == "sbsmi":
            counts = kernels.transition_counts(values)
            if left:
                counts[(left[-1] & 63) << 6 | int(values[0]) >> 2] += 1
            used = np.flatnonzero(counts)
            return used.astype("<u2").tobytes(), counts[used].astype("<u4").tobytes()
        if name == "raw_byte":
            own = kernels.cell_sums(values)
            if rows <= OWN_ROWS:
                return None, own.astype("<u2").tobytes()
            total = kernels.area_shares(own, first, kernels.layout_height(n), fractional)
            return None, total.astype("<i8").tobytes()
        entropies = kernels.block_entropies(
            np.frombuffer(left + row["bytes"] + right, dtype=np.uint8))
        skip = 1 if left else 0
        own = entropies[skip:skip + -(-values.size // kernels.BLOCK_BYTES)]
        if rows > OWN_ROWS:
            own = kernels.entropy_shares(own, first, n, fractional)
        return None, own.astype("<f8").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for row in batch.to_pylist():
                if not row["n_bytes"]:
                    made += [(*(row[k] for k in keys), name, 0, 0, 0, None, b"")
                             for name in modalities]
                    continue
                values = kernels.as_bytes(row["bytes"])
                first = row["block_no"] * block_bytes // kernels.ROW_BYTES
                for name in modalities:
                    cells, total = sums(row, name, first, values)
                    made.append((*(row[k] for k in keys), name, row["n_bytes"], first,
                                 kernels.layout_height(values.size), cells, total))
            if made:
                types = [*(pa.string() for _ in keys), pa.string(), pa.int64(), pa.int32(),
                         pa.int32(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(column, kind) for column, kind in zip(zip(*made), types)],
                    names=[*keys, "modality", "n_bytes", "first", "rows", "cells", "sums"])
    return run


def block_parts(blocks: DataFrame, block_bytes: int = BLOCK_BYTES,
                keys: Sequence[str] = ("sha",), modalities: Sequence[str] = MODALITIES,
                fractional: bool = True) -> DataFrame:
    """(keys.., modality, n_bytes, first, rows, cells, sums): packed sums, one row per block."""
    schema = ", ".join(f"{k} string" for k in keys) + ", " + PART_SCHEMA
    return blocks.select(*keys, "block_no", "bytes", "n_bytes", "before", "after").mapInArrow(
        _block_parts(block_bytes, tuple(keys), tuple(modalities), fractional), schema)


def _cell_sums(part: dict, fractional: bool) -> tuple[np.ndarray, np.ndarray]:
    """Sums and areas that a part adds to the 64 x 64 cells of its view."""
    n, first, rows, small = part["n_bytes"], part["first"], part["rows"], part["rows"] <= OWN_ROWS
    if not n:
        return np.zeros((2, kernels.SIDE, kernels.SIDE), dtype=np.int64)
    if part["modality"] == "sbsmi":
        total = np.zeros(kernels.CELLS, dtype=np.int64)
        total[np.frombuffer(part["cells"], "<u2")] = np.frombuffer(part["sums"], "<u4")
        return total.reshape(kernels.SIDE, -1), total.reshape(kernels.SIDE, -1)
    if part["modality"] == "raw_byte":
        total = np.frombuffer(part["sums"], "<u2" if small else "<i8").astype(np.int64).reshape(
            -1, kernels.SIDE)
        if small:
            total = kernels.area_shares(total, first, kernels.layout_height(n), fractional)
    else:
        total = np.frombuffer(part["sums"], "<f8")
        total = kernels.entropy_shares(total, first, n, fractional) if small else total.reshape(
            kernels.SIDE, -1)
    return total, kernels.valid_area(n, first, rows, fractional)


def _finished(modality: str, total: np.ndarray, area: np.ndarray) -> np.ndarray:
    if modality == "sbsmi":
        return np.floor(total / np.maximum(total.sum(axis=1, keepdims=True), 1) * 255)
    mean = total / np.maximum(area, 1)
    return mean / 255 if modality == "raw_byte" else np.clip(mean, 0.0, 1.0)


def _added_up(keys: Sequence[str], fractional: bool,
              array: Callable[[np.ndarray, np.ndarray], pa.Array]):
    """mapInArrow body over sorted parts: one row of 4,096 values per view.

    The parts of a view follow one another, also across batches; only the sums of one view
    and ``VIEWS_AT_ONCE`` finished ones wait.
    """
    names = [*keys, "modality"]

    def rows(done: list[tuple]) -> pa.RecordBatch:
        ids, values, areas = zip(*done)
        offsets = pa.array(np.arange(len(done) + 1, dtype=np.int32) * kernels.CELLS)
        flat = array(np.concatenate(values, axis=None), np.concatenate(areas, axis=None))
        return pa.RecordBatch.from_arrays(
            [*(pa.array(column, pa.string()) for column in zip(*ids)),
             pa.ListArray.from_arrays(offsets, flat)], names=[*names, "pixels"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, done = None, []
        for batch in batches:
            for i in range(batch.num_rows):
                part = batch.slice(i, 1).to_pylist()[0]
                total, area = _cell_sums(part, fractional)
                view = tuple(part[k] for k in names)
                if last is not None and last[0] == view:
                    last = view, last[1] + total, last[2] + area
                    continue
                if last is not None:
                    done.append((last[0], _finished(last[0][-1], *last[1:]), last[2]))
                last = view, total, area
                if len(done) == VIEWS_AT_ONCE:
                    yield rows(done)
                    done = []
        if last is not None:
            yield rows([*done, (last[0], _finished(last[0][-1], *last[1:]), last[2])])
    return run


def _merged(parts: DataFrame, keys: Sequence[str], kind: str, fractional: bool,
            array: Callable[[np.ndarray, np.ndarray], pa.Array]) -> DataFrame:
    schema = ", ".join(f"{k} string" for k in (*keys, "modality")) + f", pixels array<{kind}>"
    dealt = parts.repartition(*keys).sortWithinPartitions(*keys, "modality", "first")
    return dealt.mapInArrow(_added_up(tuple(keys), fractional, array), schema)


def merge_parts(parts: DataFrame, keys: Sequence[str] = ("sha",),
                fractional: bool = True) -> DataFrame:
    """(keys.., modality, cell, value): finished cells; absent ones are 0."""
    views = _merged(parts, keys, "double", fractional,
                    lambda values, areas: pa.array(values, pa.float64(), mask=areas == 0))
    return views.select(*keys, "modality", F.posexplode("pixels").alias("cell", "value")).where(
        F.col("value").isNotNull())


def block_views(blobs: DataFrame, block_bytes: int = BLOCK_BYTES,
                keys: Sequence[str] = ("sha",),
                modalities: Sequence[str] = MODALITIES, blank: bool = False) -> DataFrame:
    """Views of blobs too large for one task: one scan, and only partial sums are shuffled.

    A content without bytes has none, with ``blank`` one of zeros.
    """
    parts = block_parts(split_blocks(blobs, block_bytes, keys, blank), block_bytes, keys,
                        modalities)
    return _merged(parts, keys, "float", True, lambda values, areas: pa.array(
        np.where(areas > 0, values, 0).astype(np.float32)))


def cells_view(blobs: DataFrame, modality: str, key: str = "sha",
               fractional: bool = True) -> DataFrame:
    """(key, r, c, value) of one view: 4-byte cells averaged into 64 output rows.

    ``fractional`` weighs source rows by their overlap; otherwise every touching row counts
    fully. Cells without valid bytes do not appear (they are 0 in the dense view).
    """
    parts = block_parts(split_blocks(blobs, BLOCK_BYTES, (key,)), BLOCK_BYTES, (key,),
                        (modality,), fractional)
    return merge_parts(parts, (key,), fractional).select(
        key, F.floor(F.col("cell") / kernels.SIDE).cast("int").alias("r"),
        F.pmod(F.col("cell"), F.lit(kernels.SIDE)).cast("int").alias("c"), "value")
