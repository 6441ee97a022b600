"""Arrow batch functions over BINARY columns, usable from DataFrames and from SQL."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from hashlib import sha256
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronoview.functions import kernels

FLOATS = T.ArrayType(T.FloatType())
SMALLINTS = T.ArrayType(T.ShortType())


#: Views of 4,096 cells that are held as NumPy arrays, or leave Python, together.
VIEWS_AT_ONCE = 64


def _lists(rows: Iterable[np.ndarray | None], value_type: pa.DataType) -> pa.Array:
    """Lists of one batch; ``VIEWS_AT_ONCE`` rows are held beside what is stored already."""
    dtype, rows, chunks = value_type.to_pandas_dtype(), iter(rows), []
    while part := list(islice(rows, VIEWS_AT_ONCE)):
        sizes = [0 if row is None else len(row) for row in part]
        offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        flat = np.empty(offsets[-1], dtype)
        for start, row in zip(offsets, part):
            if row is not None:
                flat[start:start + len(row)] = row
        chunks.append(pa.ListArray.from_arrays(
            pa.array(offsets), pa.array(flat, type=value_type),
            mask=pa.array([row is None for row in part])))
    if len(chunks) == 1:
        return chunks[0]
    return pa.concat_arrays(chunks) if chunks else pa.array([], pa.list_(value_type))


def _per_blob(batch: pa.Array, kernel: Callable[[np.ndarray], object]) -> Iterator:
    """Apply a kernel to each value without copying the bytes; NULL stays NULL.

    An empty content has no bytes to view, states or entropy: NULL too, beside the others.
    """
    return (kernel(kernels.as_bytes(item.as_buffer()))
            if item.is_valid and len(item.as_buffer()) else None for item in batch)


@F.arrow_udf(FLOATS)
def raw_byte_view(content: pa.Array) -> pa.Array:
    return _lists(_per_blob(content, kernels.raw_byte_view), pa.float32())


@F.arrow_udf(FLOATS)
def entropy_view(content: pa.Array) -> pa.Array:
    return _lists(_per_blob(content, kernels.entropy_view), pa.float32())


@F.arrow_udf(SMALLINTS)
def sbsmi_view(content: pa.Array) -> pa.Array:
    return _lists(_per_blob(content, kernels.sbsmi_view), pa.int16())


@F.arrow_udf(FLOATS)
def raw_byte_view_binned(content: pa.Array) -> pa.Array:
    return _lists(_per_blob(content, kernels.raw_byte_view_binned), pa.float32())


@F.arrow_udf(FLOATS)
def entropy_view_binned(content: pa.Array) -> pa.Array:
    return _lists(_per_blob(content, kernels.entropy_view_binned), pa.float32())


@F.arrow_udf(T.DoubleType())
def byte_entropy(content: pa.Array) -> pa.Array:
    return pa.array(list(_per_blob(content, kernels.byte_entropy)), type=pa.float64())


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def block_entropies(content: pa.Array) -> pa.Array:
    return _lists(_per_blob(content, kernels.block_entropies), pa.float64())


@F.arrow_udf(SMALLINTS)
def lbit_states(content: pa.Array) -> pa.Array:
    return _lists(_per_blob(content, kernels.lbit_states), pa.int16())


@F.udtf(returnType=T.StructType([T.StructField("pos", T.LongType()),
                               T.StructField("state", T.IntegerType())]))
class StateRows:
    """Table function: one row per 6-bit state of a blob."""

    def eval(self, content: bytes):
        if content:
            yield from enumerate(int(s) for s in kernels.lbit_states(kernels.as_bytes(content)))


SQL_FUNCTIONS = {
    "raw_byte_view": raw_byte_view,
    "entropy_view": entropy_view,
    "sbsmi_view": sbsmi_view,
    "raw_byte_view_binned": raw_byte_view_binned,
    "entropy_view_binned": entropy_view_binned,
    "byte_entropy": byte_entropy,
    "lbit_states": lbit_states,
}


def register_functions(spark: SparkSession) -> None:
    """Make the byte views callable from SQL."""
    for name, function in SQL_FUNCTIONS.items():
        spark.udf.register(name, function)
    spark.udtf.register("state_rows", StateRows)


# -- several views per blob in one pass ------------------------------------------------

VIEW_KERNELS = {
    "raw_byte": kernels.raw_byte_view,
    "entropy": kernels.entropy_view,
    "sbsmi": kernels.sbsmi_view,
}
VIEW_DTYPES = {"raw_byte": "float32", "entropy": "float32", "sbsmi": "uint8"}


def float32_digests(pixels: pa.Array) -> pa.Array:
    """SHA-256 of each array's little-endian float32 bytes, taken from the Arrow buffer."""
    raw = pixels.cast(pa.list_(pa.float32()))
    data = memoryview(raw.values.buffers()[1]) if len(raw.values) else memoryview(b"")
    skip, offsets, width = raw.values.offset, raw.offsets.to_pylist(), 4
    return pa.array([sha256(data[(skip + lo) * width:(skip + hi) * width]).hexdigest()
                     if ok else None
                     for lo, hi, ok in zip(offsets, offsets[1:], raw.is_valid().to_pylist())],
                    type=pa.string())


def view_rows(modalities: tuple[str, ...], carry: tuple[str, ...],
              content: str = "content", digests: bool = False,
              blank: bool = False) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """mapInArrow body: (carry.., content) -> (carry.., modality, pixels, error[, output_sha256]).

    A blob crosses into Python once whatever the number of modalities, and one that
    cannot be viewed gives an error row instead of ending the task. With ``blank`` an empty or
    missing content has a view of zeros beside its error. ``VIEWS_AT_ONCE`` views wait, however
    many blobs a batch has.
    """
    def one(blob, name: str) -> tuple[np.ndarray | None, str | None]:
        try:
            if not blob.is_valid:
                raise ValueError("missing content")
            return VIEW_KERNELS[name](kernels.as_bytes(blob.as_buffer())), None
        except ValueError as problem:
            empty = not blob.is_valid or not len(blob.as_buffer())
            return (kernels.blank_view() if blank and empty else None,
                    f"{type(problem).__name__}: {problem}")

    step = max(1, VIEWS_AT_ONCE // max(1, len(modalities)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(start, step) for whole in batches
                      for start in range(0, whole.num_rows, step)):
            made = [(name, *one(blob, name)) for blob in batch.column(content)
                    for name in modalities]
            rows = pa.array(np.arange(batch.num_rows).repeat(len(modalities)), pa.int64())
            names, pixels, errors = zip(*made) if made else ((), (), ())
            views = _lists(pixels, pa.float32())
            digest = {"output_sha256": float32_digests(views)} if digests else {}
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c).take(rows) for c in carry), pa.array(names, pa.string()),
                 views, pa.array(errors, pa.string()), *digest.values()],
                names=[*carry, "modality", "pixels", "error", *digest])
    return run
