"""What the vector operators share: whole-number vectors and exact products."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoview.session import staged

#: Components are held to this bound on both sides, so that sums of squares fit 64 bits.
LIMIT = 1 << 24


def finite(vector: Column) -> Column:
    """True where a vector is not null, not empty and holds finite numbers only."""
    return vector.isNotNull() & (F.size(vector) > 0) & F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))


def scaled(vector: Column, scale: int) -> Column:
    """floor(scale * x) of every component, x as double, held to LIMIT."""
    return F.transform(vector, lambda x: F.floor(F.least(F.greatest(
        x.cast("double") * scale, F.lit(float(-LIMIT))), F.lit(float(LIMIT)))).cast("int"))


def numbered(vectors: DataFrame, scale: int, *fields: Column) -> DataFrame:
    """row, fields and v of the usable vectors, stored; ``row`` tells repeated rows apart.

    Vectors of another length than most of the table's (of equally many: than the longest)
    cannot be compared with the others and are left out.
    """
    whole = vectors.where(finite(F.col("embedding"))).select(
        F.monotonically_increasing_id().alias("row"), *fields,
        scaled(F.col("embedding"), scale).alias("v"))
    rows = staged(whole, "vectors")
    usual = rows.groupBy(F.size("v").alias("_size")).count().orderBy(
        F.desc("count"), F.desc("_size")).first()
    return rows.where(F.size("v") == (usual["_size"] if usual else 0))


def matrix(column: pa.Array | pa.ChunkedArray, rows: int) -> np.ndarray:
    """Equally long lists as a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(rows, -1)


def comparable(*sides: np.ndarray) -> list[np.ndarray]:
    """The sides as floats where all products of their rows are exact so, else as long ints."""
    width = sides[0].shape[1]
    most = max((int(np.abs(s).max()) for s in sides if s.size), default=0)
    kind = np.float64 if 4 * width * most * most < 1 << 53 else np.int64
    return [s.astype(kind) for s in sides]
