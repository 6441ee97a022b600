"""Row numbers and joins that keep hot groups spread over many tasks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

HOT_SHARE = 1.0 / 256.0


def sha_bucket(sha: Column, digits: int = 3) -> Column:
    """Order-preserving bucket of a hex id: ids sort by bucket first."""
    return F.substring(sha, 1, digits)


def seeded_order(sha: Column, seed: Column | int) -> Column:
    """A portable pseudo-random order of ids, reproducible in any engine."""
    seed = seed if isinstance(seed, Column) else F.lit(seed)
    return F.sha2(F.concat_ws(":", seed.cast("string"), sha), 256)


def ranked(df: DataFrame, keys: Sequence[str], order: Sequence[Column], bucket: Column,
           name: str = "rank", start: DataFrame | None = None,
           start_keys: Sequence[str] = ()) -> DataFrame:
    """row_number() per ``keys`` in ``order``, without sorting a whole group in one task.

    ``bucket`` must grow with the order. Bucket sizes give each bucket its first number,
    so only (keys, bucket) has to fit one task; a key holding a third of all rows is
    still ranked by as many tasks as it has buckets. ``start`` (start_keys, start) adds a
    first number per group; it is joined to the bucket sizes, never to the rows.
    """
    cut = df.withColumn("_bucket", bucket)
    sizes = cut.groupBy(*keys, "_bucket").agg(F.count("*").alias("_rows"))
    earlier = (W.partitionBy(*keys).orderBy("_bucket")
               .rowsBetween(W.unboundedPreceding, -1))
    offsets = sizes.select(*keys, "_bucket", F.coalesce(
        F.sum("_rows").over(earlier), F.lit(0)).alias("_before"))
    if start is not None:
        offsets = offsets.join(start, list(start_keys)).select(
            *keys, "_bucket", (F.col("_before") + F.col("start")).alias("_before"))
    inside = W.partitionBy(*keys, "_bucket").orderBy(*order)
    return (cut.join(offsets, [*keys, "_bucket"])
            .withColumn(name, F.col("_before") + F.row_number().over(inside))
            .drop("_bucket", "_before"))


def hot_keys(df: DataFrame, keys: Sequence[str], share: float = HOT_SHARE) -> DataFrame:
    """Keys holding more than ``share`` of the rows: never more than 1/share of them."""
    counts = df.groupBy(*keys).agg(F.count("*").alias("_rows"))
    return counts.where(
        F.col("_rows") > df.agg(F.count("*") * F.lit(share)).scalar()).select(*keys)


def skew_join(big: DataFrame, small: DataFrame, keys: Sequence[str],
              how: str = "inner") -> DataFrame:
    """Join a skewed frame to one with unique keys: hot keys by broadcast, others by shuffle.

    At most 1/HOT_SHARE keys can be hot, which bounds what is broadcast whatever the data.
    """
    hot = F.broadcast(hot_keys(big, keys))
    hot_small = F.broadcast(small.join(hot, list(keys), "left_semi"))
    spread = big.join(hot, list(keys), "left_semi").join(hot_small, list(keys), how)
    rest = big.join(hot, list(keys), "left_anti").join(small, list(keys), how)
    return spread.unionByName(rest)


def lookup_join(big: DataFrame, small: DataFrame, keys: Sequence[str],
                how: str = "inner") -> DataFrame:
    """Join to a lookup table with unique keys.

    No hint: Spark broadcasts the lookup by its measured bytes, and adaptive execution splits
    a hot key's partition where both sides are shuffled.
    """
    return big.join(small, list(keys), how)
