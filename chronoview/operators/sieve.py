"""A bitmap of keys with a fixed bound, to spare rows a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of the sieve: 2^25 bits are 4 MB however many keys go in.
SIEVE_BITS = 1 << 25


def sieve_place(key: Column) -> Column:
    return F.pmod(key, F.lit(SIEVE_BITS)) + F.lit(1)


def sieve_of(keys: DataFrame, key: str) -> DataFrame:
    """Bitmap of 64-bit keys, at most 4 MB: one row per used stretch of 32,768 bits.

    It only spares rows a shuffle: a row it lets through is still checked exactly.
    """
    place = sieve_place(F.col(key))
    return (keys.groupBy(F.bitmap_bucket_number(place).alias("_stretch"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("_bits")))


def sift(df: DataFrame, key: Column, sieve: DataFrame) -> DataFrame:
    """Add ``_maybe``: false for rows whose key is surely not among the sieve's keys."""
    place = sieve_place(key)
    bit = F.bitmap_bit_position(place)
    byte = F.conv(F.hex(F.substring(F.col("_bits"), (bit / 8).cast("int") + 1, F.lit(1))),
                  16, 10).cast("int")
    hit = F.getbit(byte.cast("long"), (bit % 8).cast("int")) == 1
    return (df.withColumn("_stretch", F.bitmap_bucket_number(place))
            .join(F.broadcast(sieve), "_stretch", "left")
            .withColumn("_maybe", F.coalesce(hit, F.lit(False)))
            .drop("_stretch", "_bits"))
