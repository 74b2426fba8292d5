"""Sets of whole-number keys as bitmaps over key ranges.

A key set is a frame ``(bucket, bits)``: one row per 32,768 consecutive keys that holds any, one
bit per key. It is built by a partial aggregate, so a table of keys is reduced to bits before
anything is shuffled; sets merge by OR, and their exact sizes add up. Sets pay where keys lie
close together; ``dense`` measures that, and callers take a join of keys where they do not.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mercato.functions.expr import col

KEYS_PER_BUCKET = 32_768
BYTES_PER_BUCKET = KEYS_PER_BUCKET // 8
# A set of at most this many buckets (16 MB, keys within a span of 134 million) is broadcast.
BROADCAST_BUCKETS = 4_096
# A set may take this many bytes per key, as much as a hashed key of a join takes.
BYTES_PER_KEY = 32


def key_set(df: DataFrame, column: str) -> DataFrame:
    """The distinct non-null keys of ``column``."""
    key = F.col(column).cast("long")
    return df.where(key.isNotNull()).groupBy(F.bitmap_bucket_number(key).alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(key)).alias("bits"))


def merged(*sets: DataFrame) -> DataFrame:
    """The union of key sets."""
    rows = sets[0]
    for s in sets[1:]:
        rows = rows.unionByName(s)
    return rows.groupBy("bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def size(keys: DataFrame) -> DataFrame:
    """One row ``n``: how many keys the set holds, exactly."""
    return keys.agg(F.coalesce(F.sum(F.bitmap_count("bits")), F.lit(0)).cast("long").alias("n"))


def dense(df: DataFrame, column: str) -> int | None:
    """The most buckets that a set of ``column`` can have, or None where the set would take more
    than ``BYTES_PER_KEY`` bytes per row: measured by one aggregate over the column."""
    key = F.col(column).cast("long")
    lo, hi, n = df.agg(F.min(key), F.max(key), F.count(key)).first()
    if not n:
        return 1
    buckets = (hi - lo) // KEYS_PER_BUCKET + 3
    small = buckets <= 8  # a few buckets cost nothing, however few their keys
    return buckets if small or buckets * BYTES_PER_BUCKET <= n * BYTES_PER_KEY else None


def with_membership(df: DataFrame, column: str, keys: DataFrame, flag: str, buckets: int | None = None) -> DataFrame:
    """Add ``flag``: whether the row's key is in the set (false for a null key). A set known to
    have at most ``BROADCAST_BUCKETS`` ``buckets`` is broadcast and the rows stay where they are;
    a larger one meets them on the bucket."""
    key = col(column).cast("long")
    named = keys.select(F.col("bucket").alias("_bucket"), F.col("bits").alias("_bits"))
    if buckets is not None and buckets <= BROADCAST_BUCKETS:
        named = F.broadcast(named)
    place = F.bitmap_bit_position(key)
    byte = F.conv(F.hex(F.expr(f"substring(_bits, CAST(bitmap_bit_position(CAST(`{column}` AS BIGINT)) DIV 8 AS INT) + 1, 1)")),
                  16, 10).cast("int")
    held = byte.bitwiseAND(F.pow(F.lit(2), place % 8).cast("int")) != 0
    return (df.join(named, F.bitmap_bucket_number(key) == F.col("_bucket"), "left")
            .withColumn(flag, F.coalesce(held, F.lit(False))).drop("_bucket", "_bits"))
