"""Ranking operators that stay distributed.

* ``top1_per_group`` (N2): the first row per group under (value desc, tie asc), as an
  aggregate of ``min(struct(-value, tie))``. It runs with map-side partial aggregation, so a
  hot group (one customer with a third of all rows) is reduced before the shuffle and no
  window partition ever holds a whole group.
* ``dense_rank_desc`` (N1): a global dense rank without a one-partition window. Distinct
  values are cut into value ranges at approximate quantiles (a bounded list of cut points on
  the driver, found per row by binary search); each range is ranked locally, and a range
  offset (one row per range) is added.
* ``keep_at_least_max`` (G13): ``HAVING agg >= ALL (subquery)`` as a comparison with a scalar
  subquery ``max``.
"""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mercato.operators.heavy import heavy_keys
from mercato.session import kept


def top1_per_group(df: DataFrame, group_cols: list[str], value: str, tie: str,
                   out: str | None = None) -> DataFrame:
    """One row per group: ``tie`` of the row with the largest ``value``; equal values resolve to
    the smallest ``tie``. Returns group columns, ``out`` (default: ``tie``) and ``value``."""
    best = F.min(F.struct((-F.col(value)).alias("k"), F.col(tie).alias("t"))).alias("_best")
    g = df.groupBy(*group_cols).agg(best)
    return g.select(*group_cols, F.col("_best.t").alias(out or tie), (-F.col("_best.k")).alias(value))


def dense_rank_desc(df: DataFrame, value: str, rank: str = "rank", ranges: int | None = None,
                    ascending: bool = False, materialize: bool = True, hot=None) -> DataFrame:
    """Add ``rank`` = 1 + number of distinct ``value``s greater than this row's value
    (smaller, with ``ascending=True``). ``materialize=False`` skips the checkpoint of the
    distinct values when ``df`` is already cheap to read (e.g. itself checkpointed). Rows whose
    value is ``hot`` (a literal that very many rows share) get its rank from one scalar and
    never meet on it in a join."""
    spark = df.sparkSession
    distinct = df.select(value).where(F.col(value).isNotNull()).distinct() \
        .withColumn("_v", F.col(value).cast("double"))
    if materialize:
        # the distinct values are read twice (cut points, ranks): cut from the lineage once
        distinct = kept(distinct)
    n = ranges or _ranges(spark, distinct.count())
    cuts: list[float] = []
    if n > 1:
        cuts = sorted(set(distinct.approxQuantile("_v", [i / n for i in range(1, n)], 1 / (4 * n))))
    # range of a value by binary search over the cut points (JVM-side)
    splits = [-math.inf] + (cuts or [0.0]) + [math.inf]
    ranged = Bucketizer(splits=splits, inputCol="_v", outputCol="_b").transform(distinct)
    b = F.col("_b").cast("int")
    ranged = ranged.withColumn("_range", b if ascending else F.lit(len(splits) - 2) - b).drop("_b")
    sizes = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    # one row per range (bounded by ``ranges``): prefix sums on a tiny frame
    offsets = sizes.select("_range", (F.sum("_n").over(
        Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))).alias("_off"))
    local = ranged.withColumn("_local", F.row_number().over(
        Window.partitionBy("_range").orderBy(F.col(value).asc() if ascending else F.col(value).desc())))
    ranks = local.join(F.broadcast(offsets), "_range").select(
        value, (F.coalesce(F.col("_off"), F.lit(0)) + F.col("_local")).cast("long").alias(rank))
    if hot is None:
        return df.join(ranks, value, "left")
    of_hot = ranks.where(F.col(value) == hot).agg(F.max(rank)).scalar()
    others = df.where(F.col(value).isNull() | (F.col(value) != hot)).join(ranks, value, "left")
    return others.unionByName(df.where(F.col(value) == hot).withColumn(rank, of_hot).select(*others.columns))


def keep_at_least_max(groups: DataFrame, value: str, reference: DataFrame) -> DataFrame:
    """Rows of ``groups`` whose ``value`` is >= every value of the one-column frame ``reference``
    (the ``>= ALL`` rewrite; an empty reference keeps nothing here, which matches the reference's
    result because its outer groups are then empty as well)."""
    ref_max: Column = reference.agg(F.max(reference.columns[0])).scalar()
    return groups.where(F.col(value) >= ref_max)


ROWS_PER_RANGE = 1_000_000


def _ranges(spark, rows: int) -> int:
    """Value ranges for so many rows: one per shuffle partition, more if a range would grow
    beyond ``ROWS_PER_RANGE``."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // ROWS_PER_RANGE))


def positions(df: DataFrame, order_col: str, out: str = "position") -> DataFrame:
    """1-based position of each row by ``order_col`` (ids for new rows: repeatable, unlike
    ``monotonically_increasing_id``), computed without a one-partition window. Rows are numbered
    themselves within value ranges and shifted by the sizes of the ranges before, so rows with
    equal values still get positions of their own. ``order_col`` must not be null. The rows are
    read for the cut points, the sizes and the numbers, so they are computed once (``kept``)."""
    rows = kept(df).withColumn("_v", F.col(order_col).cast("double"))
    n = _ranges(df.sparkSession, rows.count())
    cuts = sorted(set(rows.approxQuantile("_v", [i / n for i in range(1, n)], 1 / (4 * n)))) if n > 1 else []
    splits = [-math.inf] + (cuts or [0.0]) + [math.inf]
    rows = Bucketizer(splits=splits, inputCol="_v", outputCol="_b").transform(rows) \
        .withColumn("_range", F.col("_b").cast("int")).drop("_b")
    # one row per range: prefix sums on a frame of at most ``n`` rows
    before = rows.groupBy("_range").agg(F.count(F.lit(1)).alias("_n")).select(
        "_range", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(
            Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"))
    local = F.row_number().over(Window.partitionBy("_range").orderBy(order_col))
    return rows.withColumn("_local", local).join(F.broadcast(before), "_range") \
        .withColumn(out, (F.col("_off") + F.col("_local")).cast("long")) \
        .drop("_v", "_range", "_local", "_off")


# Requests are ordered by unique whole numbers, so a chunk of this many holds at most as many
# requests of one key.
ORDER_CHUNK = 65_536


# A key is hot with more rows than that and than one of so many half shares of the rows.
SHARES = 1_024


def by_heat(df: DataFrame, key: str, least_rows: int = ORDER_CHUNK) -> tuple[DataFrame, DataFrame | None]:
    """(rows of ordinary keys, rows of hot keys or None where there are none): a window over a whole
    key is fine for the first, the second need two levels. Found by a sketch of the key column."""
    heavy = heavy_keys(df.select(key), SHARES, least_rows)
    if heavy is None:
        return df, None
    few = F.broadcast(heavy)  # fewer than 2 * SHARES rows
    return tuple(df.join(few, key, how).select(*df.columns) for how in ("left_anti", "left_semi"))


def _split(df: DataFrame, key: str, whole, in_levels) -> DataFrame:
    ordinary, hot = by_heat(df, key)
    return whole(ordinary) if hot is None else whole(ordinary).unionByName(in_levels(hot))


def _chunked(df: DataFrame, order: str) -> DataFrame:
    return df.withColumn("_chunk", F.floor(F.col(order) / ORDER_CHUNK))


def _with_carry(rows: DataFrame, carried: DataFrame, key: str) -> DataFrame:
    """Join the chunk table back; rows without a key or an order keep their place too."""
    right = carried.withColumnsRenamed({key: "_key", "_chunk": "_of"})
    return rows.join(right, F.col(key).eqNullSafe(F.col("_key")) & F.col("_chunk").eqNullSafe(F.col("_of"))) \
        .drop("_key", "_of")


def previous_value(df: DataFrame, key: str, value: str, order: str, out: str) -> DataFrame:
    """Add ``out``: ``value`` (not null) of the key's row before this one by ``order`` (a unique
    whole number), null for its first. For a hot key a window runs within chunks of the order only;
    the last values of earlier chunks are carried over, so it never fills one window. Ordinary
    keys take one window each, which shuffles the rows once."""
    return _split(df, key, lambda d: d.withColumn(out, F.lag(value).over(Window.partitionBy(key).orderBy(order))),
                  lambda d: _previous_in_levels(d, key, value, order, out))


def _previous_in_levels(df: DataFrame, key: str, value: str, order: str, out: str) -> DataFrame:
    rows = _chunked(df, order)
    within = Window.partitionBy(key, "_chunk").orderBy(order)
    carried = rows.groupBy(key, "_chunk").agg(F.max_by(value, order).alias("_last")).select(
        key, "_chunk", F.lag("_last").over(Window.partitionBy(key).orderBy("_chunk")).alias("_carry"))
    return (_with_carry(rows.withColumn("_local", F.lag(value).over(within)), carried, key)
            .withColumn(out, F.coalesce("_local", "_carry")).drop("_local", "_carry", "_chunk"))


def previous_and_any(df: DataFrame, key: str, value: str, order: str, out: str, any_out: str) -> DataFrame:
    """``previous_value`` of a boolean, and ``any_out``: whether ``value`` is true in any row of the key
    before this one. Ordinary keys have both from one window."""
    by = Window.partitionBy(key).orderBy(order)
    earlier = by.rowsBetween(Window.unboundedPreceding, -1)
    return _split(df, key, lambda d: d.select("*", F.lag(value).over(by).alias(out), F.coalesce(
                      F.bool_or(value).over(earlier), F.lit(False)).alias(any_out)),
                  lambda d: _any_in_levels(_previous_in_levels(d, key, value, order, out), key, value, order, any_out))


def _any_in_levels(df: DataFrame, key: str, value: str, order: str, out: str) -> DataFrame:
    first = df.where(F.col(value)).groupBy(key).agg(F.min(order).alias("_first"))
    return df.join(first, key, "left").withColumn(
        out, F.coalesce(F.col("_first") < F.col(order), F.lit(False))).drop("_first")


def numbered_within(df: DataFrame, key: str, order: str, out: str) -> DataFrame:
    """Add ``out``: the row's place (from 1) among its key's rows by ``order`` (a unique whole
    number), with the same two levels for hot keys as ``previous_value``."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(order)).cast("long")
    return _split(df, key, lambda d: d.withColumn(out, place), lambda d: _numbered_in_levels(d, key, order, out))


def _numbered_in_levels(df: DataFrame, key: str, order: str, out: str) -> DataFrame:
    rows = _chunked(df, order)
    sizes = rows.groupBy(key, "_chunk").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(key).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(key, "_chunk", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_off"))
    local = F.row_number().over(Window.partitionBy(key, "_chunk").orderBy(order))
    return (_with_carry(rows.withColumn("_local", local), offsets, key)
            .withColumn(out, F.col("_off") + F.col("_local")).drop("_local", "_off", "_chunk"))


def running_total(df: DataFrame, key: str, value: str, order: str, out: str) -> DataFrame:
    """Add ``out``: the sum of ``value`` over the key's rows up to and including this one by
    ``order`` (a whole number), with the same two levels for hot keys as ``previous_value``."""
    upto = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return _split(df, key, lambda d: d.withColumn(out, F.sum(F.col(value).cast("long")).over(upto)),
                  lambda d: _total_in_levels(d, key, value, order, out))


def _total_in_levels(df: DataFrame, key: str, value: str, order: str, out: str) -> DataFrame:
    rows = _chunked(df, order)
    amount = F.col(value).cast("long")
    sums = rows.groupBy(key, "_chunk").agg(F.sum(amount).alias("_sum"))
    earlier = Window.partitionBy(key).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(key, "_chunk", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_off"))
    within = Window.partitionBy(key, "_chunk").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return (_with_carry(rows.withColumn("_local", F.sum(amount).over(within)), offsets, key)
            .withColumn(out, F.col("_off") + F.col("_local")).drop("_local", "_off", "_chunk"))
