"""Values and stock along time, per key, without a window over a whole key.

Rows are cut into chunks of time that hold about equally many rows (``with_chunks``), so a key
with a third of all rows is spread over a third of the chunks. Each operator runs its window inside
(key, chunk) only; one row per (key, chunk) carries what earlier chunks leave.

* ``as_of``: the value that held at each row's time, by a sorted union of rows and changes and the
  last value carried on. No range join. Only hot keys are cut into chunks.
* ``price_history``: validity intervals per product from price changes.
* ``covered``: which requests to take from a stock can be met, in order, when a stock never goes
  below zero and an unmet request takes nothing.
"""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mercato.operators.ranking import by_heat

CHUNK_ROWS = 65_536


def with_chunks(df: DataFrame, ts: str = "ts", rows_per_chunk: int = CHUNK_ROWS, out: str = "_chunk",
                like: DataFrame | None = None) -> DataFrame:
    """Add ``out``: the row's time chunk, numbered in time order. The cut points are approximate
    quantiles of ``ts`` in ``like`` (default: ``df``; a cheaper frame of about the same times), one
    per ``rows_per_chunk`` rows. Rows of one instant share a chunk. ``ts`` may be a number, such as
    the place of a request in its feed."""
    number = isinstance(df.schema[ts].dataType, T.NumericType)
    at = (F.col(ts) if number else F.unix_micros(F.col(ts).cast("timestamp"))).cast("double")
    timed = df.withColumn("_at", at)
    times = timed.select("_at") if like is None else like.select(at.alias("_at"))
    n = -(-times.count() // rows_per_chunk)
    cuts = sorted(set(times.approxQuantile("_at", [i / n for i in range(1, n)], 1 / (4 * n)))) if n > 1 else []
    if not cuts:
        return df.withColumn(out, F.lit(0).cast("long"))
    splits = Bucketizer(splits=[-math.inf, *cuts, math.inf], inputCol="_at", outputCol=out, handleInvalid="keep")
    return splits.transform(timed).withColumn(out, F.col(out).cast("long")).drop("_at")


def _earlier(key: str) -> Window:
    return Window.partitionBy(key).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)


def _carried(rows: DataFrame, chunks: DataFrame, key: str) -> DataFrame:
    right = chunks.withColumnsRenamed({key: "_key", "_chunk": "_of"})
    return rows.join(right, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_chunk") == F.col("_of"))) \
        .drop("_key", "_of")


def as_of(rows: DataFrame, changes: DataFrame, key: str, ts: str, value: str,
          rows_per_chunk: int = CHUNK_ROWS, like: DataFrame | None = None) -> DataFrame:
    """Add ``value`` to ``rows`` (which have ``key`` and ``ts``): that of the key's last row of
    ``changes`` (key, ts, value) at or before ``ts``; null before the first one. Of several
    changes of a key at one instant the one with the largest value counts."""
    columns, is_row = rows.columns, F.col("_is_row")
    others = [c for c in columns if c not in (key, ts)]
    both = changes.select(key, ts, F.col(value).alias("_value"), F.lit(False).alias("_is_row"),
                          *[F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in others]) \
        .unionByName(rows.select(key, ts, F.lit(None).cast(changes.schema[value].dataType).alias("_value"),
                                 F.lit(True).alias("_is_row"), *others))
    # a change counts for the rows of its instant, the largest of several last
    order = F.struct(ts, "_is_row", "_value")

    def carried_on(*by: str):
        w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        return F.last("_value", True).over(w)

    def typed(found: DataFrame, held: Column) -> DataFrame:
        return found.where(is_row).select(*[F.col(c).cast(rows.schema[c].dataType).alias(c) for c in columns],
                                          held.alias(value))
    ordinary, hot = by_heat(both, key, rows_per_chunk)
    out = typed(ordinary.withColumn("_here", carried_on(key)), F.col("_here"))
    if hot is None:
        return out
    hot = with_chunks(hot, ts, rows_per_chunk, like=like)
    told = F.when(~is_row & F.col("_value").isNotNull(), F.struct(ts, "_value"))
    chunks = hot.groupBy(key, "_chunk").agg(F.max_by("_value", told).alias("_last"))
    carry = chunks.select(key, "_chunk", F.last("_last", True).over(_earlier(key)).alias("_carry"))
    found = _carried(hot.withColumn("_here", carried_on(key, "_chunk")), carry, key)
    return out.unionByName(typed(found, F.coalesce("_here", "_carry")))


def price_history(products: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(intervals, rejects). ``changes``: change_id, product_id, ts, price, in the order of (ts,
    change_id). An interval is product_id, valid_from (null: from the start, at the price of
    ``products``), valid_to (null: still valid) and price; repeated equal prices make one.
    Changes without id, product or time, of an unknown product, or to a price that is not above
    zero are rejected; of several at one instant the last change id counts."""
    known = products.select("product_id", F.lit(True).alias("_known"))
    why = F.when(F.col("change_id").isNull(), "W0:missing_change_id") \
        .when(F.col("product_id").isNull(), "W2:missing_key").when(F.col("ts").isNull(), "W2:missing_time") \
        .when(F.col("_known").isNull(), "W2:unknown_key") \
        .when(F.coalesce(F.col("price") <= 0, F.lit(True)), "V6:price:range")
    judged = changes.join(known, "product_id", "left").withColumn("_why", why)
    good = judged.where(F.col("_why").isNull()).groupBy("product_id", "ts").agg(
        F.max_by("price", F.struct("change_id", "price")).alias("price"))
    # a product's own price changes: a dimension's history, kept in one window per product
    start = products.select("product_id", F.lit(None).cast("timestamp").alias("ts"), "price")
    line = start.unionByName(good.select("product_id", F.col("ts").cast("timestamp").alias("ts"),
                                         F.col("price").cast(products.schema["price"].dataType).alias("price")))
    timed = with_chunks(line.withColumn("_ts", F.coalesce("ts", F.timestamp_micros(F.lit(-(2 ** 62))))), "_ts")
    local = Window.partitionBy("product_id", "_chunk").orderBy("_ts")
    before = timed.groupBy("product_id", "_chunk").agg(F.max_by(F.struct("price"), "_ts").alias("_last"))
    carry = before.select("product_id", "_chunk", F.lag("_last").over(
        Window.partitionBy("product_id").orderBy("_chunk")).alias("_carry"))
    steps = _carried(timed.withColumn("_prev", F.lag(F.struct("price")).over(local)), carry, "product_id") \
        .withColumn("_prev", F.coalesce("_prev", "_carry"))
    steps = steps.where(F.col("_prev").isNull() | ~F.col("_prev.price").eqNullSafe(F.col("price"))) \
        .select("product_id", "ts", "_ts", "_chunk", "price")
    after = steps.groupBy("product_id", "_chunk").agg(F.min("_ts").alias("_first"))
    following = after.select("product_id", "_chunk", F.lead("_first").over(
        Window.partitionBy("product_id").orderBy("_chunk")).alias("_next"))
    ends = _carried(steps.withColumn("_end", F.lead("_ts").over(local)), following, "product_id")
    intervals = ends.select("product_id", F.col("ts").alias("valid_from"),
                            F.coalesce("_end", "_next").alias("valid_to"), "price")
    return intervals, judged.where(F.col("_why").isNotNull()).select("change_id", F.col("_why").alias("reason"))


def covered(moves: DataFrame, stock: DataFrame, key: str, order: list[str], quantity: str, ts: str,
            rows_per_chunk: int = CHUNK_ROWS, out: str = "covered", like: DataFrame | None = None) -> DataFrame:
    """Add ``out`` to ``moves``: whether the move takes place. ``quantity`` is signed: restocks are
    positive and always take place; a request takes one unit (-1) and is refused where the stock
    is empty. ``stock`` (key, stock) is what each key starts with (none: 0). Moves of a key are
    judged by ``order``, which begins with ``ts``.

    After moves with running sum P the stock is P + max(start, largest -P at a request so far): the
    maps "add, but not below zero" compose to a sum and a maximum, so a chunk is summed up by two
    numbers, and the chunks are folded like the rows."""
    rows = with_chunks(moves, ts, rows_per_chunk, like=like)
    step, request = F.col(quantity).cast("long"), F.col(quantity) < 0
    inside = Window.partitionBy(key, "_chunk").orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_sum", F.sum(step).over(upto))
    deep = F.when(request, -F.col("_sum"))
    chunks = rows.groupBy(key, "_chunk").agg(F.sum(step).alias("_all"), F.max(deep).alias("_deep")) \
        .withColumn("_off", F.coalesce(F.sum("_all").over(_earlier(key)), F.lit(0)))
    start = stock.select(F.col(key), F.col("stock").cast("long").alias("_start"))
    chunks = chunks.withColumn("_floor", F.max(F.col("_deep") - F.col("_off")).over(_earlier(key))) \
        .join(start, key, "left") \
        .select(key, "_chunk", "_off", F.greatest(F.coalesce("_start", F.lit(0)), "_floor").alias("_floor"))
    found = _carried(rows.withColumn("_low", F.max(deep).over(before)), chunks, key)
    # a request finds a unit where its running sum, with the floor of the requests before it, is
    # not below zero
    left = F.col("_off") + F.col("_sum") + F.greatest("_floor", F.col("_low") - F.col("_off"))
    return found.withColumn(out, ~request | (left >= 0)).drop("_chunk", "_sum", "_low", "_off", "_floor")
