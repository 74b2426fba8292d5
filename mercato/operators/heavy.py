"""Keys that hold very many rows, found by a mergeable frequency sketch.

``approx_top_k`` keeps a frequent-items sketch per task and merges the sketches, so the rows are
read once, one column wide, and nothing but the sketch is shuffled. What is found decides the
layout of a table only, never an answer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A key is heavy with more rows than half a file's share, and never with fewer than this.
HEAVY_ROWS = 1_000
# Items a sketch tracks per file; its error is below a quarter of a file's share.
TRACKED_PER_FILE = 16
TRACKED_MOST = 1_000_000
# Most keys that the sketch function returns.
RETURNED_MOST = 100_000


def heavy_keys(keys: DataFrame, files: int, least_rows: int = HEAVY_ROWS) -> DataFrame | None:
    """The values of the one-column frame ``keys`` that hold more than half of one of ``files``
    equal shares of its rows, and at least ``least_rows``: fewer than ``2 * files`` rows, or None
    where there are none. Counts are the sketch's estimates. Nulls are never heavy. Beyond 62,500
    files the sketch tracks a million items and only finds keys of a larger share."""
    (name,) = keys.columns
    tracked = min(TRACKED_MOST, max(1024, TRACKED_PER_FILE * files))
    most = min(RETURNED_MOST, tracked, 2 * files)
    found = keys.where(F.col(name).isNotNull()).agg(
        F.count(F.lit(1)).alias("rows"), F.expr(f"approx_top_k(`{name}`, {most}, {tracked})").alias("top"))
    share = F.greatest(F.lit(least_rows), F.col("rows") / (2 * files))
    heavy = found.select(F.explode("top").alias("t"), share.alias("share")) \
        .where(F.col("t.count") >= F.col("share")).select(F.col("t.item").alias(name))
    values = [r[0] for r in heavy.collect()]  # bounded by ``most``
    if not values:
        return None
    return keys.sparkSession.createDataFrame([(v,) for v in values], heavy.schema)
