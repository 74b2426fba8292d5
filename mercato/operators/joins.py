"""Join helpers.

No join here forces a broadcast: key sets and dimensions come from callers and may be large,
so the planner decides on measured sizes (``autoBroadcastJoinThreshold`` on statistics, and
AQE on runtime shuffle sizes), and falls back to a sort-merge join beyond the threshold.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lookup(df: DataFrame, keys: DataFrame, on: str | list[str]) -> DataFrame:
    """A5: rows of ``df`` whose key is in ``keys`` (a set of keys, not one) - a left semi join."""
    cols = [on] if isinstance(on, str) else list(on)
    return df.join(keys.select(*cols), cols, "left_semi")


def without(df: DataFrame, keys: DataFrame, on: str | list[str]) -> DataFrame:
    """Rows of ``df`` whose key is not in ``keys`` - a left anti join."""
    cols = [on] if isinstance(on, str) else list(on)
    return df.join(keys.select(*cols), cols, "left_anti")


def left_join_filtered(df: DataFrame, right: DataFrame, on, right_filter=None) -> DataFrame:
    """``LEFT JOIN r ON key AND <condition on r>``: filter the right side first, so rows
    of ``df`` without a match survive."""
    r = right.where(right_filter) if right_filter is not None else right
    return df.join(r, on, "left")
