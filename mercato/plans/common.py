"""Frames shared by the reports: active orders and the two scopes of a sale line."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mercato.functions.expr import active, line_value
from mercato.sources.adapter import Part

Store = Mapping[str, DataFrame]

LINE_SCOPES = ("all", "active")


def active_orders(store: Store, *cols: str) -> DataFrame:
    o = active(store["orders"])
    return o.select(*cols) if cols else o


def _check_scope(line_scope: str) -> None:
    if line_scope not in LINE_SCOPES:
        raise ValueError(f"line_scope must be one of {LINE_SCOPES}, got {line_scope!r}")


def lines(store: Store, line_scope: str) -> DataFrame:
    """Order lines in a scope: ``'all'`` keeps lines flagged off by checkout or cart removal,
    ``'active'`` keeps only ``is_valid`` lines. Every caller names its scope."""
    _check_scope(line_scope)
    od = store["order_details"]
    return od if line_scope == "all" else active(od)


def by_order(store: Store, line_scope: str, orders: DataFrame,
             fn: Callable[[DataFrame, DataFrame, Callable], DataFrame]) -> DataFrame:
    """``fn(lines, orders, small)`` for lines and a frame of unique ``order_id``s. Where the store
    keeps the lines of heavy orders apart, it is called for those orders and for all others, and
    the results are united: the others read their buckets without an exchange, and the lines of a
    heavy order, which lie in many files, never meet in one task. ``small`` marks a frame of at
    most one row per heavy order (fewer than two per bucket) for broadcasting; it leaves the frames of the
    others as they are."""
    parts = store.parts_of("order_details") if hasattr(store, "parts_of") else [Part(store["order_details"])]
    results = []
    for part in parts:
        li = part.rows if line_scope == "all" else active(part.rows)
        if part.keys is None:
            results.append(fn(li, orders, _as_is))
        elif part.heavy:
            results.append(fn(li, orders.join(F.broadcast(part.keys), "order_id", "left_semi"), F.broadcast))
        else:
            results.append(fn(li, orders.join(F.broadcast(part.keys), "order_id", "left_anti"), _as_is))
    return reduce(DataFrame.unionByName, results)


def _as_is(df: DataFrame) -> DataFrame:
    return df


def order_totals(store: Store, line_scope: str, orders: DataFrame, how: str = "inner") -> DataFrame:
    """``orders`` with the value, quantity and number of their lines. Lines are reduced to one row
    per order before the join (map-side partial sums). ``how='left'`` keeps orders without lines."""
    _check_scope(line_scope)

    def totals(li: DataFrame, o: DataFrame, small: Callable) -> DataFrame:
        per_order = li.groupBy("order_id").agg(
            F.sum(line_value()).alias("order_value"),
            F.sum("quantity").alias("order_qty"),
            F.count(F.lit(1)).alias("order_lines"))
        return o.join(small(per_order), "order_id", how)
    return by_order(store, line_scope, orders, totals)


def customer_product_lines(store: Store, line_scope: str = "all") -> DataFrame:
    """(customer, product) pairs of active orders with line count and quantity: the narrowest
    frame that the per-customer product statistics need. Lines are joined with the two order
    columns they need only; the pair aggregate is partial (map-side) as well."""
    _check_scope(line_scope)
    bought = by_order(store, line_scope, active_orders(store, "order_id", "customer_id"), lambda li, o, small: (
        li.select("order_id", "product_id", "quantity").join(small(o), "order_id")
        .select("customer_id", "product_id", "quantity")))
    return bought.groupBy("customer_id", "product_id").agg(
        F.count(F.lit(1)).alias("n_lines"), F.sum("quantity").alias("qty"))
