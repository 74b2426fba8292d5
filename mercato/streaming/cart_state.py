"""The cart stream on a store, with all state kept by Spark.

``readStream`` of cart events, price changes and deliveries -> two chained ``transformWithState``
operators over a RocksDB state store:

1. per product: stock and today's price. Rows wait until the watermark has passed them and are
   then judged in the order of time: a price change sets the price, a delivery raises the stock,
   an add takes one unit and the price of its moment, or is refused where the stock is empty. A
   customer's checkouts wait in the same way under a key of their own.
2. per customer: the open carts, which begin as the store's orders in state 'cart', and their
   lines. It gets whole slices of time, so it sorts each slice and applies it.

Both start from the store (initial state). The result is what ``fold_carts_into_store`` makes of
all events at once with ``check_stock``, however they are split into batches, as long as no event
comes later than ``delay`` behind the newest one: such an event is a reject. A batch reads its own
rows and the state of their keys; history is neither read nor listed. Every batch writes the rows
that it changed to a folder of its own, so a repeated batch replaces itself; ``current`` takes the
last version of each row.

One key is worked on by one task, and a slice of a customer is sorted in memory: slices are bounded
by what a trigger reads (``max_files_per_trigger``). Copies of an event count once within a slice of
time; a later copy comes late and is a reject, unless it carries another time.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from mercato.functions.expr import text_equals
from mercato.operators.carts import ADD, CHECKOUT, OPEN, REMOVE
from mercato.session import shared_dir

PRICE, RESTOCK = "price", "restock"
#: Rows of the stream: events (action add, remove, checkout), price changes and deliveries.
STREAM_SCHEMA = ("event_id long, ts timestamp, customer_id long, product_id long, action string, "
                 "price decimal(10,2), quantity int")
SLICE_MS = 60_000
_FIRST = {PRICE: 0, RESTOCK: 1}
_WAITING = "event_id long, micros long, customer_id long, product_id long, action string, amount long"
_JUDGED = ("place long, kind string, event_id long, micros long, customer_id long, product_id long, action string, "
           "cents long, stock long, reason string")
_CHANGED = ("kind string, customer_id long, cart_no long, order_id long, product_id long, quantity long, cents long, "
            "is_valid boolean, opened_at long, checked_out_at long, stock long, event_id long, reason string")
_JUDGED_NAMES = [c.split()[0] for c in _JUDGED.split(", ")]
_CHANGED_NAMES = [c.split()[0] for c in _CHANGED.split(", ")]
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _table(rows: list[dict], names: list[str]) -> pd.DataFrame:
    out = pd.DataFrame({n: pd.Series([r.get(n) for r in rows], dtype=object) for n in names})
    for n in names:
        if n not in ("kind", "action", "reason", "is_valid"):
            out[n] = out[n].astype("Int64")
        elif n == "is_valid":
            out[n] = out[n].astype("boolean")
    return out


def _cut(timer_values) -> int:
    """Everything before this time (ms) is judged in this batch."""
    return max(timer_values.getCurrentWatermarkInMs(), 0) // SLICE_MS * SLICE_MS


class Shelf(StatefulProcessor):
    """Stock and price of one product (or, below zero, the checkouts of one customer)."""

    def init(self, handle) -> None:
        self.handle = handle
        self.item = handle.getValueState("item", "stock long, cents long")
        self.waiting = handle.getListState("waiting", _WAITING)

    def handleInitialState(self, key, initialState, timerValues) -> None:
        row = initialState.iloc[0]
        self.item.update((int(row.stock), int(row.cents)))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        cut, out, held, timers = _cut(timerValues), [], [], set()
        for batch in rows:
            for r in batch.to_dict("records"):
                r = {n: None if pd.isna(v) else v for n, v in r.items()}
                reason = r["reason"] or ("W6:late" if r["micros"] // 1000 < cut else None)
                if reason:
                    out.append({"place": -1, "kind": "reject", "event_id": r["event_id"], "reason": reason})
                    continue
                whole = [r[n] for n in ("event_id", "micros", "customer_id", "product_id")]
                held.append((*[None if v is None else int(v) for v in whole], r["action"],
                             None if r["amount"] is None else int(r["amount"])))
                timers.add((r["micros"] // 1000 // SLICE_MS + 1) * SLICE_MS)
        if held:
            self.waiting.appendList(held)
        for at in timers:
            self.handle.registerTimer(int(at))
        yield _table(out, _JUDGED_NAMES)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        cut = _cut(timerValues)
        rows = [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []
        due = [r for r in rows if r[1] // 1000 < cut]
        if not due:  # an earlier timer of this batch has judged them
            return
        later = [r for r in rows if r[1] // 1000 >= cut]
        if later:
            self.waiting.put(later)
        else:
            self.waiting.clear()
        item = self.item.get() if self.item.exists() else None
        stock, cents = (item[0], item[1]) if item else (None, None)
        out, seen = [], set()
        for event_id, micros, customer, product, action, amount in sorted(
                due, key=lambda r: (r[1], _FIRST.get(r[4], 2), r[0] if r[0] is not None else -1)):
            changes = action in (PRICE, RESTOCK)
            if not changes and event_id in seen:
                continue
            if not changes:
                seen.add(event_id)
            event = {"place": customer, "kind": "event", "event_id": event_id, "micros": micros,
                     "customer_id": customer, "product_id": product, "action": action}
            if action in (ADD, PRICE, RESTOCK) and item is None:
                reason = "W2:unknown_key" if changes else "W6:unknown_product"
                out.append({"place": -1, "kind": "reject", "event_id": event_id, "reason": reason})
            elif action == PRICE:
                cents = amount
            elif action == RESTOCK:
                stock += amount
            elif action == ADD and stock == 0:
                out.append({**event, "action": OPEN})
                out.append({"place": -1, "kind": "reject", "event_id": event_id, "reason": "W6:no_stock"})
            elif action == ADD:
                stock -= 1
                out.append({**event, "cents": cents})
            else:
                out.append(event)
        if item is not None:
            self.item.update((stock, cents))
            out.append({"place": -1, "kind": "item", "product_id": key[0], "stock": stock, "cents": cents})
        yield _table(out, _JUDGED_NAMES)

    def close(self) -> None:
        pass


class Basket(StatefulProcessor):
    """The open carts of one customer: the store's orders in state 'cart', lowest id first, then
    new ones. Cart numbers count a customer's carts from 0."""

    def init(self, handle) -> None:
        self.carts = handle.getValueState("carts", "cart_no long, open boolean, opened_at long")
        self.orders = handle.getMapState("orders", "cart_no long", "order_id long")
        self.lines = handle.getMapState("lines", "cart_no long, product_id long",
                                        "quantity long, cents long, is_valid boolean")

    def handleInitialState(self, key, initialState, timerValues) -> None:
        orders = sorted(int(x) for x in initialState["order_id"].unique())
        number = {order: i for i, order in enumerate(orders)}
        for order, i in number.items():
            self.orders.updateValue((i,), (order,))
        for r in initialState.to_dict("records"):
            if not pd.isna(r["product_id"]):
                self.lines.updateValue((number[int(r["order_id"])], int(r["product_id"])),
                                       (int(r["quantity"]), int(r["cents"]), bool(r["is_valid"])))

    def _order(self, cart: int) -> int | None:
        return self.orders.getValue((cart,))[0] if self.orders.containsKey((cart,)) else None

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        everything = pd.concat(list(rows))
        if key[0] < 0:  # rejects and items pass
            passed = everything.to_dict("records")
            yield _table([{n: None if pd.isna(r.get(n)) else r.get(n) for n in _CHANGED_NAMES} for r in passed],
                         _CHANGED_NAMES)
            return
        held = self.carts.get() if self.carts.exists() else None
        cart, opened, opened_at = (held[0], held[1], held[2]) if held else (0, False, None)
        carts: dict[int, dict] = {}
        lines: dict[tuple[int, int], tuple] = {}

        def line(product: int) -> tuple | None:
            at = (cart, product)
            if at not in lines and self.lines.containsKey(at):
                lines[at] = tuple(self.lines.getValue(at))
            return lines.get(at)

        touched: set[tuple[int, int]] = set()
        for r in everything.sort_values(["micros", "event_id"]).to_dict("records"):
            micros, action = int(r["micros"]), r["action"]
            exists = opened or self._order(cart) is not None
            if action in (ADD, OPEN):
                if not opened:
                    opened, opened_at = True, micros
                if self._order(cart) is None:
                    carts.setdefault(cart, {})
                if action == ADD:
                    product = int(r["product_id"])
                    old = line(product)
                    lines[cart, product] = (old[0] + 1, old[1], old[2]) if old else (1, int(r["cents"]), True)
                    touched.add((cart, product))
            elif action == REMOVE:
                product = int(r["product_id"])
                old = line(product)
                if old:
                    lines[cart, product] = (old[0], old[1], False)
                    touched.add((cart, product))
            elif action == CHECKOUT and exists:
                of_cart = {at for at in lines if at[0] == cart} | {
                    tuple(k) for k in self.lines.keys() if k[0] == cart}
                for at in of_cart:
                    old = lines[at] if at in lines else tuple(self.lines.getValue(at))
                    lines[at] = (old[0], old[1], False)
                    touched.add(at)
                carts[cart] = {"opened_at": opened_at, "checked_out_at": micros}
                cart, opened, opened_at = cart + 1, False, None
        if opened and cart in carts:
            carts[cart] = {"opened_at": opened_at}
        self.carts.update((cart, opened, opened_at))
        out = [{"kind": "line", "customer_id": key[0], "cart_no": c, "order_id": self._order(c), "product_id": p,
                "quantity": lines[c, p][0], "cents": lines[c, p][1], "is_valid": lines[c, p][2]}
               for c, p in sorted(touched)]
        out += [{"kind": "order", "customer_id": key[0], "cart_no": c, "order_id": self._order(c), **facts}
                for c, facts in carts.items()]
        for at in touched:
            if at[0] >= cart:
                self.lines.updateValue(at, lines[at])
        for c in carts:  # a cart that is checked out needs no state
            if c < cart:
                for at in [tuple(k) for k in self.lines.keys() if k[0] == c]:
                    self.lines.removeKey(at)
        yield _table(out, _CHANGED_NAMES)

    def close(self) -> None:
        pass


def _routed(stream: DataFrame, delay: str) -> DataFrame:
    """Key, order and reject reason of every row. The watermark runs on a column of its own, so
    that Spark drops no late row before it is made a reject."""
    action, change = F.col("action"), F.col("action").isin(PRICE, RESTOCK)
    why = F.when(F.col("event_id").isNull() & ~F.coalesce(action == RESTOCK, F.lit(False)), "W6:missing_event_id") \
        .when(F.col("ts").isNull(), "W6:missing_time") \
        .when(action.isNull() | ~action.isin(ADD, REMOVE, CHECKOUT, PRICE, RESTOCK), "W6:missing_action") \
        .when(F.col("customer_id").isNull() & ~change, "W6:missing_customer") \
        .when(F.col("product_id").isNull() & (action != CHECKOUT), "W6:missing_product") \
        .when((action == PRICE) & F.coalesce(F.col("price") <= 0, F.lit(True)), "V6:price:range") \
        .when((action == RESTOCK) & F.coalesce(F.col("quantity") <= 0, F.lit(True)), "V6:quantity:range")
    amount = F.when(action == PRICE, (F.col("price") * 100).cast("long")).when(action == RESTOCK, F.col("quantity").cast("long"))
    place = F.when(why.isNotNull(), F.lit(-1)).when(action == CHECKOUT, -F.col("customer_id") - 2) \
        .otherwise(F.col("product_id")).cast("long")
    return (stream.withColumn("clock", F.coalesce("ts", F.timestamp_micros(F.lit(0)))).withWatermark("clock", delay)
            .select(place.alias("product"), "event_id", F.unix_micros("ts").alias("micros"), "customer_id", "product_id",
                    "action", amount.alias("amount"), why.alias("reason")))


def start_store_stream(spark: SparkSession, stream: DataFrame, store, state_dir: str | None = None,
                       delay: str = "10 minutes", processing_time: str | None = None) -> tuple[StreamingQuery, str]:
    """Start the stream over ``stream`` (a streaming frame of STREAM_SCHEMA) on ``store`` (orders,
    order_details, product). Returns the query and the folder with ``changes`` and ``_checkpoint``.
    Without ``processing_time`` it works through what is there and ends."""
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass", None) != ROCKSDB:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    state_dir = state_dir or f"{shared_dir(spark)}/cart_store_state"
    cents = (F.col("price") * 100).cast("long").alias("cents")
    items = store["product"].select(F.col("product_id").alias("product"),
                                    F.col("stock_quantity").cast("long").alias("stock"), cents)
    carts = store["orders"].where(text_equals("status", "cart")).select("customer_id", "order_id") \
        .join(store["order_details"], "order_id", "left") \
        .select(F.col("customer_id").alias("place"), "order_id", "product_id", F.col("quantity").cast("long").alias("quantity"),
                cents, "is_valid")
    judged = _routed(stream, delay).groupBy("product").transformWithStateInPandas(
        Shelf(), _JUDGED, "Append", "EventTime", initialState=items.groupBy("product"))
    changed = judged.groupBy("place").transformWithStateInPandas(
        Basket(), _CHANGED, "Append", "None", initialState=carts.groupBy("place"))

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{state_dir}/changes/batch_id={batch_id}")

    writer = changed.writeStream.foreachBatch(write).outputMode("append") \
        .option("checkpointLocation", f"{state_dir}/_checkpoint")
    writer = writer.trigger(processingTime=processing_time) if processing_time else writer.trigger(availableNow=True)
    return writer.start(), state_dir


def current(spark: SparkSession, state_dir: str, kind: str) -> DataFrame:
    """The last version of every changed row: kind 'line' (customer_id, cart_no, order_id,
    product_id, quantity, price, is_valid), 'order' (customer_id, cart_no, order_id, opened_at,
    checked_out_at), 'item' (product_id, stock, price), or all rows of kind 'reject'."""
    rows = spark.read.schema(_CHANGED + ", batch_id long").parquet(f"{state_dir}/changes").where(F.col("kind") == kind)
    if kind == "reject":
        return rows.select("event_id", "reason")
    price = (F.col("cents") / 100).cast("decimal(10,2)").alias("price")
    keys, values = {
        "line": (["customer_id", "cart_no", "product_id"], ["order_id", "quantity", price, "is_valid"]),
        "order": (["customer_id", "cart_no"], ["order_id", *[F.timestamp_micros(c).alias(c) for c in
                                                             ("opened_at", "checked_out_at")]]),
        "item": (["product_id"], ["stock", price])}[kind]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch_id").alias("_v"))
    return last.select(*keys, "_v.*")
