"""Cart event fold (W6): add / remove / checkout events -> cart orders, cart lines, stock.

Semantics (taken from the reference's click handlers):

* add: opens a cart if the customer has none; a new line takes the product's current price
  with quantity 1, a repeated add raises the quantity by 1; stock goes down by 1 per add.
  Neither stock nor the product's flag is checked.
* remove: flags the line off; stock is not given back. A remove before the first add of that
  line does nothing. A later add raises the quantity but does not flag the line on again
  (``reactivate_on_add=False``; True flags it on when the add is the line's last event).
* checkout: succeeds when the customer has an open cart, i.e. an add happened since the last
  checkout; the cart becomes 'confirmed' and all its lines are flagged off. The next add opens
  a new cart. A checkout without an open cart changes nothing.

Events are ordered by (ts, event_id). Per-customer running counts are computed in two levels
so that no task holds a whole customer: events are cut into time chunks; a chunk-level
aggregate gives each chunk's totals, a window over the (small) chunk table turns them into
offsets, and a window inside each chunk adds the local part. A customer with a third of all
events is therefore spread over many chunks and tasks.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mercato.functions.expr import text_equals
from mercato.operators.lazy import LazyFrames, once
from mercato.operators.ranking import numbered_within, positions
from mercato.operators.timeline import CHUNK_ROWS, as_of, covered, price_history, with_chunks
from mercato.session import kept

ADD, REMOVE, CHECKOUT = "add", "remove", "checkout"
# an add that the stock does not cover: it opens a cart, but makes no line and takes no stock
OPEN = "open"
# fixed action mapping of the driver's event types onto cart actions
EVENT_ACTIONS = {"click": ADD, "view": ADD, "error": REMOVE, "purchase": CHECKOUT}
CHUNK_SECONDS = 3600


def cart_events(events: DataFrame, products: DataFrame) -> DataFrame:
    """Driver events -> cart events (event_id, ts, customer_id, product_id, action). Sign-ups
    carry no cart action and are dropped; product = event id modulo (largest product id + 1),
    so events reach every product."""
    key_range = products.agg(F.max("product_id") + 1).scalar()
    action = F.when(F.col("event_type").isin("click", "view"), ADD) \
        .when(F.col("event_type") == "error", REMOVE) \
        .when(F.col("event_type") == "purchase", CHECKOUT)
    return events.where(F.col("event_type") != "signup").select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("customer_id"),
        (F.col("event_id") % key_range).alias("product_id"), action.alias("action"))


def _chunk(ts_col: str, seconds: int):
    return F.floor(F.unix_micros(F.col(ts_col)) / F.lit(seconds * 1_000_000)).cast("long")


def usable_events(events: DataFrame, products: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cart events that can be folded, rejects (event_id, reason)). An event that arrives twice
    counts once; where copies of an id differ, the earliest counts (then the smallest customer,
    product and action). Events without id, time, customer or action, and adds and removals
    without product, are rejected. So is an add of an unknown product (the reference looks the
    product up; its flag is not checked): it neither opens a cart nor counts for a checkout."""
    lines = F.col("action").isin(ADD, REMOVE)
    why = F.when(F.col("event_id").isNull(), "W6:missing_event_id").when(F.col("ts").isNull(), "W6:missing_time") \
        .when(F.col("customer_id").isNull(), "W6:missing_customer").when(F.col("action").isNull(), "W6:missing_action") \
        .when(lines & F.col("product_id").isNull(), "W6:missing_product")
    judged = events.select("event_id", "ts", "customer_id", "product_id", "action").withColumn("_why", why)
    rest = F.struct("ts", "customer_id", "product_id", "action")
    once_each = judged.where(F.col("_why").isNull()).groupBy("event_id").agg(F.min(rest).alias("_e")).select("event_id", "_e.*")
    is_add = F.col("action") == ADD
    known = products.select("product_id")
    good = once_each.where(~is_add).unionByName(once_each.where(is_add).join(known, "product_id", "left_semi"))
    unknown = once_each.where(is_add).join(known, "product_id", "left_anti")
    rejects = judged.where(F.col("_why").isNotNull()).select("event_id", F.col("_why").alias("reason")) \
        .unionByName(unknown.select("event_id", F.lit("W6:unknown_product").alias("reason")))
    return good, rejects


def with_cart_numbers(events: DataFrame, chunk_seconds: int = CHUNK_SECONDS,
                      open_carts: DataFrame | None = None) -> DataFrame:
    """Add ``ok_checkout`` (the checkout found an open cart) and ``cart_no`` (successful
    checkouts strictly before the event) to cart events of one or many customers.
    ``open_carts`` (customer_id, n_open): carts that were open before the first event; a
    customer's first ``n_open`` checkouts find one of them, whatever was added."""
    ev = events if "_chunk" in events.columns else events.withColumn("_chunk", _chunk("ts", chunk_seconds))
    ev = ev.withColumn("_seq", F.struct("ts", "event_id"))
    is_checkout = F.col("action") == CHECKOUT
    # previous add/checkout of the customer, and checkouts before: local part inside the chunk ...
    w_local = Window.partitionBy("customer_id", "_chunk").orderBy("ts", "event_id") \
        .rowsBetween(Window.unboundedPreceding, -1)
    ev = ev.withColumn("_prev_local", F.last(F.when(F.col("action") != REMOVE, F.col("action")), True).over(w_local))
    if open_carts is not None:
        ev = ev.withColumn("_place", F.coalesce(F.sum(is_checkout.cast("int")).over(w_local), F.lit(0)))
    # ... and the carried part: last add/checkout and number of checkouts of the earlier chunks
    chunks = ev.groupBy("customer_id", "_chunk").agg(
        F.max_by(F.col("action"), F.when(F.col("action") != REMOVE, F.col("_seq"))).alias("_last_act"),
        F.count_if(is_checkout).alias("_n"))
    w_chunks = Window.partitionBy("customer_id").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = chunks.select("customer_id", "_chunk", F.last("_last_act", True).over(w_chunks).alias("_carry_act"),
                           F.coalesce(F.sum("_n").over(w_chunks), F.lit(0)).alias("_off"))
    if open_carts is not None:
        chunks = chunks.join(open_carts, "customer_id", "left")
    ev = ev.join(chunks, ["customer_id", "_chunk"])
    found = F.coalesce(F.coalesce("_prev_local", "_carry_act").isin(ADD, OPEN), F.lit(False))
    if open_carts is not None:
        # the checkout's place among the customer's checkouts
        found = found | (F.col("_off") + F.col("_place") < F.coalesce("n_open", F.lit(0)))
    ev = ev.withColumn("ok_checkout", is_checkout & found).drop("_place", "n_open", "_off")
    # running count of successful checkouts, exclusive: chunk offsets + local running sum
    okn = F.col("ok_checkout").cast("int")
    ev = ev.withColumn("_ok_local", F.coalesce(F.sum(okn).over(w_local), F.lit(0)))
    per_chunk = ev.groupBy("customer_id", "_chunk").agg(F.sum(okn).alias("_ok_n"))
    per_chunk = per_chunk.withColumn("_ok_off", F.coalesce(F.sum("_ok_n").over(w_chunks), F.lit(0)))
    ev = ev.join(per_chunk.select("customer_id", "_chunk", "_ok_off"), ["customer_id", "_chunk"])
    return ev.withColumn("cart_no", (F.col("_ok_off") + F.col("_ok_local")).cast("long")) \
        .drop("_chunk", "_seq", "_prev_local", "_carry_act", "_ok_local", "_ok_off")


def fold_carts(events: DataFrame, products: DataFrame, reactivate_on_add: bool = False,
               chunk_seconds: int = CHUNK_SECONDS) -> LazyFrames:
    """Batch fold of cart events. Returns ``cart_orders``, ``cart_lines`` and ``stock_moves``
    (each built when read)."""
    events, rejects = usable_events(events, products)
    seq = F.struct("ts", "event_id")
    is_add, is_remove = F.col("action") == ADD, F.col("action") == REMOVE
    known = products.select("product_id", "price")
    line_keys = ["customer_id", "cart_no", "product_id"]

    def numbered_shared() -> DataFrame:
        # the numbered events feed both the line and the cart aggregates: computed once and cut
        # from their lineage with a reliable checkpoint in the shared checkpoint folder
        return kept(with_cart_numbers(events, chunk_seconds))

    shared = once(numbered_shared)
    state: dict[str, bool] = {}

    def carts_of(ev: DataFrame) -> DataFrame:
        carts = ev.groupBy("customer_id", "cart_no").agg(
            F.min(F.when(is_add, F.col("ts"))).alias("opened_at"),
            F.min(F.when(F.col("ok_checkout"), F.col("ts"))).alias("checked_out_at"))
        carts = carts.where(F.col("opened_at").isNotNull())
        return carts.withColumn("status", F.when(F.col("checked_out_at").isNotNull(), "confirmed").otherwise("cart"))

    def cart_lines() -> DataFrame:
        ev = shared()
        state["shared"] = True
        # every line fact in one aggregate (partial before the shuffle): adds, first add, last
        # remove and the last add/remove action
        lines = ev.where(is_add | is_remove).groupBy(*line_keys).agg(
            F.count_if(is_add).cast("int").alias("quantity"),
            F.min(F.when(is_add, seq)).alias("_first_add"),
            F.max(F.when(is_remove, seq)).alias("_last_remove"),
            F.max_by(F.col("action"), seq).alias("_last_action")).where(F.col("quantity") > 0)
        removed_after_add = F.coalesce(F.col("_last_remove") > F.col("_first_add"), F.lit(False))
        line_on = (F.col("_last_action") == ADD) if reactivate_on_add else ~removed_after_add
        lines = lines.join(carts_of(ev).select("customer_id", "cart_no", "status"), ["customer_id", "cart_no"]) \
            .join(known, "product_id")
        return lines.select(*line_keys, "quantity", "price",
                            (line_on & (F.col("status") == "cart")).alias("is_valid"))

    def cart_orders() -> DataFrame:
        # alone, the numbering is read once and needs no checkpoint; after the lines it is reused
        ev = shared() if state.get("shared") else with_cart_numbers(events, chunk_seconds)
        return carts_of(ev).select("customer_id", "cart_no", "opened_at", "checked_out_at", "status")

    def stock_moves() -> DataFrame:
        # each add of a known product takes one unit of stock; no cart numbers are needed
        return events.where(is_add).groupBy("product_id").agg(
            (-F.count(F.lit(1))).cast("long").alias("stock_change"))

    return LazyFrames({"cart_orders": cart_orders, "cart_lines": cart_lines, "stock_moves": stock_moves,
                       "rejects": lambda: rejects})


def fold_carts_into_store(store: Mapping[str, DataFrame], events: DataFrame, rows_per_chunk: int = CHUNK_ROWS,
                          price_changes: DataFrame | None = None, restocks: DataFrame | None = None,
                          check_stock: bool = False) -> LazyFrames:
    """W6 on a store: new versions of ``orders``, ``order_details`` and ``product``, and
    ``rejects`` (event_id, reason).

    A customer's events go to their orders in state 'cart', lowest id first (each checkout moves
    on to the next), and to new orders once these are used up. A line that is there keeps its
    price and gains quantity; a new one takes the price that held when it was added: today's, or
    the one of ``price_changes`` (change_id, product_id, ts, price) as of its first add. A removal
    flags the line off and a checkout all lines of the order. Every add takes one unit of stock.
    Ids of new orders follow the first added event.

    With ``check_stock`` the stock never goes below zero, as the table's CHECK demands: adds are
    met in the order of (ts, event_id) as long as there is stock, with ``restocks`` (product_id,
    ts, quantity) coming in at their time, before the adds of that instant. A refused add is in
    ``rejects``; it still opens a cart, because the reference commits the order before it takes
    the stock. The product table then holds the final stock (with restocks) and, after price
    changes, each product's last price."""
    product = store["product"]  # orders and lines are read for the outputs that need them
    times = events.select("ts").where(F.col("ts").isNotNull())
    events, rejects = usable_events(events, product)
    is_add, is_remove, opens = F.col("action") == ADD, F.col("action") == REMOVE, F.col("action").isin(ADD, OPEN)
    known = product.select("product_id", F.col("price").alias("_today"))
    prices = None
    if price_changes is not None:
        prices, bad_prices = price_history(product, price_changes)
        rejects = rejects.unionByName(bad_prices.select(F.col("change_id").alias("event_id"), "reason"))
    left_over = None
    if check_stock:
        adds = events.where(is_add).withColumn("_q", F.lit(-1).cast("long"))
        moves = adds if restocks is None else adds.unionByName(restocks.join(known, "product_id", "left_semi").select(
            F.lit(-1).cast("long").alias("event_id"), F.col("ts").cast(adds.schema["ts"].dataType).alias("ts"), "product_id",
            F.col("quantity").cast("long").alias("_q")), allowMissingColumns=True)
        moves = moves.withColumn("_second", (F.col("_q") < 0).cast("int"))
        judged = kept(covered(moves, product.select("product_id", F.col("stock_quantity").alias("stock")), "product_id",
                              ["ts", "_second", "event_id"], "_q", "ts", rows_per_chunk, "_met", times))
        refused = judged.where(~F.col("_met"))
        rejects = rejects.unionByName(refused.select("event_id", F.lit("W6:no_stock").alias("reason")))
        taken = judged.where(F.col("_q") < 0).withColumn("action", F.when(F.col("_met"), ADD).otherwise(OPEN))
        events = events.where(~is_add).unionByName(taken.select(*events.columns))
        left_over = judged.where("_met").groupBy("product_id").agg(F.sum("_q").alias("_net"))

    def open_carts() -> DataFrame:
        mine = events.select("customer_id").distinct()
        return store["orders"].where(text_equals("status", "cart")).select("customer_id", "order_id") \
            .join(mine, "customer_id", "left_semi")

    carts = once(open_carts)

    def numbered() -> DataFrame:
        n_open = carts().groupBy("customer_id").agg(F.count(F.lit(1)).alias("n_open"))
        return kept(with_cart_numbers(with_chunks(events, "ts", rows_per_chunk, like=times), open_carts=n_open))

    ev = once(numbered)

    def placed_carts() -> DataFrame:
        """customer_id, cart_no, order_id, is_new, opened_at, checked_out_at of every cart that an
        event touched."""
        seen = ev().groupBy("customer_id", "cart_no").agg(
            F.min(F.when(opens, F.col("ts"))).alias("opened_at"),
            F.min_by("event_id", F.when(opens, F.struct("ts", "event_id"))).alias("_first"),
            F.min(F.when(F.col("ok_checkout"), F.col("ts"))).alias("checked_out_at"))
        old = numbered_within(carts(), "customer_id", "order_id", "_nth").select(
            "customer_id", (F.col("_nth") - 1).alias("cart_no"), F.col("order_id").alias("_old"))
        both = seen.join(old, ["customer_id", "cart_no"], "left")
        top = store["orders"].agg(F.coalesce(F.max("order_id"), F.lit(0))).scalar()
        new = positions(both.where(F.col("_old").isNull() & F.col("opened_at").isNotNull()), "_first", "_pos") \
            .withColumn("order_id", top + F.col("_pos")).drop("_pos")
        known_carts = both.where(F.col("_old").isNotNull()).withColumn("order_id", F.col("_old"))
        return kept(known_carts.unionByName(new).withColumn("is_new", F.col("_old").isNull()).drop("_old", "_first"))

    placed = once(placed_carts)

    def orders() -> DataFrame:
        o = store["orders"]
        done = placed().where(~F.col("is_new") & F.col("checked_out_at").isNotNull()).select(
            "order_id", F.to_date("checked_out_at").alias("_date"))
        old = o.join(done, "order_id", "left") \
            .withColumn("status", F.when(F.col("_date").isNotNull(), "confirmed").otherwise(F.col("status"))) \
            .withColumn("order_date", F.coalesce("_date", "order_date")).select(*o.columns)
        out = F.col("checked_out_at")
        new = placed().where("is_new").select(
            "order_id", "customer_id", F.lit(None).cast("long").alias("employee_id"),
            F.to_date(F.coalesce(out, "opened_at")).alias("order_date"),
            F.lit(None).cast("date").alias("expected_received_date"), F.lit(None).cast("date").alias("actual_received_date"),
            F.when(out.isNotNull(), "confirmed").otherwise("cart").alias("status"), F.lit(True).alias("is_valid"))
        return old.unionByName(new)

    def order_details() -> DataFrame:
        od = store["order_details"]
        seq = F.struct("ts", "event_id")
        touched = ev().where(is_add | is_remove).groupBy("customer_id", "cart_no", "product_id").agg(
            F.count_if(is_add).cast("int").alias("_adds"), F.min(F.when(is_add, seq)).alias("_first_add"),
            F.max(F.when(is_remove, seq)).alias("_last_remove"))
        touched = touched.join(placed().select("customer_id", "cart_no", "order_id"), ["customer_id", "cart_no"]) \
            .drop("customer_id", "cart_no")
        closed = placed().where(F.col("checked_out_at").isNotNull()).select("order_id", F.lit(True).alias("_closed"))
        old = od.join(touched, ["order_id", "product_id"], "left").join(closed, "order_id", "left") \
            .withColumn("quantity", F.col("quantity") + F.coalesce("_adds", F.lit(0))) \
            .withColumn("is_valid", F.col("is_valid") & F.col("_last_remove").isNull() & F.col("_closed").isNull()) \
            .select(*od.columns)
        new = touched.where("_adds > 0").join(od.select("order_id", "product_id"), ["order_id", "product_id"], "left_anti")
        if prices is None:
            new = new.join(known, "product_id")
        else:
            new = as_of(new.withColumn("ts", F.col("_first_add.ts").cast("timestamp")), prices.select(
                "product_id", F.coalesce("valid_from", F.timestamp_micros(F.lit(-(2 ** 62)))).alias("ts"),
                F.col("price").alias("_today")), "product_id", "ts", "_today", rows_per_chunk, times)
        new = new.join(closed, "order_id", "left").select(
            "order_id", "product_id", F.col("_today").alias("price"), F.col("_adds").alias("quantity"),
            (~F.coalesce(F.col("_last_remove") > F.col("_first_add"), F.lit(False))
             & F.col("_closed").isNull()).alias("is_valid"))
        return old.unionByName(new)

    def products() -> DataFrame:
        out = product
        if prices is not None:
            now = prices.where(F.col("valid_to").isNull()).select("product_id", F.col("price").alias("_now"))
            out = out.join(now, "product_id").withColumn("price", F.col("_now")).select(*product.columns)
        moves = left_over if left_over is not None else events.where(is_add).groupBy("product_id").agg(
            (-F.count(F.lit(1))).alias("_net"))
        # without check_stock a stock may leave its column; it then stays at the column's end
        stock = F.col("stock_quantity") + F.coalesce("_net", F.lit(0))
        return out.join(moves, "product_id", "left").withColumn(
            "stock_quantity", F.greatest(F.least(stock, F.lit(2 ** 31 - 1)), F.lit(-(2 ** 31))).cast("int")) \
            .select(*product.columns)

    return LazyFrames({"orders": orders, "order_details": order_details, "product": products,
                       "rejects": lambda: rejects})
