"""Change feeds derived from the driver's tables (so that their size grows with the data).

Each feed follows a fixed selection rule over a driver table; the rules are test-data
conventions and are repeated, in SQL, by the oracle.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mercato.operators.carts import cart_events
from mercato.session import kept
from mercato.sources.adapter import Store, purchase_order_id

# ---- fixed feed parameters --------------------------------------------------------------------
AS_OF_PURCHASES = _dt.date(1995, 6, 1)
AS_OF_CHECKOUT = _dt.date(2024, 2, 1)
AS_OF_ARCHIVE = _dt.datetime(2024, 2, 1, 12, 0, 0)


def _unknown(key):
    """An id that does not exist: keys are never negative."""
    return -key - 1


def raw_line_feed(store: Store) -> DataFrame:
    """Order lines as they arrive, one per lineitem row, before repeated products are merged."""
    li = store.driver["lineitem"]
    return li.select(F.col("l_orderkey").alias("order_id"), F.col("l_partkey").alias("product_id"),
                     F.col("l_linenumber").alias("line_number"),
                     F.col("l_extendedprice").cast("decimal(10,2)").alias("price"),
                     F.col("l_quantity").cast("int").alias("quantity"))


def product_patches(store: Store) -> DataFrame:
    """W2 feed, four patches for every product: (1) even keys patch the price, odd keys set
    the category to NULL; (2) a later patch of name and price (key % 3 = 0), an empty patch
    (key % 3 = 1) or a price patch (key % 3 = 2); (3) a price patch for an unknown key; (4) a
    patch that sets the price below 0 (even keys) or the name to NULL (odd keys)."""
    p = store.driver["part"]
    k = F.col("p_partkey")
    name = F.concat("p_name", F.lit(" "), "p_brand", F.lit(" "), F.col("p_size").cast("string"))
    price = F.col("p_retailprice").cast("decimal(10,2)")
    cols = ["change_id", "product_id", "set_fields", "product_name", "category", "price"]
    first = p.select((k * 10 + 1).alias("change_id"), k.alias("product_id"),
                     F.when(k % 2 == 0, F.array(F.lit("price"))).otherwise(F.array(F.lit("category"))).alias("set_fields"),
                     F.lit(None).cast("string").alias("product_name"), F.lit(None).cast("string").alias("category"),
                     (price + F.lit(1)).cast("decimal(10,2)").alias("price"))
    second = p.select(
        (k * 10 + 2).alias("change_id"), k.alias("product_id"),
        F.when(k % 3 == 0, F.array(F.lit("product_name"), F.lit("price")))
         .when(k % 3 == 1, F.array().cast("array<string>"))
         .otherwise(F.array(F.lit("price"))).alias("set_fields"),
        F.concat(name, F.lit(" v2")).alias("product_name"), F.lit(None).cast("string").alias("category"),
        (price + F.lit(2)).cast("decimal(10,2)").alias("price"))
    unknown = p.select(
        (k * 10 + 3).alias("change_id"), _unknown(k).alias("product_id"), F.array(F.lit("price")).alias("set_fields"),
        F.lit(None).cast("string").alias("product_name"), F.lit(None).cast("string").alias("category"),
        price.alias("price"))
    refused = p.select(
        (k * 10 + 4).alias("change_id"), k.alias("product_id"),
        F.when(k % 2 == 0, F.array(F.lit("price"))).otherwise(F.array(F.lit("product_name"))).alias("set_fields"),
        F.lit(None).cast("string").alias("product_name"), F.lit(None).cast("string").alias("category"),
        F.lit(-5).cast("decimal(10,2)").alias("price"))
    return first.select(*cols).unionByName(second.select(*cols)).unionByName(unknown.select(*cols)) \
        .unionByName(refused.select(*cols))


def product_flags(store: Store) -> DataFrame:
    """W3 feed, for every product: a deactivation, then a later request that reactivates even
    keys and deactivates odd keys again, a deactivation of an unknown key, and for key % 3 = 0
    one more deactivation."""
    p = store.driver["part"]
    k = F.col("p_partkey")
    off = p.select((k * 10 + 1).alias("change_id"), k.alias("product_id"), F.lit(False).alias("flag"))
    again = p.select((k * 10 + 2).alias("change_id"), k.alias("product_id"), (k % 2 == 0).alias("flag"))
    unknown = p.select((k * 10 + 3).alias("change_id"), _unknown(k).alias("product_id"),
                       F.lit(False).alias("flag"))
    last = p.where(k % 3 == 0).select((k * 10 + 4).alias("change_id"), k.alias("product_id"),
                                      F.lit(False).alias("flag"))
    return off.unionByName(again).unionByName(unknown).unionByName(last)


def product_deletes(store: Store) -> DataFrame:
    """W5 feed: archive every inactive product, and ask for an unknown id per product."""
    p = store["product"]
    k = F.col("product_id")
    return p.where(~F.col("is_valid")).select(k.alias("product_id")).unionByName(
        p.select(_unknown(k).alias("product_id")))


def carts(store: Store) -> DataFrame:
    """W6 feed: the driver's events as cart events."""
    return cart_events(store.driver["events"], store["product"])


def checkout_requests(store: Store) -> DataFrame:
    """W7 feed: every customer asks to check out; key % 6 = 0 leaves the email out; key % 4 = 0
    pays by card, and key % 8 = 4 sends no card fields. Even keys ask a second time, complete
    and in cash."""
    c = store.driver["customer"]
    k = F.col("c_custkey")
    mail = F.concat(F.lit("c"), k.cast("string"), F.lit("@shop.test"))
    first = c.select((k * 10 + 1).alias("change_id"), k.alias("customer_id"), F.col("c_name").alias("name"),
                     F.when(k % 6 == 0, F.lit(None)).otherwise(mail).alias("email"),
                     F.when(k % 4 == 0, F.lit("card")).otherwise(F.lit("cash")).alias("payment_method"),
                     (k % 8 != 4).alias("has_card_fields"))
    second = c.where(k % 2 == 0).select(
        (k * 10 + 2).alias("change_id"), k.alias("customer_id"), F.col("c_name").alias("name"), mail.alias("email"),
        F.lit("cash").alias("payment_method"), F.lit(False).alias("has_card_fields"))
    return first.unionByName(second)


def order_status_updates(store: Store) -> DataFrame:
    """W8 feed, up to four requests per order, by its own employee (key % 60 = 31: by another
    employee): 'Completed' three days after the order date; for key % 3 = 0 'archived' without
    a date; for key % 5 = 0 'completed' a day later without its date; for key % 7 = 0 a blank
    status."""
    o = store.driver["orders"]
    k = F.col("o_orderkey")
    owner = F.col("o_custkey") % 25
    asker = F.when(k % 60 == 31, (owner + 1) % 25).otherwise(owner)

    def ask(number: int, rows: DataFrame, status: str, date=F.lit(None).cast("date")) -> DataFrame:
        return rows.select((k * 10 + number).alias("change_id"), k.alias("order_id"), asker.alias("employee_id"),
                           F.lit(status).alias("status"), date.alias("received_date"))

    return ask(1, o, "Completed", F.date_add(F.to_date("o_orderdate"), 3)) \
        .unionByName(ask(2, o.where(k % 3 == 0), "archived")) \
        .unionByName(ask(3, o.where(k % 5 == 0), "completed")) \
        .unionByName(ask(4, o.where(k % 7 == 0), " "))


def purchase_requests(store: Store) -> tuple[DataFrame, DataFrame]:
    """W9 feed: one request per (order, supplier) of the whole line table, expected 30 days
    after the latest ship date; items are the request's parts."""
    li = store.driver["lineitem"]
    asked = li.groupBy("l_orderkey", "l_suppkey").agg(F.max(F.to_date("l_shipdate")).alias("_last"))
    return _purchase_headers(store, asked), _purchase_items(store)


def _purchase_headers(store: Store, asked: DataFrame) -> DataFrame:
    return asked.select(
        purchase_order_id(store.driver).alias("change_id"), F.col("l_suppkey").alias("supplier_id"),
        (F.col("l_suppkey") % 25).alias("employee_id"), F.date_add("_last", 30).alias("expected_received_date"))


def _purchase_items(store: Store) -> DataFrame:
    items = store.driver["lineitem"].groupBy("l_orderkey", "l_suppkey", "l_partkey").agg(
        F.max(F.col("l_extendedprice").cast("decimal(10,2)")).alias("price"),
        F.sum(F.col("l_quantity").cast("int")).cast("int").alias("quantity"))
    return items.select(purchase_order_id(store.driver).alias("change_id"), F.col("l_partkey").alias("product_id"),
                        "price", "quantity")


def switched_purchases(store: Store) -> tuple[DataFrame, DataFrame, dict[str, DataFrame]]:
    """The W9 feed in one order with W3 feeds: each request is 4 times its old change id; just before
    it its largest part is switched off (every third order) or on, and for orders with key % 8 = 0
    its supplier (off for key % 16 = 0, else on). Requests and switches are projections of one
    grouping, which lies in files."""
    asked = kept(store.driver["lineitem"].groupBy("l_orderkey", "l_suppkey").agg(
        F.max(F.to_date("l_shipdate")).alias("_last"), F.max("l_partkey").alias("product_id")))
    headers, items = _purchase_headers(store, asked), _purchase_items(store)
    four = F.col("change_id") * 4
    asked = asked.withColumn("_at", purchase_order_id(store.driver) * 4)
    order = F.col("l_orderkey")
    products = asked.select((F.col("_at") - 1).alias("change_id"), "product_id", (order % 3 != 0).alias("flag"))
    suppliers = asked.where(order % 8 == 0).select((F.col("_at") - 2).alias("change_id"), F.col("l_suppkey").alias("supplier_id"),
                                                   (order % 16 != 0).alias("flag"))
    return (headers.withColumn("change_id", four), items.withColumn("change_id", four),
            {"product": products, "supplier": suppliers})


def purchase_status_updates(store: Store) -> DataFrame:
    """W10 feed, up to four requests per purchase order, active or not: 'Shipped'; for id % 7 = 0
    'Received' 12 days after the order date; for id % 14 = 0 'Shipped' again; for id % 11 = 0 no
    status, and for id % 13 = 0 a status that does not exist."""
    po = store["purchase_order"]
    k = F.col("purchase_order_id")

    def ask(number: int, rows: DataFrame, status, date=F.lit(None).cast("date")) -> DataFrame:
        return rows.select((k * 10 + number).alias("change_id"), k.alias("purchase_order_id"),
                           F.lit(status).cast("string").alias("status"), date.alias("received_date"))

    return ask(1, po, "Shipped").unionByName(ask(2, po.where(k % 7 == 0), "Received", F.date_add("order_date", 12))) \
        .unionByName(ask(3, po.where(k % 14 == 0), "Shipped")) \
        .unionByName(ask(4, po.where(k % 11 == 0), None)) \
        .unionByName(ask(5, po.where(k % 13 == 0), "Lost"))


def employee_type_changes(store: Store) -> DataFrame:
    """W11 feed: every nation-employee asks twice: first hourly when (key / 4) is odd, else
    contract; then the same again, except key % 9 = 0, which asks to become regular (the later
    request wins)."""
    n = store.driver["nation"]
    k = F.col("n_nationkey").cast("long")
    to_hourly = (F.col("n_nationkey") / 4).cast("int") % 2 == 1
    base = n.select((k * 10 + 1).alias("change_id"), k.alias("employee_id"),
                    F.when(to_hourly, "hourly").otherwise("contract").alias("new_type"),
                    F.when(to_hourly, F.lit(40)).cast("int").alias("hours_worked"),
                    F.when(to_hourly, F.lit(20)).cast("decimal(10,2)").alias("hourly_wages"),
                    F.when(~to_hourly, F.lit(_dt.date(2024, 1, 1))).alias("contract_start_date"),
                    F.when(~to_hourly, F.lit(_dt.date(2024, 12, 31))).alias("contract_end_date"),
                    F.when(~to_hourly, F.lit(50000)).cast("decimal(10,2)").alias("salary"))
    again = base.withColumn("change_id", F.col("change_id") + 1) \
        .withColumn("new_type", F.when(F.col("employee_id") % 9 == 0, F.lit("regular")).otherwise(F.col("new_type")))
    return base.unionByName(again)


def product_creates(store: Store) -> DataFrame:
    """W1 feed: every part is offered as a new product named '<name> new' at 950 below its
    retail price (some prices fall to zero or below); key % 100 = 0 comes without a name,
    key % 50 = 7 comes twice with one change id, and key % 70 = 3 comes again without one."""
    p = store.driver["part"]
    k = F.col("p_partkey")

    def offer(rows: DataFrame, change_id) -> DataFrame:
        return rows.select(
            change_id.cast("long").alias("change_id"),
            F.when(k % 100 == 0, F.lit("")).otherwise(F.concat("p_name", F.lit(" new"))).alias("product_name"),
            F.col("p_type").alias("category"),
            (F.col("p_retailprice") - 950).cast("decimal(10,2)").alias("price"),
            F.col("p_size").alias("stock_quantity"))

    return offer(p, k).unionByName(offer(p.where(k % 50 == 7), k)).unionByName(
        offer(p.where(k % 70 == 3), F.lit(None)))


def employee_creates(store: Store) -> DataFrame:
    """W1 feed for employees, one request per customer row; which fields are missing or wrong
    follows from the key."""
    c = store.driver["customer"]
    k = F.col("c_custkey")
    text = k.cast("string")
    day = lambda y, m, d: F.lit(_dt.date(y, m, d))
    return c.select(
        k.alias("change_id"),
        F.when(k % 20 == 0, "").otherwise(F.col("c_name")).alias("employee_name"),
        F.when(k % 15 == 0, "Astronaut").otherwise("manager").alias("emp_role"),
        F.when(k % 9 == 0, "123").when(k % 9 == 1, "").otherwise(F.lpad(text, 10, "0")).alias("phone_number"),
        F.when(k % 12 == 0, "no mail").otherwise(F.concat(F.lit("e"), text, F.lit("@shop.test"))).alias("email_address"),
        day(2024, 1, 1).alias("hire_date"),
        F.when(k % 14 == 0, F.lit(99)).otherwise(k % 25).cast("long").alias("manager_id"),
        F.when(k % 4 == 0, "Hourly").when(k % 4 == 1, "contract").when(k % 4 == 2, "regular")
         .when(k % 8 == 3, F.lit(None)).otherwise("HOURLY").alias("employee_type"),
        F.when(k % 16 != 0, F.lit(40)).cast("int").alias("hours_worked"),
        F.when(k % 24 == 4, F.lit(0)).otherwise(F.lit(15)).cast("decimal(10,2)").alias("hourly_wages"),
        F.when(k % 40 == 1, F.lit(1)).when(k % 40 == 13, k + 1004).otherwise(k + 1000).cast("long").alias("contract_id"),
        day(2024, 1, 1).alias("contract_start_date"),
        F.when(k % 20 == 5, day(2023, 1, 1)).otherwise(day(2024, 12, 31)).alias("contract_end_date"),
        F.when(k % 28 == 1, F.lit(0)).otherwise(F.lit(50000)).cast("decimal(10,2)").alias("salary"))


def customer_creates(store: Store) -> DataFrame:
    """W1 feed for customers, one request per order: named after the order's key; key % 10 = 0
    has a blank name, key % 9 = 0 no address."""
    o = store.driver["orders"]
    k = F.col("o_orderkey")
    return o.select(k.alias("change_id"),
                    F.when(k % 10 == 0, " ").otherwise(F.concat(F.lit("Buyer "), k.cast("string"))).alias("customer_name"),
                    F.when(k % 9 != 0, F.col("o_orderpriority")).alias("shipping_address"))


def supplier_patches(store: Store) -> DataFrame:
    """W2 feed for suppliers: even keys get an email, odd keys lose their name (refused), and
    key % 5 = 0 sends a later empty patch."""
    s = store.driver["supplier"]
    k = F.col("s_suppkey")
    cols = [F.lit(None).cast("string").alias("supplier_name"),
            F.concat(F.lit("s"), k.cast("string"), F.lit("@shop.test")).alias("email_address")]
    first = s.select((k * 10 + 1).alias("change_id"), k.alias("supplier_id"),
                     F.array(F.when(k % 2 == 0, "email_address").otherwise("supplier_name")).alias("set_fields"), *cols)
    return first.unionByName(s.where(k % 5 == 0).select(
        (k * 10 + 2).alias("change_id"), k.alias("supplier_id"), F.array().cast("array<string>").alias("set_fields"), *cols))


def customer_flags(store: Store) -> DataFrame:
    """W3 feed for customers, up to four requests each: off, off again (customers need only
    exist), for key % 3 = 0 on, and for key % 5 = 0 off for an unknown customer."""
    c = store.driver["customer"]
    k = F.col("c_custkey")

    def ask(number: int, rows: DataFrame, flag: bool, key=k) -> DataFrame:
        return rows.select((k * 10 + number).alias("change_id"), key.alias("customer_id"), F.lit(flag).alias("flag"))

    return ask(1, c, False).unionByName(ask(2, c, False)).unionByName(ask(3, c.where(k % 3 == 0), True)) \
        .unionByName(ask(4, c.where(k % 5 == 0), False, _unknown(k)))


def employee_deactivations(store: Store) -> DataFrame:
    """W4 feed: every nation-employee: key % 5 = 0 is deactivated, the others reactivated."""
    n = store.driver["nation"]
    k = F.col("n_nationkey").cast("long")
    return n.select(k.alias("change_id"), k.alias("employee_id"), (k % 5 != 0).alias("flag"))


def purchase_order_deactivations(store: Store) -> DataFrame:
    """W4 feed, up to three requests per purchase order: a withdrawal (only active, pending ones
    may be), for even ids a reactivation, and for id % 4 = 0 another withdrawal; and for
    id % 9 = 0 a withdrawal of an unknown order."""
    po = store["purchase_order"]
    k = F.col("purchase_order_id")

    def ask(number: int, rows: DataFrame, flag: bool, key=k) -> DataFrame:
        return rows.select((k * 10 + number).alias("change_id"), key.alias("purchase_order_id"),
                           F.lit(flag).alias("flag"))

    return ask(1, po, False).unionByName(ask(2, po.where(k % 2 == 0), True)) \
        .unionByName(ask(3, po.where(k % 4 == 0), False)) \
        .unionByName(ask(4, po.where(k % 9 == 0), False, _unknown(k)))


# ---- feeds with requests that have no place in the order, and a shop that runs out of stock ----
def with_unplaced(feed: DataFrame, key: str, number: int = 1, step: int = 10) -> DataFrame:
    """``feed`` with copies of its requests number ``number`` of a key, which follow from
    (change_id / step) modulo 4: 0 without a change id, 1 two with one change id, 2 without a key.
    Their change ids are the originals' below zero."""
    cid = F.col("change_id")
    first = feed.where((cid % 10 == number) & (cid > 0))
    case = F.floor(cid / step) % 4
    missing = first.where(case == 0).withColumn("change_id", F.lit(None).cast("long"))
    twice = first.where(case == 1).withColumn("change_id", -cid)
    keyless = first.where(case == 2).withColumn("change_id", -cid) \
        .withColumn(key, F.lit(None).cast(feed.schema[key].dataType))
    return feed.unionByName(missing).unionByName(twice).unionByName(twice).unionByName(keyless)


def _busy(store: Store):
    """A fiftieth of the products, which all busy events go to."""
    return store["product"].agg(F.floor(F.max("product_id") / 50) + 1).scalar()


def busy_carts(store: Store) -> DataFrame:
    """W6 feed that empties stocks: the driver's events on a fiftieth of the products. Every
    40th event comes again a second later (the first one counts), and copies of others come
    without id (event id % 41 = 0), time (% 43), customer (% 47), action (% 53) or product
    (% 59, adds), with ids below zero."""
    ev = cart_events(store.driver["events"], store["product"]).withColumn("product_id", F.col("event_id") % _busy(store))
    k = F.col("event_id")
    again = ev.where(k % 40 == 0).withColumn("ts", F.col("ts") + F.expr("INTERVAL 1 SECOND"))

    def without(modulus: int, column: str) -> DataFrame:
        own = ev.where(k % modulus == 0).withColumn("event_id", -k - modulus * 10_000_000_000)
        return own.withColumn(column, F.lit(None).cast(ev.schema[column].dataType))

    return ev.unionByName(again).unionByName(without(41, "event_id")).unionByName(without(43, "ts")) \
        .unionByName(without(47, "customer_id")).unionByName(without(53, "action")) \
        .unionByName(without(59, "product_id").where(F.col("action") == "add"))


def price_changes(store: Store) -> DataFrame:
    """Price patches over time, one per sign-up event whose id is no multiple of 3: the product
    follows from the event id / 3, the price from the id. id % 17 = 0 asks for price 0, id % 19 = 0
    for an unknown product, id % 23 = 0 for none, id % 29 = 0 comes without a time, and id % 5 = 0
    has the time of the hour's start, so that changes meet at one instant."""
    e = store.driver["events"].where("event_type = 'signup' AND event_id % 3 <> 0")
    k = F.col("event_id")
    product = F.floor(k / 3) % _busy(store)
    ts = F.col("ts").cast("timestamp")
    return e.select(
        k.alias("change_id"),
        F.when(k % 23 == 0, None).when(k % 19 == 0, -product - 1).otherwise(product).alias("product_id"),
        F.when(k % 29 == 0, None).when(k % 5 == 0, F.date_trunc("hour", ts)).otherwise(ts).alias("ts"),
        F.when(k % 17 == 0, 0).otherwise(5 + k % 90).cast("decimal(10,2)").alias("price"))


def restocks(store: Store) -> DataFrame:
    """Deliveries over time, one per sign-up event whose id is a multiple of 3: 1 to 5 units."""
    e = store.driver["events"].where("event_type = 'signup' AND event_id % 3 = 0")
    k = F.col("event_id")
    return e.select((F.floor(k / 3) % _busy(store)).alias("product_id"), F.col("ts").cast("timestamp").alias("ts"),
                    (1 + k % 5).cast("int").alias("quantity"))
