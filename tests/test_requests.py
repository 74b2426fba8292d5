"""Every request is applied or rejected; values along time and stock against replays."""

import datetime as dt
import random
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from mercato.operators import changes as W
from mercato.operators.carts import ADD, REMOVE, CHECKOUT, fold_carts, fold_carts_into_store
from mercato.operators.timeline import as_of, covered, price_history
from mercato.plans import feeds
from mercato.sources.adapter import store_from_driver
from mercato.sources.schemas import SCHEMAS

DAY = dt.date(2024, 1, 1)
SMALL = "/root/testdata/sf0.001"


def frames(spark, **tables):
    return {t: spark.createDataFrame(rows, SCHEMAS[t]) for t, rows in tables.items()}


def product(i, stock=10, valid=True, price="10.00"):
    return (i, f"p{i}", "c", D(price), valid, stock, None)


def purchase_order(i, valid=True, received=None, status="pending"):
    return (i, 1, 1, DAY, DAY, received, status, valid)


@pytest.mark.parametrize("job, feed, key, number, step, tables", [
    (lambda st, f: W.patch_rows(st, "product", f), feeds.product_patches, "product_id", 1, 10, ["product"]),
    (lambda st, f: W.set_active(st, "product", f), feeds.product_flags, "product_id", 1, 10, ["product"]),
    (lambda st, f: W.deactivate_employees(st, f),
     lambda st: feeds.employee_deactivations(st).withColumn("change_id", F.col("change_id") * 10 + 1), "employee_id", 1, 10,
     ["employee", "hourly_employee", "contract_employee"]),
    (lambda st, f: W.set_purchase_order_active(st, f), feeds.purchase_order_deactivations, "purchase_order_id", 1, 10,
     ["purchase_order", "purchase_order_details"]),
    (lambda st, f: W.checkout_carts(st, f, DAY), feeds.checkout_requests, "customer_id", 2, 20,
     ["orders", "payment"]),
    (lambda st, f: W.set_order_status(st, f), feeds.order_status_updates, "order_id", 1, 10, ["orders"]),
    (lambda st, f: W.set_purchase_status(st, f, "receive"), feeds.purchase_status_updates, "purchase_order_id", 1, 10,
     ["purchase_order"]),
    (lambda st, f: W.change_employee_type(st, f), feeds.employee_type_changes, "employee_id", 1, 10,
     ["contract", "contract_employee"])])
def test_unplaced_requests_are_rejected_and_change_nothing(spark, job, feed, key, number, step, tables):
    st = store_from_driver(spark, SMALL)
    clean = feed(st)
    hard = feeds.with_unplaced(clean, key, number, step)
    planted = hard.count() - clean.count()
    assert planted > 0
    before, after = job(st, clean), job(st, hard)
    extra = after["rejects"].exceptAll(before["rejects"])
    assert extra.count() >= planted  # a request may break several rules
    assert before["rejects"].exceptAll(after["rejects"]).isEmpty()
    for t in tables:
        assert before[t].exceptAll(after[t]).isEmpty() and after[t].exceptAll(before[t]).isEmpty(), t


def test_applied_and_rejected_flags_add_up(spark):
    st = frames(spark, product=[product(i, valid=i != 3) for i in range(5)])
    rows = [(1, 0, False), (2, 3, False), (3, 9, True), (None, 1, True), (4, None, True), (5, 1, None),
            (6, 2, False), (6, 2, True), (None, None, None), (7, 4, False)]
    out = W.set_active(st, "product", spark.createDataFrame(rows, "change_id long, product_id long, flag boolean"))
    got = sorted((r.change_id is None, r.change_id or 0, r.reason) for r in out["rejects"].collect())
    assert got == [(False, 2, "W3:state_guard"), (False, 3, "W3:unknown_key"), (False, 4, "W3:missing_key"),
                   (False, 5, "W3:missing_flag"), (False, 6, "W0:duplicate_change_id"),
                   (False, 6, "W0:duplicate_change_id"), (True, 0, "W0:missing_change_id"),
                   (True, 0, "W0:missing_change_id")]
    assert {r.product_id: r.is_valid for r in out["product"].collect()} == {
        0: False, 1: True, 2: True, 3: False, 4: False}


def test_order_received_twice_moves_stock_once(spark):
    st = frames(spark, product=[product(1)], purchase_order=[purchase_order(1)],
                purchase_order_details=[(1, 1, D("2.00"), 7, True)])

    def received(change, day):
        return spark.createDataFrame([(change, 1, "Received", day)],
                                     "change_id long, purchase_order_id long, status string, received_date date")

    first = W.set_purchase_status(st, received(1, DAY), "receive")
    then = W.set_purchase_status({**st, "product": first["product"], "purchase_order": first["purchase_order"]},
                                 received(2, dt.date(2024, 2, 2)), "receive")
    both = W.set_purchase_status(st, received(1, DAY).unionByName(received(2, dt.date(2024, 2, 2))), "receive")
    assert then["product"].collect() == both["product"].collect()
    row = then["product"].first()
    assert (row.stock_quantity, row.stock_arrival_date) == (17, dt.date(2024, 2, 2))
    assert then["purchase_order"].collect() == both["purchase_order"].collect()


def test_stock_beyond_its_column_is_a_reject(spark):
    big = 2 ** 31 - 1
    st = frames(spark, product=[product(1, 10), product(2, 10)], supplier=[(1, "s", None, None, True)],
                purchase_order=[purchase_order(5), purchase_order(6)],
                purchase_order_details=[(5, 1, D("2.00"), big, True), (6, 2, D("2.00"), 4, True)])
    requests = spark.createDataFrame([(i, 1, 1, dt.date(2025, 1, 1)) for i in (1, 2, 3)],
                                     "change_id long, supplier_id long, employee_id long, expected_received_date date")
    items = spark.createDataFrame([(1, 1, 3), (2, 1, big), (2, 2, 1), (3, 2, 5)],
                                  "change_id long, product_id long, quantity int").withColumn("price", F.lit(D("1.00")))
    out = W.create_purchase_orders(st, requests, items, DAY)
    assert [tuple(r) for r in out["rejects"].collect()] == [(2, "W9:stock_out_of_range")]
    assert {r.product_id: r.stock_quantity for r in out["product"].collect()} == {1: 13, 2: 15}
    assert out["new_lines"].count() == 2
    feed = spark.createDataFrame([(1, 5, "Received", DAY), (2, 6, "Received", DAY), (3, 5, "Shipped", None)],
                                 "change_id long, purchase_order_id long, status string, received_date date")
    out = W.set_purchase_status(st, feed, "receive")
    assert [tuple(r) for r in out["rejects"].collect()] == [(1, "W10:stock_out_of_range")]
    assert {r.product_id: r.stock_quantity for r in out["product"].collect()} == {1: 10, 2: 14}
    assert {r.purchase_order_id: r.delivery_status for r in out["purchase_order"].collect()} == {5: "Shipped", 6: "Received"}


def test_full_order_counter_is_a_reject(spark):
    st = frames(spark, customer=[(1, "a", None, None, None, "x", 2 ** 31 - 2, True)],
                orders=[(i, 1, None, DAY, None, None, "cart", True) for i in (1, 2)],
                order_details=[(1, 1, D("2.00"), 1, True)], invoice=[], payment=[])
    feed = spark.createDataFrame([(i, 1, "a", "a@b.c", "cash", False) for i in (1, 2)],
                                 "change_id long, customer_id long, name string, email string, payment_method string, "
                                 "has_card_fields boolean")
    out = W.checkout_carts(st, feed, DAY)
    assert [tuple(r) for r in out["rejects"].collect()] == [(2, "W7:order_count_out_of_range")]
    assert out["customer"].first().order_count == 2 ** 31 - 1
    assert {r.order_id: r.status for r in out["orders"].collect()} == {1: "confirmed", 2: "cart"}


def test_every_type_change_takes_effect(spark):
    st = frames(spark, employee=[(1, "e", "manager", None, None, None, None, True)],
                hourly_employee=[(1, 9, D("9.00"), True)], contract=[(4, DAY, DAY, D("1.00"), True)], contract_employee=[])
    schema = ("change_id long, employee_id long, new_type string, hours_worked int, hourly_wages decimal(10,2), "
              "contract_start_date date, contract_end_date date, salary decimal(10,2)")
    end = dt.date(2025, 1, 1)
    rows = [(1, 1, "hourly", 10, D("5.00"), None, None, None), (2, 1, "contract", None, None, DAY, end, D("7.00")),
            (3, 1, "Contract", None, None, DAY, end, D("8.00")), (4, 1, "hourly", 20, D("6.00"), None, None, None),
            (5, None, "regular", None, None, None, None, None)]
    out = W.change_employee_type(st, spark.createDataFrame(rows, schema))
    assert [tuple(r) for r in out["hourly_employee"].collect()] == [(1, 20, D("6.00"), True)]
    assert sorted((r.contract_id, r.salary) for r in out["contract"].collect()) == [
        (4, D("1.00")), (5, D("7.00")), (6, D("8.00"))]
    assert [tuple(r) for r in out["contract_employee"].collect()] == [(1, 6, False)]
    assert [tuple(r) for r in out["rejects"].collect()] == [(5, "W11:unknown_employee")]


# ---- along time ----
T0 = dt.datetime(2024, 1, 1)


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


@pytest.mark.parametrize("rows_per_chunk", [7, 10_000])
def test_as_of_equals_search(spark, rows_per_chunk):
    rng = random.Random(1)
    changes = [(rng.choice([1, 1, 1, 2, 3]), at(rng.randrange(300)), rng.randrange(1000)) for _ in range(120)]
    rows = [(i, rng.choice([1, 1, 1, 2, 3, 4]), at(rng.randrange(300)), "x") for i in range(300)]
    got = as_of(spark.createDataFrame(rows, "id long, k long, ts timestamp, extra string"),
                spark.createDataFrame(changes, "k long, ts timestamp, v int"), "k", "ts", "v", rows_per_chunk)
    assert got.columns == ["id", "k", "ts", "extra", "v"]
    want = {i: max(((t, v) for c, t, v in changes if c == k and t <= ts), default=(0, None))[1] for i, k, ts, _ in rows}
    assert {r.id: r.v for r in got.collect()} == want


def test_as_of_of_empty_tables(spark):
    rows = spark.createDataFrame([(1, 1, T0)], "id long, k long, ts timestamp")
    none = spark.createDataFrame([], "k long, ts timestamp, v int")
    assert [tuple(r) for r in as_of(rows, none, "k", "ts", "v").collect()] == [(1, 1, T0, None)]
    assert as_of(rows.limit(0), none, "k", "ts", "v").count() == 0


def test_price_history_and_its_rejects(spark):
    st = frames(spark, product=[product(1), product(2)])
    rows = [(1, 1, at(5), D("11.00")), (2, 1, at(9), D("11.00")), (3, 1, at(20), D("12.00")), (4, 1, at(20), D("13.00")),
            (5, 1, at(30), D("0.00")), (6, 9, at(1), D("1.00")), (7, None, at(1), D("1.00")), (8, 1, None, D("1.00")),
            (None, 1, at(1), D("1.00")), (9, 2, at(2), None)]
    got, rejects = price_history(st["product"], spark.createDataFrame(
        rows, "change_id long, product_id long, ts timestamp, price decimal(10,2)"))
    assert sorted(map(tuple, got.collect()), key=str) == sorted([
        (1, None, at(5), D("10.00")), (1, at(5), at(20), D("11.00")), (1, at(20), None, D("13.00")),
        (2, None, None, D("10.00"))], key=str)
    assert sorted((r.change_id or 0, r.reason) for r in rejects.collect()) == [
        (0, "W0:missing_change_id"), (5, "V6:price:range"), (6, "W2:unknown_key"), (7, "W2:missing_key"),
        (8, "W2:missing_time"), (9, "V6:price:range")]


@pytest.mark.parametrize("rows_per_chunk", [5, 50, 10_000])
def test_covered_equals_replay(spark, rows_per_chunk):
    rng = random.Random(rows_per_chunk)
    stock = {1: 3, 2: 0, 3: 40}
    moves = [(i, rng.choice([1, 1, 1, 2, 3, 4]), at(rng.randrange(200)), rng.choice([-1, -1, -1, -1, 2, 5]))
             for i in range(600)]
    got = covered(spark.createDataFrame(moves, "id long, k long, ts timestamp, q int"),
                  spark.createDataFrame(list(stock.items()), "k long, stock int"), "k", ["ts", "id"], "q", "ts",
                  rows_per_chunk)
    left, want = dict(stock), {}
    for i, k, _, q in sorted(moves, key=lambda m: (m[2], m[0])):
        want[i] = left.get(k, 0) + q >= 0
        left[k] = left.get(k, 0) + (q if want[i] else 0)
    assert {r.id: r.covered for r in got.collect()} == want
    assert got.columns == ["id", "k", "ts", "q", "covered"]


class Shop:
    """One event after another, with prices and stock of the moment."""

    def __init__(self, orders, products):
        self.orders = {o[0]: [o[1], o[6]] for o in orders}
        self.lines, self.refused = {}, []
        self.stock = {p[0]: p[5] for p in products}
        self.price = {p[0]: p[3] for p in products}

    def event(self, event_id, ts, customer, item, action):
        cart = min((i for i, (c, s) in self.orders.items() if c == customer and s == "cart"), default=None)
        if action == ADD:
            if cart is None:
                cart = max(self.orders) + 1
                self.orders[cart] = [customer, "cart"]
            if self.stock[item] == 0:
                self.refused.append(event_id)
                return
            self.stock[item] -= 1
            line = self.lines.setdefault((cart, item), [self.price[item], 0, True])
            line[1] += 1
        elif action == REMOVE and (cart, item) in self.lines:
            self.lines[cart, item][2] = False
        elif action == CHECKOUT and cart is not None:
            self.orders[cart][1] = "confirmed"
            for (o, _), line in self.lines.items():
                line[2] = line[2] and o != cart


@pytest.mark.parametrize("rows_per_chunk", [20, 10_000])
def test_busy_shop_equals_replay(spark, rows_per_chunk):
    rng = random.Random(4)
    products = [product(i, stock=rng.choice([0, 2, 8])) for i in range(4)]
    orders = [(i, i % 3, None, DAY, None, None, "cart" if i % 2 else "confirmed", True) for i in range(1, 6)]
    st = frames(spark, orders=orders, order_details=[], product=products)
    # ids of new orders follow the event ids, which follow time here
    events = [(i, t, rng.choice([0, 0, 0, 1, 2, 3]), rng.randrange(4), rng.choice([ADD, ADD, ADD, REMOVE, CHECKOUT]))
              for i, t in enumerate(sorted(at(rng.randrange(400)) for _ in range(400)))]
    changes = [(i, rng.randrange(4), at(rng.randrange(400)), D(rng.randrange(1, 90))) for i in range(40)]
    deliveries = [(rng.randrange(4), at(rng.randrange(400)), rng.randrange(1, 4)) for _ in range(40)]
    shop = Shop(orders, products)
    timeline = [((e[1], 2, e[0]), e) for e in events] + [((c[2], 0, c[0]), c) for c in changes] \
        + [((d[1], 1, 0), d) for d in deliveries]
    for (_, kind, _), row in sorted(timeline, key=lambda x: x[0]):
        if kind == 0:
            shop.price[row[1]] = row[3]
        elif kind == 1:
            shop.stock[row[0]] += row[2]
        else:
            shop.event(*row)
    schema = "event_id long, ts timestamp, customer_id long, product_id long, action string"
    out = fold_carts_into_store(
        st, spark.createDataFrame(events, schema), rows_per_chunk,
        spark.createDataFrame(changes, "change_id long, product_id long, ts timestamp, price decimal(10,2)"),
        spark.createDataFrame(deliveries, "product_id long, ts timestamp, quantity int"), check_stock=True)
    assert {r.order_id: [r.customer_id, r.status] for r in out["orders"].collect()} == shop.orders
    assert {(r.order_id, r.product_id): [r.price, r.quantity, r.is_valid] for r in out["order_details"].collect()} == shop.lines
    assert {r.product_id: (r.stock_quantity, r.price) for r in out["product"].collect()} == {
        i: (shop.stock[i], shop.price[i]) for i in shop.stock}
    assert sorted(tuple(r) for r in out["rejects"].collect()) == [(i, "W6:no_stock") for i in sorted(shop.refused)]


def test_events_without_values_are_rejected_and_move_nothing(spark):
    st = frames(spark, orders=[], order_details=[], product=[product(1)])
    rows = [(1, at(1), 1, 1, ADD), (1, at(2), 2, 1, ADD), (None, at(1), 1, 1, ADD), (None, at(1), 2, 1, ADD),
            (2, None, 1, 1, ADD), (3, at(1), None, 1, ADD), (4, at(1), 1, None, ADD), (5, at(1), 1, 1, None),
            (6, at(1), 1, 7, ADD), (7, at(3), 1, None, CHECKOUT)]
    events = spark.createDataFrame(rows, "event_id long, ts timestamp, customer_id long, product_id long, action string")
    want = [(0, "W6:missing_event_id"), (0, "W6:missing_event_id"), (2, "W6:missing_time"), (3, "W6:missing_customer"),
            (4, "W6:missing_product"), (5, "W6:missing_action"), (6, "W6:unknown_product")]
    for out in (fold_carts_into_store(st, events), fold_carts(events, st["product"])):
        assert sorted((r.event_id or 0, r.reason) for r in out["rejects"].collect()) == want
    stored = fold_carts_into_store(st, events)
    assert stored["product"].first().stock_quantity == 9
    assert [(r.customer_id, r.status) for r in stored["orders"].collect()] == [(1, "confirmed")]
