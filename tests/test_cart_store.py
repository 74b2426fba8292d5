"""Cart events folded into a store, in one go and in two with a price change in between, against a
replay of one event after another."""

import datetime as dt
import random
from decimal import Decimal as D

from mercato.operators.carts import fold_carts_into_store
from mercato.sources.schemas import SCHEMAS

DAY = dt.date(2024, 1, 1)


class Replay:
    def __init__(self, orders, lines, products):
        self.orders = {o[0]: dict(customer=o[1], status=o[6], date=o[3]) for o in orders}
        self.lines = {(x[0], x[1]): [x[2], x[3], x[4]] for x in lines}
        self.stock = {p[0]: p[5] for p in products}
        self.price = {p[0]: p[3] for p in products}

    def cart(self, customer):
        return min((i for i, o in self.orders.items() if o["customer"] == customer and o["status"] == "cart"),
                   default=None)

    def apply(self, events):
        for _, ts, customer, product, action in events:
            order = self.cart(customer)
            if action == "add" and product in self.price:
                if order is None:
                    order = max(self.orders) + 1
                    self.orders[order] = dict(customer=customer, status="cart", date=ts.date())
                line = self.lines.setdefault((order, product), [self.price[product], 0, True])
                line[1] += 1
                self.stock[product] -= 1
            elif action == "remove" and (order, product) in self.lines:
                self.lines[order, product][2] = False
            elif action == "checkout" and order is not None:
                self.orders[order].update(status="confirmed", date=ts.date())
                for (o, _), line in self.lines.items():
                    if o == order:
                        line[2] = False


def store_of(spark, orders, lines, products):
    return {t: spark.createDataFrame(rows, SCHEMAS[t]) for t, rows in
            (("orders", orders), ("order_details", lines), ("product", products))}


def check(out, replay):
    got = {r["order_id"]: dict(customer=r["customer_id"], status=r["status"], date=r["order_date"])
           for r in out["orders"].collect()}
    assert got == replay.orders
    assert {(r["order_id"], r["product_id"]): [r["price"], r["quantity"], r["is_valid"]]
            for r in out["order_details"].collect()} == replay.lines
    assert {r["product_id"]: r["stock_quantity"] for r in out["product"].collect()} == replay.stock


def test_fold_continues_open_carts(spark):
    rng = random.Random(8)
    products = [(i, f"p{i}", "c", D("10.00") + i, True, 50, None) for i in range(6)]
    # customers 0-2 have open carts (customer 1 has three), customer 3 a finished order
    orders = [(i, c, None, DAY, None, None, s, True) for i, c, s in
              [(1, 0, "cart"), (2, 1, "cart"), (3, 1, "Cart"), (4, 1, "cart"), (5, 2, "cart"), (6, 3, "completed")]]
    orders[2] = orders[2][:6] + ("cart",) + orders[2][7:]
    lines = [(1, 0, D("3.00"), 2, True), (1, 1, D("4.00"), 1, False), (2, 2, D("5.00"), 1, True), (6, 0, D("9.00"), 1, True)]
    start = dt.datetime(2024, 5, 1)
    events = [(i, start + dt.timedelta(minutes=37 * i), rng.randrange(7), rng.randrange(8),
               rng.choice(["add"] * 5 + ["remove"] * 2 + ["checkout"])) for i in range(400)]

    def frame(rows):
        return spark.createDataFrame(rows + rows[:20],     # replayed events count once
                                     "event_id long, ts timestamp, customer_id long, product_id long, action string")

    replay = Replay(orders, lines, products)
    replay.apply(events)
    check(fold_carts_into_store(store_of(spark, orders, lines, products), frame(events)), replay)

    # in two steps, with dearer products in the second
    replay = Replay(orders, lines, products)
    replay.apply(events[:180])
    first = fold_carts_into_store(store_of(spark, orders, lines, products), frame(events[:180]))
    check(first, replay)
    kept = {t: [tuple(r) for r in first[t].collect()] for t in ("orders", "order_details", "product")}
    dearer = [r[:3] + (r[3] + 5,) + r[4:] for r in kept["product"]]
    replay.price = {p: v + 5 for p, v in replay.price.items()}
    replay.apply(events[180:])
    check(fold_carts_into_store(store_of(spark, kept["orders"], kept["order_details"], dearer), frame(events[180:])), replay)
