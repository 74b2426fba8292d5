"""The stateful cart stream against the batch fold and a replay, in several splits."""

import datetime as dt
import random
import tempfile
import time
from decimal import Decimal as D

import pytest

from mercato.operators.carts import ADD, CHECKOUT, REMOVE
from mercato.streaming.cart_state import PRICE, RESTOCK, STREAM_SCHEMA, current, start_store_stream
from test_requests import DAY, Shop, at, frames, product


def rows_of(rng):
    events = [(i, t, rng.choice([0, 0, 0, 1, 2, 3]), rng.randrange(4), rng.choice([ADD, ADD, ADD, REMOVE, CHECKOUT]))
              for i, t in enumerate(sorted(at(rng.randrange(400)) for _ in range(300)))]
    changes = [(1000 + i, at(rng.randrange(400)), rng.randrange(4), D(rng.randrange(1, 90))) for i in range(30)]
    deliveries = [(at(rng.randrange(400)), rng.randrange(4), rng.randrange(1, 4)) for _ in range(30)]
    return events, changes, deliveries


def streamed(spark, st, batches):
    source, state = tempfile.mkdtemp(prefix="cart-source-"), tempfile.mkdtemp(prefix="cart-state-")
    for rows in batches:
        spark.createDataFrame(rows, STREAM_SCHEMA).coalesce(1).write.mode("append").parquet(source)
        time.sleep(0.05)
    stream = spark.readStream.schema(STREAM_SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
    query, path = start_store_stream(spark, stream, st, state, delay="20 minutes")
    assert query.awaitTermination(600)
    return path


@pytest.mark.parametrize("n_batches", [1, 4])
def test_stream_equals_replay(spark, n_batches):
    rng = random.Random(12)
    products = [product(i, stock=rng.choice([0, 2, 8])) for i in range(4)]
    orders = [(i, i % 3, None, DAY, None, None, "cart" if i % 2 else "confirmed", True) for i in range(1, 6)]
    lines = [(1, 2, D("3.50"), 4, True), (3, 0, D("1.25"), 1, False), (2, 1, D("9.00"), 1, True)]
    st = frames(spark, orders=orders, order_details=lines, product=products)
    events, changes, deliveries = rows_of(rng)
    shop = Shop(orders, products)
    shop.lines = {(o, p): [price, q, on] for o, p, price, q, on in lines}
    timeline = [((e[1], 2, e[0]), e) for e in events] + [((c[1], 0, c[0]), c) for c in changes] \
        + [((d[0], 1, 0), d) for d in deliveries]
    stream = []
    for (t, kind, _), row in sorted(timeline, key=lambda x: x[0]):
        if kind == 0:
            shop.price[row[2]] = row[3]
            stream.append((row[0], t, None, row[2], PRICE, row[3], None))
        elif kind == 1:
            shop.stock[row[1]] += row[2]
            stream.append((None, t, None, row[1], RESTOCK, None, row[2]))
        else:
            shop.event(*row)
            stream.append((*row, None, None))
    # rows come up to 15 minutes out of order; a last row far ahead moves the watermark past all
    stream.sort(key=lambda r: r[1] + dt.timedelta(minutes=rng.randrange(15)))
    stream += [stream[5]] if n_batches == 1 else []      # a copy in the same slice counts once
    size = -(-len(stream) // n_batches)
    batches = [stream[i:i + size] for i in range(0, len(stream), size)]
    batches.append([(9999, at(5000), 99, None, CHECKOUT, None, None)])
    late = (8888, at(1), 1, 1, ADD, None, None)
    batches.append([late, (None, at(1), 1, 1, ADD, None, None), (8889, None, 1, 1, ADD, None, None),
                    (8890, at(6000), None, 1, ADD, None, None), (8891, at(6000), 1, 1, PRICE, D("0.00"), None)])
    path = streamed(spark, st, batches)

    made = {}  # carts in the order in which the shop opened them
    for o, (customer, _) in sorted(shop.orders.items()):
        if o > 5 or any(x[0] == o and x[6] == "cart" for x in orders):
            made.setdefault(customer, []).append(o)
    ids = {(c, n): o for c, found in made.items() for n, o in enumerate(found)}
    got = dict(map(lambda x: ((x[0], x[1]), [x[2], x[3], x[4]]), [(o, p, price, q, on) for o, p, price, q, on in lines]))
    for r in current(spark, path, "line").collect():
        assert r.order_id == (ids[r.customer_id, r.cart_no] if ids[r.customer_id, r.cart_no] <= 5 else None)
        got[ids[r.customer_id, r.cart_no], r.product_id] = [r.price, r.quantity, r.is_valid]
    assert got == shop.lines
    status = {o: s for o, (_, s) in shop.orders.items()}
    state = {x[0]: x[6] for x in orders}
    for r in current(spark, path, "order").collect():
        state[ids[r.customer_id, r.cart_no]] = "confirmed" if r.checked_out_at else "cart"
    assert state == status
    stock = {p[0]: (p[5], p[3]) for p in products}
    stock |= {r.product_id: (r.stock, r.price) for r in current(spark, path, "item").collect()}
    assert stock == {i: (shop.stock[i], shop.price[i]) for i in shop.stock}
    rejects = sorted((r.reason, r.event_id or 0) for r in current(spark, path, "reject").collect())
    assert rejects == sorted([("W6:no_stock", i) for i in shop.refused] + [
        ("W6:late", 8888), ("W6:missing_event_id", 0), ("W6:missing_time", 8889), ("W6:missing_customer", 8890),
        ("V6:price:range", 8891)])
