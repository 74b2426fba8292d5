"""W3 and W9 in one ordered feed against a replay of one request after another."""

import datetime as dt
import random
from decimal import Decimal as D

import pytest

from mercato.operators import changes as W
from mercato.operators.timeline import as_of
from mercato.sources.schemas import SCHEMAS

DAY = dt.date(2024, 1, 1)
FLAGS = "change_id long, {} long, flag boolean"
BIG = 10 ** 14  # change ids beyond what a time in microseconds could hold as seconds


def frames(spark, seed):
    rng = random.Random(seed)
    products = [(i, f"p{i}", "c", D("1.00"), rng.random() < 0.7, 10, None) for i in range(8)]
    suppliers = [(i, f"s{i}", None, None, None, rng.random() < 0.7) for i in range(4)]

    def rows(table, made):
        fields = SCHEMAS[table].fieldNames()
        keep = {"supplier": lambda r: {"supplier_id": r[0], "supplier_name": r[1], "is_valid": r[5]}}.get(table)
        if keep:
            made = [tuple(keep(r).get(f, "x") for f in fields) for r in made]
        return spark.createDataFrame(made, SCHEMAS[table])
    store = {"product": rows("product", products), "supplier": rows("supplier", suppliers),
             "purchase_order": rows("purchase_order", []), "purchase_order_details": rows("purchase_order_details", [])}
    return store, {r[0]: r[4] for r in products}, {r[0]: r[5] for r in suppliers}


def planted(seed, n=300):
    """Requests in order: ('product' | 'supplier', id, key, flag) or ('buy', id, supplier, items)."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        kind, cid = rng.choice(["product", "supplier", "buy", "buy"]), BIG + 3 * i
        if kind == "buy":
            items = rng.sample([*range(8), 99], rng.randrange(1, 4)) if rng.random() < 0.6 else [0]  # 0 is hot
            out.append((kind, cid, rng.choice([0, 0, 1, 2, 3, 77]), items))
        else:
            out.append((kind, cid, rng.choice([0, 0, *range(1, 8 if kind == "product" else 4), 55]), rng.random() < 0.6))
    return out


def replay(feed, on, supp):
    bought, rejects, stock = [], [], dict.fromkeys(on, 10)
    for kind, cid, key, what in feed:
        if kind == "buy":
            why = [] if supp.get(key) else ["W9:supplier_inactive"]
            why += [] if all(on.get(p) for p in what) else ["W9:inactive_product"]
            rejects += [(cid, w) for w in why]
            if not why:
                bought.append(key)
                for p in what:
                    stock[p] += 2
            continue
        state = on if kind == "product" else supp
        if key not in state:
            rejects.append((cid, "W3:unknown_key"))
        elif not what and not state[key]:
            rejects.append((cid, "W3:state_guard"))
        else:
            state[key] = what
    return bought, sorted(rejects), {p: (stock[p], on[p]) for p in on}


@pytest.mark.parametrize("seed", [1, 2])
def test_mixed_feed_equals_a_replay(spark, seed):
    store, on, supp = frames(spark, seed)
    feed = planted(seed)
    buys = [r for r in feed if r[0] == "buy"]
    requests = spark.createDataFrame([(c, s, 1, DAY + dt.timedelta(9)) for _, c, s, _ in buys],
                                     "change_id long, supplier_id long, employee_id long, expected_received_date date")
    items = spark.createDataFrame([(c, p, D("1.00"), 2) for _, c, _, ps in buys for p in ps],
                                  "change_id long, product_id long, price decimal(10,2), quantity int")
    flags = {t: spark.createDataFrame([r[1:] for r in feed if r[0] == t], FLAGS.format(f"{t}_id"))
             for t in ("product", "supplier")}
    out = W.purchase_feed(store, requests, items, flags, DAY)
    bought, rejects, products = replay(feed, dict(on), dict(supp))
    made = [r.supplier_id for r in out["new_purchase_orders"].orderBy("purchase_order_id").collect()]
    assert made == bought and 0 < len(made) < len(buys)
    assert sorted(tuple(r) for r in out["rejects"].collect()) == rejects
    assert {r.product_id: (r.stock_quantity, r.is_valid) for r in out["product"].collect()} == products
    # no switches: as the plain job
    plain = W.create_purchase_orders(store, requests, items, DAY)["rejects"]
    empty = {t: f.limit(0) for t, f in flags.items()}
    assert sorted(map(tuple, W.purchase_feed(store, requests, items, empty, DAY)["rejects"].collect())) \
        == sorted(map(tuple, plain.collect()))


def test_unplaced_switches_and_requests_are_rejects(spark):
    store, _, _ = frames(spark, 1)
    requests = spark.createDataFrame([(None, 0, 1, DAY + dt.timedelta(9)), (5, None, 1, DAY + dt.timedelta(9))],
                                     "change_id long, supplier_id long, employee_id long, expected_received_date date")
    items = spark.createDataFrame([(5, 0, D("1.00"), 2), (None, 1, D("1.00"), 2), (5, None, D("1.00"), 2)],
                                  "change_id long, product_id long, price decimal(10,2), quantity int")
    flags = {"product": spark.createDataFrame([(None, 0, False), (2, None, False), (3, 1, None), (4, 1, True), (4, 2, True)],
                                              FLAGS.format("product_id"))}
    out = W.purchase_feed(store, requests, items, flags, DAY)
    rejects = {(r.change_id, r.reason) for r in out["rejects"].collect()}
    assert {(None, "W0:missing_change_id"), (2, "W3:missing_key"), (3, "W3:missing_flag"),
            (4, "W0:duplicate_change_id"), (5, "W9:missing_field")} <= rejects
    assert out["new_purchase_orders"].isEmpty() and out["product"].count() == 8


def test_as_of_whole_numbers_in_many_chunks(spark):
    changes = spark.createDataFrame([(i % 3, BIG + 10 * i, i) for i in range(200)], "k long, t long, v int")
    rows = spark.createDataFrame([(k, BIG + t) for k in range(4) for t in range(-5, 2100, 7)], "k long, t long")
    got = {(r.k, r.t): r.v for r in as_of(rows, changes, "k", "t", "v", rows_per_chunk=50).collect()}
    want = {(k, BIG + t): max((i for i in range(200) if i % 3 == k and 10 * i <= t), default=None)
            for k in range(4) for t in range(-5, 2100, 7)}
    assert got == want
