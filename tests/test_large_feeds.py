"""What keeps feeds of hundreds of millions of requests within bounds: rows are shuffled once, no
table is built that an output does not need, and the rows of a task do not grow with the data."""

import contextlib
import datetime as dt
import io
import random

from pyspark.sql import functions as F

from mercato.operators import changes as W
from mercato.operators import quality, ranking
from mercato.operators.carts import fold_carts_into_store
from mercato.operators.quality import with_duplicate_flag
from mercato.operators.ranking import by_heat, previous_value
from mercato.plans import feeds
from mercato.plans.jobs import _in_place
from mercato.session import INITIAL_PARTITIONS, fit_partitions, partition_count
from mercato.sources.adapter import Store
from mercato.sources.store import bucket_count


class Tables(dict):
    """Store tables; reading one that is not there fails the test."""

    def __missing__(self, name):
        raise AssertionError(f"{name} was read")


def plan(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue()


def test_rows_are_not_shuffled_for_few_repeated_keys(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "d"), (None, "e")], "k long, v string")
    got = with_duplicate_flag(df, ["k"])
    assert {r.v: r._dup for r in got.collect()} == {"a": True, "b": True, "c": False, "d": False, "e": False}
    assert "hashpartitioning" not in plan(got)


def test_previous_value_shuffles_rows_once(spark):
    rows = [(i, i % 3, i % 5 == 0) for i in range(0, 400_000, 1_000)]
    got = previous_value(spark.createDataFrame(rows, "t long, k long, v boolean"), "k", "v", "t", "p")
    last, want = {}, {}
    for t, k, v in rows:
        want[t], last[k] = last.get(k), v
    assert plan(got).count("hashpartitioning") == 1
    assert {r.t: r.p for r in got.collect()} == want


def test_hot_keys_are_told_apart(spark):
    df = spark.createDataFrame([(1, i) for i in range(3_000)] + [(k, 0) for k in range(2, 200)], "k long, t long")
    ordinary, hot = by_heat(df, "k", 1_000)
    assert {r.k for r in hot.select("k").distinct().collect()} == {1}
    assert hot.count() == 3_000 and ordinary.count() == 198


def test_archive_reads_no_lines(spark):
    product = spark.createDataFrame([(1, "p"), (2, "q")], "product_id long, product_name string") \
        .select("*", F.lit("c").alias("category"), F.lit(1).cast("decimal(10,2)").alias("price"),
                F.lit(1).alias("stock_quantity"), F.lit(None).cast("date").alias("stock_arrival_date"))
    out = W.archive_delete_products(Tables(product=product), spark.createDataFrame([(1,)], "product_id long"),
                                    dt.datetime(2024, 1, 1))
    assert [r.product_id for r in out["archived"].collect()] == [1]


def test_refused_events_read_no_orders_or_lines(spark):
    product = spark.createDataFrame([(1, 1)], "product_id long, stock_quantity int") \
        .withColumn("price", F.lit(1).cast("decimal(10,2)"))
    events = spark.createDataFrame([(i, 7, 1, "add", dt.datetime(2024, 1, 1, 0, 0, i)) for i in range(3)],
                                   "event_id long, customer_id long, product_id long, action string, ts timestamp")
    out = fold_carts_into_store(Tables(product=product), events, check_stock=True)["rejects"]
    assert sorted(r.event_id for r in out.collect()) == [1, 2]


def test_new_purchase_ids_need_keys_only(spark):
    class Keyed(Tables):
        def keys_of(self, name):
            return spark.createDataFrame([(40,), (40,), (7,)], "purchase_order_id long")

    st = Keyed(product=spark.createDataFrame([(1, 5, True)], "product_id long, stock_quantity int, is_valid boolean"),
               supplier=spark.createDataFrame([(3, True)], "supplier_id long, is_valid boolean"))
    requests = spark.createDataFrame([(1, 3, 2, dt.date(2024, 5, 1))],
                                     "change_id long, supplier_id long, employee_id long, expected_received_date date")
    items = spark.createDataFrame([(1, 1, 2)], "change_id long, product_id long, quantity int") \
        .withColumn("price", F.lit(1).cast("decimal(10,2)"))
    out = W.create_purchase_orders(st, requests, items, dt.date(2024, 1, 1))
    assert [r.purchase_order_id for r in out["new_lines"].collect()] == [41]


def test_purchase_order_flags_equal_a_replay(spark):
    rnd = random.Random(4)
    po = [(i, rnd.choice([True, False, None]), rnd.choice(["Pending", "pending", "Shipped", None])) for i in range(60)]
    lines = [(i, rnd.random() < 0.5) for i, _, _ in po]
    feed = [(c, rnd.randrange(65), rnd.random() < 0.5) for c in range(200)]
    st = {"purchase_order": spark.createDataFrame(po, "purchase_order_id long, is_valid boolean, delivery_status string"),
          "purchase_order_details": spark.createDataFrame(lines, "purchase_order_id long, is_valid boolean")}
    state, status, line = {i: v for i, v, _ in po}, {i: s for i, _, s in po}, dict(lines)
    refused = set()
    for c, i, flag in feed:
        pending = (status.get(i) or "").lower() == "pending"
        if state.get(i) is None or state[i] == flag or (not flag and not pending):
            refused.add(c)
        else:
            state[i] = line[i] = flag
    out = W.set_purchase_order_active(st, spark.createDataFrame(feed, "change_id long, purchase_order_id long, flag boolean"))
    assert {r.purchase_order_id: r.is_valid for r in out["purchase_order"].collect()} == state
    assert {r.purchase_order_id: r.is_valid for r in out["purchase_order_details"].collect()} == line
    assert {r.change_id for r in out["rejects"].collect()} == refused


def test_partitions_follow_the_size_of_the_source(spark):
    before = spark.conf.get(INITIAL_PARTITIONS, None)
    try:
        fit_partitions(spark, 10 * 2 ** 30)
        assert partition_count(spark) >= 640 and bucket_count(spark) >= 640
        assert bucket_count(spark, 10 * 2 ** 30) >= 320
    finally:
        spark.conf.unset(INITIAL_PARTITIONS) if before is None else spark.conf.set(INITIAL_PARTITIONS, before)


def test_stock_needs_no_purchase_ids(spark):
    st = Tables(product=spark.createDataFrame([(1, 5, True)], "product_id long, stock_quantity int, is_valid boolean"),
                supplier=spark.createDataFrame([(3, True)], "supplier_id long, is_valid boolean"))
    requests = spark.createDataFrame([(1, 3, 2, dt.date(2024, 5, 1)), (2, 4, 2, dt.date(2024, 5, 1))],
                                     "change_id long, supplier_id long, employee_id long, expected_received_date date")
    items = spark.createDataFrame([(1, 1, 2), (2, 1, 7)], "change_id long, product_id long, quantity int") \
        .withColumn("price", F.lit(1).cast("decimal(10,2)"))
    out = W.create_purchase_orders(st, requests, items, dt.date(2024, 1, 1))
    assert [r.stock_quantity for r in out["product"].collect()] == [7]


def test_requests_and_switches_are_one_grouping_in_files(store):
    headers, _, flags = feeds.switched_purchases(store)
    for df in (headers, *flags.values()):
        assert "hashpartitioning" not in plan(df)


def test_layout_in_parts_stages_no_table(spark, store):
    def staged():
        raise AssertionError("orders were staged")

    st = Store(spark, {"orders": staged}, sources={"orders": lambda: store["orders"]})
    assert _in_place(st, ["orders"])["orders"].count() == store["orders"].count()


def test_rows_unlike_repeated_keys_are_not_shuffled(spark, monkeypatch):
    monkeypatch.setattr(quality, "BROADCAST_KEYS", 10)
    rows = [(k, i) for k in range(300) for i in range(2)] + [(k, 0) for k in range(300, 20_000)] + [(None, 1)] * 2
    df = spark.createDataFrame(rows, "k long, v int").withColumn("nothing", F.lit(None))
    for feed in (df.drop("nothing"), df):
        got = with_duplicate_flag(feed, ["k"])
        assert got.columns == [*feed.columns, "_dup"]
        assert sorted((r.k or -1, r._dup) for r in got.collect()) == sorted(
            (k or -1, k is not None and k < 300) for k, _ in rows)
    alike, others = quality._by_hash(df, ["k"], spark.range(300).select(F.col("id").alias("k")), 300)
    assert alike.where("k < 300").count() == 600 and alike.count() + others.count() == len(rows)
    assert alike.count() < 4_000 and "hashpartitioning(k" not in plan(others)
    # the rows that share a repeated key's hash lie in files: what reads them shuffles no rows
    assert "hashpartitioning(k" not in plan(with_duplicate_flag(df.drop("nothing"), ["k"]))


def test_earlier_flags_need_one_shuffle(spark):
    rnd = random.Random(7)
    rows = [(t, rnd.randrange(40), rnd.random() < 0.2) for t in range(400)]
    df = spark.createDataFrame(rows, "t long, k long, v boolean")
    last, ever, want = {}, {}, {}
    for t, k, v in rows:
        want[t] = (last.get(k), ever.get(k, False))
        last[k], ever[k] = v, ever.get(k, False) or v
    got = ranking.previous_and_any(df, "k", "v", "t", "p", "e")
    assert plan(got).count("hashpartitioning") == 1
    assert {r.t: (r.p, r.e) for r in got.collect()} == want
    hot = ranking._any_in_levels(ranking._previous_in_levels(df, "k", "v", "t", "p"), "k", "v", "t", "e")
    assert {r.t: (r.p, r.e) for r in hot.collect()} == want


def test_tables_lie_as_shuffles_do(spark, tmp_path):
    from mercato.sources.store import staged_store
    partitions = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        # more partitions than the machine has cores
        spark.conf.set("spark.sql.shuffle.partitions", str(3 * spark.sparkContext.defaultParallelism))
        po = spark.range(100).select(F.col("id").alias("purchase_order_id"), F.lit(1).cast("long").alias("employee_id"),
                                     F.lit(1).cast("long").alias("supplier_id"),
                                     *[F.lit(None).cast("date").alias(c) for c in
                                       ("order_date", "expected_received_date", "actual_received_date")],
                                     F.lit("pending").alias("delivery_status"), F.lit(True).alias("is_valid"))
        st = staged_store(Store(spark, {"purchase_order": lambda: po}), f"{tmp_path}/s")
        flags = spark.createDataFrame([(1, 5, False), (2, 7, False), (3, 5, True)],
                                      "change_id long, purchase_order_id long, flag boolean")
        with_sizes = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        try:
            after = W.set_purchase_order_active(st, flags)["purchase_order"]
            assert plan(after).count("hashpartitioning") == 1  # the requests, once; the table not
            assert [r.purchase_order_id for r in after.where("NOT is_valid").collect()] == [7]
        finally:
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", with_sizes)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
