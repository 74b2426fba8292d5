"""Maintained customer counters against recomputation: profiles after changes equal the profile of
the changed store, and only the folders of touched customers are rewritten."""

import os
import re

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from mercato.plans.customer import customer_profile
from mercato.plans.maintained import CustomerCounters
from mercato.sources.adapter import store_from_driver

PARTS = 16


def same(a, b):
    a, b = a.select(*sorted(a.columns)), b.select(*sorted(b.columns))
    assert a.columns == b.columns
    rows_a, rows_b = ({tuple(r) for r in d.collect()} for d in (a, b))
    assert rows_a == rows_b, (sorted(rows_a - rows_b, key=str)[:2], sorted(rows_b - rows_a, key=str)[:2])


def recomputed(st, ids=None):
    return customer_profile(st, ids).drop("spend_rank")


def files(root):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns
            for d, _, fs in os.walk(root) for f in fs if f.endswith(".parquet")}


@pytest.fixture(scope="module")
def st(spark):
    return store_from_driver(spark, SF_SMALL)


@pytest.fixture()
def counters(st, tmp_path):
    return CustomerCounters.create(st, str(tmp_path / "counters"), PARTS)


def changed(st, order_ids):
    """Orders switched off and moved to other customers; lines removed, added and changed."""
    spark = st.spark
    hit, k = F.col("order_id").isin(order_ids), F.col("order_id")
    orders = st["orders"].withColumn("is_valid", F.when(hit & (k % 3 == 0), ~F.col("is_valid")).otherwise(F.col("is_valid"))) \
        .withColumn("customer_id", F.when(hit & (k % 3 == 1), F.col("customer_id") + 1).otherwise(F.col("customer_id"))) \
        .withColumn("order_date", F.when(hit & (k % 4 == 1), F.date_add("order_date", 4000)).otherwise(F.col("order_date")))
    lines = st["order_details"].where(~(hit & (F.col("product_id") % 2 == 0))).withColumn(
        "quantity", F.when(hit, F.col("quantity") + 3).otherwise(F.col("quantity")))
    extra = spark.createDataFrame([(o, 900_000 + i) for i, o in enumerate(order_ids)], "order_id long, product_id long") \
        .select("order_id", "product_id", F.lit("7.50").cast("decimal(10,2)").alias("price"), F.lit(2).alias("quantity"),
                F.lit(True).alias("is_valid"))
    return st.replace(orders=orders, order_details=lines.unionByName(extra.select(*lines.columns)))


def test_created_counters_give_the_profile(st, counters):
    same(counters.profile(st), recomputed(st))


def test_changes_equal_recomputation_and_touch_their_folders_only(st, counters):
    asked = st["customer"].select("customer_id").where("customer_id IN (3, 5, 9)")
    ids = [r[0] for r in st["orders"].where("customer_id IN (3, 9)").select("order_id").collect()]
    after = changed(st, ids)
    touched = after.spark.createDataFrame([(i,) for i in ids + ids[:2] + [-1]], "order_id long")
    before = files(counters.root)
    parts = counters.apply(st, after, touched)
    now = files(counters.root)
    moved = {p for p in before.keys() | now.keys() if before.get(p) != now.get(p)}
    assert {int(p.split("_part=")[1].split("/")[0]) for p in moved} == set(parts)
    assert 0 < len(parts) <= 6 < PARTS  # customers 3, 4, 9 and 10 at most
    same(counters.profile(after), recomputed(after))
    same(counters.profile(after, asked), recomputed(after, asked))


def test_a_change_and_its_reversal_leave_the_counters(st, counters):
    start = {tuple(r) for r in counters.rows().collect()}
    after = changed(st, list(range(60)))
    ids = st.spark.range(60).withColumnRenamed("id", "order_id")
    counters.apply(st, after, ids)
    same(counters.profile(after), recomputed(after))
    counters.apply(after, st, ids)
    assert {tuple(r) for r in counters.rows().collect()} == start


def test_customers_whose_last_order_goes(st, counters):
    after = st.replace(orders=st["orders"].withColumn("is_valid", F.lit(False)))
    counters.apply(st, after, st["orders"].select("order_id"))
    assert counters.rows().isEmpty()
    same(counters.profile(after), recomputed(after))


def test_no_change_writes_nothing(st, counters):
    before = files(counters.root)
    assert counters.apply(st, st, st["orders"].select("order_id")) == []
    assert files(counters.root) == before


def test_patched_names_need_no_delta(st, counters):
    p = st["product"].withColumn("category", F.concat(F.lit("New "), "category"))
    after = st.replace(product=p)
    same(counters.profile(after), recomputed(after))


# ---- order statistics -----------------------------------------------------------------------
def brute_ranks(values, asked):
    distinct = set(values)
    return {a: None if a is None else 1 + sum(v > a for v in distinct) for a in asked}


def ranks_of(stats, asked):
    df = stats.spark.createDataFrame([(None if a is None else str(a),) for a in asked], "value string") \
        .select(F.col("value").cast("decimal(38,2)").alias("value"))
    out = stats.ranked(df).collect()
    assert len(out) == len(asked)
    return {None if r["value"] is None else float(r["value"]): r["rank"] for r in out}


def money(spark, values):
    return spark.createDataFrame([(v,) for v in values], "value double")


def test_ranks_against_brute_force_through_changes(spark, tmp_path):
    from mercato.sources.order_statistics import OrderStatistics
    values = [float((i * 37) % 500) for i in range(2_000)] + [250.0] * 700  # a hot value, all repeated
    stats = OrderStatistics.create(money(spark, values + [None]), str(tmp_path / "s"), 8)
    asked = [0.0, 0.5, 250.0, 499.0, 999.0, -3.0, 123.0, None, 250.0]
    assert ranks_of(stats, asked) == brute_ranks(values, asked)
    # all values of the top ranges go, one new value far above comes, one loses one holder only
    gone = [v for v in values if v >= 300] + [250.0]
    new = [5_000.0, 5_000.0]
    deltas = money(spark, gone).withColumn("n", F.lit(-1)).unionByName(money(spark, new).withColumn("n", F.lit(1)))
    touched = stats.apply(deltas)
    left = [v for v in values if v < 300] + new
    assert 0 < len(touched) < 8
    asked += [5_000.0, 400.0, 6_000.0]
    assert ranks_of(stats, asked) == brute_ranks(left, asked)
    assert ranks_of(OrderStatistics.open(spark, stats.root), asked) == brute_ranks(left, asked)
    assert stats.apply(deltas.limit(0)) == []


def test_a_few_ranks_read_their_ranges_only(spark, tmp_path):
    from mercato.sources.order_statistics import OrderStatistics
    stats = OrderStatistics.create(money(spark, [float(i) for i in range(4_000)]), str(tmp_path / "s"), 8)
    some = stats.values([stats.range_of(10), stats.range_of(12)])
    assert some.where("value IN (10, 12)").count() == 2
    plan = stats.ranked(money(spark, [10.0, 12.0]).select(F.col("value").cast("decimal(38,2)").alias("value"))) \
        ._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*_range#\d+ = 0", plan)
    assert some.count() < 4_000 / 4


def test_outgrown_ranges_are_cut_anew(spark, tmp_path):
    from mercato.sources.order_statistics import OrderStatistics
    stats = OrderStatistics.create(money(spark, [float(i) for i in range(100)]), str(tmp_path / "s"), 2, most_per_range=200)
    more = [1_000.0 + i for i in range(900)]
    stats.apply(money(spark, more).withColumn("n", F.lit(1)))
    assert max(r["distinct"] for r in stats.counts().collect()) <= 200
    asked = [0.0, 99.0, 1_000.0, 1_899.0]
    assert ranks_of(stats, asked) == brute_ranks([float(i) for i in range(100)] + more, asked)
    empty = OrderStatistics.create(money(spark, [1.0]).limit(0), str(tmp_path / "e"), 4)
    assert ranks_of(empty, [1.0]) == {1.0: 1}


def test_ranks_follow_the_counters(st, counters, tmp_path):
    from mercato.sources.order_statistics import OrderStatistics
    spend = OrderStatistics.create(counters.totals(), str(tmp_path / "spend"), 8)
    same(counters.profile(st, spend=spend), customer_profile(st))
    ids = list(range(0, 300))
    after = changed(st, ids)
    counters.apply(st, after, st.spark.range(300).withColumnRenamed("id", "order_id"), spend)
    same(counters.profile(after, spend=spend), customer_profile(after))
    asked = st["customer"].select("customer_id").where("customer_id IN (3, 5, 9)")
    same(counters.profile(after, asked, spend), customer_profile(after, asked))
