"""Disk that customer counters take: rows are shuffled once, lines stay where they lie, the shuffle
files of a write go with it; and the counters of hot customers, of dropped ones and of odd keys."""

import glob
import os
import re
import time

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from mercato.operators import changes as W
from mercato.operators.ranking import by_heat
from mercato.plans import maintained
from mercato.plans.customer import customer_profile
from mercato.plans.maintained import WRITERS_PER_PART, CustomerCounters, counter_rows
from mercato.session import kept
from mercato.sources.adapter import store_from_driver
from mercato.sources.order_statistics import OrderStatistics
from test_maintained import changed, files, same

PARTS = 4


@pytest.fixture(scope="module")
def st(spark):
    return store_from_driver(spark, SF_SMALL)


@pytest.fixture()
def no_broadcast(spark):
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    yield
    spark.conf.set(key, before)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_counter_rows_are_shuffled_once_and_lie_in_few_files(st, tmp_path):
    counters = CustomerCounters.create(st, str(tmp_path / "counters"), PARTS)
    text = plan(counters._laid_out(counter_rows(st)))
    assert text.count("shufflepartitionidpassthrough") == 1
    assert not re.search(r"hashpartitioning\(customer_id#\d+L?, (kind|product_id)#", text)
    per_folder = {}
    for f in files(counters.root):
        per_folder[os.path.dirname(f)] = per_folder.get(os.path.dirname(f), 0) + 1
    assert len(per_folder) == PARTS and max(per_folder.values()) <= WRITERS_PER_PART


def test_lines_are_not_shuffled_by_product(st, no_broadcast):
    ids = st["product"].where("product_id % 3 = 0").select("product_id")
    kept_lines = W.archive_delete_products(st, ids, None)["order_details"]
    gone = W.by_products(st["order_details"], ids, "left_semi")
    for df, how in ((kept_lines, "left_anti"), (gone, "left_semi")):
        text = plan(df)
        assert "BroadcastHashJoin" in text, text
        assert "SortMergeJoin" not in text, text
        same(df, st["order_details"].join(ids, "product_id", how))


def test_products_far_apart_and_nulls(spark):
    rows = spark.createDataFrame([(1, None), (2, 7), (None, 7), (3, -7), (4, 10 ** 15), (5, 8), (5, 8)],
                                 "order_id long, product_id long")
    for ids in ([7, None, -7], [7, 10 ** 15, -10 ** 15], [None], []):
        keys = spark.createDataFrame([(i,) for i in ids], "product_id long")
        for how in ("left_anti", "left_semi"):
            a, b = W.by_products(rows, keys, how), rows.join(keys, "product_id", how)
            assert a.columns == b.columns
            assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_a_kept_frame_leaves_no_shuffle_files(spark):
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    dirs = [str(d) for d in manager.localDirsString()]

    def data():
        return {f for d in dirs for f in glob.glob(f"{d}/**/shuffle_*.data", recursive=True)}
    before = data()
    out = kept(spark.range(50_000).repartition(4, "id").groupBy((F.col("id") % 5_000).alias("k")).count())
    until = time.time() + 20
    while data() - before and time.time() < until:
        time.sleep(0.2)
    assert not data() - before
    assert out.count() == 5_000


def test_hot_customers_have_the_same_counters(st, tmp_path, monkeypatch):
    plain = CustomerCounters.create(st, str(tmp_path / "plain"), PARTS)
    monkeypatch.setattr(maintained, "by_heat", lambda df, key: by_heat(df, key, 70))
    assert by_heat(counter_rows(st), "customer_id", 70)[1] is not None
    hot = CustomerCounters.create(st, str(tmp_path / "hot"), PARTS)
    assert sorted(map(str, plain.rows().collect())) == sorted(map(str, hot.rows().collect()))
    same(hot.profile(st), customer_profile(st).drop("spend_rank"))


def test_totals_of_customers_that_come_and_go(st, tmp_path):
    """Customers whose last order goes leave the ranks; all folders of others keep their files."""
    counters = CustomerCounters.create(st, str(tmp_path / "counters"), 16)
    spend = OrderStatistics.create(counters.totals(), str(tmp_path / "spend"), 4)
    gone = F.col("customer_id") % 7 == 3
    ids = st["orders"].where(gone).select("order_id")
    after = st.replace(orders=st["orders"].withColumn("is_valid", F.col("is_valid") & ~F.coalesce(gone, F.lit(False))))
    counters.apply(st, after, ids, spend)
    same(counters.profile(after, spend=spend), customer_profile(after))
    assert sorted(map(str, spend.values().groupBy("value").agg(F.sum("n")).collect())) == sorted(
        map(str, counters.totals().groupBy("value").agg(F.count(F.lit(1)).alias("sum(n)")).collect()))
    counters.apply(after, st, ids, spend)
    same(counters.profile(st, spend=spend), customer_profile(st))
    again = changed(st, list(range(0, 40)))
    counters.apply(st, again, st.spark.range(40).withColumnRenamed("id", "order_id"), spend)
    same(counters.profile(again, spend=spend), customer_profile(again))
