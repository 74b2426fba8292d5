"""Correctness with hot keys: a copy of the sf0.001 tables where one customer holds a third of
all orders, one order a third of all lines and one user a third of all events. The queries
whose plans group or join on those keys must still match their SQL oracle."""

import os
import tempfile

import pytest

import __spark_entry__ as entry
from conftest import SF_SMALL
from oracle_compare import DRIVER_VIEWS, digest, duck_connect

HOT_QUERIES = ["R1_order_count", "R2_total_spent", "R4_items_ordered", "R5_favourite_category",
               "R6_distinct_products", "R7_top_product", "R8_avg_order_value", "R9_spend_rank",
               "R10_customer_profile", "R15_top_spenders", "R21_customer_spending",
               "R23_sales_value", "R25_handled_lines", "R28_min_value_handlers", "R29_avg_line_value",
               "R33_list_orders", "R33_list_orders_by_total", "R35_order_lines", "R37_purchase_order_lines",
               "R39_list_employee_orders", "R40_employee_order_lines", "R46_open_carts", "V1_duplicate_line_keys",
               "V_line_feed_violations", "W6_cart_lines", "W6_cart_orders", "W12_stock_ledger"]


@pytest.fixture(scope="module")
def hot_dir():
    import numpy as np
    import pyarrow as pa
    import pyarrow.parquet as pq
    out = tempfile.mkdtemp(prefix="mercato-hot-")
    # (table, key column, residue of key % 3 that moves, column that becomes the hot key)
    moves = {"orders": ("o_orderkey", 0, "o_custkey"), "lineitem": ("l_orderkey", 1, "l_orderkey"),
             "events": ("event_id", 0, "user_id")}
    for name in DRIVER_VIEWS:
        src = os.path.join(SF_SMALL, f"{name}.parquet")
        if not os.path.exists(src):
            continue
        t = pq.read_table(src)
        if name in moves:
            key, residue, target = moves[name]
            hot = t[key].to_numpy() % 3 == residue
            col = t[target].to_numpy()
            t = t.set_column(t.column_names.index(target), target,
                             pa.array(np.where(hot, 0, col), type=t.schema.field(target).type))
        pq.write_table(t, os.path.join(out, f"{name}.parquet"))
    return out


@pytest.mark.parametrize("name", HOT_QUERIES)
def test_hot_keys_match_oracle(spark, hot_dir, name):
    df = entry.queries()[name](spark, hot_dir)
    s = digest(df.columns, [tuple(r) for r in df.collect()])
    cur = duck_connect(hot_dir).execute(entry.oracle_sql()[name])
    o = digest([d[0] for d in cur.description], cur.fetchall())
    assert (s[0], s[1]) == (o[0], o[1])
    assert s[2] == o[2], f"{sorted(set(s[3]) - set(o[3]))[:3]} vs {sorted(set(o[3]) - set(s[3]))[:3]}"


def test_lines_of_a_heavy_order_lie_in_files_of_their_own(spark, hot_dir, tmp_path):
    """One order with a third of the lines: no file holds more than three times the median."""
    import statistics

    from pyspark.sql import functions as F

    from mercato.sources.adapter import adapted_store
    from mercato.sources.store import staged_store
    live = adapted_store(spark, hot_dir)
    merging = "spark.sql.adaptive.coalescePartitions.enabled"  # would merge files as small as these
    before = spark.conf.get(merging)
    spark.conf.set(merging, "false")
    try:
        st = staged_store(live, str(tmp_path), 8)
        rest, heavy = st.parts_of("order_details")
    finally:
        spark.conf.set(merging, before)
    assert [r[0] for r in heavy.keys.collect()] == [0] and not rest.heavy and heavy.heavy
    assert rest.rows.where("order_id = 0").isEmpty()
    assert {r[0] for r in heavy.rows.select("order_id").distinct().collect()} == {0}
    whole = live["order_details"]
    assert st["order_details"].exceptAll(whole).isEmpty() and whole.exceptAll(st["order_details"]).isEmpty()
    for part in (rest, heavy):
        sizes = [r["count"] for r in part.rows.groupBy(F.input_file_name()).count().collect()]
        assert len(sizes) == 8 and max(sizes) <= 3 * statistics.median(sizes)


def test_aggregates_of_ordinary_orders_keep_their_buckets(spark, hot_dir):
    """The parts are handled apart: only lines of the heavy order are shuffled, after a partial sum."""
    import re

    from mercato.plans.common import order_totals
    from mercato.sources.adapter import store_from_driver
    st = store_from_driver(spark, hot_dir)
    plan = order_totals(st, "all", st["orders"].select("order_id", "customer_id"))._jdf.queryExecution() \
        .executedPlan().toString()
    assert len(re.findall(r"Exchange hashpartitioning", plan)) == 1
    assert "Bucketed: true" in plan


def test_heavy_keys_by_sketch(spark):
    """Keys beyond half a file's share are found, others and nulls are not; none is None."""
    from pyspark.sql import functions as F

    from mercato.operators.heavy import heavy_keys
    ids = spark.range(40_000)
    k = F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 7 == 0, -1).when(F.col("id") % 11 == 0, None) \
        .otherwise(F.col("id") + 100)
    found = heavy_keys(ids.select(k.cast("long").alias("k")), files=8)
    assert sorted(r[0] for r in found.collect()) == [-1, 7]
    assert heavy_keys(ids.select(F.col("id").alias("k")), files=8) is None
    assert heavy_keys(ids.limit(0).select(F.col("id").alias("k")), files=8) is None
    assert heavy_keys(spark.range(30).select(F.lit(1).alias("k")), files=8) is None  # few rows


def test_replaced_tables_have_one_part(spark, hot_dir):
    from mercato.sources.adapter import store_from_driver
    st = store_from_driver(spark, hot_dir)
    changed = st.replace(order_details=st["order_details"].where("quantity > 1"))
    assert len(changed.parts_of("order_details")) == 1 and len(changed.parts_of("purchase_order_details")) >= 1
    assert len(st.replace(product=st["product"]).parts_of("order_details")) == 2
