"""Keys far beyond those of the small data sets: supplier keys in the thousands and part keys above
twenty million. Purchase order ids stay unique, ids meant not to exist do not, and the queries
match their oracle."""

import os
import tempfile

import pytest

import __spark_entry__ as entry
from conftest import SF_SMALL
from oracle_compare import DRIVER_VIEWS, digest, duck_connect

QUERIES = ["R16_oldest_purchase_orders", "R24_purchase_orders_made", "R36_list_purchase_orders", "W2_patch_rejects",
           "W2_patched_products", "W3_flag_rejects", "W4_purchase_orders_after", "W5_product_archive",
           "W9_new_purchase_orders", "W10_purchase_orders", "W12_stock_ledger"]


@pytest.fixture(scope="module")
def large_dir():
    import pyarrow.compute as pc
    import pyarrow.parquet as pq
    out = tempfile.mkdtemp(prefix="mercato-large-")
    for name in DRIVER_VIEWS:
        t = pq.read_table(os.path.join(SF_SMALL, f"{name}.parquet"))
        for column in t.column_names:
            if column.endswith("_suppkey"):
                t = t.set_column(t.column_names.index(column), column, pc.add(pc.multiply(t[column], 1037), 5))
            if column.endswith("_partkey"):
                t = t.set_column(t.column_names.index(column), column, pc.add(t[column], 20_000_000))
        pq.write_table(t, os.path.join(out, f"{name}.parquet"))
    return out


def test_purchase_order_ids_are_unique(spark, large_dir):
    from mercato.sources.adapter import store_from_driver
    po = store_from_driver(spark, large_dir)["purchase_order"]
    assert po.count() == po.select("purchase_order_id").distinct().count() > 0


@pytest.mark.parametrize("name", QUERIES)
def test_large_keys_match_oracle(spark, large_dir, name):
    df = entry.queries()[name](spark, large_dir)
    s = digest(df.columns, [tuple(r) for r in df.collect()])
    cur = duck_connect(large_dir).execute(entry.oracle_sql()[name])
    o = digest([d[0] for d in cur.description], cur.fetchall())
    assert (s[0], s[1]) == (o[0], o[1])
    assert s[2] == o[2], f"{sorted(set(s[3]) - set(o[3]))[:3]} vs {sorted(set(o[3]) - set(s[3]))[:3]}"
