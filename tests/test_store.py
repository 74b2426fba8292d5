"""Store I/O: staging on first use, change jobs on tables in parts, JSON sink."""

import contextlib
import datetime as dt
import io
import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from mercato.operators import changes as W
from mercato.plans import feeds
from mercato.sources import partitioned as P
from mercato.sources.adapter import adapted_store, store_from_driver
from mercato.sources.store import staged_store, to_json_lines, write_json


def same(a, b):
    a, b = a.select(sorted(a.columns)), b.select(sorted(b.columns))
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_tables_are_staged_on_first_use_with_their_buckets(spark):
    root = tempfile.mkdtemp(prefix="mercato-store-")
    base = adapted_store(spark, SF_SMALL)
    st = staged_store(base, root)
    assert os.listdir(root) == []
    assert same(st["order_details"], base["order_details"])
    assert os.listdir(root) == ["order_details"]
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        st["order_details"].groupBy("order_id").agg(F.sum("quantity")).explain()
    assert "Bucketed: true" in buf.getvalue()


def parted(spark, tables, parts=8):
    st = store_from_driver(spark, SF_SMALL)
    root = tempfile.mkdtemp(prefix="mercato-parts-")
    return st, P.PartitionedStore.create(spark, root, {t: st[t] for t in tables}, parts, st.driver)


def files(st, table):
    return {os.path.join(d, f) for d, _, names in os.walk(f"{st.root}/{table}") for f in names if f.endswith(".parquet")}


def test_a_patch_of_one_row_writes_one_part(spark):
    st, parts = parted(spark, ["product"])
    before = files(parts, "product")
    patch = feeds.product_patches(st).where("change_id = 21")
    rejects, written = P.apply_patches(parts, "product", patch)
    assert rejects.count() == 0 and len(written["product"]) == 1
    after = files(parts, "product")
    assert {f.split("_part=")[1].split("/")[0] for f in before ^ after} == {str(written["product"][0])}
    assert same(parts["product"], W.patch_rows(st, "product", patch)["product"])


@pytest.mark.parametrize("apply, job, tables", [
    (lambda p, st: P.apply_flags(p, "product", feeds.product_flags(st)),
     lambda st: W.set_active(st, "product", feeds.product_flags(st)), ["product"]),
    (lambda p, st: P.apply_flags(p, "employee", feeds.employee_deactivations(st)),
     lambda st: W.deactivate_employees(st, feeds.employee_deactivations(st)),
     ["employee", "hourly_employee", "contract_employee"]),
    (lambda p, st: P.apply_archive(p, feeds.product_deletes(st), feeds.AS_OF_ARCHIVE),
     lambda st: W.archive_delete_products(st, feeds.product_deletes(st), feeds.AS_OF_ARCHIVE),
     ["product", "product_archive", "order_details", "purchase_order_details"]),
    (lambda p, st: P.apply_purchase_status(p, feeds.purchase_status_updates(st).where("purchase_order_id % 50 = 7"), "receive"),
     lambda st: W.set_purchase_status(st, feeds.purchase_status_updates(st).where("purchase_order_id % 50 = 7"), "receive"),
     ["purchase_order", "product", "purchase_order_details"]),
    (lambda p, st: P.apply_type_changes(p, feeds.employee_type_changes(st)),
     lambda st: W.change_employee_type(st, feeds.employee_type_changes(st)),
     ["hourly_employee", "contract", "contract_employee", "employee"]),
    (lambda p, st: P.apply_inserts(p, "product", feeds.product_creates(st)),
     lambda st: W.insert_rows(st, "product", feeds.product_creates(st)), ["product"])])
def test_jobs_in_place_equal_jobs_on_whole_tables(spark, apply, job, tables):
    st, parts = parted(spark, tables)
    whole = job(st)
    rejects, _ = apply(parts, st)
    for t in tables:
        if t in whole:
            assert same(parts[t], whole[t]), t
    if rejects is not None:
        assert same(rejects, whole["rejects"])


def test_purchases_in_place(spark):
    st, parts = parted(spark, ["product", "supplier", "purchase_order", "purchase_order_details"])
    headers, items = feeds.purchase_requests(st)
    few = headers.where("change_id % 40 = 3")
    items = items.join(few.select("change_id"), "change_id", "left_semi")
    whole = W.create_purchase_orders(st, few, items, dt.date(1995, 6, 1))
    P.apply_purchases(parts, few, items, dt.date(1995, 6, 1))
    for t in ("product", "purchase_order", "purchase_order_details"):
        assert same(parts[t], whole[t]), t


def test_a_part_that_loses_its_last_row_is_removed(spark):
    st, parts = parted(spark, ["product", "product_archive", "order_details", "purchase_order_details"], parts=400)
    one = st["product"].where("product_id = 5").select("product_id")
    P.apply_archive(parts, one, dt.datetime(2024, 1, 1))
    assert parts["product"].where("product_id = 5").isEmpty() and parts["product"].count() == st["product"].count() - 1
    assert parts["order_details"].where("product_id = 5").isEmpty()
    assert parts["product_archive"].count() == 1


def test_nothing_is_written_for_an_empty_feed(spark):
    st, parts = parted(spark, ["product"])
    before = files(parts, "product")
    rejects, written = P.apply_flags(parts, "product", feeds.product_flags(st).limit(0))
    assert rejects.count() == 0 and written == {} and files(parts, "product") == before


def test_json_sink_writes_one_document_a_line(spark):
    path = tempfile.mkdtemp(prefix="mercato-json-") + "/out"
    st = store_from_driver(spark, SF_SMALL)
    write_json(st["supplier"], path)
    docs = [json.loads(r.value) for r in spark.read.text(path).collect()]
    assert {d["supplier_id"] for d in docs} == {r.supplier_id for r in st["supplier"].collect()}


def test_json_lines_dates_as_text_money_as_numbers(spark):
    df = spark.createDataFrame([(1, "2024-01-02", "12.50", None)], "id long, d string, m string, n string") \
        .select("id", F.to_date("d").alias("d"), F.col("m").cast("decimal(10,2)").alias("m"), "n")
    doc = json.loads(to_json_lines(df).first()["json"])
    assert doc == {"id": 1, "d": "2024-01-02", "m": 12.5, "n": None}
