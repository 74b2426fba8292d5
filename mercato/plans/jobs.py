"""Registered validation (V) and change (W) queries over feeds derived from the driver tables."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mercato.operators import changes as W
from mercato.operators import quality as V
from mercato.operators.carts import fold_carts, fold_carts_into_store
from mercato.operators.key_set import key_set, merged, size
from mercato.operators.timeline import price_history
from mercato.plans import dirty, feeds
from mercato.plans import listings as L
from mercato.plans.catalog import KEYWORD_TEXT, PRODUCT_NAME_TEXT, Query, _s
from mercato.plans.maintained import CustomerCounters
from mercato.session import shared_dir
from mercato.sources.adapter import Store
from mercato.sources.order_statistics import OrderStatistics
from mercato.sources.partitioned import PartitionedStore, apply_checkouts, apply_patches
from mercato.sources.store import bucket_count
from mercato.sources.text_index import TextIndex

INDEXED_NAME_TEXT = "0012"


# ---- validation -------------------------------------------------------------------------------
def duplicate_line_keys(store: Store) -> DataFrame:
    """V1 on the raw line feed: (order, product) pairs that arrive more than once."""
    f = feeds.raw_line_feed(store)
    return f.groupBy("order_id", "product_id").agg(F.count(F.lit(1)).alias("n_copies")).where("n_copies > 1")


def line_feed_violations(store: Store) -> DataFrame:
    """V1, V2, V3, V6 on the raw line feed, one row per (line, failed rule)."""
    f = feeds.raw_line_feed(store)
    f = V.with_duplicate_flag(f, ["order_id", "product_id"], "_dup")
    f = V.with_parent_bit(f, "order_id", store["orders"], "order_id", "_orphan_order")
    f = V.with_parent_bit(f, "product_id", store["product"], "product_id", "_orphan_product")
    rules = V.table_rules("order_details", ["order_id", "product_id", "price", "quantity"]) + [
        ("V1:primary_key:duplicate", F.col("_dup")),
        ("V3:order_id:orphan", F.col("_orphan_order")),
        ("V3:product_id:orphan", F.col("_orphan_product"))]
    _, bad = V.validate(f, rules)
    return V.violations(bad, ["order_id", "product_id", "line_number"])


def feed_key_counts(store: Store) -> DataFrame:
    """V3 over whole key sets: distinct orders and products of the line feed, of the store, and of
    both together (exact; the sets are built once each and merged)."""
    f = feeds.raw_line_feed(store)
    rows = []
    for column, parent in (("order_id", "orders"), ("product_id", "product")):
        sent, known = key_set(f, column), key_set(store[parent], column)
        rows += [size(keys).select(F.lit(column).alias("key"), F.lit(what).alias("of"), "n")
                 for what, keys in (("feed", sent), ("store", known), ("either", merged(sent, known)))]
    return reduce(DataFrame.unionByName, rows)


def _table_violations(table: str, contact: bool = False):
    return lambda st: V.table_violations(st, table, contact)


def _dirty_violations(table: str, rows, contact: bool = False):
    """The table's violations with its rows replaced by ones that break every rule."""
    return lambda st: V.table_violations(st.replace(**{table: rows(st)}), table, contact)


# ---- change jobs ------------------------------------------------------------------------------
def _products_patched(st: Store) -> DataFrame:
    return W.patch_rows(st, "product", feeds.product_patches(st))["product"]


def _patch_rejects(st: Store) -> DataFrame:
    return W.patch_rows(st, "product", feeds.product_patches(st))["rejects"]


def _products_flagged(st: Store) -> DataFrame:
    return W.set_active(st, "product", feeds.product_flags(st))["product"]


def _flag_rejects(st: Store) -> DataFrame:
    return W.set_active(st, "product", feeds.product_flags(st))["rejects"]


def _archive(st: Store) -> DataFrame:
    return W.archive_delete_products(st, feeds.product_deletes(st), feeds.AS_OF_ARCHIVE)["product_archive"]


def _maintained_profile(st: Store) -> DataFrame:
    """Profiles with ranks from counters that were built before products were deleted with their lines
    and brought up to date by deltas."""
    ids = feeds.product_deletes(st)
    out = W.archive_delete_products(st, ids, feeds.AS_OF_ARCHIVE)
    after = st.replace(product=out["product"], order_details=out["order_details"])
    root = f"{shared_dir(st.spark)}/mercato-counters/{uuid.uuid4().hex}"
    counters = CustomerCounters.create(st, f"{root}/counters", bucket_count(st.spark))
    spend = OrderStatistics.create(counters.totals(), f"{root}/spend", bucket_count(st.spark))
    hit = W.by_products(st["order_details"], ids.select("product_id").distinct(), "left_semi")
    counters.apply(st, after, hit.select("order_id"), spend)
    return counters.profile(after, spend=spend)


def _indexed(table: str, columns: list[str], patterns: dict[str, str], listing) -> Query:
    """A listing over the rows that a substring index, built over the whole table, lets through."""
    def run(st: Store) -> DataFrame:
        root = f"{shared_dir(st.spark)}/mercato-grams/{st.spark.sparkContext.applicationId}-{uuid.uuid4().hex[:12]}"
        index = TextIndex.create(_in_place(st, [table]), table, columns, root, bucket_count(st.spark))
        return listing(index.view(patterns, st))
    return _s(run)


def _lines_after_delete(st: Store) -> DataFrame:
    return W.archive_delete_products(st, feeds.product_deletes(st), feeds.AS_OF_ARCHIVE)["order_details"]


def _cart_fold(st: Store) -> dict[str, DataFrame]:
    return fold_carts(feeds.carts(st), st["product"])


def _stored_carts(st: Store) -> dict[str, DataFrame]:
    return fold_carts_into_store(st, feeds.carts(st))


def _busy_shop(st: Store) -> dict[str, DataFrame]:
    return fold_carts_into_store(st, feeds.busy_carts(st), price_changes=feeds.price_changes(st),
                                 restocks=feeds.restocks(st), check_stock=True)


def _unplaced_rejects(job: str):
    """The rejects of a job over its feed with requests that have no place in the order."""
    def run(st: Store) -> DataFrame:
        if job == "W2":
            return W.patch_rows(st, "product", feeds.with_unplaced(feeds.product_patches(st), "product_id"))["rejects"]
        if job == "W3":
            return W.set_active(st, "product", feeds.with_unplaced(feeds.product_flags(st), "product_id"))["rejects"]
        if job == "W4":
            return W.set_purchase_order_active(st, feeds.with_unplaced(
                feeds.purchase_order_deactivations(st), "purchase_order_id"))["rejects"]
        if job == "W7":
            return W.checkout_carts(st, feeds.with_unplaced(feeds.checkout_requests(st), "customer_id", 2, 20),
                                    feeds.AS_OF_CHECKOUT)["rejects"]
        if job == "W8":
            return W.set_order_status(st, feeds.with_unplaced(feeds.order_status_updates(st), "order_id"))["rejects"]
        return W.set_purchase_status(st, feeds.with_unplaced(feeds.purchase_status_updates(st), "purchase_order_id"),
                                     stock_on="receive")["rejects"]
    return run


def _in_place(st: Store, tables: list[str]) -> PartitionedStore:
    """A copy of ``tables`` in parts, in the shared folder, for a job that writes in place. As
    many parts as a shuffle starts with: at least one per 16 MB of lines. A table is read once for
    it, so it is not staged first."""
    root = f"{shared_dir(st.spark)}/mercato-parts/{st.spark.sparkContext.applicationId}-{uuid.uuid4().hex[:12]}"
    return PartitionedStore.create(st.spark, root, {t: st.unstaged(t) for t in tables}, bucket_count(st.spark), st.driver)


def _patched_in_place(st: Store) -> DataFrame:
    """W2 on a table in parts, which are replaced in place."""
    parts = _in_place(st, ["product"])
    apply_patches(parts, "product", feeds.product_patches(st))
    return parts["product"]


def _checked_out_in_place(table: str):
    def run(st: Store) -> DataFrame:
        parts = _in_place(st, ["orders", "order_details", "customer", "invoice", "payment"])
        apply_checkouts(parts, feeds.checkout_requests(st), feeds.AS_OF_CHECKOUT)
        return parts[table]
    return run


def _checkout(st: Store) -> dict[str, DataFrame]:
    return W.checkout_carts(st, feeds.checkout_requests(st), feeds.AS_OF_CHECKOUT)


def _new_payments(st: Store) -> DataFrame:
    return _checkout(st)["new_payments"]


def _purchase(st: Store) -> dict[str, DataFrame]:
    headers, items = feeds.purchase_requests(st)
    return W.create_purchase_orders(st, headers, items, feeds.AS_OF_PURCHASES)


def _switched_purchases(st: Store) -> dict[str, DataFrame]:
    return W.purchase_feed(st, *feeds.switched_purchases(st), feeds.AS_OF_PURCHASES, in_files=True)


def _new_purchase_orders(st: Store) -> DataFrame:
    return _purchase(st)["new_purchase_orders"]


def _status_changed_orders(st: Store) -> DataFrame:
    return W.set_order_status(st, feeds.order_status_updates(st))["orders"]


def _purchase_status(st: Store) -> dict[str, DataFrame]:
    return W.set_purchase_status(st, feeds.purchase_status_updates(st), stock_on="receive")


def _purchase_flags(st: Store) -> dict[str, DataFrame]:
    return W.set_purchase_order_active(st, feeds.purchase_order_deactivations(st))


def _type_changes(st: Store) -> dict[str, DataFrame]:
    return W.change_employee_type(st, feeds.employee_type_changes(st))


def _inserted(st: Store) -> dict[str, DataFrame]:
    return W.insert_rows(st, "product", feeds.product_creates(st))


def _employees(st: Store) -> dict[str, DataFrame]:
    return W.create_employees(st, feeds.employee_creates(st))


def _customer_flags(st: Store) -> dict[str, DataFrame]:
    return W.set_active(st, "customer", feeds.customer_flags(st))


JOB_QUERIES = {
    "W1_inserted_employees": _s(lambda st: _employees(st)["inserted"]),
    "W1_hourly_employees": _s(lambda st: _employees(st)["hourly_employee"]),
    "W1_contract_employees": _s(lambda st: _employees(st)["contract_employee"]),
    "W1_employee_rejects": _s(lambda st: _employees(st)["rejects"]),
    "W1_inserted_customers": _s(lambda st: W.insert_rows(st, "customer", feeds.customer_creates(st))["inserted"]),
    "W1_customer_rejects": _s(lambda st: W.insert_rows(st, "customer", feeds.customer_creates(st))["rejects"]),
    "W2_patched_suppliers": _s(lambda st: W.patch_rows(st, "supplier", feeds.supplier_patches(st))["supplier"]),
    "W2_supplier_rejects": _s(lambda st: W.patch_rows(st, "supplier", feeds.supplier_patches(st))["rejects"]),
    "W3_flagged_customers": _s(lambda st: _customer_flags(st)["customer"]),
    "W3_customer_rejects": _s(lambda st: _customer_flags(st)["rejects"]),
    "W1_inserted_products": _s(lambda st: _inserted(st)["inserted"]),
    "W1_insert_rejects": _s(lambda st: _inserted(st)["rejects"]),
    "W4_hourly_after_deactivation": _s(
        lambda st: W.deactivate_employees(st, feeds.employee_deactivations(st))["hourly_employee"]),
    "W4_employee_rejects": _s(lambda st: W.deactivate_employees(st, feeds.employee_deactivations(st))["rejects"]),
    "W4_purchase_lines_after": _s(lambda st: _purchase_flags(st)["purchase_order_details"]),
    "W4_purchase_orders_after": _s(lambda st: _purchase_flags(st)["purchase_order"]),
    "W4_purchase_order_rejects": _s(lambda st: _purchase_flags(st)["rejects"]),
    "V1_duplicate_line_keys": _s(duplicate_line_keys),
    "V_line_feed_violations": _s(line_feed_violations),
    "V3_feed_key_counts": _s(feed_key_counts),
    "V_employee_violations": _s(_table_violations("employee", contact=True)),
    "V_purchase_order_violations": _s(_table_violations("purchase_order")),
    "V_product_violations": _s(_table_violations("product")),
    "V_contract_violations": _s(_table_violations("contract")),
    "V_order_details_violations": _s(_table_violations("order_details")),
    "V_dirty_employee_violations": _s(_dirty_violations("employee", dirty.employees, contact=True)),
    "V_dirty_product_violations": _s(_dirty_violations("product", dirty.products)),
    "V_dirty_contract_violations": _s(_dirty_violations("contract", dirty.contracts)),
    "V_dirty_purchase_order_violations": _s(_dirty_violations("purchase_order", dirty.purchase_orders)),
    "V_dirty_order_details_violations": _s(_dirty_violations("order_details", dirty.order_details)),
    "V11_payment_mismatch": _s(V.payment_mismatch),
    "V11_line_price_drift": _s(V.line_price_drift),
    "V11_order_count_drift": _s(V.order_count_drift),
    "W2_patched_products": _s(_products_patched),
    "W2_patch_rejects": _s(_patch_rejects),
    "W3_flagged_products": _s(_products_flagged),
    "W3_flag_rejects": _s(_flag_rejects),
    "R31_indexed_customers_by_name": _indexed(
        "customer", ["customer_name", "city"], {"customer_name": f"%{INDEXED_NAME_TEXT}%"},
        lambda st: L.list_customers(st, "customer_name", INDEXED_NAME_TEXT)),
    "R38_indexed_products_by_name": _indexed(
        "product", ["product_name", "category"], {"product_name": f"%{PRODUCT_NAME_TEXT}%"},
        lambda st: L.list_products(st, "product_name", PRODUCT_NAME_TEXT)),
    "R45_indexed_keyword_search": _indexed(
        "product", ["product_name", "category"], {c: f"%{KEYWORD_TEXT}%" for c in ("product_name", "category")},
        lambda st: L.keyword_search(st, KEYWORD_TEXT)),
    "W5_product_archive": _s(_archive),
    "W5_lines_after_delete": _s(_lines_after_delete),
    "R10_maintained_profile": _s(_maintained_profile),
    "W6_cart_lines": _s(lambda st: _cart_fold(st)["cart_lines"]),
    "W6_cart_orders": _s(lambda st: _cart_fold(st)["cart_orders"]),
    "W6_stock_moves": _s(lambda st: _cart_fold(st)["stock_moves"]),
    "W6_store_orders": _s(lambda st: _stored_carts(st)["orders"]),
    "W6_store_lines": _s(lambda st: _stored_carts(st)["order_details"]),
    "W6_store_products": _s(lambda st: _stored_carts(st)["product"]),
    "W2_price_history": _s(lambda st: price_history(st["product"], feeds.price_changes(st))[0].where("valid_from IS NOT NULL")),
    "W6_busy_orders": _s(lambda st: _busy_shop(st)["orders"]),
    "W6_busy_lines": _s(lambda st: _busy_shop(st)["order_details"]),
    "W6_busy_products": _s(lambda st: _busy_shop(st)["product"]),
    "W6_busy_rejects": _s(lambda st: _busy_shop(st)["rejects"]),
    **{f"{job}_unplaced_rejects": _s(_unplaced_rejects(job)) for job in ("W2", "W3", "W4", "W7", "W8", "W10")},
    "W5_products_after_delete": _s(lambda st: W.archive_delete_products(
        st, feeds.product_deletes(st), feeds.AS_OF_ARCHIVE)["product"]),
    "W5_purchase_lines_after_delete": _s(lambda st: W.archive_delete_products(
        st, feeds.product_deletes(st), feeds.AS_OF_ARCHIVE)["purchase_order_details"]),
    "A7_patched_in_place": _s(_patched_in_place),
    "A7_checked_out_orders": _s(_checked_out_in_place("orders")),
    "A7_checked_out_invoices": _s(_checked_out_in_place("invoice")),
    "W7_checkout_lines": _s(lambda st: _checkout(st)["order_details"]),
    "W7_checkout_invoices": _s(lambda st: _checkout(st)["invoice"]),
    "W9_new_purchase_lines": _s(lambda st: _purchase(st)["new_lines"]),
    "W9_stocked_products": _s(lambda st: _purchase(st)["product"]),
    "W9_switched_orders": _s(lambda st: _switched_purchases(st)["new_purchase_orders"]),
    "W9_switched_products": _s(lambda st: _switched_purchases(st)["product"]),
    "W9_switched_rejects": _s(lambda st: _switched_purchases(st)["rejects"]),
    "W7_checkout_payments": _s(_new_payments),
    "W7_checkout_orders": _s(lambda st: _checkout(st)["orders"]),
    "W7_checkout_customers": _s(lambda st: _checkout(st)["customer"].select("customer_id", "order_count")),
    "W7_checkout_rejects": _s(lambda st: _checkout(st)["rejects"]),
    "W8_status_changed_orders": _s(_status_changed_orders),
    "W8_status_rejects": _s(lambda st: W.set_order_status(st, feeds.order_status_updates(st))["rejects"]),
    "W9_new_purchase_orders": _s(_new_purchase_orders),
    "W9_purchase_rejects": _s(lambda st: _purchase(st)["rejects"]),
    "W10_received_products": _s(lambda st: _purchase_status(st)["product"]),
    "W10_purchase_orders": _s(lambda st: _purchase_status(st)["purchase_order"]),
    "W10_purchase_rejects": _s(lambda st: _purchase_status(st)["rejects"]),
    "W11_hourly_after": _s(lambda st: _type_changes(st)["hourly_employee"]),
    "W11_contracts_after": _s(lambda st: _type_changes(st)["contract"]),
    "W11_rejects": _s(lambda st: _type_changes(st)["rejects"]),
    "W11_contract_employee_after": _s(lambda st: _type_changes(st)["contract_employee"]),
    "W12_stock_ledger": _s(W.stock_ledger),
    "W12_stock_ledger_on_receive": _s(lambda st: W.stock_ledger(st, stock_on="receive")),
}
