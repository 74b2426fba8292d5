"""Filtered, enriched listings.

Child counts and totals are aggregated on the child key first and then left-joined to the
parent (S8): the shuffle moves one row per parent instead of every child row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mercato.functions.expr import (NOT_RECEIVED, UNKNOWN_PRODUCT, active, active_label, delivery_status_text,
                                    employee_status_text, iso_date, label_if_null, line_value, money_text,
                                    text_equals, zero_if_null)
from mercato.functions.search import (SearchSpec, apply_search, by_flag, by_id, by_int, by_money, by_text,
                                      by_text_equal, by_tristate)
from mercato.operators.joins import lookup
from mercato.plans.common import Store, active_orders, by_order, order_totals
from mercato.plans.employee import typed_employees
from mercato.sources.schemas import SUM_MONEY

# ---- R31 customers ----------------------------------------------------------------------------
CUSTOMER_SEARCH = SearchSpec(attributes={
    "customer_id": by_id("customer_id"), "customer_name": by_text("customer_name"),
    "email_address": by_text("email_address"), "phone_number": by_text("phone_number"),
    "city": by_text("city"), "is_valid": by_flag()})


def list_customers(store: Store, search_by: str | None = None, value: str | None = None) -> DataFrame:
    """Customers with their active-order count (0 when none), by id."""
    c = apply_search(store["customer"].drop("order_count"), CUSTOMER_SEARCH, search_by, value)
    n = active_orders(store, "customer_id").groupBy("customer_id").agg(F.count(F.lit(1)).alias("order_count"))
    return (c.join(n, "customer_id", "left")
            .select("customer_id", "customer_name", "email_address", "phone_number", "city", "is_valid",
                    zero_if_null("order_count").alias("order_count"))
            .orderBy("customer_id"))


# ---- R32 employees ----------------------------------------------------------------------------
def _employee_type_pred(v: str):
    v = v.lower()
    if v == "hourly":
        return F.col("_he").isNotNull()
    if v == "contract":
        return F.col("_ce").isNotNull()
    return F.col("_he").isNull() & F.col("_ce").isNull()


EMPLOYEE_SEARCH = SearchSpec(attributes={
    "employee_id": by_id("employee_id"), "employee_name": by_text("employee_name"), "emp_role": by_text("emp_role"),
    "email_address": by_text("email_address"), "phone_number": by_text("phone_number"),
    "employee_type": _employee_type_pred, "is_valid": by_flag()})


def list_employees(store: Store, search_by: str | None = None, value: str | None = None) -> DataFrame:
    """Active employees with the type derived from active subtype rows, by id."""
    t = apply_search(typed_employees(store), EMPLOYEE_SEARCH, search_by, value)
    return (t.select("employee_id", "employee_name", "emp_role", "email_address", "phone_number", "hire_date",
                     "is_valid", "employee_type")
            .orderBy("employee_id"))


# ---- R33 orders (manager view) ----------------------------------------------------------------
def _order_status_pred(v: str):
    a, e = F.col("actual_received_date"), F.col("expected_received_date")
    if v == "cart":
        return a.isNull()
    if v == "completed":
        return a.isNotNull() & (a <= e)
    if v == "delayed":
        return a.isNotNull() & (a > e)
    return None


ORDER_SEARCH = SearchSpec(
    attributes={"order_id": by_id("order_id"), "customer_id": by_id("customer_id"),
                "total_price": by_money("total_price"), "status": _order_status_pred},
    base=lambda: F.col("is_valid"), after_aggregate={"total_price"})


def list_orders(store: Store, search_by: str | None = None, value: str | None = None) -> DataFrame:
    """Active orders with the value of their active lines (0 when none), oldest first.
    A search on the total runs after the aggregation (HAVING)."""
    o = apply_search(store["orders"], ORDER_SEARCH, search_by, value, stage="where")
    out = order_totals(store, "active", o, "left").select(
        "order_id", "customer_id", "employee_id", "order_date", "expected_received_date", "actual_received_date",
        F.coalesce(F.col("order_value"), F.lit(0)).cast(SUM_MONEY).alias("total_price"))
    out = apply_search(out, ORDER_SEARCH, search_by, value, stage="having")
    return out.orderBy(F.col("order_date").asc_nulls_first(), "order_id")


# ---- R34 suppliers ----------------------------------------------------------------------------
SUPPLIER_SEARCH = SearchSpec(attributes={
    "supplier_id": by_id("supplier_id"), "supplier_name": by_text("supplier_name"),
    "email_address": by_text("email_address"), "phone_number": by_text("phone_number"), "is_valid": by_flag()},
    default=lambda: F.col("is_valid"))


def list_suppliers(store: Store, search_by: str | None = None, value: str | None = None) -> DataFrame:
    """Suppliers with their active purchase-order count, by id; active ones by default."""
    s = apply_search(store["supplier"], SUPPLIER_SEARCH, search_by, value)
    n = active(store["purchase_order"]).groupBy("supplier_id").agg(F.count(F.lit(1)).alias("order_count"))
    return (s.join(n, "supplier_id", "left")
            .select("supplier_id", "supplier_name", "email_address", "phone_number", "is_valid",
                    zero_if_null("order_count").alias("order_count"))
            .orderBy("supplier_id"))


# ---- R35 order lines (manager view) -----------------------------------------------------------
def order_lines(store: Store, order_ids: DataFrame | None = None) -> DataFrame:
    """Active lines of active orders with product name ('Unknown Product' when the product
    row is missing), subtotal, and the order's total and line count. The order total is a
    grouped aggregate joined back on the order key (no per-order window)."""
    o = active_orders(store, "order_id")
    if order_ids is not None:
        o = lookup(o, order_ids, "order_id")

    def with_totals(li: DataFrame, o: DataFrame, small) -> DataFrame:
        li = (li.join(small(o), "order_id", "left_semi").select("order_id", "product_id", "price", "quantity")
              .withColumn("subtotal", line_value()))
        per_order = li.groupBy("order_id").agg(F.sum("subtotal").cast(SUM_MONEY).alias("order_total"),
                                               F.count(F.lit(1)).alias("line_count"))
        return li.join(small(per_order), "order_id")
    p = store["product"].select("product_id", "product_name")
    return (by_order(store, "active", o, with_totals).join(p, "product_id", "left")
            .select("order_id", "product_id", label_if_null("product_name", UNKNOWN_PRODUCT).alias("product_name"),
                    "price", "quantity", "subtotal", "order_total", "line_count"))


# ---- R36 purchase orders ----------------------------------------------------------------------
PURCHASE_ORDER_SEARCH = SearchSpec(attributes={
    "purchase_order_id": by_id("purchase_order_id"), "supplier_id": by_id("supplier_id"),
    "employee_id": by_id("employee_id"), "delivery_status": by_text_equal("delivery_status"),
    "is_valid": by_tristate()})


def list_purchase_orders(store: Store, search_by: str | None = None, value: str | None = None) -> DataFrame:
    """Purchase orders of any flag, oldest first."""
    po = apply_search(store["purchase_order"], PURCHASE_ORDER_SEARCH, search_by, value)
    return po.orderBy(F.col("order_date").asc_nulls_first(), "purchase_order_id")


# ---- R37 purchase-order lines -----------------------------------------------------------------
def purchase_order_lines(store: Store, purchase_order_ids: DataFrame | None = None) -> DataFrame:
    """Active purchase-order lines with product name (inner join)."""
    pod = active(store["purchase_order_details"])
    if purchase_order_ids is not None:
        pod = lookup(pod, purchase_order_ids, "purchase_order_id")
    p = store["product"].select("product_id", "product_name")
    return pod.join(p, "product_id").select("purchase_order_id", "product_id", "product_name", "price", "quantity")


# ---- R38 products -----------------------------------------------------------------------------
PRODUCT_SEARCH = SearchSpec(attributes={
    "product_id": by_id("product_id"), "product_name": by_text("product_name"), "category": by_text("category"),
    "price": by_money("price"), "stock_quantity": by_int("stock_quantity"), "is_valid": by_flag()},
    default=lambda: F.col("is_valid"))


def list_products(store: Store, search_by: str | None = None, value: str | None = None) -> DataFrame:
    """Products by id; active ones by default."""
    p = apply_search(store["product"], PRODUCT_SEARCH, search_by, value)
    return p.select("product_id", "product_name", "category", "price", "stock_quantity", "stock_arrival_date",
                    "is_valid").orderBy("product_id")


# ---- R39 orders of employees ------------------------------------------------------------------
def _all_lines_total_pred(v: str):
    return F.col("_total_all") == F.lit(v).cast(SUM_MONEY)


EMPLOYEE_ORDER_SEARCH = SearchSpec(attributes={
    "order_id": by_id("order_id"), "customer_id": by_id("customer_id"), "status": by_text_equal("status"),
    "total_price": _all_lines_total_pred}, base=lambda: F.col("is_valid"))


def list_employee_orders(store: Store, employee_ids: DataFrame | None = None, search_by: str | None = None,
                         value: str | None = None) -> DataFrame:
    """Active orders per employee with the value of active lines (0 when none), newest first.
    A search on the total compares the value of *all* lines (S3); no lines never matches."""
    o = store["orders"].where(F.col("employee_id").isNotNull())
    if employee_ids is not None:
        o = lookup(o, employee_ids, "employee_id")
    cols = o.columns
    o = order_totals(store, "active", o, "left").select(*cols, F.col("order_value").alias("_total_active"))
    if search_by == "total_price" and value:
        o = order_totals(store, "all", o, "left").select(
            *cols, "_total_active", F.col("order_value").alias("_total_all"))
    o = apply_search(o, EMPLOYEE_ORDER_SEARCH, search_by, value)
    return (o.select("order_id", "customer_id", "employee_id", "order_date", "expected_received_date",
                     "actual_received_date", "status", "is_valid",
                     F.coalesce(F.col("_total_active"), F.lit(0)).cast(SUM_MONEY).alias("total_price"))
            .orderBy(F.col("order_date").desc(), "order_id"))


# ---- R40 lines of an employee's orders ---------------------------------------------------------
def employee_order_lines(store: Store, pairs: DataFrame) -> DataFrame:
    """Active lines (with product name) of the requested orders, only where the order is
    active and belongs to the requested employee."""
    o = active_orders(store, "order_id", "employee_id").join(
        pairs.select("order_id", "employee_id"), ["order_id", "employee_id"], "left_semi")
    li = by_order(store, "active", o, lambda li, o, small: (
        li.select("order_id", "product_id", "price", "quantity").join(small(o), "order_id")))
    p = store["product"].select("product_id", "product_name")
    return li.join(p, "product_id").select(
        "employee_id", "order_id", "product_id", "product_name", "price", "quantity")


# ---- R45 catalogue and keyword search ---------------------------------------------------------
def catalogue(store: Store) -> DataFrame:
    """Active products, by id."""
    return (active(store["product"])
            .select("product_id", "product_name", "category", "price", "stock_quantity", "stock_arrival_date")
            .orderBy("product_id"))


def keyword_search(store: Store, keyword: str) -> DataFrame:
    """R45 (F4): products whose name or category contains the keyword; the flag is ignored."""
    p = store["product"]
    pattern = f"%{keyword}%"
    return p.where(F.col("product_name").ilike(pattern) | F.col("category").ilike(pattern))


# ---- R46 open carts ---------------------------------------------------------------------------
def open_carts(store: Store) -> DataFrame:
    """Lines of orders in state 'cart' (order flag not checked) with product, line value,
    and the cart's total and item count."""
    carts = store["orders"].where(text_equals("status", "cart")).select("order_id", "customer_id")

    def with_totals(li: DataFrame, carts: DataFrame, small) -> DataFrame:
        li = (li.select("order_id", "product_id", "quantity", "price").join(small(carts), "order_id")
              .withColumn("line_total", line_value()))
        per_cart = li.groupBy("order_id").agg(F.sum("line_total").cast(SUM_MONEY).alias("cart_total"),
                                              F.count(F.lit(1)).alias("item_count"))
        return li.join(small(per_cart), "order_id")
    p = store["product"].select("product_id", "product_name")
    return by_order(store, "active", carts, with_totals).join(p, "product_id").select(
        "customer_id", "order_id", "product_id", "product_name", "quantity", "price", "line_total",
        "cart_total", "item_count")


# ---- R47 supplier check -----------------------------------------------------------------------
def supplier_check(store: Store, supplier_ids: DataFrame) -> DataFrame:
    """For each requested id, whether the supplier exists and whether it is active."""
    ids = supplier_ids.select("supplier_id").distinct()
    s = store["supplier"].select("supplier_id", F.lit(True).alias("_hit"), F.col("is_valid").alias("_valid"))
    return ids.join(s, "supplier_id", "left").select(
        "supplier_id", F.coalesce("_hit", F.lit(False)).alias("exists"),
        F.coalesce("_valid", F.lit(False)).alias("is_valid"))


# ---- R48 order status -------------------------------------------------------------------------
def order_status(store: Store, variant: str = "manager") -> DataFrame:
    """Status text per active order: date-derived (manager page) or stored status with the
    late flag (employee page)."""
    o = active_orders(store)
    text = delivery_status_text() if variant == "manager" else employee_status_text()
    return o.select("order_id", "customer_id", "employee_id", "status", text.alias("status_text"))


def order_status_counts(store: Store, variant: str = "manager") -> DataFrame:
    """Number of active orders per status text."""
    return order_status(store, variant).groupBy("status_text").agg(F.count(F.lit(1)).alias("n_orders"))


# ---- display labels (E8, E10, E16) -------------------------------------------------------------
def product_labels(store: Store) -> DataFrame:
    """Products as the pages show them: Active/Inactive, price with two decimals and with
    thousands separators, arrival date as ISO text."""
    p = store["product"]
    return p.select("product_id", active_label().alias("status_label"), money_text("price").alias("price_text"),
                    money_text("price", thousands=True).alias("price_display"),
                    iso_date("stock_arrival_date").alias("arrival_text"))


def order_labels(store: Store) -> DataFrame:
    """Active orders as the pages show their dates: ISO text, 'Not received yet' where an order
    has no received date."""
    return active_orders(store).select(
        "order_id", iso_date("order_date").alias("order_date_text"),
        label_if_null(iso_date("actual_received_date"), NOT_RECEIVED).alias("received_text"))
