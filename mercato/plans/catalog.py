"""Registered queries: one entry per operator of the inventory, each a ``(spark, sf_dir) ->
DataFrame`` over the store built from the driver's tables.

Search parameters are fixed per entry (one entry per attribute *kind*). Request frames (ids,
(order, employee) pairs) are derived from the driver's tables, so their size grows with the data.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mercato.plans import customer as C
from mercato.plans import employee as E
from mercato.plans import listings as L
from mercato.plans import management as M
from mercato.sources.adapter import Store, store_from_driver

Query = Callable[[SparkSession, str], DataFrame]

# ---- fixed search parameters of the registered listing variants --------------------------------
CITY_TEXT = "nation_1"
FLAG_TEXT = "inactive"
EMPLOYEE_TYPE_TEXT = "hourly"
ROLE_TEXT = "manager"
ORDER_TOTAL_TEXT = "0"
ORDER_STATUS_TEXT = "delayed"
CUSTOMER_ID_TEXT = "1"
CUSTOMER_NAME_TEXT = "customer#%5"
SUPPLIER_ID_TEXT = "7"
PRODUCT_NAME_TEXT = "BLUE%brand#1"
STOCK_TEXT = "17"
SUPPLIER_NAME_TEXT = "supplier#00000001"
PO_STATUS_TEXT = "pending"
PO_FLAG_TEXT = "false"
CATEGORY_TEXT = "promo"
PRICE_TEXT = "900.10"
EMPLOYEE_ORDER_STATUS_TEXT = "COMPLETED"
KEYWORD_TEXT = "red"
EMPLOYEE_ORDER_TOTAL_TEXT = "9483349.94"


def _s(fn: Callable[[Store], DataFrame]) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(store_from_driver(spark, sf_dir))
    run.__doc__ = fn.__doc__
    return run


def order_employee_requests(store: Store) -> DataFrame:
    """Requests to view an order's lines as an employee: every driver order, asked by the
    employee whose id equals the order key modulo 25 (only some of them own the order)."""
    o = store.driver["orders"]
    return o.select(F.col("o_orderkey").alias("order_id"), (F.col("o_orderkey") % 25).alias("employee_id"))


def supplier_requests(store: Store) -> DataFrame:
    """Supplier ids asked about: for every part its key modulo one and a half times the suppliers'
    key range, so that every supplier can be asked for and some ids do not exist."""
    span = store.driver["supplier"].agg(F.floor(F.max("s_suppkey") * 1.5) + 1).scalar()
    return store.driver["part"].select((F.col("p_partkey") % span).alias("supplier_id"))


QUERIES: dict[str, Query] = {
    # customer profile
    "R1_order_count": _s(C.order_count),
    "R2_total_spent": _s(C.total_spent),
    "R3_last_order_date": _s(C.last_order_date),
    "R4_items_ordered": _s(C.items_ordered),
    "R5_favourite_category": _s(C.favourite_category),
    "R6_distinct_products": _s(C.distinct_products),
    "R7_top_product": _s(C.top_product),
    "R8_avg_order_value": _s(C.avg_order_value),
    "R9_spend_rank": _s(C.spend_rank),
    "R10_customer_profile": _s(C.customer_profile),
    # management report
    "R11_kpis": _s(M.kpis),
    "R12_pending_deliveries": _s(M.pending_deliveries),
    "R13_total_revenue": _s(M.total_revenue),
    "R14_team_roster": _s(M.team_roster),
    "R15_top_spenders": _s(M.top_spenders),
    "R16_oldest_purchase_orders": _s(M.oldest_purchase_orders),
    "R17_pay_summary": _s(M.pay_summary),
    "R18_first_manager": _s(M.first_manager),
    "R19_best_sellers": _s(M.best_sellers),
    "R20_lowest_priced_products": _s(M.lowest_priced_products),
    "R21_customer_spending": _s(M.customer_spending),
    # employee report
    "R22_orders_handled": _s(E.orders_handled),
    "R23_sales_value": _s(E.sales_value),
    "R24_purchase_orders_made": _s(E.purchase_orders_made),
    "R25_handled_lines": _s(E.handled_lines),
    "R26_pay_info": _s(E.pay_info),
    "R27_min_line_value": _s(E.min_line_value),
    "R28_min_value_handlers": _s(E.min_value_handlers),
    "R29_avg_line_value": _s(E.avg_line_value),
    "R30_busiest_employees": _s(E.busiest_employees),
    # listings
    "R31_list_customers": _s(L.list_customers),
    "R31_list_customers_by_city": _s(lambda st: L.list_customers(st, "city", CITY_TEXT)),
    "R31_list_customers_by_flag": _s(lambda st: L.list_customers(st, "is_valid", FLAG_TEXT)),
    "R31_list_customers_by_name": _s(lambda st: L.list_customers(st, "customer_name", CUSTOMER_NAME_TEXT)),
    "R32_list_employees": _s(L.list_employees),
    "R32_list_employees_by_type": _s(lambda st: L.list_employees(st, "employee_type", EMPLOYEE_TYPE_TEXT)),
    "R32_list_employees_by_role": _s(lambda st: L.list_employees(st, "emp_role", ROLE_TEXT)),
    "R32_list_employees_by_contract": _s(lambda st: L.list_employees(st, "employee_type", "contract")),
    "R32_list_employees_by_no_type": _s(lambda st: L.list_employees(st, "employee_type", "regular")),
    "R33_list_orders": _s(L.list_orders),
    "R33_list_orders_by_total": _s(lambda st: L.list_orders(st, "total_price", ORDER_TOTAL_TEXT)),
    "R33_list_orders_by_status": _s(lambda st: L.list_orders(st, "status", ORDER_STATUS_TEXT)),
    "R33_list_orders_by_customer": _s(lambda st: L.list_orders(st, "customer_id", CUSTOMER_ID_TEXT)),
    "R33_list_orders_in_cart": _s(lambda st: L.list_orders(st, "status", "cart")),
    "R33_list_orders_completed": _s(lambda st: L.list_orders(st, "status", "completed")),
    "R34_list_suppliers": _s(L.list_suppliers),
    "R34_list_suppliers_by_name": _s(lambda st: L.list_suppliers(st, "supplier_name", SUPPLIER_NAME_TEXT)),
    "R34_list_suppliers_by_flag": _s(lambda st: L.list_suppliers(st, "is_valid", FLAG_TEXT)),
    "R35_order_lines": _s(L.order_lines),
    "R36_list_purchase_orders": _s(L.list_purchase_orders),
    "R36_list_purchase_orders_by_status": _s(lambda st: L.list_purchase_orders(st, "delivery_status", PO_STATUS_TEXT)),
    "R36_list_purchase_orders_by_flag": _s(lambda st: L.list_purchase_orders(st, "is_valid", PO_FLAG_TEXT)),
    "R36_list_purchase_orders_by_supplier": _s(lambda st: L.list_purchase_orders(st, "supplier_id", SUPPLIER_ID_TEXT)),
    "R37_purchase_order_lines": _s(L.purchase_order_lines),
    "R38_list_products": _s(L.list_products),
    "R38_list_products_by_category": _s(lambda st: L.list_products(st, "category", CATEGORY_TEXT)),
    "R38_list_products_by_price": _s(lambda st: L.list_products(st, "price", PRICE_TEXT)),
    "R38_list_products_by_name": _s(lambda st: L.list_products(st, "product_name", PRODUCT_NAME_TEXT)),
    "R38_list_products_by_stock": _s(lambda st: L.list_products(st, "stock_quantity", STOCK_TEXT)),
    "R38_list_products_by_flag": _s(lambda st: L.list_products(st, "is_valid", FLAG_TEXT)),
    "R39_list_employee_orders": _s(L.list_employee_orders),
    "R39_list_employee_orders_by_status": _s(
        lambda st: L.list_employee_orders(st, None, "status", EMPLOYEE_ORDER_STATUS_TEXT)),
    "R39_list_employee_orders_by_total": _s(
        lambda st: L.list_employee_orders(st, None, "total_price", EMPLOYEE_ORDER_TOTAL_TEXT)),
    "R39_list_employee_orders_by_customer": _s(
        lambda st: L.list_employee_orders(st, None, "customer_id", CUSTOMER_ID_TEXT)),
    "R40_employee_order_lines": _s(lambda st: L.employee_order_lines(st, order_employee_requests(st))),
    "R41_employee_with_manager": _s(E.employee_with_manager),
    "R42_employee_detail": _s(E.employee_detail),
    "R43_manager_choices": _s(E.manager_choices),
    "R44_acting_managers": _s(E.acting_managers),
    "R45_catalogue": _s(L.catalogue),
    "R45_keyword_search": _s(lambda st: L.keyword_search(st, KEYWORD_TEXT)),
    "R46_open_carts": _s(L.open_carts),
    "R47_supplier_check": _s(lambda st: L.supplier_check(st, supplier_requests(st))),
    "R48_order_status_manager": _s(lambda st: L.order_status_counts(st, "manager")),
    "R48_order_status_employee": _s(lambda st: L.order_status_counts(st, "employee")),
    "E_order_labels": _s(L.order_labels),
    "E_product_labels": _s(L.product_labels),
}
