"""Hand-made store where each semantic note flips an answer."""

import datetime as dt
from decimal import Decimal

import pytest

from mercato.plans import customer as C
from mercato.plans import employee as E
from mercato.plans import listings as L
from mercato.plans import management as M
from mercato.sources.adapter import Store
from mercato.sources.schemas import SCHEMAS

D = Decimal
d = dt.date


def _store(spark, **rows):
    tables = {}
    for name, schema in SCHEMAS.items():
        df = spark.createDataFrame(rows.get(name, []), schema)
        tables[name] = (lambda df=df: df)
    return Store(spark, tables)


@pytest.fixture(scope="module")
def edge(spark):
    return _store(
        spark,
        customer=[(1, "Ann", None, None, "Oslo", "a", 0, True), (2, "Bob", None, None, "Rome", "b", 0, True),
                  (3, "Cy", None, None, "Oslo", "c", 0, True), (4, "Di", None, None, "Rome", "d", 0, False)],
        employee=[(1, "Max", "Manager", None, None, None, None, True),
                  (2, "Ada", "Assistant Manager", None, None, None, 1, True),
                  (3, "Sam", "Customer Service", None, None, None, 1, True),
                  (4, "Sam", "Customer Service", None, None, None, 1, True),
                  (5, "Eve", "Inventory Specialist", None, None, None, 1, False),
                  (6, "Ned", "Customer Service", None, None, None, 2, True)],
        hourly_employee=[(3, 40, D("10.00"), False), (6, 30, D("12.50"), True)],
        contract=[(7, d(2023, 1, 1), d(2023, 12, 31), D("50000.00"), True)],
        contract_employee=[(6, 7, True), (2, 7, True)],
        product=[(10, "widget", "A", D("5.00"), True, 5, None), (11, "widget", "B", D("7.00"), True, 5, None),
                 (12, "gear", "A", D("3.00"), True, 5, None)],
        orders=[(100, 1, 3, d(2024, 1, 1), d(2024, 1, 6), d(2024, 1, 5), "confirmed", True),
                (101, 1, 4, d(2024, 1, 2), d(2024, 1, 7), d(2024, 1, 9), "completed", True),
                (102, 2, None, d(2024, 1, 3), d(2024, 1, 8), None, "cart", True),
                (103, 2, None, d(2024, 1, 4), d(2024, 1, 9), None, "cart", True),
                (104, 2, None, d(2024, 1, 4), None, d(2024, 1, 9), "cart", True),
                (105, 4, 3, d(2024, 1, 4), d(2024, 1, 9), None, "cart", False)],
        order_details=[(100, 10, D("5.00"), 2, True), (100, 12, D("3.00"), 1, False),
                       (102, 11, D("7.00"), 3, True), (105, 10, D("5.00"), 9, True)],
        supplier=[(1, "S1", None, None, True)],
        purchase_order=[(1, 1, 1, d(2024, 1, 1), None, None, "pending", True),
                        (2, 1, 1, d(2024, 1, 2), None, None, "Pending", True),
                        (3, 1, 1, d(2024, 1, 3), None, None, "Pending", False)],
    )


def _by(df, key):
    return {r[key]: r for r in df.collect()}


def test_profile_scopes_defaults_and_rank(edge):
    p = _by(C.customer_profile(edge), "customer_id")
    # The profile counts the checked-out (inactive) line too
    assert p[1]["total_spent"] == D("13.00") and p[1]["items_ordered"] == 3
    # No orders -> zero / N/A defaults
    assert p[3]["order_count"] == 0 and p[3]["total_spent"] == D("0.00") and p[3]["top_product"] == "N/A"
    assert p[3]["favourite_category"] == "N/A" and p[3]["avg_order_value"] == 0.0
    # R8 averages over orders with lines only
    assert p[1]["avg_order_value"] == 13.0 and p[1]["order_count"] == 2
    # R9 dense rank: 21 > 13 > 0 (customers 3 and 4 share rank 3)
    assert [p[i]["spend_rank"] for i in (1, 2, 3, 4)] == [2, 1, 3, 3]
    assert p[1]["favourite_category"] == "A" and p[1]["top_product"] == "widget"


def test_employee_report_uses_active_lines(edge):
    v = _by(E.sales_value(edge), "employee_id")
    assert v[3]["total_sales_value"] == D("10.00")  # S2: inactive line left out
    assert v[5]["total_sales_value"] == D("0.00")


def test_pending_is_case_insensitive(edge):
    assert M.pending_deliveries(edge).first()["pending_deliveries"] == 2  # S1


def test_busiest_is_empty_when_unassigned_orders_lead(edge):
    # Three unassigned active orders beat every employee (Sam x2 by name is 2)
    assert E.busiest_employees(edge).count() == 0


def test_busiest_can_ignore_unassigned(edge):
    # without the unassigned group the threshold is 1 order per id; 'Sam' (two ids) has 2
    rows = E.busiest_employees(edge, ignore_unassigned=True).collect()
    assert [(r["employee_name"], r["order_count"]) for r in rows] == [("Sam", 2)]


def test_namesakes_group_by_name(edge):
    # Two 'Sam' ids are one group in the per-name average
    names = {r["employee_name"] for r in E.avg_line_value(edge).collect()}
    assert names == {"Sam"}


def test_best_sellers_all_ties_and_names(edge):
    # the order flag is not checked: per id product 10 sells 2 + 9 = 11 (the max), product 11
    # sells 3; the name 'widget' sums 11 + 3 = 14 >= 11, 'gear' has no active line
    rows = M.best_sellers(edge).collect()
    assert [(r["product_name"], r["total_quantity_sold"]) for r in rows] == [("widget", 14)]


def test_employee_types(edge):
    t = _by(L.list_employees(edge), "employee_id")
    assert t[6]["employee_type"] == "Hourly"      # S13: both subtypes -> Hourly
    assert t[3]["employee_type"] == "Regular"     # S14: inactive hourly row does not count
    assert t[2]["employee_type"] == "Contract"
    assert 5 not in t                             # inactive employee never listed
    assert L.list_employees(edge, "is_valid", "inactive").count() == 0


def test_team_roster_counts_active_reports(edge):
    rows = M.team_roster(edge).collect()
    # manager 1 has 3 active reports (2, 3, 4); manager 2 has one
    assert sorted(r["employee_name"] for r in rows) == ["Ada", "Sam", "Sam"]


def test_order_listing_status_and_total(edge):
    assert {r["order_id"] for r in L.list_orders(edge, "status", "delayed").collect()} == {101}
    assert {r["order_id"] for r in L.list_orders(edge, "status", "completed").collect()} == {100}
    # no expected date: neither completed nor delayed
    assert 104 not in {r["order_id"] for r in L.list_orders(edge, "status", "completed").collect()}
    zero = {r["order_id"] for r in L.list_orders(edge, "total_price", "0").collect()}
    assert zero == {101, 103, 104}
    # unknown attribute adds no condition
    assert L.list_orders(edge, "colour", "red").count() == 5


def test_status_texts(edge):
    m = _by(L.order_status(edge, "manager"), "order_id")
    assert m[100]["status_text"] == "Completed" and m[101]["status_text"] == "Delayed"
    assert m[102]["status_text"] == "Cart" and m[104]["status_text"] is None
    e = _by(L.order_status(edge, "employee"), "order_id")
    assert e[101]["status_text"] == "Completed (Delayed)" and e[100]["status_text"] == "Confirmed"


def test_search_wildcards_and_flags(edge):
    assert L.list_customers(edge, "customer_name", "_n").count() == 1      # '_' is a wildcard: Ann
    assert L.list_customers(edge, "is_valid", "no").count() == 1           # anything else is false
    assert L.list_products(edge).count() == 3
    assert L.list_purchase_orders(edge, "delivery_status", "PENDING").count() == 3
    assert L.list_purchase_orders(edge, "is_valid", "maybe").count() == 3  # tri-state: no filter


def test_profile_for_a_set_of_ids(spark, edge):
    ids = spark.createDataFrame([(1,), (3,)], "customer_id long")
    part = _by(C.customer_profile(edge, customer_ids=ids), "customer_id")
    full = _by(C.customer_profile(edge), "customer_id")
    assert sorted(part) == [1, 3]
    assert all(part[i] == full[i] for i in (1, 3))   # the rank still counts every customer
    lines = L.order_lines(edge, order_ids=spark.createDataFrame([(100,)], "order_id long")).collect()
    assert [(r["product_id"], r["order_total"], r["line_count"]) for r in lines] == [(10, D("10.00"), 1)]
