"""Sorted queries deliver their rows in the declared order: the value hash of the oracle check
ignores it, so it is asserted here."""

import pytest

import __spark_entry__ as entry
from conftest import SF_SMALL

ASC, DESC = False, True
# query -> sort columns, each ascending with nulls first or descending with nulls last
ORDERS = {
    "R14_team_roster": [("manager_name", ASC), ("employee_name", ASC)],
    "R15_top_spenders": [("total_spent", DESC), ("customer_id", ASC)],
    "R16_oldest_purchase_orders": [("order_date", ASC), ("purchase_order_id", ASC)],
    "R21_customer_spending": [("total_amount_spent", DESC), ("customer_id", ASC)],
    "R24_purchase_orders_made": [("order_date", DESC), ("purchase_order_id", ASC)],
    "R25_handled_lines": [("order_date", DESC), ("order_id", ASC), ("product_id", ASC)],
    "R29_avg_line_value": [("employee_name", ASC)],
    "R31_list_customers": [("customer_id", ASC)],
    "R31_list_customers_by_city": [("customer_id", ASC)],
    "R32_list_employees": [("employee_id", ASC)],
    "R33_list_orders": [("order_date", ASC), ("order_id", ASC)],
    "R33_list_orders_by_total": [("order_date", ASC), ("order_id", ASC)],
    "R34_list_suppliers": [("supplier_id", ASC)],
    "R36_list_purchase_orders": [("order_date", ASC), ("purchase_order_id", ASC)],
    "R38_list_products": [("product_id", ASC)],
    "R39_list_employee_orders": [("order_date", DESC), ("order_id", ASC)],
    "R44_acting_managers": [("employee_name", ASC), ("employee_id", ASC)],
    "R45_catalogue": [("product_id", ASC)],
}


@pytest.mark.parametrize("name", sorted(ORDERS))
def test_rows_arrive_sorted(spark, name):
    df = entry.queries()[name](spark, SF_SMALL)
    columns = [c for c, _ in ORDERS[name] if c in df.columns]
    assert columns, f"{name} has none of its sort columns: {df.columns}"
    got = [tuple(r[c] for c in columns) for r in df.collect()]
    wanted = list(got)
    for i, (column, down) in reversed(list(enumerate(ORDERS[name][:len(columns)]))):
        wanted.sort(key=lambda r: (r[i] is not None, r[i] if r[i] is not None else 0), reverse=down)
    assert len(got) > 1 and got == wanted
