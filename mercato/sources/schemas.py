"""Store schemas: the 14 commerce tables as explicit StructTypes (no inference, no evolution).

Money is DECIMAL(10,2) as declared; passwords and card fields are never loaded.
"""

from __future__ import annotations

from pyspark.sql import types as T

MONEY = T.DecimalType(10, 2)
# Fixed output types used by every query (same text on the SQL oracle side):
# line values and per-row money -> DECIMAL(18,2); sums of money -> DECIMAL(38,2).
LINE_MONEY = T.DecimalType(18, 2)
SUM_MONEY = T.DecimalType(38, 2)


def _f(name, dtype, nullable=True):
    return T.StructField(name, dtype, nullable)


L, I, S, D, B, TS = T.LongType(), T.IntegerType(), T.StringType(), T.DateType(), T.BooleanType(), T.TimestampType()

SCHEMAS: dict[str, T.StructType] = {
    "customer": T.StructType([
        _f("customer_id", L, False), _f("customer_name", S, False), _f("phone_number", S),
        _f("email_address", S), _f("city", S), _f("shipping_address", S, False),
        _f("order_count", I), _f("is_valid", B, False)]),
    "employee": T.StructType([
        _f("employee_id", L, False), _f("employee_name", S, False), _f("emp_role", S),
        _f("phone_number", S), _f("email_address", S), _f("hire_date", D), _f("manager_id", L),
        _f("is_valid", B, False)]),
    "hourly_employee": T.StructType([
        _f("employee_id", L, False), _f("hours_worked", I, False), _f("hourly_wages", MONEY, False),
        _f("is_valid", B, False)]),
    "contract": T.StructType([
        _f("contract_id", L, False), _f("contract_start_date", D, False), _f("contract_end_date", D, False),
        _f("salary", MONEY, False), _f("is_valid", B, False)]),
    "contract_employee": T.StructType([
        _f("employee_id", L, False), _f("contract_id", L, False), _f("is_valid", B, False)]),
    "product": T.StructType([
        _f("product_id", L, False), _f("product_name", S, False), _f("category", S), _f("price", MONEY, False),
        _f("is_valid", B, False), _f("stock_quantity", I, False), _f("stock_arrival_date", D)]),
    "product_archive": T.StructType([
        _f("product_id", L, False), _f("product_name", S, False), _f("category", S), _f("price", MONEY),
        _f("stock_quantity", I), _f("stock_arrival_date", D), _f("archived_at", TS)]),
    "orders": T.StructType([
        _f("order_id", L, False), _f("customer_id", L, False), _f("employee_id", L), _f("order_date", D, False),
        _f("expected_received_date", D), _f("actual_received_date", D), _f("status", S, False),
        _f("is_valid", B, False)]),
    "order_details": T.StructType([
        _f("order_id", L, False), _f("product_id", L, False), _f("price", MONEY, False), _f("quantity", I, False),
        _f("is_valid", B, False)]),
    "supplier": T.StructType([
        _f("supplier_id", L, False), _f("supplier_name", S, False), _f("email_address", S),
        _f("phone_number", S), _f("is_valid", B, False)]),
    "purchase_order": T.StructType([
        _f("purchase_order_id", L, False), _f("employee_id", L, False), _f("supplier_id", L, False),
        _f("order_date", D, False), _f("expected_received_date", D), _f("actual_received_date", D),
        _f("delivery_status", S), _f("is_valid", B, False)]),
    "purchase_order_details": T.StructType([
        _f("purchase_order_id", L, False), _f("product_id", L, False), _f("price", MONEY, False),
        _f("quantity", I, False), _f("is_valid", B, False)]),
    "invoice": T.StructType([
        _f("invoice_id", L, False), _f("order_id", L, False), _f("invoice_date", D, False), _f("is_valid", B, False)]),
    "payment": T.StructType([
        _f("payment_id", L, False), _f("invoice_id", L, False), _f("payment_date", D, False),
        _f("amount_paid", MONEY, False), _f("payment_method", S, False), _f("is_valid", B, False)]),
}

# Primary keys (single and composite) and declared foreign keys, used by the validation jobs.
PRIMARY_KEYS: dict[str, list[str]] = {
    "customer": ["customer_id"], "employee": ["employee_id"], "hourly_employee": ["employee_id"],
    "contract": ["contract_id"], "contract_employee": ["employee_id"], "product": ["product_id"],
    "product_archive": ["product_id"], "orders": ["order_id"], "order_details": ["order_id", "product_id"],
    "supplier": ["supplier_id"], "purchase_order": ["purchase_order_id"],
    "purchase_order_details": ["purchase_order_id", "product_id"], "invoice": ["invoice_id"],
    "payment": ["payment_id"],
}

# (table, column) -> (parent table, parent column)
FOREIGN_KEYS: dict[tuple[str, str], tuple[str, str]] = {
    ("employee", "manager_id"): ("employee", "employee_id"),
    ("hourly_employee", "employee_id"): ("employee", "employee_id"),
    ("contract_employee", "employee_id"): ("employee", "employee_id"),
    ("contract_employee", "contract_id"): ("contract", "contract_id"),
    ("orders", "customer_id"): ("customer", "customer_id"),
    ("orders", "employee_id"): ("employee", "employee_id"),
    ("order_details", "order_id"): ("orders", "order_id"),
    ("order_details", "product_id"): ("product", "product_id"),
    ("purchase_order", "employee_id"): ("employee", "employee_id"),
    ("purchase_order", "supplier_id"): ("supplier", "supplier_id"),
    ("purchase_order_details", "purchase_order_id"): ("purchase_order", "purchase_order_id"),
    ("purchase_order_details", "product_id"): ("product", "product_id"),
    ("invoice", "order_id"): ("orders", "order_id"),
    ("payment", "invoice_id"): ("invoice", "invoice_id"),
}

# Fixed values that must equal the reference's declared CHECK lists and VARCHAR limits.
EMP_ROLES = ["Manager", "Assistant Manager", "Customer Service", "Procurement Specialist", "Inventory Specialist"]
DELIVERY_STATUSES = ["Pending", "Shipped", "Received"]
VARCHAR_LIMITS: dict[str, dict[str, int]] = {
    "customer": {"customer_name": 100, "phone_number": 20, "email_address": 100, "city": 50, "shipping_address": 200},
    "employee": {"employee_name": 100, "emp_role": 50, "phone_number": 20, "email_address": 100},
    "product": {"product_name": 100, "category": 50},
    "orders": {"status": 20},
    "supplier": {"supplier_name": 100, "email_address": 100, "phone_number": 20},
    "purchase_order": {"delivery_status": 50},
    "payment": {"payment_method": 50},
}

TABLES = list(SCHEMAS)
