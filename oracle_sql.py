"""Independent SQL oracle (DuckDB dialect) for every registered query.

The driver's tables are pre-registered as views; the store tables are rebuilt here as ``st_*``
CTEs with the same fixed mapping rules as ``mercato.sources.adapter`` (written separately, in
SQL, so that the two sides do not share code). Unused CTEs are dropped by DuckDB.
"""

from __future__ import annotations

ADAPTER = {
    "st_customer": """SELECT c.c_custkey AS customer_id, c.c_name AS customer_name,
        CAST(NULL AS VARCHAR) AS phone_number, CAST(NULL AS VARCHAR) AS email_address, n.n_name AS city,
        c.c_mktsegment AS shipping_address, CAST(0 AS INTEGER) AS order_count, c.c_acctbal >= 0 AS is_valid
        FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey""",
    "st_employee": """SELECT CAST(n_nationkey AS BIGINT) AS employee_id, n_name AS employee_name,
        CASE WHEN n_nationkey < 2 THEN 'Manager' WHEN n_nationkey < 5 THEN 'Assistant Manager'
             WHEN n_nationkey < 15 THEN 'Customer Service' WHEN n_nationkey < 20 THEN 'Procurement Specialist'
             ELSE 'Inventory Specialist' END AS emp_role,
        CAST(NULL AS VARCHAR) AS phone_number, CAST(NULL AS VARCHAR) AS email_address, CAST(NULL AS DATE) AS hire_date,
        CAST(CASE WHEN n_nationkey < 5 THEN NULL WHEN n_nationkey < 13 THEN 0 WHEN n_nationkey < 19 THEN 1
                  WHEN n_nationkey < 23 THEN 2 WHEN n_nationkey < 24 THEN 3 ELSE 4 END AS BIGINT) AS manager_id,
        n_nationkey % 11 <> 10 AS is_valid FROM nation""",
    "st_hourly_employee": """SELECT CAST(n_nationkey AS BIGINT) AS employee_id, CAST(30 + n_nationkey % 11 AS INTEGER) AS hours_worked,
        CAST(12 + n_nationkey * 0.25 AS DECIMAL(10,2)) AS hourly_wages, n_nationkey <> 9 AS is_valid
        FROM nation WHERE n_nationkey % 3 = 0""",
    "st_contract": """SELECT CAST(n_nationkey AS BIGINT) AS contract_id, DATE '2023-01-01' AS contract_start_date,
        CAST(DATE '2023-12-31' + n_nationkey AS DATE) AS contract_end_date,
        CAST(40000 + n_nationkey * 1000 AS DECIMAL(10,2)) AS salary, n_nationkey <> 13 AS is_valid
        FROM nation WHERE n_nationkey % 3 = 1 OR n_nationkey = 6""",
    "st_contract_employee": """SELECT CAST(n_nationkey AS BIGINT) AS employee_id, CAST(n_nationkey AS BIGINT) AS contract_id,
        TRUE AS is_valid FROM nation WHERE n_nationkey % 3 = 1 OR n_nationkey = 6""",
    "st_product": """SELECT p_partkey AS product_id, p_name || ' ' || p_brand || ' ' || CAST(p_size AS VARCHAR) AS product_name,
        p_type AS category, CAST(p_retailprice AS DECIMAL(10,2)) AS price, p_size % 10 <> 0 AS is_valid,
        CAST(p_size AS INTEGER) AS stock_quantity, CAST(DATE '2024-01-01' + p_size AS DATE) AS stock_arrival_date FROM part""",
    "st_orders": """SELECT o_orderkey AS order_id, o_custkey AS customer_id,
        CASE WHEN o_orderkey % 50 = 7 THEN NULL ELSE CAST(o_custkey % 25 AS BIGINT) END AS employee_id,
        CAST(o_orderdate AS DATE) AS order_date, CAST(CAST(o_orderdate AS DATE) + 5 AS DATE) AS expected_received_date,
        CASE WHEN o_orderstatus = 'O' THEN NULL
             ELSE CAST(CAST(o_orderdate AS DATE) + CAST(o_orderkey % 11 AS INTEGER) AS DATE) END AS actual_received_date,
        CASE o_orderstatus WHEN 'P' THEN 'cart' WHEN 'O' THEN 'confirmed' WHEN 'F' THEN 'completed' END AS status,
        o_orderkey % 20 <> 0 AS is_valid FROM orders""",
    "st_order_details": """SELECT l_orderkey AS order_id, l_partkey AS product_id,
        MAX(CAST(l_extendedprice AS DECIMAL(10,2))) AS price, CAST(SUM(CAST(l_quantity AS INTEGER)) AS INTEGER) AS quantity,
        MIN(CASE WHEN l_returnflag = 'R' THEN 0 ELSE 1 END) = 1 AS is_valid
        FROM lineitem GROUP BY l_orderkey, l_partkey""",
    "st_supplier": """SELECT s_suppkey AS supplier_id, s_name AS supplier_name, CAST(NULL AS VARCHAR) AS email_address,
        CAST(NULL AS VARCHAR) AS phone_number, s_acctbal >= 0 AS is_valid FROM supplier""",
    "st_purchase_order": """SELECT l_orderkey * (SELECT max(s_suppkey) + 1 FROM supplier) + l_suppkey AS purchase_order_id, l_suppkey % 25 AS employee_id,
        l_suppkey AS supplier_id, MIN(CAST(l_shipdate AS DATE)) AS order_date,
        CAST(MIN(CAST(l_shipdate AS DATE)) + 10 AS DATE) AS expected_received_date,
        CASE WHEN MAX(l_linestatus) = 'F'
             THEN CAST(MIN(CAST(l_shipdate AS DATE)) + CAST(l_orderkey % 15 AS INTEGER) AS DATE) END AS actual_received_date,
        CASE WHEN MAX(l_linestatus) = 'F' THEN 'Received' WHEN MAX(l_returnflag) = 'R' THEN 'Shipped'
             WHEN l_orderkey % 2 = 0 THEN 'pending' ELSE 'Pending' END AS delivery_status,
        (l_orderkey * (SELECT max(s_suppkey) + 1 FROM supplier) + l_suppkey) % 20 <> 0 AS is_valid
        FROM lineitem GROUP BY l_orderkey, l_suppkey""",
    "st_purchase_order_details": """SELECT l_orderkey * (SELECT max(s_suppkey) + 1 FROM supplier) + l_suppkey AS purchase_order_id, l_partkey AS product_id,
        MAX(CAST(l_extendedprice AS DECIMAL(10,2))) AS price, CAST(SUM(CAST(l_quantity AS INTEGER)) AS INTEGER) AS quantity,
        TRUE AS is_valid FROM lineitem GROUP BY l_orderkey, l_suppkey, l_partkey""",
    "st_invoice": """SELECT o_orderkey AS invoice_id, o_orderkey AS order_id,
        CAST(CAST(o_orderdate AS DATE) + 1 AS DATE) AS invoice_date, TRUE AS is_valid FROM orders WHERE o_orderstatus = 'F'""",
    "st_payment": """SELECT o_orderkey AS payment_id, o_orderkey AS invoice_id,
        CAST(CAST(o_orderdate AS DATE) + 1 AS DATE) AS payment_date,
        CAST(o_totalprice AS DECIMAL(10,2)) AS amount_paid, o_orderpriority AS payment_method,
        o_orderkey % 40 <> 0 AS is_valid FROM orders WHERE o_orderstatus = 'F'""",
}


def with_store(body: str, extra: str = "", recursive: bool = False) -> str:
    ctes = ",\n".join(f"{name} AS ({sql})" for name, sql in ADAPTER.items())
    if extra:
        ctes += ",\n" + extra
    return f"WITH {'RECURSIVE ' if recursive else ''}{ctes}\n{body}"


LV = "CAST(od.price * od.quantity AS DECIMAL(18,2))"
M38 = "DECIMAL(38,2)"

# spend per customer over active orders, all lines
_CUST_TOTALS = f"""cust_totals AS (
    SELECT o.customer_id, SUM(od.price * od.quantity) AS total_spent, SUM(od.quantity) AS items,
           COUNT(DISTINCT o.order_id) AS n_orders
    FROM st_orders o JOIN st_order_details od ON o.order_id = od.order_id
    WHERE o.is_valid GROUP BY o.customer_id)"""
_FAV = """fav AS (
    SELECT customer_id, category FROM (
        SELECT customer_id, category, ROW_NUMBER() OVER (PARTITION BY customer_id ORDER BY freq DESC, category ASC) AS rn
        FROM (SELECT o.customer_id, p.category, COUNT(*) AS freq
              FROM st_orders o JOIN st_order_details od ON o.order_id = od.order_id
              JOIN st_product p ON od.product_id = p.product_id
              WHERE o.is_valid GROUP BY o.customer_id, p.category) t) r WHERE rn = 1)"""
_TOP = """topp AS (
    SELECT customer_id, product_name FROM (
        SELECT customer_id, product_name, ROW_NUMBER() OVER (PARTITION BY customer_id ORDER BY total DESC, product_name ASC) AS rn
        FROM (SELECT o.customer_id, p.product_name, SUM(od.quantity) AS total
              FROM st_orders o JOIN st_order_details od ON o.order_id = od.order_id
              JOIN st_product p ON od.product_id = p.product_id
              WHERE o.is_valid GROUP BY o.customer_id, p.product_name) t) r WHERE rn = 1)"""
_DISTINCT = """dprod AS (
    SELECT o.customer_id, COUNT(DISTINCT od.product_id) AS n
    FROM st_orders o JOIN st_order_details od ON o.order_id = od.order_id
    WHERE o.is_valid GROUP BY o.customer_id)"""
_AVG = """avgv AS (
    SELECT customer_id, CAST(SUM(total) AS DOUBLE) / COUNT(*) AS v FROM (
        SELECT o.customer_id, o.order_id, SUM(od.price * od.quantity) AS total
        FROM st_orders o JOIN st_order_details od ON o.order_id = od.order_id
        WHERE o.is_valid GROUP BY o.customer_id, o.order_id) t GROUP BY customer_id)"""
_RANK = f"""cust_all AS (
    SELECT c.customer_id, COALESCE(t.total_spent, 0) AS total_spent
    FROM st_customer c LEFT JOIN cust_totals t ON c.customer_id = t.customer_id),
rk AS (
    SELECT a.customer_id,
           CAST((SELECT COUNT(DISTINCT t.total_spent) FROM cust_totals t WHERE t.total_spent > a.total_spent) + 1 AS BIGINT) AS spend_rank
    FROM cust_all a)"""
_ORDER_STATS = """ostats AS (
    SELECT customer_id, COUNT(*) AS n, MAX(order_date) AS last_date FROM st_orders WHERE is_valid GROUP BY customer_id)"""

ORACLE: dict[str, str] = {}

ORACLE["R1_order_count"] = with_store(
    "SELECT c.customer_id, COALESCE(s.n, 0) AS order_count FROM st_customer c LEFT JOIN ostats s ON c.customer_id = s.customer_id",
    _ORDER_STATS)
ORACLE["R2_total_spent"] = with_store(
    f"SELECT c.customer_id, CAST(COALESCE(t.total_spent, 0) AS {M38}) AS total_spent "
    "FROM st_customer c LEFT JOIN cust_totals t ON c.customer_id = t.customer_id", _CUST_TOTALS)
ORACLE["R3_last_order_date"] = with_store(
    "SELECT c.customer_id, s.last_date AS last_order_date FROM st_customer c LEFT JOIN ostats s ON c.customer_id = s.customer_id",
    _ORDER_STATS)
ORACLE["R4_items_ordered"] = with_store(
    "SELECT c.customer_id, CAST(COALESCE(t.items, 0) AS BIGINT) AS items_ordered "
    "FROM st_customer c LEFT JOIN cust_totals t ON c.customer_id = t.customer_id", _CUST_TOTALS)
ORACLE["R5_favourite_category"] = with_store(
    "SELECT c.customer_id, COALESCE(f.category, 'N/A') AS favourite_category "
    "FROM st_customer c LEFT JOIN fav f ON c.customer_id = f.customer_id", _FAV)
ORACLE["R6_distinct_products"] = with_store(
    "SELECT c.customer_id, COALESCE(d.n, 0) AS distinct_products FROM st_customer c LEFT JOIN dprod d ON c.customer_id = d.customer_id",
    _DISTINCT)
ORACLE["R7_top_product"] = with_store(
    "SELECT c.customer_id, COALESCE(t.product_name, 'N/A') AS top_product FROM st_customer c LEFT JOIN topp t ON c.customer_id = t.customer_id",
    _TOP)
ORACLE["R8_avg_order_value"] = with_store(
    "SELECT c.customer_id, COALESCE(a.v, 0.0) AS avg_order_value FROM st_customer c LEFT JOIN avgv a ON c.customer_id = a.customer_id",
    _AVG)
ORACLE["R9_spend_rank"] = with_store("SELECT customer_id, spend_rank FROM rk", _CUST_TOTALS + ",\n" + _RANK)
ORACLE["R10_customer_profile"] = with_store(
    f"""SELECT c.customer_id, c.customer_name, c.phone_number, c.email_address, c.city, c.shipping_address, c.is_valid,
        COALESCE(s.n, 0) AS order_count, CAST(COALESCE(t.total_spent, 0) AS {M38}) AS total_spent,
        s.last_date AS last_order_date, CAST(COALESCE(t.items, 0) AS BIGINT) AS items_ordered,
        COALESCE(f.category, 'N/A') AS favourite_category, COALESCE(d.n, 0) AS distinct_products,
        COALESCE(tp.product_name, 'N/A') AS top_product, COALESCE(a.v, 0.0) AS avg_order_value, rk.spend_rank
    FROM st_customer c
    LEFT JOIN ostats s ON c.customer_id = s.customer_id
    LEFT JOIN cust_totals t ON c.customer_id = t.customer_id
    LEFT JOIN fav f ON c.customer_id = f.customer_id
    LEFT JOIN dprod d ON c.customer_id = d.customer_id
    LEFT JOIN topp tp ON c.customer_id = tp.customer_id
    LEFT JOIN avgv a ON c.customer_id = a.customer_id
    LEFT JOIN rk ON c.customer_id = rk.customer_id""",
    ",\n".join([_ORDER_STATS, _CUST_TOTALS, _FAV, _DISTINCT, _TOP, _AVG, _RANK]))

# ---- management report ----------------------------------------------------------------------
ORACLE["R11_kpis"] = with_store("""SELECT
    (SELECT COUNT(*) FROM st_employee WHERE is_valid) AS total_employees,
    (SELECT COUNT(*) FROM st_customer WHERE is_valid) AS total_customers,
    (SELECT COUNT(*) FROM st_supplier WHERE is_valid) AS total_suppliers,
    (SELECT COUNT(*) FROM st_orders WHERE is_valid) AS total_orders,
    (SELECT COUNT(*) FROM st_purchase_order WHERE is_valid) AS total_purchase_orders,
    (SELECT COUNT(*) FROM st_product WHERE is_valid) AS total_products""")
ORACLE["R12_pending_deliveries"] = with_store(
    "SELECT COUNT(*) AS pending_deliveries FROM st_purchase_order WHERE lower(delivery_status) = 'pending' AND is_valid")
ORACLE["R13_total_revenue"] = with_store(
    f"SELECT CAST(SUM(amount_paid) AS {M38}) AS total_revenue FROM st_payment WHERE is_valid")
ORACLE["R14_team_roster"] = with_store("""SELECT m.employee_name AS manager_name, e.employee_name AS employee_name, e.emp_role
    FROM st_employee e JOIN st_employee m ON m.employee_id = e.manager_id
    WHERE e.is_valid AND e.manager_id IN (
        SELECT manager_id FROM st_employee WHERE is_valid GROUP BY manager_id HAVING COUNT(*) > 2)
    ORDER BY m.employee_name, e.employee_name""")
ORACLE["R15_top_spenders"] = with_store(f"""SELECT c.customer_id, c.customer_name,
        CAST(SUM(od.price * od.quantity) AS {M38}) AS total_spent
    FROM st_customer c, st_orders o, st_order_details od
    WHERE c.customer_id = o.customer_id AND o.order_id = od.order_id AND c.is_valid AND o.is_valid
    GROUP BY c.customer_id, c.customer_name
    ORDER BY total_spent DESC, c.customer_id ASC LIMIT 4""")
ORACLE["R16_oldest_purchase_orders"] = with_store("""SELECT s.supplier_name, p.purchase_order_id, p.order_date, p.delivery_status
    FROM st_purchase_order p, st_supplier s
    WHERE p.supplier_id = s.supplier_id AND p.is_valid AND s.is_valid
    ORDER BY p.order_date ASC NULLS FIRST, p.purchase_order_id ASC LIMIT 3""")
ORACLE["R17_pay_summary"] = with_store("""SELECT e.employee_name, 'Hourly' AS type,
        '$' || CAST(he.hourly_wages AS VARCHAR) AS salary_or_wage,
        '$' || CAST(he.hours_worked * he.hourly_wages AS VARCHAR) AS total_wage
    FROM st_hourly_employee he, st_employee e WHERE he.is_valid AND he.employee_id = e.employee_id
    UNION
    SELECT e.employee_name, 'Contract' AS type, '$' || CAST(c.salary AS VARCHAR) AS salary_or_wage,
        CAST(NULL AS VARCHAR) AS total_wage
    FROM st_contract_employee ce, st_contract c, st_employee e
    WHERE ce.is_valid AND c.is_valid AND ce.contract_id = c.contract_id AND ce.employee_id = e.employee_id""")
ORACLE["R18_first_manager"] = with_store(
    "SELECT * FROM st_employee WHERE emp_role ILIKE '%manager%' ORDER BY employee_id LIMIT 1")
ORACLE["R19_best_sellers"] = with_store("""SELECT p.product_name, CAST(SUM(od.quantity) AS BIGINT) AS total_quantity_sold
    FROM st_order_details od JOIN st_product p ON od.product_id = p.product_id
    WHERE od.is_valid AND p.is_valid
    GROUP BY p.product_name
    HAVING SUM(od.quantity) >= ALL (SELECT SUM(quantity) FROM st_order_details WHERE is_valid GROUP BY product_id)""")
ORACLE["R20_lowest_priced_products"] = with_store("""SELECT DISTINCT p.product_name
    FROM st_order_details od JOIN st_product p ON od.product_id = p.product_id
    WHERE od.is_valid AND od.price = (SELECT MIN(price) FROM st_order_details WHERE is_valid)""")
ORACLE["R21_customer_spending"] = with_store(f"""SELECT c.customer_id, c.customer_name,
        COUNT(DISTINCT o.order_id) AS total_orders, CAST(SUM(od.price * od.quantity) AS {M38}) AS total_amount_spent
    FROM st_customer c JOIN st_orders o ON c.customer_id = o.customer_id
    JOIN st_order_details od ON o.order_id = od.order_id
    WHERE o.is_valid AND od.is_valid
    GROUP BY c.customer_id, c.customer_name ORDER BY total_amount_spent DESC, c.customer_id""")

# ---- employee report ------------------------------------------------------------------------
ORACLE["R22_orders_handled"] = with_store("""SELECT e.employee_id,
        (SELECT COUNT(*) FROM st_orders o WHERE o.employee_id = e.employee_id AND o.is_valid) AS total_orders_handled
    FROM st_employee e""")
ORACLE["R23_sales_value"] = with_store(f"""SELECT e.employee_id, CAST(COALESCE((
        SELECT SUM(od.price * od.quantity) FROM st_orders o, st_order_details od
        WHERE o.order_id = od.order_id AND o.employee_id = e.employee_id AND o.is_valid AND od.is_valid), 0) AS {M38})
        AS total_sales_value
    FROM st_employee e""")
ORACLE["R24_purchase_orders_made"] = with_store("""SELECT po.employee_id, po.purchase_order_id, s.supplier_name, po.order_date,
        po.delivery_status
    FROM st_purchase_order po, st_supplier s WHERE po.supplier_id = s.supplier_id AND po.is_valid
    ORDER BY po.order_date DESC, po.purchase_order_id""")
ORACLE["R25_handled_lines"] = with_store(f"""SELECT o.employee_id, o.order_id, o.order_date, od.product_id, p.product_name,
        od.quantity, od.price, {LV} AS total_value
    FROM st_orders o, st_order_details od, st_product p
    WHERE o.order_id = od.order_id AND od.product_id = p.product_id AND o.employee_id IS NOT NULL
      AND o.is_valid AND od.is_valid
    ORDER BY o.order_date DESC, o.order_id, od.product_id""")
ORACLE["R26_pay_info"] = with_store("""SELECT he.employee_id, 'Hourly' AS type, he.hourly_wages AS salary_or_wage, he.hours_worked,
        CAST(he.hourly_wages * he.hours_worked AS DECIMAL(18,2)) AS total_pay
    FROM st_hourly_employee he WHERE he.is_valid
    UNION ALL
    SELECT ce.employee_id, 'Contract' AS type, c.salary AS salary_or_wage, CAST(NULL AS INTEGER) AS hours_worked,
        CAST(NULL AS DECIMAL(18,2)) AS total_pay
    FROM st_contract_employee ce, st_contract c
    WHERE ce.contract_id = c.contract_id AND ce.is_valid AND c.is_valid
      AND ce.employee_id NOT IN (SELECT employee_id FROM st_hourly_employee WHERE is_valid)""")
ORACLE["R27_min_line_value"] = with_store(
    "SELECT CAST(MIN(price * quantity) AS DECIMAL(18,2)) AS min_value FROM st_order_details WHERE is_valid")
ORACLE["R28_min_value_handlers"] = with_store(f"""SELECT DISTINCT e.employee_name, o.order_id, {LV} AS order_value
    FROM st_orders o JOIN st_order_details od ON o.order_id = od.order_id
    JOIN st_employee e ON o.employee_id = e.employee_id
    WHERE (od.price * od.quantity) = (SELECT MIN(price * quantity) FROM st_order_details WHERE is_valid)
      AND o.is_valid AND od.is_valid""")
ORACLE["R29_avg_line_value"] = with_store("""SELECT e.employee_name,
        CAST(SUM(od.price * od.quantity) AS DOUBLE) / COUNT(*) AS avg_order_value
    FROM st_employee e JOIN st_orders o ON e.employee_id = o.employee_id
    JOIN st_order_details od ON o.order_id = od.order_id
    WHERE o.is_valid AND od.is_valid GROUP BY e.employee_name ORDER BY e.employee_name""")
ORACLE["R30_busiest_employees"] = with_store("""SELECT e.employee_name, COUNT(*) AS order_count
    FROM st_orders o JOIN st_employee e ON o.employee_id = e.employee_id
    WHERE o.is_valid GROUP BY e.employee_name
    HAVING COUNT(*) >= ALL (SELECT COUNT(*) FROM st_orders WHERE is_valid GROUP BY employee_id)""")

# ---- listings -------------------------------------------------------------------------------
_LIST_CUSTOMERS = """SELECT c.customer_id, c.customer_name, c.email_address, c.phone_number, c.city, c.is_valid,
        COUNT(o.order_id) AS order_count
    FROM st_customer c LEFT JOIN st_orders o ON c.customer_id = o.customer_id AND o.is_valid
    {where} GROUP BY c.customer_id, c.customer_name, c.email_address, c.phone_number, c.city, c.is_valid
    ORDER BY c.customer_id"""
ORACLE["R31_list_customers"] = with_store(_LIST_CUSTOMERS.format(where=""))
ORACLE["R31_list_customers_by_city"] = with_store(_LIST_CUSTOMERS.format(where="WHERE c.city ILIKE '%nation_1%'"))
ORACLE["R31_list_customers_by_flag"] = with_store(_LIST_CUSTOMERS.format(where="WHERE c.is_valid = FALSE"))

_LIST_EMPLOYEES = """SELECT e.employee_id, e.employee_name, e.emp_role, e.email_address, e.phone_number, e.hire_date, e.is_valid,
        CASE WHEN he.employee_id IS NOT NULL THEN 'Hourly' WHEN ce.employee_id IS NOT NULL THEN 'Contract'
             ELSE 'Regular' END AS employee_type
    FROM st_employee e
    LEFT JOIN st_hourly_employee he ON e.employee_id = he.employee_id AND he.is_valid
    LEFT JOIN st_contract_employee ce ON e.employee_id = ce.employee_id AND ce.is_valid
    WHERE e.is_valid {cond} ORDER BY e.employee_id"""
ORACLE["R32_list_employees"] = with_store(_LIST_EMPLOYEES.format(cond=""))
ORACLE["R32_list_employees_by_type"] = with_store(_LIST_EMPLOYEES.format(cond="AND he.employee_id IS NOT NULL"))
ORACLE["R31_indexed_customers_by_name"] = with_store(_LIST_CUSTOMERS.format(where="WHERE c.customer_name ILIKE '%0012%'"))
ORACLE["R31_list_customers_by_name"] = with_store(_LIST_CUSTOMERS.format(where="WHERE c.customer_name ILIKE '%customer#%5%'"))
ORACLE["R32_list_employees_by_contract"] = with_store(_LIST_EMPLOYEES.format(cond="AND ce.employee_id IS NOT NULL"))
ORACLE["R32_list_employees_by_no_type"] = with_store(_LIST_EMPLOYEES.format(
    cond="AND he.employee_id IS NULL AND ce.employee_id IS NULL"))
ORACLE["R32_list_employees_by_role"] = with_store(_LIST_EMPLOYEES.format(cond="AND e.emp_role ILIKE '%manager%'"))

_LIST_ORDERS = f"""SELECT o.order_id, o.customer_id, o.employee_id, o.order_date, o.expected_received_date,
        o.actual_received_date, CAST(COALESCE(SUM(od.price * od.quantity), 0) AS {M38}) AS total_price
    FROM st_orders o LEFT JOIN st_order_details od ON o.order_id = od.order_id AND od.is_valid
    WHERE o.is_valid {{where}}
    GROUP BY o.order_id, o.customer_id, o.employee_id, o.order_date, o.expected_received_date, o.actual_received_date
    {{having}} ORDER BY o.order_date, o.order_id"""
ORACLE["R33_list_orders"] = with_store(_LIST_ORDERS.format(where="", having=""))
ORACLE["R33_list_orders_by_total"] = with_store(
    _LIST_ORDERS.format(where="", having="HAVING COALESCE(SUM(od.price * od.quantity), 0) = 0"))
ORACLE["R33_list_orders_by_status"] = with_store(_LIST_ORDERS.format(
    where="AND o.actual_received_date IS NOT NULL AND o.actual_received_date > o.expected_received_date", having=""))
ORACLE["R33_list_orders_in_cart"] = with_store(_LIST_ORDERS.format(where="AND o.actual_received_date IS NULL", having=""))
ORACLE["R33_list_orders_completed"] = with_store(_LIST_ORDERS.format(
    where="AND o.actual_received_date <= o.expected_received_date", having=""))
ORACLE["R33_list_orders_by_customer"] = with_store(_LIST_ORDERS.format(where="AND o.customer_id = 1", having=""))

_LIST_SUPPLIERS = """SELECT s.supplier_id, s.supplier_name, s.email_address, s.phone_number, s.is_valid,
        COUNT(po.purchase_order_id) AS order_count
    FROM st_supplier s LEFT JOIN st_purchase_order po ON s.supplier_id = po.supplier_id AND po.is_valid
    WHERE {where} GROUP BY s.supplier_id, s.supplier_name, s.email_address, s.phone_number, s.is_valid
    ORDER BY s.supplier_id"""
ORACLE["R34_list_suppliers"] = with_store(_LIST_SUPPLIERS.format(where="s.is_valid"))
ORACLE["R34_list_suppliers_by_flag"] = with_store(_LIST_SUPPLIERS.format(where="NOT s.is_valid"))
ORACLE["R34_list_suppliers_by_name"] = with_store(_LIST_SUPPLIERS.format(where="s.supplier_name ILIKE '%supplier#00000001%'"))

ORACLE["R35_order_lines"] = with_store(f"""SELECT od.order_id, od.product_id, COALESCE(p.product_name, 'Unknown Product') AS product_name,
        od.price, od.quantity, {LV} AS subtotal,
        CAST(SUM(od.price * od.quantity) OVER (PARTITION BY od.order_id) AS {M38}) AS order_total,
        COUNT(*) OVER (PARTITION BY od.order_id) AS line_count
    FROM st_order_details od LEFT JOIN st_product p ON od.product_id = p.product_id
    WHERE od.is_valid AND od.order_id IN (SELECT order_id FROM st_orders WHERE is_valid)""")

_LIST_PO = """SELECT purchase_order_id, employee_id, supplier_id, order_date, expected_received_date, actual_received_date,
        delivery_status, is_valid
    FROM st_purchase_order WHERE 1=1 {cond} ORDER BY order_date, purchase_order_id"""
ORACLE["R36_list_purchase_orders"] = with_store(_LIST_PO.format(cond=""))
ORACLE["R36_list_purchase_orders_by_status"] = with_store(_LIST_PO.format(cond="AND lower(delivery_status) = 'pending'"))
ORACLE["R36_list_purchase_orders_by_supplier"] = with_store(_LIST_PO.format(cond="AND supplier_id = 7"))
ORACLE["R36_list_purchase_orders_by_flag"] = with_store(_LIST_PO.format(cond="AND is_valid = FALSE"))

ORACLE["R37_purchase_order_lines"] = with_store("""SELECT pod.purchase_order_id, pod.product_id, p.product_name, pod.price, pod.quantity
    FROM st_purchase_order_details pod JOIN st_product p ON pod.product_id = p.product_id WHERE pod.is_valid""")

_LIST_PRODUCTS = """SELECT product_id, product_name, category, price, stock_quantity, stock_arrival_date, is_valid
    FROM st_product WHERE {where} ORDER BY product_id"""
ORACLE["R38_list_products"] = with_store(_LIST_PRODUCTS.format(where="is_valid"))
ORACLE["R38_list_products_by_category"] = with_store(_LIST_PRODUCTS.format(where="category ILIKE '%promo%'"))
ORACLE["R38_list_products_by_name"] = with_store(_LIST_PRODUCTS.format(where="product_name ILIKE '%blue%brand#1%'"))
ORACLE["R38_indexed_products_by_name"] = ORACLE["R38_list_products_by_name"]
ORACLE["R38_list_products_by_stock"] = with_store(_LIST_PRODUCTS.format(where="stock_quantity = 17"))
ORACLE["R38_list_products_by_flag"] = with_store(_LIST_PRODUCTS.format(where="NOT is_valid"))
ORACLE["R38_list_products_by_price"] = with_store(_LIST_PRODUCTS.format(where="price = 900.10"))

_LIST_EMP_ORDERS = f"""SELECT o.order_id, o.customer_id, o.employee_id, o.order_date, o.expected_received_date,
        o.actual_received_date, o.status, o.is_valid,
        CAST(COALESCE((SELECT SUM(od.price * od.quantity) FROM st_order_details od
                       WHERE od.order_id = o.order_id AND od.is_valid), 0) AS {M38}) AS total_price
    FROM st_orders o WHERE o.employee_id IS NOT NULL AND o.is_valid {{cond}}
    ORDER BY o.order_date DESC, o.order_id"""
ORACLE["R39_list_employee_orders"] = with_store(_LIST_EMP_ORDERS.format(cond=""))
ORACLE["R39_list_employee_orders_by_status"] = with_store(_LIST_EMP_ORDERS.format(cond="AND lower(o.status) = 'completed'"))
ORACLE["R39_list_employee_orders_by_customer"] = with_store(_LIST_EMP_ORDERS.format(cond="AND o.customer_id = 1"))
ORACLE["E_order_labels"] = with_store("""SELECT order_id, strftime(order_date, '%Y-%m-%d') AS order_date_text,
        COALESCE(strftime(actual_received_date, '%Y-%m-%d'), 'Not received yet') AS received_text
    FROM st_orders WHERE is_valid""")
ORACLE["R39_list_employee_orders_by_total"] = with_store(_LIST_EMP_ORDERS.format(
    cond="AND (SELECT SUM(od.price * od.quantity) FROM st_order_details od WHERE od.order_id = o.order_id) = 9483349.94"))

ORACLE["R40_employee_order_lines"] = with_store("""SELECT o.employee_id, od.order_id, od.product_id, p.product_name, od.price, od.quantity
    FROM st_orders o JOIN st_order_details od ON o.order_id = od.order_id JOIN st_product p ON od.product_id = p.product_id
    WHERE o.is_valid AND od.is_valid
      AND EXISTS (SELECT 1 FROM orders r WHERE r.o_orderkey = o.order_id AND r.o_orderkey % 25 = o.employee_id)""")
ORACLE["R41_employee_with_manager"] = with_store("""SELECT e.*, m.employee_name AS manager_name, m.email_address AS manager_email,
        he.hours_worked, he.hourly_wages, ce.contract_id
    FROM st_employee e LEFT JOIN st_employee m ON e.manager_id = m.employee_id
    LEFT JOIN st_hourly_employee he ON e.employee_id = he.employee_id
    LEFT JOIN st_contract_employee ce ON e.employee_id = ce.employee_id""")
ORACLE["R42_employee_detail"] = with_store("""SELECT e.*, t.employee_type,
        CASE WHEN t.employee_type = 'Hourly' THEN h.hours_worked END AS hours_worked,
        CASE WHEN t.employee_type = 'Hourly' THEN h.hourly_wages END AS hourly_wages,
        CASE WHEN t.employee_type = 'Contract' THEN k.contract_start_date END AS contract_start_date,
        CASE WHEN t.employee_type = 'Contract' THEN k.contract_end_date END AS contract_end_date,
        CASE WHEN t.employee_type = 'Contract' THEN k.salary END AS salary
    FROM st_employee e
    JOIN (SELECT e2.employee_id, CASE WHEN he.employee_id IS NOT NULL THEN 'Hourly'
                 WHEN ce.employee_id IS NOT NULL THEN 'Contract' ELSE 'Regular' END AS employee_type
          FROM st_employee e2
          LEFT JOIN st_hourly_employee he ON e2.employee_id = he.employee_id AND he.is_valid
          LEFT JOIN st_contract_employee ce ON e2.employee_id = ce.employee_id AND ce.is_valid) t
      ON e.employee_id = t.employee_id
    LEFT JOIN (SELECT employee_id, hours_worked, hourly_wages FROM st_hourly_employee WHERE is_valid) h
      ON e.employee_id = h.employee_id
    LEFT JOIN (SELECT ce.employee_id, c.contract_start_date, c.contract_end_date, c.salary
               FROM st_contract_employee ce JOIN st_contract c ON ce.contract_id = c.contract_id
               WHERE ce.is_valid AND c.is_valid) k ON e.employee_id = k.employee_id
    WHERE e.is_valid""")
ORACLE["R43_manager_choices"] = with_store("""SELECT employee_id, employee_name FROM st_employee
    WHERE is_valid AND emp_role ILIKE '%manager%' ORDER BY employee_name, employee_id""")
ORACLE["R44_acting_managers"] = with_store("""SELECT * FROM st_employee
    WHERE lower(emp_role) IN ('manager', 'assistant manager')
      AND employee_id IN (SELECT DISTINCT manager_id FROM st_employee WHERE manager_id IS NOT NULL)""")
ORACLE["R45_catalogue"] = with_store("""SELECT product_id, product_name, category, price, stock_quantity, stock_arrival_date
    FROM st_product WHERE is_valid ORDER BY product_id""")
ORACLE["R45_keyword_search"] = with_store(
    "SELECT * FROM st_product WHERE product_name ILIKE '%red%' OR category ILIKE '%red%'")
ORACLE["R45_indexed_keyword_search"] = ORACLE["R45_keyword_search"]
ORACLE["R46_open_carts"] = with_store(f"""SELECT o.customer_id, od.order_id, od.product_id, p.product_name, od.quantity, od.price,
        {LV} AS line_total,
        CAST(SUM(od.price * od.quantity) OVER (PARTITION BY od.order_id) AS {M38}) AS cart_total,
        COUNT(*) OVER (PARTITION BY od.order_id) AS item_count
    FROM st_orders o JOIN st_order_details od ON o.order_id = od.order_id
    JOIN st_product p ON od.product_id = p.product_id
    WHERE lower(o.status) = 'cart' AND od.is_valid""")
ORACLE["R47_supplier_check"] = with_store("""SELECT r.supplier_id, s.supplier_id IS NOT NULL AS "exists",
        COALESCE(s.is_valid, FALSE) AS is_valid
    FROM (SELECT DISTINCT p_partkey % (SELECT CAST(floor(max(s_suppkey) * 1.5) AS BIGINT) + 1 FROM supplier) AS supplier_id FROM part) r
    LEFT JOIN st_supplier s ON r.supplier_id = s.supplier_id""")
ORACLE["R48_order_status_manager"] = with_store("""SELECT CASE WHEN actual_received_date IS NULL THEN 'Cart'
        WHEN actual_received_date <= expected_received_date THEN 'Completed'
        WHEN actual_received_date > expected_received_date THEN 'Delayed' END AS status_text,
        COUNT(*) AS n_orders
    FROM st_orders WHERE is_valid GROUP BY 1""")
ORACLE["R48_order_status_employee"] = with_store("""SELECT CASE
        WHEN status IS NOT NULL AND status <> '' THEN
            upper(substr(status, 1, 1)) || substr(status, 2)
            || CASE WHEN status = 'completed' AND actual_received_date IS NOT NULL AND expected_received_date IS NOT NULL
                         AND actual_received_date > expected_received_date THEN ' (Delayed)' ELSE '' END
        WHEN actual_received_date IS NULL THEN 'Pending'
        WHEN actual_received_date <= expected_received_date THEN 'Completed'
        ELSE 'Delayed' END AS status_text,
        COUNT(*) AS n_orders
    FROM st_orders WHERE is_valid GROUP BY 1""")

# ---- validation jobs --------------------------------------------------------------------------
_FEED = """feed AS (SELECT l_orderkey AS order_id, l_partkey AS product_id, l_linenumber AS line_number,
        CAST(l_extendedprice AS DECIMAL(10,2)) AS price, CAST(l_quantity AS INTEGER) AS quantity FROM lineitem)"""
ORACLE["V1_duplicate_line_keys"] = """SELECT l_orderkey AS order_id, l_partkey AS product_id, COUNT(*) AS n_copies
    FROM lineitem GROUP BY l_orderkey, l_partkey HAVING COUNT(*) > 1"""
ORACLE["V3_feed_key_counts"] = with_store("\nUNION ALL ".join(
    f"""SELECT '{k}' AS key, 'feed' AS of, COUNT(DISTINCT {k}) AS n FROM feed
    UNION ALL SELECT '{k}', 'store', COUNT(DISTINCT {k}) FROM {t}
    UNION ALL SELECT '{k}', 'either', COUNT(DISTINCT {k}) FROM (SELECT {k} FROM feed UNION ALL SELECT {k} FROM {t}) b"""
    for k, t in (("order_id", "st_orders"), ("product_id", "st_product"))), _FEED)
ORACLE["V_line_feed_violations"] = with_store("""
    SELECT order_id, product_id, line_number, 'V2:order_id:null' AS reason FROM feed WHERE order_id IS NULL
    UNION ALL SELECT order_id, product_id, line_number, 'V2:product_id:null' FROM feed WHERE product_id IS NULL
    UNION ALL SELECT order_id, product_id, line_number, 'V2:price:null' FROM feed WHERE price IS NULL
    UNION ALL SELECT order_id, product_id, line_number, 'V2:quantity:null' FROM feed WHERE quantity IS NULL
    UNION ALL SELECT order_id, product_id, line_number, 'V6:price:range' FROM feed WHERE price <= 0
    UNION ALL SELECT order_id, product_id, line_number, 'V6:quantity:range' FROM feed WHERE quantity <= 0
    UNION ALL SELECT f.order_id, f.product_id, f.line_number, 'V1:primary_key:duplicate' FROM feed f
        JOIN (SELECT order_id, product_id FROM feed GROUP BY 1, 2 HAVING COUNT(*) > 1) d
          ON f.order_id = d.order_id AND f.product_id = d.product_id
    UNION ALL SELECT order_id, product_id, line_number, 'V3:order_id:orphan' FROM feed
        WHERE order_id IS NOT NULL AND order_id NOT IN (SELECT order_id FROM st_orders)
    UNION ALL SELECT order_id, product_id, line_number, 'V3:product_id:orphan' FROM feed
        WHERE product_id IS NOT NULL AND product_id NOT IN (SELECT product_id FROM st_product)""", _FEED)
ORACLE["V_employee_violations"] = with_store("""
    SELECT employee_id, 'V2:employee_name:length' AS reason FROM st_employee WHERE length(employee_name) > 100
    UNION ALL SELECT employee_id, 'V2:emp_role:length' FROM st_employee WHERE length(emp_role) > 50
    UNION ALL SELECT employee_id, 'V2:phone_number:length' FROM st_employee WHERE length(phone_number) > 20
    UNION ALL SELECT employee_id, 'V2:email_address:length' FROM st_employee WHERE length(email_address) > 100
    UNION ALL SELECT employee_id, 'V7:emp_role:domain' FROM st_employee
        WHERE lower(emp_role) NOT IN ('manager', 'assistant manager', 'customer service', 'procurement specialist',
                                      'inventory specialist')
    UNION ALL SELECT employee_id, 'V4:email_address:pattern' FROM st_employee
        WHERE NOT regexp_matches(email_address, '^[^\\s@]+@[^\\s@]+\\.[^\\s@]+$')
    UNION ALL SELECT employee_id, 'V5:phone_number:pattern' FROM st_employee WHERE NOT regexp_matches(phone_number, '^\\d{10}$')
    UNION ALL SELECT employee_id, 'V1:primary_key:duplicate' FROM st_employee
        WHERE employee_id IN (SELECT employee_id FROM st_employee GROUP BY 1 HAVING COUNT(*) > 1)
    UNION ALL SELECT employee_id, 'V3:manager_id:orphan' FROM st_employee
        WHERE manager_id IS NOT NULL AND manager_id NOT IN (SELECT employee_id FROM st_employee)
    UNION ALL SELECT employee_id, 'V3:manager_id:default' FROM st_employee WHERE manager_id = -1""")
ORACLE["V_purchase_order_violations"] = with_store("""
    SELECT purchase_order_id, 'V2:order_date:null' AS reason FROM st_purchase_order WHERE order_date IS NULL
    UNION ALL SELECT purchase_order_id, 'V2:delivery_status:length' FROM st_purchase_order WHERE length(delivery_status) > 50
    UNION ALL SELECT purchase_order_id, 'V7:delivery_status:domain' FROM st_purchase_order
        WHERE lower(delivery_status) NOT IN ('pending', 'shipped', 'received')
    UNION ALL SELECT purchase_order_id, 'V1:primary_key:duplicate' FROM st_purchase_order
        WHERE purchase_order_id IN (SELECT purchase_order_id FROM st_purchase_order GROUP BY 1 HAVING COUNT(*) > 1)
    UNION ALL SELECT purchase_order_id, 'V3:employee_id:orphan' FROM st_purchase_order
        WHERE employee_id NOT IN (SELECT employee_id FROM st_employee)
    UNION ALL SELECT purchase_order_id, 'V3:supplier_id:orphan' FROM st_purchase_order
        WHERE supplier_id NOT IN (SELECT supplier_id FROM st_supplier)""")
ORACLE["V_product_violations"] = with_store("""
    SELECT product_id, 'V2:product_name:length' AS reason FROM st_product WHERE length(product_name) > 100
    UNION ALL SELECT product_id, 'V2:category:length' FROM st_product WHERE length(category) > 50
    UNION ALL SELECT product_id, 'V6:price:range' FROM st_product WHERE price <= 0
    UNION ALL SELECT product_id, 'V6:stock_quantity:range' FROM st_product WHERE stock_quantity < 0
    UNION ALL SELECT product_id, 'V1:primary_key:duplicate' FROM st_product
        WHERE product_id IN (SELECT product_id FROM st_product GROUP BY 1 HAVING COUNT(*) > 1)""")
ORACLE["V_contract_violations"] = with_store("""
    SELECT contract_id, 'V6:salary:range' AS reason FROM st_contract WHERE salary <= 0
    UNION ALL SELECT contract_id, 'V8:contract:dates' FROM st_contract WHERE contract_start_date >= contract_end_date
    UNION ALL SELECT contract_id, 'V1:primary_key:duplicate' FROM st_contract
        WHERE contract_id IN (SELECT contract_id FROM st_contract GROUP BY 1 HAVING COUNT(*) > 1)""")
ORACLE["V_order_details_violations"] = with_store("""
    SELECT order_id, product_id, 'V6:price:range' AS reason FROM st_order_details WHERE price <= 0
    UNION ALL SELECT order_id, product_id, 'V6:quantity:range' FROM st_order_details WHERE quantity <= 0
    UNION ALL SELECT order_id, product_id, 'V1:primary_key:duplicate' FROM st_order_details
        WHERE (order_id, product_id) IN (SELECT (order_id, product_id) FROM st_order_details GROUP BY order_id, product_id
                                        HAVING COUNT(*) > 1)
    UNION ALL SELECT order_id, product_id, 'V3:order_id:orphan' FROM st_order_details
        WHERE order_id NOT IN (SELECT order_id FROM st_orders)
    UNION ALL SELECT order_id, product_id, 'V3:product_id:orphan' FROM st_order_details
        WHERE product_id NOT IN (SELECT product_id FROM st_product)""")
ORACLE["V11_payment_mismatch"] = with_store(f"""SELECT p.payment_id, i.order_id, p.amount_paid,
        CAST(l.v AS {M38}) AS lines_value
    FROM st_payment p JOIN st_invoice i ON p.invoice_id = i.invoice_id
    LEFT JOIN (SELECT order_id, SUM(price * quantity) AS v FROM st_order_details GROUP BY order_id) l ON l.order_id = i.order_id
    WHERE p.amount_paid IS DISTINCT FROM CAST(l.v AS {M38})""")
ORACLE["V11_line_price_drift"] = with_store("""SELECT od.order_id, od.product_id, od.price, p.price AS current_price
    FROM st_order_details od JOIN st_product p ON od.product_id = p.product_id WHERE od.price <> p.price""")
ORACLE["V11_order_count_drift"] = with_store("""SELECT c.customer_id, c.order_count AS stored_count, COALESCE(n.n, 0) AS counted
    FROM st_customer c LEFT JOIN (SELECT customer_id, COUNT(*) AS n FROM st_orders WHERE is_valid GROUP BY 1) n
      ON c.customer_id = n.customer_id
    WHERE c.order_count IS DISTINCT FROM COALESCE(n.n, 0)""")

# ---- tables with planted violations ------------------------------------------------------------
def _dirty(name: str, rows: str, keys: str, rules: dict[str, str]) -> None:
    body = " UNION ALL ".join(f"SELECT {keys}, '{code}' AS reason FROM d WHERE {bad}" for code, bad in rules.items())
    ORACLE[name] = with_store(body, f"d AS ({rows})")


_dirty("V_dirty_employee_violations", """
    SELECT CASE WHEN c_custkey % 97 = 5 THEN c_custkey - 1 ELSE c_custkey END AS employee_id,
        CASE c_custkey % 11 WHEN 0 THEN NULL WHEN 1 THEN repeat('x', 101) ELSE c_name END AS name,
        CASE WHEN c_custkey % 7 = 0 THEN 'Astronaut' ELSE 'manager' END AS role,
        CASE c_custkey % 5 WHEN 0 THEN '12345' WHEN 1 THEN NULL ELSE lpad(CAST(c_custkey AS VARCHAR), 10, '0') END AS phone,
        CASE WHEN c_custkey % 6 = 0 THEN 'no mail' ELSE 'e' || c_custkey || '@shop.test' END AS email,
        CASE c_custkey % 13 WHEN 0 THEN -1 WHEN 1 THEN -c_custkey - 2 WHEN 2 THEN NULL
            ELSE CASE WHEN c_custkey % 97 = 5 THEN c_custkey - 1 ELSE c_custkey END END AS manager_id,
        CASE WHEN c_custkey % 17 = 0 THEN NULL ELSE TRUE END AS is_valid FROM customer""", "employee_id", {
    "V2:employee_name:null": "name IS NULL", "V2:is_valid:null": "is_valid IS NULL",
    "V2:employee_name:length": "length(name) > 100", "V7:emp_role:domain": "role = 'Astronaut'",
    "V4:email_address:pattern": "email NOT LIKE '%@%'", "V5:phone_number:pattern": "length(phone) <> 10",
    "V1:primary_key:duplicate": "employee_id IN (SELECT employee_id FROM d GROUP BY 1 HAVING COUNT(*) > 1)",
    "V3:manager_id:orphan": "manager_id NOT IN (SELECT employee_id FROM d)", "V3:manager_id:default": "manager_id = -1"})
_dirty("V_dirty_product_violations", """
    SELECT CASE WHEN product_id % 50 = 0 THEN NULL ELSE product_id END AS product_id,
        CASE product_id % 11 WHEN 0 THEN NULL WHEN 1 THEN repeat('x', 101) ELSE product_name END AS name,
        CASE WHEN product_id % 10 = 3 THEN repeat('y', 51) ELSE category END AS category,
        CASE product_id % 9 WHEN 0 THEN 0 WHEN 1 THEN NULL ELSE price END AS price,
        CASE WHEN product_id % 8 = 0 THEN -3 ELSE stock_quantity END AS stock FROM st_product
    UNION ALL SELECT product_id, product_name, category, price, stock_quantity FROM st_product WHERE product_id % 31 = 0""",
    "product_id", {
    "V2:product_id:null": "product_id IS NULL", "V2:product_name:null": "name IS NULL", "V2:price:null": "price IS NULL",
    "V2:product_name:length": "length(name) > 100", "V2:category:length": "length(category) > 50",
    "V6:price:range": "price <= 0", "V6:stock_quantity:range": "stock < 0",
    "V1:primary_key:duplicate": "product_id IN (SELECT product_id FROM d GROUP BY 1 HAVING COUNT(*) > 1)"})
_dirty("V_dirty_contract_violations", """
    SELECT CASE WHEN s_suppkey % 10 = 7 THEN s_suppkey - 1 ELSE s_suppkey END AS contract_id,
        CASE WHEN s_suppkey % 6 = 0 THEN NULL ELSE DATE '2023-01-01' END AS a,
        CASE s_suppkey % 4 WHEN 0 THEN DATE '2022-12-31' WHEN 1 THEN DATE '2023-01-01' ELSE DATE '2023-12-31' END AS b,
        CASE WHEN s_suppkey % 5 = 0 THEN 0 ELSE 40000 END AS salary FROM supplier""", "contract_id", {
    "V2:contract_start_date:null": "a IS NULL", "V6:salary:range": "salary <= 0", "V8:contract:dates": "a >= b",
    "V1:primary_key:duplicate": "contract_id IN (SELECT contract_id FROM d GROUP BY 1 HAVING COUNT(*) > 1)"})
_dirty("V_dirty_purchase_order_violations", """
    SELECT purchase_order_id, CASE WHEN purchase_order_id % 19 = 0 THEN 999 ELSE employee_id END AS e,
        CASE WHEN purchase_order_id % 23 = 0 THEN -1 ELSE supplier_id END AS s,
        CASE WHEN purchase_order_id % 29 = 0 THEN NULL ELSE order_date END AS o,
        CASE purchase_order_id % 17 WHEN 0 THEN 'Lost' WHEN 1 THEN NULL WHEN 2 THEN repeat('z', 51)
            ELSE delivery_status END AS status FROM st_purchase_order
    UNION ALL SELECT purchase_order_id, employee_id, supplier_id, order_date, delivery_status FROM st_purchase_order
        WHERE purchase_order_id % 31 = 0""", "purchase_order_id", {
    "V2:order_date:null": "o IS NULL", "V2:delivery_status:length": "length(status) > 50",
    "V7:delivery_status:domain": "lower(status) NOT IN ('pending', 'shipped', 'received')",
    "V1:primary_key:duplicate": "purchase_order_id IN (SELECT purchase_order_id FROM d GROUP BY 1 HAVING COUNT(*) > 1)",
    "V3:employee_id:orphan": "e NOT IN (SELECT employee_id FROM st_employee)",
    "V3:supplier_id:orphan": "s NOT IN (SELECT supplier_id FROM st_supplier)"})
_dirty("V_dirty_order_details_violations", """
    SELECT CASE WHEN (order_id + product_id) % 11 = 0 THEN -order_id - 1 ELSE order_id END AS order_id,
        CASE WHEN (order_id + product_id) % 13 = 0 THEN -product_id - 1 ELSE product_id END AS product_id,
        CASE (order_id + product_id) % 9 WHEN 0 THEN -1 WHEN 1 THEN NULL ELSE price END AS price,
        CASE WHEN (order_id + product_id) % 8 = 0 THEN 0 ELSE quantity END AS quantity FROM st_order_details
    UNION ALL SELECT order_id, product_id, price, quantity FROM st_order_details
        WHERE (order_id + product_id) % 37 = 0""", "order_id, product_id", {
    "V2:price:null": "price IS NULL", "V6:price:range": "price <= 0", "V6:quantity:range": "quantity <= 0",
    "V1:primary_key:duplicate": "(order_id, product_id) IN (SELECT (order_id, product_id) FROM d "
                                "GROUP BY order_id, product_id HAVING COUNT(*) > 1)",
    "V3:order_id:orphan": "order_id NOT IN (SELECT order_id FROM st_orders)",
    "V3:product_id:orphan": "product_id NOT IN (SELECT product_id FROM st_product)"})

# ---- change jobs ------------------------------------------------------------------------------
_PATCHES = """patches AS (
    SELECT p_partkey * 10 + 1 AS change_id, p_partkey AS product_id,
        CASE WHEN p_partkey % 2 = 0 THEN ['price'] ELSE ['category'] END AS set_fields,
        CAST(NULL AS VARCHAR) AS product_name, CAST(NULL AS VARCHAR) AS category,
        CAST(CAST(p_retailprice AS DECIMAL(10,2)) + 1 AS DECIMAL(10,2)) AS price
    FROM part
    UNION ALL
    SELECT p_partkey * 10 + 2, p_partkey,
        CASE WHEN p_partkey % 3 = 0 THEN ['product_name', 'price'] WHEN p_partkey % 3 = 1 THEN CAST([] AS VARCHAR[])
             ELSE ['price'] END,
        p_name || ' ' || p_brand || ' ' || CAST(p_size AS VARCHAR) || ' v2', CAST(NULL AS VARCHAR),
        CAST(CAST(p_retailprice AS DECIMAL(10,2)) + 2 AS DECIMAL(10,2))
    FROM part
    UNION ALL
    SELECT p_partkey * 10 + 3, -p_partkey - 1, ['price'], NULL, NULL, CAST(p_retailprice AS DECIMAL(10,2))
    FROM part
    UNION ALL
    SELECT p_partkey * 10 + 4, p_partkey, CASE WHEN p_partkey % 2 = 0 THEN ['price'] ELSE ['product_name'] END, NULL, NULL,
        CAST(-5 AS DECIMAL(10,2)) FROM part),
judged AS (SELECT pt.*, CASE WHEN len(set_fields) = 0 THEN 'W2:empty_patch'
            WHEN s.product_id IS NULL THEN 'W2:unknown_key'
            WHEN list_contains(set_fields, 'price') AND pt.price <= 0 THEN 'V6:price:range'
            WHEN list_contains(set_fields, 'product_name') AND pt.product_name IS NULL THEN 'V2:product_name:null' END AS why
        FROM patches pt LEFT JOIN (SELECT product_id FROM st_product WHERE is_valid) s ON pt.product_id = s.product_id),
okp AS (SELECT * FROM judged WHERE why IS NULL),
lp AS (SELECT product_id,
        bool_or(list_contains(set_fields, 'product_name')) AS has_name,
        arg_max_null(product_name, change_id) FILTER (WHERE list_contains(set_fields, 'product_name')) AS product_name,
        bool_or(list_contains(set_fields, 'category')) AS has_category,
        arg_max_null(category, change_id) FILTER (WHERE list_contains(set_fields, 'category')) AS category,
        bool_or(list_contains(set_fields, 'price')) AS has_price,
        arg_max_null(price, change_id) FILTER (WHERE list_contains(set_fields, 'price')) AS price
       FROM okp GROUP BY product_id)"""
ORACLE["W2_patched_products"] = with_store("""SELECT s.product_id,
        CASE WHEN lp.has_name THEN lp.product_name ELSE s.product_name END AS product_name,
        CASE WHEN lp.has_category THEN lp.category ELSE s.category END AS category,
        CASE WHEN lp.has_price THEN lp.price ELSE s.price END AS price,
        s.is_valid, s.stock_quantity, s.stock_arrival_date
    FROM st_product s LEFT JOIN lp ON s.product_id = lp.product_id""", _PATCHES)
ORACLE["W2_patch_rejects"] = with_store("SELECT change_id, why AS reason FROM judged WHERE why IS NOT NULL", _PATCHES)

_FLAGS = """flags AS (
    SELECT p_partkey * 10 + 1 AS change_id, p_partkey AS product_id, FALSE AS flag FROM part
    UNION ALL SELECT p_partkey * 10 + 2, p_partkey, p_partkey % 2 = 0 FROM part
    UNION ALL SELECT p_partkey * 10 + 3, -p_partkey - 1, FALSE FROM part
    UNION ALL SELECT p_partkey * 10 + 4, p_partkey, FALSE FROM part WHERE p_partkey % 3 = 0),
asked AS (SELECT f.*, ROW_NUMBER() OVER (PARTITION BY product_id ORDER BY change_id) AS n FROM flags f),
replay AS (
    SELECT product_id, is_valid AS state, 0::BIGINT AS n, NULL::BIGINT AS change_id, TRUE AS ok FROM st_product
    UNION ALL
    SELECT r.product_id, CASE WHEN a.flag THEN TRUE WHEN r.state THEN FALSE ELSE r.state END, a.n, a.change_id,
        a.flag OR r.state
    FROM replay r JOIN asked a ON a.product_id = r.product_id AND a.n = r.n + 1)"""
ORACLE["W3_flagged_products"] = with_store("""SELECT s.product_id, s.product_name, s.category, s.price,
        r.state AS is_valid, s.stock_quantity, s.stock_arrival_date
    FROM st_product s JOIN (SELECT product_id, arg_max(state, n) AS state FROM replay GROUP BY product_id) r
      ON s.product_id = r.product_id""", _FLAGS, recursive=True)
ORACLE["W3_flag_rejects"] = with_store("""SELECT change_id, 'W3:state_guard' AS reason FROM replay WHERE NOT ok
    UNION ALL SELECT change_id, 'W3:unknown_key' FROM flags
        WHERE product_id NOT IN (SELECT product_id FROM st_product)""", _FLAGS, recursive=True)

_DELETES = """dels AS (SELECT product_id FROM st_product WHERE NOT is_valid
    UNION SELECT -product_id - 1 FROM st_product)"""
ORACLE["W5_product_archive"] = with_store("""SELECT product_id, product_name, category, price, stock_quantity, stock_arrival_date,
        TIMESTAMP '2024-02-01 12:00:00' AS archived_at
    FROM st_product WHERE product_id IN (SELECT product_id FROM dels)""", _DELETES)
# the profile over the tables after the deletes
_KEPT = """kept_lines AS (SELECT * FROM st_order_details WHERE product_id NOT IN (SELECT product_id FROM dels)),
kept_products AS (SELECT * FROM st_product WHERE product_id NOT IN (SELECT product_id FROM dels))"""
_PROFILE_PARTS = ",\n".join([_ORDER_STATS, _CUST_TOTALS, _FAV, _DISTINCT, _TOP, _AVG, _RANK])
ORACLE["R10_maintained_profile"] = with_store(
    f"""SELECT c.customer_id, c.customer_name, c.phone_number, c.email_address, c.city, c.shipping_address, c.is_valid,
        COALESCE(s.n, 0) AS order_count, CAST(COALESCE(t.total_spent, 0) AS {M38}) AS total_spent,
        s.last_date AS last_order_date, CAST(COALESCE(t.items, 0) AS BIGINT) AS items_ordered,
        COALESCE(f.category, 'N/A') AS favourite_category, COALESCE(d.n, 0) AS distinct_products,
        COALESCE(tp.product_name, 'N/A') AS top_product, COALESCE(a.v, 0.0) AS avg_order_value, rk.spend_rank
    FROM st_customer c JOIN rk USING (customer_id)
    LEFT JOIN ostats s USING (customer_id) LEFT JOIN cust_totals t USING (customer_id)
    LEFT JOIN fav f USING (customer_id) LEFT JOIN dprod d USING (customer_id)
    LEFT JOIN topp tp USING (customer_id) LEFT JOIN avgv a USING (customer_id)""",
    _DELETES + ",\n" + _KEPT + ",\n"
    + _PROFILE_PARTS.replace("st_order_details", "kept_lines").replace("st_product", "kept_products"))
ORACLE["W5_lines_after_delete"] = with_store(
    "SELECT * FROM st_order_details WHERE product_id NOT IN (SELECT product_id FROM dels)", _DELETES)

_CART = """ev AS (SELECT event_id, CAST(ts AS TIMESTAMP) AS ts, user_id AS customer_id, event_id % (SELECT max(p_partkey) + 1 FROM part) AS product_id,
        CASE WHEN event_type IN ('click', 'view') THEN 'add' WHEN event_type = 'error' THEN 'remove'
             WHEN event_type = 'purchase' THEN 'checkout' END AS action
    FROM events WHERE event_type <> 'signup'),
ev2 AS (SELECT * FROM ev WHERE action <> 'add' OR product_id IN (SELECT product_id FROM st_product)),
ev3 AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY customer_id ORDER BY ts, event_id) AS ord,
        last_value(CASE WHEN action <> 'remove' THEN action END IGNORE NULLS) OVER (
            PARTITION BY customer_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev
    FROM ev2),
ev4 AS (SELECT *, COALESCE(action = 'checkout' AND prev = 'add', FALSE) AS ok FROM ev3),
ev5 AS (SELECT *, CAST(COALESCE(SUM(CASE WHEN ok THEN 1 ELSE 0 END) OVER (
            PARTITION BY customer_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT)
        AS cart_no FROM ev4),
carts AS (SELECT customer_id, cart_no, MIN(CASE WHEN action = 'add' THEN ts END) AS opened_at,
        MIN(CASE WHEN ok THEN ts END) AS checked_out_at
    FROM ev5 GROUP BY customer_id, cart_no HAVING MIN(CASE WHEN action = 'add' THEN ts END) IS NOT NULL),
clines AS (SELECT customer_id, cart_no, product_id, CAST(COUNT(*) FILTER (WHERE action = 'add') AS INTEGER) AS quantity,
        MIN(ord) FILTER (WHERE action = 'add') AS fa, MAX(ord) FILTER (WHERE action = 'remove') AS lr
    FROM ev5 GROUP BY customer_id, cart_no, product_id HAVING COUNT(*) FILTER (WHERE action = 'add') > 0)"""
ORACLE["W6_cart_lines"] = with_store("""SELECT l.customer_id, l.cart_no, l.product_id, l.quantity, p.price,
        (NOT COALESCE(l.lr > l.fa, FALSE)) AND c.checked_out_at IS NULL AS is_valid
    FROM clines l JOIN st_product p ON l.product_id = p.product_id
    JOIN carts c ON l.customer_id = c.customer_id AND l.cart_no = c.cart_no""", _CART)
ORACLE["W6_cart_orders"] = with_store("""SELECT customer_id, cart_no, opened_at, checked_out_at,
        CASE WHEN checked_out_at IS NOT NULL THEN 'confirmed' ELSE 'cart' END AS status FROM carts""", _CART)
ORACLE["W6_stock_moves"] = with_store("""SELECT product_id, CAST(-COUNT(*) AS BIGINT) AS stock_change
    FROM ev5 WHERE action = 'add' GROUP BY product_id""", _CART)

_STATUS = """base AS (SELECT o_orderkey AS k, CAST(o_orderdate AS DATE) AS d,
        CASE WHEN o_orderkey % 60 = 31 THEN (o_custkey % 25 + 1) % 25 ELSE o_custkey % 25 END AS employee_id FROM orders),
upd AS (
    SELECT k * 10 + 1 AS change_id, k AS order_id, employee_id, 'Completed' AS status, CAST(d + 3 AS DATE) AS rd FROM base
    UNION ALL SELECT k * 10 + 2, k, employee_id, 'archived', NULL FROM base WHERE k % 3 = 0
    UNION ALL SELECT k * 10 + 3, k, employee_id, 'completed', NULL FROM base WHERE k % 5 = 0
    UNION ALL SELECT k * 10 + 4, k, employee_id, ' ', NULL FROM base WHERE k % 7 = 0),
judged AS (SELECT u.*, CASE WHEN trim(u.status) = '' THEN 'W8:missing_status'
        WHEN o.order_id IS NULL THEN 'W8:not_found_or_not_owned' END AS why
    FROM upd u LEFT JOIN st_orders o ON o.order_id = u.order_id AND o.is_valid AND o.employee_id = u.employee_id),
asked AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY order_id ORDER BY change_id) AS n FROM judged WHERE why IS NULL),
replay AS (
    SELECT order_id, status, actual_received_date AS rd, 0::BIGINT AS n FROM st_orders
    UNION ALL
    SELECT r.order_id, a.status, CASE WHEN lower(a.status) = 'completed' AND a.rd IS NOT NULL THEN a.rd ELSE r.rd END, a.n
    FROM replay r JOIN asked a ON a.order_id = r.order_id AND a.n = r.n + 1)"""
ORACLE["W8_status_changed_orders"] = with_store("""SELECT o.order_id, o.customer_id, o.employee_id, o.order_date,
        o.expected_received_date, r.rd AS actual_received_date, r.status, o.is_valid
    FROM st_orders o JOIN replay r ON o.order_id = r.order_id
    QUALIFY ROW_NUMBER() OVER (PARTITION BY o.order_id ORDER BY r.n DESC) = 1""", _STATUS, recursive=True)
ORACLE["W8_status_rejects"] = with_store("SELECT change_id, why AS reason FROM judged WHERE why IS NOT NULL", _STATUS,
                                         recursive=True)

_PURCHASE = """li AS (SELECT * FROM lineitem),
hdr AS (SELECT l_orderkey * (SELECT max(s_suppkey) + 1 FROM supplier) + l_suppkey AS change_id, l_suppkey AS supplier_id, l_suppkey % 25 AS employee_id,
        CAST(MAX(CAST(l_shipdate AS DATE)) + 30 AS DATE) AS expected_received_date
    FROM li GROUP BY l_orderkey, l_suppkey),
itm AS (SELECT l_orderkey * (SELECT max(s_suppkey) + 1 FROM supplier) + l_suppkey AS change_id, l_partkey AS product_id,
        MAX(CAST(l_extendedprice AS DECIMAL(10,2))) AS price, CAST(SUM(CAST(l_quantity AS INTEGER)) AS INTEGER) AS quantity
    FROM li GROUP BY l_orderkey, l_suppkey, l_partkey),
badi AS (SELECT DISTINCT i.change_id FROM itm i LEFT JOIN st_product p ON i.product_id = p.product_id AND p.is_valid
    WHERE p.product_id IS NULL OR i.price <= 0 OR i.quantity <= 0),
chk AS (SELECT h.*,
        (h.supplier_id IS NULL OR h.employee_id IS NULL OR h.expected_received_date IS NULL
         OR h.change_id NOT IN (SELECT change_id FROM itm)) AS r_missing,
        COALESCE(h.expected_received_date <= DATE '1995-06-01', FALSE) AS r_date,
        h.supplier_id NOT IN (SELECT supplier_id FROM st_supplier WHERE is_valid) AS r_supp,
        h.change_id IN (SELECT change_id FROM badi) AS r_item
    FROM hdr h)"""
ORACLE["W9_purchase_rejects"] = with_store("""
    SELECT change_id, 'W9:missing_field' AS reason FROM chk WHERE r_missing
    UNION ALL SELECT change_id, 'V9:expected_date_not_after_as_of' FROM chk WHERE r_date
    UNION ALL SELECT change_id, 'W9:supplier_inactive' FROM chk WHERE r_supp
    UNION ALL SELECT change_id, 'W9:inactive_product' FROM chk WHERE r_item""", _PURCHASE)
ORACLE["W9_new_purchase_orders"] = with_store("""SELECT
        (SELECT MAX(purchase_order_id) FROM st_purchase_order) + ROW_NUMBER() OVER (ORDER BY change_id) AS purchase_order_id,
        employee_id, supplier_id, DATE '1995-06-01' AS order_date, expected_received_date,
        CAST(NULL AS DATE) AS actual_received_date, 'pending' AS delivery_status, TRUE AS is_valid
    FROM chk WHERE NOT (r_missing OR r_date OR r_supp OR r_item)""", _PURCHASE)

def _ledger(received: str) -> str:
    return with_store(f"""SELECT p.product_id, p.stock_quantity,
        CAST(COALESCE(s.sold, 0) AS BIGINT) AS sold, CAST(COALESCE(r.received, 0) AS BIGINT) AS received,
        CAST(COALESCE(r.received, 0) - COALESCE(s.sold, 0) AS BIGINT) AS net_movement,
        p.stock_quantity + (COALESCE(r.received, 0) - COALESCE(s.sold, 0)) < 0 AS negative
    FROM st_product p
    LEFT JOIN (SELECT product_id, SUM(quantity) AS sold FROM st_order_details GROUP BY 1) s
      ON p.product_id = s.product_id
    LEFT JOIN ({received}) r ON p.product_id = r.product_id""")


ORACLE["W12_stock_ledger"] = _ledger(
    "SELECT product_id, SUM(quantity) AS received FROM st_purchase_order_details GROUP BY 1")
ORACLE["W12_stock_ledger_on_receive"] = _ledger("""SELECT pod.product_id, SUM(pod.quantity) AS received
    FROM st_purchase_order_details pod JOIN st_purchase_order po ON pod.purchase_order_id = po.purchase_order_id
    WHERE pod.is_valid AND lower(po.delivery_status) = 'received' GROUP BY 1""")

_CHECKOUT = """carts AS (SELECT customer_id, order_id, ROW_NUMBER() OVER (PARTITION BY customer_id ORDER BY order_id) AS nth
    FROM st_orders WHERE lower(status) = 'cart'),
req AS (SELECT c_custkey * 10 + 1 AS change_id, c_custkey AS customer_id, c_name AS name,
        CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE 'c' || CAST(c_custkey AS VARCHAR) || '@shop.test' END AS email,
        CASE WHEN c_custkey % 4 = 0 THEN 'card' ELSE 'cash' END AS payment_method,
        c_custkey % 8 <> 4 AS has_card_fields
    FROM customer
    UNION ALL SELECT c_custkey * 10 + 2, c_custkey, c_name, 'x', 'cash', FALSE FROM customer WHERE c_custkey % 2 = 0),
chk AS (SELECT r.*,
        (NULLIF(trim(name), '') IS NULL OR NULLIF(trim(email), '') IS NULL OR NULLIF(trim(payment_method), '') IS NULL)
            AS r_missing,
        (lower(payment_method) = 'card' AND NOT COALESCE(has_card_fields, FALSE)) AS r_card
    FROM req r),
good AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY customer_id ORDER BY change_id) AS nth
    FROM chk WHERE NOT r_missing AND NOT r_card),
done AS (SELECT g.change_id, g.customer_id, g.payment_method, c.order_id,
        CAST(COALESCE((SELECT SUM(CAST(od.price * od.quantity AS DECIMAL(18,2))) FROM st_order_details od
                       WHERE od.order_id = c.order_id AND od.is_valid), 0) AS DECIMAL(10,2)) AS amount_paid
    FROM good g JOIN carts c ON g.customer_id = c.customer_id AND g.nth = c.nth),
inv AS (SELECT d.*, (SELECT MAX(invoice_id) FROM st_invoice) + ROW_NUMBER() OVER (ORDER BY change_id) AS invoice_id
    FROM done d)"""
ORACLE["W7_checkout_payments"] = with_store("""SELECT
        (SELECT MAX(payment_id) FROM st_payment) + ROW_NUMBER() OVER (ORDER BY change_id) AS payment_id,
        invoice_id, DATE '2024-02-01' AS payment_date, amount_paid, payment_method, TRUE AS is_valid
    FROM inv""", _CHECKOUT)
ORACLE["W7_checkout_orders"] = with_store("""SELECT o.order_id, o.customer_id, o.employee_id,
        CASE WHEN d.order_id IS NULL THEN o.order_date ELSE DATE '2024-02-01' END AS order_date,
        o.expected_received_date, o.actual_received_date,
        CASE WHEN d.order_id IS NULL THEN o.status ELSE 'confirmed' END AS status, o.is_valid
    FROM st_orders o LEFT JOIN done d ON o.order_id = d.order_id""", _CHECKOUT)
ORACLE["W7_checkout_customers"] = with_store("""SELECT c.customer_id, CAST(c.order_count + COALESCE(n, 0) AS INTEGER) AS order_count
    FROM st_customer c LEFT JOIN (SELECT customer_id, COUNT(*) AS n FROM done GROUP BY 1) d ON c.customer_id = d.customer_id""",
    _CHECKOUT)
ORACLE["W7_checkout_rejects"] = with_store("""
    SELECT change_id, 'W7:missing_field' AS reason FROM chk WHERE r_missing
    UNION ALL SELECT change_id, 'W7:card_fields' FROM chk WHERE r_card
    UNION ALL SELECT change_id, 'W7:no_cart' FROM good WHERE change_id NOT IN (SELECT change_id FROM done)""", _CHECKOUT)

_PO_STATUS = """upd AS (
    SELECT purchase_order_id * 10 + 1 AS change_id, purchase_order_id, 'Shipped' AS status, NULL::DATE AS rd
    FROM st_purchase_order
    UNION ALL SELECT purchase_order_id * 10 + 2, purchase_order_id, 'Received', CAST(order_date + 12 AS DATE)
        FROM st_purchase_order WHERE purchase_order_id % 7 = 0
    UNION ALL SELECT purchase_order_id * 10 + 3, purchase_order_id, 'Shipped', NULL
        FROM st_purchase_order WHERE purchase_order_id % 14 = 0
    UNION ALL SELECT purchase_order_id * 10 + 4, purchase_order_id, NULL, NULL
        FROM st_purchase_order WHERE purchase_order_id % 11 = 0
    UNION ALL SELECT purchase_order_id * 10 + 5, purchase_order_id, 'Lost', NULL
        FROM st_purchase_order WHERE purchase_order_id % 13 = 0),
judged AS (SELECT u.*, CASE WHEN u.status IS NULL OR trim(u.status) = '' THEN 'W10:missing_status'
        WHEN NOT p.is_valid THEN 'W10:not_found_or_inactive'
        WHEN lower(u.status) NOT IN ('pending', 'shipped', 'received') THEN 'V7:delivery_status:domain' END AS why
    FROM upd u JOIN st_purchase_order p USING (purchase_order_id)),
asked AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY purchase_order_id ORDER BY change_id) AS n FROM judged WHERE why IS NULL),
replay AS (
    SELECT purchase_order_id, delivery_status AS status, actual_received_date AS rd, 0::BIGINT AS n,
        NULL::BIGINT AS change_id, FALSE AS arrived FROM st_purchase_order
    UNION ALL
    SELECT r.purchase_order_id, a.status, CASE WHEN a.status = 'Received' AND a.rd IS NOT NULL THEN a.rd ELSE r.rd END,
        a.n, a.change_id, a.status = 'Received' AND a.rd IS NOT NULL
    FROM replay r JOIN asked a ON a.purchase_order_id = r.purchase_order_id AND a.n = r.n + 1),
moves AS (SELECT pod.product_id, r.purchase_order_id, r.change_id, r.rd, pod.quantity,
        po.actual_received_date IS NULL AS fresh
    FROM replay r JOIN st_purchase_order po ON po.purchase_order_id = r.purchase_order_id JOIN st_purchase_order_details pod ON pod.purchase_order_id = r.purchase_order_id AND pod.is_valid
    WHERE r.arrived
    QUALIFY ROW_NUMBER() OVER (PARTITION BY r.purchase_order_id, pod.product_id ORDER BY r.change_id DESC) = 1),
pp AS (SELECT product_id, arg_max(rd, change_id) AS arrival, SUM(quantity) FILTER (fresh) AS q FROM moves GROUP BY product_id)"""
ORACLE["W10_received_products"] = with_store("""SELECT p.product_id, p.product_name, p.category, p.price, p.is_valid,
        CAST(p.stock_quantity + COALESCE(pp.q, 0) AS INTEGER) AS stock_quantity,
        COALESCE(pp.arrival, p.stock_arrival_date) AS stock_arrival_date
    FROM st_product p LEFT JOIN pp ON p.product_id = pp.product_id""", _PO_STATUS, recursive=True)
ORACLE["W10_purchase_orders"] = with_store("""SELECT p.* REPLACE (r.status AS delivery_status, r.rd AS actual_received_date)
    FROM st_purchase_order p JOIN (
        SELECT * FROM replay QUALIFY ROW_NUMBER() OVER (PARTITION BY purchase_order_id ORDER BY n DESC) = 1) r
      ON p.purchase_order_id = r.purchase_order_id""", _PO_STATUS, recursive=True)
ORACLE["W10_purchase_rejects"] = with_store("SELECT change_id, why AS reason FROM judged WHERE why IS NOT NULL", _PO_STATUS,
                                            recursive=True)

_TYPES = """chg AS (
    SELECT n * 10 + 1 AS change_id, n AS employee_id,
        CASE WHEN (n // 4) % 2 = 1 THEN 'hourly' ELSE 'contract' END AS new_type
    FROM (SELECT CAST(n_nationkey AS BIGINT) AS n FROM nation) k
    UNION ALL
    SELECT n * 10 + 2, n, CASE WHEN n % 9 = 0 THEN 'regular' WHEN (n // 4) % 2 = 1 THEN 'hourly' ELSE 'contract' END
    FROM (SELECT CAST(n_nationkey AS BIGINT) AS n FROM nation) k),
okt AS (SELECT c.* FROM chg c JOIN st_employee e ON c.employee_id = e.employee_id AND e.is_valid),
lastt AS (SELECT employee_id, MAX(change_id) AS change_id, arg_max(new_type, change_id) AS t FROM okt GROUP BY employee_id),
made AS (SELECT *, (SELECT MAX(contract_id) FROM st_contract) + ROW_NUMBER() OVER (ORDER BY change_id) AS contract_id
    FROM okt WHERE new_type = 'contract')"""
ORACLE["W11_hourly_after"] = with_store("""SELECT he.employee_id, he.hours_worked, he.hourly_wages,
        he.is_valid AND he.employee_id NOT IN (SELECT employee_id FROM lastt) AS is_valid
    FROM st_hourly_employee he WHERE he.employee_id NOT IN (SELECT employee_id FROM okt WHERE new_type = 'hourly')
    UNION ALL SELECT employee_id, 40, CAST(20 AS DECIMAL(10,2)), t = 'hourly' FROM lastt
    WHERE employee_id IN (SELECT employee_id FROM okt WHERE new_type = 'hourly')""", _TYPES)
ORACLE["W11_contract_employee_after"] = with_store("""SELECT ce.employee_id, ce.contract_id,
        ce.is_valid AND ce.employee_id NOT IN (SELECT employee_id FROM lastt) AS is_valid
    FROM st_contract_employee ce WHERE ce.employee_id NOT IN (SELECT employee_id FROM made)
    UNION ALL SELECT employee_id, arg_max(m.contract_id, m.change_id), any_value(t) = 'contract'
    FROM made m JOIN lastt USING (employee_id) GROUP BY employee_id""", _TYPES)
ORACLE["W11_contracts_after"] = with_store("""SELECT * FROM st_contract
    UNION ALL SELECT contract_id, DATE '2024-01-01', DATE '2024-12-31', CAST(50000 AS DECIMAL(10,2)), TRUE FROM made""", _TYPES)
ORACLE["W11_rejects"] = with_store("""SELECT change_id, 'W11:unknown_employee' AS reason FROM chg
    WHERE employee_id NOT IN (SELECT employee_id FROM st_employee WHERE is_valid)""", _TYPES)

_CREATES = """req AS (SELECT cid AS change_id,
        CASE WHEN p_partkey % 100 = 0 THEN '' ELSE p_name || ' new' END AS product_name, p_type AS category,
        CAST(p_retailprice - 950 AS DECIMAL(10,2)) AS price, CAST(p_size AS INTEGER) AS stock_quantity
    FROM (SELECT p_partkey, p_partkey AS cid, * EXCLUDE (p_partkey) FROM part
          UNION ALL SELECT p_partkey, p_partkey, * EXCLUDE (p_partkey) FROM part WHERE p_partkey % 50 = 7
          UNION ALL SELECT p_partkey, NULL, * EXCLUDE (p_partkey) FROM part WHERE p_partkey % 70 = 3)),
bad AS (
    SELECT change_id, 'V10:product_name:required' AS reason FROM req WHERE NULLIF(trim(product_name), '') IS NULL
    UNION ALL SELECT change_id, 'V10:category:required' FROM req WHERE NULLIF(trim(category), '') IS NULL
    UNION ALL SELECT change_id, 'V10:price:required' FROM req WHERE price IS NULL
    UNION ALL SELECT change_id, 'V10:stock_quantity:required' FROM req WHERE stock_quantity IS NULL
    UNION ALL SELECT change_id, 'V2:product_name:null' FROM req WHERE product_name IS NULL
    UNION ALL SELECT change_id, 'V2:price:null' FROM req WHERE price IS NULL
    UNION ALL SELECT change_id, 'V2:stock_quantity:null' FROM req WHERE stock_quantity IS NULL
    UNION ALL SELECT change_id, 'V2:product_name:length' FROM req WHERE length(product_name) > 100
    UNION ALL SELECT change_id, 'V2:category:length' FROM req WHERE length(category) > 50
    UNION ALL SELECT change_id, 'V6:price:range' FROM req WHERE price <= 0
    UNION ALL SELECT change_id, 'V6:stock_quantity:range' FROM req WHERE stock_quantity < 0
    UNION ALL SELECT change_id, 'W0:missing_change_id' FROM req WHERE change_id IS NULL
    UNION ALL SELECT change_id, 'W0:duplicate_change_id' FROM req
        WHERE change_id IN (SELECT change_id FROM req GROUP BY 1 HAVING COUNT(*) > 1))"""
ORACLE["W1_inserted_products"] = with_store("""SELECT
        (SELECT MAX(product_id) FROM st_product) + ROW_NUMBER() OVER (ORDER BY change_id) AS product_id,
        product_name, category, price, TRUE AS is_valid, stock_quantity, CAST(NULL AS DATE) AS stock_arrival_date
    FROM req WHERE change_id NOT IN (SELECT change_id FROM bad WHERE change_id IS NOT NULL)""", _CREATES)
ORACLE["W1_insert_rejects"] = with_store("SELECT change_id, reason FROM bad", _CREATES)

_EMP_OFF = """eflags AS (SELECT CAST(n_nationkey AS BIGINT) AS change_id, CAST(n_nationkey AS BIGINT) AS employee_id,
        n_nationkey % 5 <> 0 AS flag FROM nation),
ereq AS (SELECT f.*, e.is_valid AS old,
        COALESCE(CASE WHEN f.flag THEN e.is_valid IS NOT NULL ELSE e.is_valid = TRUE END, FALSE) AS ok
    FROM eflags f LEFT JOIN st_employee e ON f.employee_id = e.employee_id),
eacc AS (SELECT employee_id FROM ereq WHERE ok AND NOT flag)"""
ORACLE["W4_hourly_after_deactivation"] = with_store("""SELECT he.employee_id, he.hours_worked, he.hourly_wages,
        he.is_valid AND he.employee_id NOT IN (SELECT employee_id FROM eacc) AS is_valid
    FROM st_hourly_employee he""", _EMP_OFF)
ORACLE["W4_employee_rejects"] = with_store("""SELECT change_id,
        CASE WHEN old IS NULL THEN 'W3:unknown_key' ELSE 'W3:state_guard' END AS reason
    FROM ereq WHERE NOT ok""", _EMP_OFF)
_PO_OFF = """poff AS (
    SELECT purchase_order_id * 10 + 1 AS change_id, purchase_order_id, FALSE AS flag FROM st_purchase_order
    UNION ALL SELECT purchase_order_id * 10 + 2, purchase_order_id, TRUE FROM st_purchase_order WHERE purchase_order_id % 2 = 0
    UNION ALL SELECT purchase_order_id * 10 + 3, purchase_order_id, FALSE FROM st_purchase_order WHERE purchase_order_id % 4 = 0
    UNION ALL SELECT purchase_order_id * 10 + 4, -purchase_order_id - 1, FALSE FROM st_purchase_order
        WHERE purchase_order_id % 9 = 0),
asked AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY purchase_order_id ORDER BY change_id) AS n FROM poff),
replay AS (
    SELECT purchase_order_id, is_valid AS state, lower(delivery_status) = 'pending' AS pending, 0::BIGINT AS n,
        NULL::BIGINT AS change_id, NULL::BOOLEAN AS ok FROM st_purchase_order
    UNION ALL
    SELECT r.purchase_order_id, CASE WHEN a.flag AND NOT r.state THEN TRUE WHEN NOT a.flag AND r.state AND r.pending THEN FALSE
            ELSE r.state END, r.pending, a.n, a.change_id,
        CASE WHEN a.flag THEN NOT r.state ELSE r.state AND r.pending END
    FROM replay r JOIN asked a ON a.purchase_order_id = r.purchase_order_id AND a.n = r.n + 1),
ended AS (SELECT purchase_order_id, arg_max(state, n) AS state, bool_or(COALESCE(ok, FALSE)) AS touched
    FROM replay GROUP BY purchase_order_id)"""
ORACLE["W4_purchase_lines_after"] = with_store("""SELECT pod.* REPLACE (
        CASE WHEN e.touched THEN e.state ELSE pod.is_valid END AS is_valid)
    FROM st_purchase_order_details pod JOIN ended e ON pod.purchase_order_id = e.purchase_order_id""", _PO_OFF, recursive=True)
ORACLE["W4_purchase_orders_after"] = with_store("""SELECT p.* REPLACE (e.state AS is_valid)
    FROM st_purchase_order p JOIN ended e ON p.purchase_order_id = e.purchase_order_id""", _PO_OFF, recursive=True)
ORACLE["W4_purchase_order_rejects"] = with_store("""SELECT change_id, 'W4:state_guard' AS reason FROM replay WHERE NOT ok
    UNION ALL SELECT change_id, 'W4:unknown_key' FROM poff WHERE purchase_order_id < 0""", _PO_OFF, recursive=True)
ORACLE["E_product_labels"] = with_store("""SELECT product_id,
        CASE WHEN is_valid THEN 'Active' ELSE 'Inactive' END AS status_label,
        printf('%.2f', CAST(price AS DOUBLE)) AS price_text,
        format('{:,.2f}', CAST(price AS DOUBLE)) AS price_display,
        strftime(stock_arrival_date, '%Y-%m-%d') AS arrival_text
    FROM st_product""")

_EMPLOYEES = """req AS (SELECT c_custkey AS change_id, c_custkey AS k,
        CASE WHEN c_custkey % 20 = 0 THEN '' ELSE c_name END AS employee_name,
        CASE WHEN c_custkey % 15 = 0 THEN 'Astronaut' ELSE 'manager' END AS emp_role,
        CASE c_custkey % 9 WHEN 0 THEN '123' WHEN 1 THEN '' ELSE lpad(CAST(c_custkey AS VARCHAR), 10, '0') END AS phone_number,
        CASE WHEN c_custkey % 12 = 0 THEN 'no mail' ELSE 'e' || c_custkey || '@shop.test' END AS email_address,
        CASE WHEN c_custkey % 14 = 0 THEN 99 ELSE c_custkey % 25 END AS manager_id,
        CASE c_custkey % 4 WHEN 0 THEN 'hourly' WHEN 1 THEN 'contract' WHEN 2 THEN 'regular'
            ELSE CASE WHEN c_custkey % 8 = 3 THEN NULL ELSE 'hourly' END END AS t,
        CASE WHEN c_custkey % 16 <> 0 THEN 40 END AS hours_worked,
        CASE WHEN c_custkey % 24 = 4 THEN 0 ELSE 15 END AS wages,
        CASE c_custkey % 40 WHEN 1 THEN 1 WHEN 13 THEN c_custkey + 1004 ELSE c_custkey + 1000 END AS contract_id,
        c_custkey % 20 = 5 AS wrong_dates, c_custkey % 28 = 1 AS no_salary
    FROM customer),
bad AS (
    SELECT change_id, 'V10:employee_name:required' AS reason FROM req WHERE employee_name = ''
    UNION ALL SELECT change_id, 'V10:employee_type:required' FROM req WHERE t IS NULL
    UNION ALL SELECT change_id, 'V7:emp_role:domain' FROM req WHERE emp_role = 'Astronaut'
    UNION ALL SELECT change_id, 'V4:email_address:pattern' FROM req WHERE email_address NOT LIKE '%@%'
    UNION ALL SELECT change_id, 'V5:phone_number:pattern' FROM req WHERE phone_number = '123'
    UNION ALL SELECT change_id, 'V3:manager_id:orphan' FROM req WHERE manager_id = 99
    UNION ALL SELECT change_id, 'W1:hourly_fields' FROM req WHERE t = 'hourly' AND hours_worked IS NULL
    UNION ALL SELECT change_id, 'V6:hourly_wages:range' FROM req WHERE t = 'hourly' AND wages <= 0
    UNION ALL SELECT change_id, 'V8:contract:dates' FROM req WHERE t = 'contract' AND wrong_dates
    UNION ALL SELECT change_id, 'V6:salary:range' FROM req WHERE t = 'contract' AND no_salary
    UNION ALL SELECT change_id, 'V1:contract_id:duplicate' FROM req WHERE t = 'contract' AND (
        contract_id IN (SELECT contract_id FROM st_contract)
        OR contract_id IN (SELECT contract_id FROM req WHERE t = 'contract' GROUP BY 1 HAVING COUNT(*) > 1))),
good AS (SELECT *, (SELECT MAX(employee_id) FROM st_employee) + ROW_NUMBER() OVER (ORDER BY change_id) AS employee_id
    FROM req WHERE change_id NOT IN (SELECT change_id FROM bad))"""
ORACLE["W1_inserted_employees"] = with_store("""SELECT employee_id, employee_name, emp_role, phone_number, email_address,
        DATE '2024-01-01' AS hire_date, manager_id, TRUE AS is_valid FROM good""", _EMPLOYEES)
ORACLE["W1_hourly_employees"] = with_store("""SELECT * FROM st_hourly_employee
    UNION ALL SELECT employee_id, hours_worked, CAST(wages AS DECIMAL(10,2)), TRUE FROM good WHERE t = 'hourly'""", _EMPLOYEES)
ORACLE["W1_contract_employees"] = with_store("""SELECT * FROM st_contract_employee
    UNION ALL SELECT employee_id, contract_id, TRUE FROM good WHERE t = 'contract'""", _EMPLOYEES)
ORACLE["W1_employee_rejects"] = with_store("SELECT change_id, reason FROM bad", _EMPLOYEES)

_BUYERS = """req AS (SELECT o_orderkey AS change_id, CASE WHEN o_orderkey % 10 = 0 THEN ' ' ELSE 'Buyer ' || o_orderkey END AS name,
        CASE WHEN o_orderkey % 9 <> 0 THEN o_orderpriority END AS address FROM orders)"""
ORACLE["W1_inserted_customers"] = with_store("""SELECT
        (SELECT MAX(customer_id) FROM st_customer) + ROW_NUMBER() OVER (ORDER BY change_id) AS customer_id,
        name AS customer_name, CAST(NULL AS VARCHAR) AS phone_number, CAST(NULL AS VARCHAR) AS email_address,
        CAST(NULL AS VARCHAR) AS city, address AS shipping_address, 0 AS order_count, TRUE AS is_valid
    FROM req WHERE trim(name) <> '' AND address IS NOT NULL""", _BUYERS)
ORACLE["W1_customer_rejects"] = with_store("""SELECT change_id, 'V10:customer_name:required' AS reason FROM req WHERE trim(name) = ''
    UNION ALL SELECT change_id, 'V2:shipping_address:null' FROM req WHERE address IS NULL""", _BUYERS)
ORACLE["W2_patched_suppliers"] = with_store("""SELECT supplier_id, supplier_name,
        CASE WHEN supplier_id % 2 = 0 AND is_valid THEN 's' || supplier_id || '@shop.test' ELSE email_address END AS email_address,
        phone_number, is_valid FROM st_supplier""")
ORACLE["W2_supplier_rejects"] = with_store("""SELECT supplier_id * 10 + 2 AS change_id, 'W2:empty_patch' AS reason
        FROM st_supplier WHERE supplier_id % 5 = 0
    UNION ALL SELECT supplier_id * 10 + 1, 'W2:unknown_key' FROM st_supplier WHERE NOT is_valid
    UNION ALL SELECT supplier_id * 10 + 1, 'V2:supplier_name:null' FROM st_supplier WHERE is_valid AND supplier_id % 2 = 1""")
ORACLE["W3_flagged_customers"] = with_store(
    "SELECT * REPLACE (customer_id % 3 = 0 AS is_valid) FROM st_customer")
ORACLE["W3_customer_rejects"] = with_store("""SELECT customer_id * 10 + 4 AS change_id, 'W3:unknown_key' AS reason
    FROM st_customer WHERE customer_id % 5 = 0""")

_STORED = """ev AS (SELECT event_id, CAST(ts AS TIMESTAMP) AS ts, user_id AS customer_id,
        event_id % (SELECT max(p_partkey) + 1 FROM part) AS product_id,
        CASE WHEN event_type IN ('click', 'view') THEN 'add' WHEN event_type = 'error' THEN 'remove'
             WHEN event_type = 'purchase' THEN 'checkout' END AS action
    FROM events WHERE event_type <> 'signup'),
ev2 AS (SELECT * FROM ev WHERE action <> 'add' OR product_id IN (SELECT product_id FROM st_product)),
open AS (SELECT customer_id, order_id, ROW_NUMBER() OVER (PARTITION BY customer_id ORDER BY order_id) - 1 AS cart_no
    FROM st_orders WHERE lower(status) = 'cart'),
ev3 AS (SELECT e.*, COALESCE(n_open, 0) AS n_open, ROW_NUMBER() OVER w AS ord,
        COUNT(*) FILTER (WHERE action = 'checkout') OVER w AS place,
        last_value(CASE WHEN action <> 'remove' THEN action END IGNORE NULLS) OVER (
            PARTITION BY e.customer_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev
    FROM ev2 e LEFT JOIN (SELECT customer_id, COUNT(*) AS n_open FROM open GROUP BY 1) k ON k.customer_id = e.customer_id
    WINDOW w AS (PARTITION BY e.customer_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)),
ev4 AS (SELECT *, action = 'checkout' AND (place <= n_open OR COALESCE(prev = 'add', FALSE)) AS ok FROM ev3),
ev5 AS (SELECT *, COALESCE(SUM(CASE WHEN ok THEN 1 ELSE 0 END) OVER (
        PARTITION BY customer_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cart_no
    FROM ev4),
seen AS (SELECT customer_id, cart_no, MIN(ts) FILTER (WHERE action = 'add') AS opened_at,
        arg_min(event_id, ord) FILTER (WHERE action = 'add') AS first_event, MIN(ts) FILTER (WHERE ok) AS out_at
    FROM ev5 GROUP BY ALL),
fresh AS (SELECT s.*, (SELECT MAX(order_id) FROM st_orders) + ROW_NUMBER() OVER (ORDER BY first_event) AS order_id
    FROM seen s WHERE opened_at IS NOT NULL
      AND NOT EXISTS (SELECT 1 FROM open o WHERE o.customer_id = s.customer_id AND o.cart_no = s.cart_no)),
placed AS (SELECT s.customer_id, s.cart_no, o.order_id, s.out_at FROM seen s JOIN open o
        ON o.customer_id = s.customer_id AND o.cart_no = s.cart_no
    UNION ALL SELECT customer_id, cart_no, order_id, out_at FROM fresh),
touched AS (SELECT p.order_id, e.product_id, COUNT(*) FILTER (WHERE action = 'add') AS adds,
        MIN(ord) FILTER (WHERE action = 'add') AS fa, MAX(ord) FILTER (WHERE action = 'remove') AS lr,
        p.out_at IS NOT NULL AS closed
    FROM ev5 e JOIN placed p ON p.customer_id = e.customer_id AND p.cart_no = e.cart_no
    WHERE action IN ('add', 'remove') GROUP BY p.order_id, e.product_id, p.out_at)"""
ORACLE["W6_store_orders"] = with_store("""SELECT o.order_id, o.customer_id, o.employee_id,
        CAST(COALESCE(CAST(p.out_at AS DATE), o.order_date) AS DATE) AS order_date, o.expected_received_date,
        o.actual_received_date, CASE WHEN p.out_at IS NULL THEN o.status ELSE 'confirmed' END AS status, o.is_valid
    FROM st_orders o LEFT JOIN placed p ON p.order_id = o.order_id
    UNION ALL SELECT order_id, customer_id, NULL, CAST(COALESCE(out_at, opened_at) AS DATE), NULL, NULL,
        CASE WHEN out_at IS NULL THEN 'cart' ELSE 'confirmed' END, TRUE FROM fresh""", _STORED)
ORACLE["W6_store_lines"] = with_store("""SELECT od.order_id, od.product_id, od.price,
        CAST(od.quantity + COALESCE(t.adds, 0) AS INTEGER) AS quantity,
        od.is_valid AND t.lr IS NULL AND od.order_id NOT IN (SELECT order_id FROM placed WHERE out_at IS NOT NULL) AS is_valid
    FROM st_order_details od LEFT JOIN touched t ON t.order_id = od.order_id AND t.product_id = od.product_id
    UNION ALL SELECT t.order_id, t.product_id, p.price, CAST(t.adds AS INTEGER),
        NOT COALESCE(t.lr > t.fa, FALSE) AND NOT t.closed
    FROM touched t JOIN st_product p ON p.product_id = t.product_id
    WHERE t.adds > 0 AND NOT EXISTS (SELECT 1 FROM st_order_details od
        WHERE od.order_id = t.order_id AND od.product_id = t.product_id)""", _STORED)
ORACLE["W6_store_products"] = with_store("""SELECT p.* REPLACE (CAST(p.stock_quantity - COALESCE(n, 0) AS INTEGER) AS stock_quantity)
    FROM st_product p LEFT JOIN (SELECT product_id, COUNT(*) AS n FROM ev2 WHERE action = 'add' GROUP BY 1) m
      ON m.product_id = p.product_id""", _STORED)

# ---- requests without a place in the order ----
_UNPLACED = {
    "W2": ("patches", "product_id", "W2_patch_rejects", _PATCHES, False),
    "W3": ("flags", "product_id", "W3_flag_rejects", _FLAGS, True),
    "W4": ("poff", "purchase_order_id", "W4_purchase_order_rejects", _PO_OFF, True),
    "W7": ("req", "customer_id", "W7_checkout_rejects", _CHECKOUT, False),
    "W8": ("upd", "order_id", "W8_status_rejects", _STATUS, True),
    "W10": ("upd", "purchase_order_id", "W10_purchase_rejects", _PO_STATUS, True),
}


def _unplaced(job: str) -> str:
    feed, key, base, ctes, recursive = _UNPLACED[job]
    number, step = (2, 20) if job == "W7" else (1, 10)
    missing = "missing_customer" if job == "W7" else "missing_key"
    first = f"{feed} WHERE change_id > 0 AND change_id % 10 = {number} AND change_id // {step} % 4"
    rejects = ORACLE[base][len(with_store("", ctes, recursive)):]
    return with_store(f"""SELECT * FROM ({rejects}) r
    UNION ALL SELECT NULL, 'W0:missing_change_id' FROM {first} = 0
    UNION ALL SELECT -change_id, 'W0:duplicate_change_id' FROM {first} = 1
    UNION ALL SELECT -change_id, 'W0:duplicate_change_id' FROM {first} = 1
    UNION ALL SELECT -change_id, '{job}:{missing}' FROM {first} = 2""", ctes, recursive)


for _job in _UNPLACED:
    ORACLE[f"{_job}_unplaced_rejects"] = _unplaced(_job)

# ---- price changes, and a shop that runs out of stock: stocks are replayed move by move ----
_BUSY = """rng AS (SELECT CAST(floor(max(p_partkey) / 50) AS BIGINT) + 1 AS n FROM part),
pc AS (SELECT event_id AS change_id,
        CASE WHEN event_id % 23 = 0 THEN NULL WHEN event_id % 19 = 0 THEN -(event_id // 3 % n) - 1 ELSE event_id // 3 % n END
            AS product_id,
        CASE WHEN event_id % 29 = 0 THEN NULL WHEN event_id % 5 = 0 THEN date_trunc('hour', CAST(ts AS TIMESTAMP))
             ELSE CAST(ts AS TIMESTAMP) END AS ts,
        CAST(CASE WHEN event_id % 17 = 0 THEN 0 ELSE 5 + event_id % 90 END AS DECIMAL(10,2)) AS price
    FROM events, rng WHERE event_type = 'signup' AND event_id % 3 <> 0),
pj AS (SELECT *, CASE WHEN product_id IS NULL THEN 'W2:missing_key' WHEN ts IS NULL THEN 'W2:missing_time'
        WHEN product_id NOT IN (SELECT product_id FROM st_product) THEN 'W2:unknown_key'
        WHEN price <= 0 THEN 'V6:price:range' END AS why FROM pc),
pt AS (SELECT product_id, ts, arg_max(price, change_id) AS price FROM pj WHERE why IS NULL GROUP BY product_id, ts
    UNION ALL SELECT product_id, NULL, price FROM st_product),
steps AS (SELECT product_id, ts, price FROM (SELECT *, lag(price) OVER (PARTITION BY product_id ORDER BY ts NULLS FIRST) AS was
    FROM pt) WHERE was IS NULL OR was <> price),
hist AS (SELECT product_id, ts AS valid_from, lead(ts) OVER (PARTITION BY product_id ORDER BY ts NULLS FIRST) AS valid_to, price
    FROM steps),
raw AS (SELECT event_id AS k, CAST(ts AS TIMESTAMP) AS ts, user_id AS customer_id, event_id % n AS product_id,
        CASE WHEN event_type IN ('click', 'view') THEN 'add' WHEN event_type = 'error' THEN 'remove'
             WHEN event_type = 'purchase' THEN 'checkout' END AS action
    FROM events, rng WHERE event_type <> 'signup'),
moves AS (SELECT product_id, ts, 1 AS second, k AS event_id, -1 AS q FROM raw WHERE action = 'add'
    UNION ALL SELECT event_id // 3 % n, CAST(ts AS TIMESTAMP), 0, NULL, 1 + event_id % 5 FROM events, rng
        WHERE event_type = 'signup' AND event_id % 3 = 0),
turn AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY product_id ORDER BY ts, second, event_id) AS i FROM moves),
stock AS (
    SELECT product_id, stock_quantity::BIGINT AS s, 0::BIGINT AS i, NULL::BIGINT AS event_id, TRUE AS met FROM st_product
    UNION ALL
    SELECT t.product_id, CASE WHEN s + t.q >= 0 THEN s + t.q ELSE s END, t.i, t.event_id, s + t.q >= 0
    FROM stock x JOIN turn t ON t.product_id = x.product_id AND t.i = x.i + 1),
refused AS (SELECT event_id FROM stock WHERE NOT met),
ev2 AS (SELECT k AS event_id, ts, customer_id, product_id,
        CASE WHEN k IN (SELECT event_id FROM refused) THEN 'open' ELSE action END AS action FROM raw),
open AS (SELECT customer_id, order_id, ROW_NUMBER() OVER (PARTITION BY customer_id ORDER BY order_id) - 1 AS cart_no
    FROM st_orders WHERE lower(status) = 'cart'),
""" + _STORED[_STORED.index("ev3 AS"):].replace("prev = 'add'", "prev IN ('add', 'open')") \
    .replace("MIN(ts) FILTER (WHERE action = 'add') AS opened_at", "MIN(ts) FILTER (WHERE action IN ('add', 'open')) AS opened_at") \
    .replace("arg_min(event_id, ord) FILTER (WHERE action = 'add')", "arg_min(event_id, ord) FILTER (WHERE action IN ('add', 'open'))") \
    .replace("MIN(ord) FILTER (WHERE action = 'add') AS fa", "MIN(ord) FILTER (WHERE action = 'add') AS fa, MIN(ts) FILTER (WHERE action = 'add') AS first_ts")
ORACLE["W2_price_history"] = with_store("SELECT * FROM hist WHERE valid_from IS NOT NULL", _BUSY, recursive=True)
_stored_lines = ORACLE["W6_store_lines"][len(with_store("", _STORED)):]
_stored_orders = ORACLE["W6_store_orders"][len(with_store("", _STORED)):]
ORACLE["W6_busy_orders"] = with_store(_stored_orders, _BUSY, recursive=True)
ORACLE["W6_busy_lines"] = with_store(_stored_lines.replace("p.price,", """(SELECT arg_max(h.price, COALESCE(h.valid_from,
        TIMESTAMP '1900-01-01')) FROM hist h WHERE h.product_id = t.product_id AND COALESCE(h.valid_from <= t.first_ts, TRUE)),"""),
    _BUSY, recursive=True)
ORACLE["W6_busy_products"] = with_store("""SELECT p.* REPLACE (CAST(s.s AS INTEGER) AS stock_quantity, h.price AS price)
    FROM st_product p JOIN (SELECT product_id, arg_max(s, i) AS s FROM stock GROUP BY product_id) s USING (product_id)
    JOIN hist h ON h.product_id = p.product_id AND h.valid_to IS NULL""", _BUSY, recursive=True)
ORACLE["W6_busy_rejects"] = with_store("""SELECT event_id, 'W6:no_stock' AS reason FROM refused
    UNION ALL SELECT change_id, why FROM pj WHERE why IS NOT NULL
    UNION ALL SELECT NULL, 'W6:missing_event_id' FROM raw WHERE k % 41 = 0
    UNION ALL SELECT -k - 430000000000, 'W6:missing_time' FROM raw WHERE k % 43 = 0
    UNION ALL SELECT -k - 470000000000, 'W6:missing_customer' FROM raw WHERE k % 47 = 0
    UNION ALL SELECT -k - 530000000000, 'W6:missing_action' FROM raw WHERE k % 53 = 0
    UNION ALL SELECT -k - 590000000000, 'W6:missing_product' FROM raw WHERE k % 59 = 0 AND action = 'add'""", _BUSY, recursive=True)

# ---- job outputs not covered above ----
ORACLE["W5_products_after_delete"] = with_store(
    "SELECT * FROM st_product WHERE product_id NOT IN (SELECT product_id FROM dels)", _DELETES)
ORACLE["W5_purchase_lines_after_delete"] = with_store(
    "SELECT * FROM st_purchase_order_details WHERE product_id NOT IN (SELECT product_id FROM dels)", _DELETES)
ORACLE["W7_checkout_lines"] = with_store("""SELECT * REPLACE (is_valid AND order_id NOT IN (SELECT order_id FROM done) AS is_valid)
    FROM st_order_details""", _CHECKOUT)
ORACLE["W7_checkout_invoices"] = with_store("""SELECT * FROM st_invoice
    UNION ALL SELECT invoice_id, order_id, DATE '2024-02-01', TRUE FROM inv""", _CHECKOUT)
_PURCHASED = _PURCHASE + """,
made AS (SELECT change_id, (SELECT MAX(purchase_order_id) FROM st_purchase_order) + ROW_NUMBER() OVER (ORDER BY change_id)
        AS purchase_order_id FROM chk WHERE NOT (r_missing OR r_date OR r_supp OR r_item))"""
ORACLE["W9_new_purchase_lines"] = with_store("""SELECT purchase_order_id, product_id, price, quantity, TRUE AS is_valid
    FROM itm JOIN made USING (change_id)""", _PURCHASED)
ORACLE["W9_stocked_products"] = with_store("""SELECT p.* REPLACE (CAST(p.stock_quantity + COALESCE(q, 0) AS INTEGER) AS stock_quantity)
    FROM st_product p LEFT JOIN (SELECT product_id, SUM(quantity) AS q FROM itm JOIN made USING (change_id) GROUP BY 1) m
      ON m.product_id = p.product_id""", _PURCHASED)
# purchases in one order with switches: the state at a request is the last switch before it
_SWITCHED = """four AS (SELECT l_orderkey, l_suppkey AS supplier_id, 4 * (l_orderkey * (SELECT max(s_suppkey) + 1 FROM supplier) + l_suppkey) AS ask,
        MAX(l_partkey) AS product_id, MAX(CAST(l_shipdate AS DATE)) + 30 AS due FROM lineitem GROUP BY l_orderkey, l_suppkey),
pf AS (SELECT ask - 1 AS change_id, product_id, l_orderkey % 3 <> 0 AS flag FROM four),
sf AS (SELECT ask - 2 AS change_id, supplier_id, l_orderkey % 16 <> 0 AS flag FROM four WHERE l_orderkey % 8 = 0),
itm AS (SELECT 4 * (l_orderkey * (SELECT max(s_suppkey) + 1 FROM supplier) + l_suppkey) AS ask, l_partkey AS product_id,
        MAX(CAST(l_extendedprice AS DECIMAL(10,2))) AS price, CAST(SUM(CAST(l_quantity AS INTEGER)) AS INTEGER) AS quantity
    FROM lineitem GROUP BY l_orderkey, l_suppkey, l_partkey),
found AS (SELECT i.*, p.product_id IS NOT NULL AND COALESCE(f.flag, p.is_valid) AS is_on
    FROM itm i ASOF LEFT JOIN pf f ON i.product_id = f.product_id AND i.ask >= f.change_id
    LEFT JOIN st_product p ON i.product_id = p.product_id),
chk AS (SELECT h.*, COALESCE(h.due <= DATE '1995-06-01', FALSE) AS r_date,
        NOT (s.supplier_id IS NOT NULL AND COALESCE(f.flag, s.is_valid)) AS r_supp,
        h.ask IN (SELECT ask FROM found WHERE NOT is_on) AS r_item
    FROM four h ASOF LEFT JOIN sf f ON h.supplier_id = f.supplier_id AND h.ask >= f.change_id
    LEFT JOIN st_supplier s ON h.supplier_id = s.supplier_id),
made AS (SELECT * FROM chk WHERE NOT (r_date OR r_supp OR r_item))"""
ORACLE["W9_switched_orders"] = with_store("""SELECT
        (SELECT MAX(purchase_order_id) FROM st_purchase_order) + ROW_NUMBER() OVER (ORDER BY ask) AS purchase_order_id,
        supplier_id % 25 AS employee_id, supplier_id, DATE '1995-06-01' AS order_date, CAST(due AS DATE) AS expected_received_date,
        CAST(NULL AS DATE) AS actual_received_date, 'pending' AS delivery_status, TRUE AS is_valid FROM made""", _SWITCHED)
ORACLE["W9_switched_products"] = with_store("""SELECT p.* REPLACE (CAST(p.stock_quantity + COALESCE(q, 0) AS INTEGER) AS stock_quantity,
        COALESCE(l.flag, p.is_valid) AS is_valid)
    FROM st_product p LEFT JOIN (SELECT product_id, SUM(quantity) AS q FROM itm WHERE ask IN (SELECT ask FROM made) GROUP BY 1) m
      ON m.product_id = p.product_id
    LEFT JOIN (SELECT product_id, arg_max(flag, change_id) AS flag FROM pf GROUP BY 1) l ON l.product_id = p.product_id""", _SWITCHED)
ORACLE["W9_switched_rejects"] = with_store("""
    SELECT ask AS change_id, 'V9:expected_date_not_after_as_of' AS reason FROM chk WHERE r_date
    UNION ALL SELECT ask, 'W9:supplier_inactive' FROM chk WHERE r_supp
    UNION ALL SELECT ask, 'W9:inactive_product' FROM chk WHERE r_item
    UNION ALL SELECT change_id, CASE WHEN p.product_id IS NULL THEN 'W3:unknown_key' ELSE 'W3:state_guard' END
        FROM (SELECT *, LAG(flag) OVER (PARTITION BY product_id ORDER BY change_id) AS was FROM pf) f
        LEFT JOIN st_product p ON p.product_id = f.product_id
        WHERE p.product_id IS NULL OR (NOT flag AND NOT COALESCE(was, p.is_valid))
    UNION ALL SELECT change_id, CASE WHEN s.supplier_id IS NULL THEN 'W3:unknown_key' ELSE 'W3:state_guard' END
        FROM (SELECT *, LAG(flag) OVER (PARTITION BY supplier_id ORDER BY change_id) AS was FROM sf) f
        LEFT JOIN st_supplier s ON s.supplier_id = f.supplier_id
        WHERE s.supplier_id IS NULL OR (NOT flag AND NOT COALESCE(was, s.is_valid))""", _SWITCHED)
ORACLE["A7_patched_in_place"] = ORACLE["W2_patched_products"]
ORACLE["A7_checked_out_orders"] = ORACLE["W7_checkout_orders"]
ORACLE["A7_checked_out_invoices"] = ORACLE["W7_checkout_invoices"]
