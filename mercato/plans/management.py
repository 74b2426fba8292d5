"""Management report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mercato.functions.expr import active, dollars, is_manager_role, text_equals
from mercato.operators.ranking import keep_at_least_max
from mercato.plans.common import Store, active_orders, lines, order_totals
from mercato.sources.schemas import SUM_MONEY

KPI_TABLES = [("total_employees", "employee"), ("total_customers", "customer"), ("total_suppliers", "supplier"),
              ("total_orders", "orders"), ("total_purchase_orders", "purchase_order"), ("total_products", "product")]


def kpis(store: Store) -> DataFrame:
    """Active row counts of six tables in one row. Each table is counted in its own
    partial aggregate; the six one-row results are unioned and folded into columns by a global
    aggregate, so no join (and no cross join) is needed."""
    parts = [store[t].agg(F.count_if(F.col("is_valid")).alias("n")).select(F.lit(name).alias("metric"), "n")
             for name, t in KPI_TABLES]
    stacked = parts[0]
    for p in parts[1:]:
        stacked = stacked.unionByName(p)
    return stacked.agg(*[F.max(F.when(F.col("metric") == name, F.col("n"))).alias(name) for name, _ in KPI_TABLES])


def pending_deliveries(store: Store) -> DataFrame:
    """Active purchase orders whose status is 'Pending' in any letter case."""
    po = store["purchase_order"]
    return po.agg(F.count_if(F.col("is_valid") & text_equals("delivery_status", "Pending"))
                  .alias("pending_deliveries"))


def total_revenue(store: Store) -> DataFrame:
    """Sum of active payments; NULL when there is none (no fallback in the reference)."""
    return active(store["payment"]).agg(F.sum("amount_paid").cast(SUM_MONEY).alias("total_revenue"))


def team_roster(store: Store, min_reports: int = 2) -> DataFrame:
    """Active employees whose manager has more than ``min_reports`` active reports,
    with the manager's name. The manager row itself may be inactive."""
    e = store["employee"]
    big_teams = (active(e).where(F.col("manager_id").isNotNull()).groupBy("manager_id")
                 .agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > min_reports).select("manager_id"))
    staff = active(e).join(big_teams, "manager_id", "left_semi")
    managers = e.select(F.col("employee_id").alias("manager_id"), F.col("employee_name").alias("manager_name"))
    return (staff.join(managers, "manager_id")
            .select("manager_name", "employee_name", "emp_role")
            .orderBy("manager_name", "employee_name"))


def spend_by_customer(store: Store, line_scope: str) -> DataFrame:
    """Per active customer: spend over active orders (lines reduced per order first)."""
    per_order = order_totals(store, line_scope, active_orders(store, "order_id", "customer_id"))
    spend = per_order.groupBy("customer_id").agg(F.sum("order_value").cast(SUM_MONEY).alias("total_spent"),
                                                 F.count(F.lit(1)).alias("total_orders"))
    c = active(store["customer"]).select("customer_id", "customer_name")
    return spend.join(c, "customer_id")


def top_spenders(store: Store, k: int = 4) -> DataFrame:
    """The ``k`` active customers with most spend (all lines of active orders); ties by id."""
    return (spend_by_customer(store, "all")
            .select("customer_id", "customer_name", "total_spent")
            .orderBy(F.col("total_spent").desc(), F.col("customer_id").asc())
            .limit(k))


def oldest_purchase_orders(store: Store, k: int = 3) -> DataFrame:
    """The ``k`` oldest active purchase orders of active suppliers; ties by id."""
    po = active(store["purchase_order"]).select("purchase_order_id", "supplier_id", "order_date", "delivery_status")
    s = active(store["supplier"]).select("supplier_id", "supplier_name")
    return (po.join(s, "supplier_id")
            .select("supplier_name", "purchase_order_id", "order_date", "delivery_status")
            .orderBy(F.col("order_date").asc_nulls_first(), F.col("purchase_order_id").asc())
            .limit(k))


def pay_summary(store: Store) -> DataFrame:
    """Pay lines of hourly and contract staff as '$' strings; duplicates removed (UNION).
    The employee's own flag is not checked."""
    e = store["employee"].select("employee_id", "employee_name")
    he = active(store["hourly_employee"])
    hourly = he.join(e, "employee_id").select(
        "employee_name", F.lit("Hourly").alias("type"), dollars("hourly_wages").alias("salary_or_wage"),
        dollars(F.col("hours_worked") * F.col("hourly_wages")).alias("total_wage"))
    ce = active(store["contract_employee"]).select("employee_id", "contract_id")
    c = active(store["contract"]).select("contract_id", "salary")
    contract = ce.join(c, "contract_id").join(e, "employee_id").select(
        "employee_name", F.lit("Contract").alias("type"), dollars("salary").alias("salary_or_wage"),
        F.lit(None).cast("string").alias("total_wage"))
    # duplicates differ at most in the case of the name (S1); the least spelling is shown
    rest = ["type", "salary_or_wage", "total_wage"]
    return (hourly.unionByName(contract).groupBy(F.lower("employee_name").alias("_key"), *rest)
            .agg(F.min("employee_name").alias("employee_name")).select("employee_name", *rest))


def first_manager(store: Store) -> DataFrame:
    """One representative employee whose role mentions Manager (lowest id)."""
    return store["employee"].where(is_manager_role()).orderBy("employee_id").limit(1)


def best_sellers(store: Store) -> DataFrame:
    """Product name(s) whose sold quantity (active lines, active products, grouped by
    name) is at least the largest quantity of any single product id (all ties kept)."""
    li = lines(store, "active").select("product_id", "quantity")
    per_id = li.groupBy("product_id").agg(F.sum("quantity").alias("q"))
    p = active(store["product"]).select("product_id", "product_name")
    # names group whatever their case (S1) and show their least spelling
    per_name = (per_id.join(p, "product_id").groupBy(F.lower("product_name").alias("_key"))
                .agg(F.min("product_name").alias("product_name"),
                     F.sum("q").cast("long").alias("total_quantity_sold")).drop("_key"))
    return keep_at_least_max(per_name, "total_quantity_sold", per_id.select("q"))


def lowest_priced_products(store: Store) -> DataFrame:
    """Distinct names of products sold (active lines) at the lowest active line price."""
    li = lines(store, "active").select("product_id", "price")
    min_price = li.agg(F.min("price")).scalar()
    p = store["product"].select("product_id", "product_name")
    return li.where(F.col("price") == min_price).join(p, "product_id").select("product_name").distinct()


def customer_spending(store: Store) -> DataFrame:
    """Per customer with active lines of active orders: distinct orders and spend."""
    per_order = order_totals(store, "active", active_orders(store, "order_id", "customer_id"))
    spend = per_order.groupBy("customer_id").agg(
        F.count(F.lit(1)).alias("total_orders"),
        F.sum("order_value").cast(SUM_MONEY).alias("total_amount_spent"))
    c = store["customer"].select("customer_id", "customer_name")
    return (spend.join(c, "customer_id")
            .select("customer_id", "customer_name", "total_orders", "total_amount_spent")
            .orderBy(F.col("total_amount_spent").desc(), "customer_id"))


def management_report(store: Store) -> dict[str, DataFrame]:
    return {"kpis": kpis(store), "pending_deliveries": pending_deliveries(store),
            "total_revenue": total_revenue(store), "team_roster": team_roster(store),
            "top_spenders": top_spenders(store), "oldest_purchase_orders": oldest_purchase_orders(store),
            "pay_summary": pay_summary(store), "first_manager": first_manager(store),
            "best_sellers": best_sellers(store)}
