"""Employee report (R22-R30) and employee lookups (R41-R44), for every employee at once.

The report counts only active lines (``line_scope='active'``, S2).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mercato.functions.expr import (MANAGER_ROLES, active, average, employee_type, in_roles, is_manager_role,
                                    line_value, zero_if_null)
from mercato.operators.joins import left_join_filtered, lookup, without
from mercato.operators.ranking import keep_at_least_max
from mercato.plans.common import Store, active_orders, by_order, lines, order_totals
from mercato.sources.schemas import LINE_MONEY, SUM_MONEY


def _employees(store: Store, employee_ids: DataFrame | None) -> DataFrame:
    e = store["employee"]
    return lookup(e, employee_ids, "employee_id") if employee_ids is not None else e


def orders_handled(store: Store, employee_ids=None) -> DataFrame:
    """Active orders per employee, 0 when none."""
    n = active_orders(store).groupBy("employee_id").agg(F.count(F.lit(1)).alias("total_orders_handled"))
    return (_employees(store, employee_ids).select("employee_id").join(n, "employee_id", "left")
            .select("employee_id", zero_if_null("total_orders_handled").alias("total_orders_handled")))


def sales_value(store: Store, employee_ids=None) -> DataFrame:
    """Value of active lines of active orders per employee, 0 when none."""
    per_order = order_totals(store, "active", active_orders(store, "order_id", "employee_id"))
    v = per_order.groupBy("employee_id").agg(F.sum("order_value").cast(SUM_MONEY).alias("total_sales_value"))
    return (_employees(store, employee_ids).select("employee_id").join(v, "employee_id", "left")
            .select("employee_id", F.coalesce("total_sales_value", F.lit(0).cast(SUM_MONEY)).alias("total_sales_value")))


def purchase_orders_made(store: Store, employee_ids=None) -> DataFrame:
    """Active purchase orders per employee with supplier name (supplier flag not checked),
    newest first."""
    po = active(store["purchase_order"])
    if employee_ids is not None:
        po = lookup(po, employee_ids, "employee_id")
    s = store["supplier"].select("supplier_id", "supplier_name")
    return (po.join(s, "supplier_id")
            .select("employee_id", "purchase_order_id", "supplier_name", "order_date", "delivery_status")
            .orderBy(F.col("order_date").desc_nulls_last(), "purchase_order_id"))


def handled_lines(store: Store, employee_ids=None) -> DataFrame:
    """Active lines of active orders with product name and line value, newest first."""
    o = active_orders(store, "order_id", "employee_id", "order_date").where(F.col("employee_id").isNotNull())
    if employee_ids is not None:
        o = lookup(o, employee_ids, "employee_id")
    li = by_order(store, "active", o, lambda li, o, small: (
        li.select("order_id", "product_id", "quantity", "price").join(small(o), "order_id")))
    p = store["product"].select("product_id", "product_name")
    return (li.join(p, "product_id")
            .select("employee_id", "order_id", "order_date", "product_id", "product_name", "quantity", "price",
                    line_value().alias("total_value"))
            .orderBy(F.col("order_date").desc(), "order_id", "product_id"))


def pay_info(store: Store, employee_ids=None) -> DataFrame:
    """Hourly pay if the employee has an active hourly row, else active contract pay."""
    he = active(store["hourly_employee"])
    hourly = he.select("employee_id", F.lit("Hourly").alias("type"), F.col("hourly_wages").alias("salary_or_wage"),
                       "hours_worked", (F.col("hourly_wages") * F.col("hours_worked")).cast(LINE_MONEY).alias("total_pay"))
    ce = active(store["contract_employee"]).select("employee_id", "contract_id")
    c = active(store["contract"]).select("contract_id", "salary")
    contract = ce.join(c, "contract_id").select(
        "employee_id", F.lit("Contract").alias("type"), F.col("salary").alias("salary_or_wage"),
        F.lit(None).cast("int").alias("hours_worked"), F.lit(None).cast(LINE_MONEY).alias("total_pay"))
    out = hourly.unionByName(without(contract, hourly, "employee_id"))
    return lookup(out, employee_ids, "employee_id") if employee_ids is not None else out


def min_line_value(store: Store) -> DataFrame:
    """Smallest active line value."""
    return lines(store, "active").agg(F.min(line_value()).alias("min_value"))


def min_value_handlers(store: Store) -> DataFrame:
    """Employees whose active orders hold an active line of the smallest value (distinct)."""
    smallest = lines(store, "active").agg(F.min(line_value())).scalar()
    of_value = by_order(store, "active", active_orders(store, "order_id", "employee_id"), lambda li, o, small: (
        li.select("order_id", line_value().alias("order_value")).where(F.col("order_value") == smallest)
        .join(small(o), "order_id")))
    e = store["employee"].select("employee_id", "employee_name")
    return (of_value.join(e, "employee_id")
            .select("employee_name", "order_id", "order_value").distinct())


def avg_line_value(store: Store) -> DataFrame:
    """Average active line value per employee name (a line average, as in the reference)."""
    per_order = order_totals(store, "active", active_orders(store, "order_id", "employee_id"))
    per_emp = per_order.groupBy("employee_id").agg(F.sum("order_value").alias("v"), F.sum("order_lines").alias("n"))
    e = store["employee"].select("employee_id", "employee_name")
    by_name = per_emp.join(e, "employee_id").groupBy(F.lower("employee_name").alias("_key")).agg(
        F.min("employee_name").alias("employee_name"), F.sum("v").alias("v"), F.sum("n").alias("n"))
    return by_name.select("employee_name", average("v", "n").alias("avg_order_value")).orderBy("employee_name")


def busiest_employees(store: Store, ignore_unassigned: bool = False) -> DataFrame:
    """Employee name(s) with at least as many active orders as any employee id; the
    threshold also counts the unassigned group (S20) unless ``ignore_unassigned``."""
    per_id = active_orders(store, "employee_id").groupBy("employee_id").agg(F.count(F.lit(1)).alias("n"))
    e = store["employee"].select("employee_id", "employee_name")
    per_name = per_id.join(e, "employee_id").groupBy(F.lower("employee_name").alias("_key")).agg(
        F.min("employee_name").alias("employee_name"), F.sum("n").alias("order_count")).drop("_key")
    threshold = per_id.where(F.col("employee_id").isNotNull()) if ignore_unassigned else per_id
    return keep_at_least_max(per_name, "order_count", threshold.select("n"))


def employee_report(store: Store, employee_ids=None) -> dict[str, DataFrame]:
    return {"orders_handled": orders_handled(store, employee_ids), "sales_value": sales_value(store, employee_ids),
            "purchase_orders": purchase_orders_made(store, employee_ids),
            "handled_lines": handled_lines(store, employee_ids), "pay_info": pay_info(store, employee_ids),
            "min_value": min_line_value(store), "min_value_handlers": min_value_handlers(store),
            "avg_line_value": avg_line_value(store), "busiest_employees": busiest_employees(store)}


def employee_with_manager(store: Store, include_inactive: bool = True, employee_ids=None) -> DataFrame:
    """Employee with the manager's name and email (left self-join keeps top-level staff)
    and the raw subtype rows (flags not checked, S12)."""
    e = store["employee"] if include_inactive else active(store["employee"])
    if employee_ids is not None:
        e = lookup(e, employee_ids, "employee_id")
    m = store["employee"].select(F.col("employee_id").alias("manager_id"),
                                 F.col("employee_name").alias("manager_name"),
                                 F.col("email_address").alias("manager_email"))
    he = store["hourly_employee"].select("employee_id", "hours_worked", "hourly_wages")
    ce = store["contract_employee"].select("employee_id", "contract_id")
    return e.join(m, "manager_id", "left").join(he, "employee_id", "left").join(ce, "employee_id", "left").select(
        *store["employee"].columns, "manager_name", "manager_email", "hours_worked", "hourly_wages", "contract_id")


def typed_employees(store: Store) -> DataFrame:
    """Active employees with the derived type from active subtype rows."""
    e = active(store["employee"])
    he = store["hourly_employee"].select("employee_id", F.col("employee_id").alias("_he"), F.col("is_valid").alias("_hv"))
    ce = store["contract_employee"].select("employee_id", F.col("employee_id").alias("_ce"), F.col("is_valid").alias("_cv"))
    t = left_join_filtered(e, he, "employee_id", F.col("_hv"))
    t = left_join_filtered(t, ce, "employee_id", F.col("_cv"))
    return t.withColumn("employee_type", employee_type("_he", "_ce"))


def employee_detail(store: Store, employee_ids=None) -> DataFrame:
    """Active employee with type, and wage terms (Hourly) or contract terms (Contract)."""
    t = typed_employees(store)
    if employee_ids is not None:
        t = lookup(t, employee_ids, "employee_id")
    he = active(store["hourly_employee"]).select("employee_id", "hours_worked", "hourly_wages")
    terms = (active(store["contract_employee"]).select("employee_id", "contract_id")
             .join(active(store["contract"]).select("contract_id", "contract_start_date", "contract_end_date", "salary"),
                   "contract_id").drop("contract_id"))
    out = t.join(he, "employee_id", "left").join(terms, "employee_id", "left")
    hourly, contract = F.col("employee_type") == "Hourly", F.col("employee_type") == "Contract"
    return out.select(
        *store["employee"].columns, "employee_type",
        F.when(hourly, F.col("hours_worked")).alias("hours_worked"),
        F.when(hourly, F.col("hourly_wages")).alias("hourly_wages"),
        F.when(contract, F.col("contract_start_date")).alias("contract_start_date"),
        F.when(contract, F.col("contract_end_date")).alias("contract_end_date"),
        F.when(contract, F.col("salary")).alias("salary"))


def manager_choices(store: Store) -> DataFrame:
    """Active employees whose role mentions Manager, by name."""
    return (active(store["employee"]).where(is_manager_role()).select("employee_id", "employee_name")
            .orderBy("employee_name", "employee_id"))


def acting_managers(store: Store) -> DataFrame:
    """Employees in a manager role who manage somebody (semi join on manager ids)."""
    e = store["employee"]
    manages = e.where(F.col("manager_id").isNotNull()).select(F.col("manager_id").alias("employee_id"))
    return e.where(in_roles("emp_role", MANAGER_ROLES)).join(manages, "employee_id", "left_semi")
