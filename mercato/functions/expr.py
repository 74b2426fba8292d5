"""Column expressions (E1-E16) and predicates.

All are built-in Spark expressions, so they stay inside whole-stage codegen. Text comparison
follows the reference's case-insensitive default collation: ``lower(a) = lower(b)`` and ``ilike``.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mercato.sources.schemas import LINE_MONEY

# ---- fixed values that must equal the reference's labels -------------------------------------
NA = "N/A"
UNKNOWN_PRODUCT = "Unknown Product"
NOT_RECEIVED = "Not received yet"
TRUE_WORDS = ["true", "1", "active"]
MANAGER_ROLES = ["Manager", "Assistant Manager"]


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# F1
def active(df: DataFrame, flag: str = "is_valid") -> DataFrame:
    """Soft-delete filter: rows whose flag is true."""
    return df.where(F.col(flag))


# F2
def text_equals(c, value: str) -> Column:
    """Case-insensitive equality."""
    return F.lower(col(c)) == F.lower(F.lit(value))


# F3
def contains_ci(c, value: str) -> Column:
    """``col LIKE '%v%'`` case-insensitively; ``%`` and ``_`` typed by the user stay wildcards."""
    return col(c).ilike(f"%{value}%")


# F6
def parse_flag(value: str) -> bool:
    return value.strip().lower() in TRUE_WORDS if value is not None else False


# F7
def parse_tristate(value: str) -> bool | None:
    v = (value or "").strip().lower()
    return True if v == "true" else False if v == "false" else None


# F11 / F12
def is_manager_role(c="emp_role") -> Column:
    return col(c).ilike("%manager%")


def in_roles(c, roles) -> Column:
    return F.lower(col(c)).isin([r.lower() for r in roles])


# E1
def employee_type(hourly_key, contract_key) -> Column:
    """Hourly before Contract before Regular (an employee in both tables is Hourly)."""
    return (F.when(col(hourly_key).isNotNull(), "Hourly")
            .when(col(contract_key).isNotNull(), "Contract")
            .otherwise("Regular"))


# E2 (manager page, and F10 predicate twin)
def delivery_status_text(actual="actual_received_date", expected="expected_received_date") -> Column:
    """Cart when not received, Completed when on time, Delayed when late; NULL when the expected
    date is missing (SQL reading of the date compare)."""
    a, e = col(actual), col(expected)
    return (F.when(a.isNull(), "Cart")
            .when(a <= e, "Completed")
            .when(a > e, "Delayed"))


# E3 (employee page)
def employee_status_text(status="status", actual="actual_received_date", expected="expected_received_date") -> Column:
    s, a, e = col(status), col(actual), col(expected)
    capital = F.concat(F.upper(F.substring(s, 1, 1)), F.substring(s, 2, 1 << 30))
    late = (s == "completed") & a.isNotNull() & e.isNotNull() & (a > e)
    stored = F.when(late, F.concat(capital, F.lit(" (Delayed)"))).otherwise(capital)
    by_dates = (F.when(a.isNull(), "Pending")
                .when(a <= e, "Completed")
                .otherwise("Delayed"))
    has_status = s.isNotNull() & (s != "")
    return F.when(has_status, stored).otherwise(by_dates)


# E4 / E5
def line_value(price="price", quantity="quantity") -> Column:
    return (col(price) * col(quantity)).cast(LINE_MONEY)


# E6
def dollars(c) -> Column:
    """``CONCAT('$', x)``: NULL in gives NULL out."""
    return F.concat(F.lit("$"), col(c).cast("string"))


# E7 / E9
def zero_if_null(c, zero=0) -> Column:
    return F.coalesce(col(c), F.lit(zero))


def label_if_null(c, label: str) -> Column:
    return F.coalesce(col(c), F.lit(label))


# E8
def money_text(c, thousands: bool = False) -> Column:
    """``'%.2f'`` or ``'{:,.2f}'`` text of an amount (money has exactly two decimals, so its
    double value prints the same digits)."""
    return F.format_number(col(c), 2) if thousands else F.format_string("%.2f", col(c).cast("double"))


# E10 / E11
def iso_date(c) -> Column:
    return F.date_format(col(c), "yyyy-MM-dd")


def parse_date(c) -> Column:
    return F.try_to_date(col(c), F.lit("yyyy-MM-dd")) if hasattr(F, "try_to_date") else F.to_date(col(c), "yyyy-MM-dd")


# E12
def as_of_date(as_of: _dt.date | None) -> Column:
    return F.lit(as_of) if as_of is not None else F.current_date()


# E13
def blank_to_null(c) -> Column:
    return F.nullif(F.trim(col(c)), F.lit(""))


# E16
def active_label(c="is_valid") -> Column:
    return F.when(col(c), "Active").otherwise("Inactive")


def average(total, count) -> Column:
    """Unrounded ``CAST(SUM(x) AS DOUBLE) / COUNT(*)`` (the same text on the oracle side)."""
    return col(total).cast("double") / col(count)
