"""Store tables with planted violations, derived from the driver's tables, so that every declared
rule (V1-V8) has rows to find and grows with the data. Which row breaks which rule follows from
its key; the oracle repeats these rules in SQL."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mercato.sources.adapter import Store
from mercato.sources.schemas import SCHEMAS


def _typed(df: DataFrame, table: str) -> DataFrame:
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in SCHEMAS[table].fields])


def _pick(key: Column, modulus: int, cases: dict[int, Column], otherwise: Column) -> Column:
    out = otherwise
    for residue, value in cases.items():
        out = F.when(key % modulus == residue, value).otherwise(out)
    return out


def _none(kind: str) -> Column:
    return F.lit(None).cast(kind)


def employees(st: Store) -> DataFrame:
    """One employee per customer row; the employees are each other's managers."""
    k = F.col("c_custkey")
    own = F.when(k % 97 == 5, k - 1).otherwise(k)
    return _typed(st.driver["customer"].select(
        own.alias("employee_id"),
        _pick(k, 11, {0: _none("string"), 1: F.lit("x" * 101)}, F.col("c_name")).alias("employee_name"),
        _pick(k, 7, {0: F.lit("Astronaut")}, F.lit("manager")).alias("emp_role"),
        _pick(k, 5, {0: F.lit("12345"), 1: _none("string")}, F.lpad(k.cast("string"), 10, "0")).alias("phone_number"),
        _pick(k, 6, {0: F.lit("no mail")}, F.concat(F.lit("e"), k.cast("string"), F.lit("@shop.test")))
        .alias("email_address"),
        F.lit(_dt.date(2020, 1, 1)).alias("hire_date"),
        _pick(k, 13, {0: F.lit(-1), 1: -k - 2, 2: _none("long")}, own).alias("manager_id"),
        _pick(k, 17, {0: _none("boolean")}, F.lit(True)).alias("is_valid")), "employee")


def products(st: Store) -> DataFrame:
    p = st["product"]
    k = F.col("product_id")
    rows = p.select(
        _pick(k, 50, {0: _none("long")}, k).alias("product_id"),
        _pick(k, 11, {0: _none("string"), 1: F.lit("x" * 101)}, F.col("product_name")).alias("product_name"),
        _pick(k, 10, {3: F.lit("y" * 51)}, F.col("category")).alias("category"),
        _pick(k, 9, {0: F.lit(0), 1: _none("decimal(10,2)")}, F.col("price")).alias("price"),
        "is_valid", _pick(k, 8, {0: F.lit(-3)}, F.col("stock_quantity")).alias("stock_quantity"), "stock_arrival_date")
    return _typed(rows, "product").unionByName(p.where(k % 31 == 0))


def contracts(st: Store) -> DataFrame:
    """One contract per supplier row."""
    k = F.col("s_suppkey")
    start = F.lit(_dt.date(2023, 1, 1))
    return _typed(st.driver["supplier"].select(
        _pick(k, 10, {7: k - 1}, k).alias("contract_id"),
        _pick(k, 6, {0: _none("date")}, start).alias("contract_start_date"),
        _pick(k, 4, {0: F.lit(_dt.date(2022, 12, 31)), 1: start}, F.lit(_dt.date(2023, 12, 31))).alias("contract_end_date"),
        _pick(k, 5, {0: F.lit(0)}, F.lit(40000)).alias("salary"), F.lit(True).alias("is_valid")), "contract")


def purchase_orders(st: Store) -> DataFrame:
    po = st["purchase_order"]
    k = F.col("purchase_order_id")
    rows = po.select(
        k, _pick(k, 19, {0: F.lit(999)}, F.col("employee_id")).alias("employee_id"),
        _pick(k, 23, {0: F.lit(-1)}, F.col("supplier_id")).alias("supplier_id"),
        _pick(k, 29, {0: _none("date")}, F.col("order_date")).alias("order_date"),
        "expected_received_date", "actual_received_date",
        _pick(k, 17, {0: F.lit("Lost"), 1: _none("string"), 2: F.lit("z" * 51)}, F.col("delivery_status"))
        .alias("delivery_status"), "is_valid")
    return _typed(rows, "purchase_order").unionByName(po.where(k % 31 == 0))


def order_details(st: Store) -> DataFrame:
    od = st["order_details"]
    k = F.col("order_id") + F.col("product_id")
    rows = od.select(
        _pick(k, 11, {0: -F.col("order_id") - 1}, F.col("order_id")).alias("order_id"),
        _pick(k, 13, {0: -F.col("product_id") - 1}, F.col("product_id")).alias("product_id"),
        _pick(k, 9, {0: F.lit(-1), 1: _none("decimal(10,2)")}, F.col("price")).alias("price"),
        _pick(k, 8, {0: F.lit(0)}, F.col("quantity")).alias("quantity"), "is_valid")
    return _typed(rows, "order_details").unionByName(od.where(k % 37 == 0))
