"""Validation with quarantine.

``validate(df, rules)`` splits rows into good rows and a quarantine that keeps the row plus an
``array<string>`` of failed rule codes. Rules are plain column conditions ("row is bad when
..."); a condition that evaluates to NULL does not fail, as a SQL CHECK passes on NULL.
Rules that need other rows (duplicate keys, missing parents) first add a flag column by an
aggregate or a join; both are shuffled on the key with map-side partial aggregation, and a
duplicate storm on one key is reduced before the shuffle.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mercato.operators.key_set import BROADCAST_BUCKETS, KEYS_PER_BUCKET, dense, key_set, with_membership
from mercato.session import kept
from mercato.sources.schemas import (DELIVERY_STATUSES, EMP_ROLES, FOREIGN_KEYS, PRIMARY_KEYS, SCHEMAS,
                                     VARCHAR_LIMITS)

# ---- fixed patterns that must equal the reference's form checks --------------------------------
EMAIL_PATTERN = r"^[^\s@]+@[^\s@]+\.[^\s@]+$"
PHONE_PATTERN = r"^\d{10}$"
# manager_id default in the reference schema; no employee has it
MANAGER_DEFAULT = -1

Rule = tuple[str, Column]


def validate(df: DataFrame, rules: list[Rule], reasons: str = "reasons") -> tuple[DataFrame, DataFrame]:
    """Return (good, quarantine). Quarantine rows carry the failed rule codes in ``reasons``."""
    codes = F.filter(F.array(*[F.when(bad, F.lit(code)) for code, bad in rules]), lambda x: x.isNotNull())
    tagged = df.withColumn(reasons, codes)
    good = tagged.where(F.size(reasons) == 0).drop(reasons)
    quarantine = tagged.where(F.size(reasons) > 0)
    return good, quarantine


def violations(quarantine: DataFrame, keys: list[str], reasons: str = "reasons") -> DataFrame:
    """One row per (key, failed rule): the flat form of a quarantine."""
    return quarantine.select(*keys, F.explode(reasons).alias("reason"))


# ---- flags that need other rows ---------------------------------------------------------------
# Repeated keys up to this many (about 10 MB) go to the rows; of more, a set of their hashes does.
BROADCAST_KEYS = 100_000
# Bits of that set per repeated key, while it is below its bound: 16 MB.
BITS_PER_HASH = 8


def with_duplicate_flag(df: DataFrame, keys: list[str], flag: str = "_dup") -> DataFrame:
    """V1: ``flag`` is true for every row whose key (without nulls) occurs more than once. The
    repeated keys are found first; where they are few, only keys are shuffled, never the rows.
    Where they are many, only the rows whose hash is that of a repeated key are, once."""
    columns, whole = [*df.columns, flag], reduce(Column.__and__, [F.col(k).isNotNull() for k in keys])
    repeated = kept(df.where(whole).groupBy(*keys).agg(F.count(F.lit(1)).alias("_copies"))
                    .where(F.col("_copies") > 1).select(*keys))
    n = repeated.count()
    if n == 0:
        return df.withColumn(flag, F.lit(False))

    def flagged(rows: DataFrame, found: DataFrame) -> DataFrame:
        return rows.join(found, keys, "left").withColumn(flag, F.col("_copies").isNotNull()).select(*columns)

    marked = repeated.withColumn("_copies", F.lit(True))
    if n <= BROADCAST_KEYS:
        return flagged(df, F.broadcast(marked))
    rows, others = _by_hash(df, keys, repeated, n)
    rows = flagged(rows, marked)
    if "void" not in rows.schema.simpleString():  # files hold no column without a type
        rows = kept(rows)
    return others.withColumn(flag, F.lit(False)).select(*columns).unionByName(rows)


def _by_hash(df: DataFrame, keys: list[str], among: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """(rows of ``df`` whose keys hash like one of the ``n`` keys of ``among``, all other rows). The
    hashes go to the rows as a set of at most ``BROADCAST_BUCKETS`` buckets."""
    buckets = min(BROADCAST_BUCKETS - 2, -(-n * BITS_PER_HASH // KEYS_PER_BUCKET))
    place = F.pmod(F.xxhash64(*keys), F.lit(buckets * KEYS_PER_BUCKET)).alias("_hash")
    hashes = key_set(among.select(place), "_hash")
    tagged = with_membership(df.select("*", place), "_hash", hashes, "_alike", buckets + 2)
    return tuple(tagged.where(rows).select(*df.columns) for rows in (F.col("_alike"), ~F.col("_alike")))


def with_parent_flag(df: DataFrame, column: str, parent: DataFrame, parent_column: str, flag: str) -> DataFrame:
    """V3: ``flag`` is true when the non-null foreign key has no parent row."""
    keys = parent.select(F.col(parent_column).alias(column)).distinct().withColumn("_hit", F.lit(True))
    out = df.join(keys, column, "left")
    return out.withColumn(flag, F.col(column).isNotNull() & F.col("_hit").isNull()).drop("_hit")


def with_parent_bit(df: DataFrame, column: str, parent: DataFrame, parent_column: str, flag: str) -> DataFrame:
    """V3 as ``with_parent_flag``, for whole-number keys: where the parents' keys lie close
    together they are reduced to bitmaps, and neither the parent table nor (up to a measured size)
    ``df`` is shuffled; elsewhere by the join of keys."""
    buckets = dense(parent, parent_column)
    if buckets is None:
        return with_parent_flag(df, column, parent, parent_column, flag)
    out = with_membership(df, column, key_set(parent, parent_column), "_known", buckets)
    return out.withColumn(flag, F.col(column).isNotNull() & ~F.col("_known")).drop("_known")


# ---- row rules from the declared schema --------------------------------------------------------
def not_null_rules(table: str, columns: list[str]) -> list[Rule]:
    """V2: declared NOT NULL columns."""
    return [(f"V2:{f.name}:null", F.col(f.name).isNull()) for f in SCHEMAS[table].fields
            if not f.nullable and f.name in columns]


def length_rules(table: str, columns: list[str]) -> list[Rule]:
    """V2: VARCHAR length limits."""
    return [(f"V2:{c}:length", F.length(c) > n) for c, n in VARCHAR_LIMITS.get(table, {}).items() if c in columns]


RANGE_RULES: dict[str, list[tuple[str, str]]] = {
    # V6: declared CHECKs (column, condition that is bad)
    "customer": [("order_count", "order_count < 0")],
    "hourly_employee": [("hours_worked", "hours_worked < 0"), ("hourly_wages", "hourly_wages <= 0")],
    "contract": [("salary", "salary <= 0")],
    "product": [("price", "price <= 0"), ("stock_quantity", "stock_quantity < 0")],
    "order_details": [("price", "price <= 0"), ("quantity", "quantity <= 0")],
    "purchase_order_details": [("price", "price <= 0"), ("quantity", "quantity <= 0")],
    "payment": [("amount_paid", "amount_paid < 0")],
}


def range_rules(table: str, columns: list[str]) -> list[Rule]:
    return [(f"V6:{c}:range", F.expr(bad)) for c, bad in RANGE_RULES.get(table, []) if c in columns]


def domain_rules(table: str, columns: list[str]) -> list[Rule]:
    """V7: role and delivery status lists, compared case-insensitively."""
    out: list[Rule] = []
    if table == "employee" and "emp_role" in columns:
        out.append(("V7:emp_role:domain", ~F.lower("emp_role").isin([r.lower() for r in EMP_ROLES])))
    if table == "purchase_order" and "delivery_status" in columns:
        out.append(("V7:delivery_status:domain",
                    ~F.lower("delivery_status").isin([s.lower() for s in DELIVERY_STATUSES])))
    return out


def contact_rules(columns: list[str]) -> list[Rule]:
    """V4 / V5: email and 10-digit phone, checked only when present."""
    out: list[Rule] = []
    if "email_address" in columns:
        out.append(("V4:email_address:pattern", ~F.col("email_address").rlike(EMAIL_PATTERN)))
    if "phone_number" in columns:
        out.append(("V5:phone_number:pattern", (F.trim("phone_number") != "")
                    & ~F.col("phone_number").rlike(PHONE_PATTERN)))
    return out


def table_rules(table: str, columns: list[str], contact: bool = False) -> list[Rule]:
    rules = not_null_rules(table, columns) + length_rules(table, columns) + range_rules(table, columns) \
        + domain_rules(table, columns)
    if table == "contract":
        rules.append(("V8:contract:dates", F.col("contract_start_date") >= F.col("contract_end_date")))
    if contact:
        rules += contact_rules(columns)
    return rules


def validate_table(store: Mapping[str, DataFrame], table: str, contact: bool = False,
                   check_keys: bool = True, check_parents: bool = True) -> tuple[DataFrame, DataFrame]:
    """Validate a store table against its declared key, parents and row rules."""
    df = store[table]
    cols = df.columns
    rules = table_rules(table, cols, contact)
    if check_keys:
        df = with_duplicate_flag(df, PRIMARY_KEYS[table], "_dup")
        rules.append(("V1:primary_key:duplicate", F.col("_dup")))
    if check_parents:
        for (child, column), (parent, parent_column) in FOREIGN_KEYS.items():
            if child != table:
                continue
            flag = f"_orphan_{column}"
            df = with_parent_flag(df, column, store[parent], parent_column, flag)
            rules.append((f"V3:{column}:orphan", F.col(flag)))
            if (child, column) == ("employee", "manager_id"):
                rules.append(("V3:manager_id:default", F.col(column) == MANAGER_DEFAULT))
    good, bad = validate(df, rules)
    helper = [c for c in df.columns if c.startswith("_")]
    return good.drop(*helper), bad.drop(*helper)


def table_violations(store: Mapping[str, DataFrame], table: str, contact: bool = False) -> DataFrame:
    _, bad = validate_table(store, table, contact)
    return violations(bad, PRIMARY_KEYS[table])


# ---- V11 consistency reports -----------------------------------------------------------------
def payment_mismatch(store: Mapping[str, DataFrame]) -> DataFrame:
    """Payments whose amount differs from the value of all lines of the paid order."""
    pay = store["payment"].select("payment_id", "invoice_id", "amount_paid")
    inv = store["invoice"].select("invoice_id", "order_id")
    od = store["order_details"]
    lines_value = od.groupBy("order_id").agg(F.sum(F.col("price") * F.col("quantity")).cast("decimal(38,2)")
                                             .alias("lines_value"))
    out = pay.join(inv, "invoice_id").join(lines_value, "order_id", "left")
    return out.where(~F.col("amount_paid").eqNullSafe(F.col("lines_value"))).select(
        "payment_id", "order_id", "amount_paid", "lines_value")


def line_price_drift(store: Mapping[str, DataFrame]) -> DataFrame:
    """Lines whose copied price differs from the product's current price."""
    p = store["product"].select("product_id", F.col("price").alias("current_price"))
    od = store["order_details"].select("order_id", "product_id", "price")
    return od.join(p, "product_id").where(F.col("price") != F.col("current_price")).select(
        "order_id", "product_id", "price", "current_price")


def order_count_drift(store: Mapping[str, DataFrame]) -> DataFrame:
    """Customers whose stored order counter is not the number of their active orders."""
    c = store["customer"].select("customer_id", F.col("order_count").alias("stored_count"))
    n = store["orders"].where("is_valid").groupBy("customer_id").agg(F.count(F.lit(1)).alias("_n"))
    out = c.join(n, "customer_id", "left").withColumn("counted", F.coalesce("_n", F.lit(0))).drop("_n")
    return out.where(~F.col("stored_count").eqNullSafe(F.col("counted"))).select(
        "customer_id", "stored_count", "counted")
