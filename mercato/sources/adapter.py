"""Adapter: the driver's TPC-H-style tables -> the 14 store tables (A1).

Every store table is a projection, filter or grouping of a driver table, written with built-in
column expressions so Catalyst prunes columns and pushes filters into the parquet scans. The
mapping rules are fixed test-data conventions (listed together below); the SQL oracle builds
the same tables with the same rules.

Only ``nation`` (25 rows by the TPC-H definition) is broadcast by hint: its size is fixed.
Everything else is left to the planner and AQE, which broadcast on measured sizes only.
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Callable, Iterator, Mapping
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mercato.session import configure
from mercato.sources.schemas import MONEY, SCHEMAS

# ---- fixed mapping values (test-data conventions, kept together) -----------------------------
# employee role by nation key: <2 Manager, <5 Assistant Manager, <15 Customer Service,
# <20 Procurement Specialist, else Inventory Specialist
ROLE_BOUNDS = [(2, "Manager"), (5, "Assistant Manager"), (15, "Customer Service"), (20, "Procurement Specialist")]
ROLE_ELSE = "Inventory Specialist"
# manager by nation key: <5 none, <13 0, <19 1, <23 2, <24 3, else 4
MANAGER_BOUNDS = [(5, None), (13, 0), (19, 1), (23, 2), (24, 3)]
MANAGER_ELSE = 4
# order status letter -> store status
ORDER_STATUS = {"P": "cart", "O": "confirmed", "F": "completed"}
# purchase order id = l_orderkey * (largest supplier key + 1) + l_suppkey, see purchase_order_id
CONTRACT_START = _dt.date(2023, 1, 1)
CONTRACT_END_BASE = _dt.date(2023, 12, 31)
STOCK_ARRIVAL_BASE = _dt.date(2024, 1, 1)

DRIVER_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]


def _bucket(col: Column, bounds, otherwise) -> Column:
    expr = None
    for upper, value in bounds:
        lit = F.lit(value)
        expr = F.when(col < upper, lit) if expr is None else expr.when(col < upper, lit)
    return expr.otherwise(F.lit(otherwise))


def _conform(df: DataFrame, table: str) -> DataFrame:
    """Select the store columns in declared order with declared types."""
    schema = SCHEMAS[table]
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])


def _null(table: str, name: str) -> Column:
    return F.lit(None).cast(SCHEMAS[table][name].dataType).alias(name)


class DriverTables:
    """Lazy readers for the driver's parquet files."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir.rstrip("/")
        self._cache: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._cache:
            self._cache[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self._cache[name]


def _customer(d: DriverTables) -> DataFrame:
    nation = F.broadcast(d["nation"].select("n_nationkey", "n_name"))
    c = d["customer"].join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return _conform(c.select(
        F.col("c_custkey").alias("customer_id"), F.col("c_name").alias("customer_name"),
        _null("customer", "phone_number"), _null("customer", "email_address"),
        F.col("n_name").alias("city"), F.col("c_mktsegment").alias("shipping_address"),
        F.lit(0).alias("order_count"), (F.col("c_acctbal") >= 0).alias("is_valid")), "customer")


def _employee(d: DriverTables) -> DataFrame:
    k = F.col("n_nationkey")
    return _conform(d["nation"].select(
        k.alias("employee_id"), F.col("n_name").alias("employee_name"),
        _bucket(k, ROLE_BOUNDS, ROLE_ELSE).alias("emp_role"),
        _null("employee", "phone_number"), _null("employee", "email_address"), _null("employee", "hire_date"),
        _bucket(k, MANAGER_BOUNDS, MANAGER_ELSE).alias("manager_id"),
        (k % 11 != 10).alias("is_valid")), "employee")


def _hourly(d: DriverTables) -> DataFrame:
    k = F.col("n_nationkey")
    return _conform(d["nation"].where(k % 3 == 0).select(
        k.alias("employee_id"), (F.lit(30) + k % 11).alias("hours_worked"),
        (F.lit(12) + k * F.lit(0.25).cast("decimal(3,2)")).cast(MONEY).alias("hourly_wages"),
        (k != 9).alias("is_valid")), "hourly_employee")


def _contract_rows(d: DriverTables) -> DataFrame:
    k = F.col("n_nationkey")
    return d["nation"].where((k % 3 == 1) | (k == 6))


def _contract(d: DriverTables) -> DataFrame:
    k = F.col("n_nationkey")
    return _conform(_contract_rows(d).select(
        k.alias("contract_id"), F.lit(CONTRACT_START).alias("contract_start_date"),
        F.date_add(F.lit(CONTRACT_END_BASE), k).alias("contract_end_date"),
        (F.lit(40000) + k * 1000).cast(MONEY).alias("salary"), (k != 13).alias("is_valid")), "contract")


def _contract_employee(d: DriverTables) -> DataFrame:
    k = F.col("n_nationkey")
    return _conform(_contract_rows(d).select(
        k.alias("employee_id"), k.alias("contract_id"), F.lit(True).alias("is_valid")), "contract_employee")


def _product(d: DriverTables) -> DataFrame:
    p = d["part"]
    return _conform(p.select(
        F.col("p_partkey").alias("product_id"),
        F.concat("p_name", F.lit(" "), "p_brand", F.lit(" "), F.col("p_size").cast("string")).alias("product_name"),
        F.col("p_type").alias("category"), F.col("p_retailprice").cast(MONEY).alias("price"),
        (F.col("p_size") % 10 != 0).alias("is_valid"), F.col("p_size").alias("stock_quantity"),
        F.date_add(F.lit(STOCK_ARRIVAL_BASE), F.col("p_size")).alias("stock_arrival_date")), "product")


def _orders(d: DriverTables) -> DataFrame:
    key = F.col("o_orderkey")
    odate = F.to_date(F.col("o_orderdate"))
    status = F.when(F.col("o_orderstatus") == "P", ORDER_STATUS["P"]) \
        .when(F.col("o_orderstatus") == "O", ORDER_STATUS["O"]) \
        .when(F.col("o_orderstatus") == "F", ORDER_STATUS["F"])
    return _conform(d["orders"].select(
        key.alias("order_id"), F.col("o_custkey").alias("customer_id"),
        F.when(key % 50 == 7, F.lit(None)).otherwise(F.col("o_custkey") % 25).alias("employee_id"),
        odate.alias("order_date"), F.date_add(odate, 5).alias("expected_received_date"),
        F.when(F.col("o_orderstatus") == "O", F.lit(None).cast("date"))
         .otherwise(F.date_add(odate, (key % 11).cast("int"))).alias("actual_received_date"),
        status.alias("status"), (key % 20 != 0).alias("is_valid")), "orders")


def _line_money():
    return F.max(F.col("l_extendedprice").cast(MONEY))


def _line_qty():
    # a sum beyond the column becomes NULL and is found by validation
    return F.sum(F.col("l_quantity").cast("int")).try_cast("int")


def _placed(rows: DataFrame, key: str, parts: int | None) -> DataFrame:
    """Rows laid out in ``parts`` by ``key``, so that they are grouped and written where they lie."""
    return rows if parts is None else rows.repartition(parts, key)


def _order_details(d: DriverTables, parts: int | None = None) -> DataFrame:
    # Repeated (order, part) pairs merge like a repeated cart add: one line, summed quantity.
    li = _placed(d["lineitem"].select("l_orderkey", "l_partkey", "l_extendedprice", "l_quantity", "l_returnflag"),
                 "l_orderkey", parts)
    g = li.groupBy("l_orderkey", "l_partkey").agg(
        _line_money().alias("price"), _line_qty().alias("quantity"),
        F.min(F.when(F.col("l_returnflag") == "R", 0).otherwise(1)).alias("_ok"))
    return _conform(g.select(
        F.col("l_orderkey").alias("order_id"), F.col("l_partkey").alias("product_id"), "price", "quantity",
        (F.col("_ok") == 1).alias("is_valid")), "order_details")


def _supplier(d: DriverTables) -> DataFrame:
    return _conform(d["supplier"].select(
        F.col("s_suppkey").alias("supplier_id"), F.col("s_name").alias("supplier_name"),
        _null("supplier", "email_address"), _null("supplier", "phone_number"),
        (F.col("s_acctbal") >= 0).alias("is_valid")), "supplier")


def purchase_order_id(d: DriverTables) -> Column:
    """Id of the purchase order of an (order, supplier) pair of the line table. The stride is the
    largest supplier key + 1, read from the supplier table, so no two pairs share an id."""
    stride = d["supplier"].agg(F.max("s_suppkey") + 1).scalar()
    return F.col("l_orderkey") * stride + F.col("l_suppkey")


def _purchase_order(d: DriverTables, parts: int | None = None) -> DataFrame:
    li = d["lineitem"].select("l_orderkey", "l_suppkey", "l_shipdate", "l_linestatus", "l_returnflag")
    g = _placed(li.withColumn("_id", purchase_order_id(d)), "_id", parts).groupBy("_id", "l_orderkey", "l_suppkey").agg(
        F.min(F.to_date("l_shipdate")).alias("order_date"),
        F.max("l_linestatus").alias("_ls"), F.max("l_returnflag").alias("_rf"))
    received = F.col("_ls") == "F"
    status = F.when(received, "Received").when(F.col("_rf") == "R", "Shipped") \
        .when(F.col("l_orderkey") % 2 == 0, "pending").otherwise("Pending")
    return _conform(g.select(
        F.col("_id").alias("purchase_order_id"), (F.col("l_suppkey") % 25).alias("employee_id"),
        F.col("l_suppkey").alias("supplier_id"), "order_date",
        F.date_add("order_date", 10).alias("expected_received_date"),
        F.when(received, F.date_add("order_date", (F.col("l_orderkey") % 15).cast("int"))).alias("actual_received_date"),
        status.alias("delivery_status"), (F.col("_id") % 20 != 0).alias("is_valid")), "purchase_order")


def _purchase_order_details(d: DriverTables, parts: int | None = None) -> DataFrame:
    li = d["lineitem"].select("l_orderkey", "l_suppkey", "l_partkey", "l_extendedprice", "l_quantity")
    g = _placed(li.withColumn("_id", purchase_order_id(d)), "_id", parts) \
        .groupBy("_id", "l_orderkey", "l_suppkey", "l_partkey").agg(
            _line_money().alias("price"), _line_qty().alias("quantity"))
    return _conform(g.select(
        F.col("_id").alias("purchase_order_id"), F.col("l_partkey").alias("product_id"), "price", "quantity",
        F.lit(True).alias("is_valid")), "purchase_order_details")


def _finished_orders(d: DriverTables) -> DataFrame:
    return d["orders"].where(F.col("o_orderstatus") == "F")


def _invoice(d: DriverTables) -> DataFrame:
    return _conform(_finished_orders(d).select(
        F.col("o_orderkey").alias("invoice_id"), F.col("o_orderkey").alias("order_id"),
        F.date_add(F.to_date("o_orderdate"), 1).alias("invoice_date"), F.lit(True).alias("is_valid")), "invoice")


def _payment(d: DriverTables) -> DataFrame:
    return _conform(_finished_orders(d).select(
        F.col("o_orderkey").alias("payment_id"), F.col("o_orderkey").alias("invoice_id"),
        F.date_add(F.to_date("o_orderdate"), 1).alias("payment_date"),
        F.col("o_totalprice").cast(MONEY).alias("amount_paid"), F.col("o_orderpriority").alias("payment_method"),
        (F.col("o_orderkey") % 40 != 0).alias("is_valid")), "payment")


def _product_archive(d: DriverTables) -> DataFrame:
    return d.spark.createDataFrame([], SCHEMAS["product_archive"])


BUILDERS: dict[str, Callable[[DriverTables], DataFrame]] = {
    "customer": _customer, "employee": _employee, "hourly_employee": _hourly, "contract": _contract,
    "contract_employee": _contract_employee, "product": _product, "product_archive": _product_archive,
    "orders": _orders, "order_details": _order_details, "supplier": _supplier,
    "purchase_order": _purchase_order, "purchase_order_details": _purchase_order_details,
    "invoice": _invoice, "payment": _payment,
}


def _purchase_keys(d: DriverTables) -> DataFrame:
    return d["lineitem"].select(purchase_order_id(d).cast("long").alias("purchase_order_id"))


#: Rows of a table with their cluster key, before they are grouped: what a layout is planned from.
KEY_ROWS: dict[str, Callable[[DriverTables], DataFrame]] = {
    "order_details": lambda d: d["lineitem"].select(F.col("l_orderkey").cast("long").alias("order_id")),
    "purchase_order": _purchase_keys, "purchase_order_details": _purchase_keys,
}
#: Builders of the tables in ``KEY_ROWS`` that group rows already laid out by the cluster key.
PLACED_BUILDERS: dict[str, Callable[[DriverTables, int], DataFrame]] = {
    "order_details": _order_details, "purchase_order": _purchase_order,
    "purchase_order_details": _purchase_order_details,
}


class Part(NamedTuple):
    """Some rows of a table, and the heavy keys (None where the table has none): the part holds
    the rows of exactly those keys (``heavy``) or of all others."""

    rows: DataFrame
    keys: DataFrame | None = None
    heavy: bool = False


class Store(Mapping):
    """The 14 store tables as lazily built DataFrames, plus the driver tables (``store.driver``)
    that change feeds are derived from. ``parts_of`` gives a table in its parts by key."""

    def __init__(self, spark: SparkSession, tables: Mapping[str, Callable[[], DataFrame]],
                 driver: DriverTables | None = None, parts: Mapping[str, Callable[[], list[Part]]] | None = None,
                 keys: Mapping[str, Callable[[], DataFrame]] | None = None,
                 sources: Mapping[str, Callable[[], DataFrame]] | None = None):
        self.spark = spark
        self._sources = dict(sources or {})
        self._keys = dict(keys or {})
        self._makers = dict(tables)
        self._parts = dict(parts or {})
        self._built: dict[str, DataFrame] = {}
        self.driver = driver

    def parts_of(self, name: str) -> list[Part]:
        return self._parts[name]() if name in self._parts else [Part(self[name])]

    def keys_of(self, name: str) -> DataFrame:
        """A frame with all the cluster keys of a table, which may come again: for a largest key
        the table itself need not be grouped and written."""
        return self._keys[name]() if name in self._keys else self[name]

    def unstaged(self, name: str) -> DataFrame:
        """The table as derived from its sources, for a job that reads it once: it is not staged."""
        return self._sources[name]() if name in self._sources else self[name]

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._built:
            self._built[name] = self._makers[name]()
        return self._built[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self._makers)

    def __len__(self) -> int:
        return len(self._makers)

    def replace(self, **tables: DataFrame) -> "Store":
        """A new store sharing unchanged tables, with some tables swapped (change-job output)."""
        makers = {name: (lambda n=name: self[n]) for name in self._makers}
        for name, df in tables.items():
            makers[name] = (lambda df=df: df)
        parts = {name: make for name, make in self._parts.items() if name not in tables}
        keys = {name: make for name, make in self._keys.items() if name not in tables}
        sources = {name: make for name, make in self._sources.items() if name not in tables}
        return Store(self.spark, makers, self.driver, parts, keys, sources)


def adapted_store(spark: SparkSession, sf_dir: str) -> Store:
    """The store as lazy adapter plans over the driver's files (nothing is written)."""
    configure(spark)
    d = DriverTables(spark, sf_dir)
    return Store(spark, {name: (lambda b=b: b(d)) for name, b in BUILDERS.items()}, d)


_STAGED: dict[tuple[str, str], Store] = {}


def _fingerprint(spark: SparkSession, sf_dir: str) -> tuple[str, int]:
    """Names, sizes and modification times of the driver files (any Hadoop file system), and
    the byte size of the line table (it sizes the buckets of the staged order tables)."""
    import hashlib
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(sf_dir)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    parts, line_bytes = [], 0
    for name in DRIVER_TABLES:
        p = jvm.org.apache.hadoop.fs.Path(f"{sf_dir.rstrip('/')}/{name}.parquet")
        if fs.exists(p):
            for st in fs.listStatus(p):
                parts.append(f"{st.getPath().getName()}:{st.getLen()}:{st.getModificationTime()}")
                if name == "lineitem":
                    line_bytes += st.getLen()
    # the code that builds the snapshot is part of its identity: a changed mapping never
    # reuses a snapshot staged by older code
    import pathlib
    here = pathlib.Path(__file__).resolve().parent
    code = "".join((here / f).read_text() for f in ("adapter.py", "schemas.py", "store.py"))
    parts.append(hashlib.sha1(code.encode()).hexdigest())
    return hashlib.sha1("|".join([sf_dir] + parts).encode()).hexdigest()[:16], line_bytes


def store_from_driver(spark: SparkSession, sf_dir: str, staged: bool = True) -> Store:
    """The store for a driver data set. With ``staged`` (default) a table is derived from the raw
    files once per application and source fingerprint, when it is first read: it is written as
    Parquet under the session's ``spark.checkpoint.dir`` (shared storage; order tables clustered
    by order id), and every query reads that instead of deriving it again."""
    live = adapted_store(spark, sf_dir)
    if not staged:
        return live
    from mercato.session import fit_partitions, shared_dir
    from mercato.sources.store import bucket_count, staged_store
    fp, line_bytes = _fingerprint(spark, sf_dir)
    fit_partitions(spark, line_bytes)
    app = spark.sparkContext.applicationId
    if (app, fp) not in _STAGED:
        root = f"{shared_dir(spark)}/mercato-store/{app}-{fp}"
        _STAGED[app, fp] = staged_store(live, root, bucket_count(spark, line_bytes))
    st = _STAGED[app, fp]
    return Store(spark, {t: (lambda t=t: st[t]) for t in st}, live.driver,
                 {t: (lambda t=t: st.parts_of(t)) for t in st},
                 {t: (lambda rows=rows: rows(live.driver)) for t, rows in KEY_ROWS.items()},
                 {t: (lambda t=t: live[t]) for t in live})
