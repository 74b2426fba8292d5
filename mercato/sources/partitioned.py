"""Change jobs that rewrite only what they touch.

A table lies in folders by a hash of its key (``<root>/<table>/_part=<n>``), written with Spark's
``partitionBy``. A job finds the parts that its feed can touch from the feed's keys, runs on those
parts alone (the scan is pruned to their folders), and replaces them with dynamic partition
overwrite; rows under new ids are appended. So a patch of one row reads and writes one part, and
the result equals the job on whole tables, because a part holds every row of its keys.

Results are computed into files of their own first (``kept``): nothing is read from files that are being
replaced, and a repeated task of the write only copies. Each table is committed by Spark's own
committer, one after the other; there is no commit across tables.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mercato.functions.expr import text_equals
from mercato.operators import changes as W
from mercato.session import kept
from mercato.sources.adapter import Store
from mercato.sources.schemas import PRIMARY_KEYS, SCHEMAS, TABLES

PART = "_part"
#: The key that a table is laid out by: its first key column (lines lie with their order).
LAYOUT_KEYS = {t: keys[0] for t, keys in PRIMARY_KEYS.items()}


def part_of(key: str, parts: int) -> Column:
    """The part of a key. ``repartition(parts, key)`` deals rows out by the same hash, so that each
    task of a write has the rows of one part."""
    return F.pmod(F.hash(F.col(key).cast("long")), F.lit(parts)).cast("int")


def delete_folder(spark: SparkSession, path: str) -> None:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


class PartitionedStore(Store):
    """The store tables under ``root``, each in ``parts`` folders."""

    def __init__(self, spark: SparkSession, root: str, parts: int, tables=TABLES, driver=None):
        self.root, self.parts = root.rstrip("/"), parts
        super().__init__(spark, {t: (lambda t=t: self._open(t).drop(PART)) for t in tables}, driver)

    @classmethod
    def create(cls, spark: SparkSession, root: str, tables: Mapping[str, DataFrame], parts: int,
               driver=None) -> PartitionedStore:
        """Lay out ``tables`` (any store tables) under ``root``."""
        out = cls(spark, root, parts, tuple(tables), driver)
        for t in tables:
            out._write(t, tables[t], "overwrite")
        return out

    def _open(self, table: str) -> DataFrame:
        schema = T.StructType([*SCHEMAS[table].fields, T.StructField(PART, T.IntegerType())])
        return self.spark.read.schema(schema).parquet(f"{self.root}/{table}")

    def _placed(self, table: str, df: DataFrame) -> DataFrame:
        return df.select(*SCHEMAS[table].fieldNames()).withColumn(PART, part_of(LAYOUT_KEYS[table], self.parts))

    def _write(self, table: str, df: DataFrame, mode: str) -> None:
        rows = self._placed(table, df).repartition(self.parts, F.col(LAYOUT_KEYS[table]).cast("long"))
        (rows.write.mode(mode)
         .option("partitionOverwriteMode", "dynamic").partitionBy(PART).parquet(f"{self.root}/{table}"))

    def touched(self, table: str, keys: DataFrame) -> list[int]:
        """The parts of ``table`` that hold the keys of ``keys``: at most ``parts`` numbers."""
        key = LAYOUT_KEYS[table]
        rows = keys.where(F.col(key).isNotNull()).select(part_of(key, self.parts).alias(PART)).distinct().collect()
        return sorted(r[0] for r in rows)

    def part(self, table: str, parts: list[int]) -> DataFrame:
        return self._open(table).where(F.col(PART).isin(parts)).drop(PART)

    def replace_parts(self, table: str, parts: list[int], df: DataFrame) -> None:
        """Put ``df`` (the new rows of ``parts``, cut from its lineage) in the place of ``parts``."""
        if not parts:
            return
        self._write(table, df, "overwrite")
        left = {r[0] for r in self._placed(table, df).select(PART).distinct().collect()}
        for p in parts:  # a part that lost its last row has no file to replace the old one
            if p not in left:
                delete_folder(self.spark, f"{self.root}/{table}/{PART}={p}")

    def apply(self, job: Callable[[Mapping[str, DataFrame]], Mapping[str, DataFrame]],
              touched: Mapping[str, DataFrame], appended: Mapping[str, str] | None = None
              ) -> tuple[DataFrame, dict[str, list[int]]]:
        """Run ``job`` on the parts that hold the keys of ``touched`` (table -> frame with the
        table's layout key) and on the other tables as they are; write its output. ``appended``:
        tables that only get new rows -> the job's output that holds them. Returns the job's
        rejects and the parts rewritten per table."""
        parts = {t: self.touched(t, keys) for t, keys in touched.items()}
        view = Store(self.spark, {t: (lambda t=t: self.part(t, parts[t]) if t in parts else self[t])
                                  for t in self}, self.driver)
        out = job(view)
        rejects = kept(out["rejects"]) if "rejects" in out else None
        # new rows first: what they are made of, such as new ids, serves the other outputs too
        new = {t: kept(out[name].select(*SCHEMAS[t].fieldNames())) for t, name in (appended or {}).items()}
        fresh = {t: kept(out[t].select(*SCHEMAS[t].fieldNames())) for t in parts if t in out and parts[t]}
        for t, df in fresh.items():
            self.replace_parts(t, parts[t], df)
        for t, df in new.items():
            self._write(t, df, "append")
        self._built.clear()  # file listings of before
        return rejects, {t: parts[t] for t in fresh}


# ---- the change jobs, with the keys that they can touch -----------------------------------------
Applied = tuple[DataFrame, dict[str, list[int]]]


def apply_patches(st: PartitionedStore, table: str, patches: DataFrame) -> Applied:
    return st.apply(lambda s: W.patch_rows(s, table, patches), {table: patches})


def apply_flags(st: PartitionedStore, table: str, flags: DataFrame) -> Applied:
    """W3, and W4 for employees and purchase orders, whose rows lie in parts of the same key."""
    if table == "employee":
        return st.apply(lambda s: W.deactivate_employees(s, flags),
                        {t: flags for t in ("employee", "hourly_employee", "contract_employee")})
    if table == "purchase_order":
        return st.apply(lambda s: W.set_purchase_order_active(s, flags),
                        {t: flags for t in ("purchase_order", "purchase_order_details")})
    return st.apply(lambda s: W.set_active(s, table, flags), {table: flags})


def apply_archive(st: PartitionedStore, ids: DataFrame, as_of) -> Applied:
    """The lines of the products are found by a scan of two columns."""
    asked = ids.select("product_id").distinct()
    lines = {t: st[t].join(asked, "product_id", "left_semi").select(LAYOUT_KEYS[t])
             for t in ("order_details", "purchase_order_details")}
    return st.apply(lambda s: W.archive_delete_products(s, ids, as_of), {"product": ids, **lines},
                    {"product_archive": "archived"})


def apply_checkouts(st: PartitionedStore, requests: DataFrame, as_of=None) -> Applied:
    """The asking customers and their open carts."""
    carts = st["orders"].where(text_equals("status", "cart")) \
        .join(requests.select("customer_id").distinct(), "customer_id", "left_semi").select("order_id")
    return st.apply(lambda s: W.checkout_carts(s, requests, as_of),
                    {"customer": requests, "orders": carts, "order_details": carts},
                    {"invoice": "new_invoices", "payment": "new_payments"})


def apply_order_status(st: PartitionedStore, feed: DataFrame) -> Applied:
    return st.apply(lambda s: W.set_order_status(s, feed), {"orders": feed})


def apply_purchases(st: PartitionedStore, requests: DataFrame, items: DataFrame, as_of=None) -> Applied:
    return st.apply(lambda s: W.create_purchase_orders(s, requests, items, as_of), {"product": items},
                    {"purchase_order": "new_purchase_orders", "purchase_order_details": "new_lines"})


def apply_purchase_status(st: PartitionedStore, feed: DataFrame, stock_on: str = "create") -> Applied:
    """The orders, and the products of their lines (read from the orders' parts)."""
    parts = st.touched("purchase_order_details", feed)
    products = st.part("purchase_order_details", parts) \
        .join(feed.select("purchase_order_id").distinct(), "purchase_order_id", "left_semi").select("product_id")

    def job(s):
        lines = st.part("purchase_order_details", parts)
        return W.set_purchase_status({**{t: s[t] for t in ("purchase_order", "product")},
                                      "purchase_order_details": lines}, feed, stock_on)
    return st.apply(job, {"purchase_order": feed, "product": products})


def apply_type_changes(st: PartitionedStore, feed: DataFrame) -> Applied:
    return st.apply(lambda s: W.change_employee_type(s, feed), {"hourly_employee": feed, "contract_employee": feed},
                    {"contract": "new_contracts"})


def apply_inserts(st: PartitionedStore, table: str, feed: DataFrame) -> Applied:
    return st.apply(lambda s: W.insert_rows(s, table, feed), {}, {table: "inserted"})
