"""Customer profiles from maintained counters (R1-R10): a change costs what it touches.

The counters are rows ``(customer_id, kind, key, n, qty, value)`` that only ever add up:

* ``product``: key is the product; lines, quantity and value bought of it;
* ``date``: key is the order date in days; orders of that date (so the latest date survives the
  retraction of an order);
* ``filled``: orders that have lines.

Order count, spend, items, distinct products, favourites and the latest date all follow from them.
A change is a signed sum: the counters of the touched orders after it, less those before it. Rows
whose count falls to nothing go, which retracts distinct products and favourites. Names and
categories are joined when a profile is read, so patches of products need no delta.

The rows lie in folders by a hash of the customer. An update reads and rewrites the folders of the
touched customers alone, a profile of some customers reads theirs. A customer has at most one row
per product and date, however many lines they have.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mercato.functions.expr import line_value
from mercato.operators.joins import lookup
from mercato.operators.ranking import by_heat
from mercato.plans.common import Store, active_orders, by_order
from mercato.plans.customer import finished_profile, product_stats
from mercato.session import kept, shuffles_freed
from mercato.sources.order_statistics import OrderStatistics
from mercato.sources.partitioned import PART, delete_folder, part_of
from mercato.sources.schemas import LINE_MONEY

SCHEMA = "customer_id BIGINT, kind STRING, key BIGINT, n BIGINT, qty BIGINT, value DECIMAL(38,2)"
KEY = ["customer_id", "kind", "key"]
# Tasks that may share the writing of one folder.
WRITERS_PER_PART = 4
TASK = "_task"


def _summed(rows: DataFrame, *placed: str) -> DataFrame:
    return rows.groupBy(*placed, *KEY).agg(F.sum("n").alias("n"), F.sum("qty").alias("qty"),
                                  F.sum("value").cast("decimal(38,2)").alias("value"))


def counter_rows(store: Store, line_scope: str = "all", order_ids: DataFrame | None = None) -> DataFrame:
    """The counters of the active orders, or of those among ``order_ids`` (distinct), before they
    are summed up. Orders without a customer count for nobody."""
    orders = active_orders(store, "order_id", "customer_id", "order_date").where(F.col("customer_id").isNotNull())
    if order_ids is not None:
        orders = lookup(orders, order_ids, "order_id")

    def of_lines(li: DataFrame, o: DataFrame, small) -> DataFrame:
        li = li.select("order_id", "product_id", "quantity", line_value().alias("_value"))
        who = o.select("order_id", "customer_id")
        bought = li.join(small(who), "order_id").withColumn("n", F.lit(1))
        filled = who.join(small(li.select("order_id").distinct()), "order_id", "left_semi")
        return _rows(bought, "product", "product_id", "n", "quantity", "_value").unionByName(
            _rows(filled.groupBy("customer_id").count(), "filled", None, "count"))
    lines = by_order(store, line_scope, orders, of_lines)
    dates = orders.withColumn("n", F.lit(1))
    return lines.unionByName(_rows(dates, "date", F.unix_date("order_date"), "n"))


def _rows(df: DataFrame, kind: str, key, n: str, qty: str | None = None, value: str | None = None) -> DataFrame:
    zero = F.lit(0)
    key = F.lit(None) if key is None else key if not isinstance(key, str) else F.col(key)
    return df.select(
        F.col("customer_id").cast("long"), F.lit(kind).alias("kind"), key.cast("long").alias("key"), F.col(n).cast("long").alias("n"),
        F.coalesce(F.col(qty) if qty else zero, zero).cast("long").alias("qty"),
        F.coalesce(F.col(value) if value else zero, zero).cast(LINE_MONEY).alias("value"))


class CustomerCounters:
    """The counters under ``root`` in ``parts`` folders by customer."""

    def __init__(self, spark: SparkSession, root: str, parts: int, line_scope: str = "all"):
        self.spark, self.root, self.parts, self.line_scope = spark, root.rstrip("/"), parts, line_scope

    @classmethod
    def create(cls, store: Store, root: str, parts: int, line_scope: str = "all") -> CustomerCounters:
        out = cls(store.spark, root, parts, line_scope)
        rows, hot = by_heat(counter_rows(store, line_scope), "customer_id")
        if hot is not None:  # summed up by all tasks before few write them
            rows = rows.unionByName(_summed(hot))
        out._write(rows)
        return out

    def _placed(self, df: DataFrame) -> DataFrame:
        return df.withColumn(PART, part_of("customer_id", self.parts))

    def _laid_out(self, rows: DataFrame) -> DataFrame:
        """The sums of ``rows`` where they are written. Rows are shuffled once: the tasks that write
        them sum them up, each for one folder."""
        writer = F.pmod(F.xxhash64("key"), F.lit(WRITERS_PER_PART)).cast("int")
        placed = self._placed(rows).withColumn(TASK, F.col(PART) * WRITERS_PER_PART + writer) \
            .repartitionById(self.parts * WRITERS_PER_PART, F.col(TASK))
        return _summed(placed, PART, TASK).where(F.col("n") != 0).drop(TASK)

    def _write(self, rows: DataFrame) -> None:
        """The sums of ``rows`` in the place of the folders they lie in. Spark replaces folders when
        all tasks are done, so ``rows`` may be read from them."""
        with shuffles_freed(self.spark):
            (self._laid_out(rows).write.mode("overwrite")
             .option("partitionOverwriteMode", "dynamic").partitionBy(PART).parquet(self.root))

    def rows(self, parts: list[int] | None = None) -> DataFrame:
        df = self.spark.read.schema(f"{SCHEMA}, {PART} INT").parquet(self.root)
        return (df if parts is None else df.where(F.col(PART).isin(parts))).drop(PART)

    def touched(self, customers: DataFrame) -> list[int]:
        """The folders of some customers: at most ``parts`` numbers."""
        ids = customers.where(F.col("customer_id").isNotNull())
        return sorted(r[0] for r in self._placed(ids).select(PART).distinct().collect())

    def deltas(self, before: Store, after: Store, order_ids: DataFrame) -> DataFrame:
        """Signed counters of the touched orders: after the change, less before it."""
        ids = kept(order_ids.select("order_id").distinct())
        new, old = (counter_rows(s, self.line_scope, ids) for s in (after, before))
        minus = old.select(*KEY, *[(-F.col(c)).alias(c) for c in ("n", "qty", "value")])
        changed = (F.col("n") != 0) | (F.col("qty") != 0) | (F.col("value") != 0)
        return _summed(new.unionByName(minus)).where(changed)

    def totals(self, rows: DataFrame | None = None) -> DataFrame:
        """Spend per customer that has counters."""
        return (self.rows() if rows is None else rows).groupBy("customer_id").agg(
            F.sum("value").cast("decimal(38,2)").alias("value"))

    def apply(self, before: Store, after: Store, order_ids: DataFrame,
              spend: OrderStatistics | None = None) -> list[int]:
        """Bring the counters from the state of ``before`` to that of ``after``, which differ in
        rows of ``order_ids`` only (orders that neither has count for nothing; so do repeats).
        ``spend`` (of ``totals``) follows. Returns the folders rewritten. Apply each change once."""
        deltas = kept(self.deltas(before, after, order_ids))
        parts = self.touched(deltas)
        if not parts:
            return []
        # computed before the files it is read from are replaced
        moves = None if spend is None else kept(self._moves(parts, deltas))
        files = self._files(parts)
        self._write(self.rows(parts).unionByName(deltas))
        for folder in {os.path.dirname(f) for f in files & self._files(parts)}:
            delete_folder(self.spark, folder)  # its last row went: no file replaced the old one
        if spend is not None:
            spend.apply(moves)
        return parts

    def _files(self, parts: list[int]) -> set[str]:
        """The files in ``parts``: at most one per task that writes a folder."""
        names = {f"{PART}={p}" for p in parts}
        return {f for f in self.rows().inputFiles() if os.path.basename(os.path.dirname(f)) in names}

    def _moves(self, parts: list[int], deltas: DataFrame) -> DataFrame:
        """Signed counts of the totals that the customers of ``deltas`` leave and reach. A customer
        has a total while they have orders, and each counts for its date."""
        def sums(df: DataFrame, changed: bool) -> DataFrame:
            orders = F.when(F.col("kind") == "date", F.col("n")).otherwise(F.lit(0))
            return df.select("customer_id", "value", orders.alias("orders"), F.lit(changed).alias("changed"))
        was = ~F.col("changed")
        per = sums(self.rows(parts), False).unionByName(sums(deltas, True)).groupBy("customer_id").agg(
            F.sum(F.when(was, F.col("value"))).alias("old"), F.sum("value").alias("new"),
            F.sum(F.when(was, F.col("orders"))).alias("had"), F.sum("orders").alias("has"),
            F.bool_or("changed").alias("changed")).where("changed")

        def move(value: str, n: int, orders: str):
            return F.struct(F.col(value).cast("decimal(38,2)").alias("value"), F.lit(n).alias("n"),
                            (F.col(orders) > 0).alias("counts"))
        return per.select(F.inline(F.array(move("old", -1, "had"), move("new", 1, "has")))) \
            .where("counts").select("value", "n")

    def profile(self, store: Store, customer_ids: DataFrame | None = None,
                spend: OrderStatistics | None = None) -> DataFrame:
        """R10 per customer or per requested id, from the counters; the spend rank (R9) is there
        with ``spend``, and reads the ranges that the customers' totals lie in."""
        base = store["customer"].drop("order_count")
        rows = self.rows()
        if customer_ids is not None:
            ids = customer_ids.select("customer_id").distinct()
            base, rows = lookup(base, ids, "customer_id"), lookup(self.rows(self.touched(ids)), ids, "customer_id")

        def of(kind: str, c: str):
            return F.when(F.col("kind") == kind, F.col(c))
        stats = rows.groupBy("customer_id").agg(
            F.sum(of("date", "n")).alias("order_count"),
            F.date_from_unix_date(F.max(of("date", "key")).cast("int")).alias("last_order_date"),
            F.sum("value").cast("decimal(38,2)").alias("total_spent"), F.sum("qty").alias("items_ordered"),
            F.sum(of("filled", "n")).alias("_orders_with_lines"))
        pairs = rows.where("kind = 'product'").select(
            "customer_id", F.col("key").alias("product_id"), F.col("n").alias("n_lines"), "qty")
        pairs, hot = by_heat(pairs, "customer_id")
        products = product_stats(store, pairs, by_customer=True)
        if hot is not None:
            products = products.unionByName(product_stats(store, hot))
        if spend is not None:
            stats = kept(stats)  # read for the ranges, the ranks and the profile
        out = base.join(stats, "customer_id", "left").join(products, "customer_id", "left")
        if spend is None:
            return finished_profile(out)
        out = out.withColumn("value", F.coalesce("total_spent", F.lit(0).cast("decimal(38,2)")))
        return finished_profile(spend.ranked(out, "spend_rank"))
