"""Customer profile (R1-R10), for every customer at once.

The profile counts every line of an active order, including lines flagged off by checkout or
by removal from the cart (``line_scope='all'``, S2). Empty sums become 0 and missing labels
'N/A' (S4, E9); ties are resolved by name so that results are repeatable (S5).
"""

from __future__ import annotations


from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mercato.functions.expr import NA, average, label_if_null, zero_if_null
from mercato.operators.joins import lookup
from mercato.operators.ranking import dense_rank_desc, top1_per_group
from mercato.plans.common import Store, active_orders, customer_product_lines, order_totals
from mercato.session import ensure_checkpoint_dir, partition_count
from mercato.sources.schemas import SUM_MONEY


def _customers(store: Store, customer_ids: DataFrame | None = None) -> DataFrame:
    c = store["customer"]
    return lookup(c, customer_ids, "customer_id") if customer_ids is not None else c


def _order_stats(store: Store, line_scope: str) -> DataFrame:
    """R1 to R4 and R8 in one grouping: active orders with the totals of their lines."""
    per_order = order_totals(store, line_scope, active_orders(store, "order_id", "customer_id", "order_date"), "left")
    return per_order.groupBy("customer_id").agg(
        F.count(F.lit(1)).alias("order_count"), F.max("order_date").alias("last_order_date"),
        F.sum("order_value").cast(SUM_MONEY).alias("total_spent"),
        F.sum("order_qty").cast("long").alias("items_ordered"),
        F.count("order_lines").alias("_orders_with_lines"))


def product_stats(store: Store, pairs: DataFrame, by_customer: bool = False) -> DataFrame:
    """R5 to R7 in one grouping of (customer, product) pairs with n_lines and qty: a pair counts once under its
    category and once under its product name; a pair of an unknown product only counts as one of
    the different products. With ``by_customer`` a pair goes to its customer's task before it is
    counted twice, so its labels are shuffled once: for customers that are not hot."""
    p = store["product"].select("product_id", "category", "product_name", F.lit(True).alias("_known"))
    pairs = pairs.join(p, "product_id", "left")
    if by_customer:
        pairs = pairs.select("customer_id", "n_lines", "qty", "category", "product_name", "_known") \
            .repartition(partition_count(pairs.sparkSession), "customer_id")

    def entry(kind: int, label, amount):
        return F.struct(F.lit(kind).alias("kind"), F.lower(label).alias("key"), label.alias("label"),
                        F.col(amount).cast("long").alias("amount"))
    category, name = entry(0, F.col("category"), "n_lines"), entry(1, F.col("product_name"), "qty")
    unknown = entry(2, F.lit(None).cast("string"), "n_lines")
    entries = F.when(F.col("_known"), F.array(category, name)).otherwise(F.array(unknown))
    # text keys group whatever their case (S1) and show their least spelling
    groups = pairs.select("customer_id", F.explode(entries).alias("e")).groupBy("customer_id", "e.kind", "e.key").agg(
        F.min("e.label").alias("label"), F.sum("e.amount").alias("amount"), F.count(F.lit(1)).alias("n"))

    def best(kind: int):
        return F.min(F.when(F.col("kind") == kind, F.struct((-F.col("amount")).alias("k"), "label")))["label"]
    return groups.groupBy("customer_id").agg(
        best(0).alias("favourite_category"), best(1).alias("top_product"),
        F.sum(F.when(F.col("kind") != 1, F.col("n"))).alias("distinct_products"))


def _spend_stats(store: Store, line_scope: str) -> DataFrame:
    """R2, R4, R8 from per-order totals: lines are reduced to orders before the join."""
    per_order = order_totals(store, line_scope, active_orders(store, "order_id", "customer_id"))
    return per_order.groupBy("customer_id").agg(
        F.sum("order_value").cast(SUM_MONEY).alias("total_spent"),
        F.sum("order_qty").cast("long").alias("items_ordered"),
        F.count(F.lit(1)).alias("_orders_with_lines"))


def _with_all_customers(store: Store, part: DataFrame, defaults: dict, customer_ids=None) -> DataFrame:
    base = _customers(store, customer_ids).select("customer_id")
    out = base.join(part, "customer_id", "left")
    return out.select("customer_id", *[
        (zero_if_null(name, value) if not isinstance(value, str) else label_if_null(name, value)).alias(name)
        if value is not None else F.col(name) for name, value in defaults.items()])


def order_count(store: Store, customer_ids=None) -> DataFrame:
    """Active orders per customer, 0 when none."""
    part = active_orders(store).groupBy("customer_id").agg(F.count(F.lit(1)).alias("order_count"))
    return _with_all_customers(store, part, {"order_count": 0}, customer_ids)


def total_spent(store: Store, line_scope: str = "all", customer_ids=None) -> DataFrame:
    """R2: value of all lines of active orders, 0 when none."""
    part = _spend_stats(store, line_scope).select("customer_id", "total_spent")
    return _with_all_customers(store, part, {"total_spent": F.lit(0).cast(SUM_MONEY)}, customer_ids)


def last_order_date(store: Store, customer_ids=None) -> DataFrame:
    """Latest active order date, NULL when none."""
    part = active_orders(store).groupBy("customer_id").agg(F.max("order_date").alias("last_order_date"))
    return _with_all_customers(store, part, {"last_order_date": None}, customer_ids)


def items_ordered(store: Store, line_scope: str = "all", customer_ids=None) -> DataFrame:
    """Quantity over all lines of active orders, 0 when none."""
    part = _spend_stats(store, line_scope).select("customer_id", "items_ordered")
    return _with_all_customers(store, part, {"items_ordered": 0}, customer_ids)


def _favourite_category(store: Store, cp: DataFrame) -> DataFrame:
    product = store["product"].select("product_id", "category")
    # text keys group whatever their case (S1) and show their least spelling
    per_cat = cp.join(product, "product_id").groupBy("customer_id", F.lower("category").alias("_key")).agg(
        F.min("category").alias("category"), F.sum("n_lines").alias("freq"))
    return top1_per_group(per_cat, ["customer_id"], "freq", "category", "favourite_category") \
        .select("customer_id", "favourite_category")


def favourite_category(store: Store, line_scope: str = "all", customer_ids=None) -> DataFrame:
    """Category with most lines; ties to the smallest category; 'N/A' when none."""
    part = _favourite_category(store, customer_product_lines(store, line_scope))
    return _with_all_customers(store, part, {"favourite_category": NA}, customer_ids)


def distinct_products(store: Store, line_scope: str = "all", customer_ids=None) -> DataFrame:
    """Number of different products bought, 0 when none."""
    part = customer_product_lines(store, line_scope).groupBy("customer_id").agg(
        F.count(F.lit(1)).alias("distinct_products"))
    return _with_all_customers(store, part, {"distinct_products": 0}, customer_ids)


def _top_product(store: Store, cp: DataFrame) -> DataFrame:
    product = store["product"].select("product_id", "product_name")
    per_name = cp.join(product, "product_id").groupBy("customer_id", F.lower("product_name").alias("_key")).agg(
        F.min("product_name").alias("product_name"), F.sum("qty").alias("total"))
    return top1_per_group(per_name, ["customer_id"], "total", "product_name", "top_product") \
        .select("customer_id", "top_product")


def top_product(store: Store, line_scope: str = "all", customer_ids=None) -> DataFrame:
    """Product name with the largest quantity (names group namesakes, S6); 'N/A' when none."""
    part = _top_product(store, customer_product_lines(store, line_scope))
    return _with_all_customers(store, part, {"top_product": NA}, customer_ids)


def _avg_order_value(spend: DataFrame) -> DataFrame:
    return spend.select("customer_id", average("total_spent", "_orders_with_lines").alias("avg_order_value"))


def avg_order_value(store: Store, line_scope: str = "all", customer_ids=None) -> DataFrame:
    """Average of per-order totals over active orders with lines, 0.0 when none."""
    part = _avg_order_value(_spend_stats(store, line_scope))
    return _with_all_customers(store, part, {"avg_order_value": 0.0}, customer_ids)


def spend_rank(store: Store, line_scope: str = "all", customer_ids=None) -> DataFrame:
    """1 + number of distinct customer totals above this customer's total (a dense rank;
    customers without orders have total 0 and rank after every positive total)."""
    # totals are read for the cut points, the ranks and the join back: computed once
    ensure_checkpoint_dir(store.spark)
    totals = total_spent(store, line_scope).checkpoint(eager=True)
    ranked = dense_rank_desc(totals, "total_spent", "spend_rank", materialize=False, hot=0) \
        .select("customer_id", "spend_rank")
    if customer_ids is not None:
        ranked = lookup(ranked, customer_ids, "customer_id")
    return ranked


PROFILE_COLUMNS = ["customer_id", "customer_name", "phone_number", "email_address", "city",
                   "shipping_address", "is_valid", "order_count", "total_spent", "last_order_date",
                   "items_ordered", "favourite_category", "distinct_products", "top_product",
                   "avg_order_value", "spend_rank"]


def customer_profile(store: Store, customer_ids: DataFrame | None = None, line_scope: str = "all") -> DataFrame:
    """The full profile, one row per customer (or per requested id). Lines are read twice:
    reduced per order, and per (customer, product) pair."""
    # the totals of every customer, not only of the requested ones, are read for the rank's cut
    # points, the ranks and the profile: computed once and cut from their lineage with a reliable
    # checkpoint in the shared checkpoint folder
    ensure_checkpoint_dir(store.spark)
    stats = (store["customer"].select("customer_id").join(_order_stats(store, line_scope), "customer_id", "left")
             .withColumn("total_spent", F.coalesce("total_spent", F.lit(0).cast(SUM_MONEY)))
             .checkpoint(eager=True))
    ranked = dense_rank_desc(stats, "total_spent", "spend_rank", materialize=False, hot=0)
    base = _customers(store, customer_ids).drop("order_count")
    products = product_stats(store, customer_product_lines(store, line_scope))
    out = base.join(ranked, "customer_id").join(products, "customer_id", "left")
    return finished_profile(out).select(*PROFILE_COLUMNS)


def finished_profile(df: DataFrame) -> DataFrame:
    """Customers with the figures joined to them: zeros and labels where there are none. A
    ``spend_rank`` passes through."""
    out = df.withColumns({
        "order_count": zero_if_null("order_count"),
        "total_spent": F.coalesce("total_spent", F.lit(0).cast(SUM_MONEY)),
        "items_ordered": zero_if_null("items_ordered"),
        "favourite_category": label_if_null("favourite_category", NA),
        "distinct_products": zero_if_null("distinct_products"),
        "top_product": label_if_null("top_product", NA),
        "avg_order_value": F.when(F.col("_orders_with_lines") > 0, average("total_spent", "_orders_with_lines"))
                            .otherwise(F.lit(0.0))})
    return out.select(*[c for c in PROFILE_COLUMNS if c in out.columns])
