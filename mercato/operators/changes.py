"""Change jobs (W1-W12): feeds of changes applied to a store snapshot.

Every job takes the store and a feed DataFrame and returns only the changed tables plus a
``rejects`` frame ``(change_id, reason)``. Nothing is updated in place (plain Parquet has no
MERGE/UPDATE): new table versions are joins and unions of the old ones;
``mercato.sources.partitioned`` runs the jobs on the parts of the tables that a feed touches and
writes those parts alone.

Requests of a feed take effect in the order of ``change_id``, and each is judged on the state
that the requests before it left. Where only the last value of a field counts this is one
aggregate per field (``max_by`` over ``change_id``, partially computed before the shuffle);
where a request depends on the one before, the previous value comes from
``ranking.previous_value``, which never gathers a hot key's requests in one window. New ids are the
table's largest id plus the position of the change id among accepted rows (repeatable; no
``monotonically_increasing_id``).

No request vanishes: every one is applied or has a reject row. A request without a change id, or
with one that another request of the feed has, has no place in the order and is rejected; so is
one without the key that it is about. A request whose result would not fit its column is rejected
too, instead of ending the job.
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mercato.functions.expr import active, as_of_date, blank_to_null, text_equals
from mercato.operators.key_set import BROADCAST_BUCKETS, dense, key_set, with_membership
from mercato.operators.lazy import LazyFrames, once
from mercato.operators.quality import contact_rules, table_rules, validate, with_duplicate_flag, \
    with_parent_flag
from mercato.operators.ranking import numbered_within, positions, previous_and_any, previous_value, running_total
from mercato.operators.timeline import as_of as value_as_of
from mercato.session import kept
from mercato.sources.schemas import DELIVERY_STATUSES, LINE_MONEY, SCHEMAS

Store = Mapping[str, DataFrame]

KEYS = {"customer": "customer_id", "employee": "employee_id", "supplier": "supplier_id", "product": "product_id",
        "orders": "order_id", "purchase_order": "purchase_order_id", "invoice": "invoice_id",
        "payment": "payment_id", "contract": "contract_id"}
# fixed: fields a create request must supply, as the reference's forms require them
REQUIRED = {
    "customer": ["customer_name"],
    "employee": ["employee_name", "emp_role", "email_address", "hire_date"],
    "supplier": ["supplier_name"],
    "product": ["product_name", "category", "price", "stock_quantity"],
}
# fixed: column defaults of the reference schema
DEFAULTS = {"customer": {"order_count": 0, "is_valid": True}, "employee": {"is_valid": True},
            "supplier": {"is_valid": True}, "product": {"is_valid": True},
            "orders": {"status": "cart", "is_valid": True}, "purchase_order": {"delivery_status": "Pending"}}
# soft-delete guards: deactivation needs an active row, except for customers (existence only)
DEACTIVATE_NEEDS_ACTIVE = {"employee": True, "supplier": True, "product": True, "customer": False}

REJECTS_SCHEMA = "change_id long, reason string"


def _conform(df: DataFrame, table: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Columns of ``table`` in order and type. Values are converted with ``try_cast``: a value
    that does not parse becomes NULL and is then rejected by the required / NOT NULL rules,
    instead of failing the whole job under ANSI mode (S10)."""
    cols = []
    for f in SCHEMAS[table].fields:
        c = F.col(f.name) if f.name in df.columns else F.lit(None)
        cols.append(c.try_cast(f.dataType).alias(f.name))
    return df.select(*keep, *cols)


def _missing(c: str, dtype) -> Column:
    """A required field is missing when NULL or, for text, blank. 0 is a legal value."""
    return _blank(c) if dtype.simpleString() == "string" else F.col(c).isNull()


def next_ids(df: DataFrame, existing: DataFrame, key: str, order_col: str = "change_id") -> DataFrame:
    """Give each row of ``df`` a new ``key``: the largest existing id + its position by
    ``order_col`` (one scalar subquery and a distributed rank)."""
    top = existing.agg(F.coalesce(F.max(key), F.lit(0))).scalar()  # one column of ``existing``
    ranked = positions(df, order_col, "_pos")
    return ranked.withColumn(key, (top + F.col("_pos")).cast("long")).drop("_pos")


def _reject_rows(quarantine: DataFrame) -> DataFrame:
    return quarantine.select("change_id", F.explode("reasons").alias("reason"))


def identified(feed: DataFrame) -> tuple[DataFrame, list]:
    """The feed with a duplicate flag, and the rules that a request which makes new ids must
    pass: a change id, and one that no other request has."""
    return with_duplicate_flag(feed, ["change_id"], "_copy"), [
        ("W0:missing_change_id", F.col("change_id").isNull()),
        ("W0:duplicate_change_id", F.col("_copy"))]


def ordered_requests(feed: DataFrame, key: str, job: str) -> tuple[DataFrame, DataFrame]:
    """(requests that have a place in the order and a key, one reject row for each other one)."""
    why = F.when(F.col("change_id").isNull(), "W0:missing_change_id") \
        .when(F.col("_copy"), "W0:duplicate_change_id") \
        .when(F.col(key).isNull(), f"{job}:missing_key")
    judged = with_duplicate_flag(feed, ["change_id"], "_copy").withColumn("_why", why)
    return (judged.where(F.col("_why").isNull()).drop("_why", "_copy").select(*feed.columns),
            judged.where(F.col("_why").isNotNull()).select("change_id", F.col("_why").alias("reason")))


def _blank(c: str) -> Column:
    return blank_to_null(c).isNull()


INT_MAX = 2 ** 31 - 1


def _keys_of(store: Store, table: str) -> DataFrame:
    """A frame with the table's keys, which may come again: the table is not built for them."""
    return store.keys_of(table) if hasattr(store, "keys_of") else store[table]


def _beyond_stock(product: DataFrame, items: DataFrame, good: DataFrame) -> DataFrame | None:
    """change_id of the requests of ``good`` that raise a product's stock beyond its column: those
    up to which all requests of ``items`` (change_id, product_id, quantity), in their order, ask
    for more than fits on top of the stock. Only products whose total may not fit are looked at;
    None where there are none, so that ``good`` need not be computed for them."""
    room = product.select("product_id", (F.lit(INT_MAX) - F.col("stock_quantity").cast("long")).alias("_room"))
    full = items.groupBy("product_id").agg(F.sum(F.col("quantity").cast("long")).alias("_all")) \
        .join(room, "product_id").where(F.col("_all") > F.col("_room")).select("product_id", "_room")
    full = kept(full)
    if full.isEmpty():
        return None
    asked = items.join(full, "product_id").join(good.select("change_id"), "change_id", "left_semi")
    upto = running_total(asked, "product_id", "quantity", "change_id", "_upto")
    return upto.where(F.col("_upto") > F.col("_room")).select("change_id").distinct()


# ---- W1 ---------------------------------------------------------------------------------------
def insert_rows(store: Store, table: str, feed: DataFrame) -> dict[str, DataFrame]:
    """Validate create requests (required fields, declared checks, contact patterns for
    employees), fill defaults, allocate ids and append."""
    key = KEYS[table]
    rows, id_rules = identified(feed)
    for c, v in DEFAULTS.get(table, {}).items():
        rows = rows.withColumn(c, F.coalesce(F.col(c), F.lit(v))) if c in rows.columns else rows.withColumn(c, F.lit(v))
    schema = SCHEMAS[table]
    rules = [(f"V10:{c}:required", _missing(c, schema[c].dataType)) for c in REQUIRED.get(table, []) if c in rows.columns]
    rules += [(f"V10:{c}:required", F.lit(True)) for c in REQUIRED.get(table, []) if c not in rows.columns]
    # values supplied but not parseable as the column's type
    rules += [(f"S10:{c}:unparsable", F.col(f"_raw_{c}").isNotNull() & F.col(c).isNull())
              for c in rows.columns if c in schema.fieldNames() and c != key]
    raw = [F.col(c).cast("string").alias(f"_raw_{c}") for c in rows.columns if c in schema.fieldNames() and c != key]
    typed = rows.select("*", *raw)
    typed = _conform(typed, table, keep=("change_id", "_copy", *[f"_raw_{c}" for c in rows.columns
                                                       if c in schema.fieldNames() and c != key])).drop(key)
    rules += [r for r in table_rules(table, [c for c in typed.columns if c != "change_id"]) if not r[0].startswith("V2:" + key)]
    rules += id_rules
    if table == "employee":
        rules += contact_rules(typed.columns)
    good, bad = validate(typed, rules)
    good = good.drop("_copy", *[c for c in good.columns if c.startswith("_raw_")])
    added = once(lambda: _conform(next_ids(good, store[table], key), table))
    return LazyFrames({table: lambda: store[table].unionByName(added()),
                       "rejects": lambda: _reject_rows(bad), "inserted": added})


def create_employees(store: Store, feed: DataFrame) -> dict[str, DataFrame]:
    """W1 for employees, with the rows of their type. ``feed``: change_id, the employee's fields,
    employee_type (required), hours_worked and hourly_wages (type 'hourly'), contract_id,
    contract dates and salary (type 'contract'); any other type has no subtype row. A request
    that breaks a rule of the employee or of its subtype is rejected as a whole."""
    rows, id_rules = identified(feed)
    rows = rows.withColumn("_type", F.lower(F.trim("employee_type")))
    hourly, contract = F.col("_type") == "hourly", F.col("_type") == "contract"
    rows = with_parent_flag(rows, "manager_id", store["employee"], "employee_id", "_no_manager")
    own = F.when(contract, F.col("contract_id"))
    rows = with_duplicate_flag(rows.withColumn("_contract", own), ["_contract"], "_twice")
    taken = store["contract"].select(F.col("contract_id").alias("_contract"), F.lit(True).alias("_taken"))
    rows = rows.join(taken, "_contract", "left")
    schema = SCHEMAS["employee"]
    rules = [(f"V10:{c}:required", _missing(c, schema[c].dataType)) for c in REQUIRED["employee"]]
    rules += [("V10:employee_type:required", _blank("employee_type"))]
    rules += [r for r in table_rules("employee", [c for c in schema.fieldNames() if c in feed.columns])
              if not r[0].endswith(":null")] + contact_rules(feed.columns)
    rules += [
        ("V3:manager_id:orphan", F.col("_no_manager")),
        ("W1:hourly_fields", hourly & (F.col("hours_worked").isNull() | F.col("hourly_wages").isNull())),
        ("V6:hours_worked:range", hourly & (F.col("hours_worked") < 0)),
        ("V6:hourly_wages:range", hourly & (F.col("hourly_wages") <= 0)),
        ("W1:contract_fields", contract & (F.col("contract_id").isNull() | F.col("contract_start_date").isNull()
                                           | F.col("contract_end_date").isNull() | F.col("salary").isNull())),
        ("V8:contract:dates", contract & (F.col("contract_start_date") >= F.col("contract_end_date"))),
        ("V6:salary:range", contract & (F.col("salary") <= 0)),
        ("V1:contract_id:duplicate", contract & (F.col("_twice") | F.col("_taken").isNotNull()))]
    good, bad = validate(rows, rules + id_rules)
    added = once(lambda: next_ids(good.withColumn("is_valid", F.lit(True)), store["employee"], "employee_id"))

    def appended(table: str, kind: str | None = None):
        def build() -> DataFrame:
            new = added() if kind is None else added().where(F.col("_type") == kind)
            return store[table].unionByName(_conform(new, table))
        return build

    return LazyFrames({
        "employee": appended("employee"), "hourly_employee": appended("hourly_employee", "hourly"),
        "contract": appended("contract", "contract"), "contract_employee": appended("contract_employee", "contract"),
        "inserted": lambda: _conform(added(), "employee"), "rejects": lambda: _reject_rows(bad)})


# ---- W2 ---------------------------------------------------------------------------------------
def patch_rows(store: Store, table: str, patches: DataFrame, ignore_blank: bool = False) -> dict[str, DataFrame]:
    """Set only the supplied fields. ``patches`` has change_id, the key, ``set_fields``
    (array<string>) and value columns; a field listed in ``set_fields`` with a NULL value sets
    NULL. Several patches of one key apply in change order (the latest per field wins).
    Unknown keys are rejected (employees, suppliers, products must also be active); empty
    patches, and patches that set a value the table's declared checks refuse, are rejected. ``ignore_blank`` treats blank text as not supplied (self-service)."""
    key = KEYS[table]
    base = store[table]
    fields = [c for c in base.columns if c != key and c in patches.columns]
    must_be_active = DEACTIVATE_NEEDS_ACTIVE.get(table, False)
    targets = (active(base) if must_be_active else base).select(key, F.lit(True).alias("_found"))
    patches, unplaced = ordered_requests(patches, key, "W2")
    p = patches.join(targets, key, "left")

    def supplied(c):
        given = F.array_contains("set_fields", c)
        if ignore_blank and dict(base.dtypes)[c] == "string":
            given = given & ~_blank(c)
        return F.coalesce(given, F.lit(False))

    # the declared checks hold for updates too, for the fields that a patch sets
    checks = [(code, supplied(code.split(":")[1]) & F.coalesce(bad, F.lit(False)))
              for code, bad in table_rules(table, fields)]
    empty = ~F.greatest(*[supplied(c) for c in fields], F.lit(False))
    unknown = F.col("_found").isNull()
    rules = [("W2:empty_patch", empty), ("W2:unknown_key", ~empty & unknown)] + [
        (code, ~empty & ~unknown & bad) for code, bad in checks]
    ok, bad_patches = validate(p, rules)
    rejects = _reject_rows(bad_patches).unionByName(unplaced)

    latest = ok.groupBy(key).agg(*[
        F.max_by(F.struct(F.col(c).cast(base.schema[c].dataType).alias("v")),
                 F.when(supplied(c), F.col("change_id"))).alias(f"_p_{c}") for c in fields])
    merged = base.join(latest, key, "left").select(*[
        F.col(c) if c == key or c not in fields else
        F.when(F.col(f"_p_{c}").isNotNull(), F.col(f"_p_{c}.v")).otherwise(F.col(c)).alias(c)
        for c in base.columns])
    return {table: merged, "rejects": rejects}


# ---- W3 / W4 ----------------------------------------------------------------------------------
def set_active(store: Store, table: str, flags: DataFrame, reactivate_needs_inactive: bool = False
               ) -> dict[str, DataFrame]:
    """Soft delete / reactivate by a feed (change_id, key, flag), request by request:
    deactivation needs an active row (customers: any row), reactivation needs an existing row
    (or an inactive one). Whether a request is accepted or not, the row's flag afterwards is
    the request's, so the state a request finds is the flag of the key's request before it."""
    return _set_active(store, table, *ordered_requests(flags, KEYS[table], "W3"), reactivate_needs_inactive)


def _set_active(store: Store, table: str, flags: DataFrame, unplaced: DataFrame,
                reactivate_needs_inactive: bool = False) -> dict[str, DataFrame]:
    """``set_active`` on requests that have a place in the order, and the rejects of the others.
    The table follows from each key's last flag: a rejected request leaves the state that it asked
    for. Only ``rejects`` and ``changed`` (keys with an accepted request) judge request by request."""
    key = KEYS[table]
    base = store[table]
    state = base.select(key, F.col("is_valid").alias("_old"))
    given = flags.where(F.col("flag").isNotNull())
    exists = F.col("_old").isNotNull()

    def judge() -> DataFrame:
        asked = previous_value(given, key, "flag", "change_id", "_before")
        req = asked.join(state, key, "left").withColumn("_now", F.coalesce("_before", "_old"))
        return req.withColumn("_ok", exists & F.when(F.col("flag"), react_ok).otherwise(deact_ok))

    deact_ok = F.col("_now") if DEACTIVATE_NEEDS_ACTIVE.get(table, False) else exists
    react_ok = ~F.col("_now") if reactivate_needs_inactive else exists
    req = once(judge)

    def rejects() -> DataFrame:
        return req().where(~F.col("_ok")).select(
            "change_id", F.when(~exists, F.lit("W3:unknown_key")).otherwise(F.lit("W3:state_guard")).alias("reason")
        ).unionByName(flags.where(F.col("flag").isNull()).select("change_id", F.lit("W3:missing_flag").alias("reason"))) \
            .unionByName(unplaced)

    def changed() -> DataFrame:
        return req().where("_ok").groupBy(key).agg(F.max_by("flag", "change_id").alias("_new"),
                                                   F.bool_or(~F.col("flag")).alias("_was_off"))

    def table_after() -> DataFrame:
        last = given.groupBy(key).agg(F.max_by("flag", "change_id").alias("_new"))
        # a row without a state keeps none, but for one whose key has rows with a state
        last = last.join(state.where(exists).select(key), key, "left_semi")
        return base.join(last, key, "left").withColumn("is_valid", F.coalesce("_new", "is_valid")).select(*base.columns)

    return LazyFrames({table: table_after, "rejects": rejects, "changed": changed})


def with_active(store: Store, table: str, rows: DataFrame, out: str, placed: DataFrame | None = None) -> DataFrame:
    """Add ``out``: true where the row of ``table`` that ``rows`` name by its key is active, else
    null. With the ``placed`` requests of a W3 feed it is judged as of the row's ``change_id``: by
    the key's last flag before it, else by the table. Rows without a key or change id find the
    table's state."""
    key = KEYS[table]
    if placed is None:
        return rows.join(active(store[table]).select(key, F.lit(True).alias(out)), key, "left")
    changes = placed.where(F.col("flag").isNotNull()).select(
        key, F.col("change_id").cast("long").alias("change_id"), F.col("flag").alias("_flag"))
    known = F.col(key).isNotNull() & F.col("change_id").isNotNull()
    seen = value_as_of(rows.where(known), changes, key, "change_id", "_flag").unionByName(
        rows.where(~known).withColumn("_flag", F.lit(None).cast("boolean")))
    state = store[table].select(key, F.col("is_valid").alias("_old"))
    on = F.col("_old").isNotNull() & F.coalesce("_flag", "_old")
    return seen.join(state, key, "left").withColumn(out, F.when(on, True)).drop("_flag", "_old")


def deactivate_employees(store: Store, flags: DataFrame) -> dict[str, DataFrame]:
    """Employee flag together with the flags of its subtype rows. A deactivation closes the
    subtype rows; a later reactivation does not open them again."""
    out = dict(set_active(store, "employee", flags))
    off = out["changed"].where("_was_off").select("employee_id")
    for child in ("hourly_employee", "contract_employee"):
        c = store[child]
        hit = c.join(off.withColumn("_off", F.lit(True)), "employee_id", "left")
        out[child] = hit.withColumn("is_valid", F.col("is_valid") & F.col("_off").isNull()).select(*c.columns)
    return out


def set_purchase_order_active(store: Store, flags: DataFrame) -> dict[str, DataFrame]:
    """Purchase order flag with its lines, request by request. Deactivation needs an
    active, still pending order (status compared case-insensitively); reactivation needs an
    inactive order.

    A pending order's flag after a request is the request's. Another order cannot be
    deactivated, so it is active once it was, or once any request asked for it. So the tables
    follow from an aggregate per order; only the rejects judge request by request."""
    key = "purchase_order_id"
    flags, unplaced = ordered_requests(flags, key, "W4")
    asked, flag = flags.where(F.col("flag").isNotNull()), F.col("flag")
    state = store["purchase_order"].select(
        key, F.col("is_valid").alias("_old"),
        F.coalesce(text_equals("delivery_status", "pending"), F.lit(False)).alias("_pending"))
    exists, pending = F.col("_old").isNotNull(), F.col("_pending")

    def rejects() -> DataFrame:
        by = previous_and_any(asked, key, "flag", "change_id", "_before", "_was_on")
        req = by.join(state, key, "left")
        now = F.when(pending, F.coalesce("_before", "_old")).otherwise(F.col("_old") | F.col("_was_on"))
        ok = F.when(flag, ~F.col("_now")).otherwise(F.col("_now") & pending)
        req = req.withColumn("_now", now).withColumn("_ok", exists & F.coalesce(ok, F.lit(False)))
        return req.where(~F.col("_ok")).select(
            "change_id", F.when(~exists, F.lit("W4:unknown_key")).otherwise(F.lit("W4:state_guard")).alias("reason")
        ).unionByName(flags.where(flag.isNull()).select("change_id", F.lit("W4:missing_flag").alias("reason"))) \
            .unionByName(unplaced)

    def accepted() -> DataFrame:
        """The flag that the order's accepted requests leave; orders without one are left out."""
        last = asked.groupBy(key).agg(F.max_by("flag", "change_id").alias("_last"), F.bool_or(flag).alias("_any_on"),
                                      F.bool_or(~flag).alias("_any_off"))
        on = F.col("_any_on") & ~F.col("_old")
        new = F.when(pending & (on | (F.col("_any_off") & F.col("_old"))), F.col("_last")).when(~pending & on, True)
        changed = last.join(state.where(exists), key).withColumn("_new", new).where(F.col("_new").isNotNull())
        # a key that has several rows: a withdrawal of a pending one comes after what switched others on
        return changed.groupBy(key).agg(F.min("_new").alias("_new"))

    def after(t: str):
        def build() -> DataFrame:
            d = store[t]
            return d.join(accepted(), key, "left") \
                .withColumn("is_valid", F.coalesce("_new", "is_valid")).select(*d.columns)
        return build

    return LazyFrames({"rejects": rejects, **{t: after(t) for t in ("purchase_order", "purchase_order_details")}})


# ---- W5 ---------------------------------------------------------------------------------------
def archive_delete_products(store: Store, ids: DataFrame, as_of: _dt.datetime) -> dict[str, DataFrame]:
    """Copy the products to the archive with a stamp, delete their lines from both detail
    tables, delete the products. Unknown ids are skipped."""
    keys = ids.select("product_id").distinct()
    gone = store["product"].join(keys, "product_id", "left_semi")
    lines = ("order_details", "purchase_order_details")
    archived = gone.select("product_id", "product_name", "category", "price", "stock_quantity", "stock_arrival_date",
                           F.lit(as_of).cast("timestamp").alias("archived_at"))
    return LazyFrames({
        "product_archive": lambda: store["product_archive"].unionByName(archived), "archived": lambda: archived,
        "product": lambda: store["product"].join(keys, "product_id", "left_anti"),
        **{t: (lambda t=t: by_products(store[t], keys, "left_anti")) for t in lines}})


def by_products(rows: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """``rows`` whose product is (``left_semi``) or is not (``left_anti``) among ``keys``. Ids that
    lie close together go to the rows as bitmaps, so that lines stay where they lie, by order;
    others meet them in a join by product."""
    buckets = dense(keys, "product_id")
    if buckets is None or buckets > BROADCAST_BUCKETS:
        return rows.join(keys, "product_id", how)
    found = with_membership(rows, "product_id", key_set(keys, "product_id"), "_among", buckets)
    return found.where(F.col("_among") if how == "left_semi" else ~F.col("_among")) \
        .select("product_id", *[c for c in rows.columns if c != "product_id"])


# A counter may be raised by this much before anybody has to look whether it still fits.
ORDER_COUNT_SPAN = 2 ** 30


# ---- W7 ---------------------------------------------------------------------------------------
def checkout_carts(store: Store, requests: DataFrame, as_of: _dt.date | None = None) -> dict[str, DataFrame]:
    """Check out customers' open carts, request by request: a customer's n-th complete
    request takes the n-th of the customer's orders in state 'cart' (by order id). A request
    without name, email or payment method, a card payment without card fields, a request
    beyond the customer's carts, or a cart whose total does not fit the payment is rejected.
    Output: orders (confirmed, dated), lines flagged off, new invoice and payment of the cart's
    active-line total, customer counter + 1. A customer whose counter is full has the requests
    beyond it rejected (the n-th complete request counts as n)."""
    o = store["orders"]
    asked, id_rules = identified(requests)
    rules = [("W7:missing_customer", F.col("customer_id").isNull()),
             ("W7:missing_field", _blank("name") | _blank("email") | _blank("payment_method")),
             ("W7:card_fields", (F.lower("payment_method") == "card") & ~F.coalesce("has_card_fields", F.lit(False)))]
    good, bad = validate(asked, rules + id_rules)
    good = numbered_within(good.select("change_id", "customer_id", "payment_method"),
                           "customer_id", "change_id", "_nth")
    carts = o.where(text_equals("status", "cart")).select("customer_id", "order_id") \
        .join(good.select("customer_id").distinct(), "customer_id", "left_semi")
    carts = numbered_within(carts, "customer_id", "order_id", "_nth")
    matched = good.join(carts, ["customer_id", "_nth"], "left")
    no_cart = matched.where(F.col("order_id").isNull()).select("change_id", F.lit("W7:no_cart").alias("reason"))
    done = matched.where(F.col("order_id").isNotNull())
    od = store["order_details"]
    totals = active(od).join(done.select("order_id"), "order_id", "left_semi").groupBy("order_id").agg(
        F.sum((F.col("price") * F.col("quantity")).cast(LINE_MONEY)).alias("_total"))
    done = done.join(totals, "order_id", "left").withColumn(
        "amount_paid", F.coalesce("_total", F.lit(0)).try_cast("decimal(10,2)"))
    too_large = done.where(F.col("amount_paid").isNull()).select(
        "change_id", F.lit("W7:amount_out_of_range").alias("reason"))
    # the counter of a customer whose checkouts would not fit it
    c = store["customer"]
    room = c.where(F.col("order_count") > INT_MAX - ORDER_COUNT_SPAN).select(
        "customer_id", (F.lit(INT_MAX) - F.col("order_count")).alias("_room"))
    done = done.where(F.col("amount_paid").isNotNull()).join(room, "customer_id", "left")
    full = F.coalesce(F.col("_nth") > F.col("_room"), F.lit(False))
    too_many = done.where(full).select("change_id", F.lit("W7:order_count_out_of_range").alias("reason"))
    done = kept(done.where(~full).drop("_room"))
    hit = done.select("order_id", F.lit(True).alias("_hit"))
    orders = o.join(hit, "order_id", "left").select(*[
        F.when(F.col("_hit"), F.lit("confirmed")).otherwise(F.col("status")).alias("status") if c == "status" else
        F.when(F.col("_hit"), as_of_date(as_of)).otherwise(F.col("order_date")).alias("order_date") if c == "order_date" else
        F.col(c) for c in o.columns])
    lines = od.join(hit, "order_id", "left").withColumn("is_valid", F.col("is_valid") & F.col("_hit").isNull()) \
        .select(*od.columns)
    def numbered() -> DataFrame:
        # one position per checkout gives both new ids (invoice and payment)
        top_invoice = store["invoice"].agg(F.coalesce(F.max("invoice_id"), F.lit(0))).scalar()
        top_payment = store["payment"].agg(F.coalesce(F.max("payment_id"), F.lit(0))).scalar()
        return positions(done, "change_id", "_pos") \
            .withColumn("invoice_id", (top_invoice + F.col("_pos")).cast("long")) \
            .withColumn("payment_id", (top_payment + F.col("_pos")).cast("long"))

    inv = once(numbered)

    def new_invoices() -> DataFrame:
        new = inv().select("invoice_id", "order_id", as_of_date(as_of).alias("invoice_date"), F.lit(True).alias("is_valid"))
        return _conform(new, "invoice")

    def invoices() -> DataFrame:
        return store["invoice"].unionByName(new_invoices())

    def new_payments() -> DataFrame:
        new = inv().select("payment_id", "invoice_id", as_of_date(as_of).alias("payment_date"), "amount_paid",
                           "payment_method", F.lit(True).alias("is_valid"))
        return _conform(new, "payment")

    def payments() -> DataFrame:
        return store["payment"].unionByName(new_payments())

    bumps = done.groupBy("customer_id").agg(F.count(F.lit(1)).alias("_n"))
    customers = c.join(bumps, "customer_id", "left").withColumn(
        "order_count", (F.coalesce("order_count", F.lit(0)) + F.coalesce("_n", F.lit(0))).cast("int")).select(*c.columns)
    return LazyFrames({"orders": lambda: orders, "order_details": lambda: lines, "invoice": invoices,
                       "payment": payments, "new_payments": new_payments, "new_invoices": new_invoices, "customer": lambda: customers,
                       "rejects": lambda: _reject_rows(bad).unionByName(no_cart).unionByName(too_large)
                       .unionByName(too_many)})


# ---- W8 ---------------------------------------------------------------------------------------
def set_order_status(store: Store, feed: DataFrame) -> dict[str, DataFrame]:
    """Employee status updates (change_id, employee_id, order_id, status, received_date).
    The status must be given and the order must be active and belong to the employee. Requests
    apply in order: the status is the last one's, the received date that of the last request
    with status 'completed' (any case) and a date."""
    o = store["orders"]
    owned = active(o).select("order_id", F.col("employee_id").alias("_owner"))
    feed, unplaced = ordered_requests(feed, "order_id", "W8")
    req = feed.join(owned, "order_id", "left")
    good, bad = validate(req, [
        ("W8:missing_status", _blank("status")),
        ("W8:not_found_or_not_owned", ~_blank("status")
         & ~F.coalesce(F.col("_owner") == F.col("employee_id"), F.lit(False)))])
    dated = text_equals("status", "completed") & F.col("received_date").isNotNull()
    last = good.groupBy("order_id").agg(
        F.max_by("status", "change_id").alias("_status"),
        F.max_by("received_date", F.when(dated, F.col("change_id"))).alias("_date"))
    out = o.join(last, "order_id", "left") \
        .withColumn("status", F.coalesce("_status", "status")) \
        .withColumn("actual_received_date", F.coalesce("_date", "actual_received_date"))
    return {"orders": out.select(*o.columns), "rejects": _reject_rows(bad).unionByName(unplaced)}


# ---- W9 ---------------------------------------------------------------------------------------
def create_purchase_orders(store: Store, requests: DataFrame, items: DataFrame, as_of: _dt.date | None = None,
                           stock_on: str = "create", flags: Mapping[str, DataFrame] | None = None
                           ) -> dict[str, DataFrame]:
    """``requests`` (change_id, supplier_id, employee_id, expected_received_date) with their
    ``items`` (change_id, product_id, price, quantity) as a separate frame, so an order with
    very many items is never gathered into one row. A request is rejected as a whole when a
    field is missing or it has no item, the expected date is not after ``as_of``, the supplier
    is not active, any item's product is not active, repeated, or has no positive price and
    quantity, or the stock of a product would no longer fit its column (counted up to the request
    over all requests before it). Accepted: header ('pending', dated
    ``as_of``), lines, and stock up (``stock_on='create'``; with 'receive' stock moves at W10
    instead, S15). ``flags`` holds W3 feeds of 'supplier' and 'product' whose change ids are of
    the same order: a request finds the suppliers and products as the flags before it left them."""
    flags = flags or {}
    return _create_purchase_orders(store, requests, items, as_of, stock_on,
                                   {t: ordered_requests(f, KEYS[t], "W3")[0] for t, f in flags.items()})


def _create_purchase_orders(store: Store, requests: DataFrame, items: DataFrame, as_of: _dt.date | None,
                            stock_on: str, placed: Mapping[str, DataFrame], in_files: bool = False
                            ) -> dict[str, DataFrame]:
    """``create_purchase_orders`` with the flag requests that have a place in the order. Requests
    and items are read for several rules, so they are computed once (requests that lie ``in_files``
    are read from there)."""
    requests, items = requests if in_files else kept(requests), kept(items)
    asked, id_rules = identified(requests)
    r = with_active(store, "supplier", asked, "_supp_ok", placed.get("supplier"))
    bad_value = F.col("price").isNull() | (F.col("price") <= 0) | F.col("quantity").isNull() | (F.col("quantity") <= 0)
    judged = with_duplicate_flag(items, ["change_id", "product_id"], "_again") \
        .select("change_id", "product_id", bad_value.alias("_bad_value"), "_again")
    flagged = with_active(store, "product", judged, "_ok", placed.get("product")).groupBy("change_id").agg(
        F.lit(True).alias("_has_items"), F.bool_or(F.col("_ok").isNull()).alias("_inactive"),
        F.bool_or("_bad_value").alias("_bad_value"), F.bool_or("_again").alias("_again"))
    r = r.join(flagged, "change_id", "left")
    rules = [("W9:missing_field", F.col("supplier_id").isNull() | F.col("employee_id").isNull()
              | F.col("expected_received_date").isNull() | F.col("_has_items").isNull()),
             ("V9:expected_date_not_after_as_of", F.col("expected_received_date") <= as_of_date(as_of)),
             ("W9:supplier_inactive", F.col("_supp_ok").isNull()),
             ("W9:inactive_product", F.coalesce("_inactive", F.lit(False))),
             ("W9:bad_price_or_quantity", F.coalesce("_bad_value", F.lit(False))),
             ("W9:repeated_product", F.coalesce("_again", F.lit(False)))] + id_rules
    good, bad = validate(r, rules)
    rejects = _reject_rows(bad)
    if stock_on == "create":
        beyond = _beyond_stock(store["product"], items, good)
        if beyond is not None:
            rejects = rejects.unionByName(beyond.select("change_id", F.lit("W9:stock_out_of_range").alias("reason")))
            good = good.join(beyond, "change_id", "left_anti")
    hdr = once(lambda: next_ids(good.select("change_id", "supplier_id", "employee_id", "expected_received_date"),
                                _keys_of(store, "purchase_order"), "purchase_order_id"))

    def new_headers() -> DataFrame:
        new = hdr().select("purchase_order_id", "employee_id", "supplier_id", as_of_date(as_of).alias("order_date"),
                           "expected_received_date", F.lit(None).cast("date").alias("actual_received_date"),
                           F.lit("pending").alias("delivery_status"), F.lit(True).alias("is_valid"))
        return _conform(new, "purchase_order")

    def headers() -> DataFrame:
        return store["purchase_order"].unionByName(new_headers())

    new_lines = once(lambda: items.join(hdr().select("change_id", "purchase_order_id"), "change_id").select(
        "purchase_order_id", "product_id", "price", "quantity", F.lit(True).alias("is_valid")))
    out = {"purchase_order": headers, "new_purchase_orders": new_headers,
           "purchase_order_details": lambda: store["purchase_order_details"].unionByName(
               _conform(new_lines(), "purchase_order_details")),
           "new_lines": lambda: _conform(new_lines(), "purchase_order_details"),
           "rejects": lambda: rejects}
    if stock_on == "create":
        def stocked() -> DataFrame:
            # accepted requests have one change id each; for the stock alone they get no new ids
            accepted = hdr() if hdr.built() else good
            moves = items.join(accepted.select("change_id"), "change_id").groupBy("product_id").agg(
                F.sum("quantity").cast("long").alias("stock_change"))
            return apply_stock(store["product"], moves)

        out["product"] = stocked
    return LazyFrames(out)


def apply_stock(product: DataFrame, moves: DataFrame) -> DataFrame:
    """Add signed stock changes (product_id, stock_change) to the product table."""
    j = product.join(moves, "product_id", "left")
    return j.withColumn("stock_quantity", (F.col("stock_quantity") + F.coalesce("stock_change", F.lit(0))).cast("int")) \
        .select(*product.columns)


def purchase_feed(store: Store, requests: DataFrame, items: DataFrame, flags: Mapping[str, DataFrame],
                  as_of: _dt.date | None = None, in_files: bool = False) -> dict[str, DataFrame]:
    """W3 and W9 as one ordered feed: switching suppliers and products on and off (``flags``, by
    table) and purchase requests share their change ids, and each is judged on what those before
    it left. Change ids must be distinct over all of them. Stock moves with the request. Requests
    and flags that lie ``in_files``, but for a projection, are not written again."""
    ordered = {t: ordered_requests(f if in_files else kept(f), KEYS[t], "W3") for t, f in flags.items()}
    switched = {t: _set_active(store, t, *o) for t, o in ordered.items()}
    bought = _create_purchase_orders(store, requests, items, as_of, "create", {t: o[0] for t, o in ordered.items()},
                                    in_files)

    def products() -> DataFrame:
        stocked = bought["product"]
        if "product" not in switched:
            return stocked
        now = switched["product"]["product"].select("product_id", F.col("is_valid").alias("_now"))
        return stocked.join(now, "product_id").withColumn("is_valid", F.col("_now")).select(*stocked.columns)

    def rejects() -> DataFrame:
        out = bought["rejects"]
        for job in switched.values():
            out = out.unionByName(job["rejects"])
        return out

    return LazyFrames({**{t: (lambda t=t: bought[t]) for t in ("purchase_order", "new_purchase_orders",
                                                               "purchase_order_details", "new_lines")},
                       **{t: (lambda t=t: switched[t][t]) for t in switched}, "product": products, "rejects": rejects})


# ---- W10 --------------------------------------------------------------------------------------
def set_purchase_status(store: Store, feed: DataFrame, stock_on: str = "create") -> dict[str, DataFrame]:
    """(change_id, purchase_order_id, status, received_date), for active purchase orders.
    Requests apply in order: the status is the last one's; 'Received' with a date also sets the
    received date (the last such request's) and the products' arrival date. With
    ``stock_on='receive'`` the stock moves here, never on both paths, and once per purchase order
    whatever the feeds: only when the order had no received date before. Requests that receive an
    order whose stock would not fit the product's column are rejected."""
    po = store["purchase_order"]
    known = active(po).select("purchase_order_id", F.lit(True).alias("_k"))
    feed, unplaced = ordered_requests(feed, "purchase_order_id", "W10")
    req = feed.join(known, "purchase_order_id", "left")
    good, bad = validate(req, [
        ("W10:missing_status", _blank("status")),
        ("W10:not_found_or_inactive", ~_blank("status") & F.col("_k").isNull()),
        ("V7:delivery_status:domain", ~_blank("status") & F.col("_k").isNotNull()
         & ~F.lower("status").isin([s.lower() for s in DELIVERY_STATUSES]))])
    rejects = _reject_rows(bad).unionByName(unplaced)
    received = (F.col("status") == "Received") & F.col("received_date").isNotNull()
    fresh = po.where(F.col("actual_received_date").isNull()).select("purchase_order_id", F.lit(True).alias("_fresh"))
    items = active(store["purchase_order_details"])
    if stock_on == "receive":
        # an order moves stock at its first receiving request
        first = good.where(received).join(fresh, "purchase_order_id", "left_semi") \
            .groupBy("purchase_order_id").agg(F.min("change_id").alias("change_id"))
        beyond = _beyond_stock(store["product"], items.join(first, "purchase_order_id"), first)
        if beyond is not None:
            over = first.join(beyond, "change_id", "left_semi").select("purchase_order_id", F.lit(True).alias("_over"))
            good = good.join(over, "purchase_order_id", "left")
            refused = received & F.col("_over").isNotNull()
            rejects = rejects.unionByName(good.where(refused).select(
                "change_id", F.lit("W10:stock_out_of_range").alias("reason")))
            good = good.where(~refused).drop("_over")
    last = good.groupBy("purchase_order_id").agg(
        F.max_by("status", "change_id").alias("_status"),
        F.max_by(F.struct("change_id", "received_date"), F.when(received, F.col("change_id"))).alias("_in"))
    j = po.join(last, "purchase_order_id", "left")
    new_po = j.withColumn("delivery_status", F.coalesce("_status", "delivery_status")) \
        .withColumn("actual_received_date", F.coalesce("_in.received_date", "actual_received_date")) \
        .select(*po.columns)
    arrivals = last.where(F.col("_in").isNotNull()).select("purchase_order_id", "_in") \
        .join(fresh, "purchase_order_id", "left")
    per_product = items.join(arrivals, "purchase_order_id") \
        .groupBy("product_id").agg(F.max_by("_in.received_date", "_in.change_id").alias("_arrival"),
                                   F.sum(F.when(F.col("_fresh"), F.col("quantity"))).cast("long").alias("stock_change"))
    p = store["product"]
    products = p.join(per_product, "product_id", "left") \
        .withColumn("stock_arrival_date", F.coalesce("_arrival", "stock_arrival_date"))
    if stock_on == "receive":
        products = products.withColumn("stock_quantity",
                                       (F.col("stock_quantity") + F.coalesce("stock_change", F.lit(0))).cast("int"))
    return {"purchase_order": new_po, "product": products.select(*p.columns), "rejects": rejects}


# ---- W11 --------------------------------------------------------------------------------------
def change_employee_type(store: Store, feed: DataFrame) -> dict[str, DataFrame]:
    """(change_id, employee_id, new_type, hours_worked, hourly_wages, contract_start_date,
    contract_end_date, salary). Every accepted request takes effect: it closes the employee's
    active subtype rows; an hourly one then upserts the hourly row, a contract one adds a contract
    (which stays, whatever comes later) and upserts the employee's reference to it (the subtype
    tables are keyed by employee). So the hourly and contract rows have the values of the last
    request of their type, and are active where that was the employee's last request."""
    e = active(store["employee"]).select("employee_id", F.lit(True).alias("_e"))
    asked, id_rules = identified(feed)
    req = asked.join(e, "employee_id", "left")
    t = F.lower("new_type")
    rules = id_rules + [("W11:unknown_employee", F.col("_e").isNull()),  # a null id is unknown too
             ("W11:bad_type", F.coalesce(~t.isin("hourly", "contract", "regular"), F.lit(True))),
             ("W11:missing_field", ((t == "hourly") & (F.col("hours_worked").isNull() | F.col("hourly_wages").isNull()))
              | ((t == "contract") & (F.col("salary").isNull() | F.col("contract_start_date").isNull()
                                      | F.col("contract_end_date").isNull()))),
             ("V8:contract:dates", (t == "contract") & (F.col("contract_start_date") >= F.col("contract_end_date")))]
    good, bad = validate(req, rules)
    good = good.withColumn("_t", t)
    is_hourly, is_contract = F.col("_t") == "hourly", F.col("_t") == "contract"
    ended = good.groupBy("employee_id").agg(
        F.max_by("_t", "change_id").alias("_type"),
        F.max_by(F.struct("hours_worked", "hourly_wages"), F.when(is_hourly, F.col("change_id"))).alias("_hours"),
        F.max(F.when(is_contract, F.col("change_id"))).alias("_contract_change"))
    he, ce = store["hourly_employee"], store["contract_employee"]

    def upserted(table: str, old: DataFrame, new: DataFrame) -> DataFrame:
        """Rows of ``old`` closed where the employee asked for a type, and replaced by ``new``."""
        closed = old.join(ended.select("employee_id", F.lit(True).alias("_touch")), "employee_id", "left") \
            .withColumn("is_valid", F.col("is_valid") & F.col("_touch").isNull()).select(*old.columns)
        return closed.join(new.select("employee_id"), "employee_id", "left_anti").unionByName(_conform(new, table))

    def hourly_employees() -> DataFrame:
        return upserted("hourly_employee", he, ended.where(F.col("_hours").isNotNull()).select(
            "employee_id", "_hours.*", (F.col("_type") == "hourly").alias("is_valid")))

    contracts = once(lambda: next_ids(good.where(is_contract).select(
        "change_id", "employee_id", "contract_start_date", "contract_end_date", "salary"), store["contract"],
        "contract_id"))

    def contract_employees() -> DataFrame:
        of = contracts().select(F.col("change_id").alias("_contract_change"), "contract_id")
        return upserted("contract_employee", ce, ended.join(of, "_contract_change").select(
            "employee_id", "contract_id", (F.col("_type") == "contract").alias("is_valid")))

    def new_contracts() -> DataFrame:
        new_c = contracts().select("contract_id", "contract_start_date", "contract_end_date", "salary",
                                   F.lit(True).alias("is_valid"))
        return _conform(new_c, "contract")

    return LazyFrames({"hourly_employee": hourly_employees, "contract_employee": contract_employees,
                       "contract": lambda: store["contract"].unionByName(new_contracts()), "new_contracts": new_contracts, "rejects": lambda: _reject_rows(bad)})


# ---- W12 --------------------------------------------------------------------------------------
def stock_ledger(store: Store, stock_on: str = "create") -> DataFrame:
    """Net stock movement per product, next to the stored stock; ``negative`` marks products
    whose stored stock would not cover the movement. Out: every sale line, whatever its flag
    (checkout flags sold lines off, and a removal gives no stock back). In: purchase lines where
    W9 or W10 move stock, by the same ``stock_on``: lines of every purchase order ('create', the
    default) or active lines of received ones ('receive')."""
    sold = store["order_details"].select("product_id", (-F.col("quantity").cast("long")).alias("q"))
    got = store["purchase_order_details"]
    if stock_on == "receive":
        received_po = store["purchase_order"].where(text_equals("delivery_status", "received"))
        got = active(got).join(received_po.select("purchase_order_id"), "purchase_order_id", "left_semi")
    got = got.select("product_id", F.col("quantity").cast("long").alias("q"))
    moves = sold.unionByName(got).groupBy("product_id").agg(
        F.sum(F.when(F.col("q") < 0, -F.col("q")).otherwise(0)).alias("sold"),
        F.sum(F.when(F.col("q") > 0, F.col("q")).otherwise(0)).alias("received"),
        F.sum("q").alias("net_movement"))
    p = store["product"].select("product_id", "stock_quantity")
    out = p.join(moves, "product_id", "left").select(
        "product_id", "stock_quantity", F.coalesce("sold", F.lit(0)).alias("sold"),
        F.coalesce("received", F.lit(0)).alias("received"), F.coalesce("net_movement", F.lit(0)).alias("net_movement"))
    return out.withColumn("negative", (F.col("stock_quantity") + F.col("net_movement")) < 0)
