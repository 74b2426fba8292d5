"""mercato: retail commerce analytics on Spark DataFrames.

Layout
------
sources/    store schemas, the adapter from the driver's tables, parquet / JDBC / JSON I/O
functions/  column expressions (status text, money strings, predicates) and the search specs
operators/  reusable Spark operators: per-group top-1, distributed dense rank, arg-max with ties,
            validation with quarantine, change jobs over feeds
plans/      the composite queries (customer profile, management and employee reports, listings)
streaming/  Structured Streaming form of the cart event fold
"""

from mercato.session import configure, build_session  # noqa: F401
