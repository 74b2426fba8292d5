"""Store I/O (A1, A2, A6): the store as plain Spark tables, JDBC loading, JSON sink.

A staged store lies in a folder of its own per application, ``<root>/<table>``, and a table is
written when it is first used, by Spark's own committer. Change jobs that write tables in place
are in ``mercato.sources.partitioned``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mercato.operators.heavy import heavy_keys
from mercato.session import partition_count, shuffles_freed
from mercato.sources.adapter import KEY_ROWS, PLACED_BUILDERS, Part, Store
from mercato.sources.schemas import SCHEMAS, TABLES

# tables bucketed by their join key when written, so that order x lines joins and per-order
# aggregates read co-partitioned, sorted files without a shuffle
CLUSTER_KEYS = {"orders": "order_id", "order_details": "order_id", "purchase_order": "purchase_order_id",
                "purchase_order_details": "purchase_order_id"}


def _catalog_name(path: str) -> str:
    return "mercato_" + hashlib.sha1(path.encode()).hexdigest()[:16]


def _open_table(spark: SparkSession, table: str, path: str, bucket: list | None) -> DataFrame:
    """Plain tables are read as Parquet with the declared schema. Bucketed tables are read
    through the session catalog, declared over the existing files with their bucket spec, so
    the scan reports hash partitioning on the key and joins / aggregates on it skip the
    shuffle."""
    if not bucket:
        return spark.read.schema(SCHEMAS[table]).parquet(path)
    key, n = bucket
    name = _catalog_name(path)
    if not spark.catalog.tableExists(name):
        cols = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in SCHEMAS[table].fields)
        spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({cols}) USING parquet "
                  f"CLUSTERED BY ({key}) SORTED BY ({key}) INTO {int(n)} BUCKETS LOCATION '{path}'")
    return spark.table(name)


BUCKET_BYTES = 32 * 1024 * 1024


def bucket_count(spark: SparkSession, source_bytes: int | None = None) -> int:
    """Buckets per clustered table: as many as a shuffle starts with, so that rows shuffled by a
    table's key meet the table where it lies and only they are shuffled. That number follows the
    source's size (``fit_partitions``); with ``source_bytes`` there is at least one bucket per
    32 MB of source data (about two million lines), so no bucket outgrows a task."""
    return max(partition_count(spark), -(-int(source_bytes or 0) // BUCKET_BYTES))


def write_table(df: DataFrame, path: str, table: str, buckets: int | None = None) -> list | None:
    """Write one store table as Parquet. Tables with a join key are bucketed and sorted by
    it (an external catalog table over ``path``); returns the bucket spec, or None."""
    key = CLUSTER_KEYS.get(table)
    if key and buckets:
        # hash-partition on the key first (the same hash bucketing uses), so each bucket is
        # written by one task as one sorted file instead of one file per task and bucket
        (df.repartition(buckets, key).write.mode("overwrite").format("parquet")
         .bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(_catalog_name(path)))
        return [key, buckets]
    df.write.mode("overwrite").parquet(path)
    return None


# tables in which one key may hold very many rows; ``SALT`` spreads such a key's rows
SALTED = ("order_details", "purchase_order_details")
SALT = "product_id"


def _stage_parts(live: Store, root: str, table: str, n: int) -> list[Part]:
    """Write one table; the parts it lies in. Rows of heavy keys go to files of their own, spread
    by a second column, because a bucket cannot be split when it is read."""
    spark, path, key = live.spark, f"{root.rstrip('/')}/{table}", CLUSTER_KEYS.get(table)
    rows, keys = live[table], None
    if table in SALTED or (table in PLACED_BUILDERS and live.driver):
        raw = KEY_ROWS[table](live.driver) if live.driver else rows.select(key)
        keys = heavy_keys(raw, n)
        if keys is None and live.driver:
            # no key has very many rows: group them where they are written, in one shuffle
            rows = PLACED_BUILDERS[table](live.driver, n)
            rows.write.mode("overwrite").format("parquet").bucketBy(n, key).sortBy(key) \
                .option("path", path).saveAsTable(_catalog_name(path))
            return [Part(_open_table(spark, table, path, [key, n]))]
    if keys is None or table not in SALTED:
        return [Part(_open_table(spark, table, path, write_table(rows, path, table, n)))]
    keys.write.mode("overwrite").parquet(f"{path}_heavy_keys")
    keys = spark.read.schema(keys.schema).parquet(f"{path}_heavy_keys")
    few = F.broadcast(keys)  # fewer than 2n rows
    rest = write_table(rows.join(few, key, "left_anti"), path, table, n)
    (rows.join(few, key, "left_semi").select(*SCHEMAS[table].fieldNames()).repartition(n, key, SALT)
     .write.mode("overwrite").parquet(f"{path}_heavy"))
    return [Part(_open_table(spark, table, path, rest), keys),
            Part(spark.read.schema(SCHEMAS[table]).parquet(f"{path}_heavy"), keys, heavy=True)]


def staged_store(live: Store, root: str, buckets: int | None = None) -> Store:
    """``live`` with every table written under ``root`` the first time it is read."""
    n = buckets or bucket_count(live.spark)
    staged: dict[str, list[Part]] = {}

    def parts(table: str) -> list[Part]:
        if table not in staged:
            with shuffles_freed(live.spark):
                staged[table] = _stage_parts(live, root, table, n)
        return staged[table]

    def whole(table: str) -> DataFrame:
        return reduce(DataFrame.unionByName, [p.rows for p in parts(table)])

    return Store(live.spark, {t: (lambda t=t: whole(t)) for t in live}, live.driver,
                 {t: (lambda t=t: parts(t)) for t in live})


def load_store_jdbc(spark: SparkSession, url: str, properties: Mapping[str, str],
                    partitions: Mapping[str, tuple[str, int, int, int]] | None = None,
                    table_names: Mapping[str, str] | None = None) -> Store:
    """A2: the 14 tables out of an existing relational database. Large tables are read in
    parallel ranges: ``partitions[table] = (column, lower, upper, num_partitions)``. Passwords
    and card data are not selected. (No JDBC driver jar ships here, so this is untested.)"""
    partitions = partitions or {}
    names = table_names or {}

    def make(t):
        def read():
            reader = spark.read.format("jdbc").option("url", url).option("dbtable", names.get(t, t))
            for k, v in properties.items():
                reader = reader.option(k, v)
            if t in partitions:
                col, lo, hi, n = partitions[t]
                reader = (reader.option("partitionColumn", col).option("lowerBound", lo)
                          .option("upperBound", hi).option("numPartitions", n))
            df = reader.load()
            return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in SCHEMAS[t].fields])
        return read
    return Store(spark, {t: make(t) for t in TABLES})


def to_json_lines(df: DataFrame) -> DataFrame:
    """One JSON document per row; dates as ISO text, money as numbers."""
    cols = []
    for f in df.schema.fields:
        s = f.dataType.simpleString()
        if s == "date":
            cols.append(F.date_format(f.name, "yyyy-MM-dd").alias(f.name))
        elif s.startswith("decimal"):
            cols.append(F.col(f.name).cast("double").alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}).alias("json"))


def write_json(df: DataFrame, path: str) -> None:
    """A6 sink: the JSON documents as text files."""
    to_json_lines(df).write.mode("overwrite").text(path)
