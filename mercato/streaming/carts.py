"""Structured Streaming form of the cart fold.

``readStream`` of event files -> cart events -> ``foreachBatch``:

1. the micro-batch is written to an event log partitioned by ``batch_id`` with overwrite,
   so a replayed batch (after a failure) replaces itself instead of duplicating events;
2. the customers of the batch are re-folded from their whole history in the log (duplicates by
   ``event_id`` removed), so late and out-of-order events land exactly where the batch fold
   puts them - no counters are incremented and no watermark can drop an event;
3. their ``cart_lines`` and ``cart_orders``, plus the unchanged rows of the other customers in
   the same buckets, replace those buckets' partitions in the state tables (dynamic partition
   overwrite). Work per batch grows with the batch's customers and the touched buckets' state,
   not with the whole history.

Every path lives under one state folder on shared storage (the checkpoint folder of the
session by default); no machine-local folder is used. The result equals the batch fold over
all events, whatever the micro-batch split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from mercato.operators.carts import cart_events, fold_carts
from mercato.session import ensure_checkpoint_dir, shared_dir

EVENTS_SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
BUCKETS = 256


def bucket_of(col: str = "customer_id", buckets: int = BUCKETS):
    return F.pmod(F.xxhash64(F.col(col)), F.lit(buckets)).cast("int")


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def _refold(spark: SparkSession, batch: DataFrame, batch_id: int, products: DataFrame, state_dir: str,
            buckets: int) -> None:
    log_path = f"{state_dir}/log"
    # the log is laid out by bucket and then batch: a replayed batch replaces its own files, and a
    # filter on the buckets prunes the log to the files of the batch's customers
    (batch.withColumn("cust_bucket", bucket_of("customer_id", buckets)).withColumn("batch_id", F.lit(batch_id))
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("cust_bucket", "batch_id").parquet(log_path))
    written = spark.read.parquet(log_path).where(F.col("batch_id") == batch_id)
    # the set of touched buckets is bounded by ``buckets``
    touched_buckets = [r[0] for r in written.select("cust_bucket").distinct().collect()]
    if not touched_buckets:
        return
    touched = written.select("customer_id").distinct()
    in_buckets = F.col("cust_bucket").isin(touched_buckets)
    # only the customers of this batch are folded again, from their whole history
    history = spark.read.parquet(log_path).where(in_buckets).join(touched, "customer_id", "left_semi")
    events = history.drop("batch_id", "cust_bucket").dropDuplicates(["event_id"])
    out = fold_carts(events, products)
    ensure_checkpoint_dir(spark)
    for name in ("cart_lines", "cart_orders"):
        path = f"{state_dir}/{name}"
        fresh = out[name].withColumn("cust_bucket", bucket_of("customer_id", buckets))
        if _exists(spark, path):
            # the other customers of the touched buckets keep their rows; they are cut from the
            # files about to be replaced by a reliable checkpoint
            kept = spark.read.parquet(path).where(in_buckets).join(touched, "customer_id", "left_anti")
            fresh = fresh.unionByName(kept.checkpoint(eager=True))
        (fresh.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("cust_bucket").parquet(path))


def start_cart_stream(spark: SparkSession, source_dir: str, products: DataFrame, state_dir: str | None = None,
                      buckets: int = BUCKETS, available_now: bool = True,
                      processing_time: str | None = None, max_files_per_trigger: int | None = None
                      ) -> tuple[StreamingQuery, str]:
    """Start the stream over event parquet files in ``source_dir``. Returns the query and the
    state folder (``cart_lines``, ``cart_orders``, ``log``, ``_checkpoint`` inside)."""
    state_dir = state_dir or f"{shared_dir(spark)}/cart_state"
    reader = spark.readStream.schema(EVENTS_SCHEMA)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    stream = reader.parquet(source_dir)
    events = cart_events(stream, products)
    writer = (events.writeStream
              .foreachBatch(lambda df, bid: _refold(spark, df, bid, products, state_dir, buckets))
              .option("checkpointLocation", f"{state_dir}/_checkpoint"))
    if available_now:
        writer = writer.trigger(availableNow=True)
    elif processing_time:
        writer = writer.trigger(processingTime=processing_time)
    return writer.start(), state_dir


def read_state(spark: SparkSession, state_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{state_dir}/{name}").drop("cust_bucket")
