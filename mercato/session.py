"""Session settings shared by tests, the bench and the query entry points."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Runtime SQL settings every job here relies on. They are safe to set on an existing
# session (no static confs): UTC so that TIMESTAMP_NTZ -> TIMESTAMP casts are stable,
# AQE so joins re-plan on runtime sizes, coalesce small shuffle partitions and split
# skewed join partitions (one hot customer / order must not land in one task).
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.localShuffleReader.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    for key, value in RUNTIME_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


# Source bytes (Parquet) behind one shuffle partition: about a million order lines.
BYTES_PER_PARTITION = 16 * 1024 * 1024
INITIAL_PARTITIONS = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"


def partition_count(spark: SparkSession) -> int:
    """Partitions that a shuffle starts with, before AQE joins small ones."""
    return int(spark.conf.get(INITIAL_PARTITIONS, None) or spark.conf.get("spark.sql.shuffle.partitions"))


def fit_partitions(spark: SparkSession, source_bytes: int) -> None:
    """Let shuffles start with as many partitions as the source's size asks for, so that the rows
    of a task do not grow with the data; AQE joins the small ones of narrow shuffles again."""
    needed = -(-int(source_bytes) // BYTES_PER_PARTITION)
    if needed > partition_count(spark):
        spark.conf.set(INITIAL_PARTITIONS, str(needed))


def build_session(master: str = "local[8]", shuffle_partitions: int = 8,
                  app_name: str = "mercato", extra: dict | None = None) -> SparkSession:
    """Local session for tests and the bench. On a cluster the submitter builds the session;
    only ``configure`` is applied there."""
    builder = (
        SparkSession.builder.master(master)
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", "16g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in RUNTIME_CONF.items():
        builder = builder.config(key, value)
    for key, value in (extra or {}).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster this is set by whoever runs the cluster and must be shared storage; it is
    read from the session and used as is. Only when it is unset (local tests) a fresh
    scratch folder is taken.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir", None)
    if not current:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        current = tempfile.mkdtemp(prefix="mercato-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(current)
    return sc.getCheckpointDir() or current


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir`` (not the per-application subfolder
    Spark creates inside it), so staged data can be found again by later sessions."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    return (base or ensure_checkpoint_dir(spark)).rstrip("/")


SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Writes in here drop their shuffle files when they end. Nothing reads them again, and left to
    the garbage collection of the driver they would fill the executors' disks write by write."""
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(SHUFFLE_CLEANUP) if before is None else spark.conf.set(SHUFFLE_CLEANUP, before)


def kept(df: DataFrame) -> DataFrame:
    """``df`` computed once and cut from its lineage, like a reliable checkpoint, as Parquet files
    in the shared folder: a fraction of a checkpoint's bytes, and readers take the columns they need."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/mercato-kept/{spark.sparkContext.applicationId}-{uuid.uuid4().hex[:12]}"
    with shuffles_freed(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
