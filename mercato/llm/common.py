"""Helpers shared by the operators of this subpackage: tables, shared scratch tables, and shipping
the package to executors."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession

from mercato.session import configure, shared_dir

_SHIPPED: set[str] = set()
# Rows of an Arrow batch between the JVM and Python workers: texts are long, and a batch is held
# several times over on its way.
BATCH_ROWS = 1_000


def prepare(spark: SparkSession) -> SparkSession:
    """Set the runtime options and make this package importable in Python workers, wherever the
    driver was started."""
    configure(spark)
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(rows)) > BATCH_ROWS:
        spark.conf.set(rows, str(BATCH_ROWS))
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        path = os.path.join(tempfile.mkdtemp(), "mercato_package.zip")
        with zipfile.ZipFile(path, "w") as z:
            for folder, _, names in os.walk(root):
                for name in names:
                    if name.endswith(".py"):
                        full = os.path.join(folder, name)
                        z.write(full, os.path.relpath(full, os.path.dirname(root)))
        spark.sparkContext.addPyFile(path)
        _SHIPPED.add(app)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder for intermediate results in the shared folder (``spark.checkpoint.dir``)."""
    app = spark.sparkContext.applicationId
    return f"{shared_dir(spark)}/llm-scratch/{app}/{name}-{uuid.uuid4().hex[:12]}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back: lineage is cut, and any
    executor can read the result again after another one is lost."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Remove a folder of the shared storage."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def drop_scratch(spark: SparkSession) -> None:
    """Remove the intermediate tables of this application (call it once their results are
    written)."""
    drop_path(spark, f"{shared_dir(spark)}/llm-scratch/{spark.sparkContext.applicationId}")


def file_system(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """File system and path of a folder in the shared storage, for tasks that write files of
    their own format."""
    if "://" not in path and not path.startswith("file:"):
        return pyarrow.fs.LocalFileSystem(), path
    if path.startswith("file:"):
        return pyarrow.fs.LocalFileSystem(), "/" + path[len("file:"):].lstrip("/")
    return pyarrow.fs.FileSystem.from_uri(path)


def write_file(path: str, data: bytes) -> None:
    """Write a file under a temporary name and move it into place, so that a repeated task
    replaces its file whole."""
    fs, name = file_system(path)
    fs.create_dir(os.path.dirname(name), recursive=True)
    draft = f"{name}.{uuid.uuid4().hex[:8]}.tmp"
    with fs.open_output_stream(draft) as out:
        out.write(data)
    fs.move(draft, name)


def read_file(path: str) -> bytes:
    fs, name = file_system(path)
    with fs.open_input_file(name) as f:
        return f.read()


def release_memory() -> None:
    """Give freed memory back to the system: Python workers are kept between stages, and what the
    allocators of one stage hold on to is missing for the next."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def lean(work: Callable) -> Callable:
    """The batch function ``work``, releasing memory when a task is through."""
    def run(batches: Iterator) -> Iterator:
        try:
            yield from work(batches)
        finally:
            release_memory()
    return run


def by_bytes(texts: list, limit: int = 4_000_000) -> Iterator[slice]:
    """Slices of a batch that hold about ``limit`` characters each, so that array work on long
    texts stays in bounded memory."""
    start = total = 0
    for i, t in enumerate(texts):
        total += len(t) if t is not None else 0
        if total >= limit:
            yield slice(start, i + 1)
            start, total = i + 1, 0
    if start < len(texts):
        yield slice(start, len(texts))


def stream_blocks(batches: Iterator[pd.DataFrame], key: list[str], asking: str,
                  build: Callable, chunk: int) -> Iterator[pd.DataFrame]:
    """Go through rows sorted by ``key`` and then by ``asking``: the rows of a key with asking 0
    make up a block (``build(rows)``), which must fit in memory, and those with asking 1 are then
    handed to ``block.ask(rows)`` at most ``chunk`` at a time, however many there are. Yields
    every block's ``results()``."""
    current, residents, visitors, block = None, [], [], None

    def settle(last: bool):
        nonlocal residents, visitors, block
        if block is None and residents:
            block, residents = build(pd.concat(residents)), []
        if block is not None and visitors and (last or sum(map(len, visitors)) >= chunk):
            rows = pd.concat(visitors)
            for i in range(0, len(rows), chunk):
                block.ask(rows.iloc[i:i + chunk])
            visitors = []

    for batch in batches:
        for found, rows in batch.groupby(key, sort=True, dropna=False):
            if found != current:
                settle(last=True)
                if block is not None:
                    yield block.results()
                current, residents, visitors, block = found, [], [], None
            asks = rows[asking] == 1
            if not asks.all():
                residents.append(rows[~asks])
            if asks.any():
                visitors.append(rows[asks])
                settle(last=False)
    settle(last=True)
    if block is not None:
        yield block.results()
