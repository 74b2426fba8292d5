"""Removal of lines that many documents share.

A line's key is the line without white space at its ends and with A-Z lower-cased. Every task
counts the keys of its documents (once per document) and the counts are added up by key. Keys
found in enough documents go into a sharded minimal perfect hash with arrays of fingerprints,
counts and last documents, written to the shared folder. Documents then probe these arrays where
they are: a task gathers the distinct hashes of its documents (of up to 32 MB of text at a time),
looks them up shard by shard, each shard read once, and drops lines by what it found. Lines are
never joined or shuffled with their text.

Rows: a null or empty text has one empty line. Every row is a document of its own. A null
``doc_id`` sorts before all others. An empty table stays empty. Columns of the input keep their
values, but for ``text`` and ``n_chars`` (if there) and for input columns named like an added one
(``n_lines``, ``n_dropped``), which are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mercato.llm.common import (by_bytes, lean, materialise, prepare, read_file, scratch_path,
                                write_file)
from mercato.llm.perfect_hash import Shard

WHITE = b" \t\n\x0b\x0c\r"
PROBE_BYTES = 32_000_000        # text whose lines are looked up together
NO_ID = -(1 << 63)


def line_digest(line: bytes, min_chars: int) -> bytes | None:
    """128-bit hash of a line's key, or None for a key of fewer than ``min_chars`` characters."""
    key = line.strip(WHITE).lower()
    if len(key) < min_chars:
        return None
    if len(key) < 4 * min_chars and not key.isascii() \
            and len(key.decode("utf-8", "replace")) < min_chars:
        return None
    return xxhash.xxh3_128_digest(key)


def _texts(batch: pa.RecordBatch) -> list[bytes]:
    return [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]


def _ids(batch: pa.RecordBatch) -> np.ndarray:
    return np.array([NO_ID if d is None else d for d in batch.column("doc_id").to_pylist()],
                    dtype=np.int64)


def count_keys(docs: DataFrame, min_chars: int) -> DataFrame:
    """key, fingerprint (the two halves of the hash), n (documents), last (largest doc_id)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, ids = _texts(batch), _ids(batch)
            for part in by_bytes(texts):
                digests, docs_of = [], []
                for text, doc in zip(texts[part], ids[part].tolist()):
                    own = {line_digest(x, min_chars) for x in text.split(b"\n")}
                    own.discard(None)
                    digests.extend(own)
                    docs_of.append(np.full(len(own), doc, dtype=np.int64))
                if not digests:
                    continue
                halves = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
                last = np.concatenate(docs_of)
                order = np.lexsort((last, halves[:, 1], halves[:, 0]))
                halves, last = halves[order], last[order]
                start = np.ones(len(order), dtype=bool)
                start[1:] = (halves[1:] != halves[:-1]).any(axis=1)
                at = np.flatnonzero(start)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(halves[at, 0]), pa.array(halves[at, 1]),
                     pa.array(np.diff(at, append=len(order))),
                     pa.array(last[np.append(at[1:], len(order)) - 1])],
                    names=["key", "fingerprint", "n", "last"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                      F.col("text").cast("string").alias("text"))
    partial = own.mapInArrow(lean(count), "key long, fingerprint long, n long, last long")
    return partial.groupBy("key", "fingerprint").agg(F.sum("n").alias("n"),
                                                     F.max("last").alias("last"))


def build_shards(keys: DataFrame, path: str, shard_keys: int) -> int:
    """Write the shards of ``keys`` under ``path``; returns their number."""
    n_shards = -(-keys.count() // shard_keys)

    def build(group: pd.DataFrame) -> pd.DataFrame:
        shard = int(group["shard"].iloc[0])
        made = Shard.build(group["key"].to_numpy(), group["fingerprint"].to_numpy(),
                           group["n"].to_numpy(), group["last"].to_numpy())
        write_file(f"{path}/shard-{shard}.npz", made.to_bytes())
        return pd.DataFrame({"shard": [shard], "n": [len(group)]})

    if n_shards:
        (keys.withColumn("shard", F.pmod("key", F.lit(n_shards)))
         .groupBy("shard").applyInPandas(build, "shard long, n long").agg(F.sum("n")).collect())
    return n_shards


def look_up(path: str, n_shards: int, digests: np.ndarray, min_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Of ``digests`` (rows of key and fingerprint, any number of times), those that the shards
    hold, sorted by key, and the last document of each. A shard is read once, and only if it can
    hold one."""
    rows = digests[np.lexsort((digests[:, 1], digests[:, 0]))]
    first = np.ones(len(rows), dtype=bool)
    first[1:] = (rows[1:] != rows[:-1]).any(axis=1)
    wanted = rows[first]
    shard = np.mod(wanted[:, 0], n_shards)
    order = np.argsort(shard, kind="stable")
    held, last = np.zeros(len(wanted), dtype=bool), np.zeros(len(wanted), dtype=np.int64)
    for at in np.split(order, np.flatnonzero(np.diff(shard[order])) + 1):
        if len(at):
            arrays = Shard.from_bytes(read_file(f"{path}/shard-{int(shard[at[0]])}.npz"))
            count, last[at] = arrays.find(wanted[at, 0], wanted[at, 1])
            held[at] = count >= min_docs
    return wanted[held], last[held]


def dedup_lines(docs: DataFrame, *, min_chars: int = 20, min_docs: int = 3,
                shard_keys: int = 1 << 20) -> DataFrame:
    """Documents without the lines whose key (of ``min_chars`` characters or more) is in
    ``min_docs`` documents or more; the largest ``doc_id`` that holds such a key keeps its lines.
    Adds n_lines (before) and n_dropped."""
    spark = prepare(docs.sparkSession)
    keys = materialise(count_keys(docs, min_chars).filter(F.col("n") >= min_docs), "line-keys")
    path = scratch_path(spark, "line-shards")
    n_shards = build_shards(keys, path, shard_keys)
    added = [T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())]
    fields = [f for f in docs.schema.fields if f.name not in ("n_lines", "n_dropped")]
    schema = T.StructType([T.StructField(f.name, T.StringType()) if f.name == "text"
                           else T.StructField(f.name, T.LongType()) if f.name in ("doc_id", "n_chars")
                           else f for f in fields] + added)

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, digests, size = [], [], 0

        def settle() -> Iterator[pa.RecordBatch]:
            found = look_up(path, n_shards, np.concatenate(digests), min_docs) if digests else None
            for part in waiting:
                yield _drop(part, _texts(part), _ids(part), found)

        for batch in batches:
            texts = _texts(batch)
            for part in by_bytes(texts, 8_000_000):
                waiting.append(batch.slice(part.start, part.stop - part.start))
                size += sum(map(len, texts[part]))
                own = {line_digest(x, min_chars) for t in texts[part] for x in t.split(b"\n")} \
                    if n_shards else set()
                own.discard(None)
                if own:
                    digests.append(np.frombuffer(b"".join(own), "<i8").reshape(-1, 2))
                if size >= PROBE_BYTES:
                    yield from settle()
                    waiting, digests, size = [], [], 0
        yield from settle()

    def _drop(batch, texts, ids, found) -> pa.RecordBatch:
        lines = [t.split(b"\n") for t in texts]
        dropped: list[set[int]] = [set() for _ in texts]
        doc_at, line_at, digests = [], [], []
        for i, own in enumerate(lines if found is not None and len(found[0]) else []):
            for j, line in enumerate(own):
                digest = line_digest(line, min_chars)
                if digest is not None:
                    doc_at.append(i)
                    line_at.append(j)
                    digests.append(digest)
        if digests:
            shared, last = found
            asked = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            doc_at, line_at = np.array(doc_at), np.array(line_at)
            at = np.minimum(np.searchsorted(shared[:, 0], asked[:, 0]), len(shared) - 1)
            out = (shared[at] == asked).all(axis=1) & (last[at] != ids[doc_at])
            for i, j in zip(doc_at[out].tolist(), line_at[out].tolist()):
                dropped[i].add(j)
        kept = [b"\n".join(x for j, x in enumerate(own) if j not in gone) if gone else text
                for own, gone, text in zip(lines, dropped, texts)]
        new = {"text": pa.array(kept, pa.binary()).cast(pa.string()),
               "n_lines": pa.array([len(x) for x in lines], pa.int64()),
               "n_dropped": pa.array([len(x) for x in dropped], pa.int64())}
        new["n_chars"] = pa.array([len(t) for t in new["text"].to_pylist()], pa.int64())
        return pa.RecordBatch.from_arrays(
            [new[f.name] if f.name in new else batch.column(f.name) for f in schema.fields],
            names=schema.names)

    source = docs.drop("n_lines", "n_dropped").withColumns(
        {"doc_id": F.col("doc_id").cast("long"), "text": F.col("text").cast("string")})
    return source.mapInArrow(lean(drop), schema)
