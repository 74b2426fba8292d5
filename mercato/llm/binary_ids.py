"""Token ids in a binary format of compressed bit or byte planes.

A file holds the ids of a run of documents in ascending ``doc_id`` order. Ids are cut into
blocks of a fixed number of ids; each block is transposed into its four byte planes (or 32 bit
planes), every plane is compressed with zstandard on its own, and an index at the end of the
file gives the place of every chunk. Token ids use the low planes only, so the high planes
shrink to a few bytes.

Layout (little-endian)::

    "MTOK1\\0" + plane kind ("Y" byte, "I" bit) + "\\0"
    plane streams of all blocks
    document index: zstandard of (int64 doc_id, int64 n_tokens, uint8 has_id) columns
    chunk index: per block uint32 n_ids and per plane uint32 length
    footer: uint64 x 6 (document index offset and length, chunk index offset, blocks, documents, ids)

Rows: a null text counts as empty (it has the end id only). Rows with a null ``doc_id`` come
first. Rows that repeat a ``doc_id`` are separate documents, next to each other, ordered by a
hash of their text. An empty table writes no file.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mercato.llm.common import materialise, prepare, read_file, scratch_path, write_file
from mercato.llm.tokens import WORD_BPE, encoder

MAGIC = b"MTOK1\0"
FOOTER = struct.Struct("<6Q")


def to_planes(ids: np.ndarray, bits: bool) -> list[bytes]:
    """The byte planes (4) or bit planes (32) of a block of uint32 ids."""
    octets = np.ascontiguousarray(ids, dtype="<u4").view(np.uint8).reshape(-1, 4)
    if not bits:
        return [octets[:, p].tobytes() for p in range(4)]
    planes = np.unpackbits(octets, axis=1, bitorder="little")
    return [np.packbits(planes[:, p], bitorder="little").tobytes() for p in range(32)]


def from_planes(planes: list[bytes], n: int, bits: bool) -> np.ndarray:
    if not bits:
        octets = np.stack([np.frombuffer(p, np.uint8, n) for p in planes], axis=1)
    else:
        bit = np.stack([np.unpackbits(np.frombuffer(p, np.uint8), count=n, bitorder="little")
                        for p in planes], axis=1)
        octets = np.packbits(bit, axis=1, bitorder="little")
    return np.ascontiguousarray(octets).view("<u4").reshape(-1)


class FileWriter:
    """Builds one file in memory, block by block; only the compressed planes are kept."""

    def __init__(self, block: int, bits: bool, level: int = 3):
        self.block, self.bits = block, bits
        self.compress = zstandard.ZstdCompressor(level=level).compress
        self.body = bytearray(MAGIC + (b"I" if bits else b"Y") + b"\0")
        self.chunks: list[tuple[int, list[int]]] = []
        self.pending: list[bytes] = []
        self.pending_ids = self.n_ids = 0
        self.docs: list[tuple[int | None, int]] = []

    def add(self, doc_id: int | None, packed: bytes) -> None:
        self.docs.append((doc_id, len(packed) // 4))
        self.pending.append(packed)
        self.pending_ids += len(packed) // 4
        self.n_ids += len(packed) // 4
        if self.pending_ids >= self.block:
            self._flush(self.pending_ids - self.pending_ids % self.block)

    def _flush(self, n: int) -> None:
        ids = np.frombuffer(b"".join(self.pending), "<u4")
        for start in range(0, n, self.block):
            part = ids[start:min(start + self.block, n)]
            planes = [self.compress(p) for p in to_planes(part, self.bits)]
            self.chunks.append((len(part), [len(p) for p in planes]))
            self.body += b"".join(planes)
        self.pending, self.pending_ids = [ids[n:].tobytes()], len(ids) - n

    def close(self) -> bytes:
        self._flush(self.pending_ids)
        n = len(self.docs)
        index = (np.array([d or 0 for d, _ in self.docs], "<i8").tobytes()
                 + np.array([k for _, k in self.docs], "<i8").tobytes()
                 + np.array([d is not None for d, _ in self.docs], np.uint8).tobytes())
        index = self.compress(index)
        docs_at = len(self.body)
        chunks_at = docs_at + len(index)
        chunk_index = b"".join(struct.pack(f"<{1 + len(p)}I", k, *p) for k, p in self.chunks)
        return bytes(self.body) + index + chunk_index + FOOTER.pack(
            docs_at, len(index), chunks_at, len(self.chunks), n, self.n_ids)


def read_documents(data: bytes) -> Iterator[tuple[int | None, int, np.ndarray]]:
    """(doc_id, number of ids before it in the file, its ids) of every document of a file."""
    if data[:len(MAGIC)] != MAGIC:
        raise ValueError("not a token file")
    bits = data[len(MAGIC):len(MAGIC) + 1] == b"I"
    docs_at, docs_len, chunks_at, n_chunks, n_docs, _ = FOOTER.unpack(data[-FOOTER.size:])
    expand = zstandard.ZstdDecompressor().decompress
    index = expand(data[docs_at:docs_at + docs_len])
    doc_ids = np.frombuffer(index, "<i8", n_docs)
    sizes = np.frombuffer(index, "<i8", n_docs, 8 * n_docs)
    has_id = np.frombuffer(index, np.uint8, n_docs, 16 * n_docs)
    entry = struct.Struct(f"<{33 if bits else 5}I")

    def blocks():
        at = len(MAGIC) + 2
        for c in range(n_chunks):
            n, *lengths = entry.unpack_from(data, chunks_at + c * entry.size)
            planes = []
            for length in lengths:
                planes.append(expand(data[at:at + length]))
                at += length
            yield from_planes(planes, n, bits)

    source, held, start = blocks(), np.empty(0, "<u4"), 0
    for doc_id, size, known in zip(doc_ids.tolist(), sizes.tolist(), has_id.tolist()):
        if len(held) < size:
            parts, have = [held], len(held)
            while have < size:
                parts.append(next(source))
                have += len(parts[-1])
            held = np.concatenate(parts)
        yield (doc_id if known else None), start, held[:size]
        held, start = held[size:], start + size


@dataclass
class TokenFiles:
    """A written set: ``files`` has one row per file (file_no, path, n_docs, n_ids, start)."""

    path: str
    files: DataFrame


def write_token_files(docs: DataFrame, path: str | None = None, *, tokenizer: str = WORD_BPE,
                      end_id: int = 2, block: int = 65_536, planes: str = "byte",
                      file_chars: int = 48_000_000) -> TokenFiles:
    """Encode every text and write its ids, in ascending ``doc_id`` order, as files of about
    ``file_chars`` characters each under ``path`` (a folder that all executors share).

    Documents are range-partitioned by ``doc_id`` as raw text, sorted, encoded and written by
    the task that holds them, so ids are never shuffled. A repeated task replaces its file.
    """
    spark = prepare(docs.sparkSession)
    path = path or scratch_path(spark, "tokens")
    bits = {"byte": False, "bit": True}[planes]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(F.col("text"), F.lit("")).alias("text"))
    total = rows.agg(F.sum(F.length("text") + 1)).first()[0] or 0
    n_files = int(-(-total // file_chars)) or 1
    ordered = (rows.withColumn("tie", F.xxhash64("text"))
               .repartitionByRange(n_files, "doc_id", "tie")
               .sortWithinPartitions("doc_id", "tie")
               .select(F.spark_partition_id().alias("file_no"), "doc_id", "text"))

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        writer, file_no = None, None
        encode, end = encoder(tokenizer).encode, struct.pack("<I", end_id)
        for batch in batches:
            for file_no, doc_id, text in zip(batch["file_no"], batch["doc_id"], batch["text"]):
                writer = writer or FileWriter(block, bits)
                writer.add(None if pd.isna(doc_id) else int(doc_id), encode(text) + end)
        if writer:
            name = f"{path}/ids-{int(file_no):06d}.mtok"
            write_file(name, writer.close())
            yield pd.DataFrame([(int(file_no), name, len(writer.docs), writer.n_ids)],
                               columns=["file_no", "path", "n_docs", "n_ids"])

    written = materialise(
        ordered.mapInPandas(write, "file_no long, path string, n_docs long, n_ids long"),
        "token-files")
    # one row per file: its place is the sum of the ids in the files before it
    before = Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1)
    files = written.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))
    return TokenFiles(path, files)


def read_token_files(spark: SparkSession, written: TokenFiles, *,
                     with_ids: bool = True) -> DataFrame:
    """Documents read back from the files: doc_id, start (ids of all documents before it),
    n_tokens, ids_crc32 and, unless ``with_ids`` is false, the ids."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if with_ids:
        schema += ", ids array<int>"

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, base in zip(batch["path"], batch["start"]):
                rows, held = [], 0
                for doc_id, start, ids in read_documents(read_file(name)):
                    row = (doc_id, int(base) + start, len(ids), zlib.crc32(ids.tobytes()))
                    rows.append(row + (ids.astype(np.int32),) if with_ids else row)
                    held += len(ids) if with_ids else 1
                    if held >= 1_000_000 or len(rows) >= 20_000:
                        yield _frame(rows, with_ids)
                        rows, held = [], 0
                if rows:
                    yield _frame(rows, with_ids)

    tasks = max(1, written.files.count())
    return (written.files.select("file_no", "path", "start").repartition(tasks, "file_no")
            .select("path", "start").mapInPandas(read, schema))


def _frame(rows: list[tuple], with_ids: bool) -> pd.DataFrame:
    columns = ["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids
    out = pd.DataFrame(rows, columns=columns)
    out["doc_id"] = out["doc_id"].astype("Int64")
    return out
