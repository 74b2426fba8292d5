"""Best-fit-decreasing packing of token sequences.

Every document is encoded, gets its end id and is cut only if it is longer than a sequence. The
pieces are dealt at random (by a hash of their place in the input, so that copies of one text
spread) into groups of bounded size, and each group is packed on
its own by best-fit decreasing: pieces go longest first into the open bin with the least room
that still takes them, found in logarithmic time with a segment tree over the remaining
capacities. Only lengths take part in the packing, so a group holds a few bytes per piece.

Rows: a null text counts as empty (its only id is the end id). Every row is a document of its
own, also when it repeats a ``doc_id``; rows with a null ``doc_id`` are packed too. An empty
table gives no rows.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mercato.llm.common import lean, materialise, prepare
from mercato.llm.tokens import WORD_BPE, encoder

GROUP_BITS = 36


class CapacityTree:
    """Open bins by remaining capacity 0..size: a segment tree of counts over the capacities,
    with a stack of bins at every leaf."""

    def __init__(self, size: int):
        self.width = 1 << size.bit_length()
        self.counts = [0] * (2 * self.width)
        self.bins: list[list[int]] = [[] for _ in range(size + 1)]

    def push(self, capacity: int, bin_no: int) -> None:
        self.bins[capacity].append(bin_no)
        self._add(capacity, 1)

    def pop_tightest(self, need: int) -> tuple[int, int] | None:
        """Remove and return (capacity, bin) of the fullest bin with room for ``need``."""
        counts = self.counts
        node = need + self.width
        while not counts[node]:                 # climb until a subtree to the right has a bin
            while node & 1:
                node >>= 1
            if node == 0:
                return None
            node += 1
        while node < self.width:                # then go down to its leftmost bin
            node <<= 1
            if not counts[node]:
                node += 1
        capacity = node - self.width
        self._add(capacity, -1)
        return capacity, self.bins[capacity].pop()

    def _add(self, capacity: int, change: int) -> None:
        node = capacity + self.width
        while node:
            self.counts[node] += change
            node >>= 1


def best_fit_decreasing(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset in it) of every length; no bin holds more than ``size``."""
    tree = CapacityTree(size)
    bins = np.empty(len(lengths), dtype=np.int64)
    offsets = np.empty(len(lengths), dtype=np.int64)
    opened = 0
    order = np.argsort(-lengths, kind="stable")
    for i, need in zip(order.tolist(), lengths[order].tolist()):
        found = tree.pop_tightest(need)
        if found is None:
            found, opened = (size, opened), opened + 1
        room, bin_no = found
        bins[i], offsets[i] = bin_no, size - room
        tree.push(room - need, bin_no)
    return bins, offsets


def token_pieces(docs: DataFrame, *, size: int, end_id: int, tokenizer: str,
                 with_ids: bool) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, deal (a hash that deals pieces into groups) and,
    if asked for, the piece's ids (binary, little-endian unsigned 32-bit)."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, deal long"
    if with_ids:
        schema += ", ids binary"

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, end = encoder(tokenizer).encode, struct.pack("<I", end_id)
        for batch in batches:
            rows = []
            for doc_id, deal, text in zip(batch["doc_id"], batch["deal"], batch["text"]):
                ids = encode(text) + end
                for piece, at in enumerate(range(0, len(ids), 4 * size)):
                    part = ids[at:at + 4 * size]
                    row = (doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part),
                           (deal + piece * 0x9E3779B97F4A7C1) & 0x7FFFFFFFFFFFFFFF)
                    rows.append(row + (part,) if with_ids else row)
            out = pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out

    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                        F.coalesce(F.col("text"), F.lit("")).alias("text"))
            .withColumn("deal", F.xxhash64(F.monotonically_increasing_id())
                        .bitwiseAND(F.lit((1 << 62) - 1)))
            .mapInPandas(lean(cut), schema))


def pack_documents(docs: DataFrame, *, size: int = 4096, end_id: int = 1,
                   tokenizer: str = WORD_BPE, group_pieces: int = 65_536,
                   with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, [ids,] sequence_id, offset.

    Only pieces shorter than a sequence are packed; a full piece is a sequence by itself. Groups
    hold about ``group_pieces`` short pieces, whatever the table's size, so a group wastes at
    most its last bins and no task grows with the input.
    """
    spark = prepare(docs.sparkSession)
    pieces = materialise(token_pieces(docs, size=size, end_id=end_id, tokenizer=tokenizer,
                                      with_ids=with_ids), "pieces")
    full = F.col("length") == size
    n_groups = max(1, -(-pieces.filter(~full).count() // group_pieces))
    dealt = pieces.withColumn("group_no", F.pmod(F.col("deal"), F.lit(n_groups)))
    # sequence ids: a full piece takes its place in its partition, below 0; groups count up from 0
    whole = (dealt.filter(full)
             .withColumn("sequence_id", -1 - F.monotonically_increasing_id())
             .withColumn("offset", F.lit(0).cast("long")))
    schema = dealt.schema.add("sequence_id", "long").add("offset", "long")

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        bins, offsets = best_fit_decreasing(group["length"].to_numpy(), size)
        return group.assign(
            sequence_id=(group["group_no"].to_numpy() << GROUP_BITS) + bins, offset=offsets)

    packed = dealt.filter(~full).groupBy("group_no").applyInPandas(pack, schema)
    return packed.unionByName(whole).drop("deal", "group_no")
