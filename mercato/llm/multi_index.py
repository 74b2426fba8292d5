"""Near-duplicate vectors by an inverted multi-index.

Unit vectors are cut into halves with a codebook each; the two code numbers name a cell of a
product grid. Every vector lies in the cell of its nearest codewords and asks the cells that can
hold a partner, found by multi-sequence traversal: both halves' codewords are ordered by a lower
bound of the distance to anything in their region, and pairs of them are visited by growing sum
until the sum passes the squared distance that the cosine allows times ``recall_radius``. At
radius 1 (the default) no partner can lie beyond, so the target recall is 1; a smaller radius
visits fewer cells and trades recall. The pairs found are verified in double precision.

Copies of one vector form a class and are compared once. Cells are cut into blocks of bounded
size, which a task holds while it streams through the vectors that ask it; it hands on counts of
links and a spanning forest of them, never the pairs, and components come from the forest.

Rows: vectors that are null, zero or hold null or non-finite components, and rows with a null
label, link with nothing: n_links 0 and a component of their own. Rows that repeat a ``vec_id``
are one node: their links add up and they share a component. Rows with a null ``vec_id`` link
with nothing; their component is null and they are kept. Vectors of different lengths are never
linked. An empty table gives no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mercato.llm.common import materialise, prepare, stream_blocks
from mercato.llm.components import connected_components
from mercato.llm.vectors import cosine, matrix, unit, usable_vectors


def train_codebook(x: np.ndarray, size: int, rounds: int = 12) -> np.ndarray:
    """k-means codewords of the rows of x, started from rows far from each other."""
    picked = [0]
    away = ((x - x[0]) ** 2).sum(axis=1)
    while len(picked) < size and away.max() > 1e-12:
        picked.append(int(away.argmax()))
        away = np.minimum(away, ((x - x[picked[-1]]) ** 2).sum(axis=1))
    words = x[picked].copy()
    for _ in range(rounds):
        near = _squared(x, words).argmin(axis=1)
        for c in np.unique(near):
            words[c] = x[near == c].mean(axis=0)
    return words


def _squared(x: np.ndarray, words: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(axis=1)[:, None] - 2 * x @ words.T
                      + (words * words).sum(axis=1), 0)


class Codebook:
    def __init__(self, words: np.ndarray):
        self.words = words
        self.gaps = np.sqrt(_squared(words, words))

    def bounds(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(code of each row, squared lower bound of its distance to every codeword's region).

        A point of codeword c's region is at least as near to c as to the row's own codeword a,
        so it lies beyond their bisecting plane."""
        far = _squared(x, self.words)
        code = far.argmin(axis=1)
        own = far[np.arange(len(x)), code]
        gap = self.gaps[code]
        plane = np.where(gap > 0, (far - own[:, None]) / np.where(gap > 0, 2 * gap, 1), 0)
        return code, np.maximum(plane - 1e-9, 0) ** 2


def traverse(first: np.ndarray, second: np.ndarray, limit: float) -> list[tuple[int, int]]:
    """Cells (i, j) by growing first[i] + second[j] while the sum is at most ``limit``."""
    one, two = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    out, heap = [], [(first[one[0]] + second[two[0]], 0, 0)]
    while heap:
        total, a, b = heapq.heappop(heap)
        if total > limit:
            break
        out.append((int(one[a]), int(two[b])))
        if b + 1 < len(two):
            heapq.heappush(heap, (first[one[a]] + second[two[b + 1]], a, b + 1))
        if b == 0 and a + 1 < len(one):
            heapq.heappush(heap, (first[one[a + 1]] + second[two[0]], a + 1, 0))
    return out


def train_index(vectors: DataFrame, codes: int, sample_rows: int) -> dict[int, tuple]:
    """Codebooks of both halves for every vector length of a sample of at most ``sample_rows``
    vectors (chosen by a hash of their id). Lengths outside the sample have a single cell."""
    sample = (vectors.withColumn("lot", F.xxhash64("vec_id")).orderBy("lot", "vec_id")
              .limit(sample_rows).select("dims", "embedding").toPandas())
    books = {}
    for dims, rows in sample.groupby("dims"):
        if dims >= 2:
            u = unit(matrix(rows["embedding"]))
            books[int(dims)] = tuple(Codebook(train_codebook(half, codes))
                                     for half in (u[:, :dims // 2], u[:, dims // 2:]))
    return books


class _Forest:
    """Union-find over vec_ids."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        self.up.setdefault(x, x)
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> None:
        x, y = self.find(x), self.find(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)


class _Block:
    """Residents of one block of a cell, and what asking vectors found in it."""

    def __init__(self, rows: pd.DataFrame, threshold: float):
        self.ids = rows["vec_id"].to_numpy()
        self.copies = rows["copies"].to_numpy()
        self.vectors = matrix(rows["embedding"])
        self.units = unit(self.vectors)
        self.threshold = threshold
        self.links = np.zeros(len(rows), dtype=np.int64)
        self.forest = _Forest()
        self.asked: list[pd.DataFrame] = []
        inside = np.triu(self._linked(self.vectors, self.units), k=1)
        inside |= inside.T
        self.links += inside @ self.copies
        self._join(self.ids, inside)

    def _linked(self, vectors: np.ndarray, units: np.ndarray) -> np.ndarray:
        close = units @ self.units.T
        linked = close >= self.threshold
        near = np.abs(close - self.threshold) < 1e-9       # rounding decides: the exact formula
        if near.any():
            x, y = np.nonzero(near)
            linked[x, y] = cosine(vectors[x], self.vectors[y]) >= self.threshold
        return linked

    def _join(self, ids: np.ndarray, linked: np.ndarray) -> None:
        has = linked.any(axis=1)
        for i in np.flatnonzero(has):
            mine = self.ids[linked[i]]
            for other in mine.tolist():
                self.forest.join(int(ids[i]), other)

    def ask(self, rows: pd.DataFrame) -> None:
        vectors = matrix(rows["embedding"])
        linked = self._linked(vectors, unit(vectors))
        hit = linked.any(axis=1)
        if hit.any():
            copies = rows["copies"].to_numpy()
            self.links += copies @ linked
            self._join(rows["vec_id"].to_numpy(), linked)
            self.asked.append(pd.DataFrame({"vec_id": rows["vec_id"].to_numpy()[hit],
                                            "n": (linked @ self.copies)[hit]}))

    def results(self) -> pd.DataFrame:
        own = pd.DataFrame({"vec_id": self.ids, "n": self.links})
        out = pd.concat([own[own["n"] > 0], *self.asked])
        out["root"] = [self.forest.find(int(v)) for v in out["vec_id"]]
        return out


def near_duplicate_vectors(rows: DataFrame, *, threshold: float = 0.98, codes: int = 8,
                           sample_rows: int = 4096, recall_radius: float = 1.0,
                           block: int = 1024) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row: links join vectors of one label with
    cosine >= ``threshold``."""
    prepare(rows.sparkSession)
    own = usable_vectors(rows, "label").filter("label IS NOT NULL") \
        .withColumn("dims", F.size("embedding"))
    # -0.0 and 0.0 are one value for grouping, so a class is a set of equal vectors
    classes = materialise(own.groupBy("label", "dims", "embedding").agg(
        F.min("vec_id").alias("vec_id"), F.count("*").alias("copies")), "classes")
    books = rows.sparkSession.sparkContext.broadcast(     # 2 * codes words per length
        train_index(classes, codes, sample_rows))
    limit = (2 - 2 * threshold + 1e-9) * recall_radius

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for dims, part in batch.groupby("dims"):
                book = books.value.get(int(dims))
                cell = np.zeros(len(part), dtype=np.int64)
                asks = [np.empty(0, dtype=np.int64)] * len(part)
                if book is not None:
                    u = unit(matrix(part["embedding"]))
                    halves = (u[:, :dims // 2], u[:, dims // 2:])
                    (one, far1), (two, far2) = (b.bounds(h) for b, h in zip(book, halves))
                    width = len(book[1].words)
                    cell = one * width + two
                    # a pair meets once: the vector of the smaller cell asks the larger one
                    asks = [np.array([c for i, j in traverse(far1[x], far2[x], limit)
                                      if (c := i * width + j) > cell[x]], dtype=np.int64)
                            for x in range(len(part))]
                yield part.assign(cell=cell, asks=asks)

    placed = materialise(classes.mapInPandas(
        place, T.StructType([*classes.schema.fields, T.StructField("cell", T.LongType()),
                             T.StructField("asks", T.ArrayType(T.LongType()))])), "placed")
    home = ["label", "dims", "cell"]
    cells = placed.groupBy(*home).count().withColumn("blocks", F.ceil(F.col("count") / block)) \
        .drop("count")
    vector = ["vec_id", "copies", "embedding"]
    residents = (placed.join(cells, home)
                 .withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(5)), F.col("blocks"))))
    # residents ask the later blocks of their own cell, and all blocks of the other cells
    own_cell = residents.filter("block + 1 < blocks") \
        .withColumn("block", F.explode(F.sequence(F.col("block") + 1, F.col("blocks") - 1)))
    others = (placed.withColumn("cell", F.explode("asks")).join(cells, home)
              .withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))))
    key = [*home, "block"]
    meeting = (residents.select(*key, *vector, F.lit(0).alias("asking"))
               .unionByName(own_cell.select(*key, *vector, F.lit(1).alias("asking")))
               .unionByName(others.select(*key, *vector, F.lit(1).alias("asking")))
               .repartition(*key).sortWithinPartitions(*key, "asking"))

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return stream_blocks(batches, key, "asking", lambda rows: _Block(rows, threshold), 4096)

    found = materialise(meeting.mapInPandas(verify, "vec_id long, n long, root long"), "links")
    by_class = found.groupBy(F.col("vec_id").alias("class_id")).agg(F.sum("n").alias("n"))
    members = (own.select("vec_id", "label", "dims", "embedding")
               .join(classes.withColumnRenamed("vec_id", "class_id"), ["label", "dims", "embedding"])
               .select("vec_id", "class_id", "copies"))
    members = materialise(members, "members")
    links = (members.join(by_class, "class_id", "left")
             .groupBy("vec_id").agg(F.sum(F.coalesce("n", F.lit(0)) + F.col("copies") - 1)
                                    .alias("n_links")))
    ties = found.select(F.col("vec_id").alias("a"), F.col("root").alias("b")).unionByName(
        members.select(F.col("vec_id").alias("a"), F.col("class_id").alias("b")))
    component = connected_components(ties).select(F.col("node").alias("vec_id"), "component")
    return (rows.select(F.col("vec_id").cast("long").alias("vec_id"))
            .join(links, "vec_id", "left").join(component, "vec_id", "left")
            .withColumn("component_id", F.coalesce("component", "vec_id"))
            .select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), "component_id",
                    F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)).alias("kept")))
