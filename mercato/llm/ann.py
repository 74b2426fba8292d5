"""Nearest neighbours by cosine with a block matrix join.

Candidates and queries are unit vectors quantised to int8 with a scale per vector. Candidate
blocks meet query blocks; an integer matrix product gives approximate cosines, and the lengths of
the quantisation errors bound how far each can be off. Only pairs that can still be among a
query's k nearest are computed again in double precision from the original vectors. Every task
keeps a heap of k results per query over all its candidate blocks, so it hands on k rows per
query, and the heaps are merged by query. The result is exact, so recall is 1.

Pairs are computed again in slices of bounded size, so many tied vectors cost time, not memory.

Rows: vectors that are null, zero, or hold null or non-finite components take no part, nor do
null ids. Vectors of different lengths are never compared. A candidate with the query's own id
is left out; repeated rows of another id are each a result of their own. Ties go to the smaller
vec_id. Rows of ``queries`` that share a vec_id are queries of their own until their results are
ranked: these are merged into one list of k for the id. A query gets fewer than k rows if there are fewer candidates. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mercato.llm.common import prepare, stream_blocks
from mercato.llm.vectors import cosine, matrix, unit, usable_vectors

SLICE = 4_000_000       # components of a slice of pairs that are computed again at once
EXACT_DIMS = 1024       # products of so many int8 pairs add up exactly in float32


class Quantised:
    """int8 rows with scale, and the lengths of the unit vectors' quantised part and error."""

    def __init__(self, x: np.ndarray):
        u = unit(x)
        self.scale = np.abs(u).max(axis=1) / 127
        self.codes = np.rint(u / self.scale[:, None]).astype(np.int8)
        near = self.codes * self.scale[:, None]
        self.length = np.sqrt((near * near).sum(axis=1))
        self.error = np.sqrt(((u - near) ** 2).sum(axis=1))


def approximate(q: Quantised, c: Quantised) -> tuple[np.ndarray, np.ndarray]:
    """(approximate cosines, bound of their error) of all rows of q with all rows of c."""
    dots = np.zeros((len(q.codes), len(c.codes)))
    for j in range(0, q.codes.shape[1], EXACT_DIMS):
        part = slice(j, j + EXACT_DIMS)
        dots += q.codes[:, part].astype(np.float32) @ c.codes[:, part].astype(np.float32).T
    dots *= q.scale[:, None]
    dots *= c.scale
    # |u.v - u'.v'| = |u'.(v - v') + (u - u').v| for unit vectors u, v with parts u', v'
    bound = q.length[:, None] * c.error + q.error[:, None] + 1e-9
    return dots, bound


class Heaps:
    """The k nearest candidates so far of every query of a block."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        self.ids, self.vectors, self.k = ids, vectors, k
        self.quantised = Quantised(vectors)
        self.best = np.full((len(ids), k), -np.inf)          # descending
        self.found = np.full((len(ids), k), np.iinfo(np.int64).max)

    def offer(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        close, bound = approximate(self.quantised, Quantised(vectors))
        close[self.ids[:, None] == ids] = -np.inf
        low = close - bound
        k = min(self.k, low.shape[1])
        floor = np.partition(low, low.shape[1] - k, axis=1)[:, low.shape[1] - k] \
            if k == self.k else np.full(len(self.ids), -np.inf)
        floor = np.maximum(floor, self.best[:, -1])
        at, who = np.nonzero((close + bound >= floor[:, None]) & np.isfinite(close))
        # pairs come sorted by query; a slice holds whole queries where it can
        step = max(1, SLICE // vectors.shape[1])
        for first in range(0, len(at), step):
            self._keep(at[first:first + step], ids[who[first:first + step]],
                       vectors[who[first:first + step]])

    def _keep(self, at: np.ndarray, ids: np.ndarray, vectors: np.ndarray) -> None:
        """Put exact scores of pairs, sorted by their query ``at``, into the heaps."""
        scores = cosine(self.vectors[at], vectors)
        starts = np.flatnonzero(np.append(True, at[1:] != at[:-1])) if len(at) else []
        for start, stop in zip(starts, [*starts[1:], len(at)]):
            i = at[start]
            score = np.concatenate([self.best[i], scores[start:stop]])
            found = np.concatenate([self.found[i], ids[start:stop]])
            order = np.lexsort((found, -score))[:self.k]
            self.best[i], self.found[i] = score[order], found[order]

    def ask(self, rows: pd.DataFrame) -> None:
        self.offer(rows["vec_id"].to_numpy(), matrix(rows["embedding"]))

    def results(self) -> pd.DataFrame:
        real = np.isfinite(self.best)
        return pd.DataFrame({"query_id": np.repeat(self.ids, self.k)[real.ravel()],
                             "vec_id": self.found[real], "score": self.best[real]})


def nearest(vectors: DataFrame, queries: DataFrame, *, k: int = 5, query_block: int = 1024,
            candidate_block: int = 4096, tiles: int | None = None) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the ``k`` nearest rows of ``vectors`` to every row
    of ``queries`` (both: vec_id, embedding)."""
    spark = prepare(vectors.sparkSession)
    dims = F.size("embedding").alias("dims")
    q, c = (usable_vectors(x).select("vec_id", "embedding", dims) for x in (queries, vectors))
    n_blocks = max(1, -(-q.count() // query_block))
    # a tile is a block of queries with one share of the candidates; its task streams through
    # the candidates, so memory holds one query block and one candidate block
    tiles = tiles or int(spark.conf.get("spark.sql.shuffle.partitions"))
    shares = max(1, -(-tiles // n_blocks))
    q = (q.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks)).cast("int"))
         .withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))
         .withColumn("asking", F.lit(0)))
    c = (c.withColumn("share", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(shares)).cast("int"))
         .withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
         .withColumn("asking", F.lit(1)))
    columns = ["block", "share", "dims", "asking", "vec_id", "embedding"]
    tile = ["block", "share", "dims"]
    dealt = (q.select(columns).unionByName(c.select(columns)).repartition(n_blocks * shares, *tile)
             .sortWithinPartitions(*tile, "asking"))

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return stream_blocks(batches, tile, "asking", lambda rows: Heaps(
            rows["vec_id"].to_numpy(), matrix(rows["embedding"]), k), candidate_block)

    found = dealt.mapInPandas(search, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return (found.withColumn("rank", rank).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
