"""Centroid clustering (operator 13): Lloyd's rounds with heap-ordered bounds, in whole numbers.

Vectors are rounded down to integers once and kept in blocks of 1,024. Each block holds, for every
cluster, a heap of its vectors ordered by the gap between the lower bound on the distance to the
second centroid and the upper bound on the distance to the own one. When centroids move, every gap
of a cluster shrinks by the same drift, so drift is accumulated per cluster and added to a gap when
it enters a heap instead of being subtracted from all of them: only the vectors at the top whose
gap has expired are popped, compared exactly with all centroids, and pushed into the heap of the
cluster that they belong to. All other vectors are not touched.

Distances, sums and means are exact integers; bounds are floating point with a margin, and a
vector is left in place only if it is strictly nearest to its centroid beyond that margin, so the
result equals plain rounds over all vectors. A task sums only the changes of its moved vectors;
Spark adds them up per cluster and component, and the driver keeps k centroids. Each round reads
one table of blocks from the shared folder and writes the next, without a shuffle of vectors.
"""

from __future__ import annotations

import hashlib
import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mercato.llm.common import drop_path, prepare, scratch_path

BLOCK = 1024
SCALE = 64
LARGE = 2.0 ** 20  # components from here on are computed with Python's integers
MARGIN = 1e-9
LIMB = 2 ** 40
LONGEST = 2 ** 63 - 1
_CHANGE = pa.struct([("cluster", pa.int32()), ("part", pa.int32()), ("limb", pa.int32()),
                     ("value", pa.int64())])
_STATE = {"ids": ("array<bigint>", pa.list_(pa.int64())),
          "kind": ("string", pa.string()),
          "vectors": ("binary", pa.binary()),
          "cluster": ("array<int>", pa.list_(pa.int32())),
          "gaps": ("binary", pa.binary()),
          "heaps": ("array<array<int>>", pa.list_(pa.list_(pa.int32()))),
          "rescanned": ("bigint", pa.int64()),
          "distances": ("array<bigint>", pa.list_(pa.int64())),
          "changes": ("array<struct<cluster:int,part:int,limb:int,value:bigint>>",
                      pa.list_(_CHANGE))}
_SCHEMA = ", ".join(f"{name} {kind}" for name, (kind, _) in _STATE.items())


def _one_row(**values) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([values[name]], kind) for name, (_, kind) in _STATE.items()], list(_STATE))


def whole(x: np.ndarray) -> tuple[str, bytes]:
    """floor(64 * x) of float64 rows, in the smallest integer type that holds it. Rows with large
    components are kept as floats ('f8')."""
    if np.abs(x).max(initial=0.0) >= LARGE:
        return "f8", x.astype("<f8").tobytes()
    q = np.floor(x * SCALE)
    top = np.abs(q).max(initial=0.0)
    kind = "i1" if top < 2 ** 7 else "i2" if top < 2 ** 15 else "i4"
    return kind, q.astype("<" + kind).tobytes()


def rows_of(kind: str, data: bytes, dims: int) -> np.ndarray:
    """The integer vectors of a block: int64, or Python integers where they may be large."""
    x = np.frombuffer(data, "<" + kind).reshape(-1, dims)
    if kind != "f8":
        return x.astype(np.int64)
    exact = [[int(v) * SCALE if abs(v) >= 2.0 ** 53 else math.floor(v * SCALE) for v in row]
             for row in x.tolist()]
    return np.array(exact, dtype=object).reshape(-1, dims)


def squares(x: np.ndarray, centroids: list[list[int]]) -> np.ndarray:
    """Exact squared distances of rows to centroids."""
    top = max((abs(v) for c in centroids for v in c), default=0)
    if x.dtype != object:
        top = max(top, int(np.abs(x).max(initial=0)))
        worst = 4 * x.shape[1] * top ** 2
        c = np.array(centroids, dtype=np.int64) if worst < 2 ** 62 else None
        if worst < 2 ** 53:  # every product and sum is a whole number that doubles hold
            f, g = x.astype(np.float64), c.astype(np.float64)
            d = (f * f).sum(1)[:, None] - 2 * (f @ g.T) + (g * g).sum(1)[None, :]
            return d.astype(np.int64)
        if worst < 2 ** 62:
            return np.stack([((x - row) ** 2).sum(1) for row in c], axis=1)
    x = x.astype(object)
    return np.stack([((x - np.array(row, dtype=object)) ** 2).sum(1) for row in centroids], axis=1)


def root(total: int) -> float:
    """Square root of a whole number, infinite beyond the range of doubles."""
    try:
        return math.sqrt(total) if total < 2 ** 100 else float(math.isqrt(total))
    except OverflowError:
        return math.inf


def _roots(d: np.ndarray) -> np.ndarray:
    if d.dtype != object:
        return np.sqrt(d.astype(np.float64))
    return np.array([root(v) for v in d.ravel().tolist()], dtype=np.float64).reshape(d.shape)


def _limbs(total: int) -> Iterator[tuple[int, int]]:
    """A whole number as digits to the base 2^40 with its sign, so that Spark can add them up."""
    sign, rest, limb = (-1 if total < 0 else 1), abs(total), 0
    while rest:
        rest, digit = divmod(rest, LIMB)
        if digit:
            yield limb, sign * digit
        limb += 1


class Block:
    """The vectors of one block with a heap per cluster."""

    def __init__(self, x: np.ndarray, k: int, cluster: np.ndarray, gaps: np.ndarray,
                 heaps: list[list[int]]):
        self.x, self.k, self.cluster, self.gaps = x, k, cluster, gaps
        self.heaps = [[(gaps[i], i) for i in heap] for heap in heaps]
        self.sums: dict[tuple[int, int], int] = {}

    def scan(self, rows: np.ndarray, centroids: list[list[int]], drift: list[float]) -> None:
        """Compare rows exactly with all centroids and put them into the heaps."""
        if not len(rows):
            return
        d = squares(self.x[rows], centroids)
        near = d.argmin(1)  # the first of equals: the smaller number
        upper = _roots(d[np.arange(len(rows)), near])
        if self.k > 1:
            others = _roots(d)
            others[np.arange(len(rows)), near] = np.inf
            lower = others.min(1)
        else:
            lower = np.full(len(rows), np.inf)
        with np.errstate(invalid="ignore"):
            gap = lower - upper - np.where(np.isinf(lower), 0.0, MARGIN * (lower + upper + 1))
        gap = np.where(np.isnan(gap), -np.inf, gap)
        old = self.cluster[rows]
        for c in np.unique(old[old != near]):
            if c >= 0:
                self._move(rows[(old == c) & (old != near)], int(c), -1)
        for c in np.unique(near[old != near]):
            self._move(rows[(near == c) & (old != near)], int(c), 1)
        self.cluster[rows] = near
        for i, c, g in zip(rows.tolist(), near.tolist(), gap.tolist()):
            self.gaps[i] = g + drift[c] if math.isfinite(drift[c]) else -math.inf
            heapq.heappush(self.heaps[c], (self.gaps[i], i))

    def _move(self, rows: np.ndarray, c: int, sign: int) -> None:
        total = self.x[rows].sum(0)
        for j, value in enumerate([*total.tolist(), len(rows)]):
            self.sums[c, j] = self.sums.get((c, j), 0) + sign * int(value)

    def expired(self, drift: list[float]) -> np.ndarray:
        """Pop the vectors whose gap the drift of their cluster has used up."""
        rows = []
        for c, heap in enumerate(self.heaps):
            while heap and heap[0][0] <= drift[c] * (1 + MARGIN):
                rows.append(heapq.heappop(heap)[1])
        return np.array(rows, dtype=np.int64)


def _drift(before: list[list[int]], after: list[list[int]], drift: list[float]) -> list[float]:
    """Accumulated drift after a round: the own centroid's move and the largest other one."""
    moves = [root(sum((a - b) ** 2 for a, b in zip(x, y))) * (1 + MARGIN)
             for x, y in zip(before, after)]
    return [d + m + max((o for j, o in enumerate(moves) if j != c), default=0.0)
            for c, (d, m) in enumerate(zip(drift, moves))]


def _blocks(vectors: DataFrame, dims: int) -> DataFrame:
    """Blocks of vectors as the table's partitions hold them; large ones in blocks of their own."""
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {kind: ([], np.empty((0, dims))) for kind in (False, True)}

        def block(ids: list, rows: np.ndarray) -> pa.RecordBatch:
            kind, data = whole(rows)
            return _one_row(ids=ids, kind=kind, vectors=data, cluster=[-1] * len(ids),
                            gaps=np.zeros(len(ids)).tobytes(), heaps=[], rescanned=0, distances=[],
                            changes=[])

        for batch in batches:
            if not batch.num_rows:
                continue
            given = batch.column("vec_id").to_pylist()
            flat = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
            large = np.abs(flat).max(axis=1) >= LARGE
            for kind in (False, True):
                ids, rows = held[kind]
                ids = ids + [given[i] for i in np.flatnonzero(large == kind)]
                rows = np.concatenate([rows, flat[large == kind]])
                while len(ids) >= BLOCK:
                    yield block(ids[:BLOCK], rows[:BLOCK])
                    ids, rows = ids[BLOCK:], rows[BLOCK:]
                held[kind] = ids, rows
        for ids, rows in held.values():
            if ids:
                yield block(ids, rows)

    return vectors.mapInArrow(build, _SCHEMA)


def _round(state: DataFrame, centroids: list[list[int]], drift: list[float], dims: int,
           first: bool, last: bool) -> DataFrame:
    """One assignment of every block; with ``last``, the distance to the own centroid as well."""
    k = len(centroids)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (batch.slice(i, 1).to_pylist()[0] for batch in batches
                    for i in range(batch.num_rows)):
            x = rows_of(row["kind"], row["vectors"], dims)
            block = Block(x, k, np.array(row["cluster"]), np.frombuffer(row["gaps"]).copy(),
                          row["heaps"] or [[] for _ in range(k)])
            rows = np.arange(len(x)) if first else block.expired(drift)
            block.scan(rows, centroids, drift)
            distances: list[int | None] = []
            if last:
                distances = [None] * len(x)
                for c in np.unique(block.cluster).tolist():
                    mine = np.flatnonzero(block.cluster == c)
                    found = squares(x[mine], [centroids[c]])[:, 0].tolist()
                    block.sums[c, dims + 1] = sum(found)
                    for i, d in zip(mine.tolist(), found):
                        distances[i] = d if d <= LONGEST else None
            yield _one_row(
                ids=row["ids"], kind=row["kind"], vectors=row["vectors"],
                cluster=block.cluster.tolist(), gaps=block.gaps.tobytes(),
                heaps=[[i for _, i in heap] for heap in block.heaps], rescanned=len(rows),
                distances=distances,
                changes=[{"cluster": c, "part": j, "limb": limb, "value": value}
                         for (c, j), total in block.sums.items() for limb, value in _limbs(total)])

    return state.mapInArrow(assign, _SCHEMA)


def _totals(state: DataFrame) -> dict[tuple[int, int], int]:
    """The changes of all blocks, added up: at most k times (dims + 2) numbers."""
    rows = (state.select(F.inline("changes")).groupBy("cluster", "part", "limb")
            .agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).collect())
    out: dict[tuple[int, int], int] = {}
    for r in rows:
        out[r["cluster"], r["part"]] = out.get((r["cluster"], r["part"]), 0) \
            + int(r["value"]) * LIMB ** r["limb"]
    return out


def cluster_vectors(rows: DataFrame, k: int = 16, rounds: int = 3, dims: int = 64,
                    seed: int = 1) -> DataFrame:
    """Clusters the vectors of ``rows`` (vec_id, embedding; other columns are ignored) that have
    exactly ``dims`` components, none null or not finite, by their components' floor(64 * x).

    The centroids start as the k vectors with smallest sha256 of '<seed>:<vec_id>' (rows that
    repeat a vec_id in the order of their components; null ids never start one), fewer if there
    are fewer. Each round assigns every vector to the nearest centroid (ties: the smaller number)
    and replaces every centroid that has vectors by their mean, rounded down; then vectors are
    assigned once more. Repeated rows are vectors of their own.

    Returns one row per vector: vec_id, cluster, distance (squared), cluster_inertia, inertia and
    centroid_sha256. Figures beyond the range of longs are null. An empty table, or one without
    a vector that has an id, gives an empty result."""
    spark = prepare(rows.sparkSession)
    v = F.col("embedding").cast("array<double>")
    usable = (rows.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
              .filter(F.size("v") == dims)
              .filter(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))))
    mark = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    starts = (usable.filter("vec_id IS NOT NULL").select(mark.alias("mark"), "v")
              .orderBy("mark", "v").limit(k).collect())
    centroids = [rows_of("f8", np.array(r["v"], "<f8").tobytes(), dims)[0].tolist() for r in starts]
    if not centroids:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, "
                                     "cluster_inertia long, inertia long, centroid_sha256 string")
    k = len(centroids)

    def written(df: DataFrame) -> tuple[DataFrame, str]:
        path = scratch_path(spark, "clusters")
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path), path

    state, path = written(_blocks(usable, dims))
    sums = {(c, j): 0 for c in range(k) for j in range(dims + 1)}
    drift = [0.0] * k
    for at in range(rounds + 1):
        old, last = path, at == rounds
        state, path = written(_round(state, centroids, drift, dims, at == 0, last))
        drop_path(spark, old)
        changes = _totals(state)
        if last:
            break
        for key, change in changes.items():
            sums[key] += change
        means = [[sums[c, j] // sums[c, dims] for j in range(dims)] if sums[c, dims] else centroids[c]
                 for c in range(k)]
        drift = _drift(centroids, means, drift)
        centroids = means

    def fit(total: int) -> int | None:
        return total if total <= LONGEST else None

    inertia = [changes.get((c, dims + 1), 0) for c in range(k)]
    figures = spark.createDataFrame(
        [(c, fit(inertia[c]), fit(sum(inertia)),
          hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for c in range(k)],
        "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    # k rows: bounded by the parameter
    return (state.select(F.inline(F.arrays_zip("ids", "cluster", "distances")))
            .toDF("vec_id", "cluster", "distance").join(F.broadcast(figures), "cluster")
            .select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"))
