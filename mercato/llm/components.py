"""Connected components of a link table: forests within chunks of links, then alternating
large-star and small-star steps across chunks.

A chunk of links (bounded, wherever they lie) is reduced to one link per node to the smallest node
that the chunk connects it with, which needs no shuffle. The star steps are a minimum per node and a
join back, so no component is ever gathered in one place; a hub is split by AQE's skew-join
handling. Rounds end as soon as every node has one link to a node without one, and each round is
cut with a written table.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mercato.llm.common import lean, materialise, prepare

# Links that are joined in memory at a time.
CHUNK_LINKS = 200_000


def chunk_forest(links: pd.DataFrame) -> pd.DataFrame:
    """(a, b) for every node a that ``links`` connect with a smaller one, b being the smallest."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while (y := up.get(x, x)) != x:
            up[x] = up.get(y, y)
            x = y
        return x

    for a, b in zip(links["a"].tolist(), links["b"].tolist()):
        a, b = root(a), root(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    return pd.DataFrame({"a": list(up), "b": [root(x) for x in up]}, dtype="int64")


def _forests(links: DataFrame) -> DataFrame:
    """The forests of all chunks: links (a, b) with a > b that connect the same nodes."""
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += len(batch)
            if n >= CHUNK_LINKS:
                yield chunk_forest(pd.concat(held))
                held, n = [], 0
        if held:
            yield chunk_forest(pd.concat(held))

    return links.mapInPandas(lean(work), "a long, b long")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return (both.join(least, "a").filter("b > a AND b <> m")
            .select(F.col("b").alias("a"), F.col("m").alias("b")))


def _small_star(down: DataFrame) -> DataFrame:
    """``down``: links with a > b, as large-star steps leave them."""
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    joined = down.join(least, "a").filter("b <> m").select(F.col("b").alias("a"),
                                                           F.col("m").alias("b"))
    return joined.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether every node has at most one link (as a) and no node is on both sides."""
    sides = F.explode(F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("up")),
                              F.struct(F.col("b").alias("node"), F.lit(0).alias("up"))))
    nodes = edges.select(sides.alias("s")).groupBy("s.node").agg(
        F.sum("s.up").alias("ups"), F.min("s.up").alias("least"))
    return nodes.filter("ups > 1 OR (ups = 1 AND least = 0)").isEmpty()


def connected_components(links: DataFrame) -> DataFrame:
    """``links``: (a, b) long pairs, in any direction, repeats and self-links allowed. Returns
    (node, component) for every node of a link other than a self-link; the component is its
    smallest node."""
    prepare(links.sparkSession)
    # written before forests are made of it: what lies in many small files is read in few chunks
    edges = materialise(links.filter("a <> b").select("a", "b"), "links")
    while True:
        edges = materialise(_forests(edges), "links")
        if _settled(edges):
            break
        edges = materialise(_small_star(_large_star(edges)), "links")
    nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return nodes.unionByName(roots)
