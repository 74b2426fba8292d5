"""Substring index: searches with ``ilike`` that read a fraction of a table.

Every run of three code points of a lower-cased text is a gram; a posting says that a row holds it.
Postings lie in folders by a hash of the gram (``<root>/postings/_slot=<n>``), sorted by gram, next
to the number of rows per gram. A search cuts its pattern at the wildcards, looks up how often the
grams of the pieces occur, takes the rarest few, intersects their postings, and reads only the
parts of the table that hold candidates. The caller's own ``ilike`` decides, so the rows are those
of a scan whatever the index says too much.

A text that is added or changed appends its postings and counts; old postings stay and are refused
by the exact test, so nothing is rewritten. The index may hold a row twice; a search counts each
gram of a row once. A pattern without three literal characters in a row, or whose rarest gram is in
more than ``MOST`` of the rows, is answered by a scan.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mercato.sources.adapter import Store
from mercato.sources.partitioned import LAYOUT_KEYS, PART, PartitionedStore, part_of

SIZE = 3
SLOT = "_slot"
#: Postings of at most this many grams are intersected for a pattern.
GRAMS = 3
#: Share of the rows that the rarest gram may be in; a scan is cheaper beyond it.
MOST = 0.25


def pieces(pattern: str) -> list[str]:
    """The literal runs of a ``LIKE`` pattern, cut at ``%`` and ``_``; a backslash makes the next
    character literal."""
    out, run, literal = [], "", False
    for c in pattern:
        if literal or c not in "%_\\":
            run, literal = run + c, False
        elif c == "\\":
            literal = True
        else:
            out.append(run)
            run = ""
    return [p for p in [*out, run] if p]


def grams_of(pattern: str) -> list[str]:
    """The distinct grams that every text matching the (lower-cased) pattern holds."""
    return sorted({p[i:i + SIZE] for p in pieces(pattern) for i in range(len(p) - SIZE + 1)})


class TextIndex:
    """The texts of ``columns`` of one table of a partitioned store, indexed under ``root``."""

    def __init__(self, store: PartitionedStore, table: str, columns: list[str], root: str, slots: int):
        self.store, self.table, self.columns, self.root, self.slots = store, table, columns, root.rstrip("/"), slots

    @classmethod
    def create(cls, store: PartitionedStore, table: str, columns: list[str], root: str, slots: int) -> TextIndex:
        out = cls(store, table, columns, root, slots)
        out._write(store[table], "overwrite")
        return out

    def _slot(self):
        return F.pmod(F.xxhash64("gram"), F.lit(self.slots)).cast("int")

    def _postings(self, rows: DataFrame) -> DataFrame:
        key = LAYOUT_KEYS[self.table]
        texts = rows.select(F.col(key).cast("long").alias("key"), F.explode(F.array(*[
            F.struct(F.lit(c).alias("column"), F.lower(F.col(c)).alias("t")) for c in self.columns])).alias("x")) \
            .select("key", "x.column", "x.t")
        grams = F.expr(f"CASE WHEN length(t) >= {SIZE} THEN array_distinct(transform("
                       f"sequence(1, length(t) - {SIZE - 1}), i -> substring(t, i, {SIZE}))) END")
        return texts.where("key IS NOT NULL").select("column", F.explode(grams).alias("gram"), "key")

    def _write(self, rows: DataFrame, mode: str) -> None:
        postings = self._postings(rows).withColumn(SLOT, self._slot())
        # AQE splits a slot that a frequent gram makes large
        (postings.hint("rebalance", SLOT).sortWithinPartitions(SLOT, "column", "gram").write.mode(mode)
         .partitionBy(SLOT).parquet(f"{self.root}/postings"))
        (postings.groupBy(SLOT, "column", "gram").agg(F.count(F.lit(1)).alias("n")).repartition(SLOT)
         .sortWithinPartitions(SLOT, "column", "gram").write.mode(mode).partitionBy(SLOT).parquet(f"{self.root}/counts"))
        (rows.agg(F.count(F.lit(1)).alias("n")).write.mode(mode).parquet(f"{self.root}/rows"))

    def add(self, rows: DataFrame) -> None:
        """Index rows that were added to the table or whose texts changed (rows of the table)."""
        self._write(rows, "append")

    def _read(self, what: str, last: str, column: str, grams: list[str]) -> DataFrame:
        df = self.store.spark.read.schema(f"column STRING, gram STRING, {last} BIGINT, {SLOT} INT").parquet(f"{self.root}/{what}")
        slots = [F.pmod(F.xxhash64(F.lit(g)), F.lit(self.slots)).cast("int") for g in grams]
        # constant after folding, so that the scan is pruned to the grams' folders
        return df.where((F.col("column") == column) & F.col("gram").isin(grams) & F.col(SLOT).isin(slots))

    def rarest(self, column: str, grams: list[str]) -> tuple[list[tuple[str, int]], int]:
        """The rarest of ``grams`` (at most ``GRAMS``) with the postings of each, and how many rows
        were indexed: as many driver rows as the pattern has grams."""
        n = {r["gram"]: r["n"] for r in self._read("counts", "n", column, grams).groupBy("gram").agg(F.sum("n").alias("n")).collect()}
        rows = self.store.spark.read.schema("n BIGINT").parquet(f"{self.root}/rows").agg(F.sum("n")).first()[0]
        return sorted(((g, n.get(g, 0)) for g in grams), key=lambda x: (x[1], x[0]))[:GRAMS], rows

    def candidates(self, patterns: Mapping[str, str]) -> DataFrame | None:
        """The keys (distinct, column ``key``) of rows that may match any of the patterns
        (column -> ``LIKE`` pattern); None where only a scan can tell."""
        lowered = self.store.spark.range(1).select(
            *[F.lower(F.lit(p)).alias(c) for c, p in patterns.items()]).first().asDict()
        found = None
        for column, pattern in lowered.items():
            grams = grams_of(pattern)
            if column not in self.columns or not grams:
                return None
            best, rows = self.rarest(column, grams)
            if best[0][1] > MOST * rows:
                return None
            chosen = [g for g, _ in best]
            bit = sum((F.when(F.col("gram") == g, 1 << i).otherwise(0) for i, g in enumerate(chosen)), F.lit(0))
            keys = (self._read("postings", "key", column, chosen).groupBy("key").agg(F.bit_or(bit).alias("held"))
                    .where(F.col("held") == (1 << len(chosen)) - 1).select("key"))
            found = keys if found is None else found.unionByName(keys).distinct()
        return found

    def rows(self, patterns: Mapping[str, str]) -> DataFrame:
        """The rows of the table that may match any of the patterns, read from their parts."""
        found = self.candidates(patterns)
        if found is None:
            return self.store[self.table]
        key = LAYOUT_KEYS[self.table]
        parts = [r[0] for r in found.select(part_of("key", self.store.parts).alias(PART)).distinct().collect()]  # at most all parts
        return self.store.part(self.table, sorted(parts)).join(found.withColumnRenamed("key", key), key, "left_semi")

    def view(self, patterns: Mapping[str, str], over: Store | None = None) -> Store:
        """``over`` (the indexed store by default) with ``rows(patterns)`` in the table's place, for
        a listing that applies the patterns itself."""
        return (self.store if over is None else over).replace(**{self.table: self.rows(patterns)})
