"""Order statistics of a changing set of values (R9, N1): how many distinct values lie above one.

The distinct values with their counts lie in folders by value range (``<root>/values/_range=<i>``),
cut at approximate quantiles, and a table of at most one row per range holds how many distinct
values each range has. The rank of a few values reads that table and the ranges these values lie
in; a change of counts reads and rewrites the ranges it falls into. When a range outgrows its
bound, all are cut anew.
"""

from __future__ import annotations

import bisect
import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mercato.session import kept
from mercato.sources.partitioned import delete_folder

VALUE = "DECIMAL(38,2)"
RANGE = "_range"
# Distinct values that a range may hold before all are cut anew: a range is sorted in one task.
MOST_PER_RANGE = 4_000_000


class OrderStatistics:
    """Distinct values (money, never null) under ``root``; ``open`` finds them again."""

    def __init__(self, spark: SparkSession, root: str, cuts: list[float], most_per_range: int = MOST_PER_RANGE):
        self.spark, self.root, self.cuts, self.most = spark, root.rstrip("/"), cuts, most_per_range

    @classmethod
    def create(cls, values: DataFrame, root: str, ranges: int, most_per_range: int = MOST_PER_RANGE) -> OrderStatistics:
        """From a frame with a column ``value``, one row per holder; nulls are left out."""
        counted = kept(values.where(F.col("value").isNotNull()).groupBy(F.col("value").cast(VALUE).alias("value"))
                       .agg(F.count(F.lit(1)).alias("n")))
        out = cls(values.sparkSession, root, [], most_per_range)
        out._lay_out(counted, ranges)
        return out

    @classmethod
    def open(cls, spark: SparkSession, root: str) -> OrderStatistics:
        cuts = spark.read.schema("cut DOUBLE").parquet(f"{root.rstrip('/')}/cuts").collect()  # one row per range
        return cls(spark, root, sorted(r[0] for r in cuts))

    def _lay_out(self, counted: DataFrame, ranges: int) -> None:
        n = max(1, ranges, -(-counted.count() * 2 // self.most))
        as_double = counted.select(F.col("value").cast("double").alias("v"))
        self.cuts = sorted(set(as_double.approxQuantile("v", [i / n for i in range(1, n)], 1 / (4 * n)))) if n > 1 else []
        delete_folder(self.spark, f"{self.root}/values")
        self._write(counted)
        self.spark.createDataFrame([(c,) for c in self.cuts], "cut DOUBLE").coalesce(1) \
            .write.mode("overwrite").parquet(f"{self.root}/cuts")
        self._write_counts(self._placed(counted).groupBy(RANGE).agg(F.count(F.lit(1)).alias("distinct")))

    def _placed(self, df: DataFrame) -> DataFrame:
        """With the range of each row's value, by binary search over the cut points."""
        splits = [-math.inf] + (self.cuts or [0.0]) + [math.inf]
        placed = Bucketizer(splits=splits, inputCol="_v", outputCol="_b").transform(
            df.withColumn("_v", F.col("value").cast("double")))
        return placed.withColumn(RANGE, F.col("_b").cast("int")).drop("_v", "_b")

    def range_of(self, value) -> int:
        return bisect.bisect_right(self.cuts or [0.0], float(value))

    def _write(self, counted: DataFrame) -> None:
        (self._placed(counted).select("value", "n", RANGE).repartition(len(self.cuts) + 2, RANGE).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy(RANGE).parquet(f"{self.root}/values"))

    def _write_counts(self, counts: DataFrame) -> None:
        counts.coalesce(1).write.mode("overwrite").parquet(f"{self.root}/counts")

    def values(self, ranges: list[int] | None = None) -> DataFrame:
        df = self.spark.read.schema(f"value {VALUE}, n BIGINT, {RANGE} INT").parquet(f"{self.root}/values")
        return df if ranges is None else df.where(F.col(RANGE).isin(ranges))

    def counts(self) -> DataFrame:
        return self.spark.read.schema(f"{RANGE} INT, distinct BIGINT").parquet(f"{self.root}/counts")

    def apply(self, deltas: DataFrame) -> list[int]:
        """Add signed counts ``(value, n)``; values whose count falls to nothing go. Returns the
        ranges rewritten. Apply each change once."""
        summed = kept(deltas.where(F.col("value").isNotNull()).groupBy(F.col("value").cast(VALUE).alias("value"))
                      .agg(F.sum("n").alias("n")).where("n != 0"))
        touched = sorted(r[0] for r in self._placed(summed).select(RANGE).distinct().collect())
        if not touched:
            return []
        fresh = kept(self.values(touched).select("value", "n").unionByName(summed).groupBy("value")
                     .agg(F.sum("n").alias("n")).where("n != 0"))
        sizes = {r[0]: r[1] for r in self._placed(fresh).groupBy(RANGE).count().collect()}  # one row per range
        if max(sizes.values(), default=0) > self.most:
            rest = self.values().where(~F.col(RANGE).isin(touched)).select("value", "n")
            self._lay_out(kept(rest.unionByName(fresh)), len(self.cuts) + 1)
            return sorted(range(len(self.cuts) + 2))
        counts = kept(self.counts().where(~F.col(RANGE).isin(touched)).unionByName(
            self.spark.createDataFrame(list(sizes.items()), f"{RANGE} INT, distinct BIGINT")))
        self._write(fresh)
        for r in set(touched) - set(sizes):  # its last value went: no file replaced the old one
            delete_folder(self.spark, f"{self.root}/values/{RANGE}={r}")
        self._write_counts(counts)
        return touched

    def ranked(self, asked: DataFrame, rank: str = "rank") -> DataFrame:
        """``asked`` with ``rank`` = 1 + number of distinct values above its ``value`` (null where
        that is null), whether the value is one of the set or not."""
        want = self._placed(asked.select(F.col("value").cast(VALUE).alias("value"))
                            .where(F.col("value").isNotNull()).distinct())
        ranges = sorted(r[0] for r in want.select(RANGE).distinct().collect())  # at most one per range
        held = self.values(ranges).select("value", RANGE, F.lit(1).alias("_held"))
        both = held.unionByName(want.withColumn("_held", F.lit(0)))
        above = Window.partitionBy(RANGE).orderBy(F.col("value").desc(), F.col("_held")) \
            .rowsBetween(Window.unboundedPreceding, Window.currentRow)
        # asked rows come before an equal held one, so the sum counts larger values only
        local = both.withColumn("_local", F.sum("_held").over(above)).where("_held = 0")
        # values in the ranges above each; one row per range on the driver
        sizes = {r[0]: r[1] for r in self.counts().collect()}
        rows, above_it = [], 0
        for r in range(len(self.cuts or [0.0]), -1, -1):
            rows.append((r, above_it))
            above_it += sizes.get(r, 0)
        offsets = self.spark.createDataFrame(rows, f"{RANGE} INT, _off BIGINT")
        ranks = local.join(F.broadcast(offsets), RANGE).select(
            F.col("value").alias("_value"), (F.col("_off") + F.col("_local") + 1).cast("long").alias(rank))
        return asked.join(ranks, F.col("value").cast(VALUE) == F.col("_value"), "left").drop("_value")
