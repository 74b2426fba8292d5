"""Bitmap key sets against Python sets."""

from pyspark.sql import functions as F

from mercato.operators.key_set import BROADCAST_BUCKETS, dense, key_set, merged, size, with_membership
from mercato.operators.quality import with_parent_bit, with_parent_flag

KEYS = [0, -1, 1, 7, 8, 9, 32_767, 32_768, 32_769, 65_536, -32_768, -32_769, 10**15, 7, None, None]
ASKED = KEYS + [2, -2, 6, 10, 32_766, 32_770, 10**15 + 1, -10**15, 65_535]


def keys(spark, values):
    return spark.createDataFrame([(v,) for v in values], "k long")


def test_membership_size_and_union(spark):
    held = {k for k in KEYS if k is not None}
    s = key_set(keys(spark, KEYS), "k")
    assert size(s).first()["n"] == len(held)
    for buckets in (None, 9, BROADCAST_BUCKETS + 1):
        got = with_membership(keys(spark, ASKED), "k", s, "in_set", buckets).collect()
        assert len(got) == len(ASKED)
        assert {r["k"]: r["in_set"] for r in got} == {k: k in held for k in ASKED}
    other = key_set(keys(spark, [5, 7, 40_000, None]), "k")
    assert size(merged(s, other, s)).first()["n"] == len(held | {5, 40_000})


def test_empty_tables(spark):
    empty = keys(spark, [])
    assert size(key_set(empty, "k")).first()["n"] == 0 and dense(empty, "k") == 1
    assert with_membership(keys(spark, [1]), "k", key_set(empty, "k"), "f", 1).first()["f"] is False
    assert with_membership(empty, "k", key_set(keys(spark, [1]), "k"), "f").isEmpty()


def test_every_bit_of_a_bucket(spark):
    s = key_set(spark.range(-40_000, 40_000).where("id % 3 = 0"), "id")
    got = with_membership(spark.range(-40_100, 40_100), "id", s, "f", 9)
    assert got.where(F.col("f") != ((F.col("id") % 3 == 0) & F.col("id").between(-40_000, 39_999))).isEmpty()


def test_orphans_equal_those_of_the_join(spark):
    close = spark.range(200_000).where("id % 5 <> 0")
    far = close.select((F.col("id") * 1_000_003).alias("id"))
    assert dense(close, "id") is not None and dense(far, "id") is None
    for parent, step in ((close, 1), (far, 1_000_003)):
        child = spark.range(30_000).select(
            F.when(F.col("id") % 7 != 0, F.col("id") * 9 * step).alias("k"), F.col("id").alias("row"))
        a, b = (f(child, "k", parent, "id", "orphan") for f in (with_parent_bit, with_parent_flag))
        assert a.columns == b.columns or set(a.columns) == set(b.columns)
        assert {tuple(r) for r in a.select("row", "orphan").collect()} == {tuple(r) for r in b.select("row", "orphan").collect()}


def test_neither_side_is_shuffled(spark):
    child = spark.range(100).withColumnRenamed("id", "k")
    plan = with_parent_bit(child, "k", spark.range(1_000), "id", "orphan")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and plan.count("Exchange hashpartitioning") == 1  # of the bitmaps
    assert "bucket" in plan.split("Exchange hashpartitioning(")[1].split(")")[0] or "_groupingexpression" in plan
