"""Substring index against a scan with ``ilike``."""

import tempfile

import pytest
from pyspark.sql import functions as F

from mercato.sources import partitioned as P
from mercato.sources.schemas import SCHEMAS
from mercato.sources.text_index import MOST, TextIndex, grams_of, pieces

NAMES = ["Anna Bell", "ANNABELLE", "bob", "an", "", None, "50% off_now", "50x offynow", "back\\slash", "Ébène Ölçü",
         "İstanbul", "ΑΒΣ ΟΔΟΣ", "😀😀😀 smile", "aaaa", "aaa", "a b c d", "Annab ellipse"]


def customers(spark, rows):
    df = spark.createDataFrame(rows, "customer_id long, customer_name string, city string")
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
                       for f in SCHEMAS["customer"].fields])


@pytest.fixture(scope="module")
def index(spark):
    rows = [(i, NAMES[i], f"town {i % 3}") for i in range(len(NAMES))]
    rows += [(100 + i, f"filler number {i}", "hot place" if i % 3 else None) for i in range(300)]
    root = tempfile.mkdtemp(prefix="mercato-grams-")
    store = P.PartitionedStore.create(spark, f"{root}/tables", {"customer": customers(spark, rows)}, 16)
    return TextIndex.create(store, "customer", ["customer_name", "city"], f"{root}/grams", 4)


def ids(df):
    return sorted(r[0] for r in df.select("customer_id").collect())


def test_pieces_and_grams():
    assert pieces("%ab_c\\%d%") == ["ab", "c%d"] and pieces("%%__") == []
    assert grams_of("%abcd%bcd_x%") == ["abc", "bcd"] and grams_of("%ab_cd%") == []


@pytest.mark.parametrize("pattern", [
    "%annab%", "%ANNA%BELL%", "%nab_l%", "%50\\% off\\_%", "%50% off_now%", "%back\\\\slash%", "%ÉBÈNE%", "%ölç%",
    "%istan%", "%i̇st%", "%οδος%", "%ΟΔΟΣ%", "%😀😀😀%", "%aaa%", "%aaaa%", "anna bell", "%filler number 29%",
    "%nowhere%", "%an%", "%", "", "%a_b%"])
def test_rows_equal_those_of_a_scan(index, pattern):
    want = index.store["customer"].where(F.col("customer_name").ilike(pattern))
    got = index.rows({"customer_name": pattern}).where(F.col("customer_name").ilike(pattern))
    assert ids(got) == ids(want)


def test_either_of_two_columns(index):
    both = F.col("customer_name").ilike("%bell%") | F.col("city").ilike("%town 2%")
    found = index.rows({"customer_name": "%bell%", "city": "%town 2%"})
    assert ids(found.where(both)) == ids(index.store["customer"].where(both)) and found.count() < 30


def test_where_the_index_cannot_tell_all_rows_are_scanned(index):
    assert index.candidates({"customer_name": "%an%"}) is None
    assert index.candidates({"customer_name": "%filler%"}) is None       # more than a quarter of the rows
    assert index.candidates({"email_address": "%anna%"}) is None
    assert index.candidates({"customer_name": "%bell%", "city": "%a%"}) is None
    best, rows = index.rarest("customer_name", ["fil", "nna", "zzz", "bel"])
    assert [g for g, _ in best] == ["zzz", "bel", "nna"] and rows == 300 + len(NAMES) and best[-1][1] < MOST * rows


def test_only_parts_with_candidates_and_folders_of_grams_are_read(index):
    found = index.rows({"customer_name": "%slash%"})
    assert len(found.inputFiles()) > 0
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "_part#" in plan and "PartitionFilters" in plan and "PushedFilters: [" in plan
    keys = index.candidates({"customer_name": "%slash%"})
    assert [r["key"] for r in keys.collect()] == [8]
    part = index.store.touched("customer", keys.withColumnRenamed("key", "customer_id"))
    assert index.store.part("customer", part).count() < index.store["customer"].count() / 4


def test_added_and_changed_texts_are_found(spark):
    root = tempfile.mkdtemp(prefix="mercato-grams-")
    rows = [(i, f"name {i}", None) for i in range(50)]
    store = P.PartitionedStore.create(spark, f"{root}/tables", {"customer": customers(spark, rows)}, 4)
    ix = TextIndex.create(store, "customer", ["customer_name", "city"], f"{root}/grams", 4)
    patch = spark.createDataFrame([(1, 7, "renamed", ["customer_name"])],
                                  "change_id long, customer_id long, customer_name string, set_fields array<string>")
    rejects, _ = P.apply_patches(store, "customer", patch)
    assert rejects.isEmpty()
    ix.add(store["customer"].where("customer_id = 7"))
    assert ids(ix.rows({"customer_name": "%renam%"})) == [7]
    old = ix.rows({"customer_name": "%name 7%"})                 # the old postings are refused by the text
    assert ids(old) == [7] and old.where(F.col("customer_name").ilike("%name 7%")).isEmpty()
    ix.add(store["customer"].where("customer_id = 7"))           # a second time changes nothing
    assert ids(ix.rows({"customer_name": "%renam%"})) == [7]


def test_empty_table(spark):
    root = tempfile.mkdtemp(prefix="mercato-grams-")
    store = P.PartitionedStore.create(spark, f"{root}/tables", {"customer": customers(spark, [])}, 4)
    ix = TextIndex.create(store, "customer", ["customer_name"], f"{root}/grams", 4)
    assert ix.rows({"customer_name": "%anna%"}).isEmpty() and ix.rows({"customer_name": "%a%"}).isEmpty()
