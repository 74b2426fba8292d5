"""Mixing sources to target weights by Poisson replication.

Every source has a target share of the output and so a rate: how often its documents should
occur on average. Each document draws its number of copies from a Poisson distribution with that
mean, by inverting it at a uniform number hashed from the seed and the document, and is exploded
by it. The copies are then shuffled globally by another hash. All of it is DataFrame work.

A rate above ``PART`` is split into equal parts whose draws add up, so that the inverted table
has a fixed length and never underflows.

Rows: documents with a null source form a source of their own. Rows that repeat a ``doc_id`` and
text draw alike. A null ``doc_id`` or text is drawn as empty. A source whose documents are all
empty has rate 1. An empty table gives no rows. Input columns named like an added one
(``replica``, ``rate``, ``shuffle_key``) are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mercato.llm.common import materialise, prepare

PART = 16.0          # largest mean of one Poisson draw
TERMS = 96           # P(X > 96) < 1e-40 at that mean
BROADCAST_SOURCES = 10_000


def uniform(*parts) -> Column:
    """A number in (0, 1) from the md5 of the given values (52 bits)."""
    text = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") + 0.5) \
        / float(1 << 52)


def source_rates(docs: DataFrame, weights: dict[str, float] | None, alpha: float,
                 total: float | None) -> DataFrame:
    """source, rate, parts and cdf (of a Poisson with mean rate / parts) of every source."""
    sizes = docs.groupBy("source").agg(
        F.sum(F.length(F.coalesce(F.col("text").cast("string"), F.lit("")))).alias("size"))
    if weights is None:
        weight = F.when(F.col("size") > 0, F.pow(F.col("size").cast("double"), F.lit(alpha)))
    else:
        weight = F.lit(None).cast("double")
        for name, w in weights.items():
            weight = F.when(F.col("source") == name, F.lit(float(w))).otherwise(weight)
        weight = F.coalesce(weight, F.lit(0.0))
    sized = materialise(sizes.withColumn("weight", weight), "sources")
    whole = sized.agg(F.sum("weight").alias("weights"), F.sum("size").alias("sizes")).first()
    wanted = float(total if total is not None else whole["sizes"] or 0)
    rate = F.when(F.col("size") > 0, F.col("weight") / F.lit(float(whole["weights"] or 1))
                  * F.lit(wanted) / F.col("size")).otherwise(F.lit(1.0))
    rated = sized.withColumn("rate", rate).withColumn(
        "parts", F.greatest(F.lit(1), F.ceil(F.col("rate") / PART)).cast("int"))
    mean = F.col("rate") / F.col("parts")
    cdf = F.aggregate(
        F.sequence(F.lit(0), F.lit(TERMS)),
        F.struct(F.exp(-mean).alias("p"), F.lit(0.0).alias("sum"),
                 F.array().cast("array<double>").alias("cdf")),
        lambda acc, i: F.struct(
            (acc["p"] * mean / (i + 1)).alias("p"), (acc["sum"] + acc["p"]).alias("sum"),
            F.concat(acc["cdf"], F.array(acc["sum"] + acc["p"])).alias("cdf")),
        lambda acc: acc["cdf"])
    return rated.select("source", "rate", "parts", cdf.alias("cdf"))


def mix_sources(docs: DataFrame, *, weights: dict[str, float] | None = None, alpha: float = 0.5,
                total: float | None = None, seed: int = 17) -> DataFrame:
    """Copies of the documents in a random global order, so that sources have their target
    weights. ``weights`` gives each source's share (sources that are not named get 0); without
    it the shares are the sources' sizes to the power ``alpha``. ``total`` is the size of the
    output in characters (by default that of the input).

    Adds replica (from 0), rate and shuffle_key; rows are partitioned by the key and sorted by it.
    """
    spark = prepare(docs.sparkSession)
    docs = docs.drop("replica", "rate", "shuffle_key")
    rates = materialise(source_rates(docs, weights, alpha, total), "rates") \
        .withColumnRenamed("source", "rated_source")
    if rates.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        rates = F.broadcast(rates)       # at most 10,000 rows of 1 KB
    drawn = F.aggregate(
        F.sequence(F.lit(1), F.col("parts")), F.lit(0),
        lambda n, i: n + F.size(F.filter(
            "cdf", lambda c: c < uniform(F.lit(seed), F.col("doc_id"), i))))
    copies = (docs.join(rates, docs["source"].eqNullSafe(F.col("rated_source")))
              .withColumn("copies", drawn).filter("copies > 0")
              .withColumn("replica", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
              .drop("rated_source", "parts", "cdf", "copies")
              .withColumn("shuffle_key", F.substring(F.md5(F.concat_ws(
                  "|", F.lit(f"order {seed}"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")),
                  F.col("replica")).cast("binary")), 1, 16)))
    return copies.repartition("shuffle_key").sortWithinPartitions("shuffle_key")
