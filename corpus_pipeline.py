"""From raw documents to packed training sequences: five stages, each written as Parquet and read
again as the next one's documents.

A stage takes (spark, docs, sf_dir) and works on every document that its predecessor kept. All
but the last return the columns of ``documents``. The steps: documents scored as toxic go; lines
that many documents share go, except from one document; one document of each group of
near-duplicates (five-word shingles, similarity 0.8 or more) stays; documents are repeated so
that sources reach their target weights; and the token sequences are packed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mercato.llm.common import materialise, table
from mercato.llm.line_dedup import dedup_lines
from mercato.llm.minhash import drop_near_duplicates
from mercato.llm.mixing import mix_sources
from mercato.llm.packing import pack_documents
from mercato.llm.toxicity import score_toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    scored = score_toxicity(docs.select(COLUMNS), table(spark, sf_dir, "labels"))
    return scored.filter(F.col("predicted") == 0).select(COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return dedup_lines(docs.select(COLUMNS), min_chars=20, min_docs=3).select(COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_duplicates(docs.select(COLUMNS), width=5, percent=80).select(COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix_sources(docs.select(COLUMNS)).select(COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs.select(COLUMNS), size=4096, end_id=1)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("mixing", mixing),
    ("packing", packing),
]

#: The toxicity scores of the first stage cannot be written in SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
