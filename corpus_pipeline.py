"""The corpus pipeline: toxicity, near duplicates, decontamination, personal data, mixing.

Each stage reads what its predecessor kept, written as Parquet, and works on all of it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from offerlake.llm.common import cut, spread, stash, table
from offerlake.llm.decontamination import find_contamination
from offerlake.llm.mixing import mix_sources
from offerlake.llm.near_duplicates import near_duplicates
from offerlake.llm.personal_data import personal_data
from offerlake.llm.toxicity import score_toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _keyed(docs: DataFrame) -> DataFrame:
    """The columns of documents with ``row``, a hash of doc_id and text: stages decide by it, so that a null or
    repeated doc_id is no other document's."""
    return docs.select(*COLUMNS, F.xxhash64("doc_id", "text", F.col("text").isNull()).alias("row"))


def _without(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """The documents but those of ``rows``."""
    return _keyed(docs).join(stash(rows.select("row").distinct()), "row", "left_anti").select(*COLUMNS)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the labelled examples do not vote toxic (score under 0.5)."""
    return _without(docs, score_toxicity(_keyed(docs), table(spark, sf_dir, "labels"), key="row").filter("predicted = 1"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of equal and near-equal texts: the one with the least doc_id, null ones last.

    Of rows of the same doc_id and text one stays.
    """
    keyed = _keyed(docs)
    classes = near_duplicates(keyed.select(F.col("row").alias("doc_id"), "text")).toDF("row", "class")
    ids = keyed.select("row", "doc_id").join(cut(classes.distinct()), "row")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")).alias("first")
    kept = stash(ids.groupBy("class").agg(first).select("first.row"))
    found = keyed.join(kept, "row")
    if keyed.select("row").join(kept, "row").groupBy("row").count().filter("count > 1").isEmpty():
        return found.select(*COLUMNS)
    # equal in doc_id and text: the least of the other columns
    one = found.groupBy("row").agg(F.min(F.struct(*COLUMNS)).alias("one"))
    return one.select("one.*")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    leaking = find_contamination(_keyed(docs).select(F.col("row").alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    return _without(docs, leaking.select(F.col("doc_id").alias("row")))


def personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data and disclosing terms replaced in their texts, n_chars as they are then. A null text stays null."""
    found = personal_data(docs.select(*COLUMNS, F.col("text").isNull().alias("was_null")))
    text = F.when(F.col("was_null"), F.lit(None)).otherwise(F.col("clean"))
    return found.withColumn("text", text).withColumn("n_chars", F.when(F.col("was_null"), F.col("n_chars")).otherwise(F.length("text").cast("bigint"))).select(*COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each document: the documents' ids and sources with the words taken."""
    return mix_sources(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("personal_data", personal),
    ("mixing", mixing),
]

#: SQL can express neither the sampling of near duplicates nor the balanced sample.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents"))
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stash(docs)
    return docs
