"""A training corpus from documents, in five stages, each written as Parquet and reread by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rivulet.llm import decontaminate, exact, language, near, packing
from rivulet.llm.common import Tables, folder

#: What the last stage called has written besides its result. A stage is called once the result before it is stored.
_own = Tables()


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told: those without text or letters go."""
    _own.release(spark)
    with _own:
        return language.keep_identified(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of identical texts, that with the largest doc_id."""
    _own.release(spark)
    with _own:
        return exact.keep_exact(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near-duplicates, the document with the least doc_id."""
    _own.release(spark)
    with _own:
        return near.keep_near(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item."""
    _own.release(spark)
    with _own:
        return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of training sequences."""
    _own.release(spark)
    with _own:
        return packing.pack(docs)


STAGES = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", pack),
]

#: Language models, minima and tokens aren't expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents: the pieces that packing returns, read from the folder that holds them.

    Null and empty texts go with the first stage; repeated rows go with the second but for rows that share doc_id and
    text, which stay together. An empty table gives an empty result. Columns of documents beside doc_id, text and lang
    are carried along. What a stage has stored is deleted once the next one is.
    """
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        result, now = stage(spark, docs, sf_dir), Tables()
        with now:
            path = folder(spark, f"pipeline-{name}")
        result.write.parquet(path)
        docs = spark.read.parquet(path)
        if last:
            last.release(spark)
        last = now
    _own.release(spark)
    return docs
