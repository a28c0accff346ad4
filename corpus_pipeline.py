"""Stages that turn raw documents into training sequences.

Each stage but the last returns the columns of documents, whatever they are, for the rows that stay.  Null texts count as empty, which the
quality rules reject; a stage that gets such rows all the same keeps them.  Rows without doc_id pass the near copies and are judged by
their text elsewhere.  Repeated rows: of a doc_id's equal rows none is a copy of another; all stay or go together.  Very long texts are
read whole.  Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from outrate.llm import forest, packing, pii, quality_rules, tiling
from outrate.llm.common import read, ready, table
from outrate.llm.tokens import default_path

#: Hundredths of the similarity (of sets of five words) from which texts are near copies.
LINK = 80


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    ready(spark)
    return quality_rules.keep(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest doc_id stays."""
    ready(spark)
    return forest.keep(docs, LINK)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark item go."""
    ready(spark)
    return tiling.keep(docs, read(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts is replaced by its kind."""
    ready(spark)
    return pii.mask(docs, pii.fit(docs))


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in training sequences."""
    ready(spark)
    return packing.pack(docs, default_path(), end_id=1)


STAGES = [("quality rules", quality), ("near copies", near_copies), ("benchmark", benchmark), ("personal data", personal_data), ("packing", sequences)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ready(spark)
    docs = read(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = table(docs, name.replace(" ", "-"))
    return docs
