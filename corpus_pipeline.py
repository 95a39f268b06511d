"""The training-text pipeline: stages over ``documents``, each written before the next one reads it.

Every stage but the last returns the columns of its input. A stage works on all rows that
the one before it kept; how it treats nulls, empty texts, ties and repeated rows is said
in its operator's module.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from driftwise.llm import decontaminate, lines, packing, perplexity, simhash
from driftwise.llm.common import saved, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity stays below their language's threshold."""
    return perplexity.accepted(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines of three-line windows that occurred before."""
    return lines.dedup_documents(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near copies."""
    return simhash.first_of_groups(docs, radius=3, beyond=True)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark window occurs."""
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in batches of length buckets."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", quality),
    ("line dedup", line_dedup),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", decontaminated),
    ("packing", packed),
]

#: The stages' fingerprints and language model cannot be put in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = saved(docs, f"stage{number}")
    return docs
