"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and is written
as Parquet to the shared folder before the next one reads it. All but the last return the
columns of documents. An empty table goes through all stages as one. Rows with null or repeated
ids are documents like others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folia.llm.common import materialize, release
from folia.llm.line_dedup import dedup_document_lines
from folia.llm.mixing import mixed_rows
from folia.llm.packing import pack_documents
from folia.llm.quality import select_quality
from folia.llm.similar import one_of_each_group


def _counted(docs: DataFrame) -> DataFrame:
    """n_chars as the text now has them."""
    return docs.withColumn("n_chars", F.length("text").cast("long"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that importance resampling takes; the rejected go.

    Null and empty texts weigh nothing either way. Without good labels all rows are kept.
    """
    return select_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def site_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the lines that over a twentieth of a source's other documents share.

    Null texts stay null, a null source is a source of its own, copies count as documents.
    """
    return _counted(dedup_document_lines(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near copies: five-word shingles, a similarity of 0.8 or more.

    That of the least id stays, null last. Null, empty and blank texts are one group.
    """
    return one_of_each_group(docs, words=5, similarity=0.8)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat and cut documents to the sources' target weights. Texts without words are not in the mix."""
    return _counted(mixed_rows(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the mix into sequences of permitted lengths: a row for each piece of a document."""
    return pack_documents(docs)


STAGES = [("quality", quality), ("site_lines", site_lines), ("near_duplicates", near_duplicates), ("mixing", mixing), ("packing", packing)]

#: Hashed n-grams, XXH64 fingerprints and greedy packing are beyond SQL: tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        before, docs = docs, materialize(stage(spark, docs, sf_dir), name)
        release(before)
    return docs
