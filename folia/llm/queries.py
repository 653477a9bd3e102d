"""The queries of the operators over the tables of a directory, and their SQL where there is any."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folia.llm.exact_dedup import exact_dedup
from folia.llm.line_dedup import dedup_page_lines
from folia.llm.media import media_features
from folia.llm.mixing import mix_sources
from folia.llm.oracles import ORACLE_SQL
from folia.llm.packing import pack_documents
from folia.llm.quality import fit_selection
from folia.llm.sentence_dedup import sentence_span_dedup
from folia.llm.sharding import interleave_shards
from folia.llm.simhash import simhash_groups
from folia.llm.suffix_dedup import repeated_strings


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = interleave_shards(_table(spark, sf_dir, "documents"), 40)
    return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    fitted = fit_selection(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return fitted.scores.filter(F.col("place") >= fitted.least).select(F.col("id").alias("doc_id"), "log_weight")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_page_lines(_table(spark, sf_dir, "pages"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_table(spark, sf_dir, "documents"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_table(spark, sf_dir, "documents"))


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_features(_table(spark, sf_dir, "documents"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_strings(_table(spark, sf_dir, "documents")).drop("kept")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(_table(spark, sf_dir, "documents"), words=3)


def op9_sentence_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_span_dedup(_table(spark, sf_dir, "documents"), sentences=2, long=25)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


__all__ = ["ORACLE_SQL", "QUERIES"]

QUERIES = {
    f.__name__: f
    for f in (op1_sharding, op2_quality, op3_line_dedup, op4_packing, op5_exact_dedup, op6_media, op7_suffix_dedup, op8_simhash, op9_sentence_dedup, op10_mixing)
}
