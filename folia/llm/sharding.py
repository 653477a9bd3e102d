"""Proportional stratified interleaving into shards."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folia.llm.common import SEED, before_groups, materialize, maybe_broadcast, order_key, unit

#: Rows that one window group holds on average; more rows make more groups.
GROUP_ROWS = 2_000


def interleave_shards(
    df: DataFrame, n_shards: int, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED, group_rows: int = GROUP_ROWS
) -> DataFrame:
    """Deal rows into shards so that each shard has the sources in the proportions of the whole.

    Rows are ranked within their source in a seeded order, sorted by fractional rank
    (rank - 1/2) / source rows, and the sorted sequence is cut into n_shards runs whose
    counts differ by one at most.

    Both ranks are taken in groups: the seeded key (and then the fractional rank, which is
    even by construction) is cut into as many equal intervals as its row count needs, rows
    are numbered inside an interval, and the running total of the interval counts is added.
    A source with a third of all rows is so spread over many tasks.

    Returns id, source, size (UTF-8 bytes + 16), text_crc32, shard, slot (0.. in each shard).
    Null source: a source of its own. Null text: size 16, CRC 0. Repeated rows are dealt one
    by one; ties in order are broken by id, then CRC. Empty table: no rows. Fewer rows than
    shards: some shards stay empty. Other columns are ignored, whatever their names.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = df.select(
        F.col(id_col).alias("id"), F.col(source_col).alias("source"), (F.octet_length(text).cast("long") + 16).alias("size"), F.crc32(text.cast("binary")).alias("crc"),
        order_key(seed, F.col(id_col)).alias("key"),
    )
    totals = df.groupBy(F.col(source_col).alias("of_source")).agg(F.count(F.lit(1)).alias("n"))
    totals = maybe_broadcast(totals)
    total = totals.agg(F.sum("n")).first()[0] or 0

    def spread(rows: DataFrame) -> DataFrame:
        return rows.join(totals, F.col("source").eqNullSafe(F.col("of_source"))).withColumn("part", F.floor(unit(F.col("key")) * F.ceil(F.col("n") / group_rows))).drop("of_source")

    keys = spread(base.select("id", "source", "key"))
    parts = materialize(keys.groupBy(F.col("source").alias("p_source"), F.col("part").alias("p_part")).agg(F.count(F.lit(1)).alias("c")), "parts")
    parts = before_groups(parts, ["p_source"], "p_part").drop("c")
    in_part = Window.partitionBy("source", "part").orderBy("key", "id", "crc")
    ranked = (
        spread(base)
        .join(parts, F.col("source").eqNullSafe(F.col("p_source")) & (F.col("part") == F.col("p_part")))
        .withColumn("rank", F.col("before") + F.row_number().over(in_part))
        .select("id", "source", "size", "crc", "key", ((F.col("rank") - 0.5) / F.col("n")).alias("at"))
    )
    ranked = materialize(ranked.withColumn("cut", F.floor(F.col("at") * max(1, -(-total // group_rows)))), "ranks")
    cuts = before_groups(materialize(ranked.groupBy(F.col("cut").alias("c_cut")).agg(F.count(F.lit(1)).alias("c")), "cuts"), [], "c_cut").drop("c")
    place = F.col("before") + F.row_number().over(Window.partitionBy("cut").orderBy("at", "key", "id", "crc")) - 1
    placed = ranked.join(cuts, F.col("cut") == F.col("c_cut")).withColumn("place", place)
    shard = F.expr(f"place * {n_shards} div {max(1, total)}")
    return placed.withColumn("shard", shard.cast("int")).select(
        F.col("id").alias(id_col), F.col("source"), "size", F.col("crc").alias("text_crc32"), "shard",
        F.expr(f"place - (shard * bigint({total}) + {n_shards - 1}) div {n_shards}").alias("slot"),
    )
