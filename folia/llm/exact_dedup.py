"""Exact deduplication with a heavy-hitter split."""

from __future__ import annotations

import hashlib

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folia.llm.common import SPACES, materialize

#: Misra-Gries counters. Every digest of more than rows / (HEAVY + 1) rows is found; at most so many winners are broadcast (about 100 bytes each).
HEAVY = 4096


def _digests(batches):
    for b in batches:
        texts = pc.fill_null(b.column("text"), "")
        digests = [hashlib.sha256(t.as_buffer().to_pybytes().translate(None, SPACES)).digest() for t in texts]
        yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(digests, pa.binary()), pc.utf8_length(texts).cast(pa.int64())], names=["id", "digest", "length"])


def misra_gries(batches, counters: int, column: str = "digest"):
    """Summarise the values of all batches of a partition by at most `counters` (value, count) pairs.

    Batches are counted whole, added to the summary, and the (counters + 1)th largest count
    is taken from all: the mergeable form of the algorithm, with the same guarantee.
    """
    held: dict[bytes, int] = {}
    for b in batches:
        for x in pc.value_counts(b.column(column)):
            value = x["values"].as_py()
            held[value] = held.get(value, 0) + x["counts"].as_py()
        if len(held) > counters:
            cut = sorted(held.values(), reverse=True)[counters]
            held = {k: v - cut for k, v in held.items() if v > cut}
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], names=[column, "least"])


def exact_dedup(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", heavy: int = HEAVY) -> DataFrame:
    """Group rows of equal text, spaces and line ends not counted, and mark the one that stays.

    Texts are equal if they are identical without the characters [\x20\x09-\x0D] (by SHA-256
    of the UTF-8 bytes that remain). The longest original, in code points, stays; then the
    smallest id; of fully repeated rows any one.

    1. Digests are taken once, beside the text, and written as small rows.
    2. A Misra-Gries summary of each partition, merged by digest, names the candidates for
       frequent digests; at most `heavy` of them go on.
    3. The candidates are counted exactly and their winners found, pre-aggregated map-side.
    4. These winners are broadcast: rows of frequent digests are settled without a shuffle.
    5. All other digests, none of them frequent, are grouped and joined by an ordinary shuffle.

    Returns a row for each row: id, keep_id, group_size, kept, text_sha256. Null text counts
    as empty; all empty and blank texts are one group. A null id comes after all others.
    Empty table: no rows. Other columns are ignored, whatever their names.
    """
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(_digests, "id long, digest binary, length long")
    rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "digests")
    found = rows.select("digest").mapInArrow(lambda bs: misra_gries(bs, heavy), "digest binary, least long")
    candidates = found.groupBy("digest").agg(F.sum("least").alias("least")).orderBy(F.desc("least"), "digest").limit(heavy).select("digest")

    best = F.min(F.struct((-F.col("length")).alias("shortness"), F.col("id").isNull().alias("no_id"), F.col("id"), F.col("row")))

    def winners(part: DataFrame) -> DataFrame:
        return part.groupBy("digest").agg(F.count(F.lit(1)).alias("group_size"), best.alias("best")).select("digest", "group_size", F.col("best.id").alias("keep_id"), F.col("best.row").alias("keep_row"))

    counted = winners(rows.join(F.broadcast(candidates), "digest", "left_semi"))
    frequent = materialize(counted.filter("group_size > 1").orderBy(F.desc("group_size"), "digest").limit(heavy), "frequent")
    settled = rows.join(F.broadcast(frequent), "digest")
    rest = rows.join(F.broadcast(frequent.select("digest")), "digest", "left_anti")
    rest = rest.join(winners(rest), "digest")
    return settled.unionByName(rest).select(F.col("id").alias(id_col), "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))
